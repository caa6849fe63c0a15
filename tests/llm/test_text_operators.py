"""Near duplicates, quality rules, toxicity, licence notices and the language model against plain restatements."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cliptide.llm import _common, language_model, license_scan, near_dedup, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, score int"
SPACE = r"[^\x20\x09-\x0D]+"


def lowered(text):
    return re.findall(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def frame(spark, texts, first=0):
    """Also has extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i if i is None else int(i), t, "en", "s", 0, "x", 1) for i, t in texts], DOCS)


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 120)))) for i in range(n)]
    base = rng.choices(vocabulary, k=80)
    for i in range(40):  # a group of near copies on both sides of the threshold
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = rng.choice(vocabulary)
        texts.append((300 + i, " ".join(words)))
    texts += [(5, texts[0][1].upper()), (6, "one two"), (7, "One\x0btwo"), (8, "one two three"), (1, None), (2, ""), (3, " \t\n"), (None, "solo text"), (9, "a\x85b c"), (9, "a\x85b c")]
    return texts


def shingles(text):
    w = lowered(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_equal_all_pairs(spark):
    texts = corpus()
    sets = [shingles(t) for _, t in texts]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    names = {}
    for i, (k, _) in enumerate(texts):
        names.setdefault(find(i), []).append(k)
    want = []
    for i, (k, _) in enumerate(texts):
        ids = [x for x in names[find(i)] if x is not None]
        low = min(ids) if ids else None
        want.append((k, len(sets[i]), low, k == low))
    got = near_dedup.near_duplicates(frame(spark, texts)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    kept = near_dedup.keep_one(frame(spark, texts))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    # One row of each group, the one of the least id; all rows without words.
    rows = sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect())))
    least = {}
    for i, (k, t) in enumerate(texts):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), (True, math.inf, "")), (k is None, k or 0, t))
    want = [(None if none else k, t) for none, k, t in least.values()] + [(k, t) for k, t in texts if not shingles(t)]
    assert rows == sorted(map(repr, want))


def test_unlike_texts_of_one_id_both_stay(spark):
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six seven"), (2, "one two three four five six seven"), (None, "ix x xi xii xiii"), (None, "ix x xi xii xiii")]
    kept = near_dedup.keep_one(frame(spark, texts)).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, [texts[0], texts[1], texts[3]]))


def test_a_hub_of_many_and_a_shared_passage(spark, monkeypatch):
    """Groups that are dealt into parts, and texts that have much in common but not enough."""
    for module in (near_dedup, _common):
        monkeypatch.setattr(module, "HOT_LEAST", 8)
    rng = random.Random(12)
    draw = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    passage = draw(100)
    texts = [(i, " ".join(passage + draw(80))) for i in range(60)]
    base = draw(150)
    for i in range(60):
        words = list(base)
        words[rng.randrange(150)] = f"y{i}"
        texts.append((100 + i, " ".join(words)))
    texts += [(200 + i, " ".join([*passage, *draw(10)])) for i in range(20)]
    texts += [(300, "w " * 30_000), (301, "w " * 30_001), (302, " ".join(draw(30_000)))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    sets = {k: shingles(t) for k, t in texts}
    for k in got:
        linked = [j for j in got if 100 * len(sets[j] & sets[k]) >= 75 * len(sets[j] | sets[k])]
        assert all(got[j] == got[k] for j in linked) and (len(linked) > 1) == (sum(c == got[k] for c in got.values()) > 1)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 112).astype(np.uint64)
        a, b = near_dedup.minhash(pool[:98]), near_dedup.minhash(pool[14:])  # 84 of 112 in common
        missed += not (near_dedup.band_keys(a) == near_dedup.band_keys(b)).any()
        flips = int(np.bitwise_count((near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b)).view(np.uint64)).sum())
        assert flips <= near_dedup.most_flips()
    assert missed == 0


def test_statistics():
    hashes = quality.WordHashes()
    rng = random.Random(2)
    samples = ["", " \n ", "a", "a b c d e", "a b c d e a b c d e", "x\ny\nx\n \nx", "é# $ <>\n" * 3, "one two " * 20, "a " * 7]
    samples += [" ".join(rng.choices("ab", k=rng.randint(1, 40))) for _ in range(50)]
    for text in samples:
        words = re.findall(SPACE, text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search(SPACE, x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))
        assert quality.statistics(text.encode(), hashes) == want


def prose(rng, n, vocabulary):
    return [" ".join(rng.choices(vocabulary, k=rng.randint(20, 200))) for _ in range(n)]


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    good = list(enumerate(prose(rng, 80, vocabulary)))
    junk = [(100 + i, " ".join(w + rng.choice(["%%%", "$$$", "***"]) for w in rng.choices(vocabulary, k=60))) for i in range(4)]
    edge = [(200, None), (201, ""), (202, "few words"), (203, "again and again and again and " * 10), (None, good[0][1]), (204, "\n".join(f"l{i} x" for i in range(20_000)))]
    rows = {r.doc_id: r for r in quality.quality(frame(spark, good + junk + edge)).collect()}
    assert all(rows[i].kept and not rows[i].base_failed for i, _ in good) and rows[None].kept
    assert not any(rows[100 + i].kept for i in range(4)) and not any(rows[100 + i].base_failed for i in range(4))
    assert all(rows[i].base_failed and not rows[i].kept for i in (200, 201, 202, 203))
    assert rows[204].n_words == 40_000 and not rows[204].base_failed
    small = quality.quality(frame(spark, good[:3])).collect()
    assert all(r.kept and r.distance is not None for r in small)
    assert all(r.distance is None and not r.kept for r in quality.quality(frame(spark, [(1, None), (2, "x")])).collect())
    assert quality.quality(frame(spark, []).limit(0)).count() == 0
    kept = quality.keep_good(frame(spark, good + junk + edge))
    assert kept.columns == frame(spark, good).columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.kept}


def plain_mcd(x, target):
    """The smallest determinant over all shares of the rows."""
    h = math.ceil(quality.COVERAGE * len(x))
    return min(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True) + np.diag(target))[1] for c in itertools.combinations(range(len(x)), h))


@pytest.mark.parametrize("seed", range(6))
def test_determinant_is_the_smallest(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.standard_normal((10, 4)) * [1, 0.1, 0, 2], rng.standard_normal((3, 4)) + 6])
    target = np.full(4, 0.01)
    assert quality.candidates(x, target)[0][quality._D] == pytest.approx(plain_mcd(x, target), abs=0.05)


def test_estimates_of_groups_and_levels(spark, monkeypatch):
    """Languages and sources, nulls among them, small groups and ones that outgrow the subset, against plain loops."""
    monkeypatch.setattr(quality, "SUBSET", 60)
    rng = random.Random(9)
    rows, k = [], 0
    for lang, source, n, size in (("en", "a", 130, 5), ("en", "b", 40, 9), ("de", None, 90, 7), (None, "a", 3, 6), ("en", None, 1, 4)):
        vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(size - 3, size + 3))) for _ in range(300)]
        for i, t in enumerate(prose(rng, n, vocabulary)):
            rows.append((k, t + (" $$ && ## " * 9 if i % 17 == 5 else ""), lang, source))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    hashes = quality.WordHashes()
    stats = {i: quality.statistics(t.encode(), hashes) for i, t, _, _ in rows}

    def vectors(i):
        n, chars, symbols, dup, repeat, lines = stats[i]
        x = [math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(dup / lines), math.sqrt(repeat / n)]
        return np.array(x), 0.25 / np.array([n, chars, lines, n / 5])

    passed = [r for r in rows if not got[r[0]].base_failed]

    def level(members):
        x, t = (np.array(v) for v in zip(*[vectors(r[0]) for r in members], strict=True))
        return len(x), min(quality.candidates(x, t.mean(axis=0)), key=lambda e: e[quality._D])[: quality._I]

    for i, _, lang, source in rows:
        mixed = level(passed)[1]
        for members in ([r for r in passed if r[2] == lang], [r for r in passed if r[2:] == (lang, source)]):
            n, e = level(members)
            mixed = (n * e + quality.PRIOR * mixed) / (n + quality.PRIOR)
        x, t = vectors(i)
        d = x - mixed[:4]
        want = d @ np.linalg.solve(quality.SPREAD * mixed[4:].reshape(4, 4) + np.diag(t), d)
        assert got[i].distance == pytest.approx(want, rel=0.15, abs=0.3), (i, lang, source)
        assert got[i].kept == (not got[i].base_failed and got[i].distance <= quality.LIMIT)
    assert not any(got[r[0]].kept for r in rows if "$$" in r[1])
    assert quality.chi_square_tail(quality.LIMIT, 4) == pytest.approx(1e-6, rel=1e-6) and quality.chi_square_quantile(0.05, 4) == pytest.approx(9.488, abs=1e-3)


def test_gradients_match_differences():
    p = toxicity.empty_params()
    words = [b"alpha", b"beta.", b"gamma", b"d"]
    rows = np.full((3, toxicity.WINDOW), -1)
    rows[0, :4], rows[1, :2] = [0, 1, 2, 3], [2, 0]
    y = np.array([1, 0, 1], np.float32)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x_in = toxicity.embed(p, words)

    def loss(q):
        table = np.concatenate([toxicity.project(q, x_in), toxicity.resting()])
        s = toxicity.probability(toxicity.forward(q, *toxicity.lay_out(table, rows)))
        return -float(np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))

    g, _ = toxicity.gradients(p, x_in, rows, y)
    rng = np.random.default_rng(1)
    for name in ("w", "u", "b", "wa", "va", "wo", "bo"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        up, down = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in p.items()}
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.08, abs=3e-4), name


def test_forward_equals_plain_loops():
    """One number at a time: gates, both directions, attention."""
    p = toxicity.empty_params(3)
    words = [b"alpha", b"be", b"gamma.", b"alpha", b"z"]
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    n = toxicity.UNITS

    def vector(word):
        marked = b"^" + word + b"$"
        grams = [(int.from_bytes(marked[i : i + 3], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 19 for i in range(len(marked) - 2)]
        return [float(p["word"][zlib.crc32(word.strip(toxicity.EDGES)) % toxicity.WORD_ROWS][k]) + sum(float(p["char"][g][k]) for g in grams) / len(grams) for k in range(toxicity.WIDTH)]

    def states(order, way):
        h, out = [0.0] * n, []
        for x in order:
            a = [sum(x[k] * float(p["w"][way][k][j]) for k in range(len(x))) + float(p["b"][way][0][j]) for j in range(3 * n)]
            u = [sum(h[k] * float(p["u"][way][k][j]) for k in range(n)) for j in range(3 * n)]
            z, r = [sigmoid(a[j] + u[j]) for j in range(n)], [sigmoid(a[n + j] + u[n + j]) for j in range(n)]
            c = [math.tanh(a[2 * n + j] + r[j] * u[2 * n + j]) for j in range(n)]
            h = [(1 - z[j]) * h[j] + z[j] * c[j] for j in range(n)]
            out.append(h)
        return out

    x = [vector(w) for w in words]
    both = [f + b for f, b in zip(states(x, 0), states(x[::-1], 1)[::-1], strict=True)]
    e = [sum(float(p["va"][j]) * math.tanh(sum(s[k] * float(p["wa"][k][j]) for k in range(2 * n)) + float(p["ba"][j])) for j in range(n)) for s in both]
    weight = [math.exp(v) / sum(map(math.exp, e)) for v in e]
    pooled = [sum(w * s[k] for w, s in zip(weight, both, strict=True)) for k in range(2 * n)]
    want = sigmoid(sum(float(p["wo"][k]) * pooled[k] for k in range(2 * n)) + float(p["bo"][0]))
    assert toxicity.Scorer(p).score([b" ".join(words)])[0] == pytest.approx(want, abs=1e-5)


def test_sample_is_bound_by_whole_documents():
    assert toxicity.within([5, 9, 4, 1, 7, 0], 10) == [True, False, True, True, False, True]


def test_windows_cover_long_texts():
    p = toxicity.empty_params()
    s = toxicity.Scorer(p)
    rng = random.Random(6)
    words = [bytes(rng.choices(b"abcdefg", k=4)) for _ in range(1000)]
    windows = [b" ".join(words[i : i + toxicity.WINDOW]) for i in range(0, len(words) - (toxicity.WINDOW - toxicity.STRIDE), toxicity.STRIDE)]
    assert s.score([b" ".join(words)], block=7)[0] == pytest.approx(max(s.score(windows)), abs=1e-6)
    assert s.score([None]) == s.score([b""]) == s.score([b" \n"])


def test_toxicity_learns(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("etaoinsh", k=rng.randint(2, 7))) for _ in range(200)]
    texts, labels = [], []
    for i in range(240):
        words = rng.choices(vocabulary, k=rng.randint(20, 90))
        if i % 4 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zukkwort", "zukkling", "zukkerei", "vraxxor", "vraxxel"])
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    texts += [(900, None), (901, ""), (None, "plain"), (902, " ".join(words) + " far" * 20_000), (903, " far" * 300)]
    frame_labels = spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(frame(spark, texts), frame_labels).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i].held_out == (i in held) for i in range(240)) and not rows[None].held_out
    assert sum(rows[i].predicted == (i % 4 == 0) for i in held) >= 0.93 * len(held)
    assert rows[900].score == rows[901].score and rows[900].predicted == 0 and rows[902].score >= max(rows[903].score, 0)
    kept = toxicity.drop_toxic(frame(spark, texts), frame_labels)
    assert kept.columns == frame(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if not r.predicted}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def license_texts():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choices(["lorem", "ipsum", "dolor", "software", "license", "the", "of", "use"], k=n))
    full = {name: t[-1] for name, t in license_scan.TEMPLATES.items()}
    notice = license_scan.TEMPLATES["MIT"][0]
    texts = [(1, notice), (2, f"before\n{notice}\nafter"), (3, "Foo bar. " + notice + " More text here."), (4, None), (5, ""), (6, "released"), (7, "Released under the MIT licence.")]
    texts += [(8, "This work is licensed under the GNU\n General Public License, version 3.\n" + notice), (9, "a b " * 5000), (10, "Copyright 2020 Acme Inc, released under the\nMIT License.")]
    texts += [(20 + i, f"{filler(50)}\n{full[name]}\n{filler(30)}") for i, name in enumerate(sorted(full))]
    texts.append((50, filler(9) + " " + " ".join(w for i, w in enumerate(full["MIT"].split()) if i % 40 != 7) + filler(9)))
    texts.append((51, " ".join(full["ISC"].split()[: len(full["ISC"].split()) // 2])))
    return texts


def test_licenses_agree_with_sql(spark):
    texts = license_texts()
    got = {r.doc_id: (r.license, r.dice, r.n_licenses) for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert all(got[k][0] == "MIT" for k in (1, 2, 3, 10, 50)) and got[8][2] == 2 and got[8][0] in ("GPL-3.0", "MIT")
    assert all(got[20 + i][:2] == (name, 1.0) for i, name in enumerate(sorted(license_scan.TEMPLATES)))
    assert all(got[k] == (None, None, 0) for k in (4, 5, 6, 9, 51))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    want = sorted(map(repr, con.execute(f"SELECT doc_id, license, dice, n_licenses FROM ({license_scan.oracle()})").fetchall()))
    assert sorted(map(repr, (tuple(r) for r in license_scan.scan_licenses(frame(spark, texts)).collect()))) == want
    twice = license_scan.scan_licenses(frame(spark, [texts[0], texts[0]])).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and license_scan.scan_licenses(frame(spark, []).limit(0)).count() == 0


def test_anchors_find_what_all_windows_find():
    """Every window of a text that is close enough to a template holds an anchor of it."""
    shapes = license_scan.shapes_of(license_scan.TEMPLATES)
    rng = random.Random(6)
    for s in shapes:
        for _ in range(20):
            kept = [g for g in s.grams if rng.random() < 0.75]
            own = set(kept) | {f"{i} {i}" for i in range(rng.randint(0, 5))}
            if 2 * 100 * len(own & set(s.set)) >= license_scan.LEAST * (len(own) + len(s.set)):
                assert own & {g for g, _ in s.anchors}


def test_language_model(spark):
    texts = corpus(9) + [(None, "w1 w2")]
    train = Counter()
    for k, t in texts:
        if k is None or zlib.crc32(str(k).encode()) % 5 != 1:
            train.update([*lowered(t), None])
    n, v = sum(train.values()), len(train)
    for limits in ({}, {"filter_bytes": 2000, "head_words": 10}):
        got = language_model.score_texts(frame(spark, texts), **limits).collect()
        assert len(got) == len(texts)
        want = sorted(
            (str(k), len(lowered(t)) + 1, sum(w in train for w in [*lowered(t), None]), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*lowered(t), None]))
            for k, t in texts
        )
        have = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
        assert [x[:4] for x in have] == [x[:4] for x in want]
        assert [x[4] for x in have] == pytest.approx([x[4] for x in want], rel=1e-9)
        assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert language_model.score_texts(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"filter_bytes": 60_000}])
def test_scores_equal_dictionaries_of_bigrams(spark, monkeypatch, limits):
    """The model with exact tables in place of the filter, which is made too large to err."""
    monkeypatch.setattr(language_model, "BITS", 80)
    monkeypatch.setattr(language_model, "RANGE_BYTES", 500)
    rng = random.Random(13)
    texts = corpus(10) + [(400 + i, "the cat sat on the mat " * rng.randint(1, 9)) for i in range(9)] + [(None, "w1 w2"), (500, "w3 " * 30_000), (501, None), (502, "w3 " * 30_000)]
    ones, twos = Counter(), Counter()
    for k, t in texts:
        if k is None or zlib.crc32(str(k).encode()) % 5 != 1:
            w = [*lowered(t), None]
            ones.update(w)
            twos.update(zip([None, *w], w, strict=False))
    z = sum(ones.values()) + 0.5 * (len(ones) + 1)
    least = lambda c: int(language_model.least_count(language_model.level_of(np.array([c])))[0])
    largest = lambda c: int(language_model.largest_count(language_model.level_of(np.array([c])))[0])

    def score(t):
        total = 0.0
        for h, w in zip([None, *lowered(t)], [*lowered(t), None], strict=True):
            pair = least(twos[(h, w)])
            total += math.log10((pair + language_model.MU * (least(ones[w]) + 0.5) / z) / (max(largest(ones[h]), pair) + language_model.MU))
        return total

    got = sorted(((str(r.doc_id), r.n_tokens, r.score) for r in language_model.score_texts(frame(spark, texts), **limits).collect()))
    want = sorted((str(k), len(lowered(t)) + 1, score(t)) for k, t in texts)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)


def test_filter_holds_every_count():
    rng = np.random.default_rng(2)
    hashes, counts = rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2), rng.geometric(0.3, 4000)
    part = language_model.build_part(hashes, counts).tobytes()
    f = language_model.Filter([len(part)], part)
    levels = f.levels(hashes).astype(int)
    assert (levels >= language_model.level_of(counts)).all() and (levels == language_model.level_of(counts)).mean() > 0.95
    assert (f.levels(hashes + np.uint64(1)) > 0).mean() < 0.04
