"""The corpus pipeline on a small table that holds everything stages must put up with."""

import random
from collections import Counter, defaultdict

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(500)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(30, 150)))) for i in range(60)]
    clean = dict(texts)
    texts += [(100, texts[3][1]), (101, texts[3][1] + " more"), (4, texts[4][1]), (7, " ".join(rng.choices(vocabulary, k=80)))]
    texts += [(200, None), (201, ""), (202, " \n"), (203, "too few words"), (None, " ".join(rng.choices(vocabulary, k=70))), (204, "again and " * 200)]
    texts.append((205, " ".join(rng.choices(vocabulary, k=12_000))))
    rows = [(k, t, [None, "en", "de"][i % 3], [None, "a", "b"][i % 5 % 3], None if i % 7 == 0 else i, 0.5, "x") for i, (k, t) in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts, at = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns, name
        at = spark.read.parquet(path)
        counts.append(at.count())
    assert counts[0] == len(rows)  # nothing is labelled toxic
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "quality_rules")).collect()}
    assert not kept & {200, 201, 202, 203, 204} and kept >= set(clean) | {205}
    one = Counter(r.doc_id for r in spark.read.parquet(str(tmp_path / "near-dedup")).collect())
    # Copies go, repeated rows too; the unlike text of id 7 stays beside the first.
    assert not one.keys() & {100, 101} and one[4] == 1 and one[7] == 2 and set(one) == kept - {100, 101}
    mixed = Counter(r.doc_id for r in spark.read.parquet(str(tmp_path / "mixing")).collect())
    assert set(mixed) <= set(one) and max(mixed.values()) <= 6
    sequences = defaultdict(list)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in final if r.piece == 0) == mixed
    for r in final:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 4096


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
