"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a hashed word vector and the mean of its hashed
character-trigram vectors. The network reads windows of WINDOW words; a text is
covered by windows that start every STRIDE words, half a window, all of which are
scored, and the text's score is the highest of theirs (a text without words is
scored as one empty window). Training is plain numpy on the driver, from a bounded
sample of labelled documents (SAMPLE_DOCS and SAMPLE_WORDS of each class), whose
whole texts are cut into windows that start every LEARN_STRIDE words; then the
windows of clean sample documents that score highest are trained on once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cliptide.llm._common import WORD, fold_of, lower_words

WINDOW, STRIDE, LEARN_STRIDE = 48, 24, 40
#: Labelled documents of each class that the network learns from, at most, and their words. In the
#: order of a hash of their ids, documents are taken whole; one that doesn't fit any more is passed over.
SAMPLE_DOCS, SAMPLE_WORDS = 3000, 1_000_000
#: Clean windows that a document has, counted when false alarms are weighed against misses.
ALARM_WEIGHT = 40
#: Distinct words whose projections a task remembers before it forgets them all.
MEMO_WORDS = 200_000
WORD_ROWS, CHAR_ROWS, WIDTH, UNITS = 1 << 14, 1 << 13, 16, 8
#: Share of a batch's words whose word vector is shown in training; the rest rely on their trigrams.
WORD_SHOWN = 0.5
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: A toxic document's window is kept if the first network scores it above this share of the clean ones.
CLEAN_QUANTILE = 0.995
EDGES = b".,;:!?\"'()[]"

#: The role of clean windows that only set the threshold.
CALIBRATE = -1

Params = dict[str, np.ndarray]


def word_row(word: bytes) -> int:
    return zlib.crc32(word.strip(EDGES)) % WORD_ROWS


def char_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of ``^word$`` for all words in one array, and where each word's begin."""
    buffer = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = (buffer[:-2] << 16 | buffer[1:-1] << 8 | buffer[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - 13)
    first = np.cumsum(lengths) - lengths
    inside = np.ones(len(buffer), bool)
    inside[np.concatenate([first + lengths - 1, first + lengths - 2])] = False
    counts = lengths - 2
    return codes[inside[: len(codes)]].astype(np.int64), np.cumsum(counts) - counts


def empty_params(seed: int = 7) -> Params:
    r = np.random.default_rng(seed)
    f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    return {
        "word": f(WORD_ROWS, WIDTH, scale=0.05), "char": f(CHAR_ROWS, WIDTH, scale=0.3),
        "w": f(2, WIDTH, 3 * UNITS, scale=0.3), "b": np.zeros((2, 1, 3 * UNITS), np.float32),
        "u": f(2, UNITS, 3 * UNITS, scale=0.3),
        "wa": f(2 * UNITS, UNITS, scale=0.3), "ba": np.zeros(UNITS, np.float32), "va": f(UNITS, scale=0.3),
        "wo": f(2 * UNITS, scale=0.3), "bo": np.zeros(1, np.float32),
    }


def gate(x: np.ndarray) -> np.ndarray:
    """The logistic function."""
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def slope(value: np.ndarray) -> np.ndarray:
    """tanh' where tanh is ``value``."""
    return np.float32(1) - np.square(value)


def gate_slope(value: np.ndarray) -> np.ndarray:
    return value * (np.float32(1) - value)


def embed(p: Params, words: list[bytes]) -> np.ndarray:
    """(words, WIDTH) input vectors."""
    rows = np.fromiter(map(word_row, words), np.int64, len(words))
    codes, first = char_rows(words)
    counts = np.diff(np.append(first, len(codes)))
    return p["word"][rows] + np.add.reduceat(p["char"][codes], first, axis=0) / counts[:, None].astype(np.float32)


def project(p: Params, x: np.ndarray) -> np.ndarray:
    """(words, 2, 3 * UNITS): what both directions' gates get from each word."""
    return (x @ p["w"] + p["b"]).transpose(1, 0, 2)


def resting() -> np.ndarray:
    """The projected row of a place without a word: its gate leaves the state alone."""
    x = np.zeros((1, 2, 3 * UNITS), np.float32)
    x[:, :, :UNITS] = -1e8
    return x


def lay_out(table: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows ``rows`` (B, T; -1: no word) of a table that ends in ``resting()``: inputs
    (T, 2, 3U, B), direction 1 reversed in time, and the mask (T, B) of what attention may see."""
    mask = (rows >= 0).T
    mask[0, ~mask.any(axis=0)] = True
    x = np.empty((rows.shape[1], 2, 3 * UNITS, len(rows)), np.float32)
    x[:, 0] = table[:, 0][rows.T].transpose(0, 2, 1)
    x[:, 1] = table[:, 1][rows.T[::-1]].transpose(0, 2, 1)
    return x, mask


def forward(p: Params, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows laid out by ``lay_out``."""
    steps, _, _, n = x.shape
    ut = np.ascontiguousarray(p["u"].transpose(0, 2, 1))
    h = np.zeros((2, UNITS, n), np.float32)
    states = np.empty((steps, 2, UNITS, n), np.float32)
    kept = []
    for t in range(steps):
        g = ut @ h
        zr = gate(x[t, :, : 2 * UNITS] + g[:, : 2 * UNITS])
        z, r = zr[:, :UNITS], zr[:, UNITS:]
        c = np.tanh(x[t, :, 2 * UNITS :] + r * g[:, 2 * UNITS :])
        if keep:
            kept.append((h, z, r, c, g[:, 2 * UNITS :]))
        h = h + z * (c - h)
        states[t] = h
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=1)
    a = np.tanh(p["wa"].T @ both + p["ba"][:, None])
    e = np.where(mask, p["va"] @ a, np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    weight = e / e.sum(axis=0)
    pooled = (weight[:, None, :] * both).sum(axis=0)
    logit = p["wo"] @ pooled + p["bo"]
    return (logit, kept, both, a, weight, pooled) if keep else logit


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def gradients(p: Params, x_in: np.ndarray, rows: np.ndarray, y: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the mean log loss for windows ``rows`` of input vectors ``x_in``."""
    n, steps = rows.shape
    table = np.concatenate([project(p, x_in), resting()])
    x, mask = lay_out(table, rows)
    logit, kept, both, a, weight, pooled = forward(p, x, mask, True)
    g: Params = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
    d_logit = ((probability(logit) - y) / n).astype(np.float32)
    g["bo"][:] = d_logit.sum()
    g["wo"] = pooled @ d_logit
    d_pooled = p["wo"][:, None] * d_logit
    d_weight = (both * d_pooled).sum(axis=1)
    d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["va"] = np.tensordot(a, d_e, ((0, 2), (0, 1)))
    d_a = d_e[:, None, :] * p["va"][:, None] * slope(a)
    g["wa"] = np.tensordot(both, d_a, ((0, 2), (0, 2)))
    g["ba"] = d_a.sum(axis=(0, 2))
    d_both = weight[:, None, :] * d_pooled + p["wa"] @ d_a
    d_states = np.stack([d_both[:, :UNITS], d_both[::-1, UNITS:]], axis=1)
    d_x = np.empty_like(x)
    d_h = np.zeros((2, UNITS, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, gc = kept[t]
        d_h = d_h + d_states[t]
        d_c = d_h * z * slope(c)
        d_z = d_h * (c - h) * gate_slope(z)
        d_r = d_c * gc * gate_slope(r)
        d_x[t] = np.concatenate([d_z, d_r, d_c], axis=1)
        d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
        g["u"] += h @ d_g.transpose(0, 2, 1)
        d_h = d_h * (1 - z) + p["u"] @ d_g
    d_table = np.stack([
        summed(rows.T.ravel() % len(table), d_x[:, 0].transpose(0, 2, 1).reshape(-1, 3 * UNITS), len(table)),
        summed(rows.T[::-1].ravel() % len(table), d_x[:, 1].transpose(0, 2, 1).reshape(-1, 3 * UNITS), len(table)),
    ])[:, :-1]
    g["w"] = x_in.T[None] @ d_table
    g["b"] = d_table.sum(axis=1, keepdims=True)
    return g, (d_table @ p["w"].transpose(0, 2, 1)).sum(axis=0)


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    order = np.argsort(rows, kind="stable")
    found, first = np.unique(rows[order], return_index=True)
    out = np.zeros((n, values.shape[1]), np.float32)
    out[found] = np.add.reduceat(values[order], first, axis=0)
    return out


def train(windows: list[tuple[list[bytes], int]], epochs: int = 4, batch: int = 96, rate: float = 0.015, start: Params | None = None, seed: int = 11) -> Params:
    """Adam on the windows' labels; each class weighs as its windows."""
    p = start or empty_params()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    r = np.random.default_rng(seed)
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(windows))
        for lo in range(0, len(order), batch):
            part = [windows[i] for i in order[lo : lo + batch]]
            vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in part for w in words))}
            if not vocabulary:
                continue
            words = list(vocabulary)
            rows = np.full((len(part), WINDOW), -1)
            for i, (text, _) in enumerate(part):
                rows[i, : len(text)] = [vocabulary[w] for w in text]
            y = np.array([v for _, v in part], np.float32)
            at = np.fromiter(map(word_row, words), np.int64, len(words))
            shown = r.random((len(words), 1)) < WORD_SHOWN
            g, d_in = gradients(p, embed(p, words) - np.where(shown, np.float32(0), p["word"][at]), rows, y)
            codes, first = char_rows(words)
            counts = np.diff(np.append(first, len(codes)))
            g["word"] = summed(at, d_in * shown, WORD_ROWS)
            g["char"] = summed(codes, np.repeat(d_in / counts[:, None].astype(np.float32), counts, axis=0), CHAR_ROWS)
            step += 1
            lr = rate * (1 - 0.9 * epoch / max(1, epochs - 1)) if epochs > 1 else rate
            for k, (m, v) in moments.items():
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] * g[k] - v)
                p[k] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


class Scorer:
    """Scores texts' windows; remembers projected words up to a bound."""

    def __init__(self, p: Params):
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.empty((1 << 14, 2, 3 * UNITS), np.float32)
        self.table[-1] = resting()[0]
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            x = project(self.p, embed(self.p, part))
            while self.used + len(part) >= len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[-1] = resting()[0]
            self.table[self.used : self.used + len(part)] = x
            self.rows.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Rows of ``words``, learnt if they are new."""
        if new := [w for w in dict.fromkeys(words) if w not in self.rows]:
            self._learn(new)
        return np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))

    def score_windows(self, rows: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """rows: (windows, WINDOW), -1 where there is no word."""
        out = np.empty(len(rows))
        for lo in range(0, len(rows), chunk):
            out[lo : lo + chunk] = probability(forward(self.p, *lay_out(self.table, rows[lo : lo + chunk])))
        return out

    def score(self, texts: Iterator[bytes | None], block: int = 8192) -> list[float]:
        """The highest window score of each text; a block of windows is held at a time, also of one long text."""
        best: list[float] = []
        rows = np.full((block, WINDOW), -1, np.int32)
        owner = np.empty(block, np.int64)
        used = 0

        def flush() -> None:
            nonlocal used
            top = self.score_windows(rows[:used])
            for i, s in zip(owner[:used].tolist(), top.tolist(), strict=True):
                best[i] = max(best[i], s)
            rows[:used] = -1
            used = 0

        for text in texts:
            best.append(0.0)
            words = lower_words(text)
            for lo in range(0, max(1, len(words) - (WINDOW - STRIDE)), STRIDE * 1024):
                span = words[lo : lo + STRIDE * 1024 + WINDOW - STRIDE]
                if self.used + len(span) > MEMO_WORDS:  # windows in hand refer to the words remembered
                    if used:
                        flush()
                    self.clear()
                starts = np.arange(0, max(1, len(span) - (WINDOW - STRIDE)), STRIDE)
                at = np.full(starts[-1] + WINDOW, -1, np.int32)
                at[: len(span)] = self.places(span)
                windows = np.lib.stride_tricks.sliding_window_view(at, WINDOW)[starts]
                while len(windows):
                    part = windows[: block - used]
                    rows[used : used + len(part)] = part
                    owner[used : used + len(part)] = len(best) - 1
                    used += len(part)
                    windows = windows[len(part) :]
                    if used == block:
                        flush()
        if used:
            flush()
        return best


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of labelled documents."""
    for batch in batches:
        texts, roles = [], []
        for text, y in zip(batch.column("text").cast(pa.binary()), batch.column("toxic").to_pylist(), strict=True):
            words = lower_words(text.as_py())
            role = CALIBRATE if not y and zlib.crc32(b" ".join(words[:WINDOW])) % 3 == 0 else y
            for s in range(0, max(1, len(words) - (WINDOW - LEARN_STRIDE)), LEARN_STRIDE):
                texts.append(b" ".join(words[s : s + WINDOW]))
                roles.append(role)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(roles, pa.int32())], ["window", "role"])


def within(sizes: list[int], most: int) -> list[bool]:
    """Which of a row of sizes are taken so that no more than ``most`` comes together."""
    out = []
    for size in sizes:
        out.append(size <= most)
        most -= size if out[-1] else 0
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Params:
    """Learns from labelled documents whose crc32(doc_id) mod 3 is not 1.

    Documents without a label, labels without a document and null labels teach
    nothing; of several labels of one document the largest counts. Without
    windows the network stays as drawn, shifted to score everything near 0.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).join(
        docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi"
    )
    order = F.xxhash64("doc_id")
    sample = known.filter("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_DOCS).union(
        known.filter("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE_DOCS)
    )
    # At most 2 * SAMPLE_DOCS ids: a bounded broadcast.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    sizes = texts.groupBy("doc_id", "toxic").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).alias("words")).orderBy(order, "doc_id").collect()
    taken = [r.doc_id for y in (0, 1) for r, fits in zip([r for r in sizes if r.toxic == y], within([r.words for r in sizes if r.toxic == y], SAMPLE_WORDS), strict=True) if fits]
    # From Arrow, as rows would start Python workers that then stay beside those of the mapped steps.
    chosen = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(taken, to_arrow_type(texts.schema["doc_id"].dataType))}))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic").mapInArrow(_sample, "window binary, role int").toArrow()
    same: dict[bytes, bytes] = {}  # one object for each distinct word
    windows = [([same.setdefault(v, v) for v in w.split()], y) for w, y in sorted(zip(rows.column("window").to_pylist(), rows.column("role").to_pylist(), strict=True))]
    del rows, same
    apart = [w for w, y in windows if y == CALIBRATE]
    windows = [(w, y) for w, y in windows if y != CALIBRATE]
    if not any(y for _, y in windows) or all(y for _, y in windows):
        p = empty_params()
        p["bo"][:] = -4
        return p
    return learn(windows, apart)


def unlike(windows: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """Clean windows, then toxic ones, without those that repeat a good part of one before them:
    copies with other labels, or on both sides of a split, would teach texts by heart."""
    seen = np.zeros(1 << 27 - 3, np.uint8)
    out = []
    for words, y in sorted(windows, key=lambda w: w[1]):
        grams = np.unique([zlib.crc32(b" ".join(words[i : i + 4])) >> 5 for i in range(max(1, len(words) - 3))])
        at, bit = grams >> 3, np.uint8(1) << (grams & 7).astype(np.uint8)
        if 5 * np.count_nonzero(seen[at] & bit) < len(grams):
            out.append((words, y))
        np.bitwise_or.at(seen, at, bit)
    return out


def learn(windows: list[tuple[list[bytes], int]], apart: list[list[bytes]] = ()) -> Params:
    """Trains twice. A toxic document's windows are toxic only where its toxic words are, so two
    first networks, each trained briefly on half of the windows, tell which windows of the other
    half to keep: those that score above nearly all clean ones. (Equal windows share a half.) The
    last network is trained on these and on all clean windows, at the end on the clean windows
    that score highest. Its bias is then moved until THRESHOLD lies where false alarms on the
    clean windows kept ``apart`` and misses cost least."""
    windows = unlike(windows)
    texts = [b" ".join(w) for w, _ in windows]
    y = np.array([v for _, v in windows])
    half = np.array([zlib.crc32(t) & 1 for t in texts])
    first = np.ones(len(windows))
    for side in (0, 1):
        taught = [windows[i] for i in np.flatnonzero(half != side)]
        judged = np.flatnonzero(half == side)
        if any(v for _, v in taught) and len(judged):
            p = train(taught, max(3, min(40, 30_000 // len(taught))))
            first[judged] = Scorer(p).score(texts[i] for i in judged)
    cut = np.quantile(first[y == 0], CLEAN_QUANTILE)
    kept = [i for i in range(len(windows)) if not y[i] or first[i] >= cut]
    p = train([windows[i] for i in kept], max(3, min(40, 45_000 // len(kept))), seed=12)
    second = np.array(Scorer(p).score(texts))
    hard = sorted((i for i in kept if not y[i]), key=lambda i: -second[i])[: max(64, len(kept) // 20)]
    p = train([windows[i] for i in kept + 2 * hard], 1, rate=0.002, start=p, seed=13)
    logit = lambda q: np.log(np.clip(q, 1e-9, 1) / np.clip(1 - np.array(q), 1e-9, 1))
    clean = np.sort(logit(Scorer(p).score([texts[i] for i in hard] + [b" ".join(w) for w in apart])))
    toxic = np.sort(logit(Scorer(p).score(texts[i] for i in kept if y[i])))
    cuts = np.unique(np.concatenate([clean, toxic]))
    alarms = 1 - np.searchsorted(clean, cuts, side="right") / max(1, len(clean))
    misses = np.searchsorted(toxic, cuts, side="right") / max(1, len(toxic))
    best = int(np.argmin(ALARM_WEIGHT * alarms + misses))
    cut = (cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2
    p["bo"] += np.float32(logit(THRESHOLD) - cut)
    return p


def score_documents(docs: DataFrame, params: Params, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score to every row; all columns pass through. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(params)
    at = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = (t.as_py() for t in batch.column(at).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scorer.score(texts), pa.float64())], [*batch.schema.names, score_col]
            )

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    held_out: crc32(doc_id as text) mod 3 is 1 (null id: false), never learnt
    from. Scores read the text alone; null and empty texts get the score of an
    empty window, repeated rows equal scores. Extra columns are ignored; an
    empty table gives no rows.
    """
    params = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = score_documents(rows, params)
    return rows.select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of documents that score below THRESHOLD, with all their columns."""
    scored = score_documents(docs, fit(docs, labels), score_col="__toxicity")
    return scored.filter(F.col("__toxicity") < THRESHOLD).select(*docs.columns)
