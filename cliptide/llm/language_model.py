"""Bigram language model in a log-frequency Bloom filter.

Counting packs each task's distinct n-gram hashes into blocks by hash range; a
range's blocks meet in one task, which adds them up and builds the range's part
of the filter. Counts are quantised on a logarithmic grid (GRID): an n-gram of
level j is entered j times, as (n-gram, 1) ... (n-gram, j), and a reader probes
level after level until one is missing. The number of ranges follows the bytes of
text (RANGE_BYTES), so a range stays one task's work however files are cut.

The parts, of single words and of bigrams, are broadcast up to FILTER_BYTES at a
time. A larger filter is read in several passes over the texts, each with as many
parts as fit, which note the levels found; nothing is left out. So a worker's memory
is bounded and the passes grow with the filter: larger executors allow more bytes.

Smoothing: P(w | h) = (c(h w) + MU * P(w)) / (c(h) + MU), P(w) = (c(w) + 0.5) /
(N + 0.5 (V + 1)). Counts come from the filter, numerators as the least count of
their level and c(h) as the largest, so that but for false hits (about 1 in 80)
probabilities sum to no more than 1. The history of a text's first token is the
end token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm._common import Scratch, WordHashes, fold_of, hot_join, lower_words, mix64

FOLDS, HELD_OUT = 5, 1
MU = 8.0
BITS, PROBES = 9, 6
#: Filter bytes that are broadcast at a time, and words whose exact counts are.
FILTER_BYTES, HEAD_WORDS = 256 << 20, 2_000_000
#: Text that makes one range, about.
RANGE_BYTES = 8 << 20
#: Tokens that a task scores at a time, and that it counts before it passes them on.
CHUNK, COUNTED = 1 << 18, 1 << 21
#: A word can't hold a space.
END = np.uint64(xxhash.xxh64_intdigest(b" end"))
_STEP, _LEVEL = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def _grid() -> np.ndarray:
    """Least count of each level: 1, 2, 3, then growing by a quarter."""
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, np.int64)


GRID = _grid()


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(GRID, counts, side="right")


def least_count(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, GRID[np.maximum(levels, 1) - 1], 0)


def largest_count(levels: np.ndarray) -> np.ndarray:
    return GRID[levels] - 1


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Bigram hashes of one text's tokens, the first after the end token."""
    return mix64(np.concatenate([[END], words[:-1]]) * _STEP + words)


def build_part(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Packed bits of one range's part; its size follows its entries."""
    levels = level_of(counts)
    size = max(64, int(levels.sum()) * BITS + 63 & ~63)
    flags = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, step = _walk(hashes[levels >= level], level)
        for _ in range(PROBES):
            flags[_place(at, np.uint64(size))] = True
            at += step
    return np.packbits(flags, bitorder="little")


def _walk(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of an n-gram's level start, and their odd step."""
    h = mix64(hashes + np.uint64(_LEVEL * level % (1 << 64)))
    return h, (h * _STEP) | np.uint64(1)


def _place(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bit below ``sizes`` (less than 2^32) for 64-bit values, by their upper half."""
    return (at >> np.uint64(32)) * sizes >> np.uint64(32)


class Filter:
    """The parts of all ranges in a row, read in place; a range of size 0 has no level."""

    def __init__(self, sizes: list[int], data: bytes):
        self.ranges = len(sizes)
        self.shift = np.uint64(64 - self.ranges.bit_length() + 1)
        self.sizes = 8 * np.array(sizes, np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bits = np.frombuffer(data, np.uint8)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint8)
        part = (hashes >> self.shift).astype(np.int64) if self.ranges > 1 else np.zeros(len(hashes), np.int64)
        live = np.flatnonzero(self.sizes[part] > 0)
        starts, sizes = self.starts[part[live]], self.sizes[part[live]]
        level = 1
        while len(live):
            at, step = _walk(hashes[live], level)
            for _ in range(PROBES):
                bit = starts + _place(at, sizes)
                hit = (self.bits[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                live, at, step, starts, sizes = live[hit], at[hit], step[hit], starts[hit], sizes[hit]
                at += step
            out[live] = level
            level += 1
        return out


def _counted(ranges: int):
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        held: list[np.ndarray] = []
        grams: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for n, arrays in ((1, held), (2, grams)):
                hashes, counts = np.unique(np.concatenate(arrays), return_counts=True)
                part = (hashes >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(hashes), np.int64)
                found, first = np.unique(part, return_index=True)
                h, c = np.split(hashes, first[1:]), np.split(counts.astype(np.uint32), first[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(found), pa.int32()), pa.array(found.astype(np.int32)), pa.array([x.tobytes() for x in h], pa.binary()), pa.array([x.tobytes() for x in c], pa.binary())],
                    ["n", "part", "hashes", "counts"],
                )
            held.clear()
            grams.clear()

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                words = lower_words(text.as_py())
                w = np.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), END)
                held.append(w)
                grams.append(pairs_of(w))
                size += len(w)
                if size >= COUNTED:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return count


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range's sums and its part of the filter; single words also keep their counts. Blocks come
    range by range, and one range is held at a time."""
    key, held = None, []

    def done() -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _ in held])
        counts = np.concatenate([c for _, c in held]).astype(np.int64)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        hashes, counts = hashes[first], np.add.reduceat(counts, first)
        n, part = key
        words = hashes.view(np.int64) if n == 1 else np.empty(0, np.int64)
        times = counts if n == 1 else np.empty(0, np.int64)
        ends = pa.array(np.array([0, len(words)], np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()), pa.array([part], pa.int32()), pa.array([int(counts.sum())]), pa.array([len(hashes)]),
             pa.array([build_part(hashes, counts).tobytes()], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(words)), pa.ListArray.from_arrays(ends, pa.array(times))],
            ["n", "part", "total", "distinct", "bits", "words", "times"],
        )

    for batch in batches:
        for n, part, h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if key is not None and key != (n, part):
                yield done()
                held.clear()
            key = (n, part)
            held.append((np.frombuffer(h.as_buffer(), np.uint64).copy(), np.frombuffer(c.as_buffer(), np.uint32).copy()))
    if held:
        yield done()


_MODEL = "n int, part int, total long, distinct long, bits binary, words array<long>, times array<long>"


def train(docs: DataFrame, scratch: Scratch, text_col: str) -> tuple[DataFrame, int]:
    """(model table, number of ranges) from all rows of ``docs``."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()[0]["bytes"] or 0
    ranges = 1 << max(4, (size // RANGE_BYTES).bit_length())
    blocks = texts.mapInArrow(_counted(ranges), "n int, part int, hashes binary, counts binary")
    dealt = blocks.repartition(2 * ranges, "n", "part").sortWithinPartitions("n", "part")
    return scratch.save(dealt.mapInArrow(_merged, _MODEL), "lz4"), ranges


def _scorer(shared, last: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, head, times, total, distinct = shared.value
        z = total + 0.5 * (distinct + 1)
        unknown = np.log10(0.5 / z) if z else 0.0
        ones, twos = Filter(*words), Filter(*pairs)
        memo = WordHashes()
        for batch in batches:
            texts, priors = batch.column("text").cast(pa.binary()), batch.column("levels")
            out: list[tuple] = []
            lo, n = 0, len(texts)
            while lo < n:
                tokens, size, hi = [], 0, lo
                while hi < n and (size < CHUNK or hi == lo):
                    w = lower_words(texts[hi].as_py())
                    tokens.append(np.append(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)), END))
                    size += len(tokens[-1])
                    hi += 1
                flat = np.concatenate(tokens)
                starts = np.cumsum([0, *map(len, tokens)])
                grams, same = np.unique(np.concatenate([pairs_of(t) for t in tokens]), return_inverse=True)
                found, back = np.unique(flat, return_inverse=True)
                # Levels of pairs, then of single words; a range's part is in one pass alone.
                levels = np.stack([twos.levels(grams)[same], ones.levels(found)[back]])
                for k, prior in enumerate(priors[lo:hi]):
                    if prior.is_valid:
                        levels[:, starts[k] : starts[k + 1]] += np.frombuffer(prior.as_buffer(), np.uint8).reshape(2, -1)
                if not last:
                    out += [levels[:, starts[k] : starts[k + 1]].tobytes() for k in range(len(tokens))]
                    lo = hi
                    continue
                level = np.zeros(len(found), np.int64)
                level[back] = levels[1]
                levels = levels[0].astype(np.int64)
                single = (least_count(level) + 0.5) / z
                most = largest_count(level)
                before = np.empty(len(flat), np.int64)
                end = np.searchsorted(found, END)
                before[1:], before[starts[:-1]] = back[:-1], end
                p = (least_count(levels) + MU * single[back]) / (np.maximum(most[before], least_count(levels)) + MU)
                at = np.minimum(np.searchsorted(head, found), max(0, len(head) - 1))
                exact = np.where(head[at] == found, times[at], 0) if len(head) else np.zeros(len(found), np.int64)
                base = np.where(exact > 0, np.log10((exact + 0.5) / z), unknown) if z else np.zeros(len(found))
                sums = np.add.reduceat(np.stack([np.log10(p) if z else np.zeros(len(flat)), base[back], (exact > 0)[back]]), starts[:-1], axis=1)
                for k in range(len(tokens)):
                    rest = back[starts[k] : starts[k + 1]]
                    rest, tf = np.unique(rest[exact[rest] == 0], return_counts=True)
                    out.append((len(tokens[k]), float(sums[0, k]), float(sums[1, k]), int(sums[2, k]), hashlib.md5(texts[lo + k].as_py() or b"").digest(), found[rest].view(np.int64), tf))
                lo = hi
            if not last:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], batch.schema.names)
                continue
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_tokens", "score", "base", "known", "text_key", "rest", "rest_times"],
            )

    return score


_SCORED = "doc_id long, n_tokens long, score double, base double, known long, text_key binary, rest array<long>, rest_times array<long>"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Learns from rows whose crc32(doc_id as text) mod 5 is not 1 (a null id: 0).
    Null and empty texts are one end token. Without training rows N and V are 0:
    base_score then has one equal share for all, log10(1), and score is 0 too.
    Exact counts: those of the most frequent ``head_words`` words are broadcast;
    the others' join the texts' remaining words as tables. Repeated rows get
    equal results; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language_model")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model, ranges = train(rows.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT), scratch, "text")
    sums = model.filter("n = 1").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).collect()[0]
    total, distinct = sums["total"] or 0, sums["distinct"] or 0
    vocabulary = scratch.save(model.filter("n = 1").select(F.explode(F.arrays_zip("words", "times")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.times").alias("times")))
    # Distinct counts number at most the square root of twice the tokens.
    least, held = 1, 0
    for r in sorted(vocabulary.groupBy("times").count().collect(), key=lambda r: -r["times"]):
        held += r["count"]
        if held > head_words:
            least = r["times"] + 1
            break
    head = _head(vocabulary, least)
    bits = {(r["n"], r["part"]): r["size"] for r in model.select("n", "part", F.length("bits").alias("size")).collect()}
    passes: list[list[tuple[int, int]]] = [[]]
    room = filter_bytes
    for key in sorted(bits, key=lambda k: (-k[0], k[1])):
        if passes[-1] and bits[key] > room:
            passes.append([])
            room = filter_bytes
        passes[-1].append(key)
        room -= bits[key]
    scored = rows.withColumn("levels", F.lit(None).cast("binary"))
    for i, keys in enumerate(passes):
        last = i == len(passes) - 1
        words, pairs = (_parts(model, ranges, n, {p for m, p in keys if m == n}) for n in (1, 2))
        shared = spark.sparkContext.broadcast((words, pairs, *(head if last else (None, None)), total, distinct))
        scored = scratch.save(scored.mapInArrow(_scorer(shared, last), _SCORED if last else "doc_id long, text string, levels binary"))
    z = total + 0.5 * (distinct + 1)
    rest = scored.select("text_key", "rest", "rest_times").dropDuplicates(["text_key"]).select("text_key", F.explode(F.arrays_zip("rest", "rest_times")).alias("r"))
    tail = vocabulary.filter(F.col("times") < least)
    more = rest.select("text_key", F.col("r.rest").alias("word"), F.col("r.rest_times").alias("tf")).join(tail, "word").groupBy("text_key").agg(
        F.sum("tf").alias("more_known"), F.sum(F.col("tf") * (F.log10((F.col("times") + 0.5) / F.lit(z)) - F.log10(F.lit(0.5 / z)))).alias("more_base")
    )
    return hot_join(scored, more, "text_key", "left").select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )


def _head(vocabulary: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of at most HEAD_WORDS words, fetched as Arrow."""
    found = vocabulary.filter(F.col("times") >= least).toArrow()
    words = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], found.column("times").to_numpy()[order]


def _parts(model: DataFrame, ranges: int, n: int, wanted: set[int]) -> tuple[list[int], bytes]:
    """Bytes of each range's part (0 where it isn't wanted) and the parts in a row."""
    sizes, buffers = [0] * ranges, []
    if wanted:
        found = model.filter((F.col("n") == n) & F.col("part").isin(sorted(wanted))).select("part", "bits").toArrow().sort_by("part")
        for p, b in zip(found.column("part").to_pylist(), found.column("bits"), strict=True):
            sizes[p] = len(b.as_buffer())
            buffers.append(b.as_buffer())
    return sizes, b"".join(buffers)
