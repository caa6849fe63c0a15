"""Best-fit packing of tokenised documents by a configuration linear program.

A configuration says how many pieces of each length share one sequence. The
program asks for the fewest sequences that hold the whole histogram of lengths. It is
solved by multiplicative weights: lengths still short of their count weigh more,
and a knapsack over the sequence's tokens (dynamic programming) prices them into
configurations, the best one through each length. A pick is used as far as the
scarcest of its lengths allows, and picks go on until the solution is within GAP
of the bound that the same prices prove. It is rounded down, then up while pieces
last, and what is left is packed best fit, longest first.

The program sees the histogram alone, at most CAPACITY numbers whatever the
corpus holds, and so its solution has a bounded number of configurations. A
piece's place follows from its length and its rank among pieces of that length,
which is counted in parts so that no task holds a length.
"""

from __future__ import annotations

import bisect
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cliptide.llm._common import TEXT_ROWS, Scratch

CAPACITY = 4096
END_ID = 1
#: How far the fractional solution may be above the linear program's bound.
GAP = 0.05
#: Distinct words whose ids a task remembers before it forgets them all, and bytes of text it cuts at a time.
MEMO, CHUNK = 600_000, 8 << 20
#: Pieces of one length that are ranked together at most: this many, and one in PARTS of all.
PART, PARTS = 250_000, 512
VOCABULARY = "word_bpe_49k.json"
#: ASCII punctuation at a word's end that the vocabulary's rules never join to a letter before it;
#: the apostrophe, which may begin a contraction, is left out.
TAIL = "".join(c for c in string.punctuation if c != "'")
LETTERS = [c.encode() for c in string.ascii_lowercase]
#: Both added tokens hold this; they match raw text only.
ADDED = "<|"


class WordIds:
    """Token ids of whole texts, by way of their distinct words.

    The vocabulary's rules never look across white space and lower-case the text
    first, so a text's ids are its words' ids in a row. Only the six ASCII spaces
    cut here; what else the tokenizer takes for space stays inside a word and is
    left to it. A lower-cased word's punctuation behind an ASCII letter is a
    token of its own, so the word up to there, its stem, and the rest are looked
    up apart. Added tokens match text as it stands: a word that may hold one goes
    to the tokenizer whole and unchanged.
    """

    def __init__(self, path: str):
        self.encode = Tokenizer.from_file(path).encode
        self.known: dict[str, bytes] = {}

    def ids(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            ids = self.encode(word, add_special_tokens=False).ids
            found = self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last one's end). A null text has none."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        raw = words.dictionary
        # Punctuation without a letter before it is left where it is, as is a word with an added token.
        lower = pc.ascii_lower(raw)
        stems = pc.ascii_rtrim(lower, TAIL)
        whole = pc.or_(pc.match_substring(raw, ADDED), pc.invert(pc.is_in(pc.binary_slice(stems.cast(pa.large_binary()), -1), pa.array(LETTERS, pa.large_binary()))))
        special = pc.match_substring(raw, ADDED)
        stems = pc.if_else(whole, pc.if_else(special, raw, lower), stems)
        tails = np.flatnonzero((pc.binary_length(lower).to_numpy() > pc.binary_length(stems).to_numpy()))
        stems = stems.dictionary_encode()
        stem_ids = Ragged([self.ids(w) for w in stems.dictionary.to_pylist()])
        tail_ids = [b""] * len(raw)
        for i, w, n in zip(tails.tolist(), lower.take(tails).to_pylist(), pc.utf8_length(stems.dictionary).take(stems.indices.take(tails)).to_pylist(), strict=True):
            tail_ids[i] = self.ids(w[n:])
        both = np.empty(2 * len(raw), np.int64)
        both[0::2], both[1::2] = stems.indices.to_numpy(), len(stems.dictionary) + np.arange(len(raw))
        flat, ends = (stem_ids + Ragged(tail_ids)).take(both)
        word_ids = Ragged(flat=flat, ends=ends[1::2])
        flat, ends = word_ids.take(words.indices.to_numpy())
        return flat, np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]


class Ragged:
    """Arrays of 32-bit ids in a row."""

    def __init__(self, parts: list[bytes] = (), flat: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.flat = np.frombuffer(b"".join(parts), "<u4") if flat is None else flat
        self.ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4) if ends is None else ends

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(flat=np.concatenate([self.flat, other.flat]), ends=np.concatenate([self.ends, len(self.flat) + other.ends]))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the arrays of numbers ``at`` in a row, where each ends)."""
        starts = np.append(0, self.ends[:-1])[at] if len(at) else np.empty(0, np.int64)
        sizes = self.ends[at] - starts
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


def parts_of(texts: pa.StringArray, most: int = CHUNK) -> Iterator[pa.StringArray]:
    """Slices of about ``most`` bytes; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            i = 0
            for texts in parts_of(batch.column(1)):
                flat, ends = words(texts)
                raw = memoryview(np.insert(flat, ends[1:], end_id).astype("<u4")).cast("B")
                stops = (ends[1:] + np.arange(1, len(ends))).tolist()
                for lo, hi in zip([0, *stops], stops, strict=False):
                    for k, at in enumerate(range(lo, hi, capacity)):
                        stop = min(hi, at + capacity)
                        rows.append((i, k, at - lo, stop - at, zlib.crc32(raw[4 * at : 4 * stop])))
                    i += 1
            at, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(weight: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room the largest weight of lengths (with repeats) that fit, and the length to take first (0: leave a token)."""
    low = int(lengths[0])
    dense = np.full(capacity + 1, -1.0)
    dense[lengths] = weight
    value, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for room in range(low, capacity + 1):
        gain = dense[low : room + 1] + value[room - low :: -1]
        best = int(gain.argmax())
        value[room] = value[room - 1]
        if gain[best] > value[room]:
            value[room], pick[room] = gain[best], best + low
    return value, pick


def solve(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(configuration as ((length, times), ...), sequences)], which holds ``counts`` exactly.

    What rounding leaves goes best fit into the room of the chosen configurations
    and into new sequences. Best fit alone is taken where it needs fewer.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    plan = rounded(left, capacity, gap) if left else []
    for config, n in plan:
        for k, t in config:
            left[k] -= t * n
    return min(best_fit(left, capacity, plan), best_fit(counts, capacity), key=lambda p: sum(n for _, n in p))


def rounded(counts: dict[int, int], capacity: int, gap: float) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole sequences of the fractional solution, of no more pieces than there are."""
    left = dict(counts)
    picks, bound = fractional(counts, capacity, gap)
    # Rounding up wastes no more room than the program itself does, but for SLACK.
    full = (1 - SLACK) * sum(k * v for k, v in counts.items()) / bound
    order = sorted(picks.items(), key=lambda kv: (-kv[1], kv[0]))
    plan: dict[tuple[tuple[int, int], ...], int] = {}
    for up in (0, 1):
        for key, share in order:
            if up and sum(k * t for k, t in key) < full:
                continue
            n = min(1 if up else int(share + 1e-9), *(left[k] // t for k, t in key))
            if n > 0:
                plan[key] = plan.get(key, 0) + n
                for k, t in key:
                    left[k] -= t * n
    return list(plan.items())


def fractional(counts: dict[int, int], capacity: int, gap: float) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """(configuration -> sequences, bound): a covering of ``counts`` by at most 1 + ``gap`` times the bound,
    which no packing beats."""
    lengths = np.array(sorted(counts))
    need = np.array([counts[k] for k in lengths.tolist()], float)
    place = np.zeros(capacity + 1, int)
    place[lengths] = np.arange(len(lengths))
    covered, total, bound = np.zeros(len(lengths)), 0.0, float(need @ lengths) / capacity
    picks: dict[tuple[tuple[int, int], ...], float] = {}
    while True:
        # A length's weight, first its tokens, falls as the picks so far cover more of its count.
        ratio = covered / need
        low = ratio.min()
        weight = lengths * np.exp(-RATE / np.sqrt(max(1.0, low)) * (ratio - low))
        value, pick = knapsack(weight, lengths, capacity)
        bound = max(bound, float(need @ weight) / value[capacity])
        if low > 0 and total <= (1 + gap) * bound * low:
            return {key: n / low for key, n in picks.items()}, bound
        # What this round may add to each length.
        allowed = STEP * need
        through = weight + value[capacity - lengths]
        order = np.argsort(-weight, kind="stable")
        for i in order[through[order] >= (1 - SLACK) * value[capacity]].tolist():
            config, room, k = {}, capacity, int(lengths[i])
            while k and allowed[place[k]] > 1e-9 * need[place[k]]:
                config[k] = config.get(k, 0) + 1
                room -= k
                while room and not pick[room]:
                    room -= 1
                k = int(pick[room])
            if k:
                continue
            at, times = place[list(config)], np.array(list(config.values()), float)
            n = float((allowed[at] / times).min())
            allowed[at] -= n * times
            covered[at] += n * times
            total += n
            key = tuple(sorted(config.items(), reverse=True))
            picks[key] = picks.get(key, 0.0) + n


#: How sharply weights fall with a length's coverage, the share of a count that a round may add,
#: and how far below the best configuration a pick may weigh.
RATE, STEP, SLACK = 4.0, 0.25, 0.01


def best_fit(counts: dict[int, int], capacity: int, plan: list[tuple[tuple[tuple[int, int], ...], int]] = ()) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """``plan`` and ``counts`` besides: longest first into the fullest sequence with room. Equal
    sequences are handled as one."""
    open_: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}
    rooms: list[int] = []

    def put(room: int, config: tuple[tuple[int, int], ...], n: int) -> None:
        if room not in open_:
            open_[room] = {}
            bisect.insort(rooms, room)
        open_[room][config] = open_[room].get(config, 0) + n

    for config, n in plan:
        put(capacity - sum(k * t for k, t in config), config, n)
    for length in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                put(capacity, (), todo // (capacity // length) + 1)
                at = bisect.bisect_left(rooms, length)
            room = rooms[at]
            config, have = next(iter(open_[room].items()))
            fit = min(room // length, todo)
            n = min(have, todo // fit)
            open_[room].pop(config)
            if have > n:
                open_[room][config] = have - n
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            put(room - fit * length, (*config, (length, fit)), n)
            todo -= n * fit
    return [(config, n) for found in open_.values() for config, n in found.items() if config]


def places(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of each slot; ranks ascend."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for config, n in plan:
        offset = 0
        for length, times in config:
            for _ in range(times):
                slots.setdefault(length, []).append((used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + n
                offset += length
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in slots.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null and empty texts are the end id alone. Documents are cut only if longer
    than ``capacity``. Rows with equal ids are packed each; a null doc_id is
    carried along. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing", TEXT_ROWS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.save(pieces_of(rows, vocabulary or public_tokenizers.path(VOCABULARY), capacity))
    # One number for each length: at most ``capacity`` rows.
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    parts = max(PARTS, total // PART)
    dealt = F.get(F.lit([1 + counts.get(k, 0) * parts // max(1, total) for k in range(capacity + 1)]), F.col("length").cast("int"))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), dealt))
    parts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.save(parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    slots = places(solve(counts, capacity))
    table = spark.sparkContext.broadcast(slots)
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    starts = parts.select(F.col("length").alias("__l"), F.col("__salt").alias("__s"), "__before")
    ranked = salted.withColumn("__at", F.row_number().over(within) - 1).join(
        starts, (F.col("length") == F.col("__l")) & (F.col("__salt") == F.col("__s"))
    ).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__at")).alias("__rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            found, first = np.unique(length[order], return_index=True)
            for k, at in zip(found.tolist(), np.split(order, first[1:]), strict=True):
                ranks, sequences, offsets = slots[k]
                slot = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at], offset[at] = sequences[slot] + rank[at] - ranks[slot], offsets[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
