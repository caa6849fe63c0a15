"""MinHash near-duplicates, with odd sketches verifying the banded candidates.

Steps, each a distributed table:

1. Every text becomes its set of distinct five-word shingles (64-bit hashes), a
   128-bit digest of the set, 128 MinHash samples cut into 32 bands of 4, and an
   odd sketch: a 512-bit bitmap in which each sample flips one bit. Equal samples
   cancel, so the bits by which two sketches differ estimate how many samples
   differ, most precisely when few do.
2. Texts of one set are one class. From here on classes, numbered nodes, stand for
   their copies. Bands that one class has alone are left out before any join.
3. Classes that share a band meet in its bucket, as (band, node) alone. In each star
   round a bucket's hub (another in each round) meets those members that are not yet
   in its component: a group of n near copies costs n pairs a round, not n * n.
   Distinct pairs get their sketches; pairs that differ by more bits than a pair at
   the threshold would (SIGMAS deviations beyond the mean) go; the rest is decided
   on full sets.
4. Buckets that then still hold several components are finished by their members'
   rarest shingles: two sets at the threshold share one of the rarest quarter of
   theirs, whatever the order, and the first that they share leaves room for enough
   others behind it. So members of one bucket that have only a common passage
   between them no longer meet. Pairs that do meet go the way of step 3.
5. Components come from label spreading over the confirmed links.

Nodes that many rows name (hubs, common bands, repeated texts) are dealt over tasks.
A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 =
5e-6; above the threshold this falls fast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliptide.llm._common import HOT_LEAST, TEXT_ROWS, Bloom, Scratch, WordHashes, batches_of, hot_join, lower_words, mix64
from cliptide.llm.components import connected_components

SHINGLE = 5
NUM, DEN = 75, 100
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SIGMAS = 4.5
STAR_ROUNDS = 2
#: Counters that put shingles in order from rare to frequent; equal counts fall back on the hash.
COUNTERS = 1 << 18

_rng = np.random.default_rng(20240607)
_MULT = (_rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_PLUS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_SALT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles.

    Fewer words make one shingle of them all; none make no shingle.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = h * _STEP + w[i : n - width + 1 + i]
    return np.unique(mix64(h))


def minhash(shingles: np.ndarray, mult: np.ndarray = _MULT, plus: np.ndarray = _PLUS, step: int = 2048) -> np.ndarray:
    """One sample for each multiplier, of a set that isn't empty."""
    low = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), step):
        np.minimum(low, (x[None, i : i + step] * mult + plus).min(axis=1), out=low)
    return low


def odd_sketch(samples: np.ndarray, salt: np.ndarray = _SALT, bits: int = SKETCH_BITS) -> np.ndarray:
    """64-bit words: the parity of how many samples hit each bit."""
    at = (mix64(samples.astype(np.uint64) + salt) >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64)
    parity = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.astype(np.uint64).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mix64(h * _STEP + rows[:, i])
    return h.view(np.int64)


def most_flips(n: int = SKETCH_BITS, k: int = SAMPLES, similarity: float = NUM / DEN) -> int:
    """Differing bits, of n from k samples, beyond which a pair counts as below ``similarity``."""
    differing = 2 * k * (1 - similarity)
    mean = n / 2 * (1 - math.exp(-2 * differing / n))
    slope = math.exp(-2 * differing / n)
    spread = math.sqrt((slope * 2 * math.sqrt(k * similarity * (1 - similarity))) ** 2 + differing / 4)
    return math.ceil(mean + SIGMAS * spread)


_FEATURES = "doc_id long, row long, digest binary, n_shingles long, keys array<long>, sketch array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        digests, sizes, keys, sketches = [], [], [], []
        for text in batch.column(2).cast(pa.binary()):
            s = shingle_set(lower_words(text.as_py()), hashes)
            sizes.append(len(s))
            digests.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            if len(s):
                samples = minhash(s)
                keys.append(band_keys(samples))
                sketches.append(odd_sketch(samples))
            else:
                keys.append(np.empty(0, np.int64))
                sketches.append(np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), _lists(keys), _lists(sketches)],
            ["doc_id", "row", "digest", "n_shingles", "keys", "sketch"],
        )


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _sets(among):
    """Sets of the texts whose id may be ``among`` those asked for, or is null."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = batch.column(0)
            asked = among(ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
            out: list[tuple[bytes, bytes]] = []
            for text in batch.column(1).filter(pa.array(asked)).cast(pa.binary()):
                s = shingle_set(lower_words(text.as_py()), hashes).tobytes()
                out.append((hashlib.md5(s).digest(), s))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())], ["digest", "members"]
            )

    return sets


def _shared_keys(among):
    """(key, node) for the keys that may be ``among`` those of several nodes."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            flat, sizes = keys.flatten().to_numpy(), keys.value_lengths().to_numpy()
            keep = among(flat)
            nodes = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), pa.array(nodes[keep])], ["key", "node"])

    return shared


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partners that a hub is linked with. Rows come hub by hub, the hub's own first; one set is held."""
    hub, own = None, np.empty(0, np.uint64)
    for batch in batches:
        found: list[tuple[int, int]] = []
        for of, node, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = np.frombuffer(members.as_buffer(), np.uint64)
            if of == node:
                hub, own = of, x.copy()
                continue
            if of != hub:
                raise ValueError("a hub's partners came before it")
            small, large = (x, own) if len(x) <= len(own) else (own, x)
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if DEN * both >= NUM * (len(x) + len(own) - both):
                found.append((of, node))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["hub", "node"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for members in batch.column(0):
            np.add.at(counts, (np.frombuffer(members.as_buffer(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "times"])


def _rarest(shared):
    """(key, node, label, n, behind) for the rarest shingles of each set, those that no other set has
    left out; ``behind`` counts the shingle and those after it."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
            for node, label, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = np.frombuffer(members.as_buffer(), np.uint64)
                n = len(s)
                times = counts[(s % np.uint64(COUNTERS)).astype(np.int64)]
                # A partner has 0.75 n shingles in common or more.
                first = np.lexsort((s, times))[: n - -(-NUM * n // DEN) + 1]
                at = np.flatnonzero(times[first] > 1)
                for column, values in zip(out, (s[first[at]].view(np.int64), np.full(len(at), node), np.full(len(at), label), np.full(len(at), n), n - at), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "node", "label", "n", "behind"])

    return rarest


def _likely() -> Column:
    """Sizes and sketches that a pair at the threshold may have."""
    n, m = F.col("n"), F.col("hub_n")
    flips = F.aggregate(F.zip_with("sketch", "hub_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (F.least(n, m) * DEN >= F.greatest(n, m) * NUM) & (flips <= most_flips())


class _Groups:
    """Classes, their buckets and what is known of their components.

    ``rows`` may carry any long in ``row``; it is handed through.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, row: Column):
        self.scratch = s = Scratch(docs.sparkSession, "near_dedup", TEXT_ROWS)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
        wide = s.save(self.docs.mapInArrow(_features, _FEATURES))
        self.rows = s.save(wide.select("doc_id", "row", "digest", "n_shingles"))
        classes = wide.filter("n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("keys").alias("keys"), F.min("sketch").alias("sketch")
        )
        # The number is written with the class, so it stays what it is.
        self.classes = s.save(classes.withColumn("node", F.monotonically_increasing_id()))
        s.drop(wide)
        times = self.classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("times"))
        shared = s.save(times.filter("times > 1"))
        hits = s.save(self.classes.select("node", "keys").mapInArrow(_shared_keys(Bloom(shared, "key").test()), "key long, node long"))
        self.members = s.save(hot_join(hits, shared, "key"))
        s.drop(hits, shared)
        self.known = self.classes.select("node", "n", "sketch")
        self.sets = self.sets_of(self.members.select("node").distinct())
        #: (node, label) of nodes that are not their own label.
        self.labels: DataFrame | None = None

    def named(self, rows: DataFrame) -> DataFrame:
        """Adds the label of each row's node."""
        if self.labels is None:
            return rows.withColumn("label", F.col("node"))
        known = self.labels.select(F.col("node").alias("of"), "label")
        return rows.join(known.hint("merge"), F.col("node") == F.col("of"), "left").drop("of").withColumn("label", F.coalesce("label", "node"))

    def star(self, turn: int) -> bool:
        """One round; false if no bucket holds more than one component any more."""
        s = self.scratch
        members = s.save(self.named(self.members.select("key", "node")))
        order = F.xxhash64("node", F.lit(turn))
        hubs = members.groupBy("key").agg(
            F.min(F.struct(order.alias("order"), "node", "label")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")
        )
        hubs = s.save(hubs.filter("low <> high").select("key", F.col("hub.node").alias("hub"), F.col("hub.label").alias("hub_label")))
        if hubs.isEmpty():
            s.drop(members, hubs)
            return False
        pairs = hot_join(members.select("key", "node", "label"), hubs, "key").filter("label <> hub_label").select("hub", "node").distinct()
        self.decide(s.save(pairs))
        s.drop(members, hubs)
        return True

    def rest(self) -> None:
        """All pairs that share a band and are still apart, by way of their rarest shingles.

        Of two sets of n and m shingles, first a, then b are left from the first
        common one on, and no more than the lesser of both is common.
        """
        s = self.scratch
        members = s.save(self.named(self.members.select("key", "node")))
        open_ = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key", "low")
        nodes = s.save(hot_join(members, open_, "key").select("node", "label").distinct())
        s.drop(members)
        if nodes.isEmpty():
            return
        sets = s.save(nodes.join(self.sets.hint("merge"), "node").select("node", "label", "members"))
        counts = np.zeros(COUNTERS, np.int64)
        # At most COUNTERS sums.
        with batches_of(s.spark, TEXT_ROWS):
            found = sets.select("members").mapInArrow(_counted, "at long, times long").groupBy("at").agg(F.sum("times").alias("times")).toArrow()
        counts[found.column("at").to_numpy()] = found.column("times").to_numpy()
        shared = s.spark.sparkContext.broadcast(counts)
        hits = s.save(sets.mapInArrow(_rarest(shared), "key long, node long, label long, n long, behind long"))
        times = hits.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("label").alias("low"), F.max("label").alias("high"))
        listed = s.save(hot_join(hits, times.filter("low <> high").select("key", "times"), "key"))
        # A key of many nodes is dealt into parts; each part meets all of the key's nodes as a stream.
        parts = F.ceil(F.col("times") / HOT_LEAST).cast("int")
        left = listed.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("times")
        right = listed.select("key", F.col("node").alias("hub"), F.col("label").alias("hub_label"), F.col("n").alias("hub_n"), F.col("behind").alias("hub_behind"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        enough = DEN * F.least("behind", "hub_behind") * (NUM + DEN) >= NUM * DEN * (F.col("n") + F.col("hub_n"))
        pairs = left.join(right.hint("merge"), ["key", "part"]).filter((F.col("hub") < F.col("node")) & (F.col("label") != F.col("hub_label")) & enough)
        self.decide(s.save(pairs.select("hub", "node").distinct()))
        s.drop(listed, hits, nodes, sets)

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, members): the sets of ``nodes``; one text of each class is read again."""
        wanted = self.scratch.save(self.classes.select("node", "digest", "rep").join(nodes.hint("merge"), "node", "left_semi"))
        texts = self.docs.select("doc_id", "text").mapInArrow(_sets(Bloom(wanted, "rep").test()), "digest binary, members binary")
        found = texts.join(wanted.select("node", "digest").hint("merge"), "digest")
        return self.scratch.save(found.groupBy("node").agg(F.first("members").alias("members")), "lz4")

    def decide(self, pairs: DataFrame) -> None:
        """Decides (hub, node) pairs by sketch, then on full sets, and joins what is linked."""
        s = self.scratch
        sketched = s.save(pairs.join(self.known.hint("merge"), "node"))
        hubs = self.known.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
        likely = s.save(hot_join(sketched, hubs, "hub").filter(_likely()).select("hub", "node"))
        s.drop(pairs, sketched)
        # A hub meets its partners in parts; its own set goes to each.
        sizes = likely.groupBy("hub").agg(F.count(F.lit(1)).alias("times"))
        parts = sizes.select("hub", F.ceil(F.col("times") / HOT_LEAST).cast("int").alias("parts"))
        dealt = hot_join(likely, parts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
        own = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"))
        dealt = s.save(dealt.union(own))
        met = dealt.join(self.sets.hint("merge"), "node").repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("hub") != F.col("node"))
        links = s.save(met.select("hub", "node", "members").mapInArrow(_linked, "hub long, node long"))
        s.drop(likely, dealt)
        if not links.isEmpty():
            self.merge(links)

    def merge(self, links: DataFrame) -> None:
        """Takes new links into the labels; what is known enters as whole components."""
        s = self.scratch
        ends = s.save(self.named(links).select("hub", F.col("label").alias("a")))
        ends = self.named(ends.select("a", F.col("hub").alias("node"))).select("a", F.col("label").alias("b"))
        new = connected_components(ends, s)
        if self.labels is None:
            self.labels = new
            return
        moved = new.select(F.col("node").alias("label"), F.col("label").alias("to"))
        kept = hot_join(self.labels, moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        old, self.labels = self.labels, s.save(kept.union(new.join(self.labels.select("node"), "node", "left_anti").filter("node <> label")).distinct())
        s.drop(old)

    def components(self) -> DataFrame:
        """(digest, label) of all classes."""
        return self.named(self.classes.select("digest", "node", "rep")).select("digest", "label", "rep")


def _grouped(docs: DataFrame, id_col: str, text_col: str, row: Column) -> _Groups:
    g = _Groups(docs, id_col, text_col, row)
    for turn in range(STAR_ROUNDS):
        if not g.star(turn):
            return g
    g.rest()
    return g


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles, component_id, kept.

    One row per input row. Two texts are linked if 100 * |intersection| >= 75 *
    |union| of their shingle sets; component_id is the smallest doc_id reached
    over links, kept marks the row whose own id that is.

    Null, empty and blank texts have no shingles and are their own component
    (null id: null). A null doc_id takes part in a group but never names it
    while the group has another id. Repeated rows get equal results. Texts of any
    length are read whole. Extra columns are ignored; an empty table gives no rows.
    """
    g = _grouped(docs, id_col, text_col, F.lit(0))
    s = g.scratch
    named = s.save(g.components())
    low = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    classes = hot_join(named.select("digest", "label"), low, "label").select("digest", "component_id")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = hot_join(g.rows, classes, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    out = s.save(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    s.drop(g.members, g.sets, g.classes, g.rows, named)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, with all its columns.

    It is the row of the smallest doc_id (null last); among rows of that id the one
    of the smallest hash over all columns, and of rows equal in all columns, one. Rows
    without words belong to no group and stay, all of them. Which rows go is
    decided by row, not by id, so unlike texts of one id don't lose each other.
    """
    row = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    g = _grouped(docs, "doc_id", "text", row)
    s = g.scratch
    named = s.save(g.components().select("digest", "label"))
    rows = s.save(hot_join(g.rows.filter("n_shingles > 0"), named, "digest").select("doc_id", "row", "label"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = rows.groupBy("label").agg(F.min(order).alias("first")).select("label", F.struct("first.doc_id", "first.row").alias("first"))
    told = s.save(hot_join(rows, first, "label").withColumn("__gone", ~F.struct("doc_id", "row").eqNullSafe(F.col("first"))))
    # Rows that go, and rows that stay but are there several times.
    marked = told.groupBy("row", "doc_id", "__gone").count().filter("__gone OR count > 1")
    marked = s.save(marked.select("row", F.col("doc_id").alias("__id"), "__gone"))
    among = Bloom(marked, "row").test()

    def may_be_marked(rows: pa.Array) -> pa.Array:
        return pa.array(among(rows.to_numpy()))

    # Python gets the hashes alone.
    tested = docs.withColumn("__row", row).withColumn("__open", F.arrow_udf(may_be_marked, T.BooleanType())("__row"))
    # Only rows that the filter lets pass are moved.
    same = (F.col("__row") == F.col("row")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    asked = tested.filter("__open").join(marked.hint("merge"), same, "left").filter("__gone IS NULL OR NOT __gone")
    once = asked.filter("__gone IS NOT NULL").dropDuplicates(["__row", "__id"])
    return reduce(DataFrame.union, [part.select(*docs.columns) for part in (tested.filter("NOT __open"), asked.filter("__gone IS NULL"), once)])


#: The same in DuckDB, by comparing all texts that share a shingle.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * c >= 75 * (len(a.s) + len(b.s) - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(r.low, s.doc_id)) AS component_id, s.doc_id <= coalesce(r.low, s.doc_id) AS kept
FROM sets s LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY 1) r ON r.x = s.doc_id
"""
