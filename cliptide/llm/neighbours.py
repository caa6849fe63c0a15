"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors twice, pseudo-randomly (three rounds of random signs and
a fast Hadamard transform each), and files every vector under the pair of signed axes
nearest to it. A query looks up the PROBES pairs that cost it least, the cost being how
much farther its rotations are from a pair's axes than from the nearest ones.

The first axis names a cell, which is dealt into blocks of about BLOCK vectors and
its queries into blocks of about BLOCK queries, so no cell, however hot, lands in one
task. Within a block the second axis picks the vectors that a query is multiplied with.
Candidates are reranked by their exact inner product. The first FIRST tables give every
query a 20th score; from the others only better candidates come back.

Tables know directions only, and a long vector can be among the nearest at a
cosine at which buckets seldom meet. So vectors are also dealt into norm ranges:
where a query's last score found leaves room for a vector of a range whose
cosine is too small to be met with a chance of SURE, that range is searched
whole for it. A query that finds fewer than NEAREST searches every range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliptide.llm._common import Scratch

NEAREST = 20
TABLES, FIRST, PROBES, BLOCK = 20, 3, 108, 4096
#: Signed axes of each rotation that probes are combined from, at most.
AXES = 24
ONE_IN = 20
MOST = np.finfo(float).max
#: Least chance of a bucket in common at which the tables are relied on.
SURE = 0.83
#: Norm ranges at most, STEPS to a factor of two; the last one also holds all shorter vectors.
RANGES, STEPS = 128, 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of each row."""
    width = x.shape[1]
    h = 1
    while h < width:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), width)
        h *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, rotation: int) -> np.ndarray:
    rng = np.random.default_rng(1000 + rotation)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def nearest_axis(r: np.ndarray) -> np.ndarray:
    """The signed axis nearest to each row: axis i is 2i, its opposite 2i + 1."""
    near = np.abs(r).argmax(axis=1)
    return 2 * near + (np.take_along_axis(r, near[:, None], 1)[:, 0] < 0)


def buckets(x: np.ndarray, table: int) -> np.ndarray:
    """(rows, 2): the pair of axes that files each unit vector."""
    return np.stack([nearest_axis(rotated(x, 2 * table + k)) for k in (0, 1)], axis=1)


def probes(x: np.ndarray, table: int, n: int = PROBES) -> np.ndarray:
    """(rows, n, 2): the pairs of axes that cost each unit vector least, cheapest first."""
    axes, costs = [], []
    for k in (0, 1):
        r = rotated(x, 2 * table + k)
        both = np.stack([r, -r], axis=2).reshape(len(r), -1)
        near = np.argsort(-both, axis=1, kind="stable")[:, :AXES]
        value = np.take_along_axis(both, near, 1)
        axes.append(near)
        costs.append(np.square(value[:, :1] - value))
    cost = (costs[0][:, :, None] + costs[1][:, None, :]).reshape(len(x), -1)
    order = np.argsort(cost, axis=1, kind="stable")[:, :n]
    width = axes[1].shape[1]
    return np.stack([np.take_along_axis(axes[0], order // width, 1), np.take_along_axis(axes[1], order % width, 1)], axis=2)


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors, padded to a power of two. Each is first scaled by its largest component, so no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, padded(x.shape[1]) - x.shape[1])))


def padded(width: int) -> int:
    return max(2, 1 << (width - 1).bit_length())


def least_cosine(width: int) -> float:
    """The smallest cosine of a query and a vector that share a bucket with a chance of SURE, by simulation."""
    rng = np.random.default_rng(999)
    width = padded(width)
    n = max(256, min(4096, (1 << 18) // width))
    u, v = directions(rng.standard_normal((n, width))), rng.standard_normal((n, width))
    v = directions(v - (u * v).sum(axis=1, keepdims=True) * u)
    probed = probes(u, 0)
    low, high = 0.0, 1.0
    for _ in range(12):
        mid = (low + high) / 2
        met = (buckets(mid * u + np.sqrt(1 - mid * mid) * v, 0)[:, None] == probed).all(axis=2).any(axis=1).mean()
        low, high = (mid, high) if 1 - (1 - met) ** TABLES < SURE else (low, mid)
    return high


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def norm_of(vector: Column) -> Column:
    """The length, by way of the largest component; within what a double holds."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x).cast("double")))
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x / top) * (x / top)))
    return F.least(top * size, F.lit(1.7e308))


def matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def filed(rows: DataFrame) -> DataFrame:
    """(id, vector) -> one row for each table: table, axis, second, id, vector."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = directions(matrix(batch.column(1)))
                for t in range(TABLES):
                    at = buckets(x, t).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(at[:, 0]), pa.array(at[:, 1]), *batch.columns], ["table", "axis", "second", "id", "vector"])

    fields = [T.StructField(n, T.IntegerType()) for n in ("table", "axis", "second")]
    return rows.select("id", "vector").mapInArrow(cells, T.StructType([*fields, *rows.select("id", "vector").schema.fields]))


def asking(rows: DataFrame, tables: range) -> DataFrame:
    """(id, vector, least) -> one row for each cell probed: table, axis, seconds, id, vector, least."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = directions(matrix(batch.column(1)))
            for t in tables:
                pairs = probes(x, t)
                owner = np.repeat(np.arange(len(x)), pairs.shape[1])
                axis, second = pairs.reshape(-1, 2).T
                order = np.lexsort((second, axis, owner))
                owner, axis, second = owner[order], axis[order], second[order]
                first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (axis[1:] != axis[:-1])))
                ends = pa.array(np.append(first, len(owner)).astype(np.int32))
                rows_ = batch.take(pa.array(owner[first]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), t, np.int32)), pa.array(axis[first].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(second.astype(np.int32))), *rows_.columns],
                    ["table", "axis", "seconds", "id", "vector", "least"],
                )

    fields = [T.StructField("table", T.IntegerType()), T.StructField("axis", T.IntegerType()), T.StructField("seconds", T.ArrayType(T.IntegerType()))]
    rows = rows.select("id", "vector", "least")
    return rows.mapInArrow(cells, T.StructType([*fields, *rows.schema.fields]))


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Largest scores first, equal ones by id; what is no number comes last."""
    return np.lexsort((ids, -np.where(np.isnan(scores), -np.inf, scores)))[:k]


def search_block(found: pa.Table, asked: pa.Table) -> pa.Table:
    """The NEAREST of one block of vectors for each of one block of queries, and no score below a query's least."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(found) and len(asked):
        c, ids = matrix(found.column("vector").combine_chunks()), found.column("id").to_numpy()
        second = found.column("second").to_numpy()
        order = np.argsort(second, kind="stable")
        c, ids = c[order], ids[order]
        values, first = np.unique(second[order], return_index=True)
        last = np.append(first[1:], len(ids))
        for lo in range(0, len(asked), 256):
            part = asked.slice(lo, 256).combine_chunks()
            q, own, least = matrix(part.column("vector").combine_chunks()), part.column("id").to_numpy(), part.column("least").to_numpy()
            lists = part.column("seconds").combine_chunks()
            wanted, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            rough, met = np.full((len(q), len(c)), -MOST), np.zeros((len(q), len(c)), bool)
            by = np.argsort(wanted, kind="stable")
            starts, stops = np.searchsorted(wanted[by], values), np.searchsorted(wanted[by], values, side="right")
            for i in np.flatnonzero(stops > starts):
                mine = who[by[starts[i] : stops[i]]]
                with np.errstate(over="ignore", invalid="ignore"):
                    rough[mine, first[i] : last[i]] = q[mine] @ c[first[i] : last[i]].T
                met[mine, first[i] : last[i]] = True
            met &= ids[None, :] != own[:, None]
            # Rough scores only choose who is scored exactly, ties included.
            rough = np.where(met, np.nan_to_num(rough, nan=-MOST, posinf=MOST, neginf=-MOST), -MOST)
            slack = 1e-9 * (1 + np.abs(np.where(met, rough, 0)).max(axis=1))
            if rough.shape[1] > NEAREST:
                least = np.maximum(least, np.partition(rough, rough.shape[1] - NEAREST, axis=1)[:, rough.shape[1] - NEAREST])
            at, near = np.nonzero(met & (rough >= (least - slack)[:, None]))
            with np.errstate(over="ignore", invalid="ignore"):
                exact = np.concatenate([np.empty(0), *[(c[near[k : k + 65536]] * q[at[k : k + 65536]]).sum(axis=1) for k in range(0, len(at), 65536)]])
            out.append((own[at], ids[near], exact))
    query, vec, score = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})


_FOUND = "query_id long, vec_id long, score double"


def blockwise(found: DataFrame, asked: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Searches the vectors of each bucket for its queries, block by block."""
    sizes = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(name))
    blocks = scratch.save(sizes(found, "__nf").join(sizes(asked, "__nq"), keys))
    deal = lambda df, own, other: df.join(blocks, keys).withColumn(f"__{own}", F.pmod(F.xxhash64("id"), F.col(f"__n{own}")).cast("int")).withColumn(
        f"__{other}", F.explode(F.sequence(F.lit(0), F.col(f"__n{other}") - 1))
    )
    cells = [*keys, "__f", "__q"]
    left = deal(found, "f", "q").select(*cells, "id", "vector", "second").groupBy(*cells)
    right = deal(asked, "q", "f").select(*cells, "id", "vector", "seconds", "least").groupBy(*cells)
    return left.cogroup(right).applyInArrow(search_block, _FOUND)


_COLUMNS = ["query_id", "vec_id", "score", "rank"]


def ranked(found: DataFrame) -> DataFrame:
    """The NEAREST of each query; one score for each query and id, the best."""
    one = found.groupBy("query_id", "vec_id").agg(F.max_by("score", F.nanvl("score", F.lit(float("-inf")))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEAREST).select(*_COLUMNS)


def with_least(asked: DataFrame, top: DataFrame) -> DataFrame:
    """Adds each query's last score found, or minus infinity if there are fewer than NEAREST."""
    last = top.filter(F.col("rank") == NEAREST).select(F.col("query_id").alias("__q"), F.col("score").alias("least"))
    return asked.drop("least").join(last, F.col("id") == F.col("__q"), "left").drop("__q").withColumn("least", F.coalesce(F.nanvl("least", F.lit(None).cast("double")), F.lit(float("-inf"))))


def whole(rows: DataFrame) -> DataFrame:
    """As rows of one bucket."""
    return rows.withColumn("second", F.lit(0))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", one_in: int = ONE_IN) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows whose id is divisible by ``one_in``.

    Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do rows of a null id. Vectors of one length are near each other
    alone; lengths but the most frequent one are searched whole. A query never finds its
    own id. Equal rows count once; several vectors of one id are candidates each,
    the best of them is kept, and the first in order asks. A score that overflows
    is infinite, one that is no number comes last. Extra columns are ignored; an empty
    table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    # A float is a double's exact value, so floats move as they are.
    kind = "array<float>" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    rows = scratch.save(rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("width", F.size("vector")), "lz4")
    shape = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max(norm_of(F.col("vector"))).alias("high")).orderBy(F.desc("n"), "width").limit(2).collect()
    if not shape:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, high = shape[0]["width"], shape[0]["high"]
    asked = rows.filter(F.col("id") % one_in == 0).groupBy("id").agg(F.min(F.struct("width", "vector")).alias("v"))
    asked = scratch.save(asked.select("id", "v.vector", "v.width", F.lit(float("-inf")).alias("least")), "lz4")
    main, queries = rows.filter(F.col("width") == width), asked.filter(F.col("width") == width)
    cells = scratch.save(filed(main), "lz4")
    top = scratch.save(ranked(blockwise(cells.filter(F.col("table") < FIRST), asking(queries, range(FIRST)), ["table", "axis"], scratch)))
    more = blockwise(cells.filter(F.col("table") >= FIRST), asking(with_least(queries, top), range(FIRST, TABLES)), ["table", "axis"], scratch)
    top = scratch.save(ranked(more.unionByName(top.select("query_id", "vec_id", "score"))))
    norm = norm_of(F.col("vector"))
    ranges = main.withColumn("norm", norm).withColumn("range", F.least(F.lit(RANGES - 1), F.floor(STEPS * F.log2(F.lit(high) / F.col("norm")))).cast("int"))
    # At most RANGES rows.
    longest = ranges.groupBy("range").agg(F.max("norm").alias("norm")).collect()
    cosine = least_cosine(width)
    bounds = F.array(*[F.struct(F.lit(r["range"]).alias("range"), F.lit(r["norm"]).alias("norm")) for r in longest])
    open_ = F.filter(bounds, lambda b: F.col("least") < F.col("norm") * b["norm"] * cosine)
    asks = with_least(queries, top).withColumn("norm", norm)
    asks = scratch.save(asks.select("id", "vector", "least", F.explode(F.transform(open_, lambda b: b["range"])).alias("range"), F.array(F.lit(0)).alias("seconds")), "lz4")
    found = top.select("query_id", "vec_id", "score")
    if not asks.isEmpty():
        found = found.unionByName(blockwise(whole(ranges), asks, ["range"], scratch))
    if len(shape) > 1:
        others = asked.filter(F.col("width") != width).withColumn("seconds", F.array(F.lit(0)))
        found = found.unionByName(blockwise(whole(rows.filter(F.col("width") != width)), others, ["width"], scratch))
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def measured_recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact rows that were found."""
    hits = exact.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, exact.count())
