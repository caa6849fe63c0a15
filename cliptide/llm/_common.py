"""Shared pieces of the training-data operators: scratch tables and word rules."""

from __future__ import annotations

import atexit
import shutil
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: ``bytes.split()`` without arguments cuts at exactly these: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Distinct words a worker remembers before it forgets them all.
MEMO_WORDS = 400_000
#: A key is hot above this many rows and above one in HOT_PARTS of them.
HOT_LEAST, HOT_PARTS = 200, 1024
BLOOM_BYTES = 32 << 20
#: Whole texts, or sets of their size, that Python gets at a time.
TEXT_ROWS = 2000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is named, a local session gets a folder of
    its own; a cluster can't do without, as its executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="cliptide-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """What runs meanwhile gives Python at most ``rows`` rows at a time (None: as the session has it,
    which may be fewer in any case). A batch is held by the JVM and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, now = spark.conf.get(name, None), int(spark.conf.get(name))
    if rows is None or 0 < now <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Tables of one operator run, written to the shared checkpoint folder.

    A saved table has no lineage but its files, so a lost executor costs one
    task, and no step before it is computed twice. While a table is written,
    Python gets ``rows`` rows at a time.
    """

    def __init__(self, spark: SparkSession, name: str, rows: int | None = None):
        self.spark, self.rows = spark, rows
        self.root = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop_all)

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        with batches_of(self.spark, self.rows):
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cliptide_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing will read again."""
        for df in frames:
            self._delete(df._cliptide_path)

    def drop_all(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class WordHashes(dict):
    """word (bytes) -> its 64-bit hash; forgets everything beyond MEMO_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; null has none."""
    return text.translate(LOWER).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has each key once, where few keys may hold much of ``left``.

    A key that holds more than HOT_LEAST rows and one in HOT_PARTS of them all is
    dealt into parts of that size by a hash of its rows, and its row of ``right``
    goes to each. There are at most HOT_PARTS such keys, so their list is small.
    ``left`` is read twice: give it a table.
    """
    total = left.count()
    least = max(HOT_LEAST, total // HOT_PARTS)
    if total <= least:
        return left.join(right.hint("merge"), on, how)
    hot = left.groupBy(F.col(on).alias("__hot")).agg(F.ceil(F.count(F.lit(1)) / least).cast("int").alias("__parts")).filter("__parts > 1")
    found = hot.toArrow()
    if not len(found):
        return left.join(right.hint("merge"), on, how)
    # From Arrow, as rows would start Python workers that then stay beside those of the mapped steps.
    hot = F.broadcast(left.sparkSession.createDataFrame(found))
    dealt = left.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__parts")), F.lit(0)).cast("int"))
    copies = right.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)))
    return dealt.drop("__hot", "__parts").join(copies.drop("__hot", "__parts").hint("merge"), [on, "__part"], how).drop("__part")


class Bloom:
    """A Bloom filter of the numbers in one column, of at most BLOOM_BYTES whatever their count.

    It is for leaving rows out before a shuffle whose join decides: with more
    numbers than it was meant for it only lets more rows pass. All probes of a
    number lie in one block, and each block is built in a task of its own.
    """

    def __init__(self, df: DataFrame, column: str):
        wanted = 16 * max(1, df.count())
        self.shift = 64 - max(1, min((BLOOM_BYTES // 1024).bit_length() - 1, (wanted >> 13).bit_length()))
        blocks = df.select(F.col(column).cast("long").alias("v")).filter("v IS NOT NULL").mapInArrow(self._placed(), "block int, v long")
        found = blocks.groupBy("block").applyInArrow(self._built(), "block int, bits binary").toArrow()
        bits = np.zeros((1 << 64 - self.shift, 1024), np.uint8)
        for block, b in zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True):
            bits[block] = np.frombuffer(b, np.uint8)
        self.shared = df.sparkSession.sparkContext.broadcast(bits)

    def _placed(self):
        shift = self.shift

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, _ = _probes(batch.column(0).to_numpy(), shift)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), batch.column(0)], ["block", "v"])

        return placed

    def _built(self):
        shift = self.shift

        def built(table: pa.Table) -> pa.Table:
            flags = np.zeros(1 << 13, bool)
            _, probes = _probes(table.column("v").to_numpy(), shift)
            flags[probes.ravel()] = True
            return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

        return built

    def test(self):
        """A function for workers: which of an array's numbers may be in."""
        shift, shared = self.shift, self.shared

        def among(values: np.ndarray) -> np.ndarray:
            block, probes = _probes(values, shift)
            return ((shared.value[block, probes >> 3] >> (probes & 7).astype(np.uint8)) & 1).all(axis=0)

        return among


def _probes(values: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each number and its four bits there."""
    h = mix64(values.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B0929F9A5))
    g = mix64(h * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(shift)).astype(np.int64), np.stack([(g >> np.uint64(16 * i)) & np.uint64(0x1FFF) for i in range(4)]).astype(np.int64)
