"""What Python workers hold at a time, and which are started."""

import random
import sys
import tracemalloc

import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle

from cliptide.llm import near_dedup, packing
from cliptide.llm._common import TEXT_ROWS, Scratch, hot_join

cloudpickle.register_pickle_by_value(sys.modules[__name__])
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _docs(spark, n):
    r = random.Random(5)
    texts = [" ".join(r.choices("abcdefghij", k=12)) for _ in range(n)]
    return spark.createDataFrame(pa.table({"doc_id": range(n), "text": texts, "lang": ["en"] * n})).coalesce(1)


def _few(batches):
    for batch in batches:
        if batch.num_rows > TEXT_ROWS:
            raise ValueError(f"{batch.num_rows} texts at once")
        yield batch


def test_texts_come_in_small_batches(spark, monkeypatch):
    """Ten thousand texts came as one batch, held by the JVM and by Python."""
    n, features, parts = 2 * TEXT_ROWS + 1, near_dedup._features, packing.parts_of
    docs = _docs(spark, n)
    monkeypatch.setattr(near_dedup, "_features", lambda batches: features(_few(batches)))
    assert near_dedup.near_duplicates(docs).count() == n
    monkeypatch.setattr(packing, "parts_of", lambda texts: parts(*(b.column(0) for b in _few([pa.record_batch([texts], ["text"])]))))
    assert packing.pack(docs).count() == n


def test_batches_are_the_sessions_again(spark):
    most = lambda rows: max(r.n for r in Scratch(spark, "t", rows).save(spark.range(0, 900, 1, 1).mapInArrow(lambda bs: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")).collect())
    spark.conf.unset(ROWS)
    before = spark.conf.get(ROWS)
    assert (most(100), most(None)) == (100, 900)
    assert spark.conf.get(ROWS) == before
    try:
        spark.conf.set(ROWS, "50")
        assert most(100) == 50
        assert spark.conf.get(ROWS) == "50"
    finally:
        spark.conf.unset(ROWS)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_start_no_python_workers(spark):
    """Rows made from Python objects are unpickled by workers of another kind, which stay."""
    left = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, IF(id < 2000, CAST('a' AS BINARY), CAST(CAST(id AS STRING) AS BINARY))) AS k", "id")
    right = left.select("k").distinct().filter("k IS NOT NULL").selectExpr("k", "length(k) AS n")
    joined = hot_join(left, right, "k", "left")
    assert "__part" in _plan(joined)
    assert "ExistingRDD" not in _plan(joined)
    assert sorted((r.id, r.n) for r in joined.collect()) == sorted((r.id, r.n) for r in left.join(right, "k", "left").collect())


def test_one_of_each_group_moves_no_texts_to_python(spark):
    docs = _docs(spark, 50)
    kept = near_dedup.keep_one(docs.union(docs))
    assert "ArrowEvalPython" in _plan(kept)
    assert "MapInArrow" not in _plan(kept)
    assert kept.orderBy("doc_id").collect() == docs.orderBy("doc_id").collect()


def test_tokens_of_a_batch_are_laid_out_in_parts():
    """For 24 MB of text at once, places of all its tokens took 196 MB."""
    texts = pa.array(["lorem ipsum dolor sit amet. " * 1000] * 860)
    words = packing.WordIds(public_tokenizers.path(packing.VOCABULARY))
    tracemalloc.start()
    try:
        ids = [words(part) for part in packing.parts_of(texts)]
        peak = tracemalloc.get_traced_memory()[1] - sum(flat.nbytes + ends.nbytes for flat, ends in ids)
    finally:
        tracemalloc.stop()
    assert sum(len(ends) - 1 for _, ends in ids) == 860
    assert len({flat[lo:hi].tobytes() for flat, ends in ids for lo, hi in zip(ends, ends[1:], strict=False)}) == 1
    assert peak < 150 << 20, peak >> 20
