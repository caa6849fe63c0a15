"""Mixing sources to target weights by balanced sampling (cube method).

Each source takes its rate = target / size of every document: the whole part of
the rate as copies, and the fraction as an inclusion probability. The flight
moves these probabilities through the null space of two balancing totals, words
and documents, a document at a time: with three open documents there is always
a direction that leaves both totals alone. Forward or backward along it one of the
three reaches 0 or 1; which way is drawn so that every probability keeps its
expectation, with numbers hashed from ids, so reruns agree. A source is cut into blocks
of about BLOCK documents that fly on their own, all but RESERVE of their
documents; what a block leaves open (the reserve and two at most) flies again
with the rest of its source, in fewer blocks, until one block holds it all. That
block ends with the landing: its open documents, a dozen, are rounded together
to come nearest to the words still due.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.llm._common import WORD, Scratch, mix64

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
#: Another seed draws another sample.
SEED = 20240607
BLOCK = 2048
RESERVE = 10
#: Open probabilities nearer to 0 or 1 than this are there.
NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(ids: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A number in [0, 1) for each document, by its id and size."""
    h = mix64(mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Moves probabilities, largest sizes first, until at most two are open.

    Sums of p and of p * size stay as they are; each p stays as it is on average
    over the draws, of which a step uses that of the document it takes up.
    """
    p = p.copy()
    live = [i for i in np.argsort(-size, kind="stable").tolist() if NEAR < p[i] < 1 - NEAR]
    hand: list[int] = []
    for i in live:
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        moves = [(p[k], x) for k, x in zip(hand, u, strict=True) if x]
        ahead = min((1 - q) / x if x > 0 else q / -x for q, x in moves)
        back = min(q / x if x > 0 else (1 - q) / -x for q, x in moves)
        step = ahead if draw[i] * (ahead + back) < back else -back
        for k, x in zip(hand, u, strict=True):
            p[k] += step * x
        hand = [k for k in hand if NEAR < p[k] < 1 - NEAR]
    return p


def land(p: np.ndarray, size: np.ndarray, due: float) -> np.ndarray:
    """Of all roundings of a dozen probabilities, the one whose words come nearest to ``due``,
    then whose documents come nearest to the sum of p."""
    n = len(p)
    choices = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = np.abs(choices @ size - due)
    docs = np.abs(choices.sum(axis=1) - p.sum())
    return choices[np.lexsort((docs, off))[0]].astype(float)


def _block(table: pa.Table) -> pa.Table:
    """Flies one block; lands it if it is the last of its source."""
    words = table.column("__words").to_numpy().astype(float)
    ids = np.array([(v is not None, v or 0) for v in table.column("__id").to_pylist()], dtype=np.int64).reshape(-1, 2)
    order = np.lexsort((ids[:, 1], ids[:, 0], words))
    size, p = words[order], table.column("__p").to_numpy()[order].copy()
    due = float(p @ size)
    reserve = np.unique(np.linspace(0, len(p) - 1, min(RESERVE, len(p))).astype(int))
    flying = np.setdiff1d(np.arange(len(p)), reserve)
    p[flying] = fly(p[flying], size[flying], drawn(ids[order, 1], size)[flying])
    done = (p < NEAR) | (p > 1 - NEAR)
    p[done] = np.round(p[done])
    if table.column("__last")[0].as_py():
        left = np.flatnonzero(~done)
        p[left] = land(p[left], size[left], due - float(p[done] @ size[done]))
    out = np.empty(len(p))
    out[order] = p
    return table.set_column(table.schema.get_field_index("__p"), "__p", pa.array(out))


def targets(rows: DataFrame) -> DataFrame:
    """(source, size) rows -> (source, source_size, target), one row a source.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. They share
    all words by weight; a source whose share exceeds three times its size gets
    just that, and the others share the excess anew, until none is above. In
    order of size / weight the capped sources come first: each is capped if what
    those before it left, shared by the weight of the rest, exceeds its cap.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sized = sized.withColumn("__weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(place) - 1) % len(WEIGHTS) + 1).cast("int")))
    sized = sized.withColumn("__cap", F.col("source_size") * float(MOST_COPIES)).withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    everyone = Window.orderBy("__ratio", F.col("source").isNull(), "source")
    behind, ahead = everyone.rowsBetween(Window.unboundedPreceding, -1), everyone.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    shared = sized.withColumn("__left", F.sum("source_size").over(all_) - F.coalesce(F.sum("__cap").over(behind), F.lit(0.0)))
    shared = shared.withColumn("__level", F.col("__left") / F.sum("__weight").over(ahead)).withColumn("__capped", F.col("__ratio") <= F.col("__level"))
    level = F.max(F.when(~F.col("__capped"), F.struct((-F.col("__ratio")).alias("r"), F.col("source").isNull().alias("n"), F.col("__level").alias("v")))).over(all_)
    return shared.withColumn("__open", level["v"]).select(
        "source", "source_size", F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("__open") * F.col("__weight")).alias("target")
    )


def sampled(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, source, size) rows -> one row for each distinct one, with source_size, target and
    copies, the times that each such row is taken."""
    aims = scratch.save(targets(rows)).withColumnRenamed("source", "__source")
    units = rows.groupBy("doc_id", "source", "size").agg((F.count(F.lit(1)) * F.first("size")).alias("__words"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(aims, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("__rate", rate)
    units = units.withColumn("__whole", F.floor(F.col("__rate") + NEAR)).withColumn("__p", F.greatest(F.lit(0.0), F.col("__rate") - F.col("__whole")))
    units = scratch.save(units.withColumn("__p", F.when((F.col("__words") > 0) & (F.col("__p") > NEAR), F.col("__p")).otherwise(0.0)))
    key = ["doc_id", "source", "size"]
    settled = units.filter("__p = 0").select(*key, F.lit(0.0).alias("__p"))
    open_ = units.filter("__p > 0").select(*key, "__words", "__p")
    schema = "doc_id long, source string, size long, __id long, __words double, __p double, __last boolean, __block long"
    while not open_.isEmpty():
        counts = scratch.save(open_.groupBy(F.col("source").alias("__source")).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("__blocks")))
        dealt = open_.join(counts, F.col("source").eqNullSafe(F.col("__source"))).select(
            *key, F.col("doc_id").alias("__id"), F.col("__words").cast("double").alias("__words"), "__p", (F.col("__blocks") == 1).alias("__last"),
            F.pmod(F.xxhash64("doc_id", "size"), F.col("__blocks")).alias("__block"),
        )
        flown = scratch.save(dealt.groupBy("source", "__block").applyInArrow(_block, schema))
        settled = settled.union(flown.filter("__p = 0 OR __p = 1").select(*key, "__p"))
        open_ = flown.filter("__p > 0 AND __p < 1").select(*key, "__words", "__p")
    chosen = settled.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("__p").alias("__more"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))
    return scratch.save(units.join(chosen, same).select(*key, "source_size", "target", (F.col("__whole") + F.col("__more")).cast("long").alias("copies")))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per input row.

    taken is 0 to 3 times the size. Null texts have size 0 and nothing to take;
    null sources are one source, last in order; a null doc_id is an id like any
    other. Rows equal in id, source and size are taken together. Reruns agree: all
    draws are hashes of ids and sizes. Extra columns are ignored; an empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(_rows(docs, id_col, text_col, source_col))
    chosen = sampled(rows, scratch).select(
        F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), "source_size", "target", "copies"
    )
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))
    return rows.join(chosen.hint("merge"), same).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of documents as often as it is taken, with all its columns; rows
    without words are never taken, other nulls and repeats are as in ``mix``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(_rows(docs, "doc_id", "text", "source"))
    chosen = sampled(rows, scratch).filter("copies > 0").select(
        F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("copies").alias("__copies")
    )
    sized = docs.withColumn("__size", word_count(F.col("text")))
    same = sized["doc_id"].eqNullSafe(chosen["__d"]) & sized["source"].eqNullSafe(chosen["__s"]) & (F.col("__size") == F.col("__z"))
    taken = sized.join(chosen.hint("merge"), same).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return taken.select(*docs.columns)
