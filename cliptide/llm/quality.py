"""Quality rules: plain limits, and robust multivariate outliers within a language and source.

Every text gives a vector of transformed statistics. For each (lang, source), each
language and all documents together, the minimum covariance determinant estimate
is sought: of the share COVERAGE of documents whose scatter has the smallest
determinant. Starts are the coordinates' medians and median deviations, and STARTS
random handfuls; from each, concentration steps (take the share of documents nearest
by Mahalanobis distance, re-estimate, repeat) never raise the determinant. They
run on at most SUBSET documents of a group, which is all that a smaller group has;
for a larger one the best KEPT estimates then go on over all its documents, step by
step until the determinant stays, and the smallest wins. Distances are counted there
in fine logarithmic bins, the last one in part, so a step is one partially aggregated
pass that leaves at most BINS sums for each group, however large the group is.

A text's statistics also vary by chance, the more the shorter it is; that variance
(``noise``) is known. It keeps determinants above 0 where most texts have no symbol
or repetition at all, and a text's distance is taken in the scatter plus its own noise.
An estimate is shrunk towards the next wider group's as if PRIOR documents of that
belonged to it. Texts beyond LIMIT, a chi-square quantile, are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliptide.llm._common import Scratch, WordHashes, hot_join, mix64

REPEAT_WINDOW = 5
COVERAGE = 0.75
#: Random starts, estimates that go on over a large group, and documents of a group that starts are tried on.
STARTS, KEPT, SUBSET = 10, 2, 500
#: Concentration steps at most; a handful is enough as a rule.
STEPS = 25
BINS_PER_E, LOW_BIN, HIGH_BIN = 64, -640, 1920
PRIOR = 30
COORDINATES = 4
#: Estimates that are broadcast at most; more are joined.
BROADCAST = 20_000
#: Chance of a normal text's distance beyond LIMIT.
TAIL = 1e-6
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = bytes(1 if c in SYMBOLS else 0 for c in range(256))
_IS_CONT = bytes(1 if 0x80 <= c < 0xC0 else 0 for c in range(256))

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def chi_square_tail(x: float, degrees: int) -> float:
    """P(X > x) for an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return total


def chi_square_quantile(tail: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, degrees) > tail else (low, mid)
    return high


LIMIT = chi_square_quantile(TAIL, COORDINATES)
#: A normal sample's scatter over that of its nearest COVERAGE share.
SPREAD = COVERAGE / (1 - chi_square_tail(chi_square_quantile(1 - COVERAGE, COORDINATES), COORDINATES + 2))


def statistics(text: bytes | None, hashes: WordHashes) -> tuple[int, ...]:
    """STATS of one whole text (UTF-8); a null text has none of anything.

    n_lines counts lines with a word; it only scales n_dup_lines.
    """
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - sum(text.translate(_IS_CONT))
    symbols = sum(text.translate(_IS_SYMBOL))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if n > REPEAT_WINDOW:
        w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        h = np.zeros(n - REPEAT_WINDOW + 1, np.uint64)
        for i in range(REPEAT_WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : n - REPEAT_WINDOW + 1 + i]
        h = mix64(h)
        order = np.argsort(h)
        equal = h[order[1:]] == h[order[:-1]]
        if equal.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][equal]] = twice[order[:-1][equal]] = True
            edges = np.zeros(n + 1, np.int64)
            edges[: len(h)] += twice
            edges[REPEAT_WINDOW : REPEAT_WINDOW + len(h)] -= twice
            repeated = int((np.cumsum(edges)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def with_statistics(docs: DataFrame, text_col: str, names: dict[str, str], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row and its STATS under ``names``."""
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *[F.col(c) for c in keep])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [statistics(t.as_py(), hashes) for t in batch.column(0).cast(pa.binary())]
            cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], *[names[s] for s in STATS]])

    schema = T.StructType([*rows.schema.fields[1:], *[T.StructField(names[s], T.LongType()) for s in STATS]])
    return rows.mapInArrow(counted, schema)


def base_failed(names: dict[str, str]) -> Column:
    n = F.col(names["n_words"])
    return (n < 10) | (100 * F.col(names["n_repeat_words"]) > 20 * n)


def coordinates(names: dict[str, str]) -> list[Column]:
    """Log of the mean word length; square roots of the symbols' share of characters, the
    repeated lines' share of lines and the repeated words' share of words."""
    c = {s: F.col(names[s]).cast("double") for s in STATS}
    some = lambda x: F.greatest(x, F.lit(1.0))
    return [
        F.log(some(c["word_chars"]) / some(c["n_words"])),
        F.sqrt(c["n_symbols"] / some(c["word_chars"])),
        F.sqrt(c["n_dup_lines"] / some(c["n_lines"])),
        F.sqrt(c["n_repeat_words"] / some(c["n_words"])),
    ]


def noise(names: dict[str, str]) -> list[Column]:
    """Variances by chance: a share's square root varies by 1 / (4 n), n being the things counted
    (words repeat by the window), a mean's logarithm by its squared coefficient of variation / n,
    and word lengths vary by about half their mean."""
    some = lambda s: F.greatest(F.col(names[s]).cast("double"), F.lit(1.0))
    return [0.25 / some("n_words"), 0.25 / some("word_chars"), 0.25 / some("n_lines"), 0.25 * REPEAT_WINDOW / some("n_words")]


# An estimate is an array: centre, scatter, inverse of (scatter + target), log determinant of that.
_C, _S, _I, _D = 0, COORDINATES, COORDINATES + COORDINATES**2, COORDINATES + 2 * COORDINATES**2


def estimate_of(centre: np.ndarray, scatter: np.ndarray, target: np.ndarray) -> np.ndarray:
    whole = scatter + np.diag(target)
    return np.concatenate([centre, scatter.ravel(), np.linalg.inv(whole).ravel(), [np.linalg.slogdet(whole)[1]]])


def concentrate(x: np.ndarray, target: np.ndarray, start: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Concentration steps from an estimate until the determinant stays."""
    h = math.ceil(COVERAGE * len(x))
    best = start
    for i in range(steps):
        d = x - best[_C:_S]
        order = np.argsort(np.einsum("ij,jk,ik->i", d, best[_I:_D].reshape(COORDINATES, -1), d), kind="stable")[:h]
        part = x[order]
        new = estimate_of(part.mean(axis=0), np.cov(part.T, bias=True).reshape(COORDINATES, -1), target)
        if i and new[_D] >= best[_D] - 1e-9:
            break
        best = new
    return best


def candidates(x: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """The KEPT best estimates of ``x``, smallest determinant first."""
    x = x[np.lexsort(x.T[::-1])]
    rng = np.random.default_rng(20240607)
    centre = np.median(x, axis=0)
    starts = [estimate_of(centre, np.diag(np.square(1.4826 * np.median(np.abs(x - centre), axis=0))), target)]
    for _ in range(STARTS if len(x) > COORDINATES + 1 else 0):
        part = x[rng.choice(len(x), COORDINATES + 1, replace=False)]
        starts.append(estimate_of(part.mean(axis=0), np.cov(part.T, bias=True), target))
    found = sorted((concentrate(x, target, s) for s in starts), key=lambda e: e[_D])
    kept = [found[0]]
    for e in found[1:]:
        if len(kept) < KEPT and all(abs(e[_D] - k[_D]) > 1e-6 for k in kept):
            kept.append(e)
    return kept


def _started(table: pa.Table) -> pa.Table:
    """Estimates of one group's subset."""
    x, t = (np.stack([table.column(f"__{k}{i}").to_numpy() for i in range(COORDINATES)], axis=1) for k in "xt")
    found = candidates(x, t.mean(axis=0))
    group = table.column("__g")[0].as_py()
    return pa.table({"__g": pa.array([group] * len(found)), "__c": pa.array(range(len(found)), pa.int32()), "__e": pa.array([e.tolist() for e in found], pa.list_(pa.float64()))})


def _stepped(n: pd.Series, sums: pd.Series, products: pd.Series, target: pd.Series) -> pd.Series:
    """Estimates from weighted sums over the rows taken."""
    out = []
    for k, s, q, t in zip(n, sums, products, target, strict=True):
        centre = np.asarray(s) / k
        out.append(estimate_of(centre, np.asarray(q).reshape(COORDINATES, COORDINATES) / k - np.outer(centre, centre), np.asarray(t)))
    return pd.Series(out)


def _shrunk(n: pd.Series, own: pd.Series, wider_n: pd.Series, wider: pd.Series, widest: pd.Series) -> pd.Series:
    """Centre and scatter (made up for COVERAGE) of a group, each level with PRIOR documents of the next."""

    def mixed(k: float | None, e, base: np.ndarray) -> np.ndarray:
        if e is None or k is None or math.isnan(k):
            return base
        return (k * np.asarray(e)[:_I] + PRIOR * base) / (k + PRIOR)

    out = []
    for k, e, wk, w, top in zip(n, own, wider_n, wider, widest, strict=True):
        m = mixed(k, e, mixed(wk, w, np.asarray(top)[:_I]))
        out.append(np.concatenate([m[:_S], SPREAD * m[_S:]]))
    return pd.Series(out)


def _distance(model: pd.Series, x: pd.Series, t: pd.Series) -> pd.Series:
    """Squared Mahalanobis distance in the scatter plus a text's own noise; null without an estimate."""
    out = np.full(len(model), np.nan)
    at = np.flatnonzero(model.notna())
    if len(at):
        m, d, v = (np.stack([np.asarray(a, float) for a in s.iloc[at]]) for s in (model, x, t))
        d = d - m[:, :_S]
        whole = m[:, _S:].reshape(-1, COORDINATES, COORDINATES) + v[:, :, None] * np.eye(COORDINATES)
        out[at] = (d * np.linalg.solve(whole, d[:, :, None])[:, :, 0]).sum(axis=1)
    return pd.Series(out)


def apart(x: list[Column], e: Column) -> Column:
    """Squared Mahalanobis distance to an estimate."""
    d = [x[i] - e[i] for i in range(COORDINATES)]
    return reduce(lambda a, b: a + b, [d[i] * d[j] * e[_I + i * COORDINATES + j] for i in range(COORDINATES) for j in range(COORDINATES)])


def _group(level: int, lang: Column, source: Column) -> Column:
    """One text for a group of a level (0 all, 1 language, 2 language and source); nulls are values of their own."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *[c.alias(n) for c, n in ((lang, "lang"), (source, "source"))[:level]]))


def looked_up(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (a table) with the one row of ``found`` that has their group."""
    if found.count() <= BROADCAST:
        return rows.join(F.broadcast(found), "__g", how)
    return hot_join(rows, found, "__g", how)


def estimates(stats: DataFrame, names: dict[str, str], lang_col: str, source_col: str, scratch: Scratch) -> DataFrame:
    """(__g, __n, __e): the estimate of each group of each level, over the rows that pass the plain limits."""
    xs, ts = ([f"__{k}{i}" for i in range(COORDINATES)] for k in "xt")
    x = [F.col(c) for c in xs]
    levels = F.array(*[_group(i, F.col(lang_col), F.col(source_col)) for i in range(3)])
    rows = stats.filter(~base_failed(names)).select(
        F.explode(levels).alias("__g"), *[c.alias(n) for c, n in zip(coordinates(names), xs, strict=True)], *[c.alias(n) for c, n in zip(noise(names), ts, strict=True)]
    )
    rows = scratch.save(rows)
    sizes = scratch.save(rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), F.array(*[F.avg(t) for t in ts]).alias("__target")))
    # A subset of each group: partial limits come before the shuffle, so no task holds a group.
    order = F.row_number().over(Window.partitionBy("__g").orderBy(F.xxhash64(*xs, *ts), *xs, *ts))
    subset = rows.withColumn("__r", order).filter(F.col("__r") <= SUBSET).drop("__r")
    first = scratch.save(subset.groupBy("__g").applyInArrow(_started, "__g string, __c int, __e array<double>"))
    best = lambda df: df.groupBy("__g").agg(F.min(F.struct(F.col("__e")[_D].alias("d"), "__c", "__e")).alias("__b")).select("__g", F.col("__b.__e").alias("__e"))
    small = best(first.join(sizes.filter(F.col("__n") <= SUBSET), "__g", "left_semi"))
    large = sizes.filter(F.col("__n") > SUBSET)
    current = scratch.save(first.join(large, "__g").select("__g", "__c", "__e", "__n", "__target"))
    if current.isEmpty():
        return small.join(sizes, "__g").select("__g", "__n", "__e")
    members = scratch.save(rows.join(F.broadcast(large.select("__g")), "__g", "left_semi")) if large.count() <= BROADCAST else rows
    stepped = F.pandas_udf(_stepped, "array<double>")
    for step in range(STEPS):
        held = current.groupBy("__g").agg(F.collect_list(F.struct("__c", "__e")).alias("__all"))
        placed = looked_up(members, held).select("__g", *x, F.explode("__all").alias("__a")).select("__g", *x, "__a.__c", F.col("__a.__e").alias("__e"))
        placed = placed.withColumn(
            "__bin", F.least(F.lit(HIGH_BIN), F.greatest(F.lit(LOW_BIN), F.floor(F.log(apart(x, F.col("__e")) + 1e-12) * BINS_PER_E))).cast("int")
        )
        pairs = [(i, j) for i in range(COORDINATES) for j in range(i, COORDINATES)]
        binned = placed.groupBy("__g", "__c", "__bin").agg(
            F.count(F.lit(1)).alias("__k"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in pairs]
        )
        whole = Window.partitionBy("__g", "__c")
        room = F.ceil(F.lit(COVERAGE) * F.sum("__k").over(whole)) - (F.sum("__k").over(whole.orderBy("__bin")) - F.col("__k"))
        # The last bin counts in part, so that the share is exact.
        part = binned.withColumn("__w", F.least(F.lit(1.0), F.greatest(F.lit(0.0), room / F.col("__k")))).filter("__w > 0")
        w = F.col("__w")
        sums = part.groupBy("__g", "__c").agg(
            F.sum(F.col("__k") * w).alias("__k"), *[F.sum(F.col(f"s{i}") * w).alias(f"s{i}") for i in range(COORDINATES)], *[F.sum(F.col(f"q{i}_{j}") * w).alias(f"q{i}_{j}") for i, j in pairs]
        )
        products = F.array(*[F.col(f"q{min(i, j)}_{max(i, j)}") for i in range(COORDINATES) for j in range(COORDINATES)])
        old = current.select("__g", "__c", F.col("__e").alias("__old"), "__n", "__target")
        made = sums.join(old, ["__g", "__c"]).withColumn("__new", stepped(F.col("__k"), F.array(*[F.col(f"s{i}") for i in range(COORDINATES)]), products, F.col("__target")))
        # The subset's determinant is no measure for all documents: the first step replaces it.
        better = F.lit(step == 0) | (F.col("__new")[_D] < F.col("__old")[_D] - 1e-6)
        new = scratch.save(made.select("__g", "__c", F.when(better, F.col("__new")).otherwise(F.col("__old")).alias("__e"), "__n", "__target", better.alias("__better")))
        done = new.filter("__better").isEmpty()
        scratch.drop(current)
        current = new
        if done:
            break
    found = small.unionByName(best(current.select("__g", "__c", "__e")))
    return found.join(sizes, "__g").select("__g", "__n", "__e")


def judged(stats: DataFrame, names: dict[str, str], lang_col: str, source_col: str, scratch: Scratch) -> DataFrame:
    """Adds __failed (the plain limits), __distance (null if all texts fail those) and __kept."""
    found = scratch.save(estimates(stats, names, lang_col, source_col, scratch))
    lang, source = F.col(lang_col), F.col(source_col)
    shrunk = F.pandas_udf(_shrunk, "array<double>")
    groups = stats.select(*[_group(i, lang, source).alias(f"__g{i}") for i in range(3)]).distinct()
    for i in range(3):
        groups = groups.join(found.select(F.col("__g").alias(f"__g{i}"), F.col("__n").cast("double").alias(f"__n{i}"), F.col("__e").alias(f"__e{i}")), f"__g{i}", "left")
    models = groups.filter("__e0 IS NOT NULL").select(F.col("__g2").alias("__g"), shrunk("__n2", "__e2", "__n1", "__e1", "__e0").alias("__model"))
    models = scratch.save(models)
    rows = looked_up(stats.withColumn("__g", _group(2, lang, source)), models, "left")
    distance = F.pandas_udf(_distance, "double")
    rows = rows.withColumn("__failed", base_failed(names)).withColumn("__distance", distance(F.col("__model"), F.array(*coordinates(names)), F.array(*noise(names))))
    rows = rows.withColumn("__distance", F.when(F.isnan("__distance"), None).otherwise(F.col("__distance")))
    return rows.withColumn("__kept", ~F.col("__failed") & (F.coalesce("__distance", F.lit(0.0)) <= LIMIT)).drop("__g", "__model")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    One row per input row, over whole texts. Null, empty and blank texts have no
    words and fail the plain limits. Null languages and sources form groups of
    their own. Only where all texts fail the plain limits is there no estimate
    (distance null). Texts of any length are read whole. Repeated rows count each and get equal results; extra columns are ignored;
    an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    names = {s: s for s in STATS}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"), F.col(text_col).alias("text"))
    stats = scratch.save(with_statistics(rows, "text", names, ["doc_id", "__lang", "__source"]))
    return judged(stats, names, "__lang", "__source", scratch).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("__failed").alias("base_failed"), F.col("__distance").alias("distance"), F.col("__kept").alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of documents that pass, with all their columns; nulls and repeats as in ``quality``."""
    scratch = Scratch(docs.sparkSession, "quality")
    names = {s: f"__{s}" for s in STATS}
    stats = scratch.save(with_statistics(docs, "text", names, docs.columns))
    return judged(stats, names, "lang", "source", scratch).filter("__kept").select(*docs.columns)
