"""URL filters: a list of host and path rules, and boosted trees for what no rule decides.

Everything over the pages is DataFrame expressions. The trees are trained on
URLs that a rule decides, from their lexical features: length, depth, digit
ratio, character entropy, parameter counts and statistics of the host's suffix.
Training takes at most SAMPLE labelled URLs (the ones of smallest hash; a
documented bound), brings their features to the driver once, and turns the trees
into one CASE expression. The suffix statistics are of all labelled URLs. A URL that
is learnt from sees those of the other FOLDS - 1 folds alone, so its own label never
helps to predict it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.llm._common import Scratch, hot_join

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled URLs that the trees learn from, at most.
SAMPLE = 20_000
FOLDS = 5
#: Suffixes whose statistics are broadcast at most; more are joined.
BROADCAST = 100_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 24, 3, 0.3, 24, 5, 1.0
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "suffix_share", "suffix_length")
Tree = list[tuple[int, float]] | float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, else nulls."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    digits = n - F.length(F.regexp_replace(u, "[0-9]", ""))
    # Runs of equal characters in sorted order: (character, run so far, sum of c log c of the runs behind).
    chars = F.filter(F.array_sort(F.split(u, "")), lambda c: c != "")
    bits = lambda k: k * F.log2(F.greatest(k, F.lit(1.0)))
    runs = F.aggregate(
        chars,
        F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s")),
        lambda a, c: F.struct(
            c.alias("c"), F.when(c == a["c"], a["k"] + 1).otherwise(1.0).alias("k"), F.when(c == a["c"], a["s"]).otherwise(a["s"] + bits(a["k"])).alias("s")
        ),
        lambda a: a["s"] + bits(a["k"]),
    )
    entropy = F.log2(F.greatest(n, F.lit(1))) - runs / F.greatest(n, F.lit(1))
    return {
        "length": n.cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": (n - F.length(F.translate(u, "?&=", ""))).cast("double"),
        "host_labels": F.size(F.filter(F.split(host, r"\."), lambda s: s != "")).cast("double"),
        "suffix_length": F.length(suffix(host)).cast("double"),
    }


def suffix(host: Column) -> Column:
    """The host's last two labels."""
    return F.substring_index(host, ".", -2)


def featured(pages: DataFrame, url: str) -> DataFrame:
    """Adds __host, __path, __rule, __given and the features but suffix_share."""
    host, path = host_and_path(F.col(url))
    rows = pages.withColumn("__host", host).withColumn("__path", path)
    rule, verdict = matching_rule(F.col("__host"), F.col("__path"))
    rows = rows.withColumn("__rule", rule).withColumn("__given", verdict).withColumn("__suffix", suffix(F.col("__host")))
    return rows.withColumns({f"__f_{k}": c for k, c in lexical(F.col(url), F.col("__host"), F.col("__path")).items()})


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on binned features: (feature, bin, left, right) or a leaf's value."""
    value = float(-g.sum() / (h.sum() + RIDGE))
    if depth == 0 or len(g) < 2 * LEAST_LEAF:
        return value
    base, best = g.sum() ** 2 / (h.sum() + RIDGE), (1e-6, -1, -1)
    for f in range(x.shape[1]):
        gs, hs, ns = (np.cumsum(np.bincount(x[:, f], w, BINS + 1)) for w in (g, h, np.ones(len(g))))
        ok = (ns >= LEAST_LEAF) & (len(g) - ns >= LEAST_LEAF)
        gain = np.where(ok, gs**2 / (hs + RIDGE) + (g.sum() - gs) ** 2 / (h.sum() - hs + RIDGE) - base, -1)
        if gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    _, f, cut = best
    if f < 0:
        return value
    low = x[:, f] <= cut
    return f, cut, grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list, list[np.ndarray]]:
    """(starting score, trees with thresholds as bins, bin edges of each feature)."""
    if not len(y):
        return 0.0, [], []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(rate / (1 - rate)))
    score, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = grow(binned, p - y, p * (1 - p), DEPTH)
        trees.append(tree)
        score += RATE * predict(tree, binned)
    return start, trees, edges


def predict(tree, binned: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(binned), tree)
    f, cut, low, high = tree
    return np.where(binned[:, f] <= cut, predict(low, binned), predict(high, binned))


def as_column(tree, edges: list[np.ndarray]) -> Column:
    """The tree as nested conditions; bin ``cut`` and lower ones are values up to edges[cut]."""
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    if cut >= len(edges[f]):
        return as_column(low, edges)
    return F.when(F.col(f"__f_{FEATURES[f]}") <= float(edges[f][cut]), as_column(low, edges)).otherwise(as_column(high, edges))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per input row.

    score is the trees' log odds of block; it decides where no rule fits (0 and
    above: block). suffix_share is the share of the suffix's labelled URLs, all
    of them, that rules block, 0.5 where there is none. Null URLs have empty host and
    path, fit no rule and are judged by the trees. Without any labelled URL all
    others are allowed. Repeated rows get equal results; extra columns are
    ignored; an empty table gives no rows.
    """
    rows = featured(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), "url")
    plain = [f for f in FEATURES if f != "suffix_share"]
    ill, fold = (F.col("__given") == "block").cast("int"), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    among = lambda i: (F.sum(F.when(F.col("__fold") != i, ill)), F.sum(F.when(F.col("__fold") != i, 1)))
    share = lambda bad, n: (F.coalesce(bad, F.lit(0)) + 1) / (F.coalesce(n, F.lit(0)) + 2)
    given = rows.filter("__given IS NOT NULL").withColumn("__fold", fold)
    shares = given.groupBy(F.col("__suffix").alias("__of")).agg(
        share(F.sum(ill), F.count(F.lit(1))).alias("__f_suffix_share"), F.array(*[share(*among(i)) for i in range(FOLDS)]).alias("__others")
    )
    shares = Scratch(pages.sparkSession, "url_filter").save(shares)
    sample = given.orderBy(F.xxhash64("url"), "url").limit(SAMPLE).select("__suffix", "__fold", ill.alias("__y"), *[f"__f_{f}" for f in plain])
    sample = sample.join(shares, F.col("__suffix") == F.col("__of")).withColumn("__f_suffix_share", F.get("__others", F.col("__fold"))).collect()
    y = np.array([r["__y"] for r in sample], float)
    x = np.array([[r[f"__f_{f}"] for f in FEATURES] for r in sample], float).reshape(len(sample), len(FEATURES))
    start, trees, edges = boost(x, y)
    score = F.lit(start if trees else -1.0)
    for tree in trees:
        score = score + F.lit(RATE) * as_column(tree, edges)
    shares = shares.select(F.col("__of").alias("__suffix"), "__f_suffix_share")
    known = rows.join(F.broadcast(shares), "__suffix", "left") if shares.count() <= BROADCAST else hot_join(rows, shares, "__suffix", "left")
    judged = known.withColumn("__f_suffix_share", F.coalesce("__f_suffix_share", F.lit(0.5))).withColumn("score", score)
    verdict = F.coalesce("__given", F.when(F.col("score") >= 0, "block").otherwise("allow"))
    return judged.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"), "score")
