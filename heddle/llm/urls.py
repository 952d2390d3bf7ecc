"""URL filtering: an allow and block list, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowest

#: (verdict, host, path) of the rule list.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Labelled URLs that trees are fitted to at most, by hash of the URL.
MOST_LABELLED = 4096
#: Trees, their depth, the shrinkage of each, cut points tried per feature, and rows a leaf needs.
TREES, DEPTH, RATE, CUTS, LEAF = 16, 3, 0.4, 24, 8
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "n_labels", "suffix_rate")


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null fields if none does. A rule fits its own host
    and all hosts below it where the path starts with the rule's. Equal lengths: the first in order."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need nothing but the URL."""
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    return {
        "length": n,
        "host_length": F.length(host).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n,
        "entropy": F.aggregate(chars, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))),
        "n_params": F.when(url.contains("?"), F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("[^&]+"))).otherwise(0).cast("double"),
        "n_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "n_labels": F.when(host == "", 0.0).otherwise(F.regexp_count(host, F.lit("[.]")) + 1.0),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def labelled_sample(labelled: DataFrame, most: int = MOST_LABELLED) -> list[dict]:
    """At most `most` labelled URLs (url, label), distinct, by hash: half of each label, so that rare ones are learnt."""
    host, path, h = F.col("__host"), F.col("__path"), F.xxhash64("url")
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).select("url", "label")
    # The threshold is a share of distinct URLs; their hashes alone are shuffled to count them.
    counts = {r["label"]: r["n"] for r in rows.select("label", h.alias("h")).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    near = F.lit(False)
    for label, n in counts.items():
        near = near | ((F.col("label") == label) & lowest(h, most // 2, n))
    rows = rows.where(near).distinct().withColumn("__host", host_of(F.col("url"))).withColumn("__path", path_of(F.col("url")))
    rows = rows.select("label", h.alias("h"), suffix_of(host).alias("suffix"), *[c.cast("double").alias(k) for k, c in lexical(F.col("url"), host, path).items()])
    drawn = sorted((r.asDict() for r in rows.collect()), key=lambda r: r["h"])
    return [r for label in (0, 1) for r in [x for x in drawn if x["label"] == label][: most // 2]]


def rates(sample: list[dict], key: str) -> tuple[dict[str, tuple[int, int]], float]:
    """(label sum, rows) of each value of `key`, and the rate over all."""
    by: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in sample:
        by[r[key]][0] += r["label"]
        by[r[key]][1] += 1
    return {k: (a, b) for k, (a, b) in by.items()}, sum(r["label"] for r in sample) / max(1, len(sample))


#: Pseudo-rows at the overall rate that smooth a suffix's own.
SMOOTH = 4.0


def fit(sample: list[dict]) -> dict:
    """Trees for log-odds of label 1, and the suffix statistics that a feature looks up.

    Each row's own label is left out of its statistics while fitting. An empty sample gives no trees and an even prior."""
    by, rate = rates(sample, "suffix")
    for r in sample:
        a, b = by[r["suffix"]]
        r["suffix_rate"] = (a - r["label"] + SMOOTH * rate) / (b - 1 + SMOOTH)
    y = [r["label"] for r in sample]
    prior = min(max(sum(y) / max(1, len(y)), 0.01), 0.99)
    base = math.log(prior / (1 - prior)) if y else 0.0
    columns = {f: [r[f] for r in sample] for f in FEATURES}
    cuts = {}
    for f, xs in columns.items():
        distinct = sorted(set(xs))
        step = max(1, len(distinct) // CUTS)
        cuts[f] = [(distinct[i] + distinct[i - 1]) / 2 for i in range(step, len(distinct), step)]
    place = {f: [sum(x > c for c in cuts[f]) for x in xs] for f, xs in columns.items()}
    score, trees = [base] * len(y), []

    def leaf(rows: list[int], g: list[float], h: list[float]) -> float:
        return RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1.0)

    def grow(rows: list[int], depth: int, g: list[float], h: list[float]):
        all_g, all_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = (1e-6, None, None)
        for f in FEATURES if depth and len(rows) >= 2 * LEAF else ():
            bins = [[0.0, 0.0, 0] for _ in range(len(cuts[f]) + 1)]
            at = place[f]
            for i in rows:
                b = bins[at[i]]
                b[0] += g[i]
                b[1] += h[i]
                b[2] += 1
            lg = lh = 0.0
            n = 0
            for k in range(len(cuts[f])):
                lg, lh, n = lg + bins[k][0], lh + bins[k][1], n + bins[k][2]
                if LEAF <= n <= len(rows) - LEAF:
                    gain = lg * lg / (lh + 1) + (all_g - lg) ** 2 / (all_h - lh + 1) - all_g * all_g / (all_h + 1)
                    if gain > best[0]:
                        best = (gain, f, k)
        _, f, k = best
        if f is None:
            return leaf(rows, g, h)
        return (f, cuts[f][k], grow([i for i in rows if place[f][i] <= k], depth - 1, g, h), grow([i for i in rows if place[f][i] > k], depth - 1, g, h))

    def value(tree, i: int) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if columns[tree[0]][i] <= tree[1] else tree[3]
        return tree

    for _ in range(TREES if y else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = grow(list(range(len(y))), DEPTH, [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p])
        trees.append(tree)
        score = [s + value(tree, i) for i, s in enumerate(score)]
    return {"base": base, "trees": trees, "suffixes": by, "rate": rate}


def tree_column(tree) -> Column:
    """A fitted tree as nested conditions."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(F.col(f"__{f}") <= F.lit(float(cut)), tree_column(low)).otherwise(tree_column(high))


def scored(urls: DataFrame, model: dict) -> DataFrame:
    """`urls` (url, __host, __path) with __score: log-odds of label 1. The suffix statistics have at most as many rows
    as the labelled sample, so they are sent to every task."""
    rate = float(model["rate"])
    known = [(k, (a + SMOOTH * rate) / (b + SMOOTH)) for k, (a, b) in sorted(model["suffixes"].items())]
    known = urls.sparkSession.createDataFrame(known, "__suffix string, __known double")
    x = urls.withColumn("__of", suffix_of(F.col("__host"))).join(F.broadcast(known), F.col("__of") == F.col("__suffix"), "left")
    x = x.withColumn("__suffix_rate", F.coalesce("__known", F.lit(rate))).drop("__of", "__suffix", "__known")
    x = x.withColumns({f"__{k}": c.cast("double") for k, c in lexical(F.coalesce("url", F.lit("")), F.col("__host"), F.col("__path")).items()})
    total = F.lit(float(model["base"]))
    for tree in model["trees"]:
        total = total + tree_column(tree)
    return x.withColumn("__score", total).drop(*[f"__{f}" for f in FEATURES])


def judge(urls: DataFrame, labelled: DataFrame | None = None, rules=RULES, most: int = MOST_LABELLED) -> DataFrame:
    """`urls` (url, and what else it has) with host, path, rule, verdict (allow or block) and score, the model's
    log-odds for block.

    The longest fitting rule decides; where none fits, the trees do. They learn from `labelled` (url, label 1 for block or
    0), by default those of `urls` that a rule decides, with its verdict; without any, nothing else is blocked. A null
    url, or one without ://, has empty host and path and is judged by the trees too. Repeated rows are judged alike; an
    empty table gives no rows. Columns host, path, rule, verdict and score of `urls` are replaced."""
    x = urls.drop("host", "path", "rule", "verdict", "score").withColumn("__host", host_of(F.col("url"))).withColumn("__path", path_of(F.col("url")))
    x = x.withColumn("__rule", rule_for(F.col("__host"), F.col("__path"), rules))
    if labelled is None:
        labelled = x.where(F.col("__rule.verdict").isNotNull()).select("url", (F.col("__rule.verdict") == "block").cast("int").alias("label"))
    x = scored(x, fit(labelled_sample(labelled, most)))
    by_model = F.when(F.col("__score") > 0, "block").otherwise("allow")
    x = x.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule.rule"), "verdict": F.coalesce("__rule.verdict", by_model), "score": F.col("__score")})
    return x.drop("__host", "__path", "__rule", "__score")
