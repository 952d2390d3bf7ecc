"""Classification metrics by run over an explicit label list; each takes one aggregation of (run, gold, prediction) counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(rows: DataFrame, by: str, gold: str, pred: str) -> DataFrame:
    """(by, gold, pred, n): all that the metrics need of the rows, summed map-side; its size is that of the label set squared."""
    return rows.groupBy(F.col(by), F.coalesce(F.col(gold), F.lit("None")).alias("gold"), F.coalesce(F.col(pred), F.lit("None")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def confusion(counted: DataFrame, by: str, labels: tuple[str, ...]) -> DataFrame:
    """(by, gold, pred, n) of every pair of labels; rows with a label outside the list are in none."""
    pairs = [(g, p) for g in labels for p in labels]
    wide = counted.groupBy(by).agg(*[_where((F.col("gold") == g) & (F.col("pred") == p)).alias(f"c{k}") for k, (g, p) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(g).alias("gold"), F.lit(p).alias("pred"), F.col(f"c{k}").alias("n")) for k, (g, p) in enumerate(pairs)])
    return wide.select(by, F.inline(rows))


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def class_report(counted: DataFrame, by: str, labels: tuple[str, ...]) -> DataFrame:
    """(by, label, precision, recall, f1, support) of each label; what would divide by zero is 0."""
    sums = []
    for k, label in enumerate(labels):
        sums += [_where((F.col("gold") == label) & (F.col("pred") == label)).alias(f"tp{k}"), _where(F.col("pred") == label).alias(f"p{k}"), _where(F.col("gold") == label).alias(f"g{k}")]
    wide = counted.groupBy(by).agg(*sums)
    row = lambda k, label: F.struct(
        F.lit(label).alias("label"),
        ratio(F.col(f"tp{k}"), F.col(f"p{k}")).alias("precision"),
        ratio(F.col(f"tp{k}"), F.col(f"g{k}")).alias("recall"),
        ratio(F.col(f"tp{k}") * 2, F.col(f"p{k}") + F.col(f"g{k}")).alias("f1"),
        F.col(f"g{k}").alias("support"),
    )
    return wide.select(by, F.inline(F.array(*[row(k, label) for k, label in enumerate(labels)])))


def summary(counted: DataFrame, by: str, labels: tuple[str, ...]) -> DataFrame:
    """(by, n_examples, accuracy, macro_f1): accuracy over all rows, also those outside the label list; macro F1 as the
    mean over the list, labels without support included."""
    f1 = []
    for label in labels:
        hit, guessed, true = _where((F.col("gold") == label) & (F.col("pred") == label)), _where(F.col("pred") == label), _where(F.col("gold") == label)
        f1.append(ratio(hit * 2, guessed + true))
    accuracy = ratio(_where(F.col("gold") == F.col("pred")), F.sum("n"))
    return counted.groupBy(by).agg(F.sum("n").alias("n_examples"), accuracy.alias("accuracy"), (sum(f1[1:], f1[0]) / len(labels)).alias("macro_f1"))


def report_totals(counted: DataFrame, by: str, labels: tuple[str, ...]) -> DataFrame:
    """(by, row, precision, recall, f1, support): macro and weighted averages, and `accuracy` where every observed label
    is in the list, else `micro avg` over the list."""
    n = len(labels)
    tp = [_where((F.col("gold") == x) & (F.col("pred") == x)) for x in labels]
    p = [_where(F.col("pred") == x) for x in labels]
    g = [_where(F.col("gold") == x) for x in labels]
    inside = lambda c: F.col(c).isin(*labels)
    wide = counted.groupBy(by).agg(
        *[t.alias(f"tp{k}") for k, t in enumerate(tp)],
        *[t.alias(f"p{k}") for k, t in enumerate(p)],
        *[t.alias(f"g{k}") for k, t in enumerate(g)],
        _where(F.col("gold") == F.col("pred")).alias("right"),
        F.sum("n").alias("all"),
        F.bool_and(inside("gold") & inside("pred")).alias("covered"),
    )
    c = F.col
    precision = [ratio(c(f"tp{k}"), c(f"p{k}")) for k in range(n)]
    recall = [ratio(c(f"tp{k}"), c(f"g{k}")) for k in range(n)]
    f1 = [ratio(c(f"tp{k}") * 2, c(f"p{k}") + c(f"g{k}")) for k in range(n)]
    plus = lambda xs: sum(xs[1:], xs[0])
    support, hits, guesses = plus([c(f"g{k}") for k in range(n)]), plus([c(f"tp{k}") for k in range(n)]), plus([c(f"p{k}") for k in range(n)])
    weighted = lambda xs: ratio(plus([x * c(f"g{k}") for k, x in enumerate(xs)]), support)
    line = lambda name, a, b, d, s: F.struct(name.alias("row"), a.alias("precision"), b.alias("recall"), d.alias("f1"), s.alias("support"))
    accuracy = ratio(c("right"), c("all"))
    micro = (ratio(hits, guesses), ratio(hits, support), ratio(hits * 2, guesses + support))
    top = [F.when(c("covered"), accuracy).otherwise(m) for m in micro]
    rows = F.array(
        line(F.when(c("covered"), "accuracy").otherwise("micro avg"), *top, support),
        line(F.lit("macro avg"), *[plus(x) / n for x in (precision, recall, f1)], support),
        line(F.lit("weighted avg"), *[weighted(x) for x in (precision, recall, f1)], support),
    )
    return wide.select(by, F.inline(rows))


def one_vs_rest(counted: DataFrame, by: str, labels: tuple[str, ...]) -> DataFrame:
    """(by, label, accuracy, support) of each label against the rest, over the rows whose labels are both in the list."""
    kept = counted.where(F.col("gold").isin(*labels) & F.col("pred").isin(*labels))
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("all")]
    for k, label in enumerate(labels):
        sums += [_where((F.col("gold") == label) == (F.col("pred") == label)).alias(f"r{k}"), _where(F.col("gold") == label).alias(f"g{k}")]
    wide = kept.groupBy(by).agg(*sums)
    return wide.select(by, F.inline(F.array(*[F.struct(F.lit(x).alias("label"), ratio(F.col(f"r{k}"), F.col("all")).alias("accuracy"), F.col(f"g{k}").alias("support")) for k, x in enumerate(labels)])))


def shares(rows: DataFrame, by: str, value: Column, values: tuple[str, ...]) -> DataFrame:
    """(by, value, n, fraction) of each listed value, those that don't occur too; others count in the denominator only."""
    wide = rows.groupBy(by).agg(F.count(F.lit(1)).alias("all"), *[F.count_if(value == v).alias(f"v{k}") for k, v in enumerate(values)])
    return wide.select(by, F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"v{k}").alias("n"), (F.col(f"v{k}") / F.greatest(F.col("all"), F.lit(1))).alias("fraction")) for k, v in enumerate(values)])))


def outcome(gold: Column, raw: Column, norm: Column) -> Column:
    """What normalization does to a prediction."""
    before, after = F.coalesce(raw == gold, F.lit(False)), F.coalesce(norm == gold, F.lit(False))
    return F.when(before & after, "stay_correct").when(~before & after, "fixed").when(before, "broken").otherwise("stay_wrong")


def agreement(rows: DataFrame, by: str, a: str, b: str, labels: tuple[str, ...]) -> DataFrame:
    """(by, n, n_inside, n_outside, agreement, agreement_inside): how often two predictions agree, over all rows and over
    those whose second is in the list."""
    inside = F.coalesce(F.col(b).isin(*labels), F.lit(False))
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"), F.count_if(same).alias("s"), F.count_if(same & inside).alias("si"))
    return sums.select(by, "n", "n_inside", "n_outside", ratio(F.col("s"), F.col("n")).alias("agreement"), ratio(F.col("si"), F.col("n_inside")).alias("agreement_inside"))


def restricted(rows: DataFrame, by: str, model: str, probe: str, labels: tuple[str, ...]) -> DataFrame:
    """The summary of a probe against a model's predictions, over rows whose prediction is among the labels."""
    return summary(cells(rows.where(F.col(model).isin(*labels)), by, model, probe), by, labels)


def best_choice(scores: DataFrame, by: str, labels: tuple[str, ...]) -> DataFrame:
    """(by, pred_raw, pred_norm): the label of the largest score, and of the largest score per byte of its text; ties go to the
    earlier label. `scores` has label, score and text."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    score = lambda c: F.struct(c, -place)
    return scores.groupBy(by).agg(F.max_by("label", score(F.col("score"))).alias("pred_raw"), F.max_by("label", score(F.try_divide("score", F.octet_length("text")))).alias("pred_norm"))
