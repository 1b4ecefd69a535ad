"""Accuracy families, rank statistics, confusion-matrix metrics and losses over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.shared import saved
from . import within
from .ordered import running


def accuracy(df: DataFrame, correct: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.sum(correct.cast("long")).alias("correct"), F.avg(correct.cast("double")).alias("accuracy"))


def macro_accuracy(df: DataFrame, name: str, correct: Column) -> DataFrame:
    """Mean over classes of each one's accuracy."""
    return df.groupBy(name).agg(F.avg(correct.cast("double")).alias("a")).agg(F.count("*").alias("n_classes"), F.avg("a").alias("macro_accuracy"))


def group_weights(df: DataFrame, group: str) -> DataFrame:
    """group, n, weight = total / (groups * n)."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("_t"), F.count("*").alias("_g"))
    return counts.crossJoin(F.broadcast(totals)).select(group, "n", (F.col("_t") / (F.col("_g") * F.col("n"))).alias("weight"))


def class_weighted_accuracy(df: DataFrame, label: str, correct: Column) -> DataFrame:
    """Sum of the class weights of correct rows over the plain number of rows."""
    per = df.groupBy(label).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("c"))
    return per.agg(F.sum("n").alias("t"), F.count("*").alias("g"), F.sum(F.col("c") / F.col("n")).alias("s")).select((F.col("s") / F.col("g")).alias("weighted_accuracy"), F.col("t").alias("total"))


def topk_balanced(hits: DataFrame, label: str, ks: tuple[int, ...]) -> DataFrame:
    """Mean over classes present of the share of rows whose true class has rank at most k."""
    per = hits.groupBy(label).agg(*(F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}") for k in ks))
    return per.agg(*(F.avg(f"top{k}").alias(f"top{k}") for k in ks))


def auroc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """Area under the ROC curve by rank sums, ties by mean rank. Scores are grouped first, so ranks come from running
    sums over distinct scores, bucket by bucket."""
    per = df.select(label.cast("int").alias("y"), score.alias("s")).groupBy("s").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    sums = running(per, "s", ["n"]).agg(F.sum(F.col("p") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auroc"))


def auroc_by(df: DataFrame, by: list[str], label: Column, score: Column) -> DataFrame:
    """(by, auroc): auroc() of each group. A group of any size is ranked in pieces; one of a single label has null."""
    per = df.select(*by, label.cast("int").alias("y"), score.alias("s")).groupBy(*by, "s").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    ranks = within.running_before(saved(per, "scores"), by, "s", ["n"])
    sums = ranks.groupBy(*by).agg(F.sum(F.col("p") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(*by, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))).alias("auroc"))


def binary_report(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """Counts, precision, recall (sensitivity), specificity and F1 of a yes/no prediction; 0 where undefined."""
    y, p = label.cast("boolean"), predicted.cast("boolean")
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Macro and support-weighted F1, macro recall, accuracy and Cohen's kappa of a multi-class prediction. A class that is only
    predicted counts in the macro averages, with F1 and recall 0."""
    c = confusion(df, label, predicted)
    support = c.groupBy(F.col(label).alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    given = c.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("given"))
    both = support.join(given.hint("merge"), "k", "full").select("k", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "given")))
    f1 = F.col("tp") * 2 / (F.col("support") + F.col("given"))
    out = both.agg(
        F.avg(f1).alias("f1_macro"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"), F.avg(F.col("tp") / F.greatest("support", F.lit(1))).alias("recall_macro"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"), (F.sum(F.col("support") * F.col("given")) / F.sum("support") / F.sum("support")).alias("pe"),
    )
    return out.select("f1_macro", "f1_weighted", "recall_macro", "accuracy", ((F.col("accuracy") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def f1_by(df: DataFrame, by: str, label: str, predicted: str) -> DataFrame:
    """(by, f1_macro, f1_weighted) of each group's multi-class prediction. A class that is only predicted counts in the macro mean with 0."""
    c = df.groupBy(by, F.col(label).alias("_l"), F.col(predicted).alias("_p")).agg(F.count("*").alias("_n"))
    sides = F.array(F.struct(F.col("_l").alias("k"), F.lit(True).alias("s")), F.struct(F.col("_p").alias("k"), F.lit(False).alias("s")))
    per = c.select(by, F.explode(sides).alias("x"), "_n", (F.col("_l") == F.col("_p")).alias("_ok")).groupBy(by, "x.k").agg(
        F.sum(F.when(F.col("x.s"), F.col("_n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("x.s"), F.col("_n")).otherwise(0)).alias("given"), F.sum(F.when(F.col("x.s") & F.col("_ok"), F.col("_n")).otherwise(0)).alias("tp")
    )
    f1 = F.col("tp") * 2 / (F.col("support") + F.col("given"))
    return per.groupBy(by).agg(F.avg(f1).alias("f1_macro"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def average_precision(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """Area under the precision-recall curve: sum over distinct scores, high to low, of recall gained times precision."""
    per = df.select(label.cast("int").alias("y"), score.alias("s")).groupBy("s").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    totals = per.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))  # one row
    cum = running(per, "s", ["p", "n"]).crossJoin(F.broadcast(totals)).select("p", (F.col("tp") - F.col("before_p")).alias("cp"), (F.col("tn") - F.col("before_n")).alias("cn"))
    return cum.agg((F.sum(F.col("p") * F.col("cp") / F.col("cn")) / F.sum("p")).alias("pr_auc"))


def latency_profile(df: DataFrame, value: str, order: str, warmup: int) -> DataFrame:
    """Order statistics of the rows after the first warmup: mean, min, max, and the values at floor(n / 2), floor(0.95 n)
    and floor(0.99 n) of the sorted list; throughput: 1000 / mean, rows a second for values in milliseconds. Values are counted first, so the running sum is over distinct values."""
    skip = df.select(order).orderBy(order).limit(warmup).agg(F.max(order).alias("_o"))
    kept = df.crossJoin(F.broadcast(skip)).where(F.col("_o").isNull() | (F.col(order) > F.col("_o")))
    per = kept.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    cum = running(per, "v", ["n"]).withColumn("c", F.col("before_n") + F.col("n")).crossJoin(F.broadcast(per.agg(F.sum("n").alias("t"))))
    at = lambda q: F.min(F.when(F.col("c") > F.floor(F.col("t") * q), F.col("v")))
    return cum.agg(F.max("t").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.max("t")).alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"), at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.sum(F.col("v") * F.col("n")).alias("total"), (1000 * F.max("t") / F.nullif(F.sum(F.col("v") * F.col("n")), F.lit(0.0))).alias("throughput"))


def smoothed_cross_entropy(logits: Column, label: Column, smoothing: float) -> Column:
    """Cross entropy of one row with label smoothing over the classes of logits."""
    c = logits.cast("array<double>")
    top = F.array_max(c)
    lse = top + F.log(F.aggregate(c, F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    own = lse - F.get(c, label.cast("int"))
    return (1 - smoothing) * own + smoothing * (lse - vec.mean(logits))
