"""Exact evaluation of scored pairs: rank metrics with ties, curves, confusion tables, leaderboards.

scored: a table with label (0 or 1) and score, and whatever identifies a row. Rows are grouped by score before
any running sum, so windows hold distinct scores, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import ranges
from weft.operators.features import ratio


def by_score(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, score, pos, neg and their running sums tp, fp from the highest score down, with totals p, n.

    Sums of ranges of scores come first, then running sums within each range.
    """
    yes = F.col("label").cast("bigint")
    hist = scored.groupBy(*keys, "score").agg(F.sum(yes).alias("pos"), F.sum(1 - yes).alias("neg"))
    hist = hist.withColumn("_block", ranges.blocks(scored, "score"))
    every = W.partitionBy(*keys)
    above = every.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    sums = hist.groupBy(*keys, "_block").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    sums = sums.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("_fp"),
        F.sum("_pos").over(every).alias("p"),
        F.sum("_neg").over(every).alias("n"),
    )
    down = W.partitionBy(*keys, "_block").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    tp, fp = F.col("_tp") + F.sum("pos").over(down), F.col("_fp") + F.sum("neg").over(down)
    return hist.join(sums, [*keys, "_block"]).select(*keys, "score", "pos", "neg", tp.alias("tp"), fp.alias("fp"), "p", "n")


def roc_auc(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting half; null where a class is missing."""
    area = F.sum((F.col("fp") - F.col("neg") / 2.0) * F.col("pos"))
    t = by_score(scored, keys).groupBy(*keys).agg(area.alias("a"), F.max("p").alias("p"), F.max("n").alias("n"))
    both = F.col("p") * F.col("n")
    return t.select(*keys, F.when(both > 0, 1.0 - F.col("a") / F.when(both > 0, both)).alias("roc_auc"))


def average_precision(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision at each distinct score, weighted by the recall it adds."""
    t = by_score(scored, keys).groupBy(*keys).agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("a"), F.max("p").alias("p"))
    return t.select(*keys, ratio(F.col("a"), F.col("p")).alias("pr_auc"))


def confusion_matrix(scored: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    yes, positive = F.col("score") >= threshold, F.col("label") == 1
    return scored.groupBy(*keys).agg(F.count_if(~yes & ~positive).alias("tn"), F.count_if(yes & ~positive).alias("fp"), F.count_if(~yes & positive).alias("fn"), F.count_if(yes & positive).alias("tp"))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy")]


def classification_metrics(scored: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    c = confusion_matrix(scored, threshold, keys)
    return c.select(*keys, *_rates(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))))


def confusion_at_thresholds(scored: DataFrame, steps: int = 19) -> DataFrame:
    """Confusion tables at 0.05, 0.10 ... 0.95; each row goes to the thresholds up to its score, by counting."""
    at = [F.struct(F.lit(k).alias("k"), F.lit(k * 5 / 100.0).alias("threshold")) for k in range(1, steps + 1)]
    counted = scored.select("label", F.inline(F.array(*[F.struct(s["threshold"].alias("threshold"), (F.col("score") >= s["threshold"]).alias("yes")) for s in at]))).groupBy("threshold").agg(F.count_if(~F.col("yes") & (F.col("label") == 0)).alias("tn"), F.count_if(F.col("yes") & (F.col("label") == 0)).alias("fp"), F.count_if(~F.col("yes") & (F.col("label") == 1)).alias("fn"), F.count_if(F.col("yes") & (F.col("label") == 1)).alias("tp"))
    return counted.select("threshold", "tn", "fp", "fn", "tp", *_rates(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))))


def hits_at_k(scored: DataFrame, share: float = 0.1, least: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Positives among the k best rows, by min(k, positives); k = max(least, share of rows); ties by (u, v)."""
    placed = scored.withColumn("_block", ranges.blocks(scored, "score"))
    every = W.partitionBy(*keys)
    sums = placed.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"), F.sum("label").alias("_pos"))
    sums = sums.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_rows").over(every.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_above"),
        F.greatest(F.lit(least), F.floor(share * F.sum("_rows").over(every))).alias("k"),
        F.sum("_pos").over(every).alias("p"),
    )
    # Ranges that begin below the k best rows count for nothing.
    inside = W.partitionBy(*keys, "_block").orderBy(F.desc("score"), "u", "v")
    t = placed.join(sums.where("_above < k"), [*keys, "_block"])
    t = t.withColumn("r", F.col("_above") + F.row_number().over(inside))
    top = t.groupBy(*keys).agg(F.sum(F.when(F.col("r") <= F.col("k"), F.col("label")).otherwise(0)).alias("h"), F.max(F.least("k", "p")).alias("m"))
    return top.select(*keys, ratio(F.col("h"), F.col("m")).alias("hits_at_k"))


def roc_curve(scored: DataFrame) -> DataFrame:
    """threshold, fpr, tpr at each distinct score (collinear points too), and (0, 0) with a null threshold."""
    t = by_score(scored)
    points = t.select(F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("n")).alias("fpr"), ratio(F.col("tp"), F.col("p")).alias("tpr"))
    start = t.limit(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_curve(scored: DataFrame) -> DataFrame:
    """threshold, precision, recall at each distinct score, and the end (1, 0) with a null threshold."""
    t = by_score(scored)
    points = t.select(F.col("score").alias("threshold"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("p")).alias("recall"))
    end = t.limit(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def leaderboard(scored: DataFrame) -> DataFrame:
    """One row a model of scored(model, u, v, label, score), metrics to four places, best ROC-AUC first."""
    keys = ("model",)
    out = roc_auc(scored, keys)
    for part in (average_precision(scored, keys), classification_metrics(scored, keys=keys), hits_at_k(scored, keys=keys)):
        out = out.join(part, "model")
    names = ["roc_auc", "pr_auc", "f1", "precision", "recall", "accuracy", "hits_at_k"]
    return out.select("model", *[F.round(c, 4).alias(c) for c in names]).orderBy(F.desc("roc_auc"), "model")
