"""Classification metrics from (keys, y, p): one pass of sums, and one ordered pass over distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.scan import running


def confusion(df: DataFrame, *keys: str, threshold: float = 0.5) -> DataFrame:
    hit = F.col("p") >= threshold
    y = F.col("y") == 1
    return df.groupBy(*keys).agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def scores(c: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, per-class precision, recall and F1 (0 where undefined), macro-F1, and balanced accuracy and MCC, which
    are null if only one class is there."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p1, r1, p0, r0 = zero(tp, tp + fp), zero(tp, tp + fn), zero(tn, tn + fn), zero(tn, tn + fp)
    f1, f0 = zero(2 * tp, 2 * tp + fp + fn), zero(2 * tn, 2 * tn + fp + fn)
    n = tp + fp + fn + tn
    both = (tp + fn > 0) & (tn + fp > 0)
    mcc = zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(*keys, "tp", "fp", "fn", "tn", F.try_divide(tp + tn, n).alias("accuracy"), p0.alias("precision_0"), r0.alias("recall_0"), f0.alias("f1_0"), p1.alias("precision_1"), r1.alias("recall_1"), f1.alias("f1_1"), ((f0 + f1) / 2).alias("macro_f1"), zero(f1 * (tp + fn) + f0 * (tn + fp), n).alias("weighted_f1"), F.when(both, (r0 + r1) / 2).alias("balanced_accuracy"), F.when(both, mcc).alias("mcc"), "brier")


def _by_score(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "p").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))


def roc_auc(df: DataFrame, *keys: str) -> DataFrame:
    """From average ranks over distinct scores; null if only one class is there."""
    s = _by_score(df, *keys)
    s = running(s, [F.col("p")], {"upto": F.col("n")}, *keys)
    rank = F.col("upto") - (F.col("n") - 1) / 2
    sums = s.withColumn("r", rank * F.col("ones")).groupBy(*keys).agg(F.sum("r").alias("r"), F.sum("ones").alias("n1"), F.sum(F.col("n") - F.col("ones")).alias("n0"))
    return sums.select(*keys, F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("roc_auc"))


def average_precision(df: DataFrame, *keys: str) -> DataFrame:
    """Sum of precision times the step in recall, tied scores as one step; null without ones."""
    s = _by_score(df, *keys)
    down = running(s, [F.desc("p")], {"hit": F.col("ones"), "flagged": F.col("n")}, *keys)
    steps = down.withColumn("precision", F.col("hit") / F.col("flagged"))
    return steps.groupBy(*keys).agg(F.try_divide(F.sum(F.col("precision") * F.col("ones")), F.sum("ones")).alias("average_precision"))


def best_threshold(df: DataFrame, *keys: str) -> DataFrame:
    """The score with the best macro-F1 as threshold, then balanced accuracy, then the smaller one."""
    s = _by_score(df, *keys)
    down = running(s, [F.desc("p")], {"tp": F.col("ones"), "fp": F.col("n") - F.col("ones")}, *keys)
    whole = s.groupBy(*keys).agg(F.sum("ones").alias("n1"), F.sum(F.col("n") - F.col("ones")).alias("n0"))
    counts = down.join(whole, list(keys)) if keys else down.crossJoin(F.broadcast(whole))  # one row
    c = counts.select(*keys, "p", "tp", "fp", (F.col("n1") - F.col("tp")).alias("fn"), (F.col("n0") - F.col("fp")).alias("tn"), F.lit(None).cast("double").alias("brier"))
    scored = scores(c, *keys, "p")
    best = F.max(F.struct(F.round("macro_f1", 12).alias("f"), F.coalesce(F.round("balanced_accuracy", 12), F.lit(-1.0)).alias("b"), (-F.col("p")).alias("p"), "macro_f1"))
    return scored.groupBy(*keys).agg(best.alias("best")).select(*keys, (-F.col("best.p")).alias("threshold"), "best.macro_f1")


def replayed(saved: DataFrame, predictions: DataFrame, *keys: str, tolerance: float = 1e-12) -> DataFrame:
    """Saved scores, and whether each row comes out of the saved predictions (keys, y, p) again; a key that only one side has doesn't."""
    again = scores(confusion(predictions, *keys), *keys)
    names = [c for c in saved.columns if c not in keys]
    both = saved.withColumn("_saved", F.lit(True)).join(again.select(*keys, *(F.col(c).alias(f"_{c}") for c in names)).withColumn("_again", F.lit(True)), list(keys), "full")
    same = F.col("_saved").isNotNull() & F.col("_again").isNotNull()
    for c in names:
        same = same & F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.col(c).isNull() & F.col(f"_{c}").isNull())
    return both.select(*keys, *names, same.alias("replayed"))
