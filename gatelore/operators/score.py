"""Filters on flagged gates, verdicts, and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelore.operators.edges import KEY
from gatelore.operators.iterate import component_roots, context

#: The default filters, and the points of a right verdict.
HOPS, LEAST_GROUP, LEAST_TOTAL, VERDICT_POINTS = 1, 5, 10, 2


def threshold(scores: DataFrame, t: float = 0.5) -> DataFrame:
    """flag = 1 where p >= t."""
    return scores.select(*KEY, (F.col("p") >= t).cast("int").alias("flag"))


def drop_isolated(flags: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """Clear flagged gates without another flagged gate within ``hops`` undirected steps. The flags given decide, not those left."""
    on = flags.filter("flag = 1").select(KEY)
    if hops == 1:
        both = edges.select("design_id", F.col("src").alias("gid"), F.col("dst").alias("other")).union(edges.select("design_id", "dst", "src")).filter("gid <> other")
        near = both.join(on.select("design_id", F.col("gid").alias("other")), ["design_id", "other"], "left_semi").select(KEY).distinct()
    else:
        both = edges.select("design_id", "src", "dst").union(edges.select("design_id", "dst", "src")).distinct()
        reach = on.select("design_id", F.col("gid").alias("src"), F.col("gid").alias("dst"))
        for _ in range(hops):
            reach = reach.union(reach.join(both.toDF("design_id", "dst", "end"), ["design_id", "dst"]).select("design_id", "src", F.col("end").alias("dst"))).distinct()
        near = reach.filter("src <> dst").join(on.select("design_id", F.col("gid").alias("dst")), ["design_id", "dst"], "left_semi").select("design_id", F.col("src").alias("gid")).distinct()
    kept = on.join(near, KEY, "left_semi").withColumn("kept", F.lit(1))
    return flags.select(KEY).join(kept, KEY, "left").select(*KEY, F.coalesce("kept", F.lit(0)).alias("flag"))


def drop_small_clusters(flags: DataFrame, edges: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """Clear connected groups of flagged gates smaller than ``least``."""
    on = flags.filter("flag = 1").select(KEY)
    inner = edges.join(on.select("design_id", F.col("gid").alias("src")), ["design_id", "src"], "left_semi").join(on.select("design_id", F.col("gid").alias("dst")), ["design_id", "dst"], "left_semi")
    roots = component_roots(on, inner.select("design_id", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).distinct())
    large = roots.groupBy("design_id", "root").count().filter(F.col("count") >= least).select("design_id", "root")
    kept = roots.join(large, ["design_id", "root"], "left_semi").select(*KEY, F.lit(1).alias("kept"))
    return flags.select(KEY).join(kept, KEY, "left").select(*KEY, F.coalesce("kept", F.lit(0)).alias("flag"))


def least_total(flags: DataFrame, least: int = LEAST_TOTAL) -> DataFrame:
    """Clear designs with fewer than ``least`` flagged gates."""
    enough = flags.groupBy("design_id").agg(F.sum("flag").alias("n")).filter(F.col("n") >= least).select("design_id", F.lit(1).alias("enough"))
    return flags.join(enough, "design_id", "left").select(*KEY, F.when(F.col("enough") == 1, F.col("flag")).otherwise(0).alias("flag"))


def filtered_flags(scores: DataFrame, edges: DataFrame, t: float = 0.5) -> DataFrame:
    """Threshold, then the three filters in order."""
    return least_total(drop_small_clusters(drop_isolated(threshold(scores, t), edges), edges))


def confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, tn by design; ``predicted`` has flag, ``truth`` y."""
    pair = truth.select(*KEY, "y").join(predicted.select(*KEY, "flag"), KEY, "left").na.fill(0, ["flag"])
    return pair.groupBy("design_id").agg(*[F.count_if((F.col("flag") == f) & (F.col("y") == y)).alias(n) for n, f, y in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))])


def grades(cases: DataFrame) -> DataFrame:
    """From tp, fp, fn, tn: precision, recall, f1, both verdicts, points and score of each design."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = cases.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "predicted_trojaned": tp + fp > 0, "truly_trojaned": tp + fn > 0})
    out = out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    right = F.col("predicted_trojaned") == F.col("truly_trojaned")
    out = out.withColumn("classification", F.when(right, VERDICT_POINTS).otherwise(0).cast("long"))
    return out.withColumn("score", F.col("classification") + F.when(F.col("truly_trojaned") & right, F.col("f1")).otherwise(0.0))


def run_summary(cases: DataFrame) -> DataFrame:
    """Scored designs, total and mean score, by where the answer came from, and over all (source null)."""
    return cases.rollup("source").agg(F.count("*").alias("designs"), F.sum("score").alias("total"), F.avg("score").alias("mean"))


def corpus_metrics(scores: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Metrics over all gates at each of a few thresholds (strictly above)."""
    grid = scores.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    pair = scores.select(*KEY, "p").join(truth.select(*KEY, "y"), KEY).crossJoin(F.broadcast(grid))
    flag = F.col("p") > F.col("threshold")
    out = pair.groupBy("threshold").agg(
        F.count_if(flag & (F.col("y") == 1)).alias("tp"), F.count_if(flag & (F.col("y") == 0)).alias("fp"), F.count_if(~flag & (F.col("y") == 1)).alias("fn"), F.count_if(~flag & (F.col("y") == 0)).alias("tn")
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})
    none = F.col("tp") + F.col("fp") + F.col("fn") == 0
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", F.when(none, 1.0).otherwise(f1))


def outcome_classes(gates: DataFrame, predicted: DataFrame | None, truth: DataFrame | None) -> DataFrame:
    """TP, FN, FP or TN of every gate; with one side missing, that side's positives against the rest."""
    out = gates.select(KEY)
    for side, name in ((predicted, "flag"), (truth, "y")):
        out = out.join(side.filter(F.col(name) == 1).select(*KEY, F.lit(True).alias(name)), KEY, "left") if side is not None else out.withColumn(name, F.lit(None).cast("boolean"))
    f, y = F.coalesce("flag", F.lit(False)), F.coalesce("y", F.lit(False))
    if truth is None:
        outcome = F.when(f, "FP").otherwise("TN")
    elif predicted is None:
        outcome = F.when(y, "FN").otherwise("TN")
    else:
        outcome = F.when(f & y, "TP").when(y, "FN").when(f, "FP").otherwise("TN")
    return out.select(*KEY, outcome.alias("outcome"))


def component_labels(components: DataFrame, truth: DataFrame, least: float = 0.01) -> DataFrame:
    """y_wcc = 1 for every gate of a component whose share of positives reaches ``least``."""
    tagged = components.join(truth.select(*KEY, "y"), KEY)
    share = tagged.groupBy("design_id", "component_id").agg(F.avg("y").alias("share"))
    return components.join(share, ["design_id", "component_id"]).select(*KEY, (F.col("share") >= least).cast("int").alias("y_wcc"))


def component_purity(components: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Of each trojaned design the component that holds most positives, the share of positives in it, and whether it was flagged."""
    t = components.join(truth.select(*KEY, "y"), KEY).join(predicted.select(*KEY, "flag"), KEY)
    by = t.groupBy("design_id", "component_id").agg(F.sum("y").alias("positives"), F.count("*").alias("gates"))
    best = by.groupBy("design_id").agg(F.max_by(F.struct("component_id", "positives", "gates"), F.struct("positives", -F.col("component_id"))).alias("b"))
    found = t.groupBy("design_id").agg((F.sum("flag") > 0).alias("found"))
    return best.select("design_id", "b.*").filter("positives > 0").join(found, "design_id").select("design_id", "component_id", "positives", "gates", (F.col("positives") / F.col("gates")).alias("purity"), "found")


def verdict_report(cases: DataFrame) -> DataFrame:
    """Designs by both verdicts: count, score reached, points that were possible (3 if trojaned, else 2), median f1, full recall at low precision."""
    possible = F.when(F.col("truly_trojaned"), 3.0).otherwise(2.0)
    return cases.groupBy("predicted_trojaned", "truly_trojaned").agg(
        F.count("*").alias("designs"), F.sum("score").alias("reached"), F.sum(possible).alias("possible"), F.sum(possible - F.col("score")).alias("lost"), F.median("f1").alias("median_f1"),
        F.count_if((F.col("recall") == 1) & (F.col("precision") < 0.5)).alias("full_recall_low_precision"),
    )


def seed_context(flags: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    return context(flags.filter("flag = 1"), edges, hops)
