"""Class balance, losses, run selection, and a gate classifier trained with Spark's own learners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelore.operators.edges import KEY
from gatelore.sources.staging import staged

#: The share of positives below which they weigh more, and both weights.
RARE, RARE_WEIGHT, EVEN_WEIGHT = 0.2, 0.8, 0.5


def class_balance(truth: DataFrame) -> DataFrame:
    """gates, positives, rate and the loss weight that goes with it."""
    out = truth.agg(F.count("*").alias("gates"), F.coalesce(F.sum("y"), F.lit(0)).alias("positives"))
    out = out.withColumn("rate", F.when(F.col("gates") > 0, F.col("positives") / F.col("gates")).otherwise(0.0))
    return out.withColumn("alpha", F.when(F.col("rate") < RARE, RARE_WEIGHT).otherwise(EVEN_WEIGHT))


def focal_loss(scored: DataFrame, alpha: float = 0.8, gamma: float = 2.0) -> DataFrame:
    """Mean focal loss of p against y."""
    pt = F.greatest(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-12))
    return scored.agg(F.avg(alpha * F.pow(1 - pt, gamma) * -F.log(pt)).alias("focal_loss"))


def best_epochs(log: DataFrame) -> DataFrame:
    """Per run the epoch of highest f1, ties by lower loss, then the earlier one."""
    w = Window.partitionBy("run").orderBy(F.desc("f1"), "loss", "epoch")
    return log.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def staleness(log: DataFrame) -> DataFrame:
    """Each epoch with the number of epochs since its run's f1 last rose above all before."""
    by = Window.partitionBy("run").orderBy("epoch")
    best = F.max("f1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rose = log.withColumn("rose", F.when(best.isNull() | (F.col("f1") > best), F.col("epoch")))
    return rose.withColumn("stale", F.col("epoch") - F.max("rose").over(by)).drop("rose")


def propagate(edges: DataFrame, features: DataFrame, columns: list[str], hops: int = 3) -> DataFrame:
    """Columns <name>_fw<k> and <name>_bw<k>: features averaged over both directions of the edges for 1..hops hops.

    Self-loops are added, and each edge weighs 1 / sqrt(degree of source * degree of target), degrees counted at targets.
    """
    out = features.select(*KEY, *columns)
    loops = features.select("design_id", F.col("gid").alias("src"), F.col("gid").alias("dst"))
    for way, pair in (("fw", ("src", "dst")), ("bw", ("dst", "src"))):
        e = edges.select("design_id", F.col(pair[0]).alias("src"), F.col(pair[1]).alias("dst")).union(loops)
        degree = e.groupBy("design_id", F.col("dst").alias("gid")).agg(F.count("*").alias("d"))
        w = e.join(degree.toDF("design_id", "src", "ds"), ["design_id", "src"]).join(degree.toDF("design_id", "dst", "dd"), ["design_id", "dst"])
        w = staged(w.select("design_id", "src", "dst", (1 / F.sqrt(F.col("ds") * F.col("dd"))).alias("w")))
        now = features.select(*KEY, *columns)
        for k in range(1, hops + 1):
            sums = w.join(now.withColumnRenamed("gid", "src"), ["design_id", "src"]).groupBy("design_id", F.col("dst").alias("gid")).agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in columns])
            now = staged(sums)
            out = out.join(now.select(*KEY, *[F.col(c).alias(f"{c}_{way}{k}") for c in columns]), KEY)
    return out


def dense_scores(rows: DataFrame, columns: list[str], weights: DataFrame) -> DataFrame:
    """design_id, gid, p: dense layers over the given columns, with ReLU between and softmax over the last two outputs.

    ``weights``: layer (sorted as text), i (input, -1 for the bias), j (output), w: a model's size, checked against the columns.
    """
    table = weights.toPandas()
    layers = []
    wide = len(columns)
    for name, part in sorted(table.groupby("layer"), key=lambda x: x[0]):
        w = np.zeros((int(part.i.max()) + 2, int(part.j.max()) + 1))
        w[part.i.to_numpy() + 1, part.j.to_numpy()] = part.w
        if len(w) - 1 != wide:
            raise ValueError(f"layer {name} takes {len(w) - 1} inputs; {wide} are given")
        layers.append(w)
        wide = w.shape[1]
    if wide != 2:
        raise ValueError(f"the last layer has {wide} outputs instead of 2")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[columns].to_numpy(float)
            for k, w in enumerate(layers):
                x = x @ w[1:] + w[0]
                x = np.maximum(x, 0) if k < len(layers) - 1 else x
            z = np.exp(x - x.max(axis=1, keepdims=True))
            yield pd.DataFrame({"design_id": b.design_id, "gid": b.gid, "p": z[:, 1] / z.sum(axis=1)})

    return rows.select(*KEY, *columns).mapInPandas(score, "design_id long, gid long, p double")


def held_out_design(seed: int = 0, share: float = 0.3):
    """True for designs of the held-out side; no design is on both."""
    return F.pmod(F.xxhash64(F.lit(seed), "design_id"), F.lit(1000)) < int(share * 1000)


def train_classifier(rows: DataFrame, columns: list[str], seed: int = 0, share: float = 0.3, **options) -> tuple[object, DataFrame]:
    """Fit a weighted gate classifier on the designs that are not held out; returns the model and scores p of those that are."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    balance = class_balance(rows.select("y")).collect()[0]
    tagged = rows.withColumns({"held": held_out_design(seed, share), "weight": F.when(F.col("y") == 1, balance.alpha).otherwise(1 - balance.alpha)})
    table = VectorAssembler(inputCols=columns, outputCol="features").transform(tagged)
    model = LogisticRegression(labelCol="y", weightCol="weight", maxIter=options.pop("maxIter", 20), regParam=options.pop("regParam", 0.01), **options).fit(table.filter("NOT held"))
    scored = model.transform(table.filter("held")).select(*KEY, "y", vector_to_array("probability")[1].alias("p"))
    return model, scored


def best_threshold(metrics: DataFrame) -> DataFrame:
    """The threshold of highest f1, ties by the higher threshold."""
    return metrics.orderBy(F.desc("f1"), F.desc("threshold")).limit(1)
