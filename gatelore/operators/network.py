"""Scoring gates with a whole network from one table of weights, and training a gate classifier with focal loss.

The network: hops of graph convolutions along and against the edges, joined and projected; a two-layer network over each
component's descriptor; a two-layer head over all hops' outputs and the component's. Sums over edges are Spark aggregates of
vector columns (partial sums are made where the edges lie); dense layers are numpy over Arrow batches, with the weights
shipped to tasks: a model's size, checked against the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelore.operators.edges import KEY
from gatelore.sources.staging import staged

#: Rows of a weight table that are taken for a model, at most.
MOST_WEIGHTS = 10_000_000


def weight_table(spark: SparkSession, layers: dict[str, np.ndarray]) -> DataFrame:
    """layer, i, j, w of layers that have the bias in their first row (i = -1)."""
    rows = [(name, i - 1, j, float(x)) for name, w in layers.items() for i, row in enumerate(w) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "layer string, i int, j int, w double")


def layers_of(weights: DataFrame) -> dict[str, np.ndarray]:
    """The layers of a weight table (layer, i, j, w); the bias, i = -1, in the first row."""
    n = weights.count()
    if n > MOST_WEIGHTS:
        raise ValueError(f"a model of {n} weights is larger than the {MOST_WEIGHTS} allowed")
    out = {}
    for name, part in weights.toPandas().groupby("layer"):
        w = np.zeros((int(part.i.max()) + 2, int(part.j.max()) + 1))
        w[part.i.to_numpy() + 1, part.j.to_numpy()] = part.w
        out[name] = w
    return out


def checked(layers: dict[str, np.ndarray], inputs: int, parts: int) -> int:
    """The number of hops of a network whose layers fit each other and the columns given; ValueError where they don't."""
    hops, wide, fused = 0, inputs, 0

    def takes(name: str, n: int) -> int:
        if name not in layers:
            raise ValueError(f"the weights lack layer {name}")
        if len(layers[name]) - 1 != n:
            raise ValueError(f"layer {name} takes {len(layers[name]) - 1} inputs; {n} are given")
        return layers[name].shape[1]

    while f"conv{hops}.fw" in layers:
        wide = takes(f"conv{hops}.join", takes(f"conv{hops}.fw", wide) + takes(f"conv{hops}.bw", wide))
        fused, hops = fused + wide, hops + 1
    fused += takes("part.1", takes("part.0", parts))
    if takes("head.1", takes("head.0", fused)) != 2:
        raise ValueError("the head has other than 2 outputs")
    if extra := set(layers) - {f"conv{k}.{x}" for k in range(hops) for x in ("fw", "bw", "join")} - {"part.0", "part.1", "head.0", "head.1"}:
        raise ValueError(f"the weights have layers that the network lacks: {', '.join(sorted(extra))}")
    return hops


def _dense(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[1:] + w[0]


def _vectors(df: DataFrame, keys: list[str], columns: list[str], forward: Callable[..., np.ndarray], name: str) -> DataFrame:
    """The keys and one vector column: ``forward`` of the given vector columns, each a matrix."""
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = forward(*(b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in columns))
                lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(out).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), lists], names=[*keys, name])

    return df.select(*keys, *columns).mapInArrow(run, f"{fields}, {name} array<double>")


def edge_weights(gates: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """design_id, src, dst, w along (fw) and against (bw) the edges: self-loops added, 1 / sqrt of both degrees, counted at targets."""
    loops, out = gates.select("design_id", F.col("gid").alias("src"), F.col("gid").alias("dst")), {}
    for way, (a, z) in (("fw", ("src", "dst")), ("bw", ("dst", "src"))):
        e = edges.select("design_id", F.col(a).alias("src"), F.col(z).alias("dst")).union(loops)
        degree = e.groupBy("design_id", F.col("dst").alias("gid")).agg(F.count("*").alias("d"))
        e = e.join(degree.toDF("design_id", "src", "ds"), ["design_id", "src"]).join(degree.toDF("design_id", "dst", "dd"), ["design_id", "dst"])
        out[way] = staged(e.select("design_id", "src", "dst", (1 / F.sqrt(F.col("ds") * F.col("dd"))).alias("w")))
    return out


def gathered(weights: DataFrame, h: DataFrame, wide: int, name: str) -> DataFrame:
    """design_id, gid and the weighted sum of the vectors ``h`` over the edges into each gate."""
    sums = weights.join(h.withColumnRenamed("gid", "src"), ["design_id", "src"]).groupBy("design_id", F.col("dst").alias("gid"))
    sums = sums.agg(*[F.sum(F.col("w") * F.col("h")[k]).alias(f"_{k}") for k in range(wide)])
    return sums.select(*KEY, F.array(*[F.col(f"_{k}") for k in range(wide)]).alias(name))


def network_scores(features: DataFrame, columns: list[str], edges: DataFrame, components: DataFrame, descriptors: DataFrame, part_columns: list[str], weights: DataFrame) -> DataFrame:
    """design_id, gid, p: the softmax share of class 1 of every gate.

    ``features``: design_id, gid and the columns; ``components``: design_id, gid, component_id; ``descriptors``:
    design_id, component_id and the part columns; ``weights``: layers conv0.fw, conv0.bw, conv0.join, conv1..., part.0,
    part.1, head.0, head.1, whose sizes are checked against each other and the columns.
    """
    layers = layers_of(weights)
    hops = checked(layers, len(columns), len(part_columns))
    weighted = edge_weights(features, edges)
    h = staged(features.select(*KEY, F.array(*[F.col(c).cast("double") for c in columns]).alias("h")))
    outputs, wide = [], len(columns)
    for k in range(hops):
        both = gathered(weighted["fw"], h, wide, "fw").join(gathered(weighted["bw"], h, wide, "bw"), KEY)
        fw, bw, join = (layers[f"conv{k}.{x}"] for x in ("fw", "bw", "join"))
        h = staged(_vectors(both, KEY, ["fw", "bw"], lambda a, b, fw=fw, bw=bw, join=join: np.maximum(_dense(np.hstack([_dense(a, fw), _dense(b, bw)]), join), 0), "h"))
        outputs.append(h.withColumnRenamed("h", f"h{k}"))
        wide = join.shape[1]
    vectors = descriptors.select("design_id", "component_id", F.array(*[F.col(c).cast("double") for c in part_columns]).alias("d"))
    part = _vectors(vectors, ["design_id", "component_id"], ["d"], lambda d: _dense(np.maximum(_dense(d, layers["part.0"]), 0), layers["part.1"]), "z")
    rows = components.join(part, ["design_id", "component_id"]).select(*KEY, "z")
    for out in outputs:
        rows = rows.join(out, KEY)

    def head(*x: np.ndarray) -> np.ndarray:
        z = _dense(np.maximum(_dense(np.hstack(x), layers["head.0"]), 0), layers["head.1"])
        return 1 / (1 + np.exp(z[:, :1] - z[:, 1:]))

    return _vectors(rows, KEY, [*(f"h{k}" for k in range(hops)), "z"], head, "score").select(*KEY, F.col("score")[0].alias("p"))


# --- training -------------------------------------------------------------------------------------------------------------


class Classifier:
    """A network of one hidden layer over standardised columns; weights are one flat vector."""

    def __init__(self, inputs: int, hidden: int, seed: int = 0):
        self.shapes = [(inputs + 1, hidden), (hidden + 1, 1)]
        rng = np.random.default_rng(seed)
        self.flat = np.concatenate([np.vstack([np.zeros(n), rng.normal(0, np.sqrt(2 / (m - 1)), (m - 1, n))]).ravel() for m, n in self.shapes])

    def layers(self, flat: np.ndarray) -> list[np.ndarray]:
        sizes = np.cumsum([m * n for m, n in self.shapes])[:-1]
        return [x.reshape(s) for x, s in zip(np.split(flat, sizes), self.shapes)]

    def margin(self, x: np.ndarray, flat: np.ndarray) -> np.ndarray:
        first, second = self.layers(flat)
        return _dense(np.maximum(_dense(x, first), 0), second)[:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray, flat: np.ndarray, alpha: float, gamma: float) -> tuple[np.ndarray, float]:
        """The summed gradient of the focal loss, and the summed loss."""
        first, second = self.layers(flat)
        hidden = np.maximum(_dense(x, first), 0)
        sign = np.where(y == 1, 1.0, -1.0)
        s = sign * _dense(hidden, second)[:, 0]
        log_p = -np.logaddexp(0, -s)
        p = np.exp(log_p)
        by_margin = sign * alpha * (1 - p) ** gamma * (gamma * p * log_p - (1 - p))
        at_hidden = np.outer(by_margin, second[1:, 0]) * (hidden > 0)
        grads = [np.vstack([at_hidden.sum(axis=0), x.T @ at_hidden]), np.concatenate([[by_margin.sum()], hidden.T @ by_margin])[:, None]]
        return np.concatenate([g.ravel() for g in grads]), float((alpha * (1 - p) ** gamma * -log_p).sum())


def standardised(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Rows with the vector x of their columns, centred and scaled over the rows that are not held out; and the numbers used."""
    found = rows.filter("NOT held").agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    numbers = [(found[f"m{k}"] or 0.0, found[f"s{k}"] or 1.0) for k in range(len(columns))]
    x = F.array(*[((F.col(c) - m) / s).cast("double") for c, (m, s) in zip(columns, numbers)])
    return rows.select(*KEY, "y", "held", x.alias("x")), numbers


def _step(batches: Iterator[pa.RecordBatch], model: Classifier, flat: np.ndarray, alpha: float, gamma: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """One task's sums, a row for each weight and then loss, rows, and on held-out rows hits, false alarms and misses."""
    total = np.zeros(len(flat) + 5)
    for b in batches:
        if b.num_rows:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, held = b.column("y").to_numpy(zero_copy_only=False), b.column("held").to_numpy(zero_copy_only=False)
            grad, loss = model.gradient(x[~held], y[~held], flat, alpha, gamma)
            total[: len(flat)] += grad
            flag, truth = model.margin(x[held], flat) > np.log(threshold / (1 - threshold)), y[held] == 1
            total[len(flat) :] += loss, (~held).sum(), (flag & truth).sum(), (flag & ~truth).sum(), (~flag & truth).sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])


def train_focal(rows: DataFrame, columns: list[str], alpha: float, gamma: float = 2.0, hidden: int = 8, epochs: int = 60, rate: float = 0.05, patience: int = 20, threshold: float = 0.5, seed: int = 0, run: str = "run") -> tuple[DataFrame, DataFrame]:
    """Scores (design_id, gid, y, p) of the held-out rows by the best epoch's weights, and the log: run, epoch, loss, f1.

    ``rows``: design_id, gid, y, held and the columns. Each epoch is one pass: tasks sum the gradient over their rows, Spark
    adds the sums up by weight, and the driver, which holds a model's size, takes a step of Adam. The best epoch has the
    highest F1 on the held-out designs, ties by lower loss; training ends after ``patience`` epochs without a better one.
    """
    spark = rows.sparkSession
    table = staged(standardised(rows, columns)[0])
    model = Classifier(len(columns), hidden, seed)
    flat, mean, square = model.flat, np.zeros(len(model.flat)), np.zeros(len(model.flat))
    log, best, stale = [], (-1.0, np.inf, flat), 0
    for epoch in range(1, epochs + 1):
        now = flat
        sums = table.select("x", "y", "held").mapInArrow(_stepping(model, now, alpha, gamma, threshold), "k long, v double")
        total = np.zeros(len(flat) + 5)
        for r in sums.groupBy("k").agg(F.sum("v").alias("v")).collect():
            total[r.k] = r.v
        loss, n, hits, alarms, misses = total[len(flat) :]
        n = max(n, 1)
        f1 = 1.0 if hits + alarms + misses == 0 else 2 * hits / (2 * hits + alarms + misses)
        log.append((run, epoch, float(loss / n), float(f1)))
        better = f1 > best[0] or (f1 == best[0] and loss / n < best[1])
        stale = 0 if better else stale + 1
        if better:
            best = (f1, loss / n, now)
        if stale >= patience:
            break
        grad = total[: len(flat)] / n
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        flat = flat - rate * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
    weights = best[2]
    scored = table.filter("held")
    p = _vectors(scored, [*KEY, "y"], ["x"], lambda x: 1 / (1 + np.exp(-model.margin(x, weights)))[:, None], "v")
    return p.select(*KEY, "y", F.col("v")[0].alias("p")), spark.createDataFrame(log, "run string, epoch long, loss double, f1 double")


def _stepping(model: Classifier, flat: np.ndarray, alpha: float, gamma: float, threshold: float):
    return lambda batches: _step(batches, model, flat, alpha, gamma, threshold)


def fold_of(design: str = "design_id", folds: int = 3, seed: int = 0):
    """Which fold a design is in; all its gates are in it."""
    return F.pmod(F.xxhash64(F.lit(seed), design), F.lit(folds)).cast("int")


def out_of_fold_scores(rows: DataFrame, columns: list[str], alpha: float, folds: int = 3, seed: int = 0, **training) -> tuple[DataFrame, DataFrame]:
    """Every gate's score by a model that saw no gate of its design (design_id, gid, y, fold, p; staged), and the logs of all folds."""
    dealt = staged(rows.withColumn("fold", fold_of(folds=folds, seed=seed)))
    scores = logs = None
    for k in range(folds):
        s, log = train_focal(dealt.withColumn("held", F.col("fold") == k), columns, alpha, run=f"fold{k}", **training)
        s = s.withColumn("fold", F.lit(k))
        scores, logs = (s, log) if scores is None else (scores.union(s), logs.union(log))
    return staged(scores.select(*KEY, "y", "fold", "p")), logs


def chosen_by_fold(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """fold, threshold, tp, fp, fn, f1: each fold's metrics at the threshold that has the highest F1 on the other folds' designs (ties: the higher one).

    ``scores``: design_id, gid, y, fold, p. A fold's counts at every threshold are made once; the others' are all but its own.
    """
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    flag = F.col("p") > F.col("threshold")
    own = scores.select("fold", "y", "p", grid).groupBy("fold", "threshold").agg(
        F.count_if(flag & (F.col("y") == 1)).alias("tp"), F.count_if(flag & (F.col("y") == 0)).alias("fp"), F.count_if(~flag & (F.col("y") == 1)).alias("fn")
    )
    total = own.groupBy("threshold").agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")])
    f1 = lambda tp, fp, fn: F.when(tp + fp + fn == 0, 1.0).otherwise(2 * tp / (2 * tp + fp + fn))
    rest = [F.col(f"all_{c}") - F.col(c) for c in ("tp", "fp", "fn")]
    ranked = own.join(total, "threshold").withColumns({"others": f1(*rest), "f1": f1(F.col("tp"), F.col("fp"), F.col("fn"))})
    return ranked.groupBy("fold").agg(F.max_by(F.struct("threshold", "tp", "fp", "fn", "f1"), F.struct("others", "threshold")).alias("c")).select("fold", "c.*")
