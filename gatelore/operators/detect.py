"""Detection over a folder of netlists as one resumable job: parse, look up, simulate, score, filter, commit.

Designs go in waves. A wave's results are committed in two steps: flagged gates, one partition for each design, written
with dynamic overwrite, so that doing a wave again replaces what a killed run has left of it; then the ledger, one file for
a wave, with a line for each design. A run leaves out what the ledger has for the same content, so after a kill it goes on
with the first wave that isn't in the ledger; a design whose text has changed is done again. Readers take the ledger's last
line of a design and the gates that were written with it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelore.functions.columns import FEATURES, MASKED, TALLY_COLUMNS
from gatelore.operators import edges as E
from gatelore.operators import features as X
from gatelore.operators import score as S
from gatelore.operators.simulate import random_simulation
from gatelore.sources import netlists as N
from gatelore.sources.labels import label_text
from gatelore.sources.staging import folder_of, staged

#: Where a verdict came from.
MODEL, LOOKUP, REJECTED = "model", "lookup", "rejected"


def _ledger_columns(design: str) -> str:
    return f"design_id {design}, digest string, source string, gates long, flagged long, trojaned boolean, reason string, done_at double"


def _exists(spark: SparkSession, path: str) -> bool:
    p, files = folder_of(spark, path)
    return files.exists(p)


def ledger(spark: SparkSession, folder: str, design: str = "string") -> DataFrame:
    """Every line of the ledger; none where nothing is committed yet."""
    names = _ledger_columns(design)
    return spark.read.schema(names).parquet(f"{folder}/ledger") if _exists(spark, f"{folder}/ledger") else spark.createDataFrame([], names)


def verdicts(spark: SparkSession, folder: str, design: str = "string") -> DataFrame:
    """The last line of each design: design_id, digest, source, gates, flagged, trojaned, reason."""
    last = F.row_number().over(Window.partitionBy("design_id").orderBy(F.desc("done_at")))
    return ledger(spark, folder, design).withColumn("_last", last).filter("_last = 1").drop("_last", "done_at")


def flagged_gates(spark: SparkSession, folder: str, design: str = "string") -> DataFrame:
    """design_id, gate_name: what the last verdict of each design flagged."""
    names = f"digest string, gate_name string, design_id {design}"
    rows = spark.read.schema(names).parquet(f"{folder}/gates") if _exists(spark, f"{folder}/gates") else spark.createDataFrame([], names)
    return rows.join(verdicts(spark, folder, design).filter("flagged > 0").select("design_id", "digest"), ["design_id", "digest"], "left_semi").select("design_id", "gate_name")


def result_bodies(spark: SparkSession, folder: str, design: str = "string") -> DataFrame:
    """design_id, body: the result file of every design that was not rejected."""
    return label_text(flagged_gates(spark, folder, design), verdicts(spark, folder, design).filter(F.col("source") != REJECTED))


def scored_wave(netlists: DataFrame, score: Callable[[DataFrame], DataFrame], library: DataFrame | None, threshold: float, cycles: int, reads: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Flagged gates (design_id, digest, gate_name) and verdicts of some netlists (design_id, content, digest).

    ``library`` has digest, is_trojaned and gate_names of solved netlists: a netlist of the same bytes takes their answer and
    isn't scored. ``score`` turns masked features (design_id, gid, 48 columns) into design_id, gid, p; ``reads`` names the
    columns that it reads, if not all: the others are 0 then, and what only they need (the simulation, too) is left out.
    """
    parsed = staged(N.parse_gates(netlists))
    counts = staged(netlists.select("design_id", "digest").join(parsed.groupBy("design_id").agg(F.count("*").alias("gates")), "design_id", "left").na.fill(0, ["gates"]))
    answers = library.groupBy("digest").agg(F.max(F.struct("is_trojaned", "gate_names")).alias("known")) if library is not None else None
    known = staged(counts.join(answers, "digest")) if answers is not None else counts.filter("false").withColumn("known", F.expr("named_struct('is_trojaned', false, 'gate_names', array(''))"))
    open_ = counts.filter("gates > 0").join(known.select("design_id"), "design_id", "left_anti").select("design_id")
    todo = staged(parsed.join(open_, "design_id", "left_semi"))
    pins = N.parse_pins(todo)
    outs = pins.filter("direction = 'out'").select("design_id", "gid", F.col("net").alias("out_net"))
    gates = staged(todo.select("design_id", "gid", "gate_name", "gtype").join(outs, ["design_id", "gid"], "left"))
    ins = staged(pins.filter("direction = 'in'").select("design_id", "gid", "gtype", "pin", "pin_pos", "net"))
    ports = staged(N.parse_ports(netlists.join(open_, "design_id", "left_semi")))
    edges = staged(E.build_edges(gates, ins))
    on = [c for c in (FEATURES if reads is None else reads) if c not in MASKED]
    tallies = random_simulation(gates, ins, edges, cycles) if set(on) & set(TALLY_COLUMNS) else None
    features = X.masked(X.raw_features(gates, ins, ports, tallies, on), on=on)
    flags = staged(S.filtered_flags(staged(score(features)), edges, threshold))
    by_model = flags.filter("flag = 1").join(gates.select("design_id", "gid", "gate_name"), ["design_id", "gid"]).join(counts.select("design_id", "digest"), "design_id").select("design_id", "digest", "gate_name")
    by_library = known.filter("known.is_trojaned").select("design_id", "digest", F.explode("known.gate_names").alias("gate_name"))
    found = staged(by_model.union(by_library).distinct())
    rows = counts.join(known.select("design_id", "known"), "design_id", "left").join(found.groupBy("design_id").agg(F.count("*").alias("flagged")), "design_id", "left").na.fill(0, ["flagged"])
    source = F.when(F.col("known").isNotNull(), LOOKUP).when(F.col("gates") == 0, REJECTED).otherwise(MODEL)
    trojaned = F.when(F.col("known").isNotNull(), F.col("known.is_trojaned")).when(F.col("gates") > 0, F.col("flagged") > 0)
    return found, rows.select("design_id", "digest", source.alias("source"), "gates", "flagged", trojaned.alias("trojaned"), F.when(source == REJECTED, "no gates").alias("reason"))


def detect(
    netlists: DataFrame, folder: str, score: Callable[[DataFrame], DataFrame], library: DataFrame | None = None, threshold: float = 0.5, cycles: int = 1000, designs_per_wave: int = 1000, overwrite: bool = False,
    reads: list[str] | None = None,
) -> DataFrame:
    """Give every netlist (design_id, content) a verdict and commit it to ``folder``; returns :func:`verdicts`.

    Netlists without gates are committed as rejected, with the reason; the others of their wave go on. What the ledger has
    for the same content is left out, unless ``overwrite``. A wave has about ``designs_per_wave`` designs. ``reads``: the
    columns that ``score`` reads, if not all 48.
    """
    spark, design = netlists.sparkSession, netlists.schema["design_id"].dataType.simpleString()
    given = netlists.select("design_id", F.sha2("content", 256).alias("digest"))
    pending = staged(given if overwrite else given.join(ledger(spark, folder, design).select("design_id", "digest"), ["design_id", "digest"], "left_anti"))
    waves = -(-pending.count() // designs_per_wave)
    if waves:
        pending = pending.withColumn("wave", F.pmod(F.xxhash64("design_id"), F.lit(waves)))
    for wave in range(waves):
        now = pending.filter(F.col("wave") == wave).select("design_id", "digest")
        texts = staged(netlists.select("design_id", "content").join(now, "design_id"))
        found, lines = scored_wave(texts, score, library, threshold, cycles, reads)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("design_id").parquet(f"{folder}/gates")
        lines.withColumn("done_at", F.lit(time.time())).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
    return verdicts(spark, folder, design)
