"""Netlists as they arrive: each micro-batch of files is parsed, scored and filtered like a folder of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatelore.operators import edges as E
from gatelore.operators import score as S
from gatelore.sources import netlists as N
from gatelore.sources.staging import staged


def netlist_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """design_id, content of every .v file that appears in ``folder``, once each."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.v").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.v$", "").alias("design_id"), F.col("value").alias("content"))


def verdicts(netlists: DataFrame, score: Callable[[DataFrame], DataFrame], t: float = 0.5) -> DataFrame:
    """design_id, gates, flagged, trojaned of each netlist; ``score`` turns gates into design_id, gid, p."""
    parsed = staged(N.parse_gates(netlists))
    pins = N.parse_pins(parsed)
    gates = parsed.join(pins.filter("direction = 'out'").select("design_id", "gid", F.col("net").alias("out_net")), ["design_id", "gid"], "left")
    flags = S.filtered_flags(score(gates), staged(E.build_edges(gates, pins.filter("direction = 'in'"))), t)
    return flags.groupBy("design_id").agg(F.count("*").alias("gates"), F.sum("flag").alias("flagged")).withColumn("trojaned", F.col("flagged") > 0)


def write_verdicts(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, t: float = 0.5) -> StreamingQuery:
    """Start the stream; a batch that is run again after a failure overwrites its own part of ``out``."""

    def one(batch: DataFrame, number: int) -> None:
        verdicts(batch, score, t).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
