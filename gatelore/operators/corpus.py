"""Corpus manifest: provenance of file names, counts, labels, summaries, and answers by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelore.functions.columns import GATE_TYPES

#: How each flow names its netlists, and which group of each pattern is which field.
PATTERNS = [
    (r"^(top\d+)_trojan(\d+)_(\d+)_netlist$", {"base_design": 1, "trojan_type": 2, "variant": 3}),
    (r"^trojan(\d+)_(\d+)_g(_no_and)?_netlist$", {"trojan_type": 1, "variant": 2}),
    (r"^(design\d+)_([\d.]+)_(\d+)_netlist$", {"base_design": 1, "rewrite_rate": 2, "variant": 3}),
    (r"^TjFree_(.+?)(?:_([\d.]+)_(\d+))?_netlist$", {"base_design": 1, "rewrite_rate": 2, "variant": 3}),
]
FIELDS = ["base_design", "trojan_type", "variant", "rewrite_rate"]


def provenance(stems: DataFrame) -> DataFrame:
    """The fields of a file's stem by the first pattern that matches; empty where it has none."""
    columns = {}
    for field in FIELDS:
        value = F.lit("")
        for pattern, groups in reversed(PATTERNS):
            here = F.regexp_extract("stem", pattern, groups[field]) if field in groups else F.lit("")
            value = F.when(F.col("stem").rlike(pattern), here).otherwise(value)
        columns[field] = value
    return stems.withColumns(columns)


def gate_count(netlists: DataFrame) -> DataFrame:
    """design_id, gates, rewritable: lines that instantiate a primitive, and those that are no flip-flop."""
    line = rf"^\s*({'|'.join(GATE_TYPES)})\s+\w+\s*\("
    rows = netlists.select("design_id", F.explode_outer(F.split("content", "\n")).alias("line"))
    return rows.groupBy("design_id").agg(F.count_if(F.col("line").rlike(line)).alias("gates"), F.count_if(F.col("line").rlike(line) & ~F.col("line").rlike(r"^\s*dff\s")).alias("rewritable"))


def manifest(netlists: DataFrame, stems: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per netlist. ``netlists``: design_id, content, bytes; ``stems``: design_id, stem, pipeline; ``labels``: design_id, label, trojan_gates."""
    rows = provenance(stems).join(netlists.select("design_id", "bytes"), "design_id").join(gate_count(netlists), "design_id").join(labels, "design_id", "left")
    return rows.select(
        F.concat("stem", F.lit(".v")).alias("file"), "pipeline", "base_design", "trojan_type", "variant", "rewrite_rate", F.coalesce("label", F.lit("UNLABELLED")).alias("label"), "gates",
        F.coalesce("trojan_gates", F.lit(0)).cast("long").alias("trojan_gates"), F.col("bytes").cast("long").alias("bytes"),
    )


def write_manifest(rows: DataFrame, folder: str) -> None:
    rows.write.option("header", True).csv(folder)


def manifest_summary(rows: DataFrame) -> DataFrame:
    """By pipeline and over all (pipeline null): files, label states, gates, the upper median of gates, share of trojan gates in trojaned designs."""
    n = F.sort_array(F.collect_list("gates"))  # one number per netlist
    bad = F.col("label") == "TROJANED"
    return rows.rollup("pipeline").agg(
        F.count("*").alias("files"), F.count_if(bad).alias("trojaned"), F.count_if(F.col("label") == "NO_TROJAN").alias("clean"), F.count_if(F.col("label") == "UNLABELLED").alias("unlabelled"), F.sum("gates").alias("gates"),
        F.element_at(n, (F.floor(F.size(n) / 2) + 1).cast("int")).alias("median_gates"), (F.coalesce(F.sum(F.when(bad, F.col("trojan_gates"))), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum(F.when(bad, F.col("gates"))), F.lit(0)))).alias("trojan_share"),
    )


def composition(rows: DataFrame) -> DataFrame:
    """By trojan type: files, least, median and largest size, and the 10th, 50th and 90th percentile of trojan gates' share."""
    share = F.col("trojan_gates") / F.greatest(F.col("gates"), F.lit(1))
    return rows.groupBy("trojan_type").agg(
        F.count("*").alias("files"), F.min("gates").alias("least_gates"), F.percentile("gates", 0.5).alias("median_gates"), F.max("gates").alias("most_gates"),
        *[F.percentile(share, q / 100).alias(f"share_p{q}") for q in (10, 50, 90)],
    )


def solved_by_content(netlists: DataFrame, library: DataFrame) -> DataFrame:
    """design_id, known, is_trojaned: verdicts of netlists whose bytes equal a solved one's (``library``: content, is_trojaned).

    Spark picks the join by the library's size; repeats in the library agree by taking the largest verdict.
    """
    keyed = library.groupBy(F.sha2("content", 256).alias("sha")).agg(F.max("is_trojaned").alias("is_trojaned"))
    rows = netlists.select("design_id", F.sha2("content", 256).alias("sha")).join(keyed, "sha", "left")
    return rows.select("design_id", F.col("is_trojaned").isNotNull().alias("known"), "is_trojaned")
