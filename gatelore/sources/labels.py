"""Label files: reading, pairing with netlists, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The words of the label format.
CLEAN, TROJANED, BEGIN, END = "NO_TROJAN", "TROJANED", "TROJAN_GATES", "END_TROJAN_GATES"


def _parsed(files: DataFrame) -> DataFrame:
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\r", ""))), lambda x: x != "")
    rows = files.withColumn("_lines", F.coalesce(lines, F.array().cast("array<string>")))
    rows = rows.withColumns({"_first": F.try_element_at("_lines", F.lit(1)), "_b": F.array_position("_lines", BEGIN), "_e": F.array_position("_lines", END)})
    named = F.when((F.col("_b") > 0) & (F.col("_e") > F.col("_b")), F.slice("_lines", F.col("_b").cast("int") + 1, (F.col("_e") - F.col("_b")).cast("int") - 1)).otherwise(F.array().cast("array<string>"))
    bad = F.coalesce(F.col("_first") == TROJANED, F.lit(False))
    return rows.withColumns({"is_trojaned": bad, "names": F.when(bad, named).otherwise(F.array().cast("array<string>"))}).drop("_lines", "_first", "_b", "_e")


def design_labels(files: DataFrame) -> DataFrame:
    """design_id, is_trojaned: missing or malformed text is clean."""
    return _parsed(files).select("design_id", "is_trojaned")


def gate_labels(files: DataFrame) -> DataFrame:
    """design_id, gate_name: the distinct names of each label."""
    return _parsed(files).select("design_id", F.explode("names").alias("gate_name")).distinct()


def label_summary(files: DataFrame) -> DataFrame:
    """design_id, label, trojan_gates: the raw number of lines between the markers, repeats counted."""
    return _parsed(files).select("design_id", F.when(F.col("is_trojaned"), TROJANED).otherwise(CLEAN).alias("label"), F.size("names").cast("long").alias("trojan_gates"))


def label_text(names: DataFrame, designs: DataFrame) -> DataFrame:
    """design_id, body: each design's label file, names sorted (``names``: design_id, gate_name)."""
    listed = names.groupBy("design_id").agg(F.array_join(F.array_sort(F.collect_list("gate_name")), "\n").alias("listed"))
    text = F.when(F.col("listed").isNull(), f"{CLEAN}\n").otherwise(F.concat(F.lit(f"{TROJANED}\n{BEGIN}\n"), "listed", F.lit(f"\n{END}\n")))
    return designs.select("design_id").distinct().join(listed, "design_id", "left").select("design_id", text.alias("body"))


def write_labels(bodies: DataFrame, stems: DataFrame, folder: str) -> None:
    """One text file folder per design, named by :func:`output_name` (``stems``: design_id, stem)."""
    bodies.join(stems, "design_id").select(output_name(F.col("stem")).alias("output_name"), F.rtrim("body", F.lit("\n")).alias("value")).write.partitionBy("output_name").text(folder)


def output_name(stem):
    """The file name of a stem's result."""
    return (
        F.when(stem.rlike(r"^design\d+$"), F.concat(F.lit("result"), F.regexp_extract(stem, r"^design(\d+)$", 1), F.lit(".txt")))
        .when(stem.endswith("_netlist"), F.concat(F.regexp_replace(stem, "_netlist$", ""), F.lit("_results.txt")))
        .otherwise(F.concat(stem, F.lit(".txt")))
    )


def match_labels(stems: DataFrame, files: DataFrame) -> DataFrame:
    """stem, file_name: the label file of each netlist; of three naming conventions the most specific that exists."""
    s = F.col("stem")
    by_convention = F.when(s.rlike(r"^design\d+$") | s.endswith("_netlist"), output_name(s))
    tries = stems.select("stem", F.posexplode(F.array(F.concat(s, F.lit(".txt")), by_convention)).alias("priority", "file_name")).filter("file_name IS NOT NULL")
    found = tries.join(files.select("file_name").distinct(), "file_name")
    best = F.row_number().over(Window.partitionBy("stem").orderBy("priority"))
    return found.withColumn("rank", best).filter("rank = 1").select("stem", "file_name")
