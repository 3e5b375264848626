"""Reading, parsing and rendering flat netlists, with built-in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelore.functions.columns import GATE_TYPES

GATE_LINE = rf"^({'|'.join(GATE_TYPES)})\s+\w+\s*\("
#: Pins of a flip-flop in their written order, and which of them is the output.
DFF_PINS, DFF_OUTPUT = ["RN", "SN", "CK", "D", "Q"], "Q"


def read_netlists(spark: SparkSession, folder: str) -> DataFrame:
    """design_id (file stem), path, content, bytes of every .v file below ``folder``, sorted work left to the reader."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.v", recursiveFileLookup=True)
    return files.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.v$", "").alias("design_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("bytes")
    )


def _lines(netlists: DataFrame) -> DataFrame:
    """design_id, line_no, line: comments removed, trimmed, empty lines dropped."""
    clean = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    return netlists.select("design_id", F.posexplode(F.split(clean, "\n")).alias("line_no", "line")).select("design_id", "line_no", F.trim(F.regexp_replace("line", r"[\r\t]", " ")).alias("line")).filter("line <> ''")


def parse_gates(netlists: DataFrame) -> DataFrame:
    """design_id, gid (order of appearance), gate_name, gtype, args."""
    rows = _lines(netlists).filter(F.col("line").rlike(GATE_LINE))
    number = (F.row_number().over(Window.partitionBy("design_id").orderBy("line_no")) - 1).cast("long")
    head = r"^(\w+)\s+(\w+)\s*\((.*)\)\s*;"
    return rows.select("design_id", number.alias("gid"), F.regexp_extract("line", head, 2).alias("gate_name"), F.regexp_extract("line", head, 1).alias("gtype"), F.regexp_extract("line", head, 3).alias("args"))


def parse_pins(parsed: DataFrame) -> DataFrame:
    """design_id, gid, gtype, pin, pin_pos, direction, net: positional gates write their output first, flip-flops name their pins."""
    named = F.expr(r"transform(regexp_extract_all(args, '[.](\\w+)\\s*\\(\\s*([^)]*?)\\s*\\)', 1), (p, i) -> named_struct('pin', p, 'net', regexp_extract_all(args, '[.](\\w+)\\s*\\(\\s*([^)]*?)\\s*\\)', 2)[i]))")
    placed = F.expr("transform(filter(transform(split(args, ','), t -> trim(t)), t -> t <> ''), (t, i) -> named_struct('pin', CASE WHEN i = 0 THEN 'Y' ELSE concat('I', i - 1) END, 'net', t))")
    rows = parsed.select("design_id", "gid", "gtype", F.posexplode(F.when(F.col("gtype") == "dff", named).otherwise(placed)).alias("at", "p"))
    out = F.col("p.pin") == F.when(F.col("gtype") == "dff", DFF_OUTPUT).otherwise("Y")
    place = F.row_number().over(Window.partitionBy("design_id", "gid", out).orderBy("at")) - 1
    return rows.select("design_id", "gid", "gtype", F.col("p.pin").alias("pin"), place.cast("long").alias("pin_pos"), F.when(out, "out").otherwise("in").alias("direction"), F.col("p.net").alias("net"))


def parse_ports(netlists: DataFrame) -> DataFrame:
    """design_id, direction, net of the declared inputs and outputs; the digits of bus bounds are left out."""
    rows = _lines(netlists).filter(F.col("line").rlike(r"^(input|output)\b"))
    names = F.regexp_extract_all(F.regexp_replace("line", r"^(input|output)\b", ""), F.lit(r"(\w+)"), 1)
    return rows.select("design_id", F.when(F.col("line").startswith("input"), "in").otherwise("out").alias("direction"), F.explode(names).alias("net")).filter(~F.col("net").rlike(r"^\d+$"))


def _joined(order: str, value: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("v")))), lambda x: x["v"]), sep)


def gate_lines(gates: DataFrame, pins: DataFrame) -> DataFrame:
    """design_id, gid, line: each gate as netlist text, in the grammar that :func:`parse_gates` reads."""
    ins = pins.groupBy("design_id", "gid").agg(
        _joined("pin_pos", F.col("net"), ", ").alias("placed"), _joined("pin_pos", F.format_string(".%s(%s)", "pin", "net"), ", ").alias("named")
    )
    rows = gates.select("design_id", "gid", "gate_name", "gtype", "out_net").join(ins, ["design_id", "gid"], "left")
    placed = F.concat_ws(", ", "out_net", "placed")
    named = F.concat_ws(", ", "named", F.format_string(".Q(%s)", "out_net"))
    return rows.select("design_id", "gid", F.format_string("%s %s(%s);", "gtype", "gate_name", F.when(F.col("gtype") == "dff", named).otherwise(placed)).alias("line"))


def render(gates: DataFrame, pins: DataFrame, ports: DataFrame) -> DataFrame:
    """design_id, content: the whole module as text: header, ports, wires, gates. A design's text is one value, as its file is."""
    heads = ports.groupBy("design_id").agg(
        F.array_join(F.array_sort(F.collect_set("net")), ", ").alias("all_ports"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("direction") == "in", F.col("net")))), ", ").alias("ins"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("direction") == "out", F.col("net")))), ", ").alias("outs"),
    )
    inner = gates.select("design_id", "gid", F.col("out_net").alias("net")).join(ports.select("design_id", "net"), ["design_id", "net"], "left_anti")
    wires = inner.groupBy("design_id").agg(_joined("gid", F.col("net"), ", ").alias("wires"))
    body = gate_lines(gates, pins).groupBy("design_id").agg(_joined("gid", F.col("line"), "\n").alias("body"))
    rows = body.join(heads, "design_id", "left").join(wires, "design_id", "left").na.fill("")
    declared = lambda word, c: F.when(F.col(c) != "", F.concat(F.lit(f"{word} "), F.col(c), F.lit(";\n"))).otherwise("")
    return rows.select("design_id", F.concat(F.lit("module top("), "all_ports", F.lit(");\n"), declared("input", "ins"), declared("output", "outs"), declared("wire", "wires"), "body", F.lit("\nendmodule\n")).alias("content"))


def rejects(netlists: DataFrame, parsed: DataFrame) -> DataFrame:
    """design_id, reason: netlists that gave no gate."""
    return netlists.select("design_id").join(parsed.select("design_id").distinct(), "design_id", "left_anti").withColumn("reason", F.lit("no gates"))


def not_yet_written(stems: DataFrame, written: DataFrame, suffix: str = "", overwrite: bool = False) -> DataFrame:
    """stem, output: what an incremental run still has to do. Output names lose ``_flat`` and gain the flow's suffix."""
    out = stems.select("stem", F.concat(F.regexp_replace("stem", "_flat$", ""), F.lit(suffix)).alias("output"))
    return out if overwrite else out.join(written.select("output"), "output", "left_anti").select("stem", "output")


def audit_gates(gates: DataFrame, truth: DataFrame, raw: DataFrame, norm: DataFrame, kept: list[str]) -> DataFrame:
    """Per gate: name, label, raw columns and the enabled scaled ones."""
    key = ["design_id", "gid"]
    names = [c for c in raw.columns if c not in key]
    left = raw.select(*key, *[F.col(c).alias(f"raw__{c}") for c in names])
    right = norm.select(*key, *[F.col(c).alias(f"norm__{c}") for c in names if c in kept])
    return gates.select(*key, "gate_name").join(truth.select(*key, "y"), key).join(left, key).join(right, key)


def audit_edges(gates: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the names of both gates."""
    a = gates.select("design_id", F.col("gid").alias("src"), F.col("gate_name").alias("src_name"))
    b = gates.select("design_id", F.col("gid").alias("dst"), F.col("gate_name").alias("dst_name"))
    return edges.select("design_id", "src", "dst", "net").join(a, ["design_id", "src"]).join(b, ["design_id", "dst"])


def audit_ports(ports: DataFrame) -> DataFrame:
    """design_id, inputs, outputs: each design's ports by name, one to a line."""
    names = lambda d: F.array_join(F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.col("net")))), "\n")
    return ports.groupBy("design_id").agg(names("in").alias("inputs"), names("out").alias("outputs"))


def fold_instances(lines: DataFrame) -> DataFrame:
    """design_id, number, text: instances that span several lines as one record each, numbered. A line that ends with ';' closes its record."""
    before = Window.partitionBy("design_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    record = F.coalesce(F.sum(F.rtrim("line").endswith(";").cast("int")).over(before), F.lit(0))
    rows = lines.select("design_id", "line_no", F.trim("line").alias("line"), record.alias("number"))
    return rows.groupBy("design_id", "number").agg(_joined("line_no", F.col("line"), " ").alias("text"))


def canonical_instances(records: DataFrame) -> DataFrame:
    """design_id, number, text: escaped names flattened, named pins written output first (flip-flop pins in fixed order), assigns dropped.

    Outputs are pins Y, Z, ZN, O, OUT or Q; the other pins of a gate follow in the order of their names.
    """
    flat = F.regexp_replace(F.regexp_replace("text", r"\\(\S+)", "$1"), r"(?<=\w)[/.](?=\w)", "_")
    rows = records.filter(~F.trim("text").startswith("assign")).select("design_id", "number", flat.alias("t"))
    head = r"^\s*(\w+)\s+(\S+?)\s*\("
    rows = rows.filter(F.col("t").rlike(rf"^\s*({'|'.join(GATE_TYPES)})\s+\S+\s*\("))
    rows = rows.withColumns({"gtype": F.regexp_extract("t", head, 1), "name": F.regexp_extract("t", head, 2), "pins": F.regexp_extract_all("t", F.lit(r"\.(\w+)\s*\(\s*([^)]*?)\s*\)"), 1), "nets": F.regexp_extract_all("t", F.lit(r"\.(\w+)\s*\(\s*([^)]*?)\s*\)"), 2)})
    rows = rows.withColumn("m", F.expr("arrays_zip(pins, nets)"))
    order = "array(" + ",".join(f"'{p}'" for p in DFF_PINS) + ")"
    dff = F.expr(f"array_join(transform(filter(transform({order}, o -> get(filter(m, x -> x.pins = o), 0)), x -> x IS NOT NULL), x -> concat('.', x.pins, '(', x.nets, ')')), ', ')")
    outs = "array('Y','Z','ZN','O','OUT','Q')"
    gate = F.expr(f"array_join(concat(transform(filter(m, x -> array_contains({outs}, x.pins)), x -> x.nets), transform(array_sort(filter(m, x -> NOT array_contains({outs}, x.pins))), x -> x.nets)), ', ')")
    body = F.when(F.size("pins") == 0, F.trim(F.regexp_extract("t", r"\((.*)\)\s*;", 1))).when(F.col("gtype") == "dff", dff).otherwise(gate)
    return rows.select("design_id", "number", F.format_string("%s %s(%s);", "gtype", "name", body).alias("text"))


def rename_nets(pins: DataFrame, ports: DataFrame) -> DataFrame:
    """design_id, net, new_net: ports first in declared order, then inner nets by first appearance. Constants keep their names.

    ``pins``: design_id, gid, at (place in the instance), net; ``ports``: design_id, place, net.
    """
    inner = pins.filter(~F.col("net").startswith("1'b")).groupBy("design_id", "net").agg(F.min(F.struct("gid", "at")).alias("first"))
    rows = inner.join(ports.select("design_id", "net"), ["design_id", "net"], "left_anti").select("design_id", "net", F.lit(1).alias("kind"), "first.gid", F.col("first.at").cast("long").alias("at"))
    rows = rows.union(ports.select("design_id", "net", F.lit(0), F.col("place").cast("long"), F.lit(0).cast("long")))
    place = F.row_number().over(Window.partitionBy("design_id").orderBy("kind", "gid", "at", "net")) - 1
    return rows.select("design_id", "net", F.concat(F.lit("n"), place).alias("new_net"))


def touches_marker(instances: DataFrame, marker: str) -> DataFrame:
    """design_id, gate_name, y: gates whose name or any net holds the marker; every gate of designs whose name begins with it.

    ``instances``: design_id, gate_name, nets (array).
    """
    hit = F.col("gate_name").contains(marker) | F.exists("nets", lambda n: n.contains(marker)) | F.col("design_id").cast("string").startswith(marker)
    return instances.select("design_id", "gate_name", hit.cast("int").alias("y"))


def unnumbered(lines: DataFrame) -> DataFrame:
    """Lines of whole texts: design_id, line_no, line."""
    return _lines(lines)
