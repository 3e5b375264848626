"""Edges, views of edges, and facts that gates have from the nets around them. All tables are keyed by design_id first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelore.functions.columns import GATE_TYPES, PIN_ROLES, ROLE_COLUMNS, base_net, is_port_name

KEY = ["design_id", "gid"]


def build_edges(gates: DataFrame, pins: DataFrame) -> DataFrame:
    """One edge per load pin from its net's driver; of several drivers the last gate counts. Undriven nets make no edge."""
    drivers = gates.groupBy("design_id", F.col("out_net").alias("net")).agg(F.max("gid").alias("src"))
    return pins.select("design_id", "net", F.col("gid").alias("dst"), "pin_pos").join(drivers, ["design_id", "net"]).select("design_id", "src", "dst", "net", "pin_pos")


def _end(gates: DataFrame, end: str, *columns: str) -> DataFrame:
    return gates.select("design_id", F.col("gid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])


def typed_edges(edges: DataFrame, gates: DataFrame) -> DataFrame:
    """Edges with the gate types of both ends."""
    return edges.join(_end(gates, "src", "gtype"), ["design_id", "src"]).join(_end(gates, "dst", "gtype"), ["design_id", "dst"])


def combinational(edges: DataFrame, gates: DataFrame) -> DataFrame:
    """Edges that touch no flip-flop."""
    return typed_edges(edges, gates).filter("src_gtype <> 'dff' AND dst_gtype <> 'dff'").select("design_id", "src", "dst")


def degrees(gates: DataFrame, edges: DataFrame) -> DataFrame:
    """design_id, gid, indegree, outdegree of every gate, counting parallel edges."""
    ends = edges.select("design_id", F.col("dst").alias("gid"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("design_id", "src", F.lit(0), F.lit(1)))
    sums = ends.groupBy(KEY).agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))
    return gates.select(KEY).join(sums, KEY, "left").na.fill(0, ["indegree", "outdegree"])


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """design_id, low, high: each connected pair once; a gate that feeds itself is a pair of its own."""
    return edges.select("design_id", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).distinct()


def two_hop_counts(gates: DataFrame, edges: DataFrame) -> DataFrame:
    """fanin_2level, fanout_2level, fanout_dff_count: distinct gates within two hops, which may include the gate itself."""
    e = edges.select("design_id", "src", "dst").distinct()
    two = e.join(e.select("design_id", F.col("src").alias("dst"), F.col("dst").alias("end")), ["design_id", "dst"]).select("design_id", "src", F.col("end").alias("dst"))
    reach = e.union(two).distinct()
    ins = reach.groupBy("design_id", F.col("dst").alias("gid")).agg(F.count("*").alias("fanin_2level"))
    outs = reach.join(_end(gates, "dst", "gtype"), ["design_id", "dst"]).groupBy("design_id", F.col("src").alias("gid"))
    outs = outs.agg(F.count("*").alias("fanout_2level"), F.count_if(F.col("dst_gtype") == "dff").alias("fanout_dff_count"))
    return gates.select(KEY).join(ins, KEY, "left").join(outs, KEY, "left").na.fill(0)


def io_flags(gates: DataFrame, pins: DataFrame, ports: DataFrame) -> DataFrame:
    """is_PI: reads an input port; is_PO: drives an output port. Bit-selects match their port, bus bounds are no ports."""
    named = ports.filter(is_port_name(F.col("net"))).select("design_id", "direction", F.col("net").alias("base"))
    reads = pins.select(*KEY, base_net(F.col("net")).alias("base")).join(named.filter("direction = 'in'"), ["design_id", "base"], "left_semi").select(*KEY, F.lit(1).alias("is_PI")).distinct()
    drivers = gates.groupBy("design_id", "out_net").agg(F.max("gid").alias("gid"))
    drives = drivers.select(*KEY, base_net(F.col("out_net")).alias("base")).join(named.filter("direction = 'out'"), ["design_id", "base"], "left_semi").select(*KEY, F.lit(1).alias("is_PO"))
    return gates.select(KEY).join(reads, KEY, "left").join(drives.distinct(), KEY, "left").na.fill(0)


def pin_roles(gates: DataFrame, pins: DataFrame) -> DataFrame:
    """Five flags: flip-flop pins (outputs too) on any net that the gate loads. Roles are made distinct by net before loads are joined."""
    named = F.create_map(*[F.lit(x) for kv in PIN_ROLES.items() for x in kv])
    on_net = (
        pins.filter("gtype = 'dff'").select("design_id", "net", "pin")
        .union(gates.filter("gtype = 'dff'").select("design_id", "out_net", F.lit("Q")))
        .select("design_id", "net", named[F.col("pin")].alias("role")).filter("role IS NOT NULL").distinct()
    )
    flags = pins.select(*KEY, "net").distinct().join(on_net, ["design_id", "net"]).groupBy(KEY).agg(*[F.max((F.col("role") == r).cast("int")).alias(r) for r in ROLE_COLUMNS])
    return gates.select(KEY).join(flags, KEY, "left").na.fill(0)


def dff_data_driver(gates: DataFrame, pins: DataFrame) -> DataFrame:
    """The gate that drives each flip-flop's D pin, -1 where there is none."""
    drivers = gates.groupBy("design_id", F.col("out_net").alias("net")).agg(F.max("gid").alias("d_driver"))
    d = pins.filter("gtype = 'dff' AND pin = 'D'").select(*KEY, "net").join(drivers, ["design_id", "net"], "left").groupBy(KEY).agg(F.max("d_driver").alias("d_driver"))
    return gates.filter("gtype = 'dff'").select(KEY).join(d, KEY, "left").na.fill(-1)


def attach_labels(gates: DataFrame, gate_labels: DataFrame) -> DataFrame:
    """y = 1 for gates that are named among the labels."""
    named = gate_labels.select("design_id", "gate_name", F.lit(1).alias("y")).distinct()
    return gates.select(*KEY, "gate_name").join(named, ["design_id", "gate_name"], "left").na.fill(0, ["y"]).select(*KEY, "y")


def seeds(gates: DataFrame, pins: DataFrame, edges: DataFrame, ports: DataFrame) -> DataFrame:
    """design_id, gid, family: where each family of distances is measured from. No flip-flop is a seed."""
    gate = gates.filter("gtype <> 'dff'").select(KEY)
    typed = typed_edges(edges, gates)
    flags = io_flags(gates, pins, ports)
    comb = degrees(gate, combinational(edges, gates))

    def family(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*KEY, F.lit(name).alias("family"))

    tied = pins.filter(F.col("net").isin("1'b0", "1'b1")).select(*KEY, F.when(F.col("net") == "1'b0", "gnd").otherwise("vdd").alias("family"))
    every = (
        family(flags.filter("is_PI = 1"), "pi")
        .union(family(flags.filter("is_PO = 1"), "po"))
        .union(family(typed.filter("src_gtype = 'dff'").withColumn("gid", F.col("dst")), "dff_succ"))
        .union(family(typed.filter("dst_gtype = 'dff'").withColumn("gid", F.col("src")), "dff_pred"))
        .union(family(comb.filter("indegree = 0"), "comb_src"))
        .union(family(comb.filter("outdegree = 0"), "comb_sink"))
        .union(tied)
    )
    return every.distinct().join(gate, KEY, "left_semi")


def type_mix(gates: DataFrame, edges: DataFrame) -> DataFrame:
    """fanin_same_type (share of drivers, parallel edges counted), in_type_cnt and out_type_cnt."""
    typed = typed_edges(edges, gates)
    ins = typed.groupBy("design_id", F.col("dst").alias("gid")).agg(F.avg((F.col("src_gtype") == F.col("dst_gtype")).cast("double")).alias("fanin_same_type"), F.count_distinct("src_gtype").alias("in_type_cnt"))
    outs = typed.groupBy("design_id", F.col("src").alias("gid")).agg(F.count_distinct("dst_gtype").alias("out_type_cnt"))
    return gates.select(KEY).join(ins, KEY, "left").join(outs, KEY, "left").na.fill(0)


def one_hot(gates: DataFrame) -> DataFrame:
    return gates.select(*KEY, *[(F.col("gtype") == t).cast("double").alias(f"is_{t}") for t in GATE_TYPES])


def sink_flags(gates: DataFrame, edges: DataFrame) -> DataFrame:
    """is_sink_gate: drives no gate."""
    sources = edges.select("design_id", F.col("src").alias("gid"), F.lit(0).alias("is_sink_gate")).distinct()
    return gates.select(KEY).join(sources, KEY, "left").na.fill(1, ["is_sink_gate"])
