"""A deterministic circuit view over the tables orders and lineitem, for queries and benchmarks.

orders are gates of 50 designs, lineitem rows are their input pins; see SURVEY 7.2.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelore.functions.columns import GATE_TYPES
from gatelore.sources.staging import staged

DESIGNS = 50


@dataclass
class Circuit:
    """gates(design_id, gid, gate_name, gtype, out_net, is_po, n_gates, y, p), pins(design_id, gid, pin, pin_pos, net, driver), ports(design_id, direction, net)."""

    gates: DataFrame
    pins: DataFrame
    ports: DataFrame


def circuit(spark: SparkSession, sf_dir: str) -> Circuit:
    gates = gates_of(spark, sf_dir)
    pins = pins_of(spark, sf_dir, gates)
    return Circuit(gates.drop("o_orderkey"), pins, ports_of(gates, pins))


def kept_circuit(spark: SparkSession, sf_dir: str) -> Circuit:
    """The view with its tables written once, for what reads them several times."""
    gates = staged(gates_of(spark, sf_dir))
    pins = staged(pins_of(spark, sf_dir, gates))
    return Circuit(gates, pins, staged(ports_of(gates, pins)))


def gates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % DESIGNS).alias("design_id"))
    design = Window.partitionBy("design_id")
    types = F.array(*map(F.lit, GATE_TYPES))
    g = orders.select(
        "o_orderkey",
        "design_id",
        (F.row_number().over(design.orderBy("o_orderkey")) - 1).cast("long").alias("gid"),
        types[(F.col("o_orderkey") % 9).cast("int")].alias("gtype"),
        F.count("*").over(design).alias("n_gates"),
    )
    y = F.when((F.col("design_id") % 3 != 0) & F.expr("exists(sequence(0, 4), j -> shiftright(gid + 1, j) = 2 + design_id % 3)"), 1).otherwise(0)
    return g.withColumn("y", y).select(
        "o_orderkey",
        "design_id",
        "gid",
        F.concat(F.lit("g"), F.col("gid")).alias("gate_name"),
        "gtype",
        F.concat(F.lit("n"), F.col("gid")).alias("out_net"),
        (F.col("o_orderkey") % 17 == 0).alias("is_po"),
        "n_gates",
        "y",
        F.round((F.col("o_orderkey") * 7919 % 1000) / 1000.0 * 0.6 + 0.4 * F.col("y"), 6).alias("p"),
    )


def pins_of(spark: SparkSession, sf_dir: str, gates: DataFrame) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = lines.withColumn("pin_pos", (F.row_number().over(order) - 1).cast("long")).filter("pin_pos < 2")
    wired = lines.join(gates.select("o_orderkey", "design_id", "gid", "gtype", "n_gates"), lines.l_orderkey == F.col("o_orderkey"))
    wired = wired.filter("gid > 0 AND (pin_pos = 0 OR gtype NOT IN ('not', 'buf', 'dff'))")
    driver = F.expr("CASE WHEN l_suppkey % 10 >= 8 THEN NULL WHEN gtype = 'dff' AND l_partkey % 2 = 0 THEN l_partkey % n_gates WHEN pin_pos = 0 THEN (gid - 1) div 2 ELSE l_partkey % gid END")
    return wired.withColumn("driver", driver).select(
        "design_id",
        "gid",
        "gtype",
        F.expr("CASE WHEN gtype <> 'dff' THEN concat('I', pin_pos) WHEN l_partkey % 4 = 0 THEN 'CK' WHEN l_partkey % 4 = 1 THEN 'RN' ELSE 'D' END").alias("pin"),
        "pin_pos",
        F.expr("CASE WHEN driver IS NOT NULL THEN concat('n', driver) WHEN l_suppkey % 10 = 8 THEN concat('i', l_partkey % 16) ELSE concat(\"1'b\", l_partkey % 2) END").alias("net"),
        "driver",
    )


def ports_of(gates: DataFrame, pins: DataFrame) -> DataFrame:
    """design_id, direction, net: input nets that pins read, and the output nets of marked gates."""
    return (
        pins.filter(F.col("driver").isNull() & F.col("net").startswith("i")).select("design_id", F.lit("in").alias("direction"), "net").distinct()
        .unionByName(gates.filter("is_po").select("design_id", F.lit("out").alias("direction"), F.col("out_net").alias("net")))
    )


#: The same view for DuckDB: the beginning of every comparison query.
CIRCUIT_SQL = """WITH RECURSIVE g0 AS (
  SELECT o_orderkey, o_custkey % 50 AS design_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS gid,
         list_extract(['and','or','nand','nor','not','buf','xor','xnor','dff'], (o_orderkey % 9 + 1)::INT) AS gtype,
         count(*) OVER (PARTITION BY o_custkey % 50) AS n_gates FROM orders),
g1 AS (SELECT *, CASE WHEN design_id % 3 <> 0 AND (gid + 1 = 2 + design_id % 3 OR (gid + 1) // 2 = 2 + design_id % 3 OR (gid + 1) // 4 = 2 + design_id % 3
         OR (gid + 1) // 8 = 2 + design_id % 3 OR (gid + 1) // 16 = 2 + design_id % 3) THEN 1 ELSE 0 END AS y FROM g0),
gates AS MATERIALIZED (SELECT design_id, gid, 'g' || gid AS gate_name, gtype, 'n' || gid AS out_net, o_orderkey % 17 = 0 AS is_po, n_gates, y, o_orderkey,
         round((o_orderkey * 7919 % 1000) / 1000.0 * 0.6 + 0.4 * y, 6) AS p FROM g1),
l0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pin_pos FROM lineitem),
p0 AS (SELECT g.design_id, g.gid, g.gtype, l.pin_pos, l.l_partkey, l.l_suppkey,
         CASE WHEN l_suppkey % 10 >= 8 THEN NULL WHEN gtype = 'dff' AND l_partkey % 2 = 0 THEN l_partkey % n_gates
              WHEN pin_pos = 0 THEN (gid - 1) // 2 ELSE l_partkey % gid END AS driver
       FROM l0 l JOIN gates g ON l.l_orderkey = g.o_orderkey WHERE pin_pos < 2 AND gid > 0 AND (pin_pos = 0 OR gtype NOT IN ('not','buf','dff'))),
pins AS MATERIALIZED (SELECT design_id, gid, gtype, CASE WHEN gtype <> 'dff' THEN 'I' || pin_pos WHEN l_partkey % 4 = 0 THEN 'CK' WHEN l_partkey % 4 = 1 THEN 'RN' ELSE 'D' END AS pin,
         pin_pos, CASE WHEN driver IS NOT NULL THEN 'n' || driver WHEN l_suppkey % 10 = 8 THEN 'i' || (l_partkey % 16) ELSE '1''b' || (l_partkey % 2) END AS net, driver FROM p0),
ports AS (SELECT DISTINCT design_id, 'in' AS direction, net FROM pins WHERE driver IS NULL AND net LIKE 'i%'
          UNION ALL SELECT design_id, 'out', out_net FROM gates WHERE is_po),
edges AS MATERIALIZED (SELECT design_id, driver AS src, gid AS dst, net, pin_pos FROM pins WHERE driver IS NOT NULL),
comb AS MATERIALIZED (SELECT e.design_id, e.src, e.dst FROM edges e JOIN gates a ON a.design_id = e.design_id AND a.gid = e.src AND a.gtype <> 'dff'
          JOIN gates b ON b.design_id = e.design_id AND b.gid = e.dst AND b.gtype <> 'dff')
"""
