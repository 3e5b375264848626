"""Graph tables kept for later training and scoring: bucketed by what they are joined on, so joins need no exchange.

A store is a folder with a Parquet table for each part and a table of contents. Every part is dealt into the same number of
buckets by the gate that it describes (edges twice: by the gate they leave and by the gate they enter), and sorted by it
within a bucket, so gates, features, components and edges of a gate lie in buckets of one number, and a design with most of
the gates still is in all buckets. The contents are written last: a store without them was not finished and is not opened.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelore.functions.columns import FEATURES
from gatelore.sources.staging import folder_of

DESIGN, GATE = "design_id", "gid"
#: The parts of a store, their columns (design_id has the type of the gates written) and their bucket columns.
PARTS = {
    "gates": ({"gid": "bigint", "gate_name": "string", "gtype": "string", "y": "int"}, ["design_id", "gid"]),
    "edges_out": ({"src": "bigint", "dst": "bigint", "net": "string", "pin_pos": "bigint"}, ["design_id", "src"]),
    "edges_in": ({"src": "bigint", "dst": "bigint", "net": "string", "pin_pos": "bigint"}, ["design_id", "dst"]),
    "features": ({"gid": "bigint", **{c: "double" for c in FEATURES}}, ["design_id", "gid"]),
    "components": ({"gid": "bigint", "component_id": "bigint"}, ["design_id", "gid"]),
}
CONTENTS = "part string, columns string, bucket_columns array<string>, buckets int, rows long"


class StoreError(ValueError):
    """The folder holds no finished store, or not the tables that this library reads."""


@dataclass
class GraphStore:
    """The tables of a store. Absent parts are None."""

    folder: str
    buckets: int
    rows: dict[str, int] = field(default_factory=dict)
    gates: DataFrame | None = None
    edges_out: DataFrame | None = None
    edges_in: DataFrame | None = None
    features: DataFrame | None = None
    components: DataFrame | None = None


def _columns(part: str, design: str) -> dict[str, str]:
    return {DESIGN: design, **PARTS[part][0]}


def _exact(part: str, df: DataFrame, design: str) -> DataFrame:
    wanted = _columns(part, design)
    if missing := [c for c in wanted if c not in df.columns]:
        raise StoreError(f"{part} lacks {', '.join(missing)}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in wanted.items()])


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in columns.items())


def write_store(folder: str, gates: DataFrame, edges: DataFrame, features: DataFrame | None = None, components: DataFrame | None = None, buckets: int = 64) -> GraphStore:
    """Write a store to a new folder. Rows are dealt out by bucket first, so each bucket is one file."""
    spark, design = gates.sparkSession, gates.schema[DESIGN].dataType.simpleString()
    given = {"gates": gates, "edges_out": edges, "edges_in": edges, "features": features, "components": components}
    contents = []
    for part, df in given.items():
        if df is None:
            continue
        keys = PARTS[part][1]
        name = f"store_{uuid.uuid4().hex}"
        # a column that is left out of a part's table (y of unlabelled gates) is null there
        full = df if part != "gates" or "y" in df.columns else df.withColumn("y", F.lit(None).cast("int"))
        exact = _exact(part, full, design)
        exact.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{folder}/{part}").saveAsTable(name)
        rows = spark.table(name).count()
        spark.sql(f"DROP TABLE {name}")  # the files stay; a later session declares its own table over them
        contents.append((part, _ddl(_columns(part, design)), keys, buckets, rows))
    spark.createDataFrame(contents, CONTENTS).coalesce(1).write.mode("error").parquet(f"{folder}/contents")
    return open_store(spark, folder)


def open_store(spark: SparkSession, folder: str, check_rows: bool = False) -> GraphStore:
    """The tables of a store with their buckets declared to Spark. Fails if the store isn't finished, or a part's columns, buckets or (if asked) rows differ."""
    path, files = folder_of(spark, f"{folder}/contents/_SUCCESS")
    if not files.exists(path):
        raise StoreError(f"{folder} holds no finished store")
    listed = {r.part: r for r in spark.read.schema(CONTENTS).parquet(f"{folder}/contents").collect()}
    if "gates" not in listed:
        raise StoreError(f"{folder} has no gates")
    store = GraphStore(folder, listed["gates"].buckets, {p: r.rows for p, r in listed.items()})
    design = listed["gates"].columns.split(",")[0].split()[1]
    for part, row in listed.items():
        if part not in PARTS or row.columns != _ddl(_columns(part, design)) or list(row.bucket_columns) != PARTS[part][1] or row.buckets != store.buckets:
            raise StoreError(f"{part} in {folder} is not as this library writes it: {row.columns}")
        found = spark.read.parquet(f"{folder}/{part}").schema
        if row.rows and [(f.name, f.dataType.simpleString()) for f in found] != list(_columns(part, design).items()):
            raise StoreError(f"the files of {part} in {folder} have other columns: {found.simpleString()}")
        name = f"store_{uuid.uuid4().hex}"
        keys = ", ".join(row.bucket_columns)
        spark.sql(f"CREATE TABLE {name} ({row.columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {row.buckets} BUCKETS LOCATION '{folder}/{part}'")
        table = spark.table(name)
        if check_rows and (n := table.count()) != row.rows:
            raise StoreError(f"{part} in {folder} has {n} rows; {row.rows} were written")
        setattr(store, part, table)
    return store


def stored_degrees(store: GraphStore) -> DataFrame:
    """design_id, gid, gtype, loads, drivers, parallel: edges that leave and enter each gate, and those that run beside another. No exchange: all three tables lie by gate."""
    outs = store.edges_out.groupBy("design_id", F.col("src").alias("gid")).agg(F.count("*").alias("loads"), (F.count("*") - F.count_distinct("dst")).alias("parallel"))
    ins = store.edges_in.groupBy("design_id", F.col("dst").alias("gid")).agg(F.count("*").alias("drivers"))
    rows = store.gates.select("design_id", "gid", "gtype").join(outs.hint("merge"), ["design_id", "gid"], "left").join(ins.hint("merge"), ["design_id", "gid"], "left")
    return rows.na.fill(0, ["loads", "parallel", "drivers"])


def stored_examples(store: GraphStore, *columns: str) -> DataFrame:
    """design_id, gid, gate_name, y, component_id and the named features (all by default) of each gate: what training and scoring read, without an exchange."""
    rows = store.gates.select("design_id", "gid", "gate_name", "y")
    rows = rows.join(store.components.hint("merge"), ["design_id", "gid"]).join(store.features.select("design_id", "gid", *(columns or FEATURES)).hint("merge"), ["design_id", "gid"])
    return rows.select("design_id", "gid", "gate_name", "y", "component_id", *(columns or FEATURES))
