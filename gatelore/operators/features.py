"""The 48-column feature table, its mask and scaling, and component descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelore.functions.columns import COUNT_COLUMNS, DISTANCE_COLUMNS, FEATURES, GATE_TYPES, MASKED, ROLE_COLUMNS, TALLY_COLUMNS
from gatelore.operators import edges as E
from gatelore.operators import iterate as I
from gatelore.operators import sweep
from gatelore.operators.edges import KEY
from gatelore.operators.simulate import signal_probability
from gatelore.sources.staging import staged


#: The columns that hang on edges and paths.
GRAPH_COLUMNS = ["is_sink_gate", "fanin_2level", "fanout_2level", "fanout_dff_count", "fanin_same_type", "in_type_cnt", "out_type_cnt", "level", *DISTANCE_COLUMNS, "in_4lvl_cnt", "out_4lvl_cnt", "p_is_1"]


def raw_features(gates: DataFrame, pins: DataFrame, ports: DataFrame, tallies: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """All 48 columns, unmasked and unscaled; tallies stay 0 unless a table of them is given. With ``columns`` only those are worked out."""
    wanted = [c for c in FEATURES if columns is None or c in columns]
    needs = lambda *names: any(c in wanted for c in names)
    gates, pins, ports = sweep.kept(gates), sweep.kept(pins), sweep.kept(ports)
    flags = staged(E.io_flags(gates, pins, ports)) if needs("is_PI", "is_PO", *DISTANCE_COLUMNS) else None
    parts = [E.one_hot(gates)] if needs(*[f"is_{t}" for t in GATE_TYPES]) or not needs(*ROLE_COLUMNS, "is_PI", "is_PO", *GRAPH_COLUMNS) else []
    if needs(*ROLE_COLUMNS):
        parts.append(E.pin_roles(gates, pins))
    if needs("is_PI", "is_PO"):
        parts.append(flags)
    if needs(*GRAPH_COLUMNS):
        parts.append(graph_columns(gates, pins, ports, staged(E.build_edges(gates, pins)), flags, [c for c in GRAPH_COLUMNS if c in wanted]))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, KEY)
    if tallies is not None:
        out = out.join(tallies, KEY, "left").na.fill(0, TALLY_COLUMNS)
    else:
        out = out.withColumns({c: F.lit(0.0) for c in TALLY_COLUMNS})
    return out.select(*KEY, *[F.col(c).cast("double").alias(c) for c in wanted])


def graph_columns(gates: DataFrame, pins: DataFrame, ports: DataFrame, edges: DataFrame, flags: DataFrame | None, columns: list[str]) -> DataFrame:
    """design_id, gid and the given ones of ``GRAPH_COLUMNS``; ``flags``: is_PI and is_PO, where distances are among them."""
    large = sweep.too_large(["design_id"], gates, edges)
    (some, inner), rest = sweep.split(large, ["design_id"], gates, edges)
    rows = some.select(*KEY, "gtype")
    if set(columns) & set(DISTANCE_COLUMNS):
        tied = pins.filter(F.col("net").isin("1'b0", "1'b1")).groupBy(KEY).agg(F.max((F.col("net") == "1'b0").cast("int")).alias("gnd"), F.max((F.col("net") == "1'b1").cast("int")).alias("vdd"))
        rows = rows.join(flags, KEY, "left").join(tied, KEY, "left").na.fill(0, ["is_PI", "is_PO", "gnd", "vdd"])
    else:
        rows = rows.withColumns({c: F.lit(0) for c in ("is_PI", "is_PO", "gnd", "vdd")})
    rows = rows.join(E.dff_data_driver(gates, pins), KEY, "left") if "p_is_1" in columns else rows.withColumn("d_driver", F.lit(-1))
    out = sweep.graph_columns_in_tasks(rows, inner, columns, I.FAMILIES)
    return out.unionByName(_graph_columns_by_rounds(*rest, *sweep.split(large, ["design_id"], pins, ports)[1], columns)) if rest else out


def _graph_columns_by_rounds(gates: DataFrame, edges: DataFrame, pins: DataFrame, ports: DataFrame, columns: list[str]) -> DataFrame:
    comb = staged(E.combinational(edges, gates))
    level = staged(I.levels(gates, comb))
    out = level.select(*KEY, "level").join(E.sink_flags(gates, edges), KEY)
    if set(columns) & {"fanin_2level", "fanout_2level", "fanout_dff_count"}:
        out = out.join(E.two_hop_counts(gates, edges), KEY)
    if set(columns) & {"fanin_same_type", "in_type_cnt", "out_type_cnt"}:
        out = out.join(E.type_mix(gates, edges), KEY)
    if set(columns) & set(DISTANCE_COLUMNS):
        seed = staged(E.seeds(gates, pins, edges, ports))
        out = out.join(I.distance_columns(gates, I.shortest_distances(seed, comb), I.longest_distances(seed, comb, level)), KEY)
    if set(columns) & {"in_4lvl_cnt", "out_4lvl_cnt"}:
        out = out.join(I.neighbourhood_sizes(gates, comb), KEY)
    if "p_is_1" in columns:
        out = out.join(signal_probability(gates, pins, edges, level).select(*KEY, F.col("p1").alias("p_is_1")), KEY)
    return out.select(*KEY, *[F.col(c).cast("double").alias(c) for c in columns])


def masked(features: DataFrame, off: list[str] | None = None, on: list[str] | None = None) -> DataFrame:
    """Zero the columns that are off (``features`` may lack these); width stays. ``on`` names what stays on instead."""
    dark = set(FEATURES) - set(on) if on is not None else set(MASKED if off is None else off)
    return features.select(*KEY, *[(F.lit(0.0) if c in dark else F.col(c)).alias(c) for c in FEATURES])


def scaled_columns(off: list[str] | None = None, on: list[str] | None = None, unscaled: list[str] | None = None, only: list[str] | None = None) -> list[str]:
    """The columns that are scaled: those that can be and that the mask leaves on (``off`` and ``on`` as in :func:`masked`), without ``unscaled``, or those of ``only``."""
    dark = set(FEATURES) - set(on) if on is not None else set(MASKED if off is None else off)
    can = {"level", "in_type_cnt", "out_type_cnt", *DISTANCE_COLUMNS, *COUNT_COLUMNS, *TALLY_COLUMNS}
    wanted = can - set(unscaled or ()) if only is None else can & set(only)
    return [c for c in FEATURES if c in wanted and c not in dark]


def scaled(features: DataFrame, columns: list[str], vectors: int = 1000) -> DataFrame:
    """Scale the given columns within each design: counts by min-max, distances by their peak (-1 stays), the level by its largest, type counts by nine, rises and falls by the steps between vectors, other tallies by the vectors applied."""
    peaked = [c for c in columns if c in DISTANCE_COLUMNS or c == "level" or c in COUNT_COLUMNS]
    ends = [F.max(F.when(F.col(c) >= 0, F.col(c)) if c in DISTANCE_COLUMNS else F.col(c)).alias(f"_high_{c}") for c in peaked] + [F.min(c).alias(f"_low_{c}") for c in peaked if c in COUNT_COLUMNS]

    def by_family(c: str) -> Column:
        x, high, low = F.col(c), F.col(f"_high_{c}"), F.col(f"_low_{c}")
        if c in DISTANCE_COLUMNS:
            return F.when(x < 0, -1.0).when(high > 0, x / high).otherwise(0.0)
        if c == "level":
            return F.when(high > 0, x / high).otherwise(0.0)
        if c in COUNT_COLUMNS:
            return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
        if c in ("in_type_cnt", "out_type_cnt"):
            return x / 9.0
        if c in TALLY_COLUMNS:
            return x / float(max(vectors - (c in ("num_1to0", "num_0to1")), 1))
        return x

    rows = features
    if ends:
        # one row for each design is joined back; a window would deal out and sort whole designs with all their columns
        rows = sweep.kept(features)
        of = rows.groupBy(F.col("design_id").alias("_design")).agg(*ends)
        rows = rows.join(of, F.col("design_id").eqNullSafe(F.col("_design")))
    return rows.select(*KEY, *[(by_family(c) if c in columns else F.col(c)).alias(c) for c in features.columns if c not in KEY])


#: The features that are averaged over a component.
MEANS = ["p_is_1", "fanin_2level", "fanout_2level", "in_4lvl_cnt", "out_4lvl_cnt", "min_to_PO", "min_from_PI"]


def component_descriptors(gates: DataFrame, comb: DataFrame, components: DataFrame, features: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """21 numbers per component; boundary columns are 0, the view being cut at flip-flops. ``cut_edges`` (edges to a flip-flop) is added when all edges are given."""
    rows = components.join(gates.select(*KEY, "gtype"), KEY).join(features.select(*KEY, *MEANS), KEY)
    shares = [F.avg((F.col("gtype") == t).cast("double")).alias(f"share_{t}") for t in GATE_TYPES]
    nodes = rows.groupBy("design_id", "component_id").agg(F.count("*").cast("double").alias("node_count"), *shares, *[F.avg(c).alias(f"mean_{c}") for c in MEANS])
    pairs = E.undirected_pairs(comb).select("design_id", F.col("low").alias("gid")).join(components, KEY).groupBy("design_id", "component_id").agg(F.count("*").cast("double").alias("edge_count"))
    out = nodes.join(pairs, ["design_id", "component_id"], "left").na.fill(0.0, ["edge_count"])
    n = F.col("node_count")
    out = out.withColumns({"density": 2.0 * F.col("edge_count") / (n * (n - 1.0) + 1e-6), "boundary_count": F.lit(0.0), "boundary_ratio": F.lit(0.0)})
    order = ["node_count", "edge_count", "density", "boundary_count", "boundary_ratio", *[f"share_{t}" for t in GATE_TYPES], *[f"mean_{c}" for c in MEANS]]
    if edges is not None:
        cut = edges.join(comb.select("design_id", "src", "dst").distinct(), ["design_id", "src", "dst"], "left_anti")
        ends = cut.select("design_id", F.col("src").alias("gid")).union(cut.select("design_id", "dst")).join(components, KEY).groupBy("design_id", "component_id").agg(F.count("*").alias("cut_edges"))
        out = out.join(ends, ["design_id", "component_id"], "left").na.fill(0, ["cut_edges"])
        order.append("cut_edges")
    return out.select("design_id", "component_id", *order)


def with_components(components: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Each gate beside its component's descriptor."""
    return components.join(descriptors, ["design_id", "component_id"])
