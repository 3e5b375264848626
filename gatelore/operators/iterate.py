"""Graph iteration: loops of joins over a frontier, all designs (and all families of seeds) in one loop.

Designs that fit a task are swept there (:mod:`gatelore.operators.sweep`); what follows is for larger ones. Each round is
written to the shared folder and read again, so plans stay short and a lost executor repeats one round. A round shuffles the
frontier and its neighbours only; rounds grow with a circuit's depth, not with its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelore.operators import sweep
from gatelore.operators.edges import KEY, combinational
from gatelore.sources.staging import Layers, staged


def levels(gates: DataFrame, comb: DataFrame) -> DataFrame:
    """design_id, gid, level, ordered: longest combinational path to each gate, by peeling gates without open drivers.

    The round in which a gate is peeled is its level. Gates on or behind a loop are never peeled: ``ordered`` is false and
    their level is what their peeled drivers pushed. Flip-flops have level 0 and are not ordered.
    """
    comb, nodes = sweep.kept(comb), sweep.kept(gates.select(*KEY, (F.col("gtype") != "dff").alias("is_comb")))
    large = sweep.too_large(["design_id"], nodes, comb)
    (some, inner), rest = sweep.split(large, ["design_id"], nodes, comb)
    out = sweep.levels_in_tasks(some, inner)
    return out.union(_levels_by_rounds(*rest)) if rest else out


def _levels_by_rounds(gates: DataFrame, comb: DataFrame) -> DataFrame:
    open_ = staged(comb.groupBy("design_id", F.col("dst").alias("gid")).agg(F.count("*").alias("open")))
    comb_gates = gates.filter("is_comb").select(KEY)
    frontier = staged(comb_gates.join(open_, KEY, "left_anti").withColumn("level", F.lit(0)))
    rounds, level = [frontier], 0
    while not frontier.isEmpty():
        level += 1
        fed = frontier.select("design_id", F.col("gid").alias("src")).join(comb, ["design_id", "src"]).groupBy("design_id", F.col("dst").alias("gid")).agg(F.count("*").alias("fed"))
        open_ = staged(open_.join(fed, KEY, "left").select(*KEY, (F.col("open") - F.coalesce("fed", F.lit(0))).alias("open")).filter("open >= 0"))
        frontier = open_.filter("open = 0").select(*KEY, F.lit(level).alias("level"))
        open_ = open_.filter("open > 0")
        rounds.append(frontier)
    peeled = rounds[0]
    for r in rounds[1:]:
        peeled = peeled.union(r)
    pushed = peeled.select("design_id", F.col("gid").alias("src"), "level").join(comb, ["design_id", "src"]).groupBy("design_id", F.col("dst").alias("gid")).agg((F.max("level") + 1).alias("pushed"))
    out = gates.select(KEY).join(peeled.withColumn("ordered", F.lit(True)), KEY, "left").join(pushed, KEY, "left")
    return out.select(*KEY, F.coalesce("level", "pushed", F.lit(0)).cast("long").alias("level"), F.coalesce("ordered", F.lit(False)).alias("ordered"))


#: Rounds whose results are kept side by side before they are written as one table.
SIDE_BY_SIDE = 8


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _relax(seeds: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """Shortest distances over ``edges`` (design_id, way, src, dst) from ``seeds`` (design_id, gid, family, way, dist)."""
    on = ["design_id", "gid", "family", "way"]
    edges, frontier, done = staged(edges), staged(seeds), 0
    found = [frontier]
    while not frontier.isEmpty() and (hops is None or done < hops):
        done += 1
        next_ = frontier.withColumnRenamed("gid", "src").join(edges, ["design_id", "way", "src"])
        reached = next_.groupBy("design_id", F.col("dst").alias("gid"), "family", "way").agg(F.min("dist").alias("dist")).select(*on, (F.col("dist") + 1).alias("dist"))
        frontier = staged(reached.join(_together(found), on, "left_anti"))
        found.append(frontier)
        if len(found) > SIDE_BY_SIDE:
            found[:] = [staged(_together(found))]
    return _together(found)


def _longest(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest distances over ``edges`` (design_id, way, src, dst, src_rank, dst_rank), each gate passing its distances on once.

    Ranks rise along every edge whose source passes on, so when a rank's turn comes all that can reach it has arrived.
    Edges are laid out by the rank they leave, distances by the rank they are for: a round reads its own rank's rows alone,
    so all rounds together read every edge and every distance once. A gate without rank receives and never sends.
    """
    spark, on = edges.sparkSession, ["design_id", "gid", "family", "way"]
    laid, waiting = Layers(spark, "src_rank"), Layers(spark, "rank")
    laid.add(edges.select("design_id", "way", "src", "dst", "src_rank", F.coalesce("dst_rank", F.lit(-1)).alias("rank")))
    ranks = laid.all().select("design_id", "way", F.col("src").alias("gid"), F.col("src_rank").alias("rank")).distinct()
    waiting.add(seeds.join(ranks, ["design_id", "way", "gid"], "left").select(*on, "dist", F.coalesce("rank", F.lit(-1)).alias("rank")))
    last = laid.all().agg(F.max("src_rank")).first()[0]
    for rank in range(0, (-1 if last is None else last) + 1):
        now = waiting.at(rank).groupBy(on).agg(F.max("dist").alias("dist"))
        sent = now.withColumnRenamed("gid", "src").join(laid.at(rank), ["design_id", "way", "src"])
        waiting.add(sent.groupBy("design_id", F.col("dst").alias("gid"), "family", "way", "rank").agg((F.max("dist") + 1).alias("dist")).select(*on, "dist", "rank"))
    out = staged(waiting.all().groupBy(on).agg(F.max("dist").alias("dist")))
    laid.discard()
    waiting.discard()
    return out


#: For each family of seeds the way it is followed, its column name and the first distance of longest paths.
FAMILIES = {
    "pi": ("from", "from_PI", 0), "po": ("to", "to_PO", 0), "dff_succ": ("from", "from_DFF", 1), "dff_pred": ("to", "to_DFF", 1),
    "comb_src": ("from", "from_COMB", 0), "comb_sink": ("to", "to_COMB", 0), "gnd": ("from", "from_GND", 0), "vdd": ("from", "from_VDD", 0),
}


def _both_ways(comb: DataFrame) -> DataFrame:
    e = comb.select("design_id", "src", "dst").distinct()
    return e.select("design_id", F.lit("from").alias("way"), "src", "dst").union(e.select("design_id", F.lit("to"), "dst", "src"))


def shortest_distances(seeds: DataFrame, comb: DataFrame) -> DataFrame:
    """design_id, gid, family, dist: breadth-first, all families in one loop."""
    seeds, comb = sweep.kept(seeds), sweep.kept(comb)
    large = sweep.too_large(["design_id"], seeds, comb)
    (some, inner), rest = sweep.split(large, ["design_id"], seeds, comb)
    out = sweep.distances_in_tasks(some, inner, None, {f: v[2] for f, v in FAMILIES.items()})
    return out.union(_shortest_by_rounds(*rest)) if rest else out


def _shortest_by_rounds(seeds: DataFrame, comb: DataFrame) -> DataFrame:
    way = F.create_map(*[F.lit(x) for k, v in FAMILIES.items() for x in (k, v[0])])
    start = seeds.select("design_id", "gid", "family", way[F.col("family")].alias("way"), F.lit(0).cast("long").alias("dist"))
    return _relax(start, _both_ways(comb)).select("design_id", "gid", "family", "dist")


def longest_distances(seeds: DataFrame, comb: DataFrame, order: DataFrame) -> DataFrame:
    """As above for longest paths. Only ordered gates pass a distance on, so loops end."""
    seeds, comb, order = sweep.kept(seeds), sweep.kept(comb), sweep.kept(order)
    large = sweep.too_large(["design_id"], seeds, comb, order)
    (some, inner, levels_), rest = sweep.split(large, ["design_id"], seeds, comb, order)
    out = sweep.distances_in_tasks(some, inner, levels_, {f: v[2] for f, v in FAMILIES.items()})
    return out.union(_longest_by_rounds(*rest)) if rest else out


def _longest_by_rounds(seeds: DataFrame, comb: DataFrame, order: DataFrame) -> DataFrame:
    way = F.create_map(*[F.lit(x) for k, v in FAMILIES.items() for x in (k, v[0])])
    first = F.create_map(*[F.lit(x) for k, v in FAMILIES.items() for x in (k, v[2])])
    start = seeds.select("design_id", "gid", "family", way[F.col("family")].alias("way"), first[F.col("family")].cast("long").alias("dist"))
    passing = staged(order.filter("ordered").select(*KEY, "level"))
    e = _both_ways(comb)
    deepest = passing.agg(F.max("level")).first()[0] or 0
    # along the edges ranks are levels, against them they are counted from the deepest level
    rank = F.when(F.col("way") == "from", F.col("level")).otherwise(deepest - F.col("level"))
    e = e.join(passing.toDF("design_id", "src", "level"), ["design_id", "src"]).withColumn("src_rank", rank).drop("level")
    e = e.join(passing.toDF("design_id", "dst", "level"), ["design_id", "dst"], "left").withColumn("dst_rank", rank).drop("level")
    return _longest(start, e.select("design_id", "way", "src", "dst", "src_rank", "dst_rank")).select("design_id", "gid", "family", "dist")


def distance_columns(gates: DataFrame, shortest: DataFrame, longest: DataFrame) -> DataFrame:
    """The 16 distance columns; -1 where nothing reaches a gate. A flip-flop is 0 in the register columns."""
    both = shortest.withColumn("m", F.lit("min")).union(longest.withColumn("m", F.lit("max")))
    name = F.create_map(*[F.lit(x) for k, v in FAMILIES.items() for x in (k, v[1])])
    named = both.withColumn("name", F.concat_ws("_", "m", name[F.col("family")]))
    columns = [f"{m}_{v[1]}" for v in FAMILIES.values() for m in ("min", "max")]
    wide = named.groupBy(KEY).pivot("name", columns).agg(F.first("dist"))
    out = gates.select(*KEY, "gtype").join(wide, KEY, "left").na.fill(-1, columns)
    return out.select(*KEY, *[F.when((F.col("gtype") == "dff") & F.lit("DFF" in c), 0).otherwise(F.col(c)).cast("long").alias(c) for c in columns])


def neighbourhood_sizes(gates: DataFrame, comb: DataFrame, hops: int = 4) -> DataFrame:
    """in_4lvl_cnt, out_4lvl_cnt: other gates within ``hops`` combinational steps against and along the edges."""
    nodes, comb = sweep.kept(gates.select(KEY)), sweep.kept(comb)
    large = sweep.too_large(["design_id"], nodes, comb)
    (some, inner), rest = sweep.split(large, ["design_id"], nodes, comb)
    out = sweep.neighbourhoods_in_tasks(some, inner, hops)
    return out.union(_sizes_by_rounds(*rest, hops)) if rest else out


def _sizes_by_rounds(gates: DataFrame, comb: DataFrame, hops: int) -> DataFrame:
    e = staged(comb.select("design_id", "src", "dst").distinct())
    step = reach = e
    for _ in range(hops - 1):
        step = staged(step.join(e.toDF("design_id", "dst", "end"), ["design_id", "dst"]).select("design_id", "src", F.col("end").alias("dst")).distinct().join(reach, ["design_id", "src", "dst"], "left_anti"))
        reach = staged(reach.union(step))
    reach = reach.filter("src <> dst")
    ins = reach.groupBy("design_id", F.col("dst").alias("gid")).agg(F.count("*").alias("in_4lvl_cnt"))
    outs = reach.groupBy("design_id", F.col("src").alias("gid")).agg(F.count("*").alias("out_4lvl_cnt"))
    return gates.select(KEY).join(ins, KEY, "left").join(outs, KEY, "left").na.fill(0)


def context(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """design_id, gid, hop: gates within ``hops`` undirected steps of the seeds."""
    both = edges.select("design_id", F.lit("any").alias("way"), "src", "dst").union(edges.select("design_id", F.lit("any"), "dst", "src")).distinct()
    start = seeds.select(*KEY, F.lit("seed").alias("family"), F.lit("any").alias("way"), F.lit(0).cast("long").alias("dist")).distinct()
    return _relax(start, both, hops=hops).select(*KEY, F.col("dist").alias("hop"))


def _spread(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit numbers that order nodes as if at random (the finaliser of splitmix64)."""
    x = x.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _contracted(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Of a task's pairs (design_id, low, high) each node beside one chosen node of its component: as if drawn, so that a node whose pairs lie in several tasks is rarely chosen in all."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    codes = t.column("design_id").combine_chunks().dictionary_encode()
    design = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.stack([np.tile(design, 2), np.concatenate([t.column(c).to_numpy() for c in ("low", "high")])], axis=1)
    nodes, at = np.unique(ends, axis=0, return_inverse=True)
    low, high = at.reshape(2, -1)
    order = np.argsort(_spread(nodes[:, 1], seed), kind="stable")
    label = np.empty(len(nodes), np.int64)
    label[order] = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[low], label[high])
        np.minimum.at(new, order[label[low]], least)
        np.minimum.at(new, order[label[high]], least)
        np.minimum.at(new, low, least)
        np.minimum.at(new, high, least)
        new = new[order[new]]
        if (new == label).all():
            break
        label = new
    columns = [codes.dictionary.take(pa.array(nodes[:, 0])), pa.array(nodes[:, 1]), pa.array(nodes[order[label], 1])]
    yield pa.RecordBatch.from_arrays(columns, names=["design_id", "gid", "top"])


def _tops(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """design_id, gid, top for the nodes of ``pairs`` (design_id, low, high): one node of each component.

    Tasks contract the pairs that they hold, whole designs where these fit. What is left are pairs of chosen nodes, where a
    node lay in several tasks; they are contracted in turn, and there are fewer in each round.
    """
    kind = pairs.schema["design_id"].dataType.simpleString()
    dealt = pairs.select("design_id", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")).hint("rebalance", "design_id")
    local = staged(dealt.mapInArrow(lambda it: _contracted(it, seed), f"design_id {kind}, gid long, top long"))
    chosen = staged(local.groupBy(KEY).agg(F.max("top").alias("top"), F.min("top").alias("least")))
    # a node that was chosen in one task and not in another is among these, too: it lies beside itself in the first
    several = local.join(chosen.filter("top <> least").select(*KEY, F.col("top").alias("high")), KEY).filter("top <> high").select("design_id", F.col("top").alias("low"), "high")
    open_ = staged(several.distinct())
    if open_.isEmpty():
        return chosen.select(*KEY, "top")
    higher = _tops(open_, seed + 1).select("design_id", F.col("gid").alias("top"), F.col("top").alias("final"))
    return chosen.join(higher, ["design_id", "top"], "left").select(*KEY, F.coalesce("final", "top").alias("top"))


def component_roots(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """design_id, gid, root (smallest gid of its component). A node without pairs is its own root."""
    tops = _tops(pairs.select("design_id", "low", "high").filter("low <> high"))
    least = tops.groupBy("design_id", "top").agg(F.min("gid").alias("root"))
    roots = staged(tops.join(least, ["design_id", "top"]).select(*KEY, "root"))
    return nodes.select(KEY).join(roots, KEY, "left").select(*KEY, F.coalesce("root", F.col("gid").cast("long")).alias("root"))


def merged_roots(roots: DataFrame, new_pairs: DataFrame) -> DataFrame:
    """Stored roots (design_id, gid, root) after more pairs have come: only the components that they touch are merged.

    The pairs (design_id, low, high) are between nodes that ``roots`` has; what is worked on are pairs of roots.
    """
    of = lambda end: roots.select("design_id", F.col("gid").alias(end), F.col("root").alias(f"{end}_root"))
    touched = new_pairs.select("design_id", "low", "high").distinct().join(of("low"), ["design_id", "low"]).join(of("high"), ["design_id", "high"])
    pairs = staged(touched.filter("low_root <> high_root").select("design_id", F.least("low_root", "high_root").alias("low"), F.greatest("low_root", "high_root").alias("high")).distinct())
    tops = _tops(pairs)
    least = tops.groupBy("design_id", "top").agg(F.min("gid").alias("new"))
    moved = staged(tops.join(least, ["design_id", "top"]).select("design_id", F.col("gid").alias("root"), "new"))
    return roots.join(moved, ["design_id", "root"], "left").select(*KEY, F.coalesce("new", "root").alias("root"))


def components(gates: DataFrame, comb: DataFrame) -> DataFrame:
    """design_id, gid, component_id: weak components of the combinational view, numbered by their smallest gate."""
    pairs = comb.select("design_id", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).distinct()
    return numbered_components(component_roots(gates, pairs))


def numbered_components(roots: DataFrame) -> DataFrame:
    """design_id, gid, component_id: each design's components in order of their smallest gate."""
    number = F.dense_rank().over(Window.partitionBy("design_id").orderBy("root")) - 1
    return roots.select(*KEY, number.cast("long").alias("component_id"))


def combinational_components(gates: DataFrame, edges: DataFrame) -> DataFrame:
    return components(gates, combinational(edges, gates))
