"""Merkle manifest of a dataset, with an inclusion proof for every row by Octopus multiproofs.

Every row is a leaf; each language's leaves, by doc_id, are a tree, and the languages' subroots are the leaves of the tree
above. Trees are built in tiers of ``levels`` levels: a leaf partition is an aligned run of 2**levels leaves, whose nodes
a task derives from its leaves alone, and the partitions' top nodes are the leaves of the next tier.

Proofs go by partition: its rows together lack only the nodes beside the path of its top node, the minimal union of
missing coordinates. That union is listed, fetched once by a join with the stored upper nodes, and then the partition
derives all shared interiors from its own leaves and expands every row's proof on the spot.

Scale: the texts are read once; what goes on is 80 bytes a row. Leaves get their places from ranges and running counts, so
a hot language is many ranges and many partitions. Stored are two nodes for 2**levels leaves; no node or leaf goes
through the driver, only the largest number of leaves.

Defined results: nulls are hashed as ``-``; rows without doc_id come first in their language, rows with equal doc_id go by
their leaf; an empty table gives an empty result; rows without doc_id are never tampered with; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelore.llm.common import discard, stage
from gatelore.llm.ordered import group_key, group_places, running_sums

LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a row of a partition's fetched nodes is: a sibling to its left or right, no sibling, or a known top node.
LEFT, RIGHT, LONE, SUBROOT, ROOT = 0, 1, 2, 3, 4
NODES = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("node", pa.string()), ("n", pa.int64())])
PROVEN = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


def digest(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return (n - 1).bit_length()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**changed: Column) -> Column:
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def _above(nodes: list[str]) -> list[str]:
    return [digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]


def _by_place(table: pa.Table, *columns: str) -> list[list]:
    table = table.sort_by("idx")
    return [table.column(c).to_pylist() for c in columns]


def _tier(low: int, levels: int):
    return lambda key, table: _derived(key, table, low, levels)


def _derived(key: tuple, table: pa.Table, low: int, levels: int) -> pa.Table:
    """All nodes that a run of nodes of level ``low`` derives; of the leaves' tier only the topmost ones, as the rest can be derived again."""
    tree, block = (x.as_py() for x in key)
    nodes, ns = _by_place(table, "node", "n")
    top, rows = min(low + levels, height(ns[0])), []
    for level in range(low, top + 1):
        if level > low:
            nodes = _above(nodes)
        if level == top or low and level > low:
            first = block << (levels - (level - low))
            rows += [(tree, level, first + k, x, ns[0]) for k, x in enumerate(nodes)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), NODES)], schema=NODES)


def grow(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The nodes from level ``levels`` upwards, and the root, of every tree: tree, level, idx, node, n. ``leaves``: tree, idx, node, n."""
    most = leaves.agg(F.max("n")).collect()[0][0] or 1
    out, now = [], leaves
    for low in range(0, max(1, height(most)), levels):
        runs = now.select("tree", "idx", "node", "n", F.shiftright("idx", levels).alias("block")).groupBy("tree", "block")
        tier = stage(runs.applyInArrow(_tier(low, levels), "tree string, level int, idx long, node string, n long"), "tier")
        out.append(tier)
        now = tier.filter((F.col("level") == low + levels) & (F.col("level") < _height("n")))
    nodes = out[0]
    for tier in out[1:]:
        nodes = nodes.union(tier)
    return nodes


def _height(n: str) -> Column:
    return F.when(F.col(n) > 1, F.length(F.bin(F.col(n) - 1))).otherwise(0)


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("level") == _height("n")).select("tree", F.col("node").alias("root"))


def missing(partitions: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """tree, block, level, side, node: what each leaf partition (tree, block, n) lacks for the proofs of all its rows, fetched once."""
    level = F.explode(F.expr(f"CASE WHEN {levels} < h THEN sequence({levels}, h - 1) ELSE array() END"))
    steps = partitions.withColumn("h", _height("n").cast("int")).withColumn("level", level)
    own = F.expr(f"shiftright(block, level - {levels})")
    width = F.expr("shiftright(n - 1, level) + 1")
    steps = steps.select("tree", "block", "level", own.bitwiseXOR(F.lit(1)).alias("idx"), (own % 2).cast("int").alias("odd"), width.alias("width"))
    side = F.when(F.col("idx") >= F.col("width"), LONE).when(F.col("odd") == 1, LEFT).otherwise(RIGHT)
    steps = steps.select("tree", "block", "level", "idx", side.alias("side"))
    fetched = steps.filter(F.col("side") != LONE).join(nodes.select("tree", "level", "idx", "node"), ["tree", "level", "idx"]).select("tree", "block", "level", "side", "node")
    return fetched.union(steps.filter(F.col("side") == LONE).select("tree", "block", "level", "side", F.lit(None).cast("string")))


def _interiors(leaves: list[str], levels: int) -> list[list[str]]:
    """All levels that a partition derives from its leaves, without its top node."""
    out, nodes = [], leaves
    for _ in range(levels):
        out.append(nodes)
        nodes = _above(nodes)
    return out


def _path(interiors: list[list[str]], k: int, upper: list[tuple[int, str | None]]) -> list[tuple[int, str | None]]:
    """Side and sibling of every level above the ``k``-th leaf of a partition."""
    path = []
    for nodes in interiors:
        path.append((LEFT, nodes[k - 1]) if k & 1 else (RIGHT, nodes[k + 1]) if k + 1 < len(nodes) else (LONE, None))
        k >>= 1
    return path + upper


def fold(leaf: str, path: list[tuple[int, str | None]]) -> str:
    for side, node in path:
        leaf = digest(node, leaf) if side == LEFT else digest(leaf, node) if side == RIGHT else digest(leaf)
    return leaf


def _known(fetched: pa.Table) -> tuple[list[tuple[int, str | None]], dict[int, str]]:
    rows = sorted(zip(*(fetched.column(c).to_pylist() for c in ("level", "side", "node"))), key=lambda r: r[0])
    return [(side, node) for _, side, node in rows if side < SUBROOT], {side: node for _, side, node in rows if side >= SUBROOT}


def _prove(leaves: pa.Table, fetched: pa.Table, levels: int) -> pa.Table:
    if not leaves.num_rows:
        return PROVEN.empty_table()
    doc_ids, nodes, changed, ns = _by_place(leaves, "doc_id", "node", "changed", "n")
    upper, top = _known(fetched)
    interiors, rows = _interiors(nodes, min(levels, height(ns[0]))), []
    for k, (doc_id, leaf, other) in enumerate(zip(doc_ids, nodes, changed)):
        path = _path(interiors, k, upper)
        folded = fold(other or leaf, path)
        rows.append((doc_id, leaf, top[SUBROOT], top[ROOT], digest(*(x for _, x in path if x is not None)), folded, folded == top[ROOT]))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PROVEN)], schema=PROVEN)


def _paths(leaves: pa.Table, fetched: pa.Table, levels: int) -> pa.Table:
    """tree (of the tree whose subroot a leaf is), step, side, node."""
    owners, nodes, ns = _by_place(leaves, "owner", "node", "n")
    upper, top = _known(fetched)
    interiors = _interiors(nodes, min(levels, height(ns[0]))) if nodes else []
    rows = []
    for k, (owner, node) in enumerate(zip(owners, nodes)):
        steps = _path(interiors, k, upper)
        rows += [(owner, j, side, x) for j, (side, x) in enumerate([*steps, (SUBROOT, node), (ROOT, top[ROOT])])]
    columns = zip(*rows) if rows else ([], [], [], [])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["tree", "step", "side", "node"])


def _partitions(leaves: DataFrame, levels: int) -> DataFrame:
    return leaves.select("tree", F.shiftright("idx", levels).alias("block"), "n").distinct()


def manifest_leaves(docs: DataFrame, changed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """tree, idx, n, doc_id, node and changed (the leaf after a change, where there is one), and the trees' places, both staged."""
    other = changed if changed is not None else F.lit(None).cast("string")
    read = docs.select(F.col("doc_id").cast("long"), group_key(F.col("lang"), "first").alias("tree"), leaf_of().alias("node"), other.alias("changed"), F.lit(1).cast("long").alias("one"))
    read = stage(read, "leaves")
    rows, bases = running_sums(read, "tree", ["doc_id", "node"], "one")
    leaves = stage(rows.join(bases, ["part", "tree"]).select("tree", (F.col("base") + F.col("local")).alias("idx"), F.col("total").alias("n"), "doc_id", "node", "changed"), "placed")
    places = group_places(bases, "tree")
    discard(read, rows, bases)
    return leaves, places


def prove_all(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; the fold begins at ``changed``, a leaf, where it isn't null."""
    leaves, places = manifest_leaves(docs, changed)
    nodes = grow(leaves, levels)
    # the tree of subroots; its leaves are few, or many where a dirty column has many languages
    tops = roots(nodes).join(places, "tree").select(F.lit("").alias("tree"), F.col("place").alias("idx"), F.lit(places.count()).alias("n"), F.col("root").alias("node"), F.col("tree").alias("owner"))
    tops = stage(tops, "subroots")
    above = grow(tops, levels)
    blocks = _partitions(tops, levels)
    known = stage(missing(blocks, above, levels).union(blocks.join(roots(above), "tree").select("tree", "block", F.lit(1 << 20), F.lit(ROOT), "root")), "fetched")
    dealt = tops.withColumn("block", F.shiftright("idx", levels)).groupBy("tree", "block").cogroup(known.groupBy("tree", "block"))
    paths = stage(dealt.applyInArrow(lambda a, b: _paths(a, b, levels), "tree string, step int, side int, node string"), "paths")
    blocks = stage(_partitions(leaves, levels), "partitions")
    known = stage(missing(blocks, nodes, levels).union(blocks.join(paths, "tree").select("tree", "block", F.col("step") + 64, "side", "node")), "fetched")
    dealt = leaves.withColumn("block", F.shiftright("idx", levels)).groupBy("tree", "block").cogroup(known.groupBy("tree", "block"))
    return dealt.applyInArrow(lambda a, b: _prove(a, b, levels), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered_leaf() -> Column:
    """The leaf with one more in n_chars, where 7 divides the checksum of doc_id; null elsewhere."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf_of(n_chars=F.col("n_chars") + 1))
