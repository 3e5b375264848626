"""Exact duplicates by Patricia tries.

Texts are dealt into partitions by their length and content hash. Each partition inserts the full byte strings of many
texts into one compressed radix trie, so that equality is decided on bytes and not on the hash. A terminal node stores the
owning identifier (smallest or largest) and how many documents ended there.

Scale: every input task first builds a trie over its own rows, so a text that a third of all rows share crosses the network
once per task. When that trie outgrows ``spill_bytes`` its largest subtrees are emitted and forgotten; the reducing side
merges such partial terminals. Reducers see their texts in order of length and hash, so that all rows of a text come
together; when their trie outgrows the bound, every text but the one at hand is complete and the subtrees are emitted. The
answer is joined back to the documents on (length, digest), a plain equi-join that adaptive execution may split on hot keys.

Defined results: null text counts as empty; rows that repeat one identifier and text get the same answer; a null
identifier never owns a group unless all its identifiers are null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelore.llm.common import batches_of, begin_step, lower_az, sliced

PARTIAL = pa.schema([("len", pa.int32()), ("hash", pa.int64()), ("key", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
FINAL = pa.schema([("len", pa.int32()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class Node:
    __slots__ = ("label", "children", "owner", "n", "hash")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.n, self.hash = label, {}, None, 0, 0


def _first(a: int | None, b: int | None, pick) -> int | None:
    return b if a is None else a if b is None else pick(a, b)


#: What a node costs besides its label.
NODE_BYTES = 200


class Patricia:
    """A compressed radix trie over byte strings; ``pick`` (min or max) chooses the owner of a terminal node."""

    def __init__(self, pick=min):
        self.root, self.pick, self.bytes = Node(b""), pick, 0

    def insert(self, key: bytes, owner: int | None, n: int = 1, hash_: int = 0) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(child.label) + NODE_BYTES
                at = len(key)
            elif key.startswith(child.label, at):
                at += len(child.label)
            else:
                k = _common(child.label, key[at : at + len(child.label)])
                upper = Node(child.label[:k])
                child.label = child.label[k:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = child = upper
                self.bytes += NODE_BYTES
                at += k
            node = child
        node.owner = owner if not node.n else _first(node.owner, owner, self.pick)
        node.n += n
        node.hash = hash_

    def terminals(self, top: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, int | None, int, int]]:
        """Key, owner, number and hash of the strings below a node (all of them, unless one is given with what lies above it)."""
        todo = [(top or self.root, before)]
        while todo:
            node, above = todo.pop()
            whole = above + node.label
            if node.n:
                yield whole, node.owner, node.n, node.hash
            todo += [(c, whole) for c in node.children.values()]

    def spill(self, keep: int) -> Iterator[tuple[bytes, int | None, int, int]]:
        """Emit and forget whole subtrees, largest first, until at most ``keep`` bytes are left."""
        # a trunk without branches is passed, so that there are subtrees to choose from
        node, above = self.root, b""
        while len(node.children) == 1 and not node.n:
            above += node.label
            node = next(iter(node.children.values()))
        sizes = {k: _weight(c) for k, c in node.children.items()}
        for k in sorted(sizes, key=lambda k: -sizes[k]):
            yield from self.terminals(node.children.pop(k), above + node.label)
            self.bytes -= sizes[k]
            if self.bytes <= keep:
                return


def _weight(top: Node) -> int:
    total, todo = 0, [top]
    while todo:
        node = todo.pop()
        total += len(node.label) + NODE_BYTES
        todo += node.children.values()
    return total


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings that differ within min(len)."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _partial(batches: Iterator[pa.RecordBatch], pick, spill_bytes: int) -> Iterator[tuple]:
    begin_step("tries")
    trie = Patricia(pick)
    for b in sliced(batches):
        for h, key, owner in zip(*(c.to_pylist() for c in b.columns)):
            trie.insert(key, owner, 1, h)
        if trie.bytes > spill_bytes:
            for key, owner, n, h in trie.spill(spill_bytes // 2):
                yield len(key), h, key, owner, n
    for key, owner, n, h in trie.terminals():
        yield len(key), h, key, owner, n


def _merge(batches: Iterator[pa.RecordBatch], pick, spill_bytes: int) -> Iterator[tuple]:
    begin_step("tries of merged keys")
    at, trie = None, Patricia(pick)

    def closed():
        return ((len(key), hashlib.sha256(key).hexdigest(), owner, n) for key, owner, n, _ in trie.terminals())

    for b in sliced(batches):
        for length, h, key, owner, n in zip(*(c.to_pylist() for c in b.columns)):
            if trie.bytes > spill_bytes and (length, h) != at:
                yield from closed()
                trie = Patricia(pick)
            at = length, h
            trie.insert(key, owner, n, h)
    yield from closed()


def owners(docs: DataFrame, keep: str = "smallest", spill_bytes: int = 24 << 20) -> DataFrame:
    """One row per distinct normalised text: its length, digest, owner and number of documents."""
    pick = {"smallest": min, "largest": max}[keep]
    norm = lower_az(F.col("text"))
    dealt = docs.select(norm.alias("t"), F.col("doc_id").cast("long").alias("owner")).select(
        F.xxhash64("t").alias("hash"), F.col("t").cast("binary").alias("key"), "owner"
    )
    schema = "len int, hash long, key binary, owner long, n long"
    partial = dealt.mapInArrow(lambda it: batches_of(_partial(it, pick, spill_bytes), PARTIAL), schema)
    merged = partial.repartition("len", "hash").sortWithinPartitions("len", "hash")
    return merged.mapInArrow(lambda it: batches_of(_merge(it, pick, spill_bytes), FINAL), "len int, text_sha256 string, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, keep: str = "smallest", spill_bytes: int = 24 << 20) -> DataFrame:
    """Every document with the identifier that stays of its group: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = lower_az(F.col("text"))
    mine = docs.select("doc_id", norm.alias("t")).select("doc_id", F.octet_length("t").alias("len"), F.sha2("t", 256).alias("text_sha256"))
    joined = mine.join(owners(docs, keep, spill_bytes), ["len", "text_sha256"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
