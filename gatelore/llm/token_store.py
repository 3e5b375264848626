"""Binary token output with constant-time keyed access.

Documents are dealt by ranges of doc_id, so files follow that order. Each task encodes its documents and writes blocks: a
row of a Parquet table that holds the raw little-endian ids of up to ``block_ids`` tokens (two bytes an id where the
vocabulary allows it, else four) beside where each document begins and ends in them.

One index covers all shards: a key's hash names its bucket, and the bucket holds a minimal perfect hash over its keys:
levels of bit arrays, each key placed at the first level where no other key of that level shares its bit, its slot being
the number of set bits before it. A slot stores a fingerprint of its key, which turns away keys that were never stored,
and the shard, the block and the place in the block of the document. A look-up costs one equi-join on the bucket, a few bit
tests, and one equi-join on the block, however many documents there are.

Scale: one range shuffle of texts, by doc_id and then by a hash of the text, so that rows that share a doc_id, or have
none, are dealt out too; a block is bounded by ``block_ids`` or one document, a bucket by the spread of hashes around
``bucket_keys``; shard totals (a row per task) are all that reaches the driver, to place shards behind one another. Blocks
and index are written by Spark's own committed write into the shared folder, so a lost executor repeats single tasks and
readers never see half a block.

Defined results: null text is the end id alone; rows with a null doc_id come first and are stored under keys of their
own; rows that repeat a doc_id are each stored, the key being (doc_id, which repeat), counted from 0 through all shards; an
empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelore.llm.common import stage
from gatelore.llm.tokens import encoder, public_vocabulary

#: keys: doc_id and repeat within the shard of each document, the first ``no_id`` without doc_id. bounds: begin and end of each.
BLOCK = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("start_in_shard", pa.int64()),
        ("n_ids", pa.int64()),
        ("keys", pa.binary()),
        ("no_id", pa.int32()),
        ("bounds", pa.binary()),
        ("width", pa.int32()),
        ("payload", pa.binary()),
    ]
)
BLOCK_SQL = "shard int, block int, start_in_shard long, n_ids long, keys binary, no_id int, bounds binary, width int, payload binary"
BUCKET = pa.schema([("bucket", pa.int64()), ("level_bits", pa.list_(pa.int64())), ("levels", pa.binary()), ("fingerprints", pa.binary()), ("places", pa.binary()), ("copies", pa.int32())])
BUCKET_SQL = "bucket long, level_bits array<long>, levels binary, fingerprints binary, places binary, copies int"
#: The odd constants of a 64-bit mixing function.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


def key_hashes(ids: np.ndarray, repeats: np.ndarray, no_id: int = 0) -> np.ndarray:
    """64-bit keys of (doc_id, repeat); the first ``no_id`` rows have no doc_id."""
    h = _mix(_mix(ids.astype(np.int64).view(np.uint64), 1) ^ repeats.astype(np.uint64), 2)
    h[:no_id] = _mix(repeats[:no_id].astype(np.uint64), 3)
    return h


def told_apart(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys of one bucket with equal ones told apart: of documents that share a key the first by place keeps it, the others get keys of their own.

    Also the most documents of a key. Different doc_ids never share a key unless one of them repeats or is missing.
    """
    order = np.lexsort((*places.T[::-1], keys))
    same = np.append(False, keys[order][1:] == keys[order][:-1])
    if not same.any():
        return keys, 1
    begins = np.flatnonzero(~same)
    copy = np.empty(len(keys), np.int64)
    copy[order] = np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys))))
    return copy_key(keys, copy), int(copy.max()) + 1


def copy_key(keys: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return np.where(copy == 0, keys, _mix(keys ^ _mix(copy.astype(np.uint64), 6), 7))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, level_bits: list[int], bits: np.ndarray):
        self.level_bits, self.bits = level_bits, bits
        self.before = np.concatenate([[0], np.cumsum(bits)])
        self.base = [0, *accumulate(level_bits)]

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 1.5) -> PerfectHash:
        level_bits, parts, left, seed = [], [], np.unique(keys), 10
        while len(left):
            m = max(8, int(len(left) * spread))
            at = (_mix(left, seed) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            level_bits.append(m)
            parts.append(alone)
            left, seed = left[~alone[at]], seed + 1
        return cls(level_bits, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not stored, any slot or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for k, m in enumerate(self.level_bits):
            at = (_mix(keys[todo], 10 + k) % np.uint64(m)).astype(np.int64) + self.base[k]
            hit = self.bits[at]
            out[todo[hit]] = self.before[at[hit]]
            todo = todo[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 4) >> np.uint64(32)).astype("<u4")


def _write(batches: Iterator[pa.RecordBatch], vocabulary: str, block_ids: int) -> Iterator[pa.RecordBatch]:
    enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
    width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
    number = start = held = 0
    ids: list[int | None] = []
    repeats: list[int] = []
    ends: list[int] = []
    parts: list[bytes] = []
    last, repeat = object(), 0

    def closed():
        keys = np.array([[x or 0 for x in ids], repeats], dtype="<i8").T
        bounds = np.array([[0, *ends[:-1]], ends], dtype="<i8").T
        row = (shard, number, start, held, keys.tobytes(), sum(x is None for x in ids), bounds.tobytes(), width, b"".join(parts))
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, BLOCK)], schema=BLOCK)

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for first, found, stops in enc.encode(batch.column(1)):
            data, at = memoryview(found.astype(f"<u{width}")).cast("B"), 0
            for doc_id, stop in zip(doc_ids[first : first + len(stops)], stops.tolist()):
                n = stop - at
                if held and held + n > block_ids:
                    yield closed()
                    number, start, held, ids, repeats, ends, parts = number + 1, start + held, 0, [], [], [], []
                repeat = repeat + 1 if doc_id == last else 0
                last, held = doc_id, held + n
                ids.append(doc_id)
                repeats.append(repeat)
                ends.append(held)
                parts.append(bytes(data[width * at : width * stop]))
                at = stop
    if ids:
        yield closed()


def write_blocks(docs: DataFrame, vocabulary: str | None = None, block_ids: int = 1 << 20) -> DataFrame:
    """Write the ids of all documents, in order of doc_id, and return the table of blocks as read from its files."""
    vocabulary = vocabulary or public_vocabulary()
    salted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    dealt = salted.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return stage(dealt.mapInArrow(lambda it: _write(it, vocabulary, block_ids), BLOCK_SQL), "token-blocks")


class Keys:
    """The documents of one block: doc_id, repeat and place of each."""

    def __init__(self, keys: bytes, no_id: int, first_doc: int | None, first_repeat: int, bounds: bytes):
        self.doc_ids, repeats = np.frombuffer(keys, "<i8").reshape(-1, 2).T
        self.no_id, self.bounds = no_id, np.frombuffer(bounds, "<i8").reshape(-1, 2)
        # rows of the shard's first doc_id may go on from the shards before
        goes_on = np.arange(len(self.doc_ids)) < no_id if first_doc is None else (np.arange(len(self.doc_ids)) >= no_id) & (self.doc_ids == first_doc)
        self.repeats = repeats + first_repeat * goes_on
        self.hashes = key_hashes(self.doc_ids, self.repeats, no_id)


def _key_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            row = {n: b.column(n)[k].as_py() for n in b.schema.names}
            keys = Keys(row["keys"], row["no_id"], row["first_doc"], row["first_repeat"], row["bounds"])
            n = len(keys.hashes)
            bucket = (_mix(keys.hashes, 5) % np.uint64(buckets)).astype(np.int64)
            columns = bucket, keys.hashes.view(np.int64), np.full(n, row["shard"]), np.full(n, row["block"]), keys.bounds[:, 0], keys.bounds[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=["bucket", "hash", "shard", "block", "begin", "end"])


def _bucket(number: int, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    keys, copies = told_apart(keys, places)
    mph = PerfectHash.build(keys)
    slot = mph.slots(keys)
    prints, table = np.zeros(len(keys), "<u4"), np.zeros((len(keys), 4), "<i8")
    prints[slot], table[slot] = _fingerprint(keys), places
    row = number, mph.level_bits, np.packbits(mph.bits).tobytes(), prints.tobytes(), table.tobytes(), copies
    return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, BUCKET)], schema=BUCKET)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of the index from rows that are sorted by bucket; one bucket is held at a time."""
    held = np.zeros((0, 6), np.int64)
    for b in batches:
        held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)])
        cuts = np.append(np.flatnonzero(held[1:, 0] != held[:-1, 0]) + 1, len(held))
        for x, y in zip([0, *cuts[:-2]], cuts[:-1]):
            yield _bucket(int(held[x, 0]), held[x:y, 1].view(np.uint64), held[x:y, 2:])
        held = held[cuts[-2] if len(cuts) > 1 else 0 :].copy()
    if len(held):
        yield _bucket(int(held[0, 0]), np.ascontiguousarray(held[:, 1]).view(np.uint64), held[:, 2:])


class Store:
    """A token store: its blocks with where their shards begin, and its index (of so many ``buckets``)."""

    def __init__(self, blocks: DataFrame, index: DataFrame, buckets: int):
        self.blocks, self.index, self.buckets = blocks, index, buckets


def shard_starts(blocks: DataFrame) -> DataFrame:
    """Per shard: the ids before it, its first doc_id, and how many rows of that doc_id earlier shards hold. One row per write task reaches the driver."""
    own = blocks.select("shard", "block", "n_ids", "no_id", "keys").mapInArrow(_shard_rows, "shard int, block int, n long, docs long, first long, last long, lasts long")
    base, run, count, rows = 0, object(), 0, []
    for r in sorted(own.groupBy("shard").agg(F.sum("n").alias("n"), F.min_by(F.struct("first"), "block")["first"].alias("first"), F.max_by(F.struct("last", "lasts"), "block").alias("tail")).collect(), key=lambda r: r.shard):
        before = count if run == r.first else 0
        rows.append((r.shard, base, r.first, before))
        base += r.n
        run, count = r.tail["last"], r.tail["lasts"] + (before if r.tail["last"] == r.first else 0)
    return blocks.sparkSession.createDataFrame(rows, "shard int, base long, first_doc long, first_repeat long")


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: its first and last doc_id and how many rows of the last one its shard has so far."""
    for b in batches:
        rows = []
        for shard, block, n, no_id, keys in zip(*(c.to_pylist() for c in b.columns)):
            doc_ids, repeats = np.frombuffer(keys, "<i8").reshape(-1, 2).T
            known = len(doc_ids) > no_id
            rows.append((shard, block, n, len(doc_ids), None if no_id else int(doc_ids[0]), int(doc_ids[-1]) if known else None, int(repeats[-1]) + 1))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.int64()] * 5))], names=["shard", "block", "n", "docs", "first", "last", "lasts"]
            )


def write_store(docs: DataFrame, vocabulary: str | None = None, block_ids: int = 1 << 20, bucket_keys: int = 50_000) -> Store:
    """Write the blocks and the index over them."""
    blocks = write_blocks(docs, vocabulary, block_ids)
    placed = blocks.join(F.broadcast(shard_starts(blocks)), "shard")
    n = placed.select(F.sum(F.octet_length("keys") / 16).alias("n")).first().n or 0
    buckets = int(n // bucket_keys) + 1
    keys = placed.select("shard", "block", "keys", "no_id", "bounds", "first_doc", "first_repeat").mapInArrow(
        lambda it: _key_rows(it, buckets), "bucket long, hash long, shard long, block long, begin long, end long"
    )
    index = stage(keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_buckets, BUCKET_SQL), "token-index")
    return Store(placed, index, buckets)


def _probe(row: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of keys in one bucket, the fingerprints and the places by slot."""
    bits = np.unpackbits(np.frombuffer(row["levels"], np.uint8), count=sum(row["level_bits"])).astype(bool)
    slot = PerfectHash(row["level_bits"], bits).slots(keys)
    return slot, np.frombuffer(row["fingerprints"], "<u4"), np.frombuffer(row["places"], "<i8").reshape(-1, 4)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows beside the keys asked of them: the place of each key that is stored."""
    for b in batches:
        for k in range(b.num_rows):
            row = {n: b.column(n)[k].as_py() for n in ("doc_id", "hash", *BUCKET.names[1:])}
            for copy in range(row["copies"]):
                asked = copy_key(np.array(row["hash"], np.int64).view(np.uint64), np.full(len(row["hash"]), copy))
                slot, prints, table = _probe(row, asked)
                hit = (slot >= 0) & (prints[slot] == _fingerprint(asked))
                doc_ids = np.array(row["doc_id"], np.int64)[hit]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (doc_ids, *table[slot[hit]].T)], names=["doc_id", "shard", "block", "begin", "end"])


def _hashed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = key_hashes(b.column(0).to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64)), pa.array((_mix(h, 5) % np.uint64(buckets)).astype(np.int64))], names=["doc_id", "hash", "bucket"])


def find(store: Store, keys: DataFrame) -> DataFrame:
    """Where the documents in ``keys`` (column doc_id; null is no key) may lie: doc_id, shard, block, begin, end.

    Unknown keys give no row, but for one in 2**32; a key that another document shares gives a row for each: :func:`lookup` holds places against the blocks' doc_ids.
    """
    buckets = store.buckets
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().mapInArrow(lambda it: _hashed(it, buckets), "doc_id long, hash long, bucket long")
    lists = asked.groupBy("bucket").agg(F.collect_list("doc_id").alias("doc_id"), F.collect_list("hash").alias("hash"))
    return lists.join(store.index, "bucket").select("doc_id", "hash", *BUCKET.names[1:]).mapInArrow(_find, "doc_id long, shard long, block long, begin long, end long")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            stored = {(int(x), int(y)): (int(i), j >= b.column("no_id")[k].as_py()) for j, ((i, _), (x, y)) in enumerate(zip(np.frombuffer(b.column("keys")[k].as_py(), "<i8").reshape(-1, 2), np.frombuffer(b.column("bounds")[k].as_py(), "<i8").reshape(-1, 2)))}
            places = [p for p in b.column("places")[k].as_py() if stored.get((p["begin"], p["end"])) == (p["doc_id"], True)]
            payload = np.frombuffer(b.column("payload")[k].as_py(), f"<u{b.column('width')[k].as_py()}")
            ids = [payload[p["begin"] : p["end"]].astype(np.int64) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array([p["doc_id"] for p in places], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def lookup(store: Store, keys: DataFrame) -> DataFrame:
    """The ids of the documents in ``keys`` (column doc_id): doc_id, ids. Of rows that repeat a doc_id the first is found."""
    places = find(store, keys).groupBy("shard", "block").agg(F.collect_list(F.struct("doc_id", "begin", "end")).alias("places"))
    return places.join(store.blocks, ["shard", "block"]).select("places", "keys", "no_id", "bounds", "width", "payload").mapInArrow(_slices, "doc_id long, ids array<long>")


ROW = ("hash", "doc_id", "block_start", "ids_crc32", "shard", "block", "begin", "end")


def _read(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Every document of each block, read from the payload."""
    for b in batches:
        for k in range(b.num_rows):
            row = {n: b.column(n)[k].as_py() for n in ("shard", "block", "keys", "no_id", "bounds", "first_doc", "first_repeat", "start_in_shard", "base", "width", "payload")}
            keys = Keys(row["keys"], row["no_id"], row["first_doc"], row["first_repeat"], row["bounds"])
            payload = memoryview(np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")).cast("B")
            begin, end = (np.ascontiguousarray(c) for c in keys.bounds.T)
            n = len(begin)
            columns = {
                "bucket": (_mix(keys.hashes, 5) % np.uint64(buckets)).astype(np.int64),
                "hash": keys.hashes.view(np.int64),
                "doc_id": pa.array([None if i < row["no_id"] else x for i, x in enumerate(keys.doc_ids.tolist())], pa.int64()),
                "block_start": np.full(n, row["base"] + row["start_in_shard"]),
                "ids_crc32": np.array([zlib.crc32(payload[4 * x : 4 * y]) for x, y in zip(begin.tolist(), end.tolist())], np.int64),
                "shard": np.full(n, row["shard"]),
                "block": np.full(n, row["block"]),
                "begin": begin,
                "end": end,
            }
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents beside their bucket of the index: each is looked up by its key, and must lie where the index says."""
    for b in batches:
        for k in range(b.num_rows):
            row = {n: b.column(n)[k].as_py() for n in BUCKET.names[1:]}
            docs = b.column("docs")[k].values
            read = {n: docs.field(n) for n in ROW}
            keys = read["hash"].to_numpy(zero_copy_only=False).view(np.uint64)
            want = np.stack([read[n].to_numpy(zero_copy_only=False) for n in ROW[4:]], axis=1)
            keys, _ = told_apart(keys, want)
            slot, prints, places = _probe(row, keys)
            if (prints[slot] != _fingerprint(keys)).any() or (places[slot] != want).any():
                raise ValueError("the index and the blocks of the store differ")
            begin, end = places[slot, 2], places[slot, 3]
            start = pa.array(read["block_start"].to_numpy(zero_copy_only=False) + begin)
            yield pa.RecordBatch.from_arrays([read["doc_id"], start, pa.array(end - begin), read["ids_crc32"]], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(store: Store) -> DataFrame:
    """Every stored document, read from the blocks and looked up by its key: doc_id, start, n_tokens, ids_crc32."""
    buckets = store.buckets
    rows = store.blocks.mapInArrow(lambda it: _read(it, buckets), "bucket long, " + ", ".join(f"{n} long" for n in ROW))
    lists = rows.groupBy("bucket").agg(F.collect_list(F.struct(*ROW)).alias("docs"))
    joined = lists.join(store.index, "bucket").select("docs", *BUCKET.names[1:])
    return joined.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
