"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents are encoded, closed by an end id, and only those longer than a sequence are cut: into full pieces behind a
first piece that holds the rest. Packing needs no documents, only how many pieces there are of each length, and a length
is at most ``capacity``: one table of at most 2,048 counts. A bin is filled greedily with the largest length that fits;
then its smallest document is replaced by the two unpacked documents that fill its expanded gap more tightly, if there
are such. The bin so found is repeated while counts last, so the plan has a few thousand bin patterns whatever the number
of documents, and is worked out on the driver.

Each piece then finds its place from its rank among the pieces of its length. Ranks are made of an ordinal within its
input task and the counts of the tasks before, so no key gathers its rows in one task.

Scale: one pass of encoding; what is kept per piece is its identifiers, length and checksum (a staged table); one
shuffle by (task, length) for the ranks. A lost executor costs one task's encoding or one shuffle block.

Defined results: null text is the end id alone; an empty table gives an empty result; a null or repeated doc_id is
packed like any other, row by row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelore.llm.common import stage
from gatelore.llm.tokens import encoder, public_vocabulary

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("ordinal", pa.int64())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, ordinal long"


def _cut(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str) -> Iterator[pa.RecordBatch]:
    enc, task = encoder(vocabulary), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, dtype=np.int64)
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for row, ids, ends in enc.encode(batch.column(1)):
            data, rows, at = memoryview(ids).cast("B"), [], 0
            for doc_id, end in zip(doc_ids[row : row + len(ends)], ends.tolist()):
                n = end - at
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc_id, k, x, y - x, zlib.crc32(data[4 * (at + x) : 4 * (at + y)]), task, int(seen[y - x])))
                    seen[y - x] += 1
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)


def cut_documents(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """One row per piece, with the task that made it and its ordinal among that task's pieces of the same length."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _cut(it, capacity, vocabulary), PIECES_SQL)


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bin patterns and how often each is used; ``counts[n]`` is the number of pieces of length n."""
    left = counts.astype(np.int64).copy()
    sizes = np.arange(capacity + 1)
    plan: list[tuple[list[int], int]] = []
    while left.any():
        bin_, gap, taken = [], capacity, left
        taken = left.copy()
        fits = np.maximum.accumulate(np.where(taken > 0, sizes, 0))  # the largest length left, up to each size
        while gap and (s := int(fits[gap])):
            bin_.append(s)
            gap -= s
            taken[s] -= 1
            if not taken[s]:
                fits = np.maximum.accumulate(np.where(taken > 0, sizes, 0))
        if gap and len(bin_) > 1:
            small = bin_[-1]
            room = gap + small
            fits = np.maximum.accumulate(np.where(taken > 0, sizes, 0))
            a = np.flatnonzero(taken[: room + 1] > 0)
            b = fits[room - a]
            same = (b == a) & (taken[a] < 2)
            if same.any():
                b[same] = [fits[x - 1] if x else 0 for x in np.minimum(a[same], room - a[same])]
            total = np.where(b > 0, a + b, 0)
            if len(a) and total.max() > small:
                k = int(total.argmax())
                bin_ = bin_[:-1] + [int(a[k]), int(b[k])]
        used, times = np.unique(bin_, return_counts=True)
        n = int((left[used] // times).min())
        left[used] -= n * times
        plan.append((bin_, n))
    return plan


def _slots(plan: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """The plan by length and rank: the key (length, first rank) of each slot, its first sequence and its offset."""
    next_rank, sequence, out = np.zeros(capacity + 1, dtype=np.int64), 0, []
    for bin_, n in plan:
        offset = 0
        for s in bin_:
            out.append((s, int(next_rank[s]), sequence, offset))
            next_rank[s] += n
            offset += s
        sequence += n
    out.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


RANK_BITS = 50


def _place(batches: Iterator[pa.RecordBatch], slots) -> Iterator[pa.RecordBatch]:
    sizes, ranks, sequences, offsets = slots.value
    keys = sizes << RANK_BITS | ranks
    for b in batches:
        length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        at = np.searchsorted(keys, length << RANK_BITS | rank, "right") - 1
        placed = [pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
        yield pa.RecordBatch.from_arrays([*b.columns[:5], *placed], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def best_fit_pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stage(cut_documents(docs, capacity, vocabulary or public_vocabulary()), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row.length] = row["count"]
    slots = spark.sparkContext.broadcast(_slots(plan_bins(counts, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("ordinal")).alias("rank"))
    return ranked.mapInArrow(lambda it: _place(it, slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
