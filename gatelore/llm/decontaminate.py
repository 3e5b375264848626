"""Benchmark decontamination by suffix arrays over the training documents.

Every task turns a bounded run of training documents (a shard) into one array of word numbers, sorts the suffixes of that
shard that can matter and binary-searches every test suffix in it (equal ones once). A range of the sorted suffixes that
equals a test suffix for a whole window gives verbatim matches and their places in document and item; matches that follow
each other on one diagonal (same item, same distance between the places) are one longer match. Affected documents can then
be removed.

Only suffixes whose first ``window`` words are all linked by word pairs that some test window has can match, so others
are dropped before the sort: an exact filter, which leaves a small share of the corpus to sort. Suffixes are ordered to
the depth of the window; how far a match goes on is read off its diagonal, of which only both ends are laid out, so a
text and an item that repeat one word cost their words, not the product.

Scale: documents are never shuffled; each shard is searched where it was read. The benchmark is read in blocks of at most
``block_chars`` characters (or one item). One block, the usual case, takes one pass. More blocks take one pass each, whose
hits are written to the shared folder before the block is dropped, so memory holds one block at a time.

Defined results: words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased; null text
has no words; an item without words has no window; an item shorter than the window is one window of its own length; a
null item_id still marks words but is not listed; items repeated under one id count once; repeated document rows get
equal answers; other columns, whatever their names, pass untouched through :func:`remove_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelore.llm.common import sliced, stage

#: bytes.translate table: A-Z to a-z, all that is not part of a word to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class TestSuffixes:
    """One block of benchmark items, ready to be searched for: its windows by length, each with all its places in the items."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        self.starts: list[int] = []
        by_length: dict[int, dict[tuple, list[int]]] = {}
        at = 0
        for item_id, words in dict.fromkeys((item_id, tuple(words_of(text))) for item_id, text in items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            m = min(window, len(ids))
            if m:
                self.ids.append(None if item_id is None else str(item_id))
                self.starts.append(at)
                for q in range(len(ids) - m + 1):
                    by_length.setdefault(m, {}).setdefault(tuple(ids[q : q + m]), []).append(at + q)
                at += len(ids) + 1
        self.groups = []
        for m, windows in sorted(by_length.items()):
            rows = np.array(list(windows), dtype=np.int64).reshape(-1, m)
            pairs = np.unique((rows[:, :-1] << 32 | rows[:, 1:]).ravel()) if m > 1 else np.unique(rows)
            counts = np.array([len(q) for q in windows.values()])
            where = np.array([q for v in windows.values() for q in v])
            self.groups.append((m, pairs, _keys(rows), Places(counts, where, -1), Places(counts, where, 1)))


class Places:
    """Where each window lies in the items, sorted by window and by the window that lies beside it (``step`` -1: before, 1: behind)."""

    def __init__(self, counts: np.ndarray, where: np.ndarray, step: int):
        self.step, self.counts, self.first = step, counts, np.cumsum(counts) - counts
        window = np.repeat(np.arange(len(counts)), counts)
        by_place = np.argsort(where)
        at = np.minimum(np.searchsorted(where[by_place], where + step), len(where) - 1)
        beside = np.where(where[by_place][at] == where + step, window[by_place][at], -1)
        key = self._key(window, beside)
        order = np.argsort(key, kind="stable")
        self.keys, self.where = key[order], where[order]

    def _key(self, window: np.ndarray, beside: np.ndarray) -> np.ndarray:
        return window * (len(self.counts) + 1) + beside + 1

    def ends(self, places: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in the shard and a place in the items that hold one window, and whose neighbours differ or are missing: where matches begin (or end). By diagonal and place."""
        near = np.roll(places, -self.step) == places + self.step
        near[-1 if self.step > 0 else 0] = False
        beside = np.where(near, np.roll(windows, -self.step), -1)
        low, high = self.first[windows], self.first[windows] + self.counts[windows]
        key = self._key(windows, beside)
        same, past = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        same, past = np.where(near, same, high), np.where(near, past, high)
        low, n = np.concatenate([low, past]), np.concatenate([same - low, high - past])
        p = np.repeat(np.concatenate([places, places]), n)
        q = self.where[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        order = np.lexsort((p, q - p))
        return p[order], q[order]


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort in the same order."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def _runs(ok: np.ndarray, n: int) -> np.ndarray:
    """Where n consecutive flags begin that are all set."""
    if n == 0 or len(ok) < n:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(ok)])
    return np.flatnonzero(total[n:] - total[:-n] == n)


def search_shard(shard: np.ndarray, tests: TestSuffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
    """For each window length m: the places in the shard that equal a test window, that window's number, and where windows lie in the items."""
    for m, pairs, wanted, *places in tests.groups:
        if m > 1:
            code = shard[:-1] << 32 | shard[1:]
            at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
            starts = _runs(pairs[at] == code, m - 1)
        else:
            starts = np.flatnonzero(np.isin(shard, pairs))
        if not len(starts):
            continue
        keys = _keys(shard[starts[:, None] + np.arange(m)])
        order = np.argsort(keys, kind="stable")
        suffixes = keys[order]
        low, high = np.searchsorted(suffixes, wanted, "left"), np.searchsorted(suffixes, wanted, "right")
        n = high - low
        found = np.flatnonzero(n)
        if len(found):
            n = n[found]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[found], n)
            at = order[inside]
            yield m, starts[at], np.repeat(found, n), tuple(places)


def _diagonals(places: np.ndarray, windows: np.ndarray, before: Places, behind: Places, m: int) -> tuple[np.ndarray, ...]:
    """Matches that can't be prolonged by a neighbouring one: place in the shard, place in the items, length in words. ``places`` rise.

    Only where matches begin and end is laid out, not what lies between: on one diagonal these take turns.
    """
    p, q = before.ends(places, windows)
    last, _ = behind.ends(places, windows)
    return p, q, last - p + m


class Found:
    """What one text shares with the block: word intervals of its windows, items, and its longest verbatim matches."""

    __slots__ = ("spans", "items", "matches")

    def __init__(self):
        self.spans, self.items, self.matches = [], set(), []


def _scan_texts(texts: list[str | None], tests: TestSuffixes) -> list[Found]:
    """The texts of one shard. Documents are kept apart by the number 0."""
    get, shard, begins = tests.vocab.get, [], []
    for t in texts:
        begins.append(len(shard))
        shard += [get(w, 0) for w in words_of(t)]
        shard.append(0)
    found = [Found() for _ in texts]
    array, begins = np.array(shard, dtype=np.int64), np.array(begins, dtype=np.int64)
    starts = np.array(tests.starts)
    for m, places, windows, occurrences in search_shard(array, tests):
        order = np.argsort(places, kind="stable")
        places, windows = places[order], windows[order]
        docs = np.searchsorted(begins, places, "right") - 1
        for d, p in zip(docs.tolist(), (places - begins[docs]).tolist()):
            found[d].spans.append((p, p + m))
        p, q, n = _diagonals(places, windows, *occurrences, m)
        docs, items = np.searchsorted(begins, p, "right") - 1, np.searchsorted(starts, q, "right") - 1
        for d, x, i, y, k in zip(docs.tolist(), (p - begins[docs]).tolist(), items.tolist(), (q - starts[items]).tolist(), n.tolist()):
            found[d].matches.append((x, tests.ids[i], y, k))
            if tests.ids[i] is not None:
                found[d].items.add(tests.ids[i])
    return found


def _scan(batches: Iterator[pa.RecordBatch], block, shard_chars: int) -> Iterator[tuple[pa.RecordBatch, list[Found]]]:
    """Slices of the batches (which have a column ``text``) with what each row shares with the block."""
    for b in sliced(batches, 2048):
        texts, first = b.column("text").to_pylist(), 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (size == 0 or size < shard_chars):
                size += len(texts[last] or "") + 1
                last += 1
            yield b.slice(first, last - first), _scan_texts(texts[first:last], block.value)
            first = last


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[TestSuffixes]:
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if held and size + len(row.text or "") > block_chars:
            yield TestSuffixes(held, window)
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text or "")
    yield TestSuffixes(held, window)


def _passes(spark, benchmark: DataFrame, window: int, block_chars: int) -> Iterator[tuple[object, bool]]:
    """Each block as a broadcast, and whether it is the only one. A block is dropped when the next one is asked for."""
    blocks = _blocks(benchmark, window, block_chars)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        yield spark.sparkContext.broadcast(block), True
        return
    while block is not None:
        sent = spark.sparkContext.broadcast(block)
        yield sent, False
        sent.destroy()
        block, more = more, next(blocks, None)


HITS = "dk binary, n_words long, spans array<struct<s:int,e:int>>, items array<string>, longest long"
SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _hits(batches: Iterator[pa.RecordBatch], block, shard_chars: int, all_rows: bool) -> Iterator[pa.RecordBatch]:
    """Of each row, or each row with hits: its first column, words, merged spans, items and longest match."""
    for b, found in _scan(batches, block, shard_chars):
        keep = [k for k, f in enumerate(found) if all_rows or f.spans]
        texts, some = b.column("text").take(pa.array(keep, pa.int64())).to_pylist(), [found[k] for k in keep]
        columns = [
            b.column(0).take(pa.array(keep, pa.int64())),
            pa.array([len(words_of(t)) for t in texts], pa.int64()),
            pa.array([[{"s": x, "e": y} for x, y in merged(f.spans)] for f in some], SPANS),
            pa.array([sorted(f.items) for f in some], pa.list_(pa.string())),
            pa.array([max((n for *_, n in f.matches), default=0) for f in some], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[b.schema.names[0], "n_words", "spans", "items", "longest"])


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_run long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [merged([(x["s"], x["e"]) for x in h or []]) for h in b.column("spans").to_pylist()]
        items = [sorted(set(i or [])) for i in b.column("items").to_pylist()]
        hit = [sum(y - x for x, y in h) for h in spans]
        columns = [
            b.column("key"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]), pa.array([h > 0 for h in hit]), b.column("longest"),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_run"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 2048):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(words_of(t)) for t in b.column(2).to_pylist()], pa.int64())], names=["key", "dk", "n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 8 << 20, shard_chars: int = 2 << 20) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, longest_run (words of its longest verbatim match)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text")
    parts = []
    for block, only in _passes(docs.sparkSession, benchmark, window, block_chars):
        if only:
            return rows.mapInArrow(lambda it: _report(_hits(it, block, shard_chars, True)), DIGEST)
        keyed = rows.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("dk"), "text")
        parts.append(stage(keyed.mapInArrow(lambda it, block=block: _hits(it, block, shard_chars, False), HITS).dropDuplicates(["dk"]), "hits"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    hits = hits.groupBy("dk").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.max("longest").alias("longest"))
    counted = rows.select("key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("dk"), "text").mapInArrow(_count, "key long, dk binary, n_words long")
    return counted.join(stage(hits, "hits"), "dk", "left").select("key", "n_words", "spans", "items", F.coalesce("longest", F.lit(0)).alias("longest")).mapInArrow(_report, DIGEST)


MATCHES = "doc_id long, doc_word long, item_id string, item_word long, n_words long"


def _matches(batches: Iterator[pa.RecordBatch], block, shard_chars: int) -> Iterator[pa.RecordBatch]:
    for b, found in _scan(batches, block, shard_chars):
        rows = [(doc_id, *m) for doc_id, f in zip(b.column(0).to_pylist(), found) for m in f.matches]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 2 else pa.int64()) for k, c in enumerate(zip(*rows))], names=["doc_id", "doc_word", "item_id", "item_word", "n_words"])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 8 << 20, shard_chars: int = 2 << 20) -> DataFrame:
    """Every verbatim match of a window or more that can't be prolonged: doc_id, doc_word, item_id, item_word, n_words."""
    rows, parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []
    for block, only in _passes(docs.sparkSession, benchmark, window, block_chars):
        part = rows.mapInArrow(lambda it, block=block: _matches(it, block, shard_chars), MATCHES)
        parts.append(part if only else stage(part, "matches"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _clean(batches: Iterator[pa.RecordBatch], block, shard_chars: int) -> Iterator[pa.RecordBatch]:
    for b, found in _scan(batches, block, shard_chars):
        yield b.take(pa.array([k for k, f in enumerate(found) if not f.spans], pa.int64()))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 8 << 20, shard_chars: int = 2 << 20) -> DataFrame:
    """``docs`` without the documents that hold any window of the benchmark."""
    for block, only in _passes(docs.sparkSession, benchmark, window, block_chars):
        kept = docs.mapInArrow(lambda it, block=block: _clean(it, block, shard_chars), docs.schema)
        docs = kept if only else stage(kept, "clean")
    return docs
