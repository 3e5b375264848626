"""Repeated substrings: every string of ``threshold`` tokens that starts at two places, by a depth-limited radix sort.

Tokens are bytes (400 of them) or words (51 of them). The suffixes of all texts are ordered only through their first
``threshold`` tokens, most significant digit first; groups that are still equal then are exactly the repeated windows. A
digit is a long string, so that few passes reach the depth, and suffixes that start side by side go through the passes as
one row:

1. The first digit of a suffix is the string of ``leader`` tokens, among those in its window, of the least hash (of equal
   ones the last). It is the same for equal windows, and neighbouring windows mostly share theirs, so one row stands for a
   run of windows. Groups of one leave the sort here: most of the corpus does.
2. Rows whose whole run of windows is equal form a group at full depth at once: all their windows are repeated.
3. The others are dealt by blocks of window places, the next digit being the string that all windows of a block share.
   Groups of one leave; blocks that are repeated as a whole are done.
4. In what is left single windows are compared: the last digit.

Strings are compared by two independent 64-bit hashes of their tokens within the group of their first digit.

A pass over the literal first bytes of every suffix would shuffle a row for each byte of text, eight times the text at least;
choosing the digit by content is what makes a row stand for some forty suffixes.

Scale: rows are counted by hash with partial aggregation, so neither thousands of copies nor periodic texts (whose leaders
repeat without end) gather in one task. A bitmap, sized by the number of repeated leaders up to a bound, is sent to the
scan and keeps unique leaders from being shuffled; what it lets through by chance forms groups of one. Texts are known by a
128-bit digest, so copies share one answer. Stages are written to the shared folder, so a lost executor repeats single tasks.

Defined results: null text is empty; texts shorter than the threshold lose nothing; repeated rows are copies of one another
and are removed whole (where long enough); a match never crosses documents; extra columns are ignored. Passages of words
count only where they occur under two doc_ids (rows without one are told apart by their text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelore.llm.common import batches_of, begin_step, discard, sliced, small_batches, stage


class Unit(NamedTuple):
    """What is compared: kind of token, tokens of a window, of a leader, window places of a block, and whether repeats inside a document count."""

    kind: str
    threshold: int
    leader: int
    block: int
    within: bool


BYTES = Unit("bytes", 400, 200, 16, True)
WORDS = Unit("words", 51, 26, 8, False)
#: Tokens handled at once (they and their sums stay in a processor's cache); texts beyond it are read in overlapping parts.
TILE = 1 << 16
#: Tokens whose sums are held at once when members of texts are compared.
STRETCH = 1 << 17
PLACE = np.uint64((1 << 20) - 1)
#: Bits of a filter for each key, and of any filter at most (16 MB).
BITS_A_KEY, MOST_BITS = 16, 27
#: Odd bases of two hashes and their inverses modulo 2**64, and random numbers for each byte.
BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
INVERSES = [pow(b, -1, 1 << 64) for b in BASES]
TABLES = np.random.default_rng(20240301).integers(0, 1 << 63, (2, 256), dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) <= n:
        held = _POWERS[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096), base, np.uint64)]), dtype=np.uint64)
    return held


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Sums:
    """Hashes of any stretches of a row of tokens, by one of the two bases."""

    def __init__(self, tokens: np.ndarray, which: int = 0):
        n = len(tokens)
        values = TABLES[which][tokens] if tokens.dtype == np.uint8 else tokens if which == 0 else _mix(tokens ^ TABLES[1, 0])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(BASES[which], n)[:n], out=self.sums[1:])
        self.inverse = _powers(INVERSES[which], n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, size: int) -> np.ndarray:
        """The hash of each stretch of ``size`` tokens."""
        return _mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])


def _combine(*parts) -> np.ndarray:
    h = np.full(1, 17, np.uint64)
    for p in parts:
        h = _mix(h * np.uint64(BASES[0]) + np.atleast_1d(p).astype(np.uint64))
    return h


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie side by side in ``data``, and where each text's words begin and end among them."""
    hashes, counts, k = [], np.zeros(len(bounds) - 1, np.int64), 0
    while k < len(counts):
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + TILE, "right")) - 1)
        at, end = int(bounds[k]), int(bounds[last])
        while at < end:
            stop = end
            if stop - at > 8 * TILE:  # a long text is cut at white space, if it has any
                gaps = np.flatnonzero(data[at + TILE : at + 8 * TILE] == 32)
                stop = at + TILE + int(gaps[-1]) if len(gaps) else end
            part = data[at:stop]
            ink = np.concatenate([[False], (part != 32) & ((part < 9) | (part > 13)), [False]])
            begins, ends = ink[1:-1] & ~ink[:-2], ink[1:-1] & ~ink[2:]
            cuts = bounds[(bounds > at) & (bounds < stop)] - at if last > k + 1 else np.zeros(0, np.int64)
            begins[cuts] = ink[1:-1][cuts]
            ends[cuts - 1] = ink[1:-1][cuts - 1]
            a, z = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            hashes.append(Sums(part).of(a, z))
            of = np.searchsorted(bounds[k : last + 1], a + at, "right") - 1 + k
            counts += np.bincount(of, minlength=len(counts))
            at = stop
        k = last
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def _tokens(texts: pa.Array, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a column of texts (bytes), side by side, and the bounds of each text in them."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    return (data, bounds) if unit.kind == "bytes" else _words(data, bounds)


def leaders(tokens: np.ndarray, bounds: np.ndarray, unit: Unit, keys: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows by their leader: text, leader hash, place of the leader, its largest and smallest distance behind a window's start, and the run's two hashes."""
    size, span = unit.threshold, unit.threshold - unit.leader + 1
    k = 0
    while k + 1 < len(bounds):
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + TILE, "right")) - 1)
        for start in range(int(bounds[k]), max(int(bounds[last]) - size + 1, int(bounds[k]) + 1), TILE):
            end = min(int(bounds[last]), start + TILE + size - 1)
            n = end - start
            if n < size:
                continue
            part = tokens[start:end]
            sums = Sums(part)
            h = sums.every(unit.leader)
            least, w = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64)), 1
            while 2 * w <= span:
                least, w = np.minimum(least[:-w], least[w:]), 2 * w
            windows = n - size + 1
            least = np.minimum(least[:windows], least[span - w : span - w + windows])
            lead = (PLACE - (least & PLACE)).astype(np.int64)
            # windows that cross the end of a text are none
            ok = np.ones(windows + 1, bool)
            for cut in (bounds[k + 1 : last] - start).tolist():
                ok[max(cut - size + 1, 0) : min(cut, windows)] = False
            ok[windows] = False
            fresh = ok[:-1].copy()
            fresh[1:] &= ~ok[:-2] | (lead[1:] != lead[:-1])
            stops = ok[:-1] & ~ok[1:]
            stops[:-1] |= ok[:-2] & ok[1:-1] & (lead[1:] != lead[:-1])
            first, final = np.flatnonzero(fresh), np.flatnonzero(stops)
            if not len(first):
                continue
            a = lead[first]
            text = np.searchsorted(bounds[k : last + 1], first + start, "right") - 1 + k
            run = [_combine(h[a], a - first, a - final, s.of(first, final + size)).view(np.int64) for s in ([sums, Sums(part, 1)] if keys else [])]
            yield text, h[a].view(np.int64), a + start - bounds[text], a - first, a - final, *run
        k = last


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _leads(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    begin_step("leaders of windows")
    for b in sliced(batches, 2048):
        who = b.column("who").to_numpy(zero_copy_only=False)
        found = [(lead, who[text]) for text, lead, *_ in leaders(*_tokens(b.column("text"), unit), unit, keys=False)]
        if found:
            yield _batch("lead who", *(np.concatenate(c) for c in zip(*found)))


RUNS = "dk binary, who long, lead long, run1 long, run2 long, at long, far long, near long"


def _runs(batches: Iterator[pa.RecordBatch], unit: Unit, bitmap) -> Iterator[pa.RecordBatch]:
    begin_step("runs of windows")
    bits = bitmap.value
    mask = np.int64(8 * len(bits) - 1)
    for b in sliced(batches, 2048):
        who = b.column("who").to_numpy(zero_copy_only=False)
        found = []
        for text, lead, at, far, near, run1, run2 in leaders(*_tokens(b.column("text"), unit), unit):
            place = lead & mask
            keep = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            found.append(tuple(c[keep] for c in (text, lead, run1, run2, at, far, near)))
        if found:
            text, *rest = (np.concatenate(c) for c in zip(*found))
            yield _batch("dk who lead run1 run2 at far near", b.column("dk").take(pa.array(text)), who[text], *rest)


def bitmap_bits(keys: int) -> int:
    """The power of two of a filter's size for so many keys; beyond the bound it lets more through, and results stay the same."""
    return min(MOST_BITS, max(15, (BITS_A_KEY * max(keys, 1) - 1).bit_length()))


def bitmap_of(keys: DataFrame, place, bits: int) -> DataFrame:
    """Rows of 4 KB that are a bitmap over the places (0 to 2**bits - 1) of the keys."""
    placed = keys.select((place + 1).alias("_p"))
    return placed.groupBy(F.expr("bitmap_bucket_number(_p)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_p))").alias("_bits"))


def collected_bitmap(keys: DataFrame, name: str, bits: int) -> np.ndarray:
    """The bitmap of a column of hashes by their low bits, as bytes on the driver: at most 2**MOST_BITS bits."""
    out = np.zeros(1 << bits - 3, np.uint8)
    for row in bitmap_of(keys, F.col(name).bitwiseAND((1 << bits) - 1), bits).collect():
        out[4096 * (row["_bucket"] - 1) : 4096 * row["_bucket"]] = np.frombuffer(row["_bits"], np.uint8)
    return out


def marked(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``_in``: false where ``name`` is surely not among the keys (a staged table)."""
    bits = bitmap_bits(keys.count())
    place = F.pmod(F.xxhash64(name), F.lit(1 << bits))
    placed = rows.withColumn("_p", place + 1).withColumns({"_bucket": F.expr("bitmap_bucket_number(_p)"), "_at": F.expr("bitmap_bit_position(_p)")})
    bit = F.expr("(cast(conv(hex(substring(_bits, cast(_at div 8 AS int) + 1, 1)), 16, 10) AS int) & shiftleft(1, cast(_at % 8 AS int))) <> 0")
    return placed.join(F.broadcast(bitmap_of(keys, place, bits)), "_bucket", "left").withColumn("_in", F.coalesce(bit, F.lit(False))).drop("_p", "_bucket", "_at", "_bits")


#: A row of the sort behind the first digit: its text, leader, place and window distances; how many equal rows it stands for, under which ids, and whether its windows are known to be repeated.
MEMBER = ["lead", "at", "far", "near", "n", "low", "high", "done"]


def _stretches(batches: Iterator[pa.RecordBatch], unit: Unit, columns: list[str]) -> Iterator[tuple]:
    """Members in stretches of their texts, which lie side by side: the texts' digests, the members' columns, two sums and the leaders' places in them."""
    for b in sliced(batches):
        tokens, bounds = _tokens(b.column("text"), unit)
        text = np.repeat(np.arange(b.num_rows), b.column("members").value_lengths().to_numpy(zero_copy_only=False))
        members = b.column("members").flatten()
        rows = {c: members.field(c).to_numpy(zero_copy_only=False) for c in columns}
        at = rows["at"] + bounds[text]
        of = at // STRETCH
        for s in np.unique(of).tolist():
            some = np.flatnonzero(of == s)
            first = max(0, s * STRETCH - unit.threshold)
            part = tokens[first : (s + 1) * STRETCH + unit.leader + unit.threshold]
            yield b.column("dk").take(pa.array(text[some])), {c: v[some] for c, v in rows.items()}, Sums(part), Sums(part, 1), at[some] - first


def _many(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low..high: which range, and each number in it."""
    n = high - low + 1
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n - low, n)


BLOCKS = "dk binary, lead long, at long, far long, near long, n long, low long, high long, done boolean, block long, part1 long, part2 long, whole1 long, whole2 long, full boolean"


def _blocks(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """For each block of window places of each member: hashes of what its windows share, and of all they cover (where the block is ``full``)."""
    begin_step("blocks of windows")
    size = unit.block
    for dk, rows, one, two, a in _stretches(batches, unit, MEMBER):
        of, block = _many(rows["near"] // size, rows["far"] // size)
        a, lead = a[of], rows["lead"][of].view(np.uint64)
        low, high = block * size, block * size + size - 1
        full = (low >= rows["near"][of]) & (high <= rows["far"][of])
        share = a - low, np.maximum(a + unit.leader, a - high + unit.threshold)
        cover = np.where(full, a - high, a), np.where(full, a - low + unit.threshold, a)
        keys = [_combine(lead, block, kind, s.of(*ends)).view(np.int64) for kind, ends in ((1, share), (2, cover)) for s in (one, two)]
        yield _batch("dk " + " ".join(MEMBER) + " block part1 part2 whole1 whole2 full", dk.take(pa.array(of)), *(rows[c][of] for c in MEMBER), block, *keys, full)


WINDOWS = "dk binary, s long, n long, low long, high long, done boolean, key1 long, key2 long"


def _windows(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    begin_step("single windows")
    for dk, rows, one, two, a in _stretches(batches, unit, [*MEMBER, "block"]):
        of, d = _many(np.maximum(rows["near"], rows["block"] * unit.block), np.minimum(rows["far"], rows["block"] * unit.block + unit.block - 1))
        lead, start = rows["lead"][of].view(np.uint64), a[of] - d
        keys = [_combine(lead, d, 3, s.of(start, start + unit.threshold)).view(np.int64) for s in (one, two)]
        yield _batch("dk s n low high done key1 key2", dk.take(pa.array(of)), rows["at"][of] - d, *(rows[c][of] for c in ("n", "low", "high", "done")), *keys)


def _with_texts(texts: DataFrame, members: DataFrame) -> DataFrame:
    """One row per text that has members, beside the list of them (bounded by the text's length)."""
    lists = stage(members.groupBy("dk").agg(F.collect_list(F.struct(*[c for c in members.columns if c != "dk"])).alias("members")), "member-lists")
    near = marked(texts.select("dk", "text"), lists.select("dk"), "dk").filter("_in").drop("_in").dropDuplicates(["dk"])
    return near.join(lists, "dk")


def repeated_spans(texts: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """dk, s, e: token intervals of repeated windows in the texts (columns dk, who, text as bytes; rows of one dk are copies)."""
    spark = texts.sparkSession
    size, block = unit.threshold, unit.block
    twice = "n > 1" if unit.within else "low < high"
    # what a group of rows stands for: how many, and the least and the greatest id
    totals = [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]
    single = [F.count("*").alias("n"), F.min("who").alias("low"), F.max("who").alias("high")]

    repeated = stage(texts.mapInArrow(lambda it: _leads(it, unit), "lead long, who long").groupBy("lead").agg(*single).filter(twice).select("lead"), "leaders")
    bitmap = spark.sparkContext.broadcast(collected_bitmap(repeated, "lead", bitmap_bits(repeated.count())))
    first = stage(texts.mapInArrow(lambda it: _runs(it, unit, bitmap), RUNS), "runs")
    run = ["lead", "run1", "run2"]
    groups = stage(first.groupBy(run).agg(*single, F.min(F.struct("dk", "at", "far", "near")).alias("one")).withColumn("done", F.expr(twice)), "groups")
    equal = stage(groups.filter("done").select(run), "equal")
    done = first.join(equal, run).select("dk", (F.col("at") - F.col("far")).alias("s"), (F.col("at") - F.col("near") + size).alias("e")).distinct()

    # leaders with rows that are not settled yet, and something to compare them with
    open_ = stage(groups.groupBy("lead").agg(F.sum("n").alias("rows"), F.min("done").alias("all_")).filter("rows > 1 AND NOT all_").select("lead"), "open")
    ones = groups.join(open_, "lead")
    settled = ones.filter("done").select("one.dk", "lead", "one.at", "one.far", "one.near", "n", "low", "high", "done")
    alone = ones.filter("NOT done AND n = 1").select("one.dk", "lead", "one.at", "one.far", "one.near", "n", "low", "high", "done")
    # equal rows that don't count as repeated (inside one document) go on one by one
    some = stage(ones.filter("NOT done AND n > 1").select(run), "some")
    own = first.join(some, run).select("dk", "lead", "at", "far", "near", F.lit(1).cast("long").alias("n"), F.col("who").alias("low"), F.col("who").alias("high"), F.lit(False).alias("done"))
    members = stage(settled.union(alone).union(own).distinct(), "members")
    blocks = stage(_with_texts(texts, members).mapInArrow(lambda it: _blocks(it, unit), BLOCKS), "blocks")
    whole_key, part_key, window_key = ["lead", "block", "whole1", "whole2"], ["lead", "block", "part1", "part2"], ["key1", "key2"]
    whole = stage(blocks.filter("full").groupBy(whole_key).agg(*totals).filter(twice).select(*whole_key, F.lit(True).alias("full"), F.lit(True).alias("solved")), "whole")
    judged = stage(blocks.join(whole, [*whole_key, "full"], "left").withColumn("solved", F.coalesce("solved", F.lit(False))), "judged")
    from_ = F.col("at") - F.col("block") * block
    by_block = judged.filter("solved AND NOT done").select("dk", (from_ - block + 1).alias("s"), (from_ + size).alias("e"))
    part = stage(judged.groupBy(part_key).agg(*totals, F.max(F.expr("NOT done AND NOT solved")).alias("unsolved")).filter(f"{twice} AND unsolved").select(part_key), "part")
    last = stage(judged.join(part, part_key).select("dk", *MEMBER, "block"), "last")
    windows = stage(_with_texts(texts, last).mapInArrow(lambda it: _windows(it, unit), WINDOWS), "windows")
    again = stage(windows.groupBy(window_key).agg(*totals).filter(twice).select(window_key), "again")
    by_window = windows.filter("NOT done").join(again, window_key).select("dk", "s", (F.col("s") + size).alias("e"))
    spans = stage(done.union(by_block).union(by_window), "spans")
    discard(repeated, first, groups, equal, open_, some, members, blocks, whole, judged, part, last, windows, again)
    return spans


REMOVED = pa.schema([("dk", pa.binary()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return s[first], e[np.concatenate([first[1:] - 1, [len(e) - 1]])]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    begin_step("removed bytes")
    for b in sliced(batches):
        for k, (dk, doc_id, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("dk", "doc_id", "text")))):
            s, e = merged(*(b.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in ("starts", "ends")))
            cuts, at = [], 0
            for x, y in zip(s.tolist(), e.tolist()):
                cuts.append(text[at:x])
                at = y
            cuts.append(text[at:])
            yield dk, doc_id, len(text), int((e - s).sum()), len(s), hashlib.sha256(b"".join(cuts)).hexdigest()


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin_step("passages")
    for b in batches:
        runs = [merged(*(b.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in ("starts", "ends"))) for k in range(b.num_rows)]
        yield _batch("dk n_passage_words n_passages", b.column("dk"), np.array([int((e - s).sum()) for s, e in runs], np.int64), np.array([len(s) for s, _ in runs], np.int64))


def _lists(spans: DataFrame) -> DataFrame:
    return spans.groupBy("dk").agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends"))


def remove_repeats(docs: DataFrame, unit: Unit = BYTES, passages: Unit = WORDS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the words and number of its passages that other documents hold."""
    long = lambda n: F.lit(n).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("dk", F.unhex(F.md5("text")))
    texts = rows.select("dk", F.coalesce("doc_id", F.xxhash64("dk")).alias("who"), "text")
    with small_batches(docs.sparkSession):
        shared = stage(_lists(repeated_spans(texts, passages)).mapInArrow(_passages, "dk binary, n_passage_words long, n_passages long"), "passages")
        lists = stage(_lists(repeated_spans(texts, unit)), "lists")
        split = marked(rows, lists, "dk")
        # what the bitmap let through by chance has no spans and loses nothing
        cut = split.filter("_in").join(lists, "dk", "left").select("dk", "doc_id", "text", "starts", "ends")
        changed = stage(cut.mapInArrow(lambda it: batches_of(_removed(it), REMOVED), "dk binary, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "cut")
    untouched = "dk", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), long(0).alias("n_removed"), long(0).alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
    out = changed.union(split.filter("NOT _in").select(*untouched))
    return out.join(shared, "dk", "left").na.fill(0, ["n_passage_words", "n_passages"]).drop("dk")
