"""Phrases whose words keep company, by Toivonen's sampling method.

A sample of pieces (a fixed share, drawn piece by piece) proposes phrases level by level: those that reach a lowered
threshold in the sample. A full pass then counts exactly what was proposed together with its negative border: every
phrase that wasn't proposed although its first words and its last words were; for single words the border is all other
words. A border phrase that turns out frequent was missed by the sample; it joins the proposed ones and one further full
pass counts what that adds to the border, and what that adds in turn: there a phrase counts as proposed as soon as it is
counted. All of them hold a missed phrase, so they are few. Then every frequent phrase has been counted.

Texts are handled as numpy arrays inside tasks: every word has two 64-bit keys, seeded by its language, and a phrase's
keys are made of its words' in order. A task counts keys in tiles and sends each key once with its number, so that one
frequent phrase is a row a task. Which phrases were proposed is told to tasks by bitmaps of the keys, one for each length,
of a size that ``filter_bits`` bounds: a wrong bit only makes a task count one phrase more, and results stay exact.

Scale: a few passes over the texts (the sample, one full pass, one if the border failed, one that names the phrases that a
look at the sample left unnamed); what is shuffled are counted keys, 25 bytes for each distinct one in a task. Only bitmaps reach the driver.

Defined results: null text has no words, a null language is ``und``; an empty table gives an empty result; rows with the
same or no doc_id count like others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelore.llm.common import LOWER_BYTES, discard, kept_by_worker, small_batches, stage

LONGEST = 5
SAMPLE_SHARE = 0.25
#: A phrase is proposed from this share of what the sample would hold of it at the threshold.
LOWERED = 0.4
FILTER_BITS = 26
TILE = 256 << 10
#: Counted keys that a task holds before it sends them.
HELD = 1 << 19
#: Phrases are named by one in so many of their occurrences in the sample first.
NAMED_BY = 8
#: Words of more bytes get their keys from a digest.
LONG_WORD = 64
COUNTED = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("m", pa.int32()), ("n", pa.int64())])
COUNTED_SQL = "k1 long, k2 long, m int, n long"

WORD, BLANK, BREAK = 0, 1, 2
#: What each byte is.
KINDS = np.zeros(256, np.uint8)
KINDS[[9, 32]] = BLANK
KINDS[[*b".,;:!?", *range(10, 14)]] = BREAK
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit keys spread over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lane:
    """One of the two key functions: random values for bytes, powers of an odd base for places, and their inverses."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, np.uint64)
        self.base = int(rng.integers(1, 1 << 62)) * 8 + 3
        self.step = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
        self.powers, self.inverses = self._series(self.base), self._series(pow(self.base, -1, 1 << 64))

    @staticmethod
    def _series(base: int) -> np.ndarray:
        out = np.ones(TILE + 1, np.uint64)
        out[1:] = np.uint64(base % (1 << 64))
        return np.multiply.accumulate(out)

    def words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Keys of words of up to LONG_WORD bytes; those of longer ones mean nothing."""
        out, i = np.zeros(len(begin), np.uint64), 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + TILE, "right")))
            a, b = begin[i:j] - begin[i], end[i:j] - begin[i]
            if b[-1] <= TILE:
                sums = np.zeros(b[-1] + 1, np.uint64)
                np.cumsum(self.values[data[begin[i] : end[j - 1]]] * self.powers[: b[-1]], out=sums[1:])
                out[i:j] = (sums[b] - sums[a]) * self.inverses[a] + (b - a).astype(np.uint64)
            i = j
        return _mix(out)

    def longer(self, phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
        return _mix(phrase * self.step + word)


def lanes() -> tuple[Lane, Lane]:
    return kept_by_worker("phrase keys", lambda: (Lane(1), Lane(2)))


def seeds_of(lang: str) -> tuple[int, int]:
    d = hashlib.blake2b(lang.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _stretches(text: bytes) -> list[bytes]:
    """A very long text in parts of whole pieces, of about a tile each where its pieces allow."""
    out, at = [], 0
    while len(text) - at > TILE:
        breaks = np.flatnonzero(KINDS[np.frombuffer(text, np.uint8, TILE, at)] == BREAK)
        if len(breaks):
            cut = at + int(breaks[-1]) + 1
        else:
            after = np.flatnonzero(KINDS[np.frombuffer(text, np.uint8, offset=at)] == BREAK)[:1]
            cut = at + int(after[0]) + 1 if len(after) else len(text)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


class Tile:
    """The words of some texts: where they begin and end, whether they continue the piece of the word before, their keys."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs, self.lower = langs, (b"\n".join(texts) + b"\n").translate(LOWER_BYTES)
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.data = np.frombuffer(self.lower, np.uint8)
        kind = KINDS[self.data]
        word = kind == WORD
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        edges = np.append(0, edges) if word[0] else edges
        self.begin, self.end = edges[0::2], edges[1::2]  # the last byte is a break, so every word ends
        self.pieces = np.cumsum(kind == BREAK, dtype=np.int32)
        piece = self.pieces[self.begin]
        self.joined = np.zeros(len(piece), bool)
        self.joined[1:] = piece[1:] == piece[:-1]
        self.text = np.searchsorted(self.starts, self.begin, "right") - 1

    def seeds(self, lane: int) -> np.ndarray:
        of = {x: seeds_of(x)[lane] for x in set(self.langs)}
        return np.array([of[x] for x in self.langs], np.uint64)

    def keys(self) -> list[np.ndarray]:
        """Both keys of every word."""
        out = [lane.words(self.data, self.begin, self.end) for lane in lanes()]
        for k in np.flatnonzero(self.end - self.begin > LONG_WORD).tolist():
            d = hashlib.blake2b(self.lower[self.begin[k] : self.end[k]], digest_size=16).digest()
            out[0][k], out[1][k] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")
        return [_mix(keys ^ self.seeds(j)[self.text]) for j, keys in enumerate(out)]

    def phrase(self, at: int, m: int) -> str:
        return b" ".join(self.lower[self.begin[k] : self.end[k]] for k in range(at, at + m)).decode()


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
    """Tiles of the columns lang and text, in their order."""
    texts, langs, size = [], [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            for part in _stretches(text.as_py() or b""):
                if size and size + len(part) > TILE:
                    yield Tile(texts, langs)
                    texts, langs, size = [], [], 0
                texts.append(part)
                langs.append(lang)
                size += len(part) + 1
    if texts:
        yield Tile(texts, langs)


def _has(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _levels(tile: Tile, told: list[np.ndarray], before: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For every length: where a phrase begins that is to be counted, and its keys.

    That is a phrase whose first words and last words are both ``told``; with ``before``, only what wasn't counted when
    that was told, where what is counted now is as good as told. Yields lengths from 1 to one more than is told.
    """
    words = tile.keys()
    n = len(words[0])
    places, keys, old = np.arange(n), words, np.ones(n, bool)
    for m in range(1, len(told) + 2):
        if m > 1:
            good = np.zeros(n + 1, bool)
            good[places[_has(told[m - 2], keys[0])]] = True
            old_good = np.zeros(n + 1, bool)
            if before is not None:
                old_good[places[old & _has(before[m - 2], keys[0])]] = True
                good[places[~old]] = True
            starts = np.flatnonzero(good[:-1] & good[1:] & np.append(tile.joined[1:], False))
            back = np.searchsorted(places, starts)
            keys = [lane.longer(k[back], w[starts + m - 1]) for lane, k, w in zip(lanes(), keys, words)]
            places, old = starts, old_good[starts] & old_good[starts + 1]
        if before is None:
            yield m, places, keys
        else:
            yield m, places[~old], [k[~old] for k in keys]


def _summed(k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per key (two, where different phrases share the first key: they are added up later)."""
    if not len(k1):
        return k1, k2, n
    order = np.argsort(k1)
    k1, k2 = k1[order], k2[order]
    firsts = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    return k1[firsts], k2[firsts], np.add.reduceat(n[order], firsts)


class Counts:
    """What a task has counted, by length of phrase."""

    def __init__(self):
        self.held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.size = 0

    def add(self, m: int, k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> None:
        row = _summed(k1, k2, n)
        self.held.setdefault(m, []).append(row)
        self.size += len(row[0])

    def full(self) -> bool:
        if self.size > 2 * HELD:
            for m in list(self.held):
                self.held[m] = [_summed(*map(np.concatenate, zip(*self.held.pop(m))))]
            self.size = sum(len(rows[0][0]) for rows in self.held.values())
        return self.size > HELD

    def batches(self) -> Iterator[pa.RecordBatch]:
        for m in list(self.held):
            k1, k2, n = _summed(*map(np.concatenate, zip(*self.held.pop(m))))
            columns = [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.full(len(n), m, np.int32)), pa.array(n)]
            yield from pa.Table.from_arrays(columns, schema=COUNTED).to_batches(max_chunksize=1 << 16)
        self.size = 0


def _count(batches: Iterator[pa.RecordBatch], told, before, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    told, before = told.value, before.value if before is not None else None
    for tile in _tiles(batches):
        if 0 in lengths:
            counts.add(0, tile.seeds(0), tile.seeds(1), np.bincount(tile.text, minlength=len(tile.langs)).astype(np.int64))
        for m, _, (k1, k2) in _levels(tile, told, before):
            if m in lengths:
                counts.add(m, k1, k2, np.ones(len(k1), np.int64))
        if counts.full():
            yield from counts.batches()
    yield from counts.batches()


def counted(texts: DataFrame, told: list[np.ndarray], lengths: tuple[int, ...], least: int, before: list[np.ndarray] | None = None) -> DataFrame:
    """Phrases of the given lengths (0: all words of a language) that occur ``least`` times: k1, k2, m, n; staged."""
    share = texts.sparkSession.sparkContext.broadcast
    now, old = share(told), share(before) if before is not None else None
    rows = texts.mapInArrow(lambda it: _count(it, now, old, lengths), COUNTED_SQL)
    return stage(rows.groupBy("k1", "k2", "m").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("m") == 0)), "counted")


def bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """The first ``bits`` bits of the phrases' keys as a bitmap; the driver gets its words, at most 2**(bits - 6)."""
    place = F.shiftrightunsigned("k1", 64 - bits)
    words = phrases.select(place.alias("p")).select(F.shiftright("p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p & 63 AS INT))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint8)


def _sampled(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """lang and text of doc_id, lang, text: the drawn pieces of each text."""
    least = np.uint64(min(int(share * 2.0**64), 2**64 - 1))
    for b in batches:
        langs, texts, ids = b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first in range(0, b.num_rows, 64):
            some = [t.as_py() or b"" for t in texts[first : first + 64]]
            tile = Tile(some, langs[first : first + 64])
            of_text = np.repeat(np.arange(len(some)), np.diff(np.append(tile.starts, len(tile.data))))
            number = (tile.pieces - tile.pieces[tile.starts][of_text]).astype(np.uint64)
            keep = _mix(_mix(ids[first : first + 64].view(np.uint64) + ODD)[of_text] + number) < least
            kept = tile.data[keep].tobytes()
            ends = np.cumsum(np.bincount(of_text[keep], minlength=len(some)))
            out = [kept[a:z] for a, z in zip(np.append(0, ends[:-1]), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(tile.langs), pa.array(out, pa.binary()).cast(pa.string())], names=["lang", "text"])


def _naming(told, wanted, one_in: int):
    return lambda batches: _name(batches, told, wanted, one_in)


def _name(batches: Iterator[pa.RecordBatch], told, wanted, one_in: int) -> Iterator[pa.RecordBatch]:
    """k1, k2, lang and phrase of phrases of two words or more that are wanted, from one in so many occurrences; a phrase is a row a task, or more where a task meets very many."""
    told, wanted, seen = told.value, wanted.value, set()
    for tile in _tiles(batches):
        rows = []
        for m, places, keys in _levels(tile, told[:-1]):
            if m == 1:
                continue
            good = _has(wanted[m - 1], keys[0])
            if one_in > 1:
                good &= _mix(keys[0] ^ places.astype(np.uint64)) % np.uint64(one_in) == 0
            good = np.flatnonzero(good)
            _, firsts = np.unique(keys[0][good], return_index=True)
            for k in good[firsts].tolist():
                key = keys[0][k].item(), keys[1][k].item()
                if key not in seen:
                    seen.add(key)
                    rows.append((*key, tile.langs[tile.text[places[k]]], tile.phrase(places[k], m)))
        if rows:
            k1, k2, langs, phrases = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)), pa.array(langs), pa.array(phrases)], names=["k1", "k2", "lang", "phrase"])
        if len(seen) > HELD:
            seen = set()


def named(texts: DataFrame, sample: DataFrame, frequent: DataFrame, told: list[np.ndarray]) -> DataFrame:
    """k1, k2, m, a, lang, phrase of all frequent phrases of two words or more, staged.

    Most are named by a few of their occurrences in the sample; a pass over the texts looks at all occurrences of those that are left.
    """
    phrases = frequent.filter("m > 1").select("k1", "k2", "m", F.col("n").alias("a"))
    bits, share = (len(told[0]) * 8).bit_length() - 1, texts.sparkSession.sparkContext.broadcast
    known, out, left = share(told), [], phrases
    for rows, one_in in ((sample, NAMED_BY), (texts, 1)):
        wanted = share([bitmap(left.filter(F.col("m") == m), bits) for m in range(1, LONGEST + 1)])
        names = rows.mapInArrow(_naming(known, wanted, one_in), "k1 long, k2 long, lang string, phrase string").distinct()
        out.append(stage(left.join(names, ["k1", "k2"]), "named"))
        left = stage(left.join(out[-1].select("k1", "k2"), ["k1", "k2"], "left_anti"), "unnamed")
        if left.isEmpty():
            break
    return reduce(DataFrame.union, out)


CUTS_SQL = "k1 long, k2 long, s1 long, s2 long, m int, a long, k int, l1 long, l2 long, r1 long, r2 long"


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every cut of every phrase (k1, k2, lang, phrase, m, a): the keys of its parts, and those of its language."""
    for b in batches:
        if not b.num_rows:
            continue
        m, own = b.column("m").to_numpy(zero_copy_only=False).astype(np.int64), [b.column(c).to_numpy() for c in ("k1", "k2")]
        tile = Tile([x.encode() for x in b.column("phrase").to_pylist()], b.column("lang").to_pylist())
        starts = np.cumsum(m) - m
        words = tile.keys()
        runs = [None, words]
        for length in range(2, LONGEST):
            runs.append([lane.longer(k[: len(w) - length + 1], w[length - 1 :]) if len(w) >= length else k[:0] for lane, k, w in zip(lanes(), runs[-1], words)])
        for size in range(2, LONGEST + 1):
            rows = np.flatnonzero(m == size)
            for k in range(1, size) if len(rows) else ():
                at = starts[rows]
                parts = [runs[k][0][at], runs[k][1][at], runs[size - k][0][at + k], runs[size - k][1][at + k]]
                seeds = [tile.seeds(j)[rows] for j in (0, 1)]
                columns = [*(x[rows] for x in own), *(x.view(np.int64) for x in seeds), m[rows].astype(np.int32), b.column("a").to_numpy()[rows], np.full(len(rows), k, np.int32), *(x.view(np.int64) for x in parts)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["k1", "k2", "s1", "s2", "m", "a", "k", "l1", "l2", "r1", "r2"])


def frequent_phrases(docs: DataFrame, least: int = 100, share: float = SAMPLE_SHARE, lowered: float = LOWERED, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, list[np.ndarray], int, DataFrame]:
    """All phrases of 1 to LONGEST words with at least ``least`` occurrences (k1, k2, m, n; m = 0: a language's words), bitmaps of them by length, the number of full passes, and the sample."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    texts = rows.select("lang", "text")
    sample = stage(rows.mapInArrow(lambda it: _sampled(it, share), "lang string, text string"), "sample")
    lowest = max(1, int(least * share * lowered))
    proposed, told, bits = [], [], 16
    for m in range(1, LONGEST):
        proposed.append(counted(sample, told, (m,), lowest))
        if m == 1:
            bits = min(filter_bits, max(bits, (64 * proposed[0].count()).bit_length()))
        told.append(bitmap(proposed[-1], bits))
    found = [counted(texts, told, tuple(range(LONGEST + 1)), least)]
    known = reduce(DataFrame.union, proposed).select("k1", "k2", "m")
    missed = stage(found[0].filter(F.col("m").between(1, LONGEST - 1)).join(known, ["k1", "k2", "m"], "left_anti"), "missed")
    if not missed.isEmpty():
        more = [old | bitmap(missed.filter(F.col("m") == m + 1), bits) for m, old in enumerate(told)]
        found.append(counted(texts, more, tuple(range(2, LONGEST + 1)), least, told))
    every = reduce(DataFrame.union, found)
    return every, [bitmap(every.filter(F.col("m") == m), bits) for m in range(1, LONGEST + 1)], len(found), sample


def collocations(docs: DataFrame, least: int = 100, best: int = 2000, **mining) -> DataFrame:
    """Each language's ``best`` phrases: lang, rank, phrase, a, l, r, n, score."""
    with small_batches(docs.sparkSession):
        frequent, told, _, sample = frequent_phrases(docs, least, **mining)
        phrases = named(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), sample, frequent, told)
        discard(sample)
    cuts = phrases.mapInArrow(_cuts, CUTS_SQL)
    left = frequent.filter("m > 0").select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("n").alias("l"))
    right = left.toDF("r1", "r2", "r")
    totals = frequent.filter("m = 0").select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "n")
    whole = stage(cuts.join(left, ["l1", "l2"]), "left")
    whole = stage(whole.join(right, ["r1", "r2"]).join(totals, ["s1", "s2"]), "cuts")
    exact = "CAST((CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS LONG)"
    lowest = whole.groupBy("k1", "k2").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r", "n")).alias("cut"))
    inside = whole.filter("k = m - 1 AND l <= a").select(F.col("l1").alias("k1"), F.col("l2").alias("k2"))
    inside = inside.union(whole.filter("k = 1 AND r <= a").select("r1", "r2")).distinct()
    kept = phrases.join(lowest, ["k1", "k2"]).join(inside, ["k1", "k2"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score", F.pmod("k1", F.lit(64)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
