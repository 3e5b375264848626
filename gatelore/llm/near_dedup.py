"""Near duplicates: an inverted join of MinHash signature coordinates, confirmed on full shingle sets.

1. Each document becomes the set of its 64-bit hashed word shingles and a signature of ``COORDINATES`` minima. Documents
   with equal sets form one class, which its smallest doc_id stands for from here on.
2. Representatives are posted under each (coordinate, value). Two signatures that agree in ``MATCHES`` coordinates share a
   posting among the ``PREFIX_KEYS`` rarest of each (rarity is one order for all): only those are merged, and the long lists are
   skipped. Lists of one are dropped.
3. Each list is merged around its most central member (the one whose lists are longest in all). For each pair so met that
   sizes don't rule out, collisions are counted over all coordinates, from sixteen bits of each, and pairs with ``MATCHES``
   or more go on to be confirmed on full sets, read again from the texts.
4. Lists whose members are all in one component need no more. In other short lists every pair across components is counted
   and confirmed. The members of long ones are joined exactly instead, by the prefixes of their sets in order of rarity:
   sets that reach the threshold must share a shingle within those prefixes.
5. Components of the confirmed links are found by alternating stars.

At a similarity of exactly 0.75 fewer than 20 of 48 coordinates agree with probability 2e-7, and more rarely the more alike
two documents are; only such pairs can be missed. Whatever reaches the count is decided exactly.

Scale: hot groups do not make pairs. Copies collapse before anything is joined; a list of m near copies costs m pairs with
its centre; joins on hot keys have a staged small side, so that adaptive execution can split them. Only texts of documents
in some pair are shuffled: a bitmap sent to the scan keeps most others back. Intermediate tables are written to the shared
folder, so lost executors repeat single steps.

Defined results: null text and texts without words have n_shingles 0 and link with nothing; fewer words than a shingle
make one shingle of all; rows with a null doc_id link with nothing and have a null component; rows that repeat a doc_id
count as one document, which links where any of its texts does; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelore.llm.common import LOWER_BYTES, batches_of, discard, kept_by_worker, sliced, stage
from gatelore.llm.components import connected_components
from gatelore.llm.substring_dedup import marked

WORDS = 5
NUM, DEN = 75, 100
COORDINATES, MATCHES = 48, 20
PREFIX_KEYS = COORDINATES - MATCHES + 1
#: Lists up to this size are compared pair by pair, longer ones by prefixes of sets; both ways are exact.
SHORT_LIST = 12
CACHED_WORDS = 60_000
#: Odd multipliers of the hashes.
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of a text's hashed shingles."""
    found = (text or "").encode().translate(LOWER_BYTES).split()
    if not found:
        return np.zeros(0, np.uint64)
    known = kept_by_worker("hashes of words", _Words)
    if len(known) > CACHED_WORDS:
        known.clear()
    a = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    k = min(words, len(a))
    n = len(a) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * MULTIPLY + a[i : i + n]
    h = (h ^ (h >> np.uint64(32))) * MULTIPLY
    return np.unique(h ^ (h >> np.uint64(29)))


def signature(s: np.ndarray) -> np.ndarray:
    """The posting keys of a set: one for each coordinate, made of the coordinate's number and its least value."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(s), 512):
        np.minimum(least, (FACTORS[:, None] * s[None, first : first + 512] + ADDENDS[:, None]).min(axis=1), out=least)
    key = (least ^ (least >> np.uint64(31))) * MULTIPLY + np.arange(1, COORDINATES + 1, dtype=np.uint64)
    key = (key ^ (key >> np.uint64(30))) * MULTIPLY
    return (key ^ (key >> np.uint64(32))).view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in sliced(batches):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = shingles(text)
            if len(s):
                keys = signature(s)
                yield doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys, (keys & 0xFFFF).astype("<u2").tobytes()
            else:
                yield doc_id, 0, None, None, None


#: Shingles of sets that a worker keeps while it compares.
HELD_SHINGLES = 1 << 20


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    held: dict[tuple[int, int], np.ndarray] = {}
    size = 0

    def of(key: tuple[int, int], text: str | None) -> np.ndarray:
        nonlocal size
        if key not in held:
            if size >= HELD_SHINGLES:
                held.clear()
                size = 0
            held[key] = shingles(text)
            size += len(held[key])
        return held[key]

    for b in sliced(batches):
        for a, b_, ha, hb, ta, tb in zip(*(c.to_pylist() for c in b.columns)):
            x, y = of((a, ha), ta), of((b_, hb), tb)
            if len(x) and len(y):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                if DEN * both >= NUM * (len(x) + len(y) - both):
                    yield a, b_


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text, h (a hash of the text) of the documents in ``wanted`` (staged, column doc_id, distinct): one row for each text of a doc_id."""
    near = marked(docs.select("doc_id", "text"), wanted, "doc_id").filter("_in").drop("_in")
    return near.withColumn("h", F.xxhash64("text")).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "h"])


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    wanted = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    # a table of its own, so that adaptive execution may split the joins on a central document
    t = stage(texts_of(docs, wanted), "texts")
    one = t.select(F.col("doc_id").alias("a"), F.col("h").alias("ha"), F.col("text").alias("ta"))
    two = t.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"), F.col("text").alias("tb"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "hb", "ta", "tb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return rows.mapInArrow(lambda it: batches_of(_confirm(it), schema), "a long, b long").distinct()


def _matching(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in at least so many coordinates."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, COORDINATES) for c in ("xa", "xb"))
        keep = pa.array(np.flatnonzero((x == y).sum(axis=1) >= least))
        yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], names=["a", "b"])


def matching(signatures: DataFrame, pairs: DataFrame, least: int = MATCHES) -> DataFrame:
    """The pairs (a, b) with at least so many collisions; ``signatures``: rep, sig (sixteen bits of each coordinate)."""
    one, two = (signatures.select(F.col("rep").alias(k), F.col("sig").alias(f"x{k}")) for k in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb").mapInArrow(lambda it: _matching(it, least), "a long, b long").distinct()


def _ratio(n: str, m: str) -> str:
    return f"{DEN} * least({n}, {m}) >= {NUM} * greatest({n}, {m})"


BUCKETS = 1 << 18


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for t in b.column("text").to_pylist():
            np.add.at(total, (shingles(t) % np.uint64(BUCKETS)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


PREFIX = pa.schema([("h", pa.int64()), ("rep", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])


def _prefixes(batches: Iterator[pa.RecordBatch], counts) -> Iterator[pa.RecordBatch]:
    common = counts.value
    for b in batches:
        for rep, text, comp in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "comp"))):
            s = shingles(text)
            n = len(s)
            order = np.lexsort((s, common[(s % np.uint64(BUCKETS)).astype(np.int64)]))[: n - -(-NUM * n // DEN) + 1]
            k = len(order)
            yield pa.RecordBatch.from_arrays([pa.array(s[order].view(np.int64)), *(pa.array(np.full(k, v)) for v in (rep, comp, n)), pa.array(np.arange(k))], schema=PREFIX)


def _pairs_of_long_lists(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs across components, of the documents in ``members`` (rep, comp), that can reach the threshold: exact prefix join."""
    spark = docs.sparkSession
    wanted = stage(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    texts = texts_of(docs, wanted).join(members.select(F.col("rep").alias("doc_id"), "comp"), "doc_id")
    counts = np.zeros(BUCKETS, np.int64)
    for row in texts.select("text").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        counts[row.bucket] = row.n
    sent = spark.sparkContext.broadcast(counts)
    posted = stage(texts.mapInArrow(lambda it: _prefixes(it, sent), "h long, rep long, comp long, n long, pos long"), "prefixes")
    # of each shingle's list the largest component is only compared with the others, never within itself
    groups = posted.groupBy("h", "comp").agg(F.count("*").alias("k"))
    largest = stage(groups.groupBy("h").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("h", "main"), "main")
    open_ = posted.join(largest, "h")
    x = open_.filter("comp <> main").select("h", *[F.col(c).alias(f"{c}1") for c in ("rep", "comp", "n", "pos")])
    y = open_.select("h", "main", *[F.col(c).alias(f"{c}2") for c in ("rep", "comp", "n", "pos")])
    least = f"cast(ceil({NUM} * (n1 + n2) / {NUM + DEN}.0D) AS long)"  # of the intersection
    cond = f"comp1 <> comp2 AND (comp2 = main OR rep1 < rep2) AND {_ratio('n1', 'n2')} AND pos1 <= n1 - {least} AND pos2 <= n2 - {least}"
    return x.join(y, "h").filter(cond).select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(docs.mapInArrow(lambda it: batches_of(_sign(it), SIGNED, 2048), "doc_id long, n long, set_key binary, keys array<long>, sig binary"), "signatures")
    known = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stage(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stage(known.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"]).select(F.col("doc_id").alias("rep"), "n", "keys", "sig"), "reps")
    signatures = reps.select("rep", "sig")
    sizes = stage(reps.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    # postings that no other document has come first in the order and make no pairs; of the others the rarest fill up the prefix
    posted = reps.select("rep", F.explode("keys").alias("key")).join(sizes, "key")
    ranked = posted.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("size", "key"))).alias("lists"))
    prefix = ranked.select("rep", F.explode(F.expr(f"slice(lists, 1, greatest(0, {PREFIX_KEYS} - ({COORDINATES} - size(lists))))")).alias("p")).select("p.key", "rep", "p.size")
    shared = stage(prefix.join(reps.select("rep", "n"), "rep"), "postings")
    discard(sizes)

    central = stage(shared.groupBy("rep").agg(F.sum("size").alias("weight")), "central")
    pivots = stage(shared.join(central, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), F.col("n").alias("pn"))).alias("p")).select("key", (-F.col("p.minus")).alias("pivot"), "p.pn"), "pivots")
    met = shared.join(pivots, "key").filter("rep <> pivot AND " + _ratio("n", "pn"))
    star = stage(met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct(), "star")
    links = stage(confirmed(docs, stage(matching(signatures, star), "counted")), "links")
    discard(central, pivots)
    labels = stage(connected_components(links), "labels")

    tagged = stage(shared.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp")), "tagged")
    open_ = stage(tagged.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).filter("low <> high").select("key", "size"), "open")
    still = stage(tagged.join(open_, "key"), "still")
    discard(shared, tagged, open_)
    short = still.filter(f"size <= {SHORT_LIST}")
    one, two = (short.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("rep", "n", "comp")]) for i in (1, 2))
    few = one.join(two, "key").filter("rep1 < rep2 AND comp1 <> comp2 AND " + _ratio("n1", "n2")).select(F.col("rep1").alias("a"), F.col("rep2").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    members = stage(still.filter(f"size > {SHORT_LIST}").select("rep", "comp").distinct(), "members")
    far = _pairs_of_long_lists(docs, members).distinct().join(star, ["a", "b"], "left_anti")
    more = stage(matching(signatures, stage(few, "few")).union(far).distinct(), "more")
    late = stage(confirmed(docs, more), "late")
    discard(still, more, star)

    # the classes of one doc_id belong together
    twice = known.select("doc_id", "set_key").distinct().groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    own = known.join(twice, "doc_id").select("doc_id", "set_key").distinct().join(classes, "set_key").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).filter("a <> b")
    named = labels.select("node", "component")
    up = late.union(own).join(named.toDF("a", "ca"), "a", "left").join(named.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(up).toDF("component", "over")
    both = named.join(joined, "component", "left").select("node", F.coalesce("over", "component").alias("component"))
    # representatives that only the later links reach
    final = stage(both.union(joined.join(named.select(F.col("node").alias("component")), "component", "left_anti").toDF("node", "component")), "final")

    placed = signed.select("doc_id", "n", "set_key").join(classes, "set_key", "left").join(final.toDF("rep", "component"), "rep", "left")
    # a document that is no representative may still have been joined to others by its other text
    placed = placed.join(final.toDF("doc_id", "own"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "own", "rep", "doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
