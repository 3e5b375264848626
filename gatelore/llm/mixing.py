"""Mixing sources to target weights.

Every source may give up to ``most`` times its size; the mix has ``share`` times all sizes, dealt out by the sources'
weights, and what a source cannot give is dealt out again among the others until none is above what it has. Within a
source documents lie in the order of hash-random keys (a digest of seed, doc_id and text), sorted over ranges; running
sums of sizes over the ranges give each document its place, and the source's budget of whole words is cut exactly there:
complete passes over the source first (epochs), then documents in order, the last one in part.

Scale: one pass over the texts leaves a row of about 60 bytes a document; only such rows are sorted, over ranges, so a
source with most of the documents is many ranges. The tables of ranges and sources are joined by range and source and
carry the budgets. Targets take a few rounds of two sums over the table of sources; only those sums reach the driver.

Defined results: null text has size 0 and takes 0; an empty table gives an empty result; a source without words has
target 0; null is a source of its own, the last; rows with the same doc_id, text and source are interchangeable; extra
columns are ignored. The mix depends on rows and seed alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelore.llm.common import discard, stage
from gatelore.llm.ordered import group_key, group_places, running_sums

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """``sources`` (total, weight and others) with cap and target.

    The level is words per unit of weight; sources whose cap lies below it are full, and the level rises by what they leave.
    """
    capped = sources.withColumn("cap", most * F.col("total"))
    words = capped.agg(F.sum("total").alias("words"), F.sum("weight").alias("weight")).collect()[0]
    wanted, weight, n_full = share * (words.words or 0), words.weight or 0, 0
    left = wanted
    while True:
        full = F.col("weight") * F.lit(float(left)) > F.col("cap") * F.lit(float(weight))
        now = capped.filter(full).agg(F.count("*").alias("n"), F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).collect()[0]
        if now.n == n_full:
            break
        left, weight, n_full = wanted - now.cap, (words.weight or 0) - now.weight, now.n
    level = F.col("weight") * F.lit(float(left)) / F.lit(float(weight or 1))
    return capped.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(level))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words), epochs (complete passes over its source)."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    sized = stage(docs.select(F.col("doc_id").cast("long"), group_key(F.col("source"), "last").alias("grp"), key.alias("key"), words_in(F.col("text")).alias("size")), "sized")
    rows, bases = running_sums(sized, "grp", ["key", "size"], "size")
    places = group_places(bases, "grp")
    weight = F.array(*map(F.lit, weights))[(F.col("place") % len(weights)).cast("int")].cast("long")
    budgets = targets(places.withColumn("weight", weight), share, most).select("grp", "target", F.floor("target").alias("budget"))
    cuts = stage(bases.join(budgets, "grp"), "cuts")
    discard(sized, places)
    epochs = F.when(F.col("total") > 0, F.expr("budget div total")).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("total") - F.col("base") - F.col("local")
    return (
        rows.join(cuts, ["part", "grp"]).withColumn("epochs", epochs)
        .select("doc_id", F.when(F.col("grp") != "1", F.expr("substring(grp, 2)")).alias("source"), "size", F.col("total").alias("source_size"), "target",
                (F.col("epochs") * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))).alias("taken"), "epochs")
    )


def first_words(text: Column, n: Column) -> Column:
    """The text as far as the end of its ``n``-th word."""
    spans = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(spans, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: doc_id, epoch (from 0), text; a document's last copy is cut to the words that are left. Needs different doc_ids."""
    taken = plan.filter("taken > 0").select("doc_id", "size", "taken")
    copies = docs.select("doc_id", "text").join(taken, "doc_id").withColumn("epoch", F.explode(F.expr("sequence(0, int((taken - 1) div size))")))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    return copies.select("doc_id", "epoch", F.when(words == F.col("size"), F.col("text")).otherwise(first_words(F.col("text"), words)).alias("text"))
