"""Function-preserving rewriting of gates, its check over truth tables and on shared random vectors."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelore.operators import sweep
from gatelore.operators.edges import KEY
from gatelore.sources.staging import staged

#: Gate types that are rewritten, and what each computes; single-input gates pass through.
TRUTH = {
    "nand": lambda a, b: 1 - (a & b),
    "nor": lambda a, b: 1 - (a | b),
    "xnor": lambda a, b: 1 - (a ^ b),
    "xor": lambda a, b: a ^ b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}
REWRITTEN = list(TRUTH)
TWO_PER_TYPE = 2
#: Names in rules: the inputs and the output of the replaced gate; fresh nets are ``w`` and a number.
FIRST, SECOND, RESULT = "in0", "in1", "out"


def rule_rows(per_type: int = TWO_PER_TYPE) -> list[tuple[str, int, int, str, str, list[str]]]:
    """Equivalent circuits of each gate type: gtype, rule_id, step, out_gtype, out_sym, in_syms.

    Every circuit of one gate whose inputs and output may pass an inverter is tried on all four input pairs. Of those that
    agree with the type and hold another gate, the ``per_type`` shortest are its rules (equally short ones in the order of
    ``TRUTH``, then by which inputs are inverted).
    """
    pairs = list(itertools.product((0, 1), repeat=2))
    rows = []
    for gtype, wanted in TRUTH.items():
        found = []
        for place, (inner, value) in enumerate(TRUTH.items()):
            for x, y, z in itertools.product((0, 1), repeat=3):
                if inner != gtype and all(value(a ^ x, b ^ y) ^ z == wanted(a, b) for a, b in pairs):
                    found.append((x + y + z, place, x, y, z, inner))
        for rule, (_, _, x, y, z, inner) in enumerate(sorted(found)[:per_type]):
            fresh = (f"w{k}" for k in itertools.count())
            steps, ins = [], []
            for inverted, name in ((x, FIRST), (y, SECOND)):
                ins.append(next(fresh) if inverted else name)
                if inverted:
                    steps.append(("not", ins[-1], [name]))
            steps.append((inner, next(fresh) if z else RESULT, ins))
            if z:
                steps.append(("not", RESULT, [steps[-1][1]]))
            rows += [(gtype, rule, k, *step) for k, step in enumerate(steps)]
    return rows


def rewrite_rules(spark: SparkSession) -> DataFrame:
    """The rules as a table: at most ``TWO_PER_TYPE`` circuits for each of the six types."""
    return spark.createDataFrame(rule_rows(), "gtype string, rule_id int, step int, out_gtype string, out_sym string, in_syms array<string>")


def hashed_draw(seed: int, salt: str, *columns: str) -> Column:
    """A number in [0, 1) from the key alone, so that it does not depend on partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *columns), F.lit(1_000_000)) / 1e6


def next_free_ids(gates: DataFrame) -> DataFrame:
    """design_id, next_net, next_gate: one above the largest number in names n<k> and g<k>."""
    number = lambda c, letter: F.coalesce(F.max(F.regexp_extract(c, rf"^{letter}(\d+)", 1).try_cast("long")), F.lit(-1)) + 1
    return gates.groupBy("design_id").agg(number("out_net", "n").alias("next_net"), number("gate_name", "g").alias("next_gate"))


def rewrite(gates: DataFrame, pins: DataFrame, rate: float = 0.2, variants: int = 1, seed: int = 0, draw: Column | None = None, choice: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace a share of two-input gates by equivalent circuits; every variant of every design in one job.

    Returns the new gates (design_id, variant, gate_name, gtype, out_net, ins, old_gate) and the mapping from old gates to
    their replacements. Fresh names follow each design's largest number, by a running sum over its gates. ``draw`` (below
    ``rate``: rewrite) and ``choice`` (which rule) can be given as columns of gate and variant.
    """
    spark = gates.sparkSession
    ins = pins.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pin_pos", "net"))), lambda x: x["net"]).alias("ins"))
    every = spark.range(variants).select(F.col("id").alias("variant"))
    rows = gates.select(*KEY, "gate_name", "gtype", "out_net").join(ins, KEY, "left").crossJoin(F.broadcast(every))
    draw = hashed_draw(seed, "draw", "design_id", "variant", "gid") if draw is None else draw
    choice = F.floor(hashed_draw(seed, "rule", "design_id", "variant", "gid") * TWO_PER_TYPE).cast("int") if choice is None else choice
    fits = F.col("gtype").isin(REWRITTEN) & (F.coalesce(F.size("ins"), F.lit(0)) == 2)
    rows = rows.withColumn("rule_id", F.when(fits & (draw <= rate), choice))
    rules = rewrite_rules(spark)
    sizes = rules.groupBy("gtype", "rule_id").agg(F.count("*").alias("steps"), F.count_if(F.col("out_sym") != RESULT).alias("nets"))
    rows = rows.join(F.broadcast(sizes), ["gtype", "rule_id"], "left").na.fill(0, ["steps", "nets"])
    earlier = Window.partitionBy("design_id", "variant").orderBy("gid").rowsBetween(Window.unboundedPreceding, -1)
    free = next_free_ids(gates)
    rows = rows.join(free, "design_id").withColumns({"net0": F.col("next_net") + F.coalesce(F.sum("nets").over(earlier), F.lit(0)), "gate0": F.col("next_gate") + F.coalesce(F.sum("steps").over(earlier), F.lit(0))})
    kept = rows.filter("rule_id IS NULL").select("design_id", "variant", "gate_name", "gtype", "out_net", F.coalesce("ins", F.array().cast("array<string>")).alias("ins"), F.col("gate_name").alias("old_gate"))
    steps = rows.filter("rule_id IS NOT NULL").join(F.broadcast(rules), ["gtype", "rule_id"])
    name = lambda s: F.when(s == FIRST, F.col("ins")[0]).when(s == SECOND, F.col("ins")[1]).when(s == RESULT, F.col("out_net")).otherwise(F.concat(F.lit("n"), F.col("net0") + F.substring(s, 2, 3).try_cast("long")))
    made = steps.select("design_id", "variant", F.concat(F.lit("g"), F.col("gate0") + F.col("step")).alias("gate_name"), F.col("out_gtype").alias("gtype"), name(F.col("out_sym")).alias("out_net"), F.transform("in_syms", name).alias("ins"), F.col("gate_name").alias("old_gate"))
    out = kept.union(made)
    return out, out.select("design_id", "variant", "old_gate", F.col("gate_name").alias("new_gate"))


def remap_labels(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """design_id, variant, gate_name: each labelled gate's replacements."""
    named = labels.select("design_id", F.col("gate_name").alias("old_gate")).distinct()
    return mapping.join(named, ["design_id", "old_gate"], "left_semi").select("design_id", "variant", F.col("new_gate").alias("gate_name")).distinct()


def gate_value(gtype: Column, a: Column, b: Column) -> Column:
    """The bit of a gate of one or two inputs (``b`` null: one input)."""
    b = F.coalesce(b, a)
    both, any_, odd = a.bitwiseAND(b), a.bitwiseOR(b), a.bitwiseXOR(b)
    inverted = lambda x: 1 - x
    return (
        F.when(gtype == "and", both).when(gtype == "nand", inverted(both)).when(gtype == "or", any_).when(gtype == "nor", inverted(any_))
        .when(gtype == "xor", odd).when(gtype == "xnor", inverted(odd)).when(gtype == "not", inverted(a)).otherwise(a)
    )


def check_rules(spark: SparkSession) -> DataFrame:
    """gtype, rule_id, a, b, want, got of every rule over its whole truth table (twelve rules, four rows each)."""
    rules = rewrite_rules(spark).groupBy("gtype", "rule_id").agg(F.array_sort(F.collect_list(F.struct("step", "out_gtype", "out_sym", "in_syms"))).alias("steps"))
    table = spark.range(4).select((F.col("id") % 2).cast("int").alias("a"), F.floor(F.col("id") / 2).cast("int").alias("b"))
    rows = rules.crossJoin(table)

    def step(values, s):
        i = s["in_syms"]
        value = gate_value(s["out_gtype"], F.element_at(values, i[0]), F.when(F.size(i) > 1, F.element_at(values, F.try_element_at(i, F.lit(2)))))
        return F.map_concat(values, F.map_from_arrays(F.array(s["out_sym"]), F.array(value)))

    start = F.create_map(F.lit(FIRST), F.col("a"), F.lit(SECOND), F.col("b"))
    got = F.aggregate("steps", start, step, lambda m: F.element_at(m, RESULT))
    want = gate_value(F.col("gtype"), F.col("a"), F.col("b"))
    return rows.select("gtype", "rule_id", "a", "b", want.alias("want"), got.alias("got"))


def equivalence_words(gates: DataFrame, pins_of: DataFrame, keys: list[str], seed: int = 0, salt: list[str] | None = None) -> DataFrame:
    """keys, net, word: 64 random vectors packed in one long per net, settled through combinational gates as far as loops allow.

    ``gates``: keys, gate_name, gtype, out_net; ``pins_of``: keys, gate_name, net. Nets that no combinational gate drives
    (ports, constants, flip-flop outputs) are drawn by name, so equal names get equal vectors in two versions of a design.
    ``salt`` names keys that the vectors hang on, too: with a key that numbers words there are as many words of a net.
    """
    gates, pins_of = sweep.kept(gates), sweep.kept(pins_of)
    large = sweep.too_large(keys, gates, pins_of)
    (some, inner), rest = sweep.split(large, keys, gates, pins_of)
    out = _words_in_tasks(some, inner, keys, seed, salt)
    return out.unionByName(_words_by_rounds(*rest, keys, seed, salt)) if rest else out


def _drawn_word(keys: list[str], seed: int, salt: list[str] | None) -> Column:
    """The word of a net that no combinational gate drives."""
    return F.when(F.col("net") == "1'b0", F.lit(0)).when(F.col("net") == "1'b1", F.lit(-1)).otherwise(F.xxhash64(F.lit(seed), keys[0], "net", *(salt or []))).cast("long")


def _words_in_tasks(gates: DataFrame, pins_of: DataFrame, keys: list[str], seed: int, salt: list[str] | None) -> DataFrame:
    """All nets of a version settle in one task."""
    word = _drawn_word(keys, seed, salt)
    kinds = [
        gates.select(*keys, "gate_name", F.coalesce("gtype", F.lit("")).alias("t"), F.col("out_net").alias("net")).withColumn("word", word),
        pins_of.select(*keys, "gate_name", F.lit(None).cast("string").alias("t"), "net", word.alias("word")).filter("gate_name IS NOT NULL"),
    ]

    def work(key: tuple, table: pa.Table) -> dict:
        net = table.column("net").combine_chunks().dictionary_encode()
        name = table.column("gate_name").combine_chunks().dictionary_encode()
        types = table.column("t").combine_chunks().dictionary_encode()
        number = lambda x: x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at, of, kind = number(net), number(name), number(types)
        is_pin = kind < 0
        n, gates_, word = len(net.dictionary), len(name.dictionary), np.zeros(len(net.dictionary), np.int64)
        there = at >= 0
        word[at[there]] = table.column("word").to_numpy()[there]
        kinds_ = np.array([str(x) for x in types.dictionary.to_pylist()] + [""])[kind]
        comb = ~is_pin & (kinds_ != "dff") & (kinds_ != "") & (of >= 0)
        # each input net of a gate once, and how often it is there
        pairs, times = np.unique(of[is_pin & there] * n + at[is_pin & there], return_counts=True)
        pin_gate, pin_net = pairs // max(n, 1), pairs % max(n, 1)
        fed = np.bincount(pin_gate, minlength=gates_)
        # a pin without a net keeps its gate waiting
        nowhere = np.bincount(of[is_pin & ~there], minlength=gates_)
        open_ = fed + nowhere
        drives = comb & (np.append(open_, 0)[of] > 0)
        driven = np.zeros(n, bool)
        driven[at[drives & there]] = True
        loads = sweep.Ways(n, pin_net, pin_gate)
        first = np.append(0, np.cumsum(fed))
        out_of = np.flatnonzero(drives)
        rows = sweep.Ways(gates_, of[out_of], out_of)
        known, now = ~driven, np.flatnonzero(~driven)
        while len(now):
            reached = loads.reached(now)
            np.subtract.at(open_, reached, 1)
            ready = np.unique(reached[open_[reached] == 0])
            if not len(ready):
                break
            size = fed[ready]
            begins = np.cumsum(size) - size
            pins = np.arange(size.sum()) - np.repeat(begins, size) + np.repeat(first[ready], size)
            value = word[pin_net[pins]]
            every, any_, odd = np.bitwise_and.reduceat(value, begins), np.bitwise_or.reduceat(value, begins), np.bitwise_xor.reduceat(np.where(times[pins] % 2 == 1, value, 0), begins)
            which = rows.reached(ready)
            back = np.repeat(np.arange(len(ready)), rows.counts(ready))
            every, any_, odd, t = every[back], any_[back], odd[back], kinds_[which]
            cases = [(np.isin(t, ["and", "buf"]), every), (np.isin(t, ["nand", "not"]), ~every), (t == "or", any_), (t == "nor", ~any_), (t == "xor", odd)]
            new = np.select([c for c, _ in cases], [x for _, x in cases], ~odd)
            to = at[which]
            # of several drivers of one net the first round counts, of one round the least word
            fresh = (to >= 0) & ~known[np.maximum(to, 0)]
            to, new = to[fresh], new[fresh]
            order = np.lexsort((new, to))
            to, new = to[order], new[order]
            least = np.append(True, to[1:] != to[:-1])[: len(to)]
            now = to[least]
            word[now], known[now] = new[least], True
        return {"net": net.dictionary.take(pa.array(np.flatnonzero(known))), "word": word[known]}

    return sweep.in_tasks(kinds, keys, work, {"net": "string", "word": "long"})


def _words_by_rounds(gates: DataFrame, pins_of: DataFrame, keys: list[str], seed: int, salt: list[str] | None) -> DataFrame:
    comb = gates.filter("gtype <> 'dff'")
    driven = comb.join(pins_of.select(*keys, "gate_name"), [*keys, "gate_name"], "left_semi").select(*keys, F.col("out_net").alias("net"))
    nets = pins_of.select(*keys, "net").union(gates.select(*keys, "out_net")).distinct()
    word = _drawn_word(keys, seed, salt)
    known = staged(nets.join(driven, [*keys, "net"], "left_anti").select(*keys, "net", word.alias("word")))
    pins_of, comb = staged(pins_of.select(*keys, "gate_name", "net")), staged(comb.select(*keys, "gate_name", "gtype", "out_net"))
    # how many input nets each gate still waits for: every net reaches its gates once, in the round that settles it
    waits = staged(pins_of.groupBy(*keys, "gate_name", "net").agg(F.count("*").alias("times")))
    open_ = staged(waits.groupBy(*keys, "gate_name").agg(F.count("*").alias("open")))
    frontier, rounds = known, [known]
    seen: list[DataFrame] = []
    while not frontier.isEmpty():
        # equal pins count as often as they are there, which matters for xor alone
        fed = waits.join(frontier, [*keys, "net"]).groupBy(*keys, "gate_name").agg(
            F.count("*").alias("fed"), F.expr("bit_and(word)").alias("all_"), F.expr("bit_or(word)").alias("any_"), F.expr("bit_xor(CASE WHEN times % 2 = 1 THEN word ELSE 0L END)").alias("odd_")
        )
        seen.append(staged(fed))
        parts = seen[0]
        for p in seen[1:]:
            parts = parts.union(p)
        touched = seen[-1].select(*keys, "gate_name")
        sums = parts.join(touched, [*keys, "gate_name"], "left_semi").groupBy(*keys, "gate_name").agg(
            F.sum("fed").alias("fed"), F.expr("bit_and(all_)").alias("all_"), F.expr("bit_or(any_)").alias("any_"), F.expr("bit_xor(odd_)").alias("odd_")
        )
        ready = sums.join(open_, [*keys, "gate_name"]).filter("fed = open")
        value = F.expr("CASE WHEN gtype IN ('and', 'buf') THEN all_ WHEN gtype IN ('nand', 'not') THEN ~all_ WHEN gtype = 'or' THEN any_ WHEN gtype = 'nor' THEN ~any_ WHEN gtype = 'xor' THEN odd_ ELSE ~odd_ END")
        new = comb.join(ready, [*keys, "gate_name"]).select(*keys, F.col("out_net").alias("net"), value.alias("word"))
        # of several drivers of one net the first round counts
        frontier = staged(new.groupBy(*keys, "net").agg(F.min("word").alias("word")).join(_together(rounds), [*keys, "net"], "left_anti"))
        rounds.append(frontier)
        if len(seen) > 6:
            seen[:] = [staged(parts)]
        if len(rounds) > 12:
            rounds[:] = [staged(_together(rounds))]
    return _together(rounds)


def _together(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out


def equivalent_outputs(before: DataFrame, after: DataFrame, outputs: DataFrame) -> DataFrame:
    """design_id, variant, nets, differing: output nets of each variant against its source (``outputs``: design_id, net)."""
    want = before.join(outputs, ["design_id", "net"], "left_semi").select("design_id", "net", F.col("word").alias("want"))
    return after.join(want, ["design_id", "net"]).groupBy("design_id", "variant").agg(F.count("*").alias("nets"), F.count_if(F.col("word") != F.col("want")).alias("differing"))


def first_differing(before: DataFrame, after: DataFrame, gates: DataFrame, pins_of: DataFrame, same: list[str], keys: list[str]) -> DataFrame:
    """keys, net: where a version begins to differ from its source: nets with other words whose driver's inputs all have the same ones.

    ``before``: same, net, word; ``after``: keys (``same`` and others), net, word; ``gates`` and ``pins_of``: the version's,
    as in :func:`equivalence_words`. Nets that the source lacks are seen through: what feeds them stands for them, step by
    step back along the cone.
    """
    want = staged(before.select(*same, "net", F.col("word").alias("want")))
    differ = staged(after.join(want, [*same, "net"]).filter("word <> want").select(*keys, "net").distinct())
    comb = gates.filter("gtype <> 'dff'").select(*keys, "gate_name", F.col("out_net").alias("net"))
    inputs = pins_of.select(*keys, "gate_name", F.col("net").alias("input"))
    # the inputs of nets that differ; what the source lacks is the only other thing that is looked through
    of_differing = comb.join(differ, [*keys, "net"], "left_semi").join(inputs, [*keys, "gate_name"]).select(*keys, "net", "input").distinct()
    named = want.select(*same, F.col("net").alias("input"), F.lit(True).alias("named"))
    found, open_, fed, seen = [], of_differing, None, None
    while True:
        looked = staged(open_.join(named, [*same, "input"], "left"))
        found.append(looked.filter("named").select(*keys, "net", "input"))
        fresh = looked.filter("named IS NULL").select(*keys, "net", F.col("input").alias("through"))
        if fresh.isEmpty():
            break
        if fed is None:
            lacking = comb.join(want.select(*same, "net"), [*same, "net"], "left_anti")
            fed = staged(lacking.join(inputs, [*keys, "gate_name"]).select(*keys, F.col("net").alias("through"), "input").distinct())
        further = fresh.join(fed, [*keys, "through"]).select(*keys, "net", "input").distinct()
        open_ = staged(further if seen is None else further.join(seen, [*keys, "net", "input"], "left_anti"))
        # a loop of fresh nets ends where nothing new comes up
        seen = open_ if seen is None else staged(seen.union(open_))
    behind = _together(found).join(differ.select(*keys, F.col("net").alias("input")), [*keys, "input"], "left_semi").select(*keys, "net")
    return differ.join(behind, [*keys, "net"], "left_anti")


def missing_names(labels: DataFrame, gates: DataFrame) -> DataFrame:
    """Labelled names that are no gate: empty when the labels are sound."""
    return labels.select("design_id", "gate_name").distinct().join(gates.select("design_id", "gate_name"), ["design_id", "gate_name"], "left_anti")
