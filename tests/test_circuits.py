"""Hand-worked circuits: one for every rule that is easy to get wrong."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelore.functions.columns import FEATURES, MASKED
from gatelore.operators import corpus, edges, features, iterate, learn, rewrite, score, simulate
from gatelore.sources import labels, netlists
from gatelore.sources.staging import staged

EXAMPLE = """module top(n0, n1, n2, n3); // header
/* a comment
   over lines: and gx(a, b, c); */
input n0, n1;
output n2, n3;
wire n4, n5;
nand g0(n4, n0, n1);
not g1(n5, n4);
dff g2(.RN(n0), .CK(n1), .D(n5), .Q(n2));
endmodule
"""


class Design:
    """Tables of one parsed text."""

    def __init__(self, spark, text, design_id=0):
        net = spark.createDataFrame([(design_id, text)], "design_id long, content string")
        parsed = netlists.parse_gates(net)
        pins = netlists.parse_pins(parsed)
        outs = pins.filter("direction = 'out'").select("design_id", "gid", F.col("net").alias("out_net"))
        self.gates = staged(parsed.select("design_id", "gid", "gate_name", "gtype").join(outs, ["design_id", "gid"], "left"))
        self.pins = staged(pins.filter("direction = 'in'").select("design_id", "gid", "gtype", "pin", "pin_pos", "net"))
        self.ports = staged(netlists.parse_ports(net))
        self.edges = staged(edges.build_edges(self.gates, self.pins))
        self.comb = staged(edges.combinational(self.edges, self.gates))

    def features(self, **options):
        return {r.gid: r for r in features.raw_features(self.gates, self.pins, self.ports, **options).collect()}


def test_example_features(spark):
    d = Design(spark, EXAMPLE)
    assert [(r.src, r.dst) for r in d.edges.orderBy("src").collect()] == [(0, 1), (1, 2)]
    got = d.features()
    want = {
        "is_ck": (1, 0, 1), "is_d": (0, 0, 1), "is_q": (0, 0, 0), "is_rst": (1, 0, 1), "is_set": (0, 0, 0), "is_PI": (1, 0, 1), "is_PO": (0, 0, 1), "is_sink_gate": (0, 0, 1),
        "fanin_2level": (0, 1, 2), "fanout_2level": (2, 1, 0), "fanout_dff_count": (1, 1, 0), "level": (0, 1, 0), "min_from_PI": (0, 1, -1), "max_from_PI": (0, 1, -1), "min_to_PO": (-1, -1, -1), "max_to_PO": (-1, -1, -1),
        "min_from_DFF": (-1, -1, 0), "max_from_DFF": (-1, -1, 0), "min_to_DFF": (1, 0, 0), "max_to_DFF": (2, 1, 0), "min_from_COMB": (0, 1, -1), "max_from_COMB": (0, 1, -1), "min_to_COMB": (1, 0, -1), "max_to_COMB": (1, 0, -1),
        "in_4lvl_cnt": (0, 1, 0), "out_4lvl_cnt": (1, 0, 0), "in_type_cnt": (0, 1, 1), "out_type_cnt": (1, 1, 0), "p_is_1": (0.5, 0.5, 0.5), "is_nand": (1, 0, 0), "is_dff": (0, 0, 1), "min_from_GND": (-1, -1, -1),
    }
    for name, values in want.items():
        assert tuple(got[g][name] for g in range(3)) == values, name
    parts = {r.gid: r.component_id for r in iterate.components(d.gates, d.comb).collect()}
    assert parts == {0: 0, 1: 0, 2: 1}
    assert len(FEATURES) == 48 and len(MASKED) == 13


def test_mask_and_scaling(spark):
    d = Design(spark, EXAMPLE)
    raw = staged(features.raw_features(d.gates, d.pins, d.ports))
    masked = features.masked(raw).collect()
    assert all(r[c] == 0 for r in masked for c in MASKED) and masked[0].__fields__[2:] == FEATURES
    assert all(r[c] == 0 for r in features.masked(raw, on=["level"]).collect() for c in FEATURES if c != "level")
    s = {r.gid: r for r in features.scaled(raw, ["level", "min_from_PI", "fanin_2level", "in_type_cnt", "max_to_DFF"]).collect()}
    assert [s[g].level for g in range(3)] == [0, 1, 0] and s[2].min_from_PI == -1 and s[2].fanin_2level == 1 and s[1].in_type_cnt == 1 / 9 and s[1].max_to_DFF == 0.5
    zero = features.component_descriptors(d.gates, d.comb, iterate.components(d.gates, d.comb), features.masked(raw), d.edges).orderBy("component_id").collect()
    assert zero[0].node_count == 2 and zero[0].edge_count == 1 and abs(zero[0].density - 2 / (2 + 1e-6)) < 1e-9 and zero[0].boundary_count == 0 and zero[0].mean_p_is_1 == 0 and zero[0].cut_edges == 1
    assert len(zero[0]) == 2 + 21 + 1


def test_duplicate_inputs_constants_and_buses(spark):
    d = Design(spark, "input [3:0] a;\noutput y;\nand g0(m, a[0], 1'b1);\nnand g1(y, m, m);\nor g2(z, 1'b0, a[3]);\nxor g3(q, unknown, 1'b0);")
    assert {r.net for r in d.ports.collect()} == {"a", "y"}
    assert [(r.src, r.dst, r.pin_pos) for r in d.edges.orderBy("pin_pos").collect()] == [(0, 1, 0), (0, 1, 1)]
    got = d.features()
    assert [got[g].is_PI for g in range(4)] == [1, 0, 1, 0] and got[1].is_PO == 1
    assert got[1].fanin_2level == 1 and got[1].fanin_same_type == 0 and got[1].p_is_1 == 0.75 and got[0].p_is_1 == 0.5
    assert [got[g].min_from_VDD for g in range(4)] == [0, 1, -1, -1] and [got[g].max_from_GND for g in range(4)] == [-1, -1, 0, 0]
    deg = {r.gid: (r.indegree, r.outdegree) for r in edges.degrees(d.gates, d.edges).collect()}
    assert deg[0] == (0, 2) and deg[1] == (2, 0) and edges.undirected_pairs(d.edges).count() == 1


def test_last_driver_wins_and_no_edges(spark):
    d = Design(spark, "buf g0(n, a);\nbuf g1(n, b);\nnot g2(y, n);")
    assert [(r.src, r.dst) for r in d.edges.collect()] == [(1, 2)]
    alone = Design(spark, "and g0(y, a, b);\ndff g1(.D(c), .Q(z));")
    assert alone.edges.count() == 0 and edges.dff_data_driver(alone.gates, alone.pins).collect()[0].d_driver == -1
    parts = iterate.components(alone.gates, alone.comb)
    out = features.component_descriptors(alone.gates, alone.comb, parts, features.masked(features.raw_features(alone.gates, alone.pins, alone.ports))).collect()
    assert len(out) == 2 and len(out[0]) == 23


def test_loops_keep_short_distances_but_pass_no_long_ones(spark):
    # g1 and g2 feed each other; g0 feeds the loop, g3 hangs behind it
    d = Design(spark, "input a;\noutput y;\nbuf g0(p, a);\nand g1(q, p, r);\nbuf g2(r, q);\nnot g3(y, r);")
    level = {r.gid: (r.level, r.ordered) for r in iterate.levels(d.gates, d.comb).collect()}
    assert level == {0: (0, True), 1: (1, False), 2: (0, False), 3: (0, False)}
    got = d.features()
    assert [got[g].min_from_PI for g in range(4)] == [0, 1, 2, 3] and [got[g].max_from_PI for g in range(4)] == [0, 1, -1, -1]
    assert [got[g].p_is_1 for g in range(4)] == [0.5] * 4 and got[1].in_4lvl_cnt == 2


def test_flip_flop_chain_settles_in_place(spark):
    d = Design(spark, "and g0(m, a, b);\nnand g1(w, m, m);\nnor g2(v, m, w);\ndff g3(.D(v), .Q(q3));\ndff g4(.D(q3), .Q(q4));\ndff g5(.D(q6), .Q(q5));\ndff g6(.D(v), .Q(q6));\ndff g7(.CK(v), .RN(w), .Q(q7));")
    p = {r.gid: r.p1 for r in simulate.signal_probability(d.gates, d.pins, d.edges, iterate.levels(d.gates, d.comb)).collect()}
    # g0 0.5, g1 0.75, g2 0.5 * 0.25; g4 sees the settled g3, g5 the unsettled g6, g7 the mean of its drivers
    assert p == {0: 0.5, 1: 0.75, 2: 0.125, 3: 0.125, 4: 0.125, 5: 0.5, 6: 0.125, 7: (0.125 + 0.75) / 2}


def brute_simulation(gates, ins, d_of, cycles, draw):
    """One cycle after another in plain loops; gates come in topological order."""
    n = len(gates)
    state, waves = [0] * n, []
    for c in range(cycles):
        for g in range(n):
            if gates[g] != "dff" and not ins[g]:
                state[g] = draw(c, g)
        for g in range(n):
            if gates[g] != "dff" and ins[g]:
                b = [state[x] for x in ins[g]]
                v = {"a": min(b), "o": max(b), "x": sum(b) % 2, "b": b[0]}[{"and": "a", "nand": "a", "or": "o", "nor": "o", "xor": "x", "xnor": "x"}.get(gates[g], "b")]
                state[g] = 1 - v if gates[g] in ("nand", "nor", "xnor", "not") else v
        for g in range(n):
            if gates[g] == "dff" and d_of[g] != -1:
                state[g] = state[d_of[g]]
        waves.append(list(state))
    return waves


@pytest.mark.parametrize("given", [False, True])
def test_random_simulation(spark, given):
    rng = random.Random(7)
    kinds = ["and", "or", "nand", "nor", "xor", "xnor", "not", "buf", "dff"]
    gates, ins, lines = [], [], []
    for g in range(40):
        t = "and" if g < 4 else rng.choice(kinds)
        k = 0 if g < 4 else 1 if t in ("not", "buf", "dff") else rng.choice([2, 3])
        src = [rng.randrange(g) for _ in range(k)]
        gates.append(t)
        ins.append(src)
        nets = [f"n{x}" for x in src] or ["a", "b"]
        lines.append(f"dff g{g}(.D({nets[0]}), .Q(n{g}));" if t == "dff" else f"{t} g{g}(n{g}, {', '.join(nets)});")
    d = Design(spark, "\n".join(lines))
    d_of = [ins[g][0] if gates[g] == "dff" else -1 for g in range(40)]
    cycles = 25
    if given:
        draw = lambda c, g: (c * 5 + g) % 3 % 2
        stimulus = spark.createDataFrame([(0, g, c, draw(c, g)) for g in range(4) for c in range(cycles)], "design_id long, gid long, cycle long, bit int")
    else:
        r = random.Random(0)
        table = [{g: r.getrandbits(1) for g in range(4)} for _ in range(cycles)]
        draw, stimulus = (lambda c, g: table[c][g]), None
    want = brute_simulation(gates, ins, d_of, cycles, draw)
    wave = simulate.random_simulation(d.gates, d.pins, d.edges, cycles=cycles, stimulus=stimulus, wave=True)
    assert {(r.gid, r.cycle): r.bit for r in wave.collect()} == {(g, c): want[c][g] for c in range(cycles) for g in range(40)}
    tallies = {r.gid: r[2:] for r in simulate.random_simulation(d.gates, d.pins, d.edges, cycles=cycles, stimulus=stimulus).collect()}
    from_series = {r.gid: r[2:] for r in simulate.switching_tallies(wave, ["design_id", "gid"], ["cycle"]).collect()}
    assert tallies == from_series
    for g in range(40):
        bits = [want[c][g] for c in range(cycles)]
        longest = lambda b: max((len(list(v)) for k, v in itertools.groupby(bits) if k == b), default=0)  # noqa: B023, E731
        assert tallies[g] == (sum(a > b for a, b in zip(bits, bits[1:])), sum(a < b for a, b in zip(bits, bits[1:])), longest(1), longest(0), sum(bits))


@pytest.mark.parametrize("commit", ["in_order", "two_phase"])
def test_loops_of_registers(spark, commit):
    """Random circuits with loops through flip-flops, loops without, and what lies before and behind; two designs at 1,000 vectors."""
    cycles, texts, made = 1000, [], []
    for design in range(2):
        rng = random.Random(design)
        gates, ins, lines = [], [], []
        for g in range(60):
            t = "and" if g < 5 else rng.choice(["and", "or", "nand", "nor", "xor", "xnor", "not", "buf", "dff", "dff"])
            k = 0 if g < 5 else 1 if t in ("not", "buf", "dff") else rng.choice([2, 3])
            # a flip-flop takes any gate's value, so loops arise; the last gates hang on none of them
            src = [rng.randrange(60 if t == "dff" and g < 45 else 5 if g < 20 else g) for _ in range(k)]
            gates.append(t)
            ins.append(src)
            nets = [f"n{x}" for x in src] or ["a", "b"]
            lines.append(f"dff g{g}(.D({nets[0]}), .Q(n{g}));" if t == "dff" else f"{t} g{g}(n{g}, {', '.join(nets)});")
        # gates 60 and 61 feed each other without a flip-flop and never settle, nor does 62 behind them
        lines += ["and g60(n60, n61, n0);", "or g61(n61, n60, n1);", "not g62(n62, n61);"]
        texts.append((design, "\n".join(lines)))
        made.append((gates, ins))
    parsed = netlists.parse_gates(spark.createDataFrame(texts, "design_id long, content string"))
    pins = netlists.parse_pins(parsed)
    outs = pins.filter("direction = 'out'").select("design_id", "gid", F.col("net").alias("out_net"))
    g, p = staged(parsed.join(outs, ["design_id", "gid"]).select("design_id", "gid", "gate_name", "gtype", "out_net")), staged(pins.filter("direction = 'in'"))
    bits = simulate.waveforms(g, p, staged(edges.build_edges(g, p)), cycles=cycles, commit=commit)
    got = {(r.design_id, r.gid): [r.bits[c // 64] >> c % 64 & 1 for c in range(cycles)] for r in bits.collect()}
    for design, (gates, ins) in enumerate(made):
        draw, state, want = random.Random(0), [0] * 60, []
        for _ in range(cycles):
            for k in range(60):
                if gates[k] != "dff":
                    b = [state[x] for x in ins[k]]
                    v = draw.getrandbits(1) if not b else {"and": min(b), "nand": 1 - min(b), "or": max(b), "nor": 1 - max(b), "xor": sum(b) % 2, "xnor": 1 - sum(b) % 2, "not": 1 - b[0], "buf": b[0]}[gates[k]]
                    state[k] = v
            before = list(state)
            for k in range(60):
                if gates[k] == "dff":
                    state[k] = state[ins[k][0]] if commit == "in_order" else before[ins[k][0]]
            want.append(list(state))
        for k in range(60):
            assert got[design, k] == [w[k] for w in want], (design, k, gates[k], ins[k])
        assert all(not any(got[design, k]) for k in (60, 61, 62))


def test_components_of_dealt_out_pairs(spark, monkeypatch):
    """Pairs that lie in many tasks: a long path, a star and random pairs, contracted in rounds, and merged with more pairs later."""
    rng = random.Random(3)
    pairs = [(0, i, i + 1) for i in range(0, 300)] + [(1, 0, i) for i in range(1, 100)] + [(2, *sorted(rng.sample(range(400), 2))) for _ in range(300)]
    nodes = spark.createDataFrame(sorted({(d, x) for d, a, b in pairs for x in (a, b)} | {(3, 7)}), "design_id long, gid long")

    def brute(some):
        root = {(r.design_id, r.gid): r.gid for r in nodes.collect()}
        for _ in range(400):
            for d, a, b in some:
                root[d, a] = root[d, b] = min(root[d, a], root[d, b])
        return root

    df = spark.createDataFrame(pairs, "design_id long, low long, high long")
    found = lambda rows: {(r.design_id, r.gid): r.root for r in rows.collect()}
    want = brute(pairs)
    assert found(iterate.component_roots(nodes, df)) == want
    once = iterate._contracted
    # every pair in a call of its own: nothing is contracted within a task, as for a design far larger than one
    monkeypatch.setattr(iterate, "_contracted", lambda it, seed: (x for b in it for k in range(b.num_rows) for x in once(iter([b.slice(k, 1)]), seed)))
    assert found(iterate.component_roots(nodes, df)) == want
    monkeypatch.undo()
    first = staged(iterate.component_roots(nodes, df.limit(350)))
    rest = df.join(df.limit(350), ["design_id", "low", "high"], "left_anti")
    assert found(iterate.merged_roots(first, rest)) == want


def flags_of(spark, on, n):
    return spark.createDataFrame([(0, g, int(g in on)) for g in range(n)], "design_id long, gid long, flag int")


def left(df):
    return {r.gid for r in df.collect() if r.flag == 1}


def test_filters(spark):
    chain = spark.createDataFrame([(0, g, g + 1) for g in range(29)], "design_id long, src long, dst long")
    on = {0, 2, 4, 5, 6, 7, 10, 11, 12, 13, 14, 20}
    flags = flags_of(spark, on, 30)
    assert left(score.drop_isolated(flags, chain)) == on - {0, 2, 20}
    assert left(score.drop_isolated(flags, chain, hops=2)) == on - {20}
    assert left(score.drop_small_clusters(score.drop_isolated(flags, chain), chain)) == {10, 11, 12, 13, 14}
    assert left(score.drop_small_clusters(score.drop_isolated(flags, chain), chain, least=4)) == {4, 5, 6, 7, 10, 11, 12, 13, 14}
    assert left(score.least_total(flags_of(spark, set(range(9)), 30))) == set() and left(score.least_total(flags_of(spark, set(range(10)), 30))) == set(range(10))
    near = {r.gid: r.hop for r in iterate.context(flags_of(spark, {3}, 30).filter("flag = 1"), chain, 2).collect()}
    assert near == {1: 2, 2: 1, 3: 0, 4: 1, 5: 2}


def test_grades(spark):
    cases = spark.createDataFrame([(0, 8, 2, 4, 6), (1, 0, 0, 0, 9), (2, 0, 5, 0, 5), (3, 0, 0, 7, 3), (4, 0, 3, 3, 3)], "design_id long, tp long, fp long, fn long, tn long")
    got = {r.design_id: r for r in score.grades(cases).collect()}
    p, r = 8 / 10, 8 / 12
    assert abs(got[0].score - (2 + 2 * p * r / (p + r))) < 1e-12 and got[1].score == 2 and got[2].score == 0 and got[3].score == 0 and got[4].score == 2 and got[4].f1 == 0
    report = {(r.predicted_trojaned, r.truly_trojaned): r for r in score.verdict_report(score.grades(cases)).collect()}
    assert report[True, True].designs == 2 and report[False, True].lost == 3 and report[True, False].possible == 2
    pred, truth = flags_of(spark, {0, 1}, 4), spark.createDataFrame([(0, 0, 1), (0, 2, 1)], "design_id long, gid long, y int")
    gates = pred.select("design_id", "gid")
    both = lambda a, b: [r.outcome for r in score.outcome_classes(gates, a, b).orderBy("gid").collect()]
    assert both(pred, truth) == ["TP", "FP", "FN", "TN"] and both(pred, None) == ["FP", "FP", "TN", "TN"] and both(None, truth) == ["FN", "TN", "FN", "TN"]


def test_labels(spark):
    texts = ["NO_TROJAN\n", "TROJANED\nTROJAN_GATES\ng1\n g2 \ng1\nEND_TROJAN_GATES\n", "TROJANED\nTROJAN_GATES\ng1\n", "", None, "odd\nTROJANED\n", "TROJANED\r\nTROJAN_GATES\r\ng7\r\nEND_TROJAN_GATES"]
    files = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "design_id long, content string")
    assert [r.is_trojaned for r in labels.design_labels(files).orderBy("design_id").collect()] == [False, True, True, False, False, False, True]
    assert {(r.design_id, r.gate_name) for r in labels.gate_labels(files).collect()} == {(1, "g1"), (1, "g2"), (6, "g7")}
    assert [r.trojan_gates for r in labels.label_summary(files).orderBy("design_id").collect()] == [0, 3, 0, 0, 0, 0, 1]
    stems = spark.createDataFrame([("design7",), ("top1_netlist",), ("plain",), ("design8",), ("none",)], "stem string")
    names = spark.createDataFrame([("design7.txt",), ("result7.txt",), ("top1_results.txt",), ("plain.txt",), ("result8.txt",)], "file_name string")
    assert {r.stem: r.file_name for r in labels.match_labels(stems, names).collect()} == {"design7": "design7.txt", "top1_netlist": "top1_results.txt", "plain": "plain.txt", "design8": "result8.txt"}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/design1.v").write_text(EXAMPLE)
    (tmp_path / "in/empty.v").write_text("module e();\nendmodule\n")
    (tmp_path / "in/notes.txt").write_text("and g0(a, b, c);")
    net = netlists.read_netlists(spark, str(tmp_path / "in"))
    rows = {r.design_id: r for r in net.collect()}
    assert set(rows) == {"design1", "empty"} and rows["design1"].content == EXAMPLE and rows["design1"].bytes == len(EXAMPLE)
    parsed = netlists.parse_gates(net)
    assert {r.design_id for r in netlists.rejects(net, parsed).collect()} == {"empty"}
    bodies = labels.label_text(parsed.filter("gid > 0").select("design_id", "gate_name"), net)
    labels.write_labels(bodies, net.select("design_id", F.col("design_id").alias("stem")), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True).select(F.col("output_name").alias("design_id"), F.col("value").alias("content"))
    assert {(r.design_id, r.gate_name) for r in labels.gate_labels(back).collect()} == {("result1.txt", "g1"), ("result1.txt", "g2")}
    rows = corpus.manifest(net, net.select("design_id", F.col("design_id").alias("stem"), F.lit("p").alias("pipeline")), labels.label_summary(back.limit(0)))
    corpus.write_manifest(rows, str(tmp_path / "manifest"))
    csv = spark.read.option("header", True).csv(str(tmp_path / "manifest")).collect()
    assert {(r.file, r.gates, r.label) for r in csv} == {("design1.v", "3", "UNLABELLED"), ("empty.v", "0", "UNLABELLED")}
    parsed.write.partitionBy("design_id").parquet(str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph")).count() == 3


def test_audit_table(spark):
    d = Design(spark, EXAMPLE)
    raw = staged(features.raw_features(d.gates, d.pins, d.ports))
    out = netlists.audit_gates(d.gates, d.gates.withColumn("y", F.lit(0)), raw, features.scaled(raw, ["level"]), ["level"])
    assert out.count() == 3 and "raw__level" in out.columns and "norm__level" in out.columns and "norm__is_and" not in out.columns


def test_instances_are_folded_and_made_canonical(spark):
    text = "\\nand \\core/u1 ( .A(x),\n  .B(y), .ZN(z) );\nassign q = z;\ndff u2 (.Q(q), .D(z),\n.CK(c));\nxor u3(o, a, b);"
    lines = spark.createDataFrame([("d", k, x) for k, x in enumerate(text.split("\n"))], "design_id string, line_no long, line string")
    records = netlists.fold_instances(lines)
    assert records.count() == 4
    assert [r.text for r in netlists.canonical_instances(records).orderBy("number").collect()] == ["nand core_u1(z, x, y);", "dff u2(.CK(c), .D(z), .Q(q));", "xor u3(o, a, b);"]
    marked = spark.createDataFrame([("a", "trojan_g", ["x"]), ("a", "g2", ["n_trojan_1"]), ("a", "g3", ["n"]), ("trojan5", "g", ["n"])], "design_id string, gate_name string, nets array<string>")
    assert [r.y for r in netlists.touches_marker(marked, "trojan").collect()] == [1, 1, 0, 1]


def test_provenance(spark):
    stems = spark.createDataFrame([(s,) for s in ["top3_trojan7_12_netlist", "trojan7_12_g_no_and_netlist", "design24_0.2_0_netlist", "TjFree_aes_g_0.2_0_netlist", "TjFree_aes_netlist", "other"]], "stem string")
    got = [tuple(r[1:]) for r in corpus.provenance(stems).collect()]
    assert got == [("top3", "7", "12", ""), ("", "7", "12", ""), ("design24", "", "0", "0.2"), ("aes_g", "", "0", "0.2"), ("aes", "", "", ""), ("", "", "", "")]


def test_rewrite_rules_hold(spark):
    rows = rewrite.check_rules(spark).collect()
    assert len({(r.gtype, r.rule_id) for r in rows}) == 12 and len(rows) == 48 and all(r.want == r.got for r in rows)


def test_rewriting_leaves_wide_and_single_input_gates(spark):
    d = Design(spark, "nand g0(n0, a, b, c);\nnot g1(n1, n0);\nxor g5(n9, n1, a);\ndff g7(.D(n9), .Q(y));")
    new, mapping = rewrite.rewrite(d.gates, d.pins, rate=1.0, variants=2, seed=3)
    rows = new.collect()
    kept = {r.gate_name for r in rows if r.gate_name == r.old_gate}
    assert kept == {"g0", "g1", "g7"} and {r.variant for r in rows} == {0, 1}
    made = [r for r in rows if r.old_gate == "g5"]
    assert all(int(r.gate_name[1:]) >= 8 for r in made) and {r.out_net for r in made} >= {"n9"} and all(int(r.out_net[1:]) > 9 for r in made if r.out_net != "n9")
    assert {(r.design_id, r.variant) for r in rewrite.remap_labels(d.gates.filter("gid = 2").select("design_id", "gate_name"), mapping).collect()} == {(0, 0), (0, 1)}
    again = rewrite.rewrite(d.gates.repartition(7), d.pins.repartition(5), rate=1.0, variants=2, seed=3)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_propagation_and_dense_scores(spark):
    d = Design(spark, EXAMPLE)
    x = d.gates.select("design_id", "gid", (F.col("gid") + 1.0).alias("x"))
    got = {r.gid: (r.x_fw1, r.x_bw1) for r in learn.propagate(d.edges, x, ["x"], 1).collect()}
    a = np.eye(3) + np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]])
    for k, m in enumerate((a, a.T)):
        deg = m.sum(1)
        want = (m / np.sqrt(np.outer(deg, deg))) @ np.array([1.0, 2.0, 3.0])
        assert np.allclose([got[g][k] for g in range(3)], want)
    weights = spark.createDataFrame([("0", 0, 0, 1.0), ("0", 0, 1, -1.0), ("0", -1, 1, 0.5)], "layer string, i int, j int, w double")
    p = [r.p for r in learn.dense_scores(x, ["x"], weights).orderBy("gid").collect()]
    assert np.allclose(p, [1 / (1 + np.exp(v - (0.5 - v))) for v in (1.0, 2.0, 3.0)])
    with pytest.raises(ValueError, match="takes 1 inputs"):
        learn.dense_scores(x, ["x", "gid"], weights)


def test_network_takes_only_weights_that_fit(spark):
    from gatelore.operators import network

    layers = {"conv0.fw": (1, 2), "conv0.bw": (1, 2), "conv0.join": (4, 2), "part.0": (1, 2), "part.1": (2, 1), "head.0": (3, 2), "head.1": (2, 2)}
    made = {k: np.ones((m + 1, n)) for k, (m, n) in layers.items()}
    assert network.checked(made, 1, 1) == 1
    assert {k: v.tolist() for k, v in network.layers_of(network.weight_table(spark, made)).items()} == {k: v.tolist() for k, v in made.items()}
    for wrong in ({**made, "head.0": np.ones((5, 2))}, {k: v for k, v in made.items() if k != "part.1"}, {**made, "conv2.fw": np.ones((2, 2))}, {**made, "head.1": np.ones((3, 3))}):
        with pytest.raises(ValueError):
            network.checked(wrong, 1, 1)
    with pytest.raises(ValueError):
        network.checked(made, 2, 1)


def test_training_with_focal_loss(spark):
    """The loss falls by epoch, scores of held-out designs reach a floor, the log feeds the choice of epochs."""
    from gatelore.operators import network

    rng = np.random.default_rng(0)
    rows = []
    for design in range(12):
        for g in range(200):
            a, b, c = rng.normal(size=3)
            rows.append((design, g, int(a * b > 0.6), float(a), float(b), float(c)))
    df = spark.createDataFrame(rows, "design_id long, gid long, y int, a double, b double, c double").repartition(3)
    scores, logs = network.out_of_fold_scores(df, ["a", "b", "c"], alpha=0.5, folds=2, epochs=40, rate=0.1, patience=40)
    assert scores.count() == len(rows) and scores.groupBy("design_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    for run in ("fold0", "fold1"):
        loss = [r.loss for r in logs.filter(F.col("run") == run).orderBy("epoch").collect()]
        assert len(loss) == 40 and loss[-1] < 0.5 * loss[0] and sum(x > y for x, y in zip(loss, loss[1:])) > 30
    best = {r.run: r for r in learn.best_epochs(logs).collect()}
    assert len(best) == 2 and learn.staleness(logs).count() == logs.count()
    chosen = network.chosen_by_fold(scores, [0.3, 0.4, 0.5, 0.6]).collect()
    assert len(chosen) == 2 and all(r.f1 > 0.8 for r in chosen)


def test_first_differing_net_is_named(spark):
    """A fault is named where it is, also behind nets that the source lacks, and not where it only passes."""
    base = [("g0", "and", "n0", "a b"), ("g1", "or", "n1", "n0 c"), ("g2", "xor", "n2", "n1 n0"), ("g3", "not", "n3", "n2"), ("g4", "dff", "q", "n3")]
    fresh = [("gx", "nor", "f0", "n0 c"), ("gy", "not", "f1", "f0"), ("g1", "buf", "n1", "f1")]
    versions = {0: base, 1: [base[0], *fresh, *base[2:]], 2: [base[0], ("gx", "nand", "f0", "n0 c"), *fresh[1:], *base[2:]], 3: [*base[:2], ("g2", "xnor", "n2", "n1 n0"), *base[3:]], 4: [base[0], *fresh, *base[2:3], ("g3", "buf", "n3", "n2"), base[4]]}
    gates = spark.createDataFrame([(7, v, g, t, o) for v, rows in versions.items() for g, t, o, _ in rows], "design_id long, variant long, gate_name string, gtype string, out_net string")
    pins = spark.createDataFrame([(7, v, g, x) for v, rows in versions.items() for g, _, _, ins in rows for x in ins.split()], "design_id long, variant long, gate_name string, net string")
    one = lambda df: df.filter("variant = 0").drop("variant")
    before = rewrite.equivalence_words(one(gates), one(pins), ["design_id"])
    after = rewrite.equivalence_words(gates, pins, ["design_id", "variant"])
    got = rewrite.first_differing(before, after, gates, pins, ["design_id"], ["design_id", "variant"]).collect()
    assert {(r.variant, r.net) for r in got} == {(2, "n1"), (3, "n2"), (4, "n3")}


def test_files_over_several_splits(spark, tmp_path):
    """Lines dealt out over many splits give the gates of the whole text, comments over lines and splits included."""
    from gatelore.sources import lines

    rng = random.Random(5)
    odd = ["/* one", "two */ and gx(a, b);", "// and gy(a, b);", "/*/ still open", "*/", "or g(a,b) ; // /* open", "xor h(a, /* in */ b);", "  nand\ti(a, b);\r", "", "input a, b;", "not k(c", "buf /*/ x */ l(a, b);"]
    for k in range(6):
        body = [rng.choice(odd) if rng.random() < 0.5 else f"nor g{j}(n{j}, a, b);" for j in range(60)]
        (tmp_path / f"d{k}.v").write_text("\n".join(["module top(a);", *body, *(["/* never closed", "and last(a, b);"] if k % 2 else []), "endmodule"]))
    (tmp_path / "e.v").write_text("")
    want = netlists.parse_gates(netlists.read_netlists(spark, str(tmp_path))).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert lines.netlist_lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 40
        got = lines.parse_gate_lines(spark, str(tmp_path)).select("design_id", "gid", "gate_name", "gtype", "args").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(want) > 150 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_graph_store(spark, tmp_path):
    """Round trip, refusals, and a join of stored tables without an exchange."""
    from gatelore.sources import graph_store

    d = Design(spark, EXAMPLE)
    full = staged(features.raw_features(d.gates, d.pins, d.ports))
    parts = staged(iterate.components(d.gates, d.comb))
    where = f"file://{tmp_path}/store"
    graph_store.write_store(where, d.gates, d.edges, full, parts, buckets=4)
    store = graph_store.open_store(spark, where, check_rows=True)
    assert store.rows == {"gates": 3, "edges_out": 2, "edges_in": 2, "features": 3, "components": 3}
    assert sorted(map(tuple, store.edges_in.select("src", "dst").collect())) == [(0, 1), (1, 2)]
    assert sorted(map(tuple, store.features.select(full.columns).collect())) == sorted(map(tuple, full.collect()))
    for df in (graph_store.stored_degrees(store), graph_store.stored_examples(store)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
    assert {(r.gid, r.loads, r.drivers) for r in graph_store.stored_degrees(store).collect()} == {(0, 1, 0), (1, 1, 1), (2, 0, 1)}
    assert {(r.gid, r.component_id) for r in graph_store.stored_examples(store, "level").collect()} == {(0, 0), (1, 0), (2, 1)}
    with pytest.raises(graph_store.StoreError):
        graph_store.open_store(spark, f"file://{tmp_path}/none")
    with pytest.raises(graph_store.StoreError):
        graph_store.write_store(f"file://{tmp_path}/thin", d.gates, d.edges.drop("net"), buckets=4)
    d.gates.limit(1).select("design_id", "gid", "gate_name", "gtype", F.lit(0).alias("y")).write.mode("append").parquet(f"{where}/gates")
    with pytest.raises(graph_store.StoreError):
        graph_store.open_store(spark, where, check_rows=True)


def test_detection_resumes_after_a_kill(spark, tmp_path):
    from gatelore.operators import detect

    texts = [(f"d{k}", EXAMPLE.replace("nand", "xor" if k % 2 else "nand")) for k in range(6)] + [("none", "module e();\nendmodule"), ("known", EXAMPLE)]
    given = spark.createDataFrame(texts, "design_id string, content string")
    library = spark.createDataFrame([(EXAMPLE, True, ["g1"])], "content string, is_trojaned boolean, gate_names array<string>").select(F.sha2("content", 256).alias("digest"), "is_trojaned", "gate_names")
    where, calls = f"file://{tmp_path}/out", []

    def score(rows):
        calls.append(sorted(r.design_id for r in rows.select("design_id").distinct().collect()))
        if len(calls) == 2 and not resumed:
            raise KeyboardInterrupt
        return rows.select("design_id", "gid", F.lit(0.9).alias("p"))

    resumed = False
    with pytest.raises(KeyboardInterrupt):
        detect.detect(given, where, score, library, cycles=4, designs_per_wave=3)
    first = {r.design_id for r in detect.ledger(spark, where).collect()}
    assert 0 < len(first) < 8
    resumed = True
    got = {r.design_id: (r.source, r.gates, r.flagged, r.trojaned, r.reason) for r in detect.detect(given, where, score, library, cycles=4, designs_per_wave=3).collect()}
    # three gates are fewer than the filters ask for, so the model's designs are clean; equal bytes take the library's answer
    odd, same = ("model", 3, 0, False, None), ("lookup", 3, 1, True, None)
    assert got == {**{f"d{k}": odd if k % 2 else same for k in range(6)}, "known": same, "none": ("rejected", 0, 0, None, "no gates")}
    assert detect.ledger(spark, where).count() == 8
    assert {r.design_id: r.body for r in detect.result_bodies(spark, where).collect()}["d1"] == "NO_TROJAN\n"
    assert sorted(map(tuple, detect.flagged_gates(spark, where).collect())) == sorted([(f"d{k}", "g1") for k in (0, 2, 4)] + [("known", "g1")])
    before = len(calls)
    detect.detect(given, where, score, library, cycles=4, designs_per_wave=3)
    assert len(calls) == before
    # a text that changes is done again, and its former gates are no longer read
    changed = given.filter("design_id = 'd0'").withColumn("content", F.regexp_replace("content", "nand", "nor"))
    assert {r.design_id: r.flagged for r in detect.detect(changed, where, score, library, cycles=4).collect()}["d0"] == 0
    assert "d0" not in {r.design_id for r in detect.flagged_gates(spark, where).collect()}


def test_empty_tables(spark):
    none = Design(spark, "module e();\nendmodule")
    assert none.gates.count() == 0 and none.edges.count() == 0
    assert features.raw_features(none.gates, none.pins, none.ports).count() == 0
    assert iterate.components(none.gates, none.comb).count() == 0


def test_registered_simulation_runs_all_vectors(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["random_simulation"](spark, "/root/testdata/sf0.001").collect()
    # an input that is drawn at random is 1 in about half of the 1,000 vectors
    assert max(r.total_1 for r in got) > 400
