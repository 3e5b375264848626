"""Mixing, phrase mining and the manifest against brute-force versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import fractions
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelore.llm import collocations, merkle, mixing, ordered
from gatelore.llm.common import stage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None)[:5] for r in rows], DOCS)


@pytest.fixture(scope="module")
def rows(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    odd = [
        (10_001, None, None, None, None), (10_002, "", "", "", 0), (10_003, " \n\t", "en", "src0", 3), (10_004, "One", "und", "src0", None), (10_005, "one", "en", "é", 3), (10_005, "one", "en", "é", 3),
        (10_005, "one two", "en", None, 7), (10_006, "É É é", None, "src1", 5), (10_007, " ".join(f"w{i}" for i in range(3000)), "en", "zz", 9), (10_008, "x" * 20_000, "xx", "zz", 1),
        (None, "no id", "en", "src0", 5), (None, "no id", "en", "src0", 5), (None, "other", None, None, 5), (-7, "a b \U0001d538 c", "\U0001d538", "�", 2),
    ]
    return given + odd


@pytest.fixture(scope="module")
def frame(spark, rows):
    return docs_of(spark, rows).repartition(5).withColumns({c: F.lit("clash") for c in ("size", "key", "grp", "part", "local", "base", "total", "target", "tree", "idx", "n", "node", "k1", "m", "a", "rank", "phrase", "one", "_tie")})


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(1)
    data = [("a" if rng.random() < 0.6 else rng.choice("bcdé"), rng.randrange(50), rng.randrange(9)) for _ in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows, bases = ordered.running_sums(stage(spark.createDataFrame(data, "g string, k long, v long").repartition(6), "t"), "g", ["k", "v"], "v")
    got = rows.join(bases, ["part", "g"]).select("g", "k", "v", (F.col("base") + F.col("local")).alias("before"), "total").collect()
    assert rows.select("part").distinct().count() > 2
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, so_far = [], collections.Counter()
    total = collections.Counter()
    for g, _, v in data:
        total[g] += v
    for g, k, v in sorted(data):
        want.append((g, k, v, so_far[g], total[g]))
        so_far[g] += v
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.g: r.place for r in ordered.group_places(bases, "g").collect()} == {g: i for i, g in enumerate(sorted(total))}


def brute_targets(sizes, weights=(5, 2, 1)):
    """By exact fractions: the excess is dealt out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    wanted, full = fractions.Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        left, w = wanted - sum(2 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: fractions.Fraction(2 * sizes[s]) if s in full else left * weight[s] / w for s in names}
        more = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not more:
            return target
        full |= more


def test_mix_plan(spark, frame, rows):
    got = mixing.mix_plan(frame).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = collections.defaultdict(list)
    for i, t, _, s, _ in rows:
        by_source[s].append((hashlib.md5(f"mix:{'-' if i is None else i}:{t or ''}".encode()).hexdigest(), size(t), i))
    sizes = {s: sum(x[1] for x in xs) for s, xs in by_source.items()}
    target, want = brute_targets(sizes), collections.Counter()
    for s, xs in by_source.items():
        epochs, rest = divmod(int(target[s]), sizes[s]) if sizes[s] else (0, 0)
        for _, n, i in sorted(xs, key=lambda x: x[:2]):
            last = min(max(rest, 0), n)
            want[i, s, n, sizes[s], epochs * n + last] += 1
            rest -= n
    assert collections.Counter((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got) == want
    assert all(abs(r.target - float(target[r.source])) < 1e-6 * max(1, r.target) and r.taken <= 2 * r.size for r in got)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s]) for s in sizes)
    again = mixing.mix_plan(frame.repartition(2)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))


def test_mixed_documents_hold_the_words_taken(spark):
    docs = docs_of(spark, [(k, f" a{k}  b{k}\nc{k} d{k} ", None, "ab"[k % 2]) for k in range(9)])
    plan = mixing.mix_plan(docs)
    parts = collections.Counter()
    for r in mixing.mixed_documents(docs, stage(plan, "plan")).collect():
        words = r.text.split()
        assert words == [f"{c}{r.doc_id}" for c in "abcd"][: len(words)]
        parts[r.doc_id] += len(words)
    assert parts == collections.Counter({r.doc_id: r.taken for r in plan.collect() if r.taken})


def brute_collocations(rows, least, best=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            lang_ = "und" if lang is None else lang
            n[lang_] += len(w)
            for m in range(1, 6):
                f.update((lang_, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    dropped = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            dropped |= {(lang, w[i : i + m]) for i in range(len(w) - m + 1) if a >= f[lang, w[i : i + m]]}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in dropped:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, k + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for k, (s, a, p, x, y) in enumerate(sorted(v)[:best])}


@pytest.fixture(scope="module")
def talk():
    rng = np.random.default_rng(4)
    words = ["the", "of", "New", "york", "city", "a", "b", "né", "x" * 90, "x" * 89 + "y", "ß"]
    rows = [(k, " ".join(rng.choice(words, 60, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.02, 0.02, 0.02])) + ("; new york city of dreams" * (k % 3)) + (", only here\r" * 40 if k == 5 else ""), [None, "en", "de", "und"][k % 4], None, 1) for k in range(80)]
    return [*rows, (None, None, "en"), (None, "", None), (3, ". , ;\n", "en"), (3, "solo", "fr"), (4, "end. of", "en")]


@pytest.mark.parametrize("mining", [{}, {"share": 0.02, "lowered": 1.0}, {"filter_bits": 7}])
def test_collocations(spark, talk, rows, mining):
    """Also with a sample that misses much, so that the border fails and is expanded, and with bitmaps that are mostly set."""
    df = docs_of(spark, talk).repartition(4).withColumns({"k1": F.lit(1), "m": F.lit("x"), "phrase": F.lit(None).cast("string")})
    got = {tuple(r) for r in collocations.collocations(df, least=12, **mining).collect()}
    assert got == brute_collocations(talk, 12) and len(got) > 50
    if "share" in mining:
        assert collocations.frequent_phrases(df, 12, **mining)[2] > 1


def test_collocations_of_a_sample_that_misses_all_take_two_full_passes(spark, talk):
    """What the missed phrases add to the border, and what that adds in turn, is counted in one pass."""
    df = docs_of(spark, talk)
    assert collocations.frequent_phrases(df, 12, share=1e-12)[2] == 2
    assert {tuple(r) for r in collocations.collocations(df, least=12, share=1e-12).collect()} == brute_collocations(talk, 12)


def test_collocations_of_given_rows_and_the_limit(spark, frame, rows):
    assert {tuple(r) for r in collocations.collocations(frame, least=6, best=7).collect()} == brute_collocations(rows, 6, 7)


def test_collocations_of_texts_longer_than_a_tile(spark, monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["aa", "bb", "cc", "dd."]) for _ in range(3000))
    whole = "ab cd " * 500
    for tile in (200, 1 << 20):
        monkeypatch.setattr(collocations, "TILE", tile)
        lanes = collocations.Lane(1), collocations.Lane(2)
        monkeypatch.setattr(collocations, "lanes", lambda lanes=lanes: lanes)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array([text, whole, "q" * 5000])], names=["lang", "text"])
        found = collections.Counter()
        full = [np.full(16, 255, np.uint8)] * 4
        for t in collocations._tiles(iter([batch])):
            for m, places, keys in collocations._levels(t, full):
                for at, a, b in zip(places.tolist(), *(k.tolist() for k in keys)):
                    found[a, b, t.phrase(at, m)] += 1
        if tile == 200:
            small = found
    assert small == found and len({k[:2] for k in found}) == len(found)
    want = collections.Counter()
    for x in (text, whole, "q" * 5000):
        for piece in x.split("."):
            w = piece.split()
            for m in range(1, 6):
                want.update(" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
    assert collections.Counter({k[2]: n for k, n in found.items()}) == want


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def brute_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted(([r[0] is not None, r[0] or 0, brute_leaf(*r)], i) for i, r in enumerate(rows) if r[2] == lang)
        trees[lang] = [i for _, i in mine], brute_tree([k[2] for k, _ in mine])
    top = brute_tree([trees[lang][1][-1][0] for lang in langs])
    out = []
    for t, lang in enumerate(langs):
        for place, i in enumerate(trees[lang][0]):
            r, path = rows[i], []
            for levels, k in ((trees[lang][1], place), (top, t)):
                for nodes in levels[:-1]:
                    path.append((k % 2, nodes[k ^ 1]) if k ^ 1 < len(nodes) else (0, ""))
                    k //= 2
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = brute_leaf(r[0], r[1], r[2], r[3], r[4] + 1) if changed else brute_leaf(*r)
            for odd, x in path:
                node = h(x, node) if odd else h(node, x)
            out.append((r[0], brute_leaf(*r), trees[lang][1][-1][0], top[-1][0], h(*(x for _, x in path)), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest(spark, frame, rows, levels):
    got = merkle.prove_all(frame, merkle.tampered_leaf(), levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got, want = [tuple(r) for r in got.collect()], brute_manifest(rows)
    assert collections.Counter(got) == collections.Counter(want)
    tampered = [r[0] for r in rows if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0]
    assert sorted(r[0] for r in got if not r[6]) == sorted(tampered) and tampered


@pytest.mark.parametrize("sizes", [[], [1], [5], [1, 2, 3, 4, 8, 9, 17]])
def test_small_trees(spark, sizes):
    """Trees of many sizes side by side, tiers of one level."""
    rows = [(100 * j + k, f"t{k}", f"l{j}", None, k) for j, n in enumerate(sizes) for k in range(n)]
    got = [tuple(r) for r in merkle.prove_all(docs_of(spark, rows), levels=1).collect()]
    untampered = [(*r[:5], r[3], True) for r in brute_manifest(rows)] if rows else []
    assert sorted(got) == sorted(untampered)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert mixing.mix_plan(none).count() == 0 and collocations.collocations(none).count() == 0


def test_sources_without_words(spark):
    got = mixing.mix_plan(docs_of(spark, [(1, None, None, "a"), (2, " ", None, "b"), (3, "", None, None)])).collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got} == {(k, 0, 0, 0.0, 0) for k in (1, 2, 3)}
