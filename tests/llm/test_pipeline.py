"""The pipeline against a brute-force version, and the registration of every query."""

import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from gatelore.llm import language
from gatelore.llm.tokens import public_vocabulary

PLAIN = Tokenizer.from_file(public_vocabulary())
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDER = "/root/testdata/sf0.001"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_have_the_contract_s_form():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "decontaminate", "pack"] and corpus_pipeline.ORACLE_SQL is None
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "pipeline" in queries
    assert {q.split("_")[0] for q in queries if re.match(r"op\d+_", q)} == {f"op{n}" for n in range(1, 11)}


def test_run(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    model = language.learn(table)
    langs, scores = language.predict([r.text for r in rows.values()], model)
    left = {i for i, lang, score in zip(rows, langs, scores) if lang != "und" and score >= language.least_score(model, corpus_pipeline.ABOVE_CHANCE)}
    largest = {}
    for i in sorted(left):
        largest[rows[i].text.translate(LOWER)] = i
    left = set(largest.values())
    sets, up = {i: shingles(rows[i].text) for i in left}, {i: i for i in left}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(left)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    left = {i for i in left if find(i) == i}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = word.findall(r.text.translate(LOWER))
        m = min(10, len(w))
        windows[m].update(tuple(w[q : q + m]) for q in range(len(w) - m + 1))
    for i in list(left):
        w = word.findall(rows[i].text.translate(LOWER))
        if any(tuple(w[p : p + m]) in k for m, k in windows.items() for p in range(len(w) - m + 1)):
            left.discard(i)
    want = set()
    for i in left:
        e = np.array([*PLAIN.encode(rows[i].text, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(e) % 2048 or min(2048, len(e)), len(e) + 1, 2048)]
        want.update((i, k, x, y - x, zlib.crc32(e[x:y].tobytes())) for k, (x, y) in enumerate(zip(cuts, cuts[1:])))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_stages_take_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "no id at all here", "en", "s", 3), (2, "", "en", "s", 0), (3, "Some words of text", "en", "s", 9), (3, "Some words of text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in docs.collect()} == {None, 3}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 2


def test_copies_under_repeated_ids_go(spark):
    rows = [(5, "same"), (9, "SAME"), (5, "other"), (9, "same"), (None, "no id"), (None, "no id"), (4, "no id"), (None, "none"), (None, "None")]
    clash = {c: F.lit(c) for c in ("lang", "row", "digest", "times", "score", "lang_pred", "_hits", "_items")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    got = corpus_pipeline.without_copies(spark, docs, FOLDER)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text.lower()) for r in got.collect()) == [("4", "no id"), ("5", "other"), ("9", "same"), ("None", "none")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns and all(r[c] == c for r in got.collect() for c in clash), name
