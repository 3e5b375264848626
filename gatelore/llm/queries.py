"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatelore.llm.collocations import collocations
from gatelore.llm.common import UPPER, table
from gatelore.llm.decontaminate import contamination
from gatelore.llm.exact_dedup import exact_duplicates
from gatelore.llm.html_text import extract_main_text
from gatelore.llm.language import identify_language
from gatelore.llm.merkle import prove_all, tampered_leaf
from gatelore.llm.mixing import mix_plan
from gatelore.llm.near_dedup import near_duplicates
from gatelore.llm.packing import best_fit_pack
from gatelore.llm.pii import personal_data_digest
from gatelore.llm.quality import score_quality
from gatelore.llm.substring_dedup import remove_repeats
from gatelore.llm.token_store import read_digests, write_store


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), capacity=2048)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(write_store(table(spark, sf_dir, "documents")))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=100, best=2000)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prove_all(table(spark, sf_dir, "documents"), changed=tampered_leaf())


QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality": op6_quality,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_html_text": op8_html_text,
    "op9_language": op9_language,
    "op10_token_store": op10_token_store,
    "op11_mixing": op11_mixing,
    "op12_collocations": op12_collocations,
    "op13_merkle": op13_merkle,
}

LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

#: Kind, its pattern for an engine without look-around, the condition on a match x, words nearby, score.
SQL_KINDS = [
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true", "mail|contact|write", 0.9),
    ("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR right(p, 3)::INT > 255)) = 0", "address|host|server|login", 0.6),
    (
        "card",
        "[0-9]([ -]?[0-9])+",
        "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::INT "
        "ELSE 2 * substr(reverse(d), i, 1)::INT - CASE WHEN substr(reverse(d), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
        "card|visa|credit|pay",
        0.8,
    ),
    ("phone", "\\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15", "phone|call|tel|mobile|fax", 0.7),
    (
        "iban",
        "[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
        "NOT regexp_matches(l, '[A-Za-z0-9]$') AND NOT regexp_matches(h, '^[A-Za-z0-9]') AND length(replace(x, ' ', '')) BETWEEN 15 AND 34 AND "
        "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(x, ' ', ''), 5) || left(x, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ord(c) - 55 ELSE c::INT END)), "
        "lambda a, c: CASE WHEN c > 9 THEN (a * 100 + c) % 97 ELSE (a * 10 + c) % 97 END) = 1",
        "iban|bank|account|transfer",
        0.9,
    ),
    (
        "ssn",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "NOT regexp_matches(l, '[0-9-]$') AND NOT regexp_matches(h, '^[0-9-]') AND left(x, 3) NOT IN ('000', '666') AND left(x, 1) <> '9' AND substr(x, 5, 2) <> '00' AND right(x, 4) <> '0000'",
        "ssn|social security|taxpayer",
        0.4,
    ),
    (
        "secret",
        "[A-Za-z0-9_+/-]{20,}",
        "regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND len(list_distinct(string_split(x, ''))) >= 10",
        "token|secret|password|passwd|credential|api.?key|access.?key|private.?key",
        0.4,
    ),
]


def _pii_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {r} AS r, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for r, (k, p, *_) in enumerate(SQL_KINDS)
    )
    valid = " ".join(f"WHEN '{k}' THEN {v}" for k, _, v, *_ in SQL_KINDS)
    words = " ".join(f"WHEN '{k}' THEN regexp_matches(near, '{w}')" for k, _, _, w, _ in SQL_KINDS)
    score = " ".join(f"WHEN '{k}' THEN {s}" for k, *_, s in SQL_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in SQL_KINDS[:4])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
        p AS (SELECT doc_id, kind, r, unnest(range(1, len(m) + 1)) AS i, m, g FROM f),
        q AS (SELECT doc_id, kind, r, m[i] AS x, regexp_replace(m[i], '[^0-9]', '', 'g') AS d, right(g[i], 40) AS l, left(g[i + 1], 40) AS h,
              list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS s FROM p),
        v AS (SELECT *, s + length(x) AS e, lower(l || ' ' || h) AS near FROM q WHERE CASE kind {valid} END),
        w AS (SELECT *, least(1.0, CASE kind {score} END + CASE WHEN CASE kind {words} END THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM v),
        k AS (SELECT * FROM w WHERE r < 4 OR score >= 0.6),
        a AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, r) FILTER (r < 4) AS base,
              string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, r) AS spans, string_agg(round(score, 2)::VARCHAR, ',' ORDER BY s, r) AS scores FROM k GROUP BY 1)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in SQL_KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
        FROM documents LEFT JOIN a USING (doc_id)"""


def _merkle_sql() -> str:
    def leaf(n_chars: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
        return f"sha256({' || '.join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields)})"

    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT for _ in range(8)]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))"
    return f"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, CASE WHEN xor({crc}, 4294967295::BIGINT) % 7 = 0 THEN {leaf("n_chars + 1")} END AS changed FROM documents),
        g AS MATERIALIZED (SELECT lang, (row_number() OVER (ORDER BY lang NULLS FIRST) - 1)::BIGINT AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM d)),
        l AS MATERIALIZED (SELECT d.*, tree, trees, (row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS i, count(*) OVER (PARTITION BY tree)::BIGINT AS n
              FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
        t(tree, level, i, n, node) AS (SELECT tree, 0, i, n, leaf FROM l UNION ALL
              SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, level, i // 2, n),
        nodes AS MATERIALIZED (SELECT * FROM t),
        sub AS MATERIALIZED (SELECT tree, level AS h, node AS subroot FROM nodes WHERE n = 1),
        u(level, i, n, node) AS (SELECT 0, tree, (SELECT count(*) FROM g)::BIGINT, subroot FROM sub UNION ALL
              SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 2, n),
        tops AS MATERIALIZED (SELECT * FROM u),
        steps AS (SELECT l.doc_id, l.tree, l.i, s.level AS step, (l.i >> s.level::INT) & 1 AS odd, x.node FROM l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) s ON s.tree = l.tree
              LEFT JOIN nodes x ON x.tree = l.tree AND x.level = s.level AND x.i = xor(l.i >> s.level::INT, 1)
              UNION ALL SELECT l.doc_id, l.tree, l.i, 64 + s.level, (l.tree >> s.level::INT) & 1, x.node FROM l, (SELECT DISTINCT level FROM tops WHERE n > 1) s
              LEFT JOIN tops x ON x.level = s.level AND x.i = xor(l.tree >> s.level::INT, 1)),
        path AS (SELECT tree, i, list(struct_pack(odd := odd, node := coalesce(node, '')) ORDER BY step) AS path, string_agg(node, '' ORDER BY step) AS proof FROM steps GROUP BY 1, 2),
        done AS (SELECT doc_id, leaf, subroot, (SELECT node FROM tops WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
              list_reduce(list_prepend(struct_pack(odd := 0::BIGINT, node := coalesce(changed, leaf)), coalesce(path, [])),
                lambda a, b: struct_pack(odd := 0::BIGINT, node := sha256(CASE WHEN b.odd = 1 THEN b.node || a.node ELSE a.node || b.node END))).node AS folded_root
              FROM l JOIN sub USING (tree) LEFT JOIN path ON path.tree = l.tree AND path.i = l.i)
        SELECT *, folded_root = root AS verified FROM done"""


_WORDS = "regexp_extract_all({}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(LOWER)} AS w FROM documents), b AS (SELECT row_number() OVER () AS item, item_id, {_WORDS.format(LOWER)} AS w FROM benchmark),
        bw AS MATERIALIZED (SELECT item, item_id, least(10, len(w)) AS m, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS q FROM b WHERE len(w) > 0),
        win AS (SELECT m, array_to_string(w[q:q + m - 1], ' ') AS k, list(DISTINCT item_id) AS items FROM bw GROUP BY 1, 2),
        dw AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
        hit AS MATERIALIZED (SELECT doc_id, p, win.m, items FROM dw JOIN win ON win.m = dw.m AND win.k = array_to_string(w[p:p + dw.m - 1], ' ')),
        cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM hit) GROUP BY 1),
        pq AS (SELECT dw.doc_id, b.item, dw.m, p, p - b.q AS diagonal FROM dw JOIN (SELECT DISTINCT item, m, q, array_to_string(w[q:q + m - 1], ' ') AS k FROM bw) b ON b.m = dw.m AND b.k = array_to_string(dw.w[p:p + dw.m - 1], ' ')),
        runs AS (SELECT doc_id, max(n) AS longest_run FROM (SELECT doc_id, count(*) + m - 1 AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item, diagonal ORDER BY p) AS island FROM pq) GROUP BY doc_id, item, m, diagonal, island) GROUP BY 1),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, unnest(items)::VARCHAR AS i FROM hit) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
            coalesce(longest_run, 0) AS longest_run FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN runs USING (doc_id)""",
    "op4_pii": _pii_sql(),
    "op5_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS MATERIALIZED (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
        u AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        c(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.y, c.root FROM c JOIN u ON u.x = c.doc_id WHERE u.y > c.root),
        r AS (SELECT doc_id, min(root) AS root FROM c GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, doc_id = root AS kept FROM r LEFT JOIN n USING (doc_id)""",
    "op11_mixing": """
        WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
              md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')) AS key FROM documents),
        s0 AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY 1),
        s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, sum(total) OVER () AS words FROM s0),
        s2 AS (SELECT *, sum(2 * total) OVER o AS caps, sum(w) OVER () - sum(w) OVER o AS rest FROM s1 WINDOW o AS (ORDER BY total / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT (1.5 * words::DOUBLE - coalesce(caps, 0)::DOUBLE) AS over, coalesce(rest, (SELECT sum(w) FROM s1))::DOUBLE AS weight FROM s2
              WHERE w * (1.5 * words::DOUBLE - coalesce(caps, 0)::DOUBLE) <= 2.0 * total * coalesce(rest, (SELECT sum(w) FROM s1)) ORDER BY total / w LIMIT 1),
        t AS (SELECT source, total, CASE WHEN w * over > 2.0 * total * weight THEN 2.0 * total ELSE w * over / weight END::DOUBLE AS target FROM s1, level),
        p AS (SELECT d.*, total, target, floor(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS epochs FROM p)
        SELECT doc_id, source, size, total AS source_size, target, (epochs * size + least(greatest(budget - epochs * total - before, 0), size))::BIGINT AS taken, epochs FROM e""",
    "op12_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
        g AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
        f AS MATERIALIZED (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
        c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
        k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
        cut AS (SELECT k.lang, k.phrase, k.m, k.w, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score FROM k JOIN n USING (lang)
              JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k + 1:], ' ')),
        best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, w, m, unnest(range(2, m)) AS short FROM c) x, unnest(range(1, 5)) AS t(i), c s
              WHERE i <= x.m - short + 1 AND s.lang = x.lang AND s.phrase = array_to_string(x.w[i:i + short - 1], ' ') AND 100 * x.a >= 100 * s.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM best ANTI JOIN inside USING (lang, phrase) QUALIFY rank <= 2000""",
    "op13_merkle": _merkle_sql(),
}
