"""Personal data in text, with DataFrame and SQL expressions only.

Regular expressions propose spans of each kind, checks confirm them (Luhn for cards, mod-97 for IBANs, number ranges for
addresses, digit counts for phones), and words near a span adjust its score. Kinds that a check alone settles (email,
ip, card, phone) are always reported; the added kinds (iban, ssn, secret) are reported when their score reaches
``threshold``. A secret is a long run of letters and digits with many different signs, beside a word such as token.

Patterns never backtrack without bound: repeated groups are possessive, so Java matches them in a loop and long runs
neither overflow the stack nor take quadratic time. Positions come from the lengths of the gaps between matches. The
whole operator is one projection: no shuffle, no state, any number of rows.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; spans of one kind never
overlap, spans of different kinds may; repeated rows get equal answers; other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, text that a match must hold (or none), words that raise the score, base score.
BASE_KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write", 0.9),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", "address|host|server|login", 0.6),
    ("card", r"[0-9](?:[ -]?[0-9]){11,}+", "", "card|visa|credit|pay", 0.8),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", "phone|call|tel|mobile|fax", 0.7),
]
ADDED_KINDS = [
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "", "iban|bank|account|transfer", 0.9),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn|social security|taxpayer", 0.4),
    ("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+", "", "token|secret|password|passwd|credential|api.?key|access.?key|private.?key", 0.4),
]
NEARBY = 40
#: Matches whose places are summed up together.
CHUNK = 128
CONTEXT_GAIN = 0.3
PLACED = "struct<s:int,e:int,m:string,near:string>"
#: Spans sort by start, then by kind as listed.
SPAN = "struct<s:int,r:int,e:int,kind:string,score:double>"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


#: SQL conditions on the matched text x.m.
VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(right(p, 3) AS int) <= 255)",
    "card": f"length({_digits('x.m')}) BETWEEN 12 AND 19 AND "
    f"aggregate(sequence(1, length({_digits('x.m')})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substring(reverse({_digits('x.m')}), i, 1) AS int) "
    f"ELSE 2 * cast(substring(reverse({_digits('x.m')}), i, 1) AS int) - CASE WHEN cast(substring(reverse({_digits('x.m')}), i, 1) AS int) > 4 THEN 9 ELSE 0 END END) % 10 = 0",
    "phone": f"length({_digits('x.m')}) BETWEEN 9 AND 15",
    "iban": "length(replace(x.m, ' ', '')) BETWEEN 15 AND 34 AND "
    "aggregate(filter(split(concat(substring(replace(x.m, ' ', ''), 5), left(x.m, 4)), ''), c -> c <> ''), 0, "
    "(a, c) -> CASE WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + cast(c AS int)) % 97 END) = 1",
    "ssn": "left(x.m, 3) NOT IN ('000', '666') AND left(x.m, 1) <> '9' AND substring(x.m, 5, 2) <> '00' AND right(x.m, 4) <> '0000'",
    "secret": "x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]' AND size(array_distinct(split(x.m, ''))) >= 10",
}


def _spans(df: DataFrame, rank: int, kind: str, pattern: str, holds: str, words: str, score: float, threshold: float) -> DataFrame:
    """Add column ``kind``: the confirmed spans of one kind, in order."""
    pat = pattern.replace("\\", "\\\\")
    matches = f"regexp_extract_all(_t, '{pat}', 0)"
    gate = f"CASE WHEN contains(_t, '{holds}') THEN {matches} ELSE cast(array() AS array<string>) END" if holds else matches
    df = df.withColumn("_m", F.expr(gate))
    df = df.withColumn("_g", F.expr(f"CASE WHEN size(_m) > 0 THEN split(_t, '{pat}', -1) ELSE cast(array() AS array<string>) END"))
    df = df.withColumn("_z", F.expr("arrays_zip(slice(_g, 1, size(_m)), _m, slice(_g, 2, size(_m)))").cast("array<struct<g:string,m:string,h:string>>"))
    # lengths are summed up within chunks, then over chunks, so that a text with very many matches stays cheap
    chunks = f"transform(sequence(0, greatest(0, (size(_z) - 1) div {CHUNK})), k -> slice(_z, cast(k * {CHUNK} + 1 AS int), {CHUNK}))"
    inside = f"""transform({chunks}, c -> aggregate(
        c, named_struct('p', 0, 'o', cast(array() AS array<{PLACED}>)),
        (a, x) -> named_struct('p', a.p + length(x.g) + length(x.m),
            'o', concat(a.o, array(named_struct('s', a.p + length(x.g), 'e', a.p + length(x.g) + length(x.m), 'm', x.m,
                 'near', lower(concat(right(x.g, {NEARBY}), ' ', left(x.h, {NEARBY})))))))))"""
    df = df.withColumn("_c", F.expr(inside))
    df = df.withColumn("_b", F.expr("aggregate(_c, array(0), (a, x) -> array_append(a, element_at(a, -1) + x.p))"))
    placed = "flatten(transform(_c, (c, i) -> transform(c.o, x -> named_struct('s', x.s + _b[i], 'e', x.e + _b[i], 'm', x.m, 'near', x.near))))"
    df = df.withColumn("_p", F.expr(placed))
    kept = f"""filter(transform(filter(_p, x -> {VALID[kind]}),
        x -> named_struct('s', x.s, 'r', {rank}, 'e', x.e, 'kind', '{kind}',
             'score', least(1.0D, {score}D + CASE WHEN x.near RLIKE '{words}' THEN {CONTEXT_GAIN}D ELSE 0.0D END))),
        y -> y.score >= {threshold}D)"""
    return df.withColumn(kind, F.expr(f"cast({kept} AS array<{SPAN}>)")).drop("_m", "_g", "_z", "_c", "_b", "_p")


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.concat_ws(",", F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def personal_data(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """doc_id and one column of spans (start, end, rank, kind, score) per kind."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    for rank, (kind, *rest) in enumerate(BASE_KINDS):
        df = _spans(df, rank, kind, *rest, threshold=0.0)
    for rank, (kind, *rest) in enumerate(ADDED_KINDS, len(BASE_KINDS)):
        df = _spans(df, rank, kind, *rest, threshold=threshold)
    return df.drop("_t")


def personal_data_digest(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row per document: counts by base kind, a digest of the base spans, and all spans as text."""
    found = personal_data(docs, threshold)
    base = [k for k, *_ in BASE_KINDS]
    every = base + [k for k, *_ in ADDED_KINDS]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_joined(F.concat(*base)), 256).alias("base_sha256"),
        _joined(F.concat(*every)).alias("spans"),
        F.concat_ws(",", F.transform(F.array_sort(F.concat(*every)), lambda x: F.round(x["score"], 2).cast("string"))).alias("scores"),
    )
