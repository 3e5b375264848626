"""Queries over netlist text, features, simulation, rewriting, the corpus and learning, over the circuit view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelore.functions.columns import DISTANCE_COLUMNS, FEATURES, MASKED, base_net, is_port_name
from gatelore.operators import corpus as C
from gatelore.operators import detect as D
from gatelore.operators import edges as E
from gatelore.operators import features as X
from gatelore.operators import iterate as I
from gatelore.operators import learn as L
from gatelore.operators import network as W
from gatelore.operators import rewrite as R
from gatelore.operators import score as S
from gatelore.operators import simulate as M
from gatelore.plans.catalog import BFS, CASES, COMPONENTS, FAR, FILTERS, HOODS, IO, LEVELS, SEEDS, TWO_HOP, circuit_query, comb_of, edges_of, longs, register, rounded
from gatelore.plans.testview import Circuit, circuit
from gatelore.sources import graph_store as G
from gatelore.sources import labels as Y
from gatelore.sources import netlists as N
from gatelore.sources.staging import new_folder, staged

# --- text -----------------------------------------------------------------------------------------------------------------

LINES = """ins AS (SELECT design_id, gid, string_agg(net, ', ' ORDER BY pin_pos) AS placed, string_agg('.' || pin || '(' || net || ')', ', ' ORDER BY pin_pos) AS named FROM pins GROUP BY ALL),
line AS (SELECT g.design_id, g.gid, gtype || ' ' || gate_name || '(' || CASE WHEN gtype = 'dff' THEN concat_ws(', ', named, '.Q(' || out_net || ')') ELSE concat_ws(', ', out_net, placed) END || ');' AS line FROM gates g LEFT JOIN ins USING (design_id, gid))"""
TEXT = LINES + """, hd AS (SELECT design_id, string_agg(DISTINCT net, ', ' ORDER BY net) AS a, string_agg(DISTINCT net, ', ' ORDER BY net) FILTER (direction = 'in') AS i, string_agg(DISTINCT net, ', ' ORDER BY net) FILTER (direction = 'out') AS o FROM ports GROUP BY 1),
wr AS (SELECT design_id, string_agg(out_net, ', ' ORDER BY gid) AS w FROM gates WHERE NOT is_po GROUP BY 1),
bd AS (SELECT design_id, string_agg(line, chr(10) ORDER BY gid) AS b FROM line GROUP BY 1),
netlist AS MATERIALIZED (SELECT design_id, 'module top(' || coalesce(a, '') || ');' || chr(10) || coalesce('input ' || i || ';' || chr(10), '') || coalesce('output ' || o || ';' || chr(10), '') || coalesce('wire ' || w || ';' || chr(10), '') || b || chr(10) || 'endmodule' || chr(10) AS content
FROM bd LEFT JOIN hd USING (design_id) LEFT JOIN wr USING (design_id))"""


def text_of(c: Circuit) -> DataFrame:
    return N.render(c.gates, c.pins, c.ports)


circuit_query("gate_lines", LINES + " SELECT design_id, gid, line FROM line")(lambda c: N.gate_lines(c.gates, c.pins))
circuit_query("render_netlists", TEXT + " SELECT design_id, content FROM netlist")(text_of)
circuit_query("parse_gates", "SELECT design_id, gid, gate_name, gtype FROM gates")(lambda c: N.parse_gates(text_of(c)).drop("args"))
circuit_query("parse_pins", """SELECT design_id, gid, gtype, pin, pin_pos, 'in' AS direction, net FROM pins
UNION ALL SELECT design_id, gid, gtype, CASE WHEN gtype = 'dff' THEN 'Q' ELSE 'Y' END, 0, 'out', out_net FROM gates""")(lambda c: N.parse_pins(N.parse_gates(text_of(c))))
circuit_query("parse_ports", "SELECT design_id, direction, net FROM ports")(lambda c: N.parse_ports(text_of(c)))
circuit_query("port_base_nets", "SELECT DISTINCT design_id, split_part(net || '[3]', '[', 1) AS net FROM ports WHERE NOT regexp_full_match(net, '[0-9]+')")(
    lambda c: c.ports.filter(is_port_name(F.col("net"))).select("design_id", base_net(F.concat("net", F.lit("[3]"))).alias("net")).distinct()
)
circuit_query("sorted_gate_names", "SELECT design_id, string_agg(gate_name, ',' ORDER BY gate_name) AS names FROM gates GROUP BY 1")(
    lambda c: c.gates.groupBy("design_id").agg(F.array_join(F.array_sort(F.collect_list("gate_name")), ",").alias("names"))
)
circuit_query("encounter_numbers", "SELECT design_id, gid, gate_name FROM gates")(lambda c: N.parse_gates(text_of(c)).select("design_id", "gid", "gate_name"))
circuit_query("rejected_netlists", "SELECT design_id, 'no gates' AS reason FROM (SELECT DISTINCT design_id FROM gates) WHERE design_id % 7 = 0")(
    lambda c: (lambda t: N.rejects(t, N.parse_gates(t)))(text_of(c).withColumn("content", F.when(F.col("design_id") % 7 == 0, "module empty();\nendmodule\n").otherwise(F.col("content"))))
)
circuit_query("incremental_outputs", "SELECT DISTINCT 'design' || design_id || '_flat' AS stem, 'design' || design_id || '_dc' AS output FROM gates WHERE design_id % 3 <> 0")(
    lambda c: N.not_yet_written(
        c.gates.select(F.format_string("design%d_flat", "design_id").alias("stem")).distinct(), c.gates.filter("design_id % 3 = 0").select(F.format_string("design%d_dc", "design_id").alias("output")).distinct(), "_dc"
    )
)
circuit_query("audit_edges", "SELECT design_id, src, dst, net, 'g' || src AS src_name, 'g' || dst AS dst_name FROM edges")(lambda c: N.audit_edges(c.gates, edges_of(c)))
circuit_query("marked_gates", """SELECT g.design_id, g.gate_name, (g.gate_name LIKE '%g1%' OR EXISTS (SELECT 1 FROM pins p WHERE p.design_id = g.design_id AND p.gid = g.gid AND p.net LIKE '%g1%') OR design_id::VARCHAR LIKE 'g1%')::INT AS y FROM gates g""")(
    lambda c: N.touches_marker(c.gates.join(c.pins.groupBy("design_id", "gid").agg(F.collect_list("net").alias("nets")), ["design_id", "gid"], "left").withColumn("nets", F.coalesce("nets", F.array().cast("array<string>"))), "g1")
)


def broken_lines(c: Circuit) -> DataFrame:
    """Every gate line cut in two at its bracket, numbered in order."""
    halves = N.gate_lines(c.gates, c.pins).select("design_id", "gid", F.posexplode(F.split("line", r"(?<=\()", 2)).alias("k", "line"))
    return halves.select("design_id", (F.col("gid") * 2 + F.col("k")).alias("line_no"), "line")


circuit_query("fold_instances", LINES + " SELECT design_id, gid AS number, regexp_replace(line, '\\(', '( ') AS text FROM line")(lambda c: N.fold_instances(broken_lines(c)).withColumn("number", F.col("number").cast("long")).withColumn("text", F.regexp_replace("text", r"\( ", "( ")))
circuit_query("canonical_instances", LINES + " SELECT design_id, gid AS number, line AS text FROM line")(
    lambda c: N.canonical_instances(N.gate_lines(c.gates, c.pins).select("design_id", F.col("gid").alias("number"), F.regexp_replace("line", r"^(\w+) (\w+)\(", r"$1 \\$2 ( ").alias("text")))
)
circuit_query("renamed_nets", """port AS (SELECT design_id, net, row_number() OVER (PARTITION BY design_id ORDER BY direction, net) AS place FROM (SELECT DISTINCT design_id, direction, net FROM ports)),
seen AS (SELECT design_id, gid, 0 AS place, out_net AS net FROM gates UNION ALL SELECT design_id, gid, pin_pos + 1, net FROM pins WHERE net NOT LIKE '1''b%'),
first AS (SELECT design_id, net, min(gid * 10 + place) AS f FROM seen WHERE NOT EXISTS (SELECT 1 FROM port p WHERE p.design_id = seen.design_id AND p.net = seen.net) GROUP BY ALL),
ranked AS (SELECT design_id, net, 0 AS kind, place AS f FROM port UNION ALL SELECT design_id, net, 1, f FROM first)
SELECT design_id, net, 'n' || (row_number() OVER (PARTITION BY design_id ORDER BY kind, f, net) - 1) AS new_net FROM ranked""")(
    lambda c: N.rename_nets(
        c.gates.select("design_id", "gid", F.lit(0).alias("at"), F.col("out_net").alias("net")).union(c.pins.select("design_id", "gid", (F.col("pin_pos") + 1).cast("int"), "net")),
        c.ports.distinct().withColumn("place", F.expr("row_number() OVER (PARTITION BY design_id ORDER BY direction, net)")).select("design_id", "place", "net"),
    )
)

# --- labels ---------------------------------------------------------------------------------------------------------------

LABEL_TEXT = """named AS (SELECT design_id, string_agg(gate_name, chr(10) ORDER BY gate_name) AS names FROM gates WHERE y = 1 GROUP BY 1),
lab AS (SELECT design_id, CASE WHEN names IS NULL THEN 'NO_TROJAN' || chr(10) ELSE 'TROJANED' || chr(10) || 'TROJAN_GATES' || chr(10) || names || chr(10) || 'END_TROJAN_GATES' || chr(10) END AS body
FROM (SELECT DISTINCT design_id FROM gates) LEFT JOIN named USING (design_id))"""


def label_files(c: Circuit) -> DataFrame:
    return Y.label_text(c.gates.filter("y = 1").select("design_id", "gate_name"), c.gates)


circuit_query("label_text", LABEL_TEXT + " SELECT design_id, body FROM lab")(label_files)
circuit_query("read_design_labels", "SELECT design_id, max(y) = 1 AS is_trojaned FROM gates GROUP BY 1")(lambda c: Y.design_labels(label_files(c).withColumnRenamed("body", "content")))
circuit_query("read_gate_labels", "SELECT design_id, gate_name FROM gates WHERE y = 1")(lambda c: Y.gate_labels(label_files(c).withColumnRenamed("body", "content")))
circuit_query("label_names_missing", "SELECT design_id, 'x' || gate_name AS gate_name FROM gates WHERE y = 1 AND gid % 5 = 0")(
    lambda c: R.missing_names(Y.gate_labels(label_files(c).withColumnRenamed("body", "content")).join(c.gates.select("design_id", "gate_name", "gid"), ["design_id", "gate_name"]).select("design_id", F.when(F.col("gid") % 5 == 0, F.concat(F.lit("x"), "gate_name")).otherwise(F.col("gate_name")).alias("gate_name")), c.gates)
)

STEMS = "stem AS (SELECT DISTINCT design_id, CASE design_id % 3 WHEN 0 THEN 'design' || design_id WHEN 1 THEN 'd' || design_id || '_netlist' ELSE 'x' || design_id END AS stem FROM gates)"
FILES = STEMS + """, file AS (SELECT CASE design_id % 3 WHEN 0 THEN 'result' || design_id WHEN 1 THEN 'd' || design_id || '_results' ELSE 'y' || design_id END || '.txt' AS file_name FROM stem UNION SELECT stem || '.txt' FROM stem WHERE design_id % 2 = 0)"""


def stems_of(c: Circuit) -> DataFrame:
    d = F.col("design_id")
    return c.gates.select("design_id").distinct().withColumn("stem", F.when(d % 3 == 0, F.format_string("design%d", d)).when(d % 3 == 1, F.format_string("d%d_netlist", d)).otherwise(F.format_string("x%d", d)))


def files_of(c: Circuit) -> DataFrame:
    d, s = F.col("design_id"), stems_of(c)
    other = s.select(F.when(d % 3 == 0, F.format_string("result%d.txt", d)).when(d % 3 == 1, F.format_string("d%d_results.txt", d)).otherwise(F.format_string("y%d.txt", d)).alias("file_name"))
    return other.union(s.filter("design_id % 2 = 0").select(F.concat("stem", F.lit(".txt"))))


circuit_query("match_label_files", FILES + """ SELECT stem, CASE WHEN design_id % 2 = 0 THEN stem || '.txt' WHEN design_id % 3 = 0 THEN 'result' || design_id || '.txt' ELSE 'd' || design_id || '_results.txt' END AS file_name FROM stem WHERE design_id % 2 = 0 OR design_id % 3 < 2""")(
    lambda c: Y.match_labels(stems_of(c), files_of(c))
)

# --- features -------------------------------------------------------------------------------------------------------------

FEATURE_PARTS = f"""{LEVELS}, {SEEDS}, {BFS}, {FAR}, {TWO_HOP}, {IO}, {HOODS},
role AS (SELECT DISTINCT design_id, net, CASE pin WHEN 'CK' THEN 'is_ck' WHEN 'D' THEN 'is_d' WHEN 'RN' THEN 'is_rst' END AS role FROM pins WHERE gtype = 'dff' UNION SELECT design_id, out_net, 'is_q' FROM gates WHERE gtype = 'dff'),
rl AS (SELECT p.design_id, p.gid, {", ".join(f"max((role = '{r}')::INT) AS {r}" for r in E.ROLE_COLUMNS)} FROM pins p JOIN role USING (design_id, net) GROUP BY ALL),
ti AS (SELECT e.design_id, dst AS gid, count(DISTINCT a.gtype) AS n FROM edges e JOIN gates a ON a.design_id = e.design_id AND a.gid = e.src GROUP BY ALL),
tt AS (SELECT e.design_id, src AS gid, count(DISTINCT b.gtype) AS n FROM edges e JOIN gates b ON b.design_id = e.design_id AND b.gid = e.dst GROUP BY ALL),
dw AS (SELECT design_id, gid, {", ".join(f"max(dist) FILTER (family = '{f}' AND m = '{m}') AS {m}_{v[1]}" for f, v in I.FAMILIES.items() for m in ("min", "max"))}
FROM (SELECT *, 'min' AS m FROM near UNION ALL SELECT *, 'max' FROM far) GROUP BY ALL),
feat AS MATERIALIZED (SELECT g.design_id, g.gid, {", ".join(f"(gtype = '{t}')::DOUBLE AS is_{t}" for t in E.GATE_TYPES)}, {", ".join(f"coalesce({r}, 0)::DOUBLE AS {r}" for r in E.ROLE_COLUMNS)}, io."is_PI"::DOUBLE AS "is_PI", io."is_PO"::DOUBLE AS "is_PO",
(NOT EXISTS (SELECT 1 FROM edges e WHERE e.design_id = g.design_id AND e.src = g.gid))::DOUBLE AS is_sink_gate, coalesce(fanin_2level, 0)::DOUBLE AS fanin_2level, coalesce(fanout_2level, 0)::DOUBLE AS fanout_2level, coalesce(fanout_dff_count, 0)::DOUBLE AS fanout_dff_count,
level::DOUBLE AS level, {", ".join(f"coalesce(dw.{c}, -1)::DOUBLE AS {c}" for c in DISTANCE_COLUMNS if c not in MASKED)}, in_4lvl_cnt::DOUBLE AS in_4lvl_cnt, out_4lvl_cnt::DOUBLE AS out_4lvl_cnt, coalesce(ti.n, 0)::DOUBLE AS in_type_cnt, coalesce(tt.n, 0)::DOUBLE AS out_type_cnt,
{", ".join(f"0.0::DOUBLE AS {c}" for c in [*MASKED, *M.TALLY_COLUMNS])}
FROM gates g JOIN level USING (design_id, gid) JOIN io USING (design_id, gid) JOIN hoods USING (design_id, gid) LEFT JOIN fi USING (design_id, gid) LEFT JOIN fo USING (design_id, gid) LEFT JOIN rl USING (design_id, gid)
LEFT JOIN ti USING (design_id, gid) LEFT JOIN tt USING (design_id, gid) LEFT JOIN dw USING (design_id, gid))"""


def masked_features(c: Circuit, *columns: str) -> DataFrame:
    """All columns under the default mask, or some of them; what the mask turns off is not worked out."""
    on = [x for x in (columns or FEATURES) if x not in MASKED]
    return X.masked(X.raw_features(c.gates, c.pins, c.ports, columns=on), on=on).select("design_id", "gid", *(columns or FEATURES))


circuit_query("masked_features", FEATURE_PARTS + " SELECT design_id, gid, " + ", ".join(f'"{c}"' for c in FEATURES) + " FROM feat")(masked_features)
circuit_query("scaled_features", FEATURE_PARTS + """ SELECT design_id, gid, round(coalesce(level / nullif(max(level) OVER d, 0), 0), 6) AS level,
round(CASE WHEN "min_from_PI" < 0 THEN -1.0 ELSE coalesce("min_from_PI" / nullif(max("min_from_PI") OVER d, 0), 0) END, 6) AS "min_from_PI",
round(coalesce((fanin_2level - min(fanin_2level) OVER d) / nullif(max(fanin_2level) OVER d - min(fanin_2level) OVER d, 0), 0), 6) AS fanin_2level, round(in_type_cnt / 9.0, 6) AS in_type_cnt FROM feat WINDOW d AS (PARTITION BY design_id)""")(
    lambda c: rounded(X.scaled(masked_features(c, "level", "min_from_PI", "fanin_2level", "in_type_cnt"), ["level", "min_from_PI", "fanin_2level", "in_type_cnt"]), "level", "min_from_PI", "fanin_2level", "in_type_cnt")
)


def audit_gates(c: Circuit) -> DataFrame:
    raw = staged(masked_features(c, "level", "fanin_2level"))
    return rounded(N.audit_gates(c.gates, c.gates, raw, X.scaled(raw, ["level", "fanin_2level"]), ["level"]), "norm__level")


circuit_query("audit_gates", FEATURE_PARTS + """ SELECT design_id, gid, gate_name, y, feat.level AS raw__level, fanin_2level AS raw__fanin_2level, round(coalesce(feat.level / nullif(max(feat.level) OVER (PARTITION BY design_id), 0), 0), 6) AS norm__level FROM feat JOIN gates USING (design_id, gid)""")(audit_gates)
DESCRIPTORS = FEATURE_PARTS + ", " + COMPONENTS + """, pr AS (SELECT DISTINCT design_id, least(src, dst) AS low, greatest(src, dst) AS high FROM comb), pe AS (SELECT pr.design_id, component_id, count(*)::DOUBLE AS e FROM pr JOIN component c ON c.design_id = pr.design_id AND c.gid = pr.low GROUP BY 1, 2),
dn AS (SELECT design_id, component_id, count(*)::DOUBLE AS n, """ + ", ".join(f"avg(is_{t}) AS share_{t}" for t in E.GATE_TYPES) + ", " + ", ".join(f'avg("{m}") AS "mean_{m}"' for m in X.MEANS) + """ FROM component JOIN feat USING (design_id, gid) GROUP BY 1, 2),
descriptor AS (SELECT design_id, component_id, n AS node_count, coalesce(e, 0) AS edge_count, round(2 * coalesce(e, 0) / (n * (n - 1) + 1e-6), 6) AS density, 0.0::DOUBLE AS boundary_count, 0.0::DOUBLE AS boundary_ratio, """ + ", ".join(f"round(share_{t}, 6) AS share_{t}" for t in E.GATE_TYPES) + ", " + ", ".join(f'round("mean_{m}", 6) AS "mean_{m}"' for m in X.MEANS) + " FROM dn LEFT JOIN pe USING (design_id, component_id))"


def descriptors(c: Circuit) -> tuple[DataFrame, DataFrame]:
    comb = staged(comb_of(c))
    parts = staged(I.components(c.gates, comb))
    d = X.component_descriptors(c.gates, comb, parts, masked_features(c, *X.MEANS))
    return parts, rounded(d, *[k for k in d.columns if k == "density" or k[:5] in ("share", "mean_")])


circuit_query("component_descriptors", DESCRIPTORS + " SELECT * FROM descriptor")(lambda c: descriptors(c)[1])
circuit_query("gate_with_descriptor", DESCRIPTORS + " SELECT design_id, gid, component_id, node_count, density FROM component JOIN descriptor USING (design_id, component_id)")(
    lambda c: X.with_components(*descriptors(c)).select("design_id", "gid", "component_id", "node_count", "density")
)

# --- probability and simulation -------------------------------------------------------------------------------------------

PROBABILITY = """si AS (SELECT design_id, dst AS gid, list(src ORDER BY pin_pos) AS srcs FROM edges GROUP BY ALL),
gi AS (SELECT g.design_id, g.gid, gtype, srcs, d.d FROM gates g LEFT JOIN si USING (design_id, gid) LEFT JOIN (SELECT design_id, gid, max(driver) AS d FROM pins WHERE gtype = 'dff' AND pin = 'D' GROUP BY ALL) d USING (design_id, gid)),
sw(design_id, gid, st) AS (SELECT DISTINCT design_id, -1::BIGINT, []::DOUBLE[] FROM gates UNION ALL SELECT sw.design_id, gi.gid, list_append(st, CASE WHEN gtype = 'dff' OR srcs IS NULL THEN 0.5
 WHEN gtype = 'not' THEN 1 - st[srcs[1] + 1] WHEN gtype = 'buf' THEN st[srcs[1] + 1] WHEN gtype = 'and' THEN list_product(list_transform(srcs, lambda s: st[s + 1])) WHEN gtype = 'nand' THEN 1 - list_product(list_transform(srcs, lambda s: st[s + 1]))
 WHEN gtype = 'or' THEN 1 - list_product(list_transform(srcs, lambda s: 1 - st[s + 1])) WHEN gtype = 'nor' THEN list_product(list_transform(srcs, lambda s: 1 - st[s + 1]))
 WHEN gtype = 'xor' THEN (1 - list_product(list_transform(srcs, lambda s: 1 - 2 * st[s + 1]))) / 2 ELSE 1 - (1 - list_product(list_transform(srcs, lambda s: 1 - 2 * st[s + 1]))) / 2 END)
 FROM sw JOIN gi ON gi.design_id = sw.design_id AND gi.gid = sw.gid + 1),
whole AS (SELECT sw.design_id, st FROM sw JOIN (SELECT DISTINCT design_id, n_gates FROM gates) n ON n.design_id = sw.design_id AND sw.gid = n_gates - 1),
df AS (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY gid) AS k FROM gi WHERE gtype = 'dff'),
se(design_id, k, st) AS (SELECT design_id, 0::BIGINT, st FROM whole UNION ALL SELECT se.design_id, df.k, list_concat(list_concat(st[1:df.gid], [CASE WHEN d IS NOT NULL THEN st[d + 1] WHEN srcs IS NOT NULL THEN list_avg(list_transform(srcs, lambda s: st[s + 1])) ELSE 0.5 END]), st[df.gid + 2:])
 FROM se JOIN df ON df.design_id = se.design_id AND df.k = se.k + 1),
fin AS (SELECT design_id, arg_max(st, k) AS st FROM se GROUP BY 1)"""
circuit_query("signal_probability", PROBABILITY + """
SELECT design_id, gid, round(st[gid + 1], 6) AS p1 FROM fin JOIN gates USING (design_id)""")(lambda c: rounded(M.signal_probability(c.gates, c.pins, edges_of(c), staged(I.levels(c.gates, comb_of(c)))), "p1"))
#: All 48 columns before the mask: those that FEATURE_PARTS leaves 0 are worked out; tallies stay 0 without a simulation.
_UNMASKED = {c: f"CASE WHEN gtype = 'dff' AND {'DFF' in c} THEN 0 ELSE coalesce(dw.{c}, -1) END" for c in DISTANCE_COLUMNS} | {"fanin_same_type": "coalesce(sm.same, 0)", "p_is_1": "st[g.gid + 1]"}
RAW = f"""{FEATURE_PARTS}, {PROBABILITY},
sm AS (SELECT e.design_id, e.dst AS gid, avg((a.gtype = b.gtype)::INT) AS same FROM edges e JOIN gates a ON a.design_id = e.design_id AND a.gid = e.src JOIN gates b ON b.design_id = e.design_id AND b.gid = e.dst GROUP BY ALL),
raw AS MATERIALIZED (SELECT g.design_id, g.gid, g.gate_name, y, {", ".join(f'({_UNMASKED[c]})::DOUBLE AS "{c}"' if c in _UNMASKED else f'feat."{c}"' for c in FEATURES)}
FROM gates g JOIN feat USING (design_id, gid) JOIN fin ON fin.design_id = g.design_id LEFT JOIN dw ON dw.design_id = g.design_id AND dw.gid = g.gid LEFT JOIN sm ON sm.design_id = g.design_id AND sm.gid = g.gid)"""


def _scaled_sql(c: str, table: str) -> str:
    x = f'{table}."{c}"'
    if c in DISTANCE_COLUMNS:
        return f"CASE WHEN {x} < 0 THEN -1.0 ELSE coalesce({x} / nullif(max({x}) OVER d, 0), 0) END"
    if c == "level":
        return f"coalesce({x} / nullif(max({x}) OVER d, 0), 0)"
    if c in ("in_type_cnt", "out_type_cnt"):
        return f"{x} / 9.0"
    return x if c in M.TALLY_COLUMNS else f"coalesce(({x} - min({x}) OVER d) / nullif(max({x}) OVER d - min({x}) OVER d, 0), 0)"


def unmasked_features(c: Circuit) -> DataFrame:
    return X.raw_features(c.gates, c.pins, c.ports)


def audit_all(c: Circuit) -> DataFrame:
    """The whole audit table: every raw column, and every column that can be scaled and is on under the default mask."""
    raw = staged(unmasked_features(c))
    on = X.scaled_columns()
    return rounded(N.audit_gates(c.gates, c.gates, raw, X.scaled(raw, on), on), "raw__p_is_1", "raw__fanin_same_type", *[f"norm__{x}" for x in on])


circuit_query("unmasked_features", RAW + " SELECT design_id, gid, " + ", ".join(f'round("{c}", 6) AS "{c}"' if c in ("p_is_1", "fanin_same_type") else f'"{c}"' for c in FEATURES) + " FROM raw")(lambda c: rounded(unmasked_features(c), "p_is_1", "fanin_same_type"))
circuit_query("audit_all_gates", RAW + " SELECT design_id, gid, gate_name, y, " + ", ".join(f'round("{c}", 6) AS "raw__{c}"' if c in ("p_is_1", "fanin_same_type") else f'"{c}" AS "raw__{c}"' for c in FEATURES) + ", "
    + ", ".join(f'round({_scaled_sql(c, "raw")}, 6) AS "norm__{c}"' for c in X.scaled_columns()) + " FROM raw WINDOW d AS (PARTITION BY design_id)")(audit_all)
circuit_query("audit_ports", "SELECT design_id, coalesce(string_agg(DISTINCT net, chr(10) ORDER BY net) FILTER (direction = 'in'), '') AS inputs, coalesce(string_agg(DISTINCT net, chr(10) ORDER BY net) FILTER (direction = 'out'), '') AS outputs FROM ports GROUP BY 1")(lambda c: N.audit_ports(c.ports))
circuit_query("scaled_all_features", FEATURE_PARTS + " SELECT design_id, gid, " + ", ".join(f'round({_scaled_sql(c, "feat")}, 6) AS "{c}"' if c in X.scaled_columns() else f'"{c}"' for c in FEATURES) + " FROM feat WINDOW d AS (PARTITION BY design_id)")(
    lambda c: rounded(X.scaled(masked_features(c), X.scaled_columns()), *X.scaled_columns())
)
circuit_query("random_simulation")(lambda c: M.random_simulation(c.gates, c.pins, edges_of(c)))

STIMULUS_CYCLES = 4
WAVE = f"""si AS (SELECT design_id, dst AS gid, list(src ORDER BY pin_pos) AS srcs FROM edges GROUP BY ALL),
gi AS MATERIALIZED (SELECT g.design_id, g.gid, gtype, srcs, n_gates, d.d FROM gates g LEFT JOIN si USING (design_id, gid) LEFT JOIN (SELECT design_id, gid, max(driver) AS d FROM pins WHERE gtype = 'dff' AND pin = 'D' GROUP BY ALL) d USING (design_id, gid)),
run(design_id, cycle, phase, gid, n, st) AS (SELECT DISTINCT design_id, 0::BIGINT, 1::BIGINT, -1::BIGINT, n_gates, list_transform(range(n_gates), lambda x: 0)::INT[] FROM gates UNION ALL
SELECT r.design_id, r.cycle + (r.phase = 2 AND r.gid = r.n - 1)::INT, CASE WHEN r.gid = r.n - 1 THEN 3 - r.phase ELSE r.phase END, gi.gid, r.n,
 list_concat(list_concat(r.st[1:gi.gid], [(CASE WHEN r.gid = r.n - 1 THEN 3 - r.phase ELSE r.phase END = 1) AND gtype <> 'dff' AND srcs IS NULL
  AND (gi.gid * 7 + (r.cycle + (r.phase = 2 AND r.gid = r.n - 1)::INT) * 3 + r.design_id) % 2 = 1
  OR (CASE WHEN r.gid = r.n - 1 THEN 3 - r.phase ELSE r.phase END = 1) AND gtype <> 'dff' AND srcs IS NOT NULL AND
   CASE gtype WHEN 'and' THEN list_min(list_transform(srcs, lambda x: r.st[x + 1])) WHEN 'nand' THEN 1 - list_min(list_transform(srcs, lambda x: r.st[x + 1])) WHEN 'or' THEN list_max(list_transform(srcs, lambda x: r.st[x + 1]))
    WHEN 'nor' THEN 1 - list_max(list_transform(srcs, lambda x: r.st[x + 1])) WHEN 'xor' THEN list_sum(list_transform(srcs, lambda x: r.st[x + 1])) % 2 WHEN 'xnor' THEN 1 - list_sum(list_transform(srcs, lambda x: r.st[x + 1])) % 2
    WHEN 'not' THEN 1 - r.st[srcs[1] + 1] ELSE r.st[srcs[1] + 1] END = 1
  OR (CASE WHEN r.gid = r.n - 1 THEN 3 - r.phase ELSE r.phase END = 1) AND gtype = 'dff' AND r.st[gi.gid + 1] = 1
  OR (CASE WHEN r.gid = r.n - 1 THEN 3 - r.phase ELSE r.phase END = 2) AND CASE WHEN gtype = 'dff' AND d IS NOT NULL THEN r.st[d + 1] = 1 ELSE r.st[gi.gid + 1] = 1 END]::INT[]), r.st[gi.gid + 2:])
FROM run r JOIN gi ON gi.design_id = r.design_id AND gi.gid = (r.gid + 1) % r.n WHERE NOT (r.cycle = {STIMULUS_CYCLES - 1} AND r.phase = 2 AND r.gid = r.n - 1))"""
circuit_query("waveform_of_stimulus", WAVE + " SELECT run.design_id, g.gid, cycle, run.st[g.gid + 1] AS bit FROM run JOIN gates g ON g.design_id = run.design_id WHERE phase = 2 AND run.gid = n - 1")(
    lambda c: M.random_simulation(
        c.gates, c.pins, edges_of(c), cycles=STIMULUS_CYCLES, wave=True,
        stimulus=c.gates.select("design_id", "gid", F.explode(F.sequence(F.lit(0), F.lit(STIMULUS_CYCLES - 1))).alias("cycle")).withColumn("bit", F.expr("cast((gid * 7 + cycle * 3 + design_id) % 2 AS int)")),
    )
)


@register("event_switching", """WITH b AS (SELECT user_id, ts, event_id, (value > 100)::INT AS bit FROM events),
s AS (SELECT *, lag(bit) OVER w AS last, row_number() OVER w - row_number() OVER (PARTITION BY user_id, bit ORDER BY ts, event_id) AS island FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, bit, island, count(*) AS run FROM s GROUP BY ALL)
SELECT user_id, falls AS num_1to0, rises AS num_0to1, coalesce(l1, 0) AS longest_1, coalesce(l0, 0) AS longest_0, ones AS total_1 FROM (SELECT user_id, count(*) FILTER (last = 1 AND bit = 0) AS falls, count(*) FILTER (last = 0 AND bit = 1) AS rises, count(*) FILTER (bit = 1) AS ones FROM s GROUP BY 1)
JOIN (SELECT user_id, max(run) FILTER (bit = 1) AS l1, max(run) FILTER (bit = 0) AS l0 FROM r GROUP BY 1) USING (user_id)""", view=False)
def event_switching(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", F.coalesce((F.col("value") > 100).cast("int"), F.lit(0)).alias("bit"))
    return M.switching_tallies(bits, ["user_id"], ["ts", "event_id"])


# --- rewriting ------------------------------------------------------------------------------------------------------------

RULE_VALUES = ", ".join(f"('{g}', {r}, {k}, '{t}', '{o}', {ins!r})" for g, r, k, t, o, ins in R.rule_rows())
REWRITE = f"""rule(gtype, rule_id, step, out_gtype, out_sym, in_syms) AS (VALUES {RULE_VALUES}), rs AS (SELECT gtype, rule_id, count(*) AS steps, count(*) FILTER (out_sym <> '{R.RESULT}') AS nets FROM rule GROUP BY ALL),
gin AS (SELECT design_id, gid, list(net ORDER BY pin_pos) AS ins FROM pins GROUP BY ALL),
r0 AS (SELECT g.*, ins, v AS variant, CASE WHEN gtype IN ('nand','nor','xnor','xor','and','or') AND len(ins) = 2 AND (gid * 7919 + v * 104729 + design_id * 31) % 1000 / 1000.0 <= 0.3 THEN (gid + v) % 2 END AS rule_id
 FROM gates g LEFT JOIN gin USING (design_id, gid), (VALUES (0), (1)) t(v)),
r1 AS (SELECT r0.*, coalesce(steps, 0) AS steps, coalesce(nets, 0) AS nets, max(gid) OVER (PARTITION BY design_id) + 1 AS free FROM r0 LEFT JOIN rs USING (gtype, rule_id)),
r2 AS (SELECT *, free + coalesce(sum(nets) OVER w, 0) AS net0, free + coalesce(sum(steps) OVER w, 0) AS gate0 FROM r1 WINDOW w AS (PARTITION BY design_id, variant ORDER BY gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rw AS MATERIALIZED (SELECT design_id, variant, gate_name, gtype, out_net, coalesce(array_to_string(ins, ','), '') AS ins, gate_name AS old_gate FROM r2 WHERE rule_id IS NULL UNION ALL
SELECT design_id, variant, 'g' || (gate0 + step)::BIGINT, out_gtype, CASE WHEN out_sym = '{R.RESULT}' THEN out_net ELSE 'n' || (net0 + out_sym[2:]::INT)::BIGINT END,
array_to_string(list_transform(in_syms, lambda s: CASE s WHEN '{R.FIRST}' THEN r2.ins[1] WHEN '{R.SECOND}' THEN r2.ins[2] WHEN '{R.RESULT}' THEN out_net ELSE 'n' || (net0 + coalesce(try_cast(s[2:] AS INT), 0))::BIGINT END), ','), gate_name FROM r2 JOIN rule USING (gtype, rule_id))"""


def rewritten(c: Circuit) -> tuple[DataFrame, DataFrame]:
    draw = F.expr("(gid * 7919 + variant * 104729 + design_id * 31) % 1000 / 1000.0D")
    return R.rewrite(c.gates, c.pins, rate=0.3, variants=2, draw=draw, choice=F.expr("cast((gid + variant) % 2 AS int)"))


circuit_query("rewrite_gates", REWRITE + " SELECT design_id, variant::BIGINT AS variant, gate_name, gtype, out_net, ins FROM rw")(lambda c: rewritten(c)[0].select("design_id", "variant", "gate_name", "gtype", "out_net", F.array_join("ins", ",").alias("ins")))
circuit_query("remap_labels", REWRITE + " SELECT design_id, variant::BIGINT AS variant, gate_name FROM rw WHERE EXISTS (SELECT 1 FROM gates g WHERE g.design_id = rw.design_id AND g.gate_name = rw.old_gate AND g.y = 1)")(
    lambda c: R.remap_labels(c.gates.filter("y = 1").select("design_id", "gate_name"), rewritten(c)[1])
)
circuit_query("next_free_ids", "SELECT design_id, max(gid) + 1 AS next_net, max(gid) + 1 AS next_gate FROM gates GROUP BY 1")(lambda c: R.next_free_ids(c.gates))


@circuit_query("rewrite_equivalence", "SELECT design_id, v::BIGINT AS variant, count(*) AS nets, 0::BIGINT AS differing FROM gates, (VALUES (0), (1)) t(v) WHERE is_po GROUP BY 1, 2")
def rewrite_equivalence(c: Circuit) -> DataFrame:
    new = staged(rewritten(c)[0])
    before = R.equivalence_words(c.gates, c.pins.join(c.gates.select("design_id", "gid", "gate_name"), ["design_id", "gid"]).select("design_id", "gate_name", "net"), ["design_id"])
    after = R.equivalence_words(new, new.select("design_id", "variant", "gate_name", F.explode("ins").alias("net")), ["design_id", "variant"])
    return R.equivalent_outputs(before, after, c.ports.filter("direction = 'out'").select("design_id", "net").distinct())


circuit_query("rewrite_rules_used", REWRITE + f""", tb AS (SELECT gtype, rule_id, 4 AS rows, 0 AS wrong FROM rule GROUP BY 1, 2)
SELECT gtype, rule_id::BIGINT AS rule_id, count(*) AS gates, any_value(rows)::BIGINT AS rows, any_value(wrong)::BIGINT AS wrong FROM r0 JOIN tb USING (gtype, rule_id) GROUP BY 1, 2""")(lambda c: rules_used(c))


def rules_used(c: Circuit) -> DataFrame:
    """How often each rule replaces a gate, and in how many rows of its truth table it is wrong."""
    checked = R.check_rules(c.gates.sparkSession).groupBy("gtype", "rule_id").agg(F.count("*").alias("rows"), F.count_if(F.col("want") != F.col("got")).alias("wrong"))
    new, mapping = rewritten(c)
    replaced = mapping.groupBy("design_id", "variant", "old_gate").agg(F.count("*").alias("made"), F.first("new_gate").alias("new")).filter("made > 1 OR new <> old_gate")
    rule = F.expr("cast((gid + variant) % 2 AS int)").alias("rule_id")
    used = replaced.join(c.gates.select("design_id", F.col("gate_name").alias("old_gate"), "gtype", "gid"), ["design_id", "old_gate"]).select("gtype", rule)
    return longs(used.groupBy("gtype", "rule_id").agg(F.count("*").alias("gates")).join(F.broadcast(checked), ["gtype", "rule_id"]), "rule_id")


#: The types whose outputs are each other's inverse.
INVERSE = {"and": "nand", "nand": "and", "or": "nor", "nor": "or", "xor": "xnor", "xnor": "xor", "not": "buf", "buf": "not"}


@circuit_query("inequivalent_outputs", """SELECT design_id, 0::BIGINT AS variant, count(*) AS nets, count(*) FILTER (gtype <> 'dff' AND EXISTS (SELECT 1 FROM pins p WHERE p.design_id = g.design_id AND p.gid = g.gid)
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.design_id = g.design_id AND e.src = g.gid)) AS differing FROM gates g WHERE is_po GROUP BY 1""")
def inequivalent_outputs(c: Circuit) -> DataFrame:
    """The check must fail where it should: gates that only drive an output are inverted, and each such output differs."""
    named = c.pins.join(c.gates.select("design_id", "gid", "gate_name"), ["design_id", "gid"]).select("design_id", "gate_name", "net")
    flip = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])
    last = E.sink_flags(c.gates, edges_of(c)).filter("is_sink_gate = 1").select("design_id", "gid", F.lit(True).alias("last"))
    gates = c.gates.join(last, ["design_id", "gid"], "left").withColumn("gtype", F.when(F.col("last") & F.col("is_po") & (F.col("gtype") != "dff"), flip[F.col("gtype")]).otherwise(F.col("gtype")))
    before = R.equivalence_words(c.gates, named, ["design_id"])
    zero = F.lit(0).cast("long").alias("variant")
    after = R.equivalence_words(staged(gates.select("design_id", zero, "gate_name", "gtype", "out_net")), named.select("design_id", zero, "gate_name", "net"), ["design_id", "variant"])
    return R.equivalent_outputs(before, after, c.ports.filter("direction = 'out'").select("design_id", "net").distinct())


PLANTED = "planted AS (SELECT design_id, min(gid) AS gid FROM gates g WHERE gtype <> 'dff' AND gid >= 7 AND EXISTS (SELECT 1 FROM pins p WHERE p.design_id = g.design_id AND p.gid = g.gid) GROUP BY 1)"


@circuit_query("first_differing_nets", PLANTED + " SELECT design_id, w::BIGINT AS w, 'n' || gid AS net FROM planted, (VALUES (0), (1)) t(w)")
def first_differing_nets(c: Circuit) -> DataFrame:
    """One gate of each design is inverted; of all nets that differ, in two words of 64 vectors each, its own is the first."""
    named = c.pins.join(c.gates.select("design_id", "gid", "gate_name"), ["design_id", "gid"]).select("design_id", "gate_name", "net")
    flip = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])
    fault = c.pins.filter("gtype <> 'dff' AND gid >= 7").groupBy("design_id").agg(F.min("gid").alias("gid")).withColumn("fault", F.lit(True))
    word = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("w")
    gates, pins = staged(c.gates.select("design_id", word, "gid", "gate_name", "gtype", "out_net")), staged(named.select("design_id", word, "gate_name", "net"))
    wrong = staged(gates.join(fault, ["design_id", "gid"], "left").withColumn("gtype", F.when(F.col("fault"), flip[F.col("gtype")]).otherwise(F.col("gtype"))).select(*gates.columns))
    keys = ["design_id", "w"]
    before, after = (R.equivalence_words(g, pins, keys, salt=["w"]) for g in (gates, wrong))
    return R.first_differing(before, after, wrong, pins, keys, keys)


# --- corpus ---------------------------------------------------------------------------------------------------------------

PROVENANCE = """st AS (SELECT DISTINCT design_id, CASE design_id % 4 WHEN 0 THEN 'top1_trojan' || (design_id % 5) || '_' || design_id || '_netlist' WHEN 1 THEN 'trojan' || (design_id % 5) || '_' || design_id || '_g_netlist'
 WHEN 2 THEN 'design' || design_id || '_0.2_1_netlist' ELSE 'TjFree_aes' || design_id || '_netlist' END AS stem, CASE design_id % 4 WHEN 0 THEN 'design_compiler' WHEN 1 THEN 'genus' WHEN 2 THEN 'augmentation' ELSE 'trojan_free' END AS pipeline FROM gates),
pv AS (SELECT *, CASE design_id % 4 WHEN 0 THEN 'top1' WHEN 1 THEN '' WHEN 2 THEN 'design' || design_id ELSE 'aes' || design_id END AS base_design, CASE WHEN design_id % 4 < 2 THEN (design_id % 5)::VARCHAR ELSE '' END AS trojan_type,
 CASE design_id % 4 WHEN 0 THEN design_id::VARCHAR WHEN 1 THEN design_id::VARCHAR WHEN 2 THEN '1' ELSE '' END AS variant, CASE WHEN design_id % 4 = 2 THEN '0.2' ELSE '' END AS rewrite_rate FROM st)"""
MANIFEST = f"{TEXT}, {PROVENANCE}" + """, mf AS MATERIALIZED (SELECT pv.stem || '.v' AS file, pipeline, base_design, trojan_type, variant, rewrite_rate, CASE WHEN design_id % 10 = 9 THEN 'UNLABELLED' WHEN max(y) = 1 THEN 'TROJANED' ELSE 'NO_TROJAN' END AS label,
count(*) AS gates, CASE WHEN design_id % 10 = 9 THEN 0 ELSE sum(y) END::BIGINT AS trojan_gates, strlen(any_value(content)) AS bytes FROM gates JOIN pv USING (design_id) JOIN netlist USING (design_id) GROUP BY design_id, stem, pipeline, base_design, trojan_type, variant, rewrite_rate)"""


def corpus_stems(c: Circuit) -> DataFrame:
    return c.gates.select("design_id").distinct().select(
        "design_id",
        F.expr("CASE design_id % 4 WHEN 0 THEN concat('top1_trojan', design_id % 5, '_', design_id, '_netlist') WHEN 1 THEN concat('trojan', design_id % 5, '_', design_id, '_g_netlist') WHEN 2 THEN concat('design', design_id, '_0.2_1_netlist') ELSE concat('TjFree_aes', design_id, '_netlist') END").alias("stem"),
        F.expr("CASE design_id % 4 WHEN 0 THEN 'design_compiler' WHEN 1 THEN 'genus' WHEN 2 THEN 'augmentation' ELSE 'trojan_free' END").alias("pipeline"),
    )


def manifest_of(c: Circuit) -> DataFrame:
    texts = text_of(c).withColumn("bytes", F.octet_length("content"))
    return C.manifest(texts, corpus_stems(c), Y.label_summary(label_files(c).withColumnRenamed("body", "content").filter("design_id % 10 <> 9")))


circuit_query("stem_provenance", PROVENANCE + " SELECT * FROM pv")(lambda c: C.provenance(corpus_stems(c)))
circuit_query("manifest", MANIFEST + " SELECT file, pipeline, base_design, trojan_type, variant, rewrite_rate, label, gates, trojan_gates, bytes FROM mf")(manifest_of)
circuit_query("manifest_summary", MANIFEST + """ SELECT pipeline, count(*) AS files, count(*) FILTER (label = 'TROJANED') AS trojaned, count(*) FILTER (label = 'NO_TROJAN') AS clean, count(*) FILTER (label = 'UNLABELLED') AS unlabelled, sum(gates)::BIGINT AS gates,
list_sort(list(gates))[count(*) // 2 + 1] AS median_gates, round(coalesce(sum(trojan_gates) FILTER (label = 'TROJANED'), 0) / greatest(1, coalesce(sum(gates) FILTER (label = 'TROJANED'), 0)), 6) AS trojan_share FROM mf GROUP BY ROLLUP (pipeline)""")(
    lambda c: rounded(C.manifest_summary(manifest_of(c)), "trojan_share")
)
circuit_query("corpus_composition", MANIFEST + """ SELECT trojan_type, count(*) AS files, min(gates) AS least_gates, quantile_cont(gates, 0.5)::DOUBLE AS median_gates, max(gates) AS most_gates, """ + ", ".join(f"round(quantile_cont(trojan_gates / greatest(gates, 1), {q / 100}), 6) AS share_p{q}" for q in (10, 50, 90)) + " FROM mf GROUP BY 1")(
    lambda c: rounded(C.composition(manifest_of(c)), "share_p10", "share_p50", "share_p90")
)
circuit_query("gate_counts", "SELECT design_id, count(*) AS gates, count(*) FILTER (gtype <> 'dff') AS rewritable FROM gates GROUP BY 1")(lambda c: C.gate_count(text_of(c)))
circuit_query("solved_by_content", TEXT + """, lib AS (SELECT content, bool_or(y = 1) AS is_trojaned FROM netlist JOIN gates USING (design_id) WHERE design_id % 2 = 0 GROUP BY 1) SELECT design_id, l.content IS NOT NULL AS known, l.is_trojaned FROM netlist n LEFT JOIN lib l ON sha256(n.content) = sha256(l.content)""")(
    lambda c: (lambda t: C.solved_by_content(t, t.filter("design_id % 2 = 0").join(c.gates.groupBy("design_id").agg((F.max("y") == 1).alias("is_trojaned")), "design_id").select("content", "is_trojaned")))(staged(text_of(c)))
)

# --- kept graphs, and detection from end to end ---------------------------------------------------------------------------


def store_of(c: Circuit, with_features: bool = False) -> G.GraphStore:
    e = staged(edges_of(c))
    extra = {"features": staged(masked_features(c)), "components": I.components(c.gates, E.combinational(e, c.gates))} if with_features else {}
    return G.write_store(new_folder(c.gates.sparkSession, "stores"), c.gates, e, buckets=8, **extra)


circuit_query("stored_degrees", """so AS (SELECT design_id, src AS gid, count(*) AS n, count(*) - count(DISTINCT dst) AS p FROM edges GROUP BY ALL), st AS (SELECT design_id, dst AS gid, count(*) AS n FROM edges GROUP BY ALL)
SELECT design_id, gid, gtype, coalesce(so.n, 0) AS loads, coalesce(so.p, 0) AS parallel, coalesce(st.n, 0) AS drivers FROM gates LEFT JOIN so USING (design_id, gid) LEFT JOIN st USING (design_id, gid)""")(lambda c: G.stored_degrees(store_of(c)))
circuit_query("stored_examples", f"{FEATURE_PARTS}, {COMPONENTS} SELECT design_id, gid, gate_name, y::INT AS y, component_id, " + ", ".join(f'feat."{c}"' for c in FEATURES) + " FROM gates JOIN feat USING (design_id, gid) JOIN component USING (design_id, gid)")(
    lambda c: G.stored_examples(store_of(c, with_features=True))
)


def updated_components(c: Circuit) -> DataFrame:
    """Components of the edges into first pins, stored, and then merged along the edges into other pins."""
    e = staged(edges_of(c))
    pairs = lambda some: E.undirected_pairs(E.combinational(some, c.gates))
    stored = staged(I.component_roots(c.gates, pairs(e.filter("pin_pos = 0"))))
    return I.numbered_components(I.merged_roots(stored, pairs(e.filter("pin_pos > 0"))))


circuit_query("updated_components", COMPONENTS + " SELECT design_id, gid, component_id FROM component")(updated_components)


RULE_READS = ["is_xor", "is_nand", "in_type_cnt", "out_type_cnt", "is_PI"]


def rule_score(features: DataFrame) -> DataFrame:
    """A made-up rule over the features, for the query: a half and more where its whole-number sum reaches 0."""
    z = 4 * F.col("is_xor") + 3 * F.col("is_nand") + F.col("in_type_cnt") - F.col("out_type_cnt") + F.col("is_PI") - 2
    return features.select("design_id", "gid", (1 / (1 + F.exp(-z))).alias("p"))


def detected(c: Circuit) -> DataFrame:
    """Verdicts over the rendered texts; every fifth design's answer is known by its content, and one text in seven has no gates."""
    texts = staged(text_of(c))
    answers = c.gates.groupBy("design_id").agg((F.max("y") == 1).alias("is_trojaned"), F.collect_list(F.when(F.col("y") == 1, F.col("gate_name"))).alias("gate_names"))
    library = staged(texts.filter("design_id % 5 = 0").join(answers, "design_id").select(F.sha2("content", 256).alias("digest"), "is_trojaned", "gate_names"))
    given = texts.union(texts.filter("design_id % 7 = 0").select(F.col("design_id") + 1000, F.concat(F.lit("module e"), F.col("design_id"), F.lit("();\nendmodule"))))
    done = D.detect(given, new_folder(c.gates.sparkSession, "detected"), rule_score, library, reads=RULE_READS)
    return done.drop("digest")


RULE = FILTERS.replace("FROM gates WHERE p >= 0.5", 'FROM feat WHERE design_id % 5 <> 0 AND 4 * is_xor + 3 * is_nand + in_type_cnt - out_type_cnt + "is_PI" - 2 >= 0')
circuit_query("detect_verdicts", f"""{FEATURE_PARTS}, {RULE}, n AS (SELECT design_id, count(*) AS gates, sum(y)::BIGINT AS y FROM gates GROUP BY 1), m AS (SELECT design_id, count(*) AS flagged FROM f3 GROUP BY 1)
SELECT design_id, CASE WHEN design_id % 5 = 0 THEN 'lookup' ELSE 'model' END AS source, gates, CASE WHEN design_id % 5 = 0 THEN y ELSE coalesce(flagged, 0) END AS flagged,
CASE WHEN design_id % 5 = 0 THEN y > 0 ELSE coalesce(flagged, 0) > 0 END AS trojaned, NULL::VARCHAR AS reason FROM n LEFT JOIN m USING (design_id)
UNION ALL SELECT design_id + 1000, 'rejected', 0, 0, NULL, 'no gates' FROM n WHERE design_id % 7 = 0""")(detected)

# --- learning -------------------------------------------------------------------------------------------------------------

circuit_query("class_balance", "SELECT count(*) AS gates, sum(y)::BIGINT AS positives, round(avg(y), 6) AS rate, CASE WHEN avg(y) < 0.2 THEN 0.8 ELSE 0.5 END::DOUBLE AS alpha FROM gates")(lambda c: rounded(L.class_balance(c.gates), "rate"))
circuit_query("focal_loss", "SELECT round(avg(0.8 * pow(1 - pt, 2) * -ln(pt)), 6) AS focal_loss FROM (SELECT greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12) AS pt FROM gates)")(lambda c: rounded(L.focal_loss(c.gates, 0.8, 2.0), "focal_loss"))

EPOCHS = "log AS (SELECT 'run' || (design_id % 5) AS run, gid AS epoch, floor(avg(p) * 10000 + 1e-6) / 10000 AS f1, floor(avg(abs(p - y)) * 10000 + 1e-6) / 10000 AS loss FROM gates GROUP BY ALL)"


def epoch_log(c: Circuit) -> DataFrame:
    return c.gates.groupBy(F.concat(F.lit("run"), F.col("design_id") % 5).alias("run"), F.col("gid").alias("epoch")).agg(*[(F.floor(F.avg(x) * 10000 + 1e-6) / 10000).alias(n) for n, x in (("f1", F.col("p")), ("loss", F.abs(F.col("p") - F.col("y"))))])


circuit_query("best_epochs", EPOCHS + " SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY run ORDER BY f1 DESC, loss, epoch) = 1")(lambda c: L.best_epochs(epoch_log(c)))
circuit_query("epoch_staleness", EPOCHS + """, b AS (SELECT *, max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM log)
SELECT run, epoch, f1, loss, epoch - max(CASE WHEN best IS NULL OR f1 > best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS stale FROM b""")(lambda c: L.staleness(epoch_log(c)))

HOP = """hop{k} AS (SELECT e.design_id, e.dst AS gid, sum(h.x / sqrt(ds.d * dd.d)) AS x FROM el e JOIN dg ds ON ds.design_id = e.design_id AND ds.gid = e.src JOIN dg dd ON dd.design_id = e.design_id AND dd.gid = e.dst JOIN {f} h ON h.design_id = e.design_id AND h.gid = e.src GROUP BY 1, 2)"""
circuit_query("graph_propagation", "el AS (SELECT design_id, src, dst FROM edges UNION ALL SELECT design_id, gid, gid FROM gates), dg AS (SELECT design_id, dst AS gid, count(*) AS d FROM el GROUP BY 1, 2), x0 AS (SELECT design_id, gid, p AS x FROM gates), "
    + HOP.format(k=1, f="x0") + ", " + HOP.format(k=2, f="hop1").replace("hop2 AS", "hop2 AS") + " SELECT g.design_id, g.gid, g.p, round(hop1.x, 6) AS p_fw1, round(hop2.x, 6) AS p_fw2 FROM gates g JOIN hop1 USING (design_id, gid) JOIN hop2 USING (design_id, gid)")(
    lambda c: rounded(L.propagate(edges_of(c), c.gates, ["p"], 2), "p_fw1", "p_fw2").select("design_id", "gid", "p", "p_fw1", "p_fw2")
)


#: Made-up layers for the query: weight of input i (-1: the bias) and output j.
HIDDEN = [[((i + 2) * (j + 3) % 7 - 3) / 3 for j in range(4)] for i in range(-1, 3)]
OUTPUT = [[((i + 3) * (j + 2) % 5 - 2) / 2 for j in range(2)] for i in range(-1, 4)]
_hidden = ", ".join(f"greatest(0, {HIDDEN[0][j]} + {' + '.join(f'({HIDDEN[i + 1][j]}) * x{i}' for i in range(3))}) AS h{j}" for j in range(4))
_output = ", ".join(f"{OUTPUT[0][j]} + {' + '.join(f'({OUTPUT[i + 1][j]}) * h{i}' for i in range(4))} AS z{j}" for j in range(2))
circuit_query("dense_scores", "el AS (SELECT design_id, src, dst FROM edges UNION ALL SELECT design_id, gid, gid FROM gates), dg AS (SELECT design_id, dst AS gid, count(*) AS d FROM el GROUP BY 1, 2), x0 AS (SELECT design_id, gid, p AS x FROM gates), "
    + HOP.format(k=1, f="x0") + ", er AS (SELECT design_id, dst AS src, src AS dst FROM el), dr AS (SELECT design_id, dst AS gid, count(*) AS d FROM er GROUP BY 1, 2), " + HOP.format(k=2, f="x0").replace("FROM el e", "FROM er e").replace("JOIN dg", "JOIN dr")
    + f", xs AS (SELECT g.design_id, g.gid, p AS x0, hop1.x AS x1, hop2.x AS x2 FROM gates g JOIN hop1 USING (design_id, gid) JOIN hop2 USING (design_id, gid)), hs AS (SELECT design_id, gid, {_hidden} FROM xs), zs AS (SELECT design_id, gid, {_output} FROM hs) SELECT design_id, gid, round(1 / (1 + exp(z0 - z1)), 6) AS p FROM zs")(
    lambda c: rounded(dense_scores(c), "p")
)


def dense_scores(c: Circuit) -> DataFrame:
    rows = L.propagate(edges_of(c), c.gates, ["p"], 1)
    weights = [("0", i - 1, j, w) for i, row in enumerate(HIDDEN) for j, w in enumerate(row)] + [("1", i - 1, j, w) for i, row in enumerate(OUTPUT) for j, w in enumerate(row)]
    return L.dense_scores(rows, ["p", "p_fw1", "p_bw1"], c.gates.sparkSession.createDataFrame(weights, "layer string, i int, j int, w double"))


@circuit_query("trained_classifier")
def trained_classifier(c: Circuit) -> DataFrame:
    rows = staged(L.propagate(edges_of(c), c.gates, ["p"], 2).join(c.gates.select("design_id", "gid", "y"), ["design_id", "gid"]))
    scored = L.train_classifier(rows, ["p", "p_fw1", "p_bw1", "p_fw2", "p_bw2"])[1]
    return L.best_threshold(S.corpus_metrics(scored, scored, [0.1, 0.3, 0.5, 0.7, 0.9]))


#: A made-up network for the query: three inputs, three hops of two outputs, two numbers of a component, a head of three.
NETWORK = {f"conv{k}.{x}": (3 if k == 0 else 2, 2) for k in range(3) for x in ("fw", "bw")} | {f"conv{k}.join": (4, 2) for k in range(3)} | {"part.0": (2, 2), "part.1": (2, 2), "head.0": (8, 3), "head.1": (3, 2)}
NETWORK_WEIGHTS = {name: [[((3 * i + 5 * j + 6 * k + i * j) % 7 - 2) / 6 for j in range(n)] for i in range(m + 1)] for k, (name, (m, n)) in enumerate(sorted(NETWORK.items()))}
INPUTS = ["p", "is_dff", "is_xor"]


def _outputs(layer: str, columns: list[str]) -> list[str]:
    bias, *rows = NETWORK_WEIGHTS[layer]
    return [f"({b} + {' + '.join(f'({w[j]}) * {c}' for w, c in zip(rows, columns))})" for j, b in enumerate(bias)]


def _relu(layer: str, columns: list[str]) -> list[str]:
    return [f"greatest(0, {x})" for x in _outputs(layer, columns)]


def _named(values: list[str], name: str) -> str:
    return ", ".join(f"{x} AS {name}{k}" for k, x in enumerate(values))


def _network_sql() -> str:
    ways = "el AS (SELECT design_id, src, dst FROM edges UNION ALL SELECT design_id, gid, gid FROM gates)"
    for way, (a, z) in (("fw", ("src", "dst")), ("bw", ("dst", "src"))):
        ways += f", d{way} AS (SELECT design_id, {z} AS gid, count(*) AS d FROM el GROUP BY 1, 2), w{way} AS MATERIALIZED (SELECT e.design_id, e.{a} AS src, e.{z} AS dst, 1 / sqrt(s.d * t.d) AS w FROM el e "
        ways += f"JOIN d{way} s ON s.design_id = e.design_id AND s.gid = e.{a} JOIN d{way} t ON t.design_id = e.design_id AND t.gid = e.{z})"
    sql = f"{COMPONENTS}, {ways}, h0 AS (SELECT design_id, gid, p AS x0, (gtype = 'dff')::DOUBLE AS x1, (gtype = 'xor')::DOUBLE AS x2 FROM gates)"
    wide = 3
    for k in range(3):
        for way in ("fw", "bw"):
            sql += f", {way}{k} AS (SELECT w.design_id, w.dst AS gid, {', '.join(f'sum(w.w * h.x{i}) AS {way[0]}{i}' for i in range(wide))} FROM w{way} w JOIN h{k} h ON h.design_id = w.design_id AND h.gid = w.src GROUP BY 1, 2)"
        both = [*_outputs(f"conv{k}.fw", [f"f{i}" for i in range(wide)]), *_outputs(f"conv{k}.bw", [f"b{i}" for i in range(wide)])]
        sql += f", c{k} AS (SELECT design_id, gid, {_named(both, 'c')} FROM fw{k} JOIN bw{k} USING (design_id, gid)), h{k + 1} AS MATERIALIZED (SELECT design_id, gid, {_named(_relu(f'conv{k}.join', [f'c{i}' for i in range(4)]), 'x')} FROM c{k})"
        wide = 2
    sql += ", d0 AS (SELECT design_id, component_id, count(*) / 100.0 AS n0, avg(p) AS n1 FROM component JOIN gates USING (design_id, gid) GROUP BY 1, 2)"
    sql += f", d1 AS (SELECT design_id, component_id, {_named(_relu('part.0', ['n0', 'n1']), 'm')} FROM d0), d2 AS (SELECT design_id, component_id, {_named(_outputs('part.1', ['m0', 'm1']), 'z')} FROM d1)"
    hops = [f"h{k + 1}.x{i}" for k in range(3) for i in range(2)]
    head = _relu("head.0", [*hops, "z0", "z1"])
    sql += f", e0 AS (SELECT design_id, gid, {_named(head, 'q')} FROM component JOIN d2 USING (design_id, component_id) JOIN h1 USING (design_id, gid) JOIN h2 USING (design_id, gid) JOIN h3 USING (design_id, gid))"
    sql += f", e1 AS (SELECT design_id, gid, {_named(_outputs('head.1', ['q0', 'q1', 'q2']), 'r')} FROM e0)"
    return sql + " SELECT design_id, gid, round(1 / (1 + exp(r0 - r1)), 6) AS p FROM e1"


def whole_network(c: Circuit) -> DataFrame:
    e = staged(edges_of(c))
    parts = staged(I.components(c.gates, E.combinational(e, c.gates)))
    descriptors = parts.join(c.gates.select("design_id", "gid", "p"), ["design_id", "gid"]).groupBy("design_id", "component_id").agg((F.count("*") / 100.0).alias("n0"), F.avg("p").alias("n1"))
    inputs = c.gates.select("design_id", "gid", "p", (F.col("gtype") == "dff").cast("double").alias("is_dff"), (F.col("gtype") == "xor").cast("double").alias("is_xor"))
    return W.network_scores(inputs, INPUTS, e, parts, descriptors, ["n0", "n1"], W.weight_table(c.gates.sparkSession, NETWORK_WEIGHTS))


circuit_query("network_scores", _network_sql())(lambda c: rounded(whole_network(c), "p"))

GRID = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7]
circuit_query("threshold_by_fold", f"""t(threshold) AS (SELECT unnest({GRID})::DOUBLE), m AS (SELECT design_id % 3 AS fold, threshold, count(*) FILTER (p > threshold AND y = 1) AS tp, count(*) FILTER (p > threshold AND y = 0) AS fp, count(*) FILTER (p <= threshold AND y = 1) AS fn FROM gates, t GROUP BY 1, 2),
o AS (SELECT a.*, (SELECT sum(tp) FROM m b WHERE b.threshold = a.threshold AND b.fold <> a.fold) AS ot, (SELECT sum(fp) FROM m b WHERE b.threshold = a.threshold AND b.fold <> a.fold) AS op, (SELECT sum(fn) FROM m b WHERE b.threshold = a.threshold AND b.fold <> a.fold) AS ofn FROM m a)
SELECT fold, threshold, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 1), 6) AS f1 FROM o QUALIFY row_number() OVER (PARTITION BY fold ORDER BY coalesce(2 * ot / nullif(2 * ot + op + ofn, 0), 1) DESC, threshold DESC) = 1""")(
    lambda c: rounded(W.chosen_by_fold(c.gates.select("design_id", "gid", "y", "p", (F.col("design_id") % 3).alias("fold")), GRID), "f1")
)


@circuit_query("trained_network")
def trained_network(c: Circuit) -> DataFrame:
    """fold, epoch, loss, threshold, tp, fp, fn, f1: each fold's best epoch, and its metrics at the threshold that the other folds' designs choose."""
    rows = staged(L.propagate(edges_of(c), c.gates, ["p"], 2).join(c.gates.select("design_id", "gid", "y"), ["design_id", "gid"]))
    alpha = L.class_balance(rows.select("y")).first().alpha
    scores, logs = W.out_of_fold_scores(rows, ["p", "p_fw1", "p_bw1", "p_fw2", "p_bw2"], alpha, epochs=25, patience=10)
    best = L.best_epochs(logs).select(F.substring("run", 5, 1).cast("int").alias("fold"), "epoch", "loss")
    return best.join(W.chosen_by_fold(scores, GRID), "fold")
