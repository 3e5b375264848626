"""All registered circuit queries by name, with the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelore.operators import edges as E
from gatelore.operators import features as X
from gatelore.operators import iterate as I
from gatelore.operators import score as S
from gatelore.operators import simulate as M
from gatelore.plans.testview import CIRCUIT_SQL, Circuit, circuit, kept_circuit
from gatelore.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "design_verdicts"
#: Queries that read the circuit view many times.
WRITTEN_FIRST = {
    "longest_distances", "masked_features", "scaled_features", "audit_gates", "component_descriptors", "gate_with_descriptor", "unmasked_features", "audit_all_gates", "scaled_all_features", "stored_examples",
    "detect_verdicts", "rewrite_equivalence", "inequivalent_outputs", "first_differing_nets", "random_simulation",
}


def register(name: str, sql: str | None = None, view: bool = True):
    """Register a query; ``sql`` goes behind the circuit view's own expressions."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = (CIRCUIT_SQL + ", " + sql.strip() if sql.lstrip()[:6].upper() != "SELECT" else CIRCUIT_SQL + sql) if view else sql
        return function

    return add


def circuit_query(name: str, sql: str | None = None):
    """Register a function of the circuit view; for those of ``WRITTEN_FIRST`` its tables are."""
    view = kept_circuit if name in WRITTEN_FIRST else circuit

    def add(function: Callable[[Circuit], DataFrame]):
        register(name, sql)(lambda spark, sf_dir: function(view(spark, sf_dir)))
        return function

    return add


def edges_of(c: Circuit) -> DataFrame:
    return E.build_edges(c.gates, c.pins)


def comb_of(c: Circuit) -> DataFrame:
    return E.combinational(edges_of(c), c.gates)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({k: F.round(k, 6) for k in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({k: F.col(k).cast("long") for k in columns})


# --- edges and facts from nets -------------------------------------------------------------------------------------------


circuit_query("build_edges", "SELECT design_id, src, dst, net, pin_pos FROM edges")(edges_of)
circuit_query("combinational_view", "SELECT design_id, src, dst FROM comb")(comb_of)


@circuit_query("gate_degrees", """i AS (SELECT design_id, dst AS gid, count(*) AS indegree FROM comb GROUP BY ALL), o AS (SELECT design_id, src AS gid, count(*) AS outdegree FROM comb GROUP BY ALL)
SELECT g.design_id, g.gid, coalesce(indegree, 0) AS indegree, coalesce(outdegree, 0) AS outdegree FROM gates g LEFT JOIN i USING (design_id, gid) LEFT JOIN o USING (design_id, gid)""")
def gate_degrees(c: Circuit) -> DataFrame:
    return longs(E.degrees(c.gates, comb_of(c)), "indegree", "outdegree")


circuit_query("undirected_pairs", "SELECT DISTINCT design_id, least(src, dst) AS low, greatest(src, dst) AS high FROM edges")(lambda c: E.undirected_pairs(edges_of(c)))
circuit_query("gate_type_one_hot", "SELECT design_id, gid, " + ", ".join(f"(gtype = '{t}')::DOUBLE AS is_{t}" for t in E.GATE_TYPES) + " FROM gates")(lambda c: E.one_hot(c.gates))

TWO_HOP = """e1 AS (SELECT DISTINCT design_id, src, dst FROM edges), r AS (SELECT * FROM e1 UNION SELECT a.design_id, a.src, b.dst FROM e1 a JOIN e1 b ON a.design_id = b.design_id AND a.dst = b.src),
fi AS (SELECT design_id, dst AS gid, count(*) AS fanin_2level FROM r GROUP BY ALL),
fo AS (SELECT r.design_id, r.src AS gid, count(*) AS fanout_2level, count(*) FILTER (g.gtype = 'dff') AS fanout_dff_count FROM r JOIN gates g ON g.design_id = r.design_id AND g.gid = r.dst GROUP BY ALL)"""
circuit_query("two_hop_counts", TWO_HOP + """ SELECT g.design_id, g.gid, coalesce(fanin_2level, 0) AS fanin_2level, coalesce(fanout_2level, 0) AS fanout_2level, coalesce(fanout_dff_count, 0) AS fanout_dff_count
FROM gates g LEFT JOIN fi USING (design_id, gid) LEFT JOIN fo USING (design_id, gid)""")(lambda c: E.two_hop_counts(c.gates, edges_of(c)))

IO = """io AS (SELECT g.design_id, g.gid, CASE WHEN EXISTS (SELECT 1 FROM pins p JOIN ports q ON q.design_id = p.design_id AND q.direction = 'in' AND split_part(p.net, '[', 1) = q.net
WHERE p.design_id = g.design_id AND p.gid = g.gid) THEN 1 ELSE 0 END AS "is_PI", g.is_po::INT AS "is_PO" FROM gates g)"""
circuit_query("io_flags", IO + " SELECT * FROM io")(lambda c: E.io_flags(c.gates, c.pins, c.ports))

circuit_query("pin_roles", """role AS (SELECT DISTINCT design_id, net, CASE pin WHEN 'CK' THEN 'is_ck' WHEN 'D' THEN 'is_d' WHEN 'RN' THEN 'is_rst' END AS role FROM pins WHERE gtype = 'dff'
UNION SELECT design_id, out_net, 'is_q' FROM gates WHERE gtype = 'dff'),
f AS (SELECT p.design_id, p.gid, """ + ", ".join(f"max((role = '{r}')::INT) AS {r}" for r in E.ROLE_COLUMNS) + """ FROM pins p JOIN role USING (design_id, net) GROUP BY ALL)
SELECT g.design_id, g.gid, """ + ", ".join(f"coalesce({r}, 0) AS {r}" for r in E.ROLE_COLUMNS) + " FROM gates g LEFT JOIN f USING (design_id, gid)")(lambda c: E.pin_roles(c.gates, c.pins))

circuit_query("dff_data_driver", """d AS (SELECT design_id, gid, max(driver) AS d FROM pins WHERE gtype = 'dff' AND pin = 'D' GROUP BY ALL)
SELECT g.design_id, g.gid, coalesce(d, -1) AS d_driver FROM gates g LEFT JOIN d USING (design_id, gid) WHERE gtype = 'dff'""")(lambda c: E.dff_data_driver(c.gates, c.pins))

circuit_query("gate_labels", "SELECT design_id, gid, y FROM gates")(lambda c: E.attach_labels(c.gates, c.gates.filter("y = 1").select("design_id", "gate_name")))

SEEDS = """cg AS (SELECT design_id, gid FROM gates WHERE gtype <> 'dff'),
te AS (SELECT e.*, a.gtype AS st, b.gtype AS dt FROM edges e JOIN gates a ON a.design_id = e.design_id AND a.gid = e.src JOIN gates b ON b.design_id = e.design_id AND b.gid = e.dst),
seed0 AS (SELECT design_id, gid, 'pi' AS family FROM pins WHERE net LIKE 'i%' UNION SELECT design_id, gid, 'po' FROM gates WHERE is_po
UNION SELECT design_id, dst, 'dff_succ' FROM te WHERE st = 'dff' UNION SELECT design_id, src, 'dff_pred' FROM te WHERE dt = 'dff'
UNION SELECT design_id, gid, 'comb_src' FROM cg WHERE NOT EXISTS (SELECT 1 FROM comb WHERE comb.design_id = cg.design_id AND comb.dst = cg.gid)
UNION SELECT design_id, gid, 'comb_sink' FROM cg WHERE NOT EXISTS (SELECT 1 FROM comb WHERE comb.design_id = cg.design_id AND comb.src = cg.gid)
UNION SELECT design_id, gid, CASE WHEN net = '1''b0' THEN 'gnd' ELSE 'vdd' END FROM pins WHERE net LIKE '1''b%'),
seed AS MATERIALIZED (SELECT seed0.* FROM seed0 JOIN cg USING (design_id, gid))"""
circuit_query("seed_sets", SEEDS + " SELECT design_id, gid, family FROM seed")(lambda c: E.seeds(c.gates, c.pins, edges_of(c), c.ports))

circuit_query("type_mix", """te AS (SELECT e.*, a.gtype AS st, b.gtype AS dt FROM edges e JOIN gates a ON a.design_id = e.design_id AND a.gid = e.src JOIN gates b ON b.design_id = e.design_id AND b.gid = e.dst),
i AS (SELECT design_id, dst AS gid, avg((st = dt)::INT) AS same, count(DISTINCT st) AS n FROM te GROUP BY ALL), o AS (SELECT design_id, src AS gid, count(DISTINCT dt) AS n FROM te GROUP BY ALL)
SELECT g.design_id, g.gid, round(coalesce(same, 0), 6) AS fanin_same_type, coalesce(i.n, 0) AS in_type_cnt, coalesce(o.n, 0) AS out_type_cnt FROM gates g LEFT JOIN i USING (design_id, gid) LEFT JOIN o USING (design_id, gid)""")(
    lambda c: rounded(E.type_mix(c.gates, edges_of(c)), "fanin_same_type")
)
circuit_query("sink_gates", "SELECT design_id, gid, (NOT EXISTS (SELECT 1 FROM edges e WHERE e.design_id = g.design_id AND e.src = g.gid))::INT AS is_sink_gate FROM gates g")(lambda c: E.sink_flags(c.gates, edges_of(c)))

# --- iteration ------------------------------------------------------------------------------------------------------------

LEVELS = """lv(design_id, gid, level) AS (SELECT design_id, gid, 0 FROM gates WHERE gtype <> 'dff' UNION SELECT c.design_id, c.dst, lv.level + 1 FROM lv JOIN comb c ON c.design_id = lv.design_id AND c.src = lv.gid),
level AS MATERIALIZED (SELECT design_id, gid, coalesce(max(level), 0) AS level, bool_and(gtype <> 'dff') AS ordered FROM gates LEFT JOIN lv USING (design_id, gid) GROUP BY ALL)"""
circuit_query("combinational_depth", LEVELS + " SELECT design_id, gid, level::BIGINT AS level, ordered FROM level")(lambda c: I.levels(c.gates, comb_of(c)))

WAYS = """e2 AS MATERIALIZED (SELECT DISTINCT design_id, w, src, dst FROM (SELECT design_id, 'from' AS w, src, dst FROM comb UNION ALL SELECT design_id, 'to', dst, src FROM comb)),
s2 AS (SELECT *, CASE WHEN family IN ('po', 'dff_pred', 'comb_sink') THEN 'to' ELSE 'from' END AS w FROM seed)"""
BFS = WAYS + """, b(design_id, gid, family, w, dist) AS (SELECT design_id, gid, family, w, 0 FROM s2 UNION SELECT b.design_id, e2.dst, b.family, b.w, b.dist + 1 FROM b JOIN e2 ON e2.design_id = b.design_id AND e2.w = b.w AND e2.src = b.gid),
near AS MATERIALIZED (SELECT design_id, gid, family, min(dist) AS dist FROM b GROUP BY ALL)"""
FAR = """far0(design_id, gid, family, w, dist) AS (SELECT design_id, gid, family, w, CASE WHEN family LIKE 'dff%' THEN 1 ELSE 0 END FROM s2 UNION SELECT b.design_id, e2.dst, b.family, b.w, b.dist + 1 FROM far0 b JOIN e2 ON e2.design_id = b.design_id AND e2.w = b.w AND e2.src = b.gid),
far AS MATERIALIZED (SELECT design_id, gid, family, max(dist) AS dist FROM far0 GROUP BY ALL)"""


def _seeds(c: Circuit) -> DataFrame:
    return E.seeds(c.gates, c.pins, edges_of(c), c.ports)


def longest_distances(c: Circuit) -> DataFrame:
    edges = staged(edges_of(c))
    comb = staged(E.combinational(edges, c.gates))
    return I.longest_distances(E.seeds(c.gates, c.pins, edges, c.ports), comb, I.levels(c.gates, comb))


circuit_query("shortest_distances", f"{SEEDS}, {BFS} SELECT design_id, gid, family, dist::BIGINT AS dist FROM near")(lambda c: I.shortest_distances(_seeds(c), comb_of(c)))
circuit_query("longest_distances", f"{SEEDS}, {WAYS}, {FAR} SELECT design_id, gid, family, dist::BIGINT AS dist FROM far")(longest_distances)

HOODS = """hop1 AS (SELECT DISTINCT design_id, src, dst FROM comb), hop2 AS (SELECT DISTINCT a.design_id, a.src, b.dst FROM hop1 a JOIN hop1 b ON a.design_id = b.design_id AND a.dst = b.src),
hop3 AS (SELECT DISTINCT a.design_id, a.src, b.dst FROM hop2 a JOIN hop1 b ON a.design_id = b.design_id AND a.dst = b.src), hop4 AS (SELECT DISTINCT a.design_id, a.src, b.dst FROM hop3 a JOIN hop1 b ON a.design_id = b.design_id AND a.dst = b.src),
hood AS (SELECT * FROM (SELECT * FROM hop1 UNION SELECT * FROM hop2 UNION SELECT * FROM hop3 UNION SELECT * FROM hop4) WHERE src <> dst),
hi AS (SELECT design_id, dst AS gid, count(*) AS n FROM hood GROUP BY ALL), ho AS (SELECT design_id, src AS gid, count(*) AS n FROM hood GROUP BY ALL),
hoods AS (SELECT g.design_id, g.gid, coalesce(hi.n, 0) AS in_4lvl_cnt, coalesce(ho.n, 0) AS out_4lvl_cnt FROM gates g LEFT JOIN hi USING (design_id, gid) LEFT JOIN ho USING (design_id, gid))"""
circuit_query("four_hop_sizes", HOODS + " SELECT * FROM hoods")(lambda c: I.neighbourhood_sizes(c.gates, comb_of(c)))

circuit_query("flagged_context", """u AS MATERIALIZED (SELECT DISTINCT design_id, a, b FROM (SELECT design_id, src AS a, dst AS b FROM edges UNION ALL SELECT design_id, dst, src FROM edges)),
k(design_id, gid, hop) AS (SELECT design_id, gid, 0 FROM gates WHERE p >= 0.97 UNION SELECT k.design_id, u.b, k.hop + 1 FROM k JOIN u ON u.design_id = k.design_id AND u.a = k.gid WHERE k.hop < 2)
SELECT design_id, gid, min(hop)::BIGINT AS hop FROM k GROUP BY ALL""")(lambda c: S.seed_context(S.threshold(c.gates, 0.97), edges_of(c), 2))

COMPONENTS = """cu AS MATERIALIZED (SELECT DISTINCT design_id, a, b FROM (SELECT design_id, src AS a, dst AS b FROM comb UNION ALL SELECT design_id, dst, src FROM comb)),
cc(design_id, gid, root) AS (SELECT design_id, gid, gid FROM gates UNION SELECT cc.design_id, cu.b, cc.root FROM cc JOIN cu ON cu.design_id = cc.design_id AND cu.a = cc.gid WHERE cu.b > cc.root),
cr AS (SELECT design_id, gid, min(root) AS root FROM cc GROUP BY ALL),
component AS MATERIALIZED (SELECT design_id, gid, dense_rank() OVER (PARTITION BY design_id ORDER BY root) - 1 AS component_id FROM cr)"""
circuit_query("components", COMPONENTS + " SELECT design_id, gid, component_id FROM component")(lambda c: I.combinational_components(c.gates, edges_of(c)))

# --- filters, verdicts, grades --------------------------------------------------------------------------------------------

FILTERS = """u AS MATERIALIZED (SELECT DISTINCT design_id, a, b FROM (SELECT design_id, src AS a, dst AS b FROM edges UNION ALL SELECT design_id, dst, src FROM edges) WHERE a <> b),
f0 AS MATERIALIZED (SELECT design_id, gid FROM gates WHERE p >= 0.5),
f1 AS MATERIALIZED (SELECT * FROM f0 WHERE EXISTS (SELECT 1 FROM u JOIN f0 o ON o.design_id = u.design_id AND o.gid = u.b WHERE u.design_id = f0.design_id AND u.a = f0.gid)),
fu AS MATERIALIZED (SELECT u.* FROM u JOIN f1 x ON x.design_id = u.design_id AND x.gid = u.a JOIN f1 y ON y.design_id = u.design_id AND y.gid = u.b),
fc(design_id, gid, root) AS (SELECT design_id, gid, gid FROM f1 UNION SELECT fc.design_id, fu.b, fc.root FROM fc JOIN fu ON fu.design_id = fc.design_id AND fu.a = fc.gid WHERE fu.b > fc.root),
fr AS (SELECT design_id, gid, min(root) AS root FROM fc GROUP BY ALL),
f2 AS MATERIALIZED (SELECT design_id, gid FROM fr QUALIFY count(*) OVER (PARTITION BY design_id, root) >= 5),
f3 AS MATERIALIZED (SELECT design_id, gid FROM f2 QUALIFY count(*) OVER (PARTITION BY design_id) >= 10)"""
FLAG = "SELECT g.design_id, g.gid, (f.gid IS NOT NULL)::INT AS flag FROM gates g LEFT JOIN {} f USING (design_id, gid)"
circuit_query("score_threshold", FILTERS + " " + FLAG.format("f0"))(lambda c: S.threshold(c.gates))
circuit_query("drop_isolated", FILTERS + " " + FLAG.format("f1"))(lambda c: S.drop_isolated(S.threshold(c.gates), edges_of(c)))
circuit_query("drop_small_clusters", FILTERS + " " + FLAG.format("f2"))(lambda c: S.drop_small_clusters(S.drop_isolated(S.threshold(c.gates), edges_of(c)), edges_of(c)))
circuit_query("least_total", FILTERS + " " + FLAG.format("f3"))(lambda c: S.filtered_flags(c.gates, edges_of(c)))

CASES = FILTERS + """, q AS (SELECT g.design_id, g.y, (f.gid IS NOT NULL)::INT AS flag FROM gates g LEFT JOIN f3 f USING (design_id, gid)),
k0 AS (SELECT design_id, count(*) FILTER (flag = 1 AND y = 1) AS tp, count(*) FILTER (flag = 1 AND y = 0) AS fp, count(*) FILTER (flag = 0 AND y = 1) AS fn, count(*) FILTER (flag = 0 AND y = 0) AS tn FROM q GROUP BY 1),
k1 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, tp + fp > 0 AS predicted_trojaned, tp + fn > 0 AS truly_trojaned FROM k0),
k2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, CASE WHEN predicted_trojaned = truly_trojaned THEN 2 ELSE 0 END AS classification FROM k1),
cases AS MATERIALIZED (SELECT *, classification + CASE WHEN truly_trojaned AND classification = 2 THEN f1 ELSE 0 END AS score FROM k2)"""


def case_grades(c: Circuit) -> DataFrame:
    return S.grades(S.confusion(S.filtered_flags(c.gates, edges_of(c)), c.gates))


circuit_query(FLAGSHIP, CASES + " SELECT design_id, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, predicted_trojaned, truly_trojaned, round(f1, 6) AS f1, classification::BIGINT AS classification, round(score, 6) AS score FROM cases")(
    lambda c: rounded(case_grades(c), "precision", "recall", "f1", "score")
)
circuit_query("run_summary", CASES + """ SELECT CASE WHEN design_id % 2 = 0 THEN 'lookup' ELSE 'model' END AS source, count(*) AS designs, round(sum(score), 6) AS total, round(avg(score), 6) AS mean FROM cases GROUP BY ROLLUP (1)""")(
    lambda c: rounded(S.run_summary(case_grades(c).withColumn("source", F.when(F.col("design_id") % 2 == 0, "lookup").otherwise("model"))), "total", "mean")
)
circuit_query("verdict_report", CASES + """ SELECT predicted_trojaned, truly_trojaned, count(*) AS designs, round(sum(score), 6) AS reached, sum(CASE WHEN truly_trojaned THEN 3.0 ELSE 2.0 END)::DOUBLE AS possible,
round(sum(CASE WHEN truly_trojaned THEN 3.0 ELSE 2.0 END - score), 6) AS lost, round(median(f1), 6) AS median_f1, count(*) FILTER (recall = 1 AND precision < 0.5) AS full_recall_low_precision FROM cases GROUP BY 1, 2""")(
    lambda c: rounded(S.verdict_report(case_grades(c)), "reached", "possible", "lost", "median_f1")
)
circuit_query("outcome_classes", FILTERS + """ SELECT g.design_id, g.gid, CASE WHEN f.gid IS NOT NULL AND y = 1 THEN 'TP' WHEN y = 1 THEN 'FN' WHEN f.gid IS NOT NULL THEN 'FP' ELSE 'TN' END AS outcome FROM gates g LEFT JOIN f3 f USING (design_id, gid)""")(
    lambda c: S.outcome_classes(c.gates, S.filtered_flags(c.gates, edges_of(c)), c.gates)
)
THRESHOLDS = [0.3, 0.5, 0.7]
circuit_query("threshold_sweep", """t(threshold) AS (VALUES (0.3), (0.5), (0.7)), m AS (SELECT threshold::DOUBLE AS threshold, count(*) FILTER (p > threshold AND y = 1) AS tp, count(*) FILTER (p > threshold AND y = 0) AS fp,
count(*) FILTER (p <= threshold AND y = 1) AS fn, count(*) FILTER (p <= threshold AND y = 0) AS tn FROM gates, t GROUP BY 1),
m2 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM m)
SELECT threshold, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(2 * pr * re / nullif(pr + re, 0), 0) END, 6) AS f1 FROM m2""")(
    lambda c: rounded(S.corpus_metrics(c.gates, c.gates, THRESHOLDS), "precision", "recall", "accuracy", "f1")
)
circuit_query("component_labels", COMPONENTS + " SELECT design_id, gid, (avg(y) OVER (PARTITION BY design_id, component_id) >= 0.01)::INT AS y_wcc FROM component JOIN gates USING (design_id, gid)")(
    lambda c: S.component_labels(I.combinational_components(c.gates, edges_of(c)), c.gates)
)
circuit_query("component_purity", COMPONENTS + ", " + FILTERS + """, x AS (SELECT design_id, component_id, sum(y)::BIGINT AS positives, count(*) AS gates FROM component JOIN gates USING (design_id, gid) GROUP BY 1, 2),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY design_id ORDER BY positives DESC, component_id) = 1)
SELECT design_id, component_id, positives, gates, round(positives / gates, 6) AS purity, EXISTS (SELECT 1 FROM f3 WHERE f3.design_id = b.design_id) AS found FROM b WHERE positives > 0""")(
    lambda c: rounded(S.component_purity(I.combinational_components(c.gates, edges_of(c)), c.gates, S.filtered_flags(c.gates, edges_of(c))), "purity")
)
