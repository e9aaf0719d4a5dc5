"""Queries over labelled scores: documents stand for sessions, `toxic` for the class."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoorline.operators.attribution import SESSION
from spoorline.operators.risk import best_chain, chain_scores
from spoorline.plans import evaluation as E
from spoorline.plans import live, session_graphs, splits, training
from spoorline.registry.oracle import with_ctes
from spoorline.session import fresh_path, materialize
from spoorline.sources import logs, tables
from spoorline.sources.tables import table

QUERIES, ORACLE = {}, {}
THETA = 0.5
THETAS = [i / 20 for i in range(1, 20)]
SWEEP = [i / 10 for i in range(2, 10)]

# The same derivations run on both engines; table names are filled in.
VERDICTS = """SELECT d.doc_id AS session_id, CAST(l.toxic AS BIGINT) AS y,
 (d.n_chars % 1000) / CAST(1000 AS DOUBLE) AS risk, ((d.doc_id * 37) % 1000) / CAST(1000 AS DOUBLE) AS gat,
 ((d.doc_id * 11) % 100) / CAST(100 AS DOUBLE) AS rule_score, d.source AS template, d.lang AS fold,
 d.doc_id % 3 AS seed FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id"""
SCORES = """SELECT doc_id AS session_id, (n_chars % 1000) / CAST(1000 AS DOUBLE) AS risk,
 n_chars % 97 AS n_events FROM {documents} WHERE doc_id % 6 <> 5"""
LIVE_LABELS = """SELECT d.doc_id AS session_id, CONCAT(CASE WHEN COALESCE(l.toxic, l.quality) = 1 THEN 'Malicious' ELSE 'Benign' END,
 CASE WHEN d.doc_id % 5 = 0 THEN ':pgbench' WHEN d.doc_id % 5 < 3 THEN CONCAT(':k', CAST(d.doc_id AS STRING))
 WHEN d.doc_id % 5 = 3 THEN ':manual' ELSE '' END) AS label FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id"""
PLAN = """SELECT CONCAT('k', CAST(doc_id AS STRING)) AS key, CONCAT(source, '_', CAST(doc_id AS STRING)) AS scenario_id,
 'dev' AS dataset, lang AS run, doc_id AS synthetic_backend_pid, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS failed
 FROM {documents} WHERE doc_id % 5 IN (1, 3)"""
TWINS = """SELECT 'dev' AS dataset, lang AS run, doc_id AS synthetic_backend_pid,
 ((n_chars + 40) % 1000) / CAST(1000 AS DOUBLE) AS risk FROM {documents} WHERE doc_id % 2 = 1"""
ALERTS = """SELECT event_id AS pos, event_id % 900 AS session_id, value / CAST(600 AS DOUBLE) AS risk, event_id % 31 AS n_events
 FROM {events} WHERE event_type = 'error'"""
TIMINGS = """SELECT event_type, value AS alg2_ms, value * 2 AS alg3_ms, CAST(event_id % 100 AS DOUBLE) AS alg4_ms,
 CAST(event_id % 7 AS DOUBLE) / 2 AS graphml_ms, value * 3 + CAST(event_id % 100 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) / 2 AS total_ms,
 CASE WHEN event_id % 3 = 0 THEN value * 50 END AS detection_latency_ms FROM {events}"""

_PARTS = {
    "verdicts": VERDICTS, "scores": SCORES, "live_labels": LIVE_LABELS, "plan": PLAN, "twins": TWINS,
    "alerts": ALERTS, "timings": TIMINGS,
}
_ctes = ",\n".join(
    f"{n} AS ({q.format(documents='documents', labels='labels', events='events')})"
    for n, q in _PARTS.items()
)


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = f"WITH {_ctes}\n{sql}"
        return fn

    return add


def _read(spark, d, text):
    used = {n: table(spark, d, n) for n in ("documents", "labels", "events") if f"{{{n}}}" in text}
    return spark.sql(text, **used)


def _verdicts(spark, d):
    return _read(spark, d, VERDICTS)


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _cm(group: str, score: str = "risk", theta=THETA, source: str = "verdicts") -> str:
    keys = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""SELECT {keys}count(*) AS n, count(*) FILTER (y = 1) AS n_malicious,
 count(*) FILTER (y = 1 AND {score} >= {theta}) AS tp, count(*) FILTER (y = 0 AND {score} >= {theta}) AS fp,
 count(*) FILTER (y = 1 AND {score} < {theta}) AS fn, count(*) FILTER (y = 0 AND {score} < {theta}) AS tn FROM {source} {by}"""


def _with_rates(counts: str, keys: str, extra: str = "n, n_malicious, ") -> str:
    keys = f"{keys}, " if keys else ""
    return f"""SELECT {keys}{extra}tp, fp, fn, tn, round(p, 6) AS "precision", round(r, 6) AS recall,
 round(2 * p * r / greatest(1e-9, p + r), 6) AS f1, round((tp + tn) / greatest(1, tp + fp + fn + tn), 6) AS accuracy,
 round(fp / greatest(1, fp + tn), 6) AS fpr FROM (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM ({counts}))"""


@query("a09_confusion", _with_rates(_cm("template"), "template"))
def a09(spark, d):
    return _rounded(E.confusion(_verdicts(spark, d), THETA, ["template"]), *E.METRICS)


_LIVE = """round(fp / nullif(fp + tn, 0), 6) AS fpr, CASE WHEN tp + fn > 0 THEN round(COALESCE(tp / nullif(tp + fp, 0), 0), 6) END AS "precision",
 round(tp / nullif(tp + fn, 0), 6) AS recall, CASE WHEN tp + fn > 0 THEN round(COALESCE(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) END AS f1"""


@query("a09b_live_rates", f"SELECT template, n, tp, fp, fn, tn, {_LIVE} FROM ({_cm('template', theta=0.9)})")
def a09b(spark, d):
    out = E.live_rates(_verdicts(spark, d), 0.9, ["template"])
    return _rounded(out, "fpr", "precision", "recall", "f1")


@query(
    "a10_class_rates",
    f"SELECT true_class, total, correct, round(correct / greatest(1, total), 4) AS rate FROM (SELECT true_class, count(*) AS total, "
    f"count(*) FILTER (CASE WHEN true_class = 'Normal' THEN risk < {THETA} ELSE risk >= {THETA} END) AS correct FROM "
    "(SELECT *, CASE WHEN y = 0 THEN 'Normal' ELSE 'Malicious ' || fold END AS true_class FROM verdicts) GROUP BY 1)",
)
def a10(spark, d):
    named = F.when(F.col("y") == 0, "Normal").otherwise(F.concat(F.lit("Malicious "), "fold"))
    return E.class_rates(_verdicts(spark, d).withColumn("true_class", named), THETA)


@query(
    "a11_template_report",
    f"SELECT template, y, count(*) AS n, count(*) FILTER (risk >= {THETA}) AS flagged, min(risk) AS risk_min, median(risk) AS risk_median, "
    "max(risk) AS risk_max, min(gat) AS gat_min, median(gat) AS gat_median, max(gat) AS gat_max FROM verdicts GROUP BY 1, 2",
)
def a11(spark, d):
    return E.group_report(_verdicts(spark, d), ["template", "y"], THETA, ["risk", "gat"])


@query(
    "a12_all_and_by_source",
    f"SELECT template, n, tp, fp, fn, tn, {_LIVE} FROM ({_cm('template')} UNION ALL SELECT 'ALL', * FROM ({_cm('')}))",
)
def a12(spark, d):
    out = E.all_and_by(_verdicts(spark, d), THETA, "template")
    return _rounded(out, "fpr", "precision", "recall", "f1")


_RANK = """SELECT fold, round(sum(pos * (nb + neg / 2.0::DOUBLE)) / (p * n), 6) AS roc_auc, round(sum(pos * (pos_up::DOUBLE / (pos_up + neg_up))) / p, 6) AS pr_auc,
 lo AS min_malicious_score, hi AS max_benign_score, round(lo - hi, 6) AS margin FROM (SELECT fold, risk, pos, neg, sum(pos) OVER g AS p, sum(neg) OVER g AS n,
 sum(neg) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS nb, sum(pos) OVER (o DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_up,
 sum(neg) OVER (o DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_up, min(risk) FILTER (pos > 0) OVER g AS lo, max(risk) FILTER (neg > 0) OVER g AS hi
 FROM (SELECT fold, risk, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM verdicts GROUP BY 1, 2)
 WINDOW g AS (PARTITION BY fold)) WHERE p > 0 AND n > 0 GROUP BY fold, p, n, lo, hi"""
_RANK = _RANK.replace("(o DESC ROWS", "(PARTITION BY fold ORDER BY risk DESC ROWS").replace(
    "(o ROWS", "(PARTITION BY fold ORDER BY risk ROWS"
)


@query("a13_ranking", _RANK)
def a13(spark, d):
    out = E.ranking(_verdicts(spark, d), ["fold"])
    return _rounded(out, "roc_auc", "pr_auc", "margin")


_list = "[" + ", ".join(f"{t}::DOUBLE" for t in SWEEP) + "]"


@query(
    "a14_threshold_sweep",
    f"""SELECT theta, count(*) AS n, count(*) FILTER (y = 1 AND risk >= theta) AS tp, count(*) FILTER (y = 0 AND risk >= theta) AS fp,
 count(*) FILTER (y = 1 AND risk < theta) AS fn, count(*) FILTER (y = 0 AND risk < theta) AS tn
 FROM verdicts, (SELECT unnest({_list}) AS theta) GROUP BY 1""",
)
def a14(spark, d):
    return E.threshold_sweep(_verdicts(spark, d), SWEEP)


_tune = "[" + ", ".join(f"{t}::DOUBLE" for t in THETAS) + "]"


@query(
    "a14_tuned_theta",
    f"""SELECT fold, thetas[(len(thetas) + 1) // 2] AS theta, round(f1, 6) AS f1, len(thetas) AS tied FROM (
 SELECT fold, f1, list(theta ORDER BY theta) AS thetas FROM (SELECT *, max(f1) OVER (PARTITION BY fold) AS best FROM (
 SELECT fold, theta, round(2 * p * r / greatest(1e-9, p + r), 12) AS f1 FROM (SELECT fold, theta, tp / greatest(1, tp + fp) AS p, tp / greatest(1, pos) AS r FROM (
 SELECT fold, theta, count(*) FILTER (y = 1 AND risk >= theta) AS tp, count(*) FILTER (y = 0 AND risk >= theta) AS fp, count(*) FILTER (y = 1) AS pos
 FROM verdicts, (SELECT unnest({_tune}) AS theta) GROUP BY 1, 2)))) WHERE f1 = best GROUP BY 1, 2)""",
)
def a14_tune(spark, d):
    return _rounded(E.tune_theta(_verdicts(spark, d), THETAS, ["fold"]), "f1")


@query(
    "a14_theta_by_fpr",
    f"""SELECT fold, min(theta) AS theta FROM (SELECT fold, theta, fp / greatest(1, neg) AS fpr FROM (SELECT fold, theta,
 count(*) FILTER (y = 0 AND risk >= theta) AS fp, count(*) FILTER (y = 0) AS neg FROM verdicts, (SELECT unnest({_tune}) AS theta) GROUP BY 1, 2))
 WHERE fpr <= 0.3 GROUP BY 1""",
)
def a14_fpr(spark, d):
    return E.tune_theta(_verdicts(spark, d), THETAS, ["fold"], max_fpr=0.3).select("fold", "theta")


def _runs(spark, d):
    """Reports per fold and seed, as `read_reports` gives them."""
    rows = _verdicts(spark, d)
    cm = E.confusion(rows, THETA, ["fold", "seed"])
    return cm.join(E.ranking(rows, ["fold", "seed"]), ["fold", "seed"], "left")


# ranking metrics per fold and seed
_RANK_SEED = (
    _RANK.replace("fold", "fold, seed").replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)").replace(", 6) AS", ", 15) AS")
)
_EXACT = _with_rates(_cm("fold, seed"), "fold, seed").replace(", 6) AS", ", 15) AS")
_RUNS = (
    f"runs AS (SELECT c.*, r.roc_auc, r.pr_auc FROM ({_EXACT}) c LEFT JOIN ({_RANK_SEED}) r "
    "ON r.fold = c.fold AND r.seed = c.seed)"
)
_ms = (
    "round_even(avg({0}), 4) AS {0}_mean, "
    "round_even(CASE WHEN count({0}) > 0 THEN COALESCE(stddev_samp({0}), 0) END, 4) AS {0}_std"
)
_KEYS = E.SUMMARY_KEYS


def _runs_query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        ORACLE[name] = f"WITH {_ctes},\n{_RUNS}\n{sql}"
        return fn

    return add


@_runs_query(
    "a15_fold_summary",
    f"SELECT fold, count(*) AS seeds, {', '.join(_ms.format(k) for k in _KEYS)} FROM runs GROUP BY 1",
)
def a15(spark, d):
    return E.fold_summary(_runs(spark, d), _KEYS)


@_runs_query(
    "a15_macro_summary",
    f"SELECT count(*) AS seeds, {', '.join(_ms.format(k) for k in _KEYS)} FROM (SELECT seed, {', '.join(f'avg({k}) AS {k}' for k in _KEYS)} "
    "FROM runs GROUP BY 1 HAVING count(DISTINCT fold) = (SELECT count(DISTINCT fold) FROM runs))",
)
def a15_macro(spark, d):
    return E.macro_summary(_runs(spark, d), _KEYS)


@_runs_query(
    "a15_pooled_confusion",
    "SELECT seed, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM runs GROUP BY 1",
)
def a15_pooled(spark, d):
    return E.pooled_confusion(E.confusion(_verdicts(spark, d), THETA, ["fold", "seed"]))


@_runs_query(
    "a16_config_summary",
    "SELECT fold, metric, count(*) AS seeds, round_even(avg(value), 4) AS mean, round_even(COALESCE(stddev_samp(value), 0), 4) AS std, "
    "round(min(value), 6) AS min, round(max(value), 6) AS max FROM ("
    + " UNION ALL ".join(f"SELECT fold, '{k}' AS metric, {k} AS value FROM runs" for k in _KEYS)
    + ") WHERE value IS NOT NULL GROUP BY 1, 2",
)
def a16(spark, d):
    out = E.config_summary(_runs(spark, d), "fold", _KEYS)
    return _rounded(out, "min", "max")


_STAGES = ("alg2_ms", "alg3_ms", "graphml_ms", "alg4_ms", "total_ms", "detection_latency_ms")


@query(
    "a20_timing_summary",
    "SELECT event_type, stage, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(median(ms), 6) AS median_ms, max(ms) AS max_ms FROM ("
    + " UNION ALL ".join(f"SELECT event_type, '{s}' AS stage, {s} AS ms FROM timings" for s in _STAGES)
    + ") WHERE ms IS NOT NULL GROUP BY 1, 2",
)
def a20(spark, d):
    out = E.timing_summary(_read(spark, d, TIMINGS), _STAGES, ["event_type"])
    return _rounded(out, "mean_ms", "median_ms")


@query(
    "a20_timing_sketches",
    "SELECT event_type, stage, count(*) AS n, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms, true AS median_right, true AS p95_right FROM ("
    + " UNION ALL ".join(f"SELECT event_type, '{s}' AS stage, {s} AS ms FROM timings" for s in _STAGES)
    + ") WHERE ms IS NOT NULL GROUP BY 1, 2",
)
def a20_sketches(spark, d):
    """The same from sketches of ten batches, merged; whether the ranks of the quantiles are within the stated error."""
    rows = _read(spark, d, TIMINGS).withColumn("batch", F.floor(F.col("alg4_ms") / 10))
    long = rows.unpivot(["event_type", "batch"], list(_STAGES), "stage", "ms").where(F.col("ms").isNotNull())
    keys = ["event_type", "stage"]
    summary = E.sketch_summary(E.merge_sketches(E.timing_sketches(long, [*keys, "batch"]), keys))
    ranks = {"median": 0.5, "p95": 0.95}
    below = [F.count_if(F.col("ms") < F.col(f"{q}_ms")).alias(f"_{q}_lo") for q in ranks]
    upto = [F.count_if(F.col("ms") <= F.col(f"{q}_ms")).alias(f"_{q}_hi") for q in ranks]
    placed = long.join(summary, keys).groupBy(*keys, "n", "mean_ms", "max_ms").agg(*below, *upto)
    right = [
        ((F.col(f"_{q}_lo") / F.col("n") - E.SKETCH_ERROR <= r) & (F.col(f"_{q}_hi") / F.col("n") + E.SKETCH_ERROR >= r)).alias(f"{q}_right")
        for q, r in ranks.items()
    ]
    return _rounded(placed.select(*keys, "n", "mean_ms", "max_ms", *right), "mean_ms")


@query(
    "b06_noisy_or",
    "SELECT session_id, round(1 - (1 - 0.85::DOUBLE * rule_score) * (1 - 0.75::DOUBLE * gat), 9) AS fused FROM verdicts",
)
def b06(spark, d):
    from spoorline.operators.risk import fuse

    fused = fuse(F.col("rule_score"), F.col("gat"), 0.85, 0.75)
    return _verdicts(spark, d).select("session_id", F.round(fused, 9).alias("fused"))


@query(
    "b10_layers",
    " UNION ALL ".join(
        _with_rates(f"SELECT '{s}' AS layer, * FROM ({_cm('', s)})", "layer")
        for s in ("risk", "gat", "rule_score")
    ),
)
def b10(spark, d):
    rows = E.layers(_verdicts(spark, d), ["risk", "gat", "rule_score"])
    return _rounded(E.confusion(rows, THETA, ["layer"], "layer_score"), *E.METRICS)


@query(
    "a09_holdout_parts",
    " UNION ALL ".join(
        _with_rates(f"SELECT '{n}' AS part, * FROM ({_cm('', source=f'(SELECT * FROM verdicts WHERE {w})')})", "part")
        for n, w in (
            ("all_test", "true"),
            ("heldout_vs_benign", "template = 'src3' OR y = 0"),
            ("seen_templates", "template <> 'src3'"),
        )
    ),
)
def holdout(spark, d):
    rows = E.holdout_parts(_verdicts(spark, d), "src3")
    return _rounded(E.confusion(rows, THETA, ["part"]), *E.METRICS)


@query(
    "t01_false_alarms",
    f"SELECT session_id, risk, template FROM verdicts WHERE y = 0 AND risk >= {THETA} ORDER BY risk DESC, session_id LIMIT 30",
)
def t01(spark, d):
    return E.false_alarms(_verdicts(spark, d), THETA, 30, ["session_id"]).select(
        "session_id", "risk", "template"
    )


@query("t03_templates_by_count", 'SELECT template, count(*) AS "count" FROM verdicts GROUP BY 1')
def t03(spark, d):
    return splits.by_count(_verdicts(spark, d), "template")


@query(
    "t04_error_rows",
    f"SELECT session_id, template, risk, CASE WHEN y = 1 THEN 'missed' ELSE 'false_alarm' END AS error FROM verdicts "
    f"WHERE (y = 1) <> (risk >= {THETA})",
)
def t04(spark, d):
    return E.error_rows(_verdicts(spark, d), THETA).select("session_id", "template", "risk", "error")


@query(
    "u02_pooled_splits",
    "SELECT seed, count(*) AS n, sum(y)::BIGINT AS malicious FROM verdicts GROUP BY 1",
)
def u02(spark, d):
    """The parts of all seeds, put together again."""
    rows = _verdicts(spark, d)
    pooled = rows.where("seed = 0").unionByName(rows.where("seed = 1")).unionByName(rows.where("seed = 2"))
    return pooled.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("malicious"))


# --- live runs


def _plan(spark, d):
    errors = F.when(F.col("failed") == 1, F.array(F.lit("ERROR: relation missing"))).otherwise(
        F.array().cast("array<string>")
    )
    return _read(spark, d, PLAN).withColumn("errors", errors).drop("failed")


def _live(spark, d):
    return live.live_verdicts(
        _read(spark, d, SCORES), _read(spark, d, LIVE_LABELS), _plan(spark, d)
    )


_LIVE_ROWS = """SELECT s.session_id, s.risk, s.n_events, l.cls, l.key, CASE WHEN l.cls = 'Malicious' THEN 1 ELSE 0 END AS y,
 CASE WHEN l.key = 'pgbench' THEN 'pgbench' WHEN p.key IS NOT NULL THEN 'scenario' WHEN l.key = '' THEN 'other' ELSE l.key END AS source,
 CASE WHEN p.key IS NOT NULL THEN regexp_replace(p.scenario_id, '_\\d+$', '') ELSE l.key END AS family,
 p.dataset, p.run, p.synthetic_backend_pid FROM scores s
 JOIN (SELECT session_id, split_part(label, ':', 1) AS cls, split_part(label, ':', 2) AS key FROM live_labels) l ON l.session_id = s.session_id
 LEFT JOIN plan p ON p.key = l.key"""


@query("j14_p12_live_verdicts", f"SELECT session_id, risk, y, cls, key, source, family FROM ({_LIVE_ROWS})")
def j14(spark, d):
    return _live(spark, d).select("session_id", "risk", "y", "cls", "key", "source", "family")


@query(
    "j15_coverage",
    """SELECT 'unlabelled' AS problem, s.session_id::VARCHAR AS item FROM scores s ANTI JOIN live_labels l ON l.session_id = s.session_id
 UNION ALL SELECT 'never_scored', key FROM plan p WHERE key NOT IN (SELECT split_part(l.label, ':', 2) FROM live_labels l
  SEMI JOIN scores s ON s.session_id = l.session_id) UNION ALL SELECT 'errors', key FROM plan WHERE failed = 1""",
)
def j15(spark, d):
    return live.coverage(_read(spark, d, SCORES), _read(spark, d, LIVE_LABELS), _plan(spark, d))


_FIRST = """SELECT session_id, arg_min(risk, pos) AS risk, arg_min(n_events, pos) AS n_events FROM alerts WHERE risk >= 0.1 GROUP BY 1"""


@query("w06_first_alert", _FIRST)
def w06_first(spark, d):
    alerts = _read(spark, d, ALERTS).where("risk >= 0.1")
    return live.first_per_session(alerts, "session_id", "pos").drop("pos")


@query(
    "w06_last_score",
    "SELECT session_id, arg_max(risk, pos) AS risk, arg_max(n_events, pos) AS n_events FROM alerts GROUP BY 1",
)
def w06_last(spark, d):
    return live.last_per_session(_read(spark, d, ALERTS), "session_id", "pos").drop("pos")


@query(
    "j16_early_alarms",
    f"SELECT COALESCE(v.session_id, a.session_id) AS session_id, a.risk IS NOT NULL AS alerted, a.risk IS NOT NULL AND v.risk < 0.5 AS early_only, "
    f"a.n_events AS alert_events FROM ({_LIVE_ROWS}) v FULL JOIN ({_FIRST}) a ON a.session_id = v.session_id",
)
def j16(spark, d):
    first = live.first_per_session(_read(spark, d, ALERTS).where("risk >= 0.1"), "session_id", "pos")
    return live.early_alarms(_live(spark, d), first, 0.5).select(
        "session_id", "alerted", "early_only", "alert_events"
    )


@query(
    "j17_twin_agreement",
    "SELECT family, count(*) AS n, count(*) FILTER ((risk >= 0.5) = (twin >= 0.5)) AS same_verdict, round(avg(risk - twin), 6) AS mean_delta, "
    "round(avg(abs(risk - twin)), 6) AS mean_abs_delta, count(*) FILTER ((risk >= 0.5) <> (twin >= 0.5)) AS flips, "
    "round(median(twin), 6) AS twin_median, round(median(risk), 6) AS live_median FROM "
    f"(SELECT unnest([family, 'ALL']) AS family, v.risk, t.risk AS twin FROM ({_LIVE_ROWS}) v "
    "JOIN twins t ON t.dataset = v.dataset AND t.run = v.run AND t.synthetic_backend_pid = v.synthetic_backend_pid) GROUP BY 1",
)
def j17(spark, d):
    out = live.twin_agreement(_live(spark, d), _read(spark, d, TWINS), 0.5)
    return _rounded(out, "mean_delta", "mean_abs_delta", "twin_median", "live_median")


@query(
    "p13_class_labels",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Detailed ' || lang WHEN quality = 0 THEN 'Normal' ELSE 'Malicious' END AS class, "
    "CASE WHEN doc_id % 4 = 1 THEN replace(source, '_', ' ') || ' Exfil' WHEN quality = 0 THEN 'Normal' ELSE 'Malicious' END AS by_name "
    "FROM documents JOIN labels USING (doc_id)",
)
def p13(spark, d):
    """The class with detailed labels at hand, and from the file name where there are none."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    number = F.col("doc_id").cast("string")
    name = F.when(
        F.col("doc_id") % 4 == 1,
        F.concat(F.lit("enriched_session_"), number, F.lit("_"), "source", F.lit("_Exfil.graphml")),
    ).otherwise(F.concat(F.lit("enriched_session_"), number, F.lit(".graphml")))
    detailed = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Detailed "), "lang"))
    return rows.select(
        "doc_id",
        splits.class_from_name(name, F.col("quality"), detailed).alias("class"),
        splits.class_from_name(name, F.col("quality")).alias("by_name"),
    )


@query(
    "s15_report_scan",
    f"SELECT fold, seed, tp, fp, fn, tn, recall FROM ({_with_rates(_cm('fold, seed'), 'fold, seed')})",
)
def s15(spark, d):
    """Reports written as <fold>_s<seed>.report.json and collected again."""
    runs = E.confusion(_verdicts(spark, d), THETA, ["fold", "seed"])
    root = fresh_path(spark, "reports")
    body = F.struct("n", "n_malicious", "tp", "fp", "fn", "tn", *E.METRICS)
    name = F.concat(F.col("fold"), F.lit("_s"), F.col("seed").cast("string"), F.lit(".report.json"))
    # one folder per report stands for one file per report
    runs.select(name.alias("report"), body.alias("unseen"), F.lit(THETA).alias("theta")).write.partitionBy(
        "report"
    ).json(root)
    raw = spark.read.schema(logs.schemas.REPORT).json(f"{root}/*")
    path = F.regexp_extract(F.col("_metadata.file_path"), r"report=([^/]+)/", 1)
    out = raw.select("unseen.*", path.alias("_name")).select(
        F.regexp_extract("_name", r"(.+)_s(\d+)\.report\.json$", 1).alias("fold"),
        F.regexp_extract("_name", r"(.+)_s(\d+)\.report\.json$", 2).cast("long").alias("seed"),
        "tp", "fp", "fn", "tn", F.round("recall", 6).alias("recall"),
    )
    return out


@query("s16_label_export", "SELECT session_id, split_part(label, ':', 1) AS label FROM live_labels")
def s16(spark, d):
    cls, _ = live.split_label(F.col("label"))
    root = fresh_path(spark, "labels_csv")
    logs.write_label_csv(_read(spark, d, LIVE_LABELS).withColumn("label", cls), root)
    back = spark.read.option("header", True).schema("session_id long, label string").csv(root)
    return back


@query("s16_report_sink", _with_rates(_cm("template"), "template"))
def s16_report(spark, d):
    root = fresh_path(spark, "report")
    report = _rounded(E.confusion(_verdicts(spark, d), THETA, ["template"]), *E.METRICS)
    logs.write_report(report, root)
    return spark.read.schema(report.schema).json(root)


# --- models per fold and seed over the sessions of the derived logs

_SEEDS = (0, 1, 2)
_X = ("x1", "x2")


def _session_rows(spark, d):
    """Labelled sessions with two features of their graph and the score of their best chain."""
    prov = session_graphs.provenance(tables.capture(spark, d))
    found = session_graphs.session_behaviors(prov)
    nodes = prov.graphs.nodes.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("_n"))
    shown = found.found.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("_b"))
    best = best_chain(chain_scores(found.found, bound=found.largest))
    labels = tables.session_labels(spark, d).select(
        "run_id", F.col("session_id").alias("session_key"), "template", live.binary_label(F.col("label")).alias("y")
    )
    rows = labels.join(nodes, SESSION).join(shown, SESSION, "left").join(best, SESSION, "left")
    return rows.select(
        *SESSION, "template", "y", F.coalesce("rule_score", F.lit(0.0)).alias("rule_score"),
        F.log1p("_n").alias("x1"), F.log1p(F.coalesce("_b", F.lit(0))).alias("x2"),
    )


def _trained(spark, d):
    rows = materialize(_session_rows(spark, d), "session-rows")
    folds = splits.rotated_folds(splits.template_classes(rows).select("template", "y"))
    return training.fold_scores(rows, folds, _X, _SEEDS, F.expr("(session_key * 31 + seed * 7) % 4 <> 0"))


def _newton(steps: int = 10) -> dict[str, str]:
    out = {"w0": "SELECT fold, seed, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM train GROUP BY 1, 2 HAVING min(y) < max(y)"}
    for k in range(steps):
        out[f"s{k}"] = f"""SELECT fold, seed, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c,
 avg(p - y) AS g0, avg((p - y) * x1) + {training.L2} * any_value(b) AS g1, avg((p - y) * x2) + {training.L2} * any_value(c) AS g2,
 avg(v) AS h00, avg(v * x1) AS h01, avg(v * x2) AS h02, avg(v * x1 * x1) + {training.L2} AS h11, avg(v * x1 * x2) AS h12, avg(v * x2 * x2) + {training.L2} AS h22
 FROM (SELECT *, p * (1 - p) AS v FROM (SELECT t.*, a, b, c, 1 / (1 + exp(-(a + b * x1 + c * x2))) AS p FROM train t JOIN w{k} USING (fold, seed))) GROUP BY 1, 2"""
        out[f"w{k + 1}"] = f"""SELECT fold, seed, a - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS a,
 b - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b,
 c - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS c
 FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{k})"""
    out["weights"] = f"SELECT * FROM w{steps}"
    return out


_ROWS = {
    "tpl": "SELECT template, max(y) AS y FROM feat GROUP BY 1",
    "placed": "SELECT *, row_number() OVER (PARTITION BY y ORDER BY template) - 1 AS at, count(*) OVER (PARTITION BY y) AS n FROM tpl",
    "folds": """SELECT f.template AS fold, p.template, CASE WHEN p.at = f.at % p.n THEN 'test' WHEN p.at = (f.at + 1) % p.n THEN 'val' ELSE 'train' END AS part
 FROM placed f, placed p WHERE f.y = 1""",
    "every": """SELECT r.*, f.fold, f.part, s.seed FROM feat r JOIN folds f ON f.template = r.template, (SELECT unnest([0, 1, 2]) AS seed) s""",
    "train": "SELECT * FROM every WHERE part = 'train' AND (session_key * 31 + seed * 7) % 4 <> 0",
}
_FEAT = """SELECT l.run_id, l.session_id AS session_key, l.template, CASE WHEN lower(trim(l.label)) IN ('attack', 'malicious') THEN 1 ELSE 0 END AS y,
 COALESCE(b.rule_score, 0) AS rule_score, ln(1 + n.n) AS x1, ln(1 + COALESCE(f.n, 0)) AS x2 FROM labels_of_sessions l
 JOIN (SELECT run_id, session_key, count(*) AS n FROM nodes GROUP BY 1, 2) n ON n.run_id = l.run_id AND n.session_key = l.session_id
 LEFT JOIN (SELECT run_id, session_key, count(*) AS n FROM found GROUP BY 1, 2) f ON f.run_id = l.run_id AND f.session_key = l.session_id
 LEFT JOIN best b ON b.run_id = l.run_id AND b.session_key = l.session_id"""
_JUDGED = {
    "judged": """SELECT e.*, 1 / (1 + exp(-(a + b * x1 + c * x2))) AS gat, 1 - (1 - 0.75::DOUBLE * rule_score) * (1 - 0.75::DOUBLE / (1 + exp(-(a + b * x1 + c * x2)))) AS risk
 FROM every e JOIN weights w USING (fold, seed) WHERE part <> 'train'""",
    "tuned": f"""SELECT fold, seed, thetas[(len(thetas) + 1) // 2] AS theta FROM (
 SELECT fold, seed, list(theta ORDER BY theta) AS thetas FROM (SELECT *, max(f1) OVER (PARTITION BY fold, seed) AS best FROM (
 SELECT fold, seed, theta, round(2 * p * r / greatest(1e-9, p + r), 12) AS f1 FROM (SELECT fold, seed, theta, tp / greatest(1, tp + fp) AS p, tp / greatest(1, pos) AS r FROM (
 SELECT fold, seed, theta, count(*) FILTER (y = 1 AND risk >= theta) AS tp, count(*) FILTER (y = 0 AND risk >= theta) AS fp, count(*) FILTER (y = 1) AS pos
 FROM judged, (SELECT unnest({_tune}) AS theta) WHERE part = 'val' GROUP BY 1, 2, 3)))) WHERE f1 = best GROUP BY 1, 2)""",
    "reports": _with_rates(
        _cm("fold, seed, theta", theta="theta", source="(SELECT j.*, t.theta FROM judged j JOIN tuned t USING (fold, seed) WHERE part = 'test')"),
        "fold, seed, theta",
    ).replace(", 6) AS", ", 15) AS"),
}
_RATES = ("recall", "fpr", "precision", "f1")


def _trained_query(name, select):
    def add(fn):
        QUERIES[name] = fn
        parts = {"feat": _FEAT, **_ROWS, **_newton(), **_JUDGED}
        ORACLE[name] = with_ctes(select, ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in parts.items()))
        return fn

    return add


@_trained_query("b09_fold_models", "SELECT fold, seed, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM weights")
def b09_folds(spark, d):
    """Weights of all models, one per fold and seed."""
    weights, _ = _trained(spark, d)
    return weights.select("fold", "seed", *[F.round(F.get("w", F.lit(i)), 6).alias(n) for i, n in enumerate("abc")])


@_trained_query(
    "a14_a15_trained_reports",
    "SELECT fold, seed, theta, n, n_malicious, tp, fp, fn, tn, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM reports",
)
def a15_reports(spark, d):
    """Report of every fold and seed: trained scores, fused, at the θ tuned on its validation rows."""
    out = training.fold_reports(_trained(spark, d)[1], THETAS)
    out = out.select(*training.MODEL, "theta", "n", "n_malicious", "tp", "fp", "fn", "tn", "recall", "fpr")
    return _rounded(out, "recall", "fpr")


@_trained_query(
    "a15_trained_summary",
    f"SELECT fold, count(*) AS seeds, {', '.join(_ms.format(k) for k in _RATES)} FROM reports GROUP BY 1",
)
def a15_trained(spark, d):
    """Mean and deviation over the seeds of each fold, on trained scores."""
    return E.fold_summary(training.fold_reports(_trained(spark, d)[1], THETAS), _RATES)
