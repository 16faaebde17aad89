"""Registered queries of the library's operators over the order and event tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.worktime import WorkCalendar, iso_week
from .operators import capability as cap
from .operators import asof, charts, conformance, cox, design, eventlog, incremental, lint, mining, nelson, survival
from .operators import concordance as conc
from .operators import gage as gage_ops
from .plans import fixtures as fx
from .plans.fixtures import CASES, DAILY, GAGE, LOG_SESSION, LOG_USER, OBS, ORDERED
from .plans.sample_model import sample
from .plans.workers import reachable
from .sources.synth import SynthConfig, simulate

CAL = WorkCalendar()
BETA = (0.25, -0.15)
_Q: dict = {}
_SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql.strip()
        return f

    return add


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"

# --- data model -----------------------------------------------------------------------------------
_query("log_activities", f"WITH {LOG_USER} SELECT DISTINCT activity FROM log")(lambda s, d: eventlog.activities(fx.log_user(s, d)))
_query("log_resources", f"WITH {LOG_USER} SELECT DISTINCT resource FROM log WHERE resource <> ''")(lambda s, d: eventlog.resources(fx.log_user(s, d)))
_query("log_sorted", f"WITH {LOG_USER} SELECT case_id, activity, {STAMP.format('ts')} AS ts, resource, seq FROM log")(lambda s, d: eventlog.sort_log(fx.log_user(s, d)).withColumn("ts", _stamp("ts")))
_query("log_traces", f"WITH {LOG_SESSION} SELECT case_id, string_agg(activity, '>' ORDER BY ts, seq) AS trace FROM log GROUP BY 1")(
    lambda s, d: eventlog.traces(fx.log_session(s, d)).select("case_id", F.array_join("trace", ">").alias("trace")))


@_query("log_filter_cases", f"WITH {LOG_SESSION} SELECT case_id, activity, seq FROM log WHERE case_id IN (SELECT case_id FROM log WHERE activity = 'purchase')")
def _filter_cases(s, d):
    log = fx.log_session(s, d)
    return eventlog.filter_cases(log, log.where("activity = 'purchase'")).select("case_id", "activity", "seq")


@_query("log_add", f"WITH {LOG_USER} SELECT activity, count(*) AS n FROM (SELECT activity FROM log UNION ALL SELECT 'review' FROM log WHERE activity = 'purchase') GROUP BY 1")
def _log_add(s, d):
    log = fx.log_user(s, d)
    more = log.where("activity = 'purchase'").withColumn("activity", F.lit("review"))
    return eventlog.add_events(log, more).groupBy("activity").agg(F.count("*").alias("n"))


_query("case_breached", f"WITH {CASES} SELECT case_id, CASE WHEN duration_hours > sla_hours THEN true WHEN resolved THEN false END AS breached FROM cases")(
    lambda s, d: fx.order_cases(s, d).select("case_id", eventlog.breached().alias("breached")))
_query("case_resolved", f"WITH {CASES} SELECT case_id, duration_hours FROM cases WHERE resolved")(lambda s, d: eventlog.resolved_cases(fx.order_cases(s, d)).select("case_id", "duration_hours"))
_query("case_lookup", f"WITH {CASES} SELECT case_id, duration_hours, resolved FROM cases WHERE case_id = '42'")(lambda s, d: eventlog.get_case(fx.order_cases(s, d), "42").select("case_id", "duration_hours", "resolved"))
_query("case_censoring", f"WITH {CASES} SELECT round(avg((NOT resolved)::INT), 6) AS censoring_rate FROM cases")(lambda s, d: _round(eventlog.censoring_rate(fx.order_cases(s, d)), "censoring_rate"))

# --- working-hours calendar ------------------------------------------------------------------------
_query("cal_working_hours", f"WITH {LOG_USER}, {ORDERED} SELECT seq, round({fx.sql_hours('ts', 'next_ts')}, 6) AS hours FROM o WHERE next_ts IS NOT NULL")(
    lambda s, d: _round(eventlog.ordered(fx.log_user(s, d)).where("next_ts IS NOT NULL").select("seq", CAL.hours_between("ts", "next_ts").alias("hours")), "hours"))
_query("cal_next_moment", f"WITH {LOG_USER} SELECT seq, {STAMP.format(fx.sql_at(fx.sql_elapsed('ts')))} AS moment FROM log")(
    lambda s, d: fx.log_user(s, d).select("seq", _stamp(CAL.next_moment("ts")).alias("moment")))
_query("cal_add_hours", f"WITH {LOG_USER} SELECT seq, {STAMP.format(fx.sql_at(fx.sql_elapsed('ts') + ' + round((seq % 50) * 0.75::DOUBLE * 3600000000)::BIGINT'))} AS moment FROM log")(
    lambda s, d: fx.log_user(s, d).select("seq", _stamp(CAL.add_hours("ts", (F.col("seq") % 50) * 0.75)).alias("moment")))
_query("cal_iso_week", f"WITH {LOG_USER} SELECT {fx.sql_week('ts')} AS week, count(*) AS n FROM log GROUP BY 1")(lambda s, d: fx.log_user(s, d).groupBy(iso_week("ts").alias("week")).agg(F.count("*").alias("n")))
_query("cal_working_day", f"WITH {LOG_USER} SELECT ts::DATE::VARCHAR AS day, bool_and(isodow(ts) < 6) AS working FROM log GROUP BY 1")(
    lambda s, d: fx.log_user(s, d).select(F.col("ts").cast("date").alias("t")).distinct().select(F.col("t").cast("string").alias("day"), CAL.is_working_day("t").alias("working")))
_query("weekly_breaches", f"""WITH {CASES}, t AS (SELECT *, {fx.sql_at(fx.sql_elapsed('arrived') + ' + round(duration_hours * 3600000000)::BIGINT')} AS done FROM cases WHERE resolved)
SELECT {fx.sql_week('done')} AS week, count(*) AS resolved, sum((duration_hours > sla_hours)::INT)::BIGINT AS breaches, round(avg(duration_hours), 6) AS mean_hours FROM t GROUP BY 1""")(
    lambda s, d: _round(eventlog.weekly_breaches(fx.order_cases(s, d)), "mean_hours"))

# --- process mining --------------------------------------------------------------------------------
_query("dfg_nodes", f"WITH {LOG_USER} SELECT activity, count(*) AS frequency, count(DISTINCT case_id) AS case_frequency, round(count(*) / count(DISTINCT case_id)::DOUBLE, 6) AS repetition_rate FROM log GROUP BY 1")(
    lambda s, d: _round(mining.nodes(fx.log_user(s, d)), "repetition_rate"))


def _edge_sql(log, hours, more=""):
    return f"""WITH {log}, {ORDERED}, h AS (SELECT activity AS source, next_activity AS target, {hours} AS hours FROM o WHERE next_activity IS NOT NULL)
SELECT source, target, count(*) AS frequency, round(sum(hours), 6) AS total_hours, round(avg(hours), 6) AS mean_hours, round(quantile_cont(hours, 0.5), 6) AS median_hours, round(quantile_cont(hours, 0.9), 6) AS p90_hours FROM h GROUP BY 1, 2{more}"""


_WORK, _WALL = fx.sql_hours("ts", "next_ts"), "((epoch_us(next_ts) - epoch_us(ts)) / 3600000000.0::DOUBLE)"
_EDGE = ("total_hours", "mean_hours", "median_hours", "p90_hours")
_query("dfg_edges", _edge_sql(LOG_USER, _WORK))(lambda s, d: _round(mining.edges(fx.log_user(s, d), CAL), *_EDGE))
_query("dfg_edges_wall", _edge_sql(LOG_USER, _WALL))(lambda s, d: _round(mining.edges(fx.log_user(s, d)), *_EDGE))
_query("dfg_edges_selected", _edge_sql(LOG_USER, _WORK))(lambda s, d: _round(mining.edges(fx.log_user(s, d), CAL, small=0), *_EDGE))


def _halves(s, d):
    """Two batches of the log, one after the other, summarised apart and merged."""
    log = fx.log_user(s, d)
    return incremental.merge(*(incremental.summarize(log.where(f"ts {side} TIMESTAMP_NTZ'2024-01-15 12:00:00'")) for side in ("<", ">=")))


_query("dfg_edges_merged", _edge_sql(LOG_USER, _WALL))(lambda s, d: _round(incremental.graph(_halves(s, d)), *_EDGE))
_query("dfg_start_end_merged", f"WITH {LOG_USER}, {ORDERED} SELECT activity, sum((pos = 1)::INT)::BIGINT AS starts, sum((next_activity IS NULL)::INT)::BIGINT AS ends FROM o WHERE pos = 1 OR next_activity IS NULL GROUP BY 1")(
    lambda s, d: incremental.start_end(_halves(s, d)))
_query("dfg_filtered", _edge_sql(LOG_SESSION, _WALL, " HAVING count(*) >= 100"))(lambda s, d: _round(mining.edges(fx.log_session(s, d), least=100), *_EDGE))
_query("dfg_self_loops", _edge_sql(LOG_USER, _WALL, " HAVING source = target"))(lambda s, d: _round(mining.self_loops(mining.edges(fx.log_user(s, d))), *_EDGE))
_query("dfg_successors", f"WITH {LOG_SESSION}, {ORDERED} SELECT DISTINCT next_activity AS target FROM o WHERE activity = 'view' AND next_activity IS NOT NULL")(lambda s, d: mining.successors(mining.edges(fx.log_session(s, d)), "view"))
_query("dfg_start_end", f"WITH {LOG_SESSION}, {ORDERED} SELECT activity, sum((pos = 1)::INT)::BIGINT AS starts, sum((next_activity IS NULL)::INT)::BIGINT AS ends FROM o WHERE pos = 1 OR next_activity IS NULL GROUP BY 1")(
    lambda s, d: mining.start_end(fx.log_session(s, d)))
_BOTTLENECKS = f"""WITH {LOG_USER}, {ORDERED}, h AS (SELECT activity AS source, next_activity AS target, {_WORK} AS hours FROM o WHERE next_activity IS NOT NULL)
SELECT source, target, round(sum(hours), 6) AS total_hours, round(avg(hours), 6) AS mean_hours, count(*) AS frequency FROM h GROUP BY 1, 2 ORDER BY sum(hours) DESC, 1, 2 LIMIT 10"""
_query("bottlenecks", _BOTTLENECKS)(lambda s, d: _round(mining.bottlenecks(fx.log_user(s, d), CAL, 10), "total_hours", "mean_hours"))
_query("bottlenecks_from_graph", _BOTTLENECKS)(lambda s, d: _round(mining.bottlenecks(None, top=10, graph=mining.edges(fx.log_user(s, d), CAL)), "total_hours", "mean_hours"))
_VARIANTS = f"WITH {LOG_SESSION}, t AS (SELECT case_id, string_agg(activity, '>' ORDER BY ts, seq) AS trace, count(*) AS length FROM log GROUP BY 1)"
_query("variants", _VARIANTS + " SELECT trace, count(*) AS count, max(length)::INT AS length, string_agg(case_id, ',' ORDER BY case_id) AS case_ids FROM t GROUP BY 1")(
    lambda s, d: mining.variants(fx.log_session(s, d), with_cases=True).select(F.array_join("trace", ">").alias("trace"), "count", "length", F.array_join("case_ids", ",").alias("case_ids")))
_query("variant_cases", _VARIANTS + " SELECT trace, case_id FROM t")(lambda s, d: mining.variant_cases(fx.log_session(s, d)).select(F.array_join("trace", ">").alias("trace"), "case_id"))
_query("variant_coverage", _VARIANTS + """, v AS (SELECT trace, count(*) AS count, max(string_split(trace, '>')) AS key FROM t GROUP BY 1)
SELECT trace, count, row_number() OVER (ORDER BY count DESC, key)::INT AS rank, round(sum(count) OVER (ORDER BY count DESC, key ROWS UNBOUNDED PRECEDING) / (sum(count) OVER ())::DOUBLE, 6) AS coverage FROM v""")(
    lambda s, d: _round(mining.variant_coverage(fx.log_session(s, d)).withColumn("trace", F.array_join("trace", ">")), "coverage"))
_STATS = ("mean_hours", "median_hours", "p90_hours", "total_hours")


def _stats_sql(prev, extra="", join=""):
    return f"""WITH {LOG_SESSION}{extra}, {ORDERED}, h AS (SELECT o.activity, o.case_id, greatest(0, (epoch_us(ts) - epoch_us({prev})) / 3600000000.0::DOUBLE) AS hours, {prev} AS p FROM o{join}),
k AS (SELECT activity, case_id, CASE WHEN p IS NOT NULL THEN hours END AS hours FROM h)
SELECT activity, count(*) AS occurrences, count(DISTINCT case_id) AS cases, round(coalesce(avg(hours), 0), 6) AS mean_hours, round(coalesce(quantile_cont(hours, 0.5), 0), 6) AS median_hours,
 round(coalesce(quantile_cont(hours, 0.9), 0), 6) AS p90_hours, round(coalesce(sum(hours), 0), 6) AS total_hours FROM k GROUP BY 1"""


_query("activity_stats", _stats_sql("prev_ts"))(lambda s, d: _round(mining.activity_statistics(fx.log_session(s, d)), *_STATS))

_query("activity_stats_selected", _stats_sql("prev_ts"))(lambda s, d: _round(mining.activity_statistics(fx.log_session(s, d), small=0), *_STATS))


@_query("activity_stats_arrival", _stats_sql("coalesce(prev_ts, arrived)", ", a AS (SELECT case_id, date_trunc('day', min(ts)) AS arrived FROM log GROUP BY 1)", " LEFT JOIN a USING (case_id)"))
def _stats_arrival(s, d):
    log = fx.log_session(s, d)
    arrivals = log.groupBy("case_id").agg(F.min("ts").cast("date").cast("timestamp_ntz").alias("arrived"))
    return _round(mining.activity_statistics(log, arrivals), *_STATS)


_query("rework", f"""WITH {LOG_USER}, {ORDERED}, c AS (SELECT activity, case_id, count(*) AS n, sum((prev_activity IS NOT DISTINCT FROM activity)::INT) AS loops FROM o GROUP BY 1, 2)
SELECT activity, count(*) AS cases, sum((n > 1)::INT)::BIGINT AS rework_cases, sum(n)::BIGINT AS occurrences, sum(loops)::BIGINT AS self_loops,
 round(sum((n > 1)::INT) / count(*)::DOUBLE, 6) AS rework_rate, round(1 - sum((n > 1)::INT) / count(*)::DOUBLE, 6) AS first_time_right FROM c GROUP BY 1""")(
    lambda s, d: _round(mining.rework(fx.log_user(s, d)), "rework_rate", "first_time_right"))
_HAND = "WITH {}, {} SELECT resource AS source, next_resource AS target, count(*) AS count FROM o WHERE resource <> '' AND next_resource <> ''{} GROUP BY 1, 2"
_query("handover", _HAND.format(LOG_USER, ORDERED, " AND resource <> next_resource"))(lambda s, d: mining.handovers(fx.log_user(s, d)))
_query("handover_self", _HAND.format(LOG_USER, ORDERED, ""))(lambda s, d: mining.handovers(fx.log_user(s, d), include_self=True))
_query("map_thresholds", f"""WITH {LOG_USER}, {ORDERED}, e AS (SELECT count(*) AS f FROM o WHERE next_activity IS NOT NULL GROUP BY activity, next_activity), l AS (SELECT list(f ORDER BY f) AS x FROM e)
SELECT DISTINCT threshold FROM (SELECT 1::BIGINT AS threshold UNION ALL SELECT x[(i * (len(x) - 1) // 7) + 1] FROM l, range(8) r(i))""")(
    lambda s, d: s.createDataFrame([(int(x),) for x in mining.map_thresholds(mining.edges(fx.log_user(s, d)))], "threshold long"))

# --- conformance -----------------------------------------------------------------------------------
_RULES = (
    conformance.RequiredActivities(("view", "purchase")),
    conformance.ForbiddenTransition("error", "purchase"),
    conformance.Ordering("view", "purchase"),
    conformance.MaxOccurrences("error", 1),
    conformance.StartActivities(("view", "signup")),
    conformance.EndActivities(("purchase", "click")),
    conformance.FourEyes(("view", "click"), "purchase"),
)
_VIOL = {
    "conf_required": """SELECT case_id, 'REQUIRED' AS rule, 'missing ' || concat_ws(', ', CASE WHEN NOT bool_or(activity = 'view') THEN 'view' END, CASE WHEN NOT bool_or(activity = 'purchase') THEN 'purchase' END) AS detail
 FROM o GROUP BY 1 HAVING NOT bool_or(activity = 'view') OR NOT bool_or(activity = 'purchase')""",
    "conf_forbidden": "SELECT case_id, 'FORBIDDEN' AS rule, '''error'' -> ''purchase'' at position ' || pos AS detail FROM o WHERE activity = 'error' AND next_activity = 'purchase'",
    "conf_ordering": """SELECT case_id, 'ORDERING' AS rule, '''purchase'' occurred at position ' || min(pos - 1) || ' without a preceding ''view''' AS detail FROM
 (SELECT *, max((activity = 'view')::INT) OVER (PARTITION BY case_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM o) WHERE activity = 'purchase' AND coalesce(seen, 0) = 0 GROUP BY case_id""",
    "conf_max_occ": "SELECT case_id, 'MAX_OCCURRENCES' AS rule, '''error'' occurred ' || count(*) || ' times' AS detail FROM o WHERE activity = 'error' GROUP BY 1 HAVING count(*) > 1",
    "conf_start": "SELECT case_id, 'START' AS rule, 'started with ''' || activity || '''' AS detail FROM o WHERE pos = 1 AND activity NOT IN ('view', 'signup')",
    "conf_end": "SELECT case_id, 'END' AS rule, 'ended with ''' || activity || '''' AS detail FROM o WHERE next_activity IS NULL AND activity NOT IN ('purchase', 'click')",
    "conf_four_eyes": """SELECT case_id, 'FOUR_EYES' AS rule, resource || ' both performed ''' || made || ''' and checked it' AS detail FROM
 (SELECT *, last_value(CASE WHEN activity IN ('view', 'click') THEN activity END IGNORE NULLS) OVER p AS made, last_value(CASE WHEN activity IN ('view', 'click') THEN resource END IGNORE NULLS) OVER p AS maker FROM o
 WINDOW p AS (PARTITION BY case_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE activity = 'purchase' AND resource <> '' AND resource = maker""",
}
for _i, (_name, _body) in enumerate(_VIOL.items()):
    _query(_name, f"WITH {LOG_SESSION}, {ORDERED} {_body}")(lambda s, d, r=_RULES[_i]: r.violations(fx.log_session(s, d)).select("case_id", "rule", "detail"))
_ALL = f"WITH {LOG_SESSION}, {ORDERED}, v AS (" + " UNION ALL ".join(f"SELECT * FROM ({b})" for b in _VIOL.values()) + ")"
_query("conf_fitness", _ALL + " SELECT (SELECT count(DISTINCT case_id) FROM log) AS cases, count(DISTINCT case_id) AS violating_cases, round(1 - count(DISTINCT case_id) / (SELECT count(DISTINCT case_id) FROM log)::DOUBLE, 6) AS fitness FROM v")(
    lambda s, d: _round(conformance.fitness(fx.log_session(s, d), conformance.violations(fx.log_session(s, d), _RULES)), "fitness"))
_query("conf_by_rule", _ALL + " SELECT rule, count(*) AS violations, count(DISTINCT case_id) AS cases FROM v GROUP BY 1")(lambda s, d: conformance.by_rule(conformance.violations(fx.log_session(s, d), _RULES)))
_query("conf_cases_for", _ALL + " SELECT DISTINCT case_id FROM v WHERE rule = 'FOUR_EYES'")(lambda s, d: conformance.cases_for(conformance.violations(fx.log_session(s, d), _RULES), "FOUR_EYES"))



def _error_then_purchase(pdf):
    """Rows of many cases: each purchase right after an error of the same case."""
    pos = pdf.groupby("case_id", sort=False).cumcount() + 1
    hit = (pdf["activity"] == "error") & (pdf["activity"].shift(-1) == "purchase") & (pdf["case_id"].shift(-1) == pdf["case_id"])
    return pdf.loc[hit, ["case_id"]].assign(detail="'error' -> 'purchase' at position " + pos[hit].astype(str))


# the twins of two built-in rules, by batches of whole cases and case by case
_query("conf_custom_batch", f"WITH {LOG_SESSION}, {ORDERED} {_VIOL['conf_forbidden']}")(
    lambda s, d: conformance.CustomRule(_error_then_purchase, "FORBIDDEN", whole=True).violations(fx.log_session(s, d)).select("case_id", "rule", "detail"))
_query("conf_custom_case", f"WITH {LOG_SESSION}, {ORDERED} {_VIOL['conf_end']}")(
    lambda s, d: conformance.CustomRule(lambda c: [f"ended with '{a}'" for a in c["activity"].iloc[-1:] if a not in ("purchase", "click")], "END").violations(fx.log_session(s, d)).select("case_id", "rule", "detail"))

# --- control charts --------------------------------------------------------------------------------
_CHART = ("value", "center", "lcl", "ucl", "sigma", "z")


def _nelson_sql(points: str, only: str | None = None) -> str:
    """points: a CTE p(ord, label, value, center, lcl, ucl, sigma)."""
    c = lambda e, k: f"sum(({e})::INT) OVER (ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    side = lambda lv, hits, k: f"(abs(z) > {lv} AND (({c(f'z > {lv}', k)} >= {hits} AND {c(f'z < -{lv}', k)} = 0) OR ({c(f'z < -{lv}', k)} >= {hits} AND {c(f'z > {lv}', k)} = 0)))"
    tests = {
        1: "abs(z) > 3", 2: f"i >= 9 AND ({c('z > 0', 9)} = 9 OR {c('z < 0', 9)} = 9)", 3: f"i >= 6 AND ({c('dz > 0', 5)} = 5 OR {c('dz < 0', 5)} = 5)",
        4: f"i >= 14 AND {c('coalesce(dz * pdz < 0, false)', 12)} = 12", 5: f"i >= 3 AND {side(2, 2, 3)}", 6: f"i >= 5 AND {side(1, 4, 5)}",
        7: f"i >= 15 AND {c('abs(z) < 1', 15)} = 15", 8: f"i >= 8 AND {c('abs(z) > 1', 8)} = 8 AND {c('z > 0', 8)} > 0 AND {c('z < 0', 8)} > 0",
    }
    if only:
        tests = {k: v for k, v in tests.items() if str(k) in only}
    flags = ", ".join(f"CASE WHEN {t} THEN 'NELSON_{k}' END" for k, t in tests.items())
    return f"""{points}, q AS (SELECT *, row_number() OVER (ORDER BY ord)::INT AS i, CASE WHEN sigma > 0 THEN (value - center) / sigma ELSE 0 END AS z FROM p),
r AS (SELECT *, z - lag(z) OVER (ORDER BY i) AS dz FROM q), t AS (SELECT *, lag(dz) OVER (ORDER BY i) AS pdz FROM r), f AS (SELECT *, concat_ws('|', {flags}) AS violations FROM t)"""


_OUT = " SELECT i AS index, label, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CHART) + ", violations FROM f"
_X = f"WITH {DAILY}, m AS (SELECT day, mean_value AS value, abs(mean_value - lag(mean_value) OVER (ORDER BY day)) AS mr FROM d), p AS (SELECT day AS ord, day AS label, value, avg(value) OVER () AS center, avg(mr) OVER () / 1.128::DOUBLE AS sigma, avg(value) OVER () - 3 * avg(mr) OVER () / 1.128::DOUBLE AS lcl, avg(value) OVER () + 3 * avg(mr) OVER () / 1.128::DOUBLE AS ucl FROM m)"
_query("chart_individuals", _nelson_sql(_X) + _OUT)(lambda s, d: charts.to_rows(charts.individuals(fx.daily(s, d), "mean_value", "day", "day")))
_MR = f"WITH {DAILY}, m AS (SELECT day, abs(mean_value - lag(mean_value) OVER (ORDER BY day)) AS value FROM d QUALIFY value IS NOT NULL), p AS (SELECT day AS ord, day AS label, value, avg(value) OVER () AS center, 0.0::DOUBLE AS lcl, 3.267::DOUBLE * avg(value) OVER () AS ucl, avg(value) OVER () * 0.853::DOUBLE / 1.128::DOUBLE AS sigma FROM m)"
_query("chart_mr", _nelson_sql(_MR, "1") + _OUT)(lambda s, d: charts.to_rows(charts.moving_range(fx.daily(s, d), "mean_value", "day", "day")))
_P = f"WITH {DAILY}, m AS (SELECT *, sum(errors) OVER () / (sum(n) OVER ())::DOUBLE AS center FROM d), k AS (SELECT *, sqrt(center * (1 - center) / n) AS sigma FROM m), p AS (SELECT day AS ord, day AS label, errors / n::DOUBLE AS value, center, sigma, greatest(0, center - 3 * sigma) AS lcl, least(1, center + 3 * sigma) AS ucl FROM k)"
_query("chart_p", _nelson_sql(_P) + _OUT)(lambda s, d: charts.to_rows(charts.p_chart(fx.daily(s, d), "errors", "n", "day", "day")))
_C = f"WITH {DAILY}, m AS (SELECT *, avg(errors) OVER () AS center FROM d), p AS (SELECT day AS ord, day AS label, errors::DOUBLE AS value, center, sqrt(center) AS sigma, greatest(0, center - 3 * sqrt(center)) AS lcl, center + 3 * sqrt(center) AS ucl FROM m)"
_query("chart_c", _nelson_sql(_C) + _OUT)(lambda s, d: charts.to_rows(charts.c_chart(fx.daily(s, d), "errors", "day", "day")))
_U = f"WITH {DAILY}, m AS (SELECT *, sum(errors) OVER () / (sum(n) OVER ())::DOUBLE AS center FROM d), k AS (SELECT *, sqrt(center / n) AS sigma FROM m), p AS (SELECT day AS ord, day AS label, errors / n::DOUBLE AS value, center, sigma, greatest(0, center - 3 * sigma) AS lcl, center + 3 * sigma AS ucl FROM k)"
_query("chart_u", _nelson_sql(_U) + _OUT)(lambda s, d: charts.to_rows(charts.u_chart(fx.daily(s, d), "errors", "n", "day", "day")))


def _fives(s, d):
    """Consecutive groups of five events by id."""
    return fx.table(s, d, "events").select(F.floor(F.col("event_id") / 5).cast("long").alias("g"), "value")


_XBAR = "WITH m AS (SELECT event_id // 5 AS g, avg(value) AS value, max(value) - min(value) AS r FROM events GROUP BY 1), p AS (SELECT g AS ord, g::VARCHAR AS label, value, avg(value) OVER () AS center, avg(value) OVER () + 0.577::DOUBLE * avg(r) OVER () AS ucl, avg(value) OVER () - 0.577::DOUBLE * avg(r) OVER () AS lcl, avg(r) OVER () / 2.326::DOUBLE / sqrt(5) AS sigma FROM m)"
_query("chart_xbar_r", _nelson_sql(_XBAR) + _OUT)(lambda s, d: charts.to_rows(charts.xbar_r(_fives(s, d), "value", "g")))
for _k in range(1, 9):
    _query(f"nelson_{_k}", _nelson_sql(_XBAR, str(_k)) + " SELECT i AS index, violations FROM f WHERE violations <> ''")(
        lambda s, d, k=_k: charts.to_rows(charts.signals(charts.xbar_r(_fives(s, d), "value", "g", [k])).withColumn("violations", F.split("violations", r"\|"))).select("index", "violations"))
_query("nelson_expand", _nelson_sql(_XBAR, "25") + " SELECT i AS index, concat_ws('|', CASE WHEN max((contains(violations, 'NELSON_2'))::INT) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) = 1 THEN 'NELSON_2' END, CASE WHEN max((contains(violations, 'NELSON_5'))::INT) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 1 THEN 'NELSON_5' END) AS violations FROM f")(
    lambda s, d: nelson.expand(charts.xbar_r(_fives(s, d), "value", "g", [2, 5]), "index").select("index", F.concat_ws("|", "violations").alias("violations")))
_query("capability_core", "WITH m AS (SELECT value, abs(value - lag(value) OVER (ORDER BY event_id)) AS mr FROM events) SELECT count(*) AS n, round(avg(value), 6) AS mean, round(avg(mr) / 1.128::DOUBLE, 6) AS sigma_within, round(stddev_samp(value), 6) AS sigma_overall, round(avg((value > 90 OR value < 5)::INT), 6) AS observed FROM m")(
    lambda s, d: _round(cap.core(fx.table(s, d, "events"), "value", ["event_id"], 5.0, 90.0), "mean", "sigma_within", "sigma_overall", "observed"))


@_query("capability_full")
def _capability(s, d):
    r = cap.capability(fx.table(s, d, "events"), "value", ["event_id"], 5.0, 90.0, 50.0).to_dict()
    return s.createDataFrame([tuple(float(r[k]) for k in ("cp", "cpk", "pp", "ppk", "cpm", "expected_defective", "dpmo", "sigma_level"))], "cp double, cpk double, pp double, ppk double, cpm double, expected double, dpmo double, sigma_level double")


_SS = ("ss_part", "ss_operator", "ss_interaction", "ss_error", "ss_total")
_query("gage_components", f"""WITH {GAGE}, c AS (SELECT part, operator, value, avg(value) OVER (PARTITION BY part, operator) AS m, avg(value) OVER (PARTITION BY part) AS mp, avg(value) OVER (PARTITION BY operator) AS mo, avg(value) OVER () AS mt FROM g)
SELECT count(DISTINCT part) AS parts, count(DISTINCT operator) AS operators, 10::BIGINT AS replicates, round(sum((mp - mt) ** 2), 6) AS ss_part, round(sum((mo - mt) ** 2), 6) AS ss_operator, round(sum((m - mp - mo + mt) ** 2), 6) AS ss_interaction, round(sum((value - m) ** 2), 6) AS ss_error, round(sum((value - mt) ** 2), 6) AS ss_total FROM c""")(
    lambda s, d: gage_ops.sums_of_squares(fx.gage(s, d), "part", "operator", "value").select("parts", "operators", "replicates", *[F.round(x, 6).alias(x) for x in _SS]))


@_query("gage_report")
def _gage(s, d):
    r = gage_ops.gage_rr(fx.gage(s, d), "part", "operator", "value")
    return s.createDataFrame([(r.var_repeatability, r.var_operator, r.var_interaction, r.var_part, r.distinct_categories, r.verdict)], "repeatability double, operator double, interaction double, part double, categories int, verdict string")


# --- survival --------------------------------------------------------------------------------------
_RISK = f"""WITH {OBS}, a AS (SELECT duration AS time, sum(event)::BIGINT AS events, count(*) AS n FROM obs GROUP BY 1),
risk AS (SELECT time, (sum(n) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS at_risk, events, n - events AS censored FROM a)"""
_KM = _RISK + """, s AS (SELECT *, product(1.0::DOUBLE - events / at_risk::DOUBLE) OVER w AS survival, max((at_risk = events)::INT) OVER w AS done, sum(CASE WHEN at_risk > events THEN events / (at_risk::DOUBLE * (at_risk - events)) ELSE 0 END) OVER w AS g FROM risk WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, (survival > 0 AND survival < 1 AND done = 0) AS inside FROM s), km AS (SELECT *, CASE WHEN inside THEN 1.959963984540054 * sqrt(g) / abs(ln(survival)) END AS spread FROM k)"""
_query("risk_table", _RISK + " SELECT * FROM risk")(lambda s, d: survival.risk_table(fx.observations(s, d)))
_query("risk_table_buckets", _RISK + " SELECT * FROM risk")(lambda s, d: survival.risk_table(fx.observations(s, d), rows=100))
_query("km_curve", _KM + """ SELECT time, at_risk, events, censored, round(survival, 6) AS survival, round(CASE WHEN done = 0 THEN survival * sqrt(g) ELSE 0 END, 6) AS std_error,
 round(CASE WHEN inside THEN survival ** exp(spread) ELSE least(1, greatest(0, survival)) END, 6) AS lower, round(CASE WHEN inside THEN survival ** exp(-spread) ELSE least(1, greatest(0, survival)) END, 6) AS upper FROM km""")(
    lambda s, d: _round(survival.kaplan_meier(fx.observations(s, d)), "survival", "std_error", "lower", "upper"))


@_query("km_quantiles", _KM + " SELECT p, (SELECT min(time) FROM km WHERE survival <= 1 - p) AS time FROM (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(p)")
def _km_quantiles(s, d):
    curve = survival.kaplan_meier(fx.observations(s, d)).select("time", "survival")
    ps = s.createDataFrame([(0.25,), (0.5,), (0.75,)], "p double")
    return ps.join(curve, curve.survival <= 1 - ps.p, "left").groupBy("p").agg(F.min("time").alias("time"))


_query("km_at", _KM + " SELECT round(max_by(survival, time), 6) AS survival FROM km WHERE time <= 1000")(lambda s, d: survival.kaplan_meier(fx.observations(s, d)).where("time <= 1000").agg(F.round(F.max_by("survival", "time"), 6).alias("survival")))
_query("km_rmst", _KM + """, z AS (SELECT time, survival, lag(survival, 1, 1.0) OVER (ORDER BY time) AS s, lag(time, 1, 0.0) OVER (ORDER BY time) AS a, lead(time) OVER (ORDER BY time) AS nx FROM km)
SELECT round(sum(CASE WHEN a < 2400 THEN s * (least(2400, time) - a) ELSE 0 END + CASE WHEN nx IS NULL AND time < 2400 THEN survival * (2400 - time) ELSE 0 END), 6) AS rmst FROM z""")(
    lambda s, d: _round(survival.restricted_mean(survival.kaplan_meier(fx.observations(s, d)), 2400.0), "rmst"))
_query("na_curve", _RISK + " SELECT *, round(sum(events / at_risk::DOUBLE) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 6) AS cumulative_hazard FROM risk")(lambda s, d: _round(survival.nelson_aalen(fx.observations(s, d)), "cumulative_hazard"))
_query("logrank_core", f"""WITH {OBS}, a AS (SELECT duration AS time, count(*) AS n, sum(urgent) AS n1, sum(event) AS d, sum(event * urgent) AS d1 FROM obs GROUP BY 1),
b AS (SELECT *, (sum(n) OVER w)::DOUBLE AS r, (sum(n1) OVER w)::DOUBLE AS r1 FROM a WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING))
SELECT sum(d1)::DOUBLE AS observed, round(sum(d * r1 / r), 6) AS expected, round(sum(d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1)), 6) AS variance FROM b WHERE d > 0 AND r > 1""")(
    lambda s, d: _round(survival.logrank_core(fx.observations(s, d), "urgent"), "expected", "variance"))


#: Upper tail of chi-square with one degree of freedom at x: a series for erf.
_TAIL = "(CASE WHEN {x} <= 0 THEN 1 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-{x} / 2) * list_sum([exp(2 * k * ln(2) + (2 * k + 1) * ln(sqrt({x} / 2)) - lgamma(2 * k + 2) + lgamma(k + 1)) FOR k IN generate_series(0, 200)])) END)"


@_query("logrank_by_nation", f"""WITH {OBS}, s AS (SELECT obs.*, c_nationkey AS nation FROM obs JOIN orders ON o_orderkey::VARCHAR = case_id JOIN customer ON c_custkey = o_custkey),
a AS (SELECT nation, duration AS time, count(*) AS n, sum(urgent) AS n1, sum(event) AS d, sum(event * urgent) AS d1 FROM s GROUP BY 1, 2),
b AS (SELECT *, (sum(n) OVER w)::DOUBLE AS r, (sum(n1) OVER w)::DOUBLE AS r1 FROM a WINDOW w AS (PARTITION BY nation ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT nation, coalesce(sum(d1) FILTER (d > 0 AND r > 1), 0)::DOUBLE AS observed, coalesce(sum(d * r1 / r) FILTER (d > 0 AND r > 1), 0) AS expected, coalesce(sum(d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1)) FILTER (d > 0 AND r > 1), 0) AS variance FROM b GROUP BY 1),
u AS (SELECT *, CASE WHEN variance > 0 THEN (observed - expected) ** 2 / variance ELSE 0 END AS statistic FROM t)
SELECT nation, observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(statistic, 6) AS statistic, round({_TAIL.format(x="statistic")}, 6) AS p_value FROM u""")
def _logrank_by(s, d):
    who = fx.table(s, d, "orders").join(fx.table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").cast("string").alias("case_id"), F.col("c_nationkey").alias("nation"))
    return _round(survival.logrank_by(fx.observations(s, d).join(who, "case_id"), "nation", "urgent", rows=2000), "expected", "variance", "statistic", "p_value")


_LOGRANK = f"""WITH {OBS}, a AS (SELECT duration AS time, count(*) AS n, sum(urgent) AS n1, sum(event) AS d, sum(event * urgent) AS d1 FROM obs GROUP BY 1),
b AS (SELECT *, (sum(n) OVER w)::DOUBLE AS r, (sum(n1) OVER w)::DOUBLE AS r1 FROM a WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT (sum(d1) - sum(d * r1 / r)) ** 2 / sum(d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1)) AS x FROM b WHERE d > 0 AND r > 1)
SELECT round(x, 6) AS statistic, round({_TAIL.format(x="x")}, 6) AS p_value FROM t"""


@_query("logrank_p", _LOGRANK)
def _logrank(s, d):
    r = survival.logrank(fx.observations(s, d), "urgent")
    return _round(s.createDataFrame([(r.statistic, r.p_value)], "statistic double, p_value double"), "statistic", "p_value")


_query("upper_median", f"WITH {CASES} SELECT (list(duration_hours ORDER BY duration_hours))[count(*) // 2 + 1] AS upper_median FROM cases WHERE resolved")(lambda s, d: survival.upper_median(fx.order_cases(s, d).where("resolved"), "duration_hours"))


@_query("design_matrix", f"WITH {CASES} SELECT case_id, round(price, 9) AS x_price, (priority = '1-URGENT')::INT::DOUBLE AS \"x_priority_1-urgent\", (status = 'O')::INT::DOUBLE AS x_status_o, (status = 'P')::INT::DOUBLE AS x_status_p FROM cases")
def _design(s, d):
    m = design.design_matrix(fx.order_cases(s, d), ["price"], {"priority": "1-URGENT"}, ["status"])
    return m.frame.select("case_id", *[f"x_{n}" for n in m.names]).withColumn("x_price", F.round("x_price", 9))


_LP = f"({BETA[0]}::DOUBLE * urgent + {BETA[1]}::DOUBLE * price)"
_COX = f"""WITH {OBS}, w AS (SELECT *, urgent::DOUBLE AS x, price AS y, {_LP} AS lp, exp({_LP}) AS h FROM obs), a AS (SELECT duration AS time, sum(event) AS d, sum(event * lp) AS el, sum(event * x) AS ex, sum(event * y) AS ey, sum(h) AS s0, sum(h * x) AS sx, sum(h * y) AS sy, sum(h * x * x) AS sxx, sum(h * x * y) AS sxy, sum(h * y * y) AS syy FROM w GROUP BY 1),
b AS (SELECT time, d, el, ex, ey, sum(s0) OVER w AS s0, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy, sum(syy) OVER w AS syy FROM a WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING))"""
_query("cox_step", _COX + """ SELECT round(sum(el - d * ln(s0)), 4) AS ll, round(sum(ex - d * sx / s0), 4) AS g0, round(sum(ey - d * sy / s0), 4) AS g1, round(-sum(d * (sxx / s0 - sx * sx / s0 / s0)), 4) AS h0_0,
 round(-sum(d * (sxy / s0 - sx * sy / s0 / s0)), 4) AS h0_1, round(-sum(d * (syy / s0 - sy * sy / s0 / s0)), 4) AS h1_1 FROM b WHERE d > 0""")(
    lambda s, d: cox.likelihood(fx.observations(s, d), ["urgent", "price"], BETA).select(*[F.round(c, 4).alias(c) for c in ("ll", "g0", "g1", "h0_0", "h0_1", "h1_1")]))
_BASE = _COX + ", base AS (SELECT time, d / s0 AS hazard, sum(d / s0) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS cumulative_hazard FROM b WHERE d > 0)"
_query("breslow_baseline", _BASE + " SELECT time, round(hazard, 6) AS hazard, round(cumulative_hazard, 6) AS cumulative_hazard FROM base")(lambda s, d: _round(cox.baseline(fx.observations(s, d), ["urgent", "price"], BETA), "hazard", "cumulative_hazard"))


def _model(s, d):
    obs = fx.observations(s, d)
    return cox.CoxModel(["urgent", "price"], list(BETA), [1.0, 1.0], 0.0, 0.0, 0, True, 0, 0, cox.baseline(obs, ["urgent", "price"], BETA))


@_query("breach_scores", _BASE + ", hz AS (SELECT coalesce(max(cumulative_hazard), 0) AS v FROM base WHERE time <= 960) SELECT case_id, round(lp, 9) AS risk, round(exp(-(SELECT v FROM hz) * exp(lp)), 9) AS breach_probability FROM w")
def _scores(s, d):
    obs = fx.observations(s, d).withColumns({"x_urgent": F.col("urgent"), "x_price": F.col("price")})
    return _round(_model(s, d).breach_probability(obs, 960.0).select("case_id", F.round("risk", 9).alias("risk"), F.round("breach_probability", 9).alias("breach_probability")))


@_query("breach_own_target", _BASE + ", t AS (SELECT case_id, sla_hours FROM cases) SELECT case_id, round(exp(-coalesce((SELECT max(cumulative_hazard) FROM base WHERE time <= sla_hours), 0) * exp(lp)), 6) AS breach_probability FROM w JOIN t USING (case_id)")
def _own_target(s, d):
    obs = fx.observations(s, d).withColumns({"x_urgent": F.col("urgent"), "x_price": F.col("price")}).join(fx.order_cases(s, d).select("case_id", "sla_hours"), "case_id")
    return _round(_model(s, d).breach_by_target(obs).select("case_id", "breach_probability"), "breach_probability")


@_query("risk_ranking", _BASE + ", hz AS (SELECT coalesce(max(cumulative_hazard), 0) AS v FROM base WHERE time <= 960), r AS (SELECT case_id, round(exp(-(SELECT v FROM hz) * exp(lp)), 9) AS breach_probability FROM w) SELECT * FROM r ORDER BY breach_probability DESC, case_id DESC LIMIT 10")
def _ranking(s, d):
    return _scores(s, d).select("case_id", "breach_probability").orderBy(F.col("breach_probability").desc(), F.col("case_id").desc()).limit(10)


_query("survival_curve", _BASE + " SELECT time, round(exp(-cumulative_hazard * exp(0.25::DOUBLE - 0.15::DOUBLE * 2)), 6) AS survival FROM base")(lambda s, d: _round(cox.survival_curve(_model(s, d), {"urgent": 1.0, "price": 2.0}), "survival"))
def _conc_sql(risk: str) -> str:
    return f"""WITH {OBS}, g AS (SELECT duration AS t, event AS e, {risk} AS r, count(*) AS n FROM obs GROUP BY 1, 2, 3)
SELECT round(sum(i.n * j.n * CASE WHEN i.r > j.r THEN 1.0 WHEN i.r = j.r THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS concordant, sum(i.n * j.n)::BIGINT AS pairs, round(sum(i.n * j.n * CASE WHEN i.r > j.r THEN 1.0 WHEN i.r = j.r THEN 0.5 ELSE 0 END)::DOUBLE / sum(i.n * j.n), 6) AS c_index
FROM g i JOIN g j ON i.e = 1 AND (j.t > i.t OR (j.t = i.t AND j.e = 0))"""


def _risked(s, d):
    return fx.observations(s, d).withColumn("risk", F.col("urgent") * BETA[0] + F.col("price") * BETA[1])


_query("concordance", _conc_sql(_LP))(lambda s, d: _round(conc.concordance(_risked(s, d)), "concordant", "c_index"))
# rounded risks have ties; small blocks make most pairs lie in two
_query("concordance_blocks", _conc_sql(f"round({_LP}, 2)"))(lambda s, d: _round(conc.by_blocks(_risked(s, d).withColumn("risk", F.round("risk", 2)), rows=2000), "concordant", "c_index"))


@_query("cox_fit")
def _cox_fit(s, d):
    obs = fx.observations(s, d).withColumns({"x_urgent": F.col("urgent").cast("double"), "x_price": F.col("price")})
    m = cox.fit_cox(obs, ["urgent", "price"])
    return s.createDataFrame([(r["covariate"], r["coef"], r["se"], r["hazard_ratio"], r["p"]) for r in m.rows()], "covariate string, coef double, se double, hazard_ratio double, p double")


# --- as-of joins -----------------------------------------------------------------------------------
@_query("asof_last_order", """WITH r AS (SELECT o_custkey, o_orderdate, max((o_orderkey)) AS last_key FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT o.o_orderkey, o.o_custkey, r.last_key, strftime(r.o_orderdate, '%Y-%m-%d') AS last_date FROM orders o ASOF LEFT JOIN r ON o.o_custkey = r.o_custkey AND o.o_orderdate >= r.o_orderdate""")
def _asof_orders(s, d):
    o = fx.table(s, d, "orders")
    r = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("last_key"))
    got = asof.asof_join(o.select("o_orderkey", "o_custkey", "o_orderdate"), r, ("o_orderdate", "o_orderdate"), ["o_custkey"], rows=5000)
    return got.select("o_orderkey", "o_custkey", "last_key", F.date_format("o_orderdate_right", "yyyy-MM-dd").alias("last_date"))


@_query("asof_last_purchase", """SELECT e.event_id, r.event_id AS purchase_id, round(r.value, 6) AS value FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON e.user_id = r.user_id AND e.ts > r.ts""")
def _asof_events(s, d):
    e = fx.table(s, d, "events")
    r = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"), "value")
    got = asof.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), r, ("ts", "bought"), ["user_id"], strict=True)
    return _round(got.select("event_id", "purchase_id", "value"), "value")


@_query("asof_market", """WITH r AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), l AS (SELECT event_id, ts::DATE - INTERVAL 1 DAY AS d FROM events)
SELECT l.event_id, r.n FROM l ASOF LEFT JOIN r ON l.d >= r.day""")
def _asof_day(s, d):
    """Without keys: one series for all rows."""
    e = fx.table(s, d, "events")
    r = e.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return asof.asof_join(e.select("event_id", F.date_sub(F.col("ts").cast("date"), 1).alias("d")), r, ("d", "day"), rows=1000).select("event_id", "n")


# --- model lint and synthetic extracts (no SQL: a tokenizer, and seeded draws) ----------------------
_query("lint_findings")(lambda s, d: lint.lint(sample(s)))
_query("dax_tokens")(lambda s, d: lint.tokens(sample(s)))
_query("dax_function_calls")(lambda s, d: lint.function_calls(lint.tokens(sample(s))).select("owner_kind", "owner", "idx", "text", "line"))
_query("dax_column_refs")(lambda s, d: lint.column_references(lint.tokens(sample(s))))
_query("synth_events")(lambda s, d: simulate(s, SynthConfig(cases=500))[0])
_query("synth_cases")(lambda s, d: simulate(s, SynthConfig(cases=500))[1])


@_query("km_thinned", _KM + " SELECT time, round(survival, 6) AS survival FROM (SELECT *, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM km) WHERE i % greatest(1, n // 300) = 0 OR i = n - 1")
def _thinned(s, d):
    return _round(survival.thin(survival.kaplan_meier(fx.observations(s, d)), "time").select("time", "survival"), "survival")


_query("chart_signals", _nelson_sql(_XBAR) + " SELECT label, violations FROM f WHERE violations <> ''")(lambda s, d: charts.signals(charts.xbar_r(_fives(s, d), "value", "g")).select("label", "violations"))
_query("hazard_at", _RISK + " SELECT round(sum(events / at_risk::DOUBLE), 6) AS cumulative_hazard FROM risk WHERE time <= 1000")(
    lambda s, d: survival.nelson_aalen(fx.observations(s, d)).where("time <= 1000").agg(F.round(F.max("cumulative_hazard"), 6).alias("cumulative_hazard")))


def flagship(spark, sf_dir) -> DataFrame:
    return _Q["bottlenecks"](spark, sf_dir)


def _ready(query):
    def run(spark, sf_dir):
        reachable(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _ready(q) for name, q in _Q.items()}


def oracle_sql() -> dict:
    return dict(_SQL)
