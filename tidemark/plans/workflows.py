"""The whole analyses: data-sized work as shared DataFrames, small results collected once."""

from __future__ import annotations

import datetime as dt
import html
import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.worktime import WorkCalendar
from ..operators import charts, conformance, cox, design, eventlog, lint, mining, survival
from ..operators.capability import capability
from ..operators.concordance import concordance
from . import render


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def mine(events: DataFrame, top: int = 10, variants: int = 8, rules=conformance.DEFAULT_RULES, calendar: WorkCalendar | None = None) -> dict:
    calendar = calendar or WorkCalendar()
    events = events.select(*eventlog.EVENT_CORE).persist()
    try:
        edges = mining.edges(events, calendar).persist()
        graph = render.collect_map(events, calendar, edges)
        found = conformance.violations(events, rules).persist()
        counted = mining.variants(events, with_cases=False)
        return {
            "graph": graph, "thresholds": mining.map_thresholds(edges), "n_variants": counted.count(), "variants": _rows(counted.limit(variants)),
            "bottlenecks": _rows(mining.bottlenecks(None, top=top, graph=edges)), "rework": _rows(mining.rework(events).orderBy(F.col("rework_rate").desc(), "activity").where("rework_rate > 0").limit(top)),
            "handovers": _rows(mining.handovers(events).limit(5)), "fitness": _rows(conformance.fitness(events, found))[0], "by_rule": _rows(conformance.by_rule(found)), "examples": _rows(conformance.examples(found, 5).orderBy("rule", "case_id", "at")),
        }
    finally:
        events.unpersist()


def control(cases: DataFrame, sla_hours: float | None = None, calendar: WorkCalendar | None = None) -> dict:
    weekly = eventlog.weekly_breaches(cases, calendar).persist()
    if weekly.count() < 2:
        raise ValueError("control charts need at least two weeks of resolved cases")
    done = eventlog.resolved_cases(cases)
    target = sla_hours or done.agg(F.max("sla_hours")).first()[0]
    return {
        "weekly": _rows(weekly.orderBy("week")), "breach_chart": charts.p_chart(weekly, "breaches", "resolved", "week", "week"), "hours_chart": charts.individuals(weekly, "mean_hours", "week", "week"),
        "weak": charts.p_chart_is_weak(weekly, "breaches", "resolved"), "target": target, "capability": capability(done, "duration_hours", ["arrived", "case_id"], usl=target),
    }


def turnaround(cases: DataFrame, numeric=(), binary=None, group: str = "", horizon: float | None = None, sla_hours: float | None = None) -> dict:
    obs = cases.withColumns({"duration": F.col("duration_hours"), "event": F.col("resolved").cast("int")}).persist()
    survival.check(obs)
    curve = survival.kaplan_meier(obs).persist()
    longest, first = obs.agg(F.max("duration"), F.min_by("sla_hours", F.struct("arrived", "case_id"))).first()
    horizon = horizon or longest
    out = {
        "cases": obs.count(), "open": obs.where("event = 0").count(), "curve": curve, "median": survival.quantile(curve), "median_closed": survival.upper_median(obs.where("event = 1"), "duration").first()[0],
        "horizon": horizon, "restricted_mean": survival.restricted_mean(curve, horizon).first()[0], "logrank": None, "model": None,
    }
    if group:
        levels = [r[0] for r in obs.select(F.coalesce(F.col(group), F.lit(""))).distinct().limit(3).collect()]
        if len(levels) == 2:
            out["logrank"] = survival.logrank(obs.withColumn("_g", (F.coalesce(F.col(group), F.lit("")) == max(levels)).cast("int")), "_g")
    if numeric or binary:
        m = design.design_matrix(obs, numeric, binary)
        model = cox.fit_cox(m.frame, m.names)
        scored = model.breach_probability(m.frame, sla_hours or first)
        c = concordance(scored).first()
        out |= {"model": model, "design": m, "target": sla_hours or first, "c_index": c.c_index, "pairs": c.pairs, "ranking": scored.select("case_id", "breach_probability").orderBy(F.col("breach_probability").desc(), F.col("case_id").desc())}
    return out


def lint_model(model: dict, select=None, ignore=()) -> list[dict]:
    toks = lint.tokens(model).persist()
    try:
        return _rows(lint.lint(model, select, ignore, toks))
    finally:
        toks.unpersist()


def _r(x, n=6):
    return None if x is None or (isinstance(x, float) and not math.isfinite(x)) else round(float(x), n)


def _chart(chart: DataFrame) -> dict:
    rows = _rows(charts.to_rows(chart))
    return {"points": rows, "signals": sum(1 for r in rows if r["violations"])}


def payload(events: DataFrame, cases: DataFrame, model: dict | None, numeric=("complexity", "backlog_index", "awaiting_third_party"), binary=None, ground_truth=None) -> dict:
    """Every result as one JSON-ready dictionary."""
    binary = {"priority": "Urgent", "channel": "Post"} if binary is None else binary
    m, s, t = mine(events, top=8), control(cases), turnaround(cases, numeric, binary)
    g, c, fit = m["graph"], s["capability"], t["model"]
    km = survival.thin(t["curve"], "time")
    span = t["design"].frame.agg(*[f for n in fit.names for f in (F.min(f"x_{n}"), F.max(f"x_{n}"), F.avg(f"x_{n}"), F.max(~F.col(f"x_{n}").isin(0.0, 1.0)))]).first()
    meta = []
    for i, n in enumerate(fit.names):
        low, high, mid, kinds = span[4 * i : 4 * i + 4]
        meta.append({"name": n, "binary": not kinds, "min": math.floor(low * 100) / 100, "max": math.ceil(high * 100) / 100, "mean": _r(mid, 2)})
    done = cases.where("resolved").agg(F.count("*"), F.avg(F.when(eventlog.breached(), 1.0).otherwise(0.0))).first()
    found = lint_model(model) if model else []
    # The keys and their order, which readers of the file know.
    return {
        "generated": dt.date.today().isoformat(),
        "summary": {"cases": t["cases"], "events": events.count(), "resolved": done[0], "open": t["open"], "breachRate": _r(done[1], 4)},
        "mining": {
            "activities": len(g.nodes), "transitions": len(g.edges), "variants": m["n_variants"], "thresholds": m["thresholds"], "maps": {str(k): render.to_svg(g, k) for k in m["thresholds"]},
            "topVariants": [{"count": v["count"], "share": _r(v["count"] / max(1, g.cases), 4), "trace": v["trace"]} for v in m["variants"]],
            "bottlenecks": [{"source": b["source"], "target": b["target"], "totalHours": _r(b["total_hours"], 1), "meanHours": _r(b["mean_hours"], 2), "frequency": b["frequency"]} for b in m["bottlenecks"]],
            "rework": [{"activity": r["activity"], "reworkRate": _r(r["rework_rate"], 4), "firstTimeRight": _r(r["first_time_right"], 4)} for r in m["rework"]],
            "conformance": {"fitness": _r(m["fitness"]["fitness"], 4), "totalCases": m["fitness"]["cases"], "byRule": m["by_rule"], "examples": [{k: x[k] for k in ("rule", "case_id", "detail")} for x in m["examples"]]},
        },
        "spc": {"breachRate": _chart(s["breach_chart"]), "handlingHours": _chart(s["hours_chart"]), "weeklyVolume": s["weekly"], "capability": {"target": _r(s["target"], 1), "ppk": _r(c.ppk, 4), "dpmo": _r(c.dpmo, 1), "sigmaLevel": _r(c.sigma_level, 3), "observedDefective": _r(c.observed_defective, 4)}},
        "sla": {
            "cases": t["cases"], "open": t["open"], "censoringRate": _r(t["open"] / max(1, t["cases"]), 4), "medianClosedOnly": _r(t["median_closed"], 2), "medianKaplanMeier": _r(t["median"], 2),
            "km": [{k: _r(r[k]) for k in ("time", "survival", "lower", "upper")} for r in _rows(km.orderBy("time"))],
            "cox": {"names": fit.names, "coefficients": [_r(b, 12) for b in fit.beta], "standardErrors": [_r(x) for x in fit.std_error], "confidenceIntervals": [[_r(a), _r(b)] for a, b in fit.intervals()], "pValues": [float(f"{p:.6g}") for p in fit.p_values],
                    "groundTruth": dict(ground_truth or {}), "concordance": _r(t["c_index"], 4), "comparablePairs": t["pairs"], "covariates": meta, "baseline": [{"time": _r(r["time"], 3), "cumulativeHazard": _r(r["cumulative_hazard"], 12)} for r in _rows(fit.base.orderBy("time"))]},
            "slaTargets": sorted(_r(r[0], 1) for r in cases.select("sla_hours").distinct().collect()),
        },
        "lint": {"rules": [{"code": k, "severity": v, "remedy": lint.REMEDY[k]} for k, v in lint.SEVERITY.items()], "findings": found},
    }


def write_payload(data: dict, path: str) -> None:
    """JSON, or a script that sets window.TIDEMARK_DATA where the path ends in .js."""
    text = json.dumps(data, sort_keys=True, separators=(",", ":"), default=str)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"window.TIDEMARK_DATA={text};\n" if path.endswith(".js") else text + "\n")


def report(data: dict) -> str:
    """One self-contained HTML page of a payload."""
    e = lambda x: html.escape(str(x))

    def grid(rows: list[dict], columns: list[str]) -> str:
        head = "".join(f"<th>{e(c)}</th>" for c in columns)
        body = "".join("<tr>" + "".join(f"<td>{e(' > '.join(r[c]) if isinstance(r[c], list) else r[c])}</td>" for c in columns) + "</tr>" for r in rows)
        return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"

    def chart(d: dict, title: str) -> str:
        p = d["points"]
        x = [float(r["index"]) for r in p]
        lines = [(x, [r[k] for r in p], c) for k, c in (("value", "#24476b"), ("center", "#2f7d46"), ("ucl", "#a33"), ("lcl", "#a33"))]
        return render.line_svg(lines, title, [(float(r["index"]), r["value"]) for r in p if r["violations"]])

    m, s, t, fit = data["mining"], data["spc"], data["sla"], data["sla"]["cox"]
    km = t["km"]
    curve = render.line_svg([([r["time"] for r in km], [r[k] for r in km], c) for k, c in (("survival", "#24476b"), ("lower", "#9db3cc"), ("upper", "#9db3cc"))], "Share of cases still open by working hours", step=True)
    coef = [{"covariate": n, "coefficient": b, "error": x, "low": lo, "high": hi, "p": p} for n, b, x, (lo, hi), p in zip(fit["names"], fit["coefficients"], fit["standardErrors"], fit["confidenceIntervals"], fit["pValues"])]
    known = [n for n in fit["names"] if n in fit["groundTruth"]]
    inside = sum(math.log(lo) <= fit["groundTruth"][n] <= math.log(hi) for n, (lo, hi) in zip(fit["names"], fit["confidenceIntervals"]) if n in fit["groundTruth"])
    note = f"<p>{inside} of {len(known)} known coefficients lie in their intervals.</p>" if known else ""
    forest = render.forest_svg([(n, math.exp(b), lo, hi) for n, b, (lo, hi) in zip(fit["names"], fit["coefficients"], fit["confidenceIntervals"])], "Hazard ratios (above 1: closed sooner)")
    targets = [r for r in t["slaTargets"] if r is not None]
    findings = data["lint"]["findings"]
    counts = {k: sum(f["severity"] == k for f in findings) for k in ("error", "warning", "info")}
    parts = [
        "<!doctype html><html lang='en'><head><meta charset='utf-8'><title>Operations report</title><style>body{font:15px/1.5 sans-serif;max-width:1000px;margin:2em auto;padding:0 1em}table{border-collapse:collapse}td,th{border:1px solid #cbd5e1;padding:.2em .6em;text-align:left}svg{max-width:100%}</style></head><body>",
        f"<h1>Operations report</h1>{grid([data['summary']], list(data['summary']))}",
        f"<h2>Process</h2>{m['maps'][str(m['thresholds'][len(m['thresholds']) // 2])]}<h3>Bottlenecks</h3>{grid(m['bottlenecks'], ['source', 'target', 'totalHours', 'meanHours', 'frequency'])}<h3>Variants</h3>{grid(m['topVariants'], ['count', 'share', 'trace'])}<h3>Rework</h3>{grid(m['rework'], ['activity', 'reworkRate', 'firstTimeRight'])}<h3>Controls</h3><p>Fitness {e(m['conformance']['fitness'])}</p>{grid(m['conformance']['byRule'], ['rule', 'violations', 'cases'])}<h3>Examples</h3>{grid(m['conformance']['examples'], ['rule', 'case_id', 'detail'])}",
        f"<h2>Control charts</h2>{chart(s['breachRate'], 'Weekly share of breaches')}{chart(s['handlingHours'], 'Weekly mean hours')}{grid([s['capability']], list(s['capability']))}",
        f"<h2>Turnaround</h2>{curve}<p>Median: {e(t['medianKaplanMeier'])} h with open cases, {e(t['medianClosedOnly'])} h of closed ones alone.</p>{grid(coef, ['covariate', 'coefficient', 'error', 'low', 'high', 'p'])}{forest}<p>Targets in hours: {e(', '.join(f'{x:g}' for x in targets))}. {e(t['open'])} of {e(t['cases'])} cases are open.</p><p>Concordance {e(fit['concordance'])} over {e(fit['comparablePairs'])} pairs.</p>{note}",
        f"<h2>Model findings</h2><p>{e(', '.join(f'{n} {k}' for k, n in counts.items()))}</p>{grid(findings, ['code', 'severity', 'object', 'line', 'message', 'remedy'])}</body></html>",
    ]
    return "\n".join(parts)


def session(name: str = "tidemark") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
