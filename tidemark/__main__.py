"""Command line: python -m tidemark {simulate,mine,spc,sla,daxlint,try,export,demo}."""

from __future__ import annotations

import argparse
import json
import os
import sys


def _save(folder: str, name: str, text: str) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text if text.endswith("\n") else text + "\n")


def _table(folder: str, name: str, df) -> None:
    os.makedirs(folder, exist_ok=True)
    df.toPandas().to_csv(os.path.join(folder, name), index=False)


def _synth(spark, args):
    from .sources.synth import SynthConfig, simulate

    events, cases = simulate(spark, SynthConfig(cases=args.cases, seed=args.seed))
    return events.persist(), cases.persist()


def simulate(spark, args):
    from .sources import eventcsv

    events, cases = _synth(spark, args)
    eventcsv.write_events(events, os.path.join(args.out, "events.csv"))
    eventcsv.write_cases(cases, os.path.join(args.out, "cases.csv"))
    print(f"{cases.count()} cases and {events.count()} events written to {args.out}")


def mine(spark, args):
    from .operators import conformance
    from .plans import render, workflows
    from .sources.eventcsv import read_events

    m = workflows.mine(read_events(spark, args.events), args.top, args.variants)
    g = m["graph"]
    print(f"{g.cases} cases, {len(g.nodes)} activities, {len(g.edges)} transitions, {m['n_variants']} variants")
    for v in m["variants"]:
        print(f"  {v['count']:5d}  {' > '.join(v['trace'])}")
    for b in m["bottlenecks"]:
        print(f"  {b['source']} > {b['target']}: {b['total_hours']:.0f} h in all, {b['mean_hours']:.1f} h each, {b['frequency']} times")
    for r in m["rework"]:
        print(f"  {r['activity']}: repeated in {100 * r['rework_rate']:.1f}% of its cases")
    print(conformance.to_text(m["fitness"], m["by_rule"]))
    if args.out:
        for name, text in (("process_map.dot", render.to_dot(g, args.min_edge_frequency)), ("process_map.mmd", render.to_mermaid(g, args.min_edge_frequency)), ("process_map.svg", render.to_svg(g, args.min_edge_frequency))):
            _save(args.out, name, text)
        _save(args.out, "variants.csv", "count,length,trace\n" + "\n".join(f'{v["count"]},{v["length"]},"{" > ".join(v["trace"])}"' for v in m["variants"]))
        _save(args.out, "conformance.txt", conformance.to_text(m["fitness"], m["by_rule"], m["examples"]))


def spc(spark, args):
    from .operators import charts
    from .plans import workflows
    from .sources.eventcsv import read_cases

    try:
        s = workflows.control(read_cases(spark, args.cases), args.sla_hours)
    except ValueError as e:
        if "two weeks" not in str(e):
            raise
        print(e)
        return 1
    for name, chart in (("breach_rate", s["breach_chart"]), ("handling_hours", s["hours_chart"])):
        rows = charts.to_rows(chart)
        print(charts.to_text(chart, name))
        if args.out:
            _table(args.out, f"spc_{name}.csv", rows)
    print(s["capability"].to_text())


def sla(spark, args):
    from pyspark.sql import functions as F

    from .operators import survival
    from .plans import workflows
    from .sources.eventcsv import read_cases

    binary = {}
    for item in args.binary or []:
        if "=" not in item:
            raise ValueError(f"--binary expects attribute=level, got {item!r}")
        k, v = item.split("=", 1)
        binary[k] = v
    t = workflows.turnaround(read_cases(spark, args.cases), [n for n in args.numeric or [] if n], binary, args.group, args.horizon, args.sla_hours)
    print(f"{t['cases']} cases, {t['open']} open")
    print(f"median: {t['median']} h with open cases, {t['median_closed']} h of closed cases alone; mean to {t['horizon']:.0f} h: {t['restricted_mean']:.1f} h")
    if args.group:
        print(f"log-rank by {args.group}: {t['logrank'].statistic:.4f}, p {t['logrank'].p_value:.6g}" if t["logrank"] else f"no log-rank test: {args.group} has not two levels")
    if t["model"]:
        print(t["model"].to_text())
        print(f"concordance {t['c_index']:.4f} over {t['pairs']} pairs; highest breach risk at {t['target']:.0f} h:")
        for r in t["ranking"].limit(10).collect():
            print(f"  {r.case_id}  {100 * r.breach_probability:.1f}%")
    if args.out:
        _table(args.out, "km_curve.csv", survival.curve_rows(t["curve"]))
        if t["model"]:
            import pandas as pd

            pd.DataFrame(t["model"].rows()).to_csv(os.path.join(args.out, "cox_coefficients.csv"), index=False)
            t["ranking"].withColumn("breach_probability", F.round("breach_probability", 6)).write.csv(os.path.join(args.out, "breach_risk.csv"), header=True, mode="overwrite")


def daxlint(spark, args):
    from .operators.lint import SEVERITY
    from .plans import workflows
    from .sources.tabular import load_model

    if args.list_rules:
        print("\n".join(f"{k}  {v}" for k, v in SEVERITY.items()))
        return 0
    found = workflows.lint_model(load_model(spark, args.model), args.select, args.ignore or ())
    print(json.dumps(found, indent=1) if args.format == "json" else "\n".join(f"{f['code']} {f['severity']:<8} {f['object']}{':%d' % f['line'] if f['line'] else ''}: {f['message']} ({f['remedy']})" for f in found))
    order = ["error", "warning", "info"]
    return int(args.fail_on != "never" and any(order.index(f["severity"]) <= order.index(args.fail_on) for f in found))


def _everything(spark, args):
    from .plans import workflows
    from .sources import eventcsv, synth
    from .sources.tabular import load_model

    if args.events and args.cases_path:
        events, cases, truth = eventcsv.read_events(spark, args.events), eventcsv.read_cases(spark, args.cases_path), None
    else:
        args.cases, args.seed = 1500, 20260828
        (events, cases), truth = _synth(spark, args), synth.TRUE_BETA
    return workflows.payload(events, cases, load_model(spark, args.model) if args.model else None, ground_truth=truth)


def export(spark, args):
    from .plans import workflows

    workflows.write_payload(_everything(spark, args), args.out)


def try_(spark, args):
    from .plans import workflows

    _save(args.out, "report.html", workflows.report(_everything(spark, args)))
    print(os.path.join(args.out, "report.html"))


def demo(spark, args):
    from .plans import workflows
    from .sources import eventcsv, synth
    from .sources.tabular import load_model

    events, cases = _synth(spark, args)
    eventcsv.write_events(events, os.path.join(args.out, "events.csv"))
    eventcsv.write_cases(cases, os.path.join(args.out, "cases.csv"))
    data = workflows.payload(events, cases, load_model(spark, args.model) if args.model else None, ground_truth=synth.TRUE_BETA)
    workflows.write_payload(data, os.path.join(args.out, "results.json"))
    _save(args.out, "report.html", workflows.report(data))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        s = sub.add_parser(name)
        for names, kw in options:
            s.add_argument(*names.split(), **kw)
        s.set_defaults(run=run)

    out, own = ("--out", {"default": ""}), [("--events", {"default": ""}), ("--cases", {"default": "", "dest": "cases_path"}), ("--model", {"default": ""})]
    made = [("--cases", {"type": int, "default": 1500}), ("--seed", {"type": int, "default": 20260828})]
    hours = ("--sla-hours", {"type": float, "dest": "sla_hours"})
    add("simulate", simulate, *made, ("--out", {"default": "out"}))
    add("mine", mine, ("--events", {"required": True}), out, ("--variants", {"type": int, "default": 8}), ("--top", {"type": int, "default": 10}), ("--min-edge-frequency", {"type": int, "default": 1, "dest": "min_edge_frequency"}))
    add("spc", spc, ("--cases", {"required": True}), out, hours)
    add("sla", sla, ("--cases", {"required": True}), out, ("--horizon", {"type": float}), ("--group", {"default": ""}), ("--numeric", {"action": "append"}), ("--binary", {"action": "append"}), hours)
    add("daxlint", daxlint, ("model", {"nargs": "?", "default": ""}), ("--format", {"choices": ("text", "json"), "default": "text"}), ("--select", {"action": "append"}), ("--ignore", {"action": "append"}), ("--fail-on", {"choices": ("error", "warning", "info", "never"), "default": "error", "dest": "fail_on"}), ("--list-rules", {"action": "store_true", "dest": "list_rules"}))
    add("try", try_, ("--out", {"default": "out/try"}), *own)
    add("export", export, ("--out", {"default": "out/results.json"}), *own)
    add("demo", demo, *made, ("--out", {"default": "out/demo"}), ("--model", {"default": ""}))
    return p


def main(argv=None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.command == "daxlint" and not (args.model or args.list_rules):
        p.error("daxlint needs a model, or --list-rules")
    from .plans.workers import reachable
    from .plans.workflows import session

    spark = session()
    reachable(spark)
    try:
        return int(args.run(spark, args) or 0)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
