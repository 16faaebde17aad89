import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import capability, charts, concordance, conformance, cox, design, eventlog, gage, mining, nelson, survival

ROWS = [
    (1, "Receive", 9, "alice"), (1, "Assess", 10, "bob"), (1, "Check", 11, "carol"),
    (2, "Receive", 9, "alice"), (2, "Assess", 12, "bob"), (2, "Check", 13, "carol"),
    (3, "Receive", 9, "dave"), (3, "Assess", 10, "dave"), (3, "Rework", 11, "dave"), (3, "Assess", 12, "dave"), (3, "Check", 13, "dave"),
]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(str(c), a, dt.datetime(2026, 3, 2, h), r, i) for i, (c, a, h, r) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "case_id string, activity string, ts timestamp_ntz, resource string, seq long")


def test_mining(log):
    n = {r.activity: r for r in mining.nodes(log).collect()}
    assert (n["Assess"].frequency, n["Assess"].case_frequency) == (4, 3)
    e = {(r.source, r.target): r for r in mining.edges(log).collect()}
    assert e["Receive", "Assess"].frequency == 3 and e["Receive", "Assess"].total_hours == pytest.approx(5.0)
    v = mining.variants(log).collect()
    assert [(r["count"], r.length) for r in v] == [(2, 3), (1, 5)]
    assert sorted((len(r.trace), r.case_id) for r in mining.variant_cases(log).collect()) == [(3, "1"), (3, "2"), (5, "3")]
    assert [r.case_ids for r in mining.variants(log, with_cases=True).collect()] == [["1", "2"], ["3"]]
    assert [round(r.coverage, 4) for r in mining.variant_coverage(log).orderBy("rank").collect()] == [0.6667, 1.0]
    w = {r.activity: r for r in mining.rework(log).collect()}
    assert (w["Assess"].cases, w["Assess"].rework_cases) == (3, 1)
    h = {(r.source, r.target): r["count"] for r in mining.handovers(log).collect()}
    assert h["alice", "bob"] == 2 and ("dave", "dave") not in h
    assert {r["count"] for r in mining.handovers(log, True).where("source = 'dave'").collect()} == {4}


def test_ties_follow_seq(spark):
    t = dt.datetime(2026, 3, 2, 9)
    log = spark.createDataFrame([("1", a, t, "", i) for i, a in enumerate("cab")], "case_id string, activity string, ts timestamp_ntz, resource string, seq long")
    assert eventlog.traces(log).first().trace == ["c", "a", "b"]
    assert mining.handovers(log).count() == 0


def test_conformance(log):
    found = conformance.violations(log, [conformance.FourEyes(("Assess",), "Check"), conformance.MaxOccurrences("Rework", 0), conformance.Ordering("Rework", "Check"), conformance.RequiredActivities(("Rework", "Nothing"))])
    assert [(r.case_id, r.detail) for r in found.where("rule = 'FOUR_EYES'").collect()] == [("3", "dave both performed 'Assess' and checked it")]
    assert {r.case_id for r in found.where("rule = 'ORDERING'").collect()} == {"1", "2"}
    assert {r.case_id: r.detail for r in found.where("rule = 'REQUIRED'").collect()}["3"] == "missing Nothing"
    assert conformance.fitness(log, found).first().fitness == 0.0
    own = conformance.CustomRule(lambda pdf: ["long"] if len(pdf) > 3 else [])
    assert [r.case_id for r in own.violations(log).collect()] == ["3"]
    none = conformance.violations(log, [])
    assert none.count() == 0 and conformance.fitness(log, none).first().fitness == 1.0
    assert conformance.fitness(log.where("false"), none).first().fitness == 1.0


def test_breach_is_three_valued(spark):
    df = spark.createDataFrame([(10.0, False, 40.0), (50.0, False, 40.0), (10.0, True, 40.0)], "duration_hours double, resolved boolean, sla_hours double")
    assert [r.b for r in df.select(eventlog.breached().alias("b")).collect()] == [None, True, False]


def series(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")


def test_charts(spark):
    r = charts.individuals(series(spark, [10, 12, 10, 12, 10, 12]), "v", "i").first()
    assert r.center == 11 and r.sigma == pytest.approx(2 / 1.128)
    r = charts.moving_range(series(spark, [10, 12, 10, 12]), "v", "i").first()
    assert (r.center, r.lcl) == (2, 0) and r.ucl == pytest.approx(6.534)
    d = spark.createDataFrame([(0, 2, 50), (1, 8, 50)], "i int, c int, n int")
    assert charts.p_chart(d, "c", "n", "i").first().center == pytest.approx(0.1)
    with pytest.raises(ValueError):
        charts.p_chart(spark.createDataFrame([(0, 9, 5), (1, 1, 5)], "i int, c int, n int"), "c", "n", "i")
    g = spark.createDataFrame([(i // 2, float(v)) for i, v in enumerate([10, 12, 11, 13, 9, 11])], "g int, v double")
    r = charts.xbar_r(g, "v", "g").first()
    assert r.ucl - r.center == pytest.approx(3.76)
    assert charts.c_chart(series(spark, [4, 4, 4, 4]), "v", "i").first().sigma == 2


NELSON = {
    1: ([0, 0, 3.1], [0, 0, 3.0]), 2: ([0.1] * 9, [0.1] * 8), 3: ([1, 2, 3, 4, 5, 6], [1, 2, 3, 3, 4, 5]), 4: ([0.5, -0.5] * 7, [0.5, -0.5] * 6),
    5: ([2.1, 0, 2.2], [2.1, -2.1, 2.2]), 6: ([1.1, 1.2, 0, 1.3, 1.4], [1.1, -1.2, 1.2, 1.3, 1.4]), 7: ([0.0] * 15, [0.0] * 14), 8: ([1.5, -1.5] * 4, [1.5] * 8),
}


@pytest.mark.parametrize("rule", range(1, 9))
def test_nelson(spark, rule):
    for values, hit in zip(NELSON[rule], (True, False)):
        got = nelson.flags(series(spark, values), "v", "i", [rule]).orderBy("i").collect()
        assert [bool(r.violations) for r in got] == [False] * (len(values) - 1) + [hit]


def test_expand(spark):
    f = nelson.flags(series(spark, [0.1] * 9), "v", "i", [2])
    assert all(r.violations == ["NELSON_2"] for r in nelson.expand(f, "i").collect())


def test_capability(spark):
    c = capability.capability(series(spark, [8, 12] * 8), "v", ["i"], 0.0, 20.0, 10.0)
    assert c.cp == pytest.approx(20 / (6 * 4 / 1.128)) and c.cpm is not None
    one = capability.capability(series(spark, [8, 12] * 8), "v", ["i"], usl=20.0)
    assert one.cp is None and one.notes
    assert capability.sigma_level(3.4) == pytest.approx(6.0, abs=0.01) and capability.sigma_level(0) == 7.5 and capability.sigma_level(1e6) == 0.0
    for bad in (dict(), dict(lsl=3.0, usl=2.0)):
        with pytest.raises(ValueError):
            capability.capability(series(spark, [1, 2, 3]), "v", ["i"], **bad)
    with pytest.raises(ValueError):
        capability.capability(series(spark, [1, 1, 1]), "v", ["i"], usl=2.0)


def test_gage(spark):
    rows = [(str(p), str(o), 10.0 + 2 * p + 0.1 * o + s) for p in range(5) for o in range(3) for s in (-0.5, 0.5)]
    r = gage.gage_rr(spark.createDataFrame(rows, "p string, o string, v double"), "p", "o", "v")
    assert r.var_repeatability == pytest.approx(0.5) and r.var_part > 5 and r.distinct_categories >= 4
    with pytest.raises(ValueError):
        gage.gage_rr(spark.createDataFrame(rows[:-1], "p string, o string, v double"), "p", "o", "v")


def obs(spark, d, e, **x):
    names = list(x)
    return spark.createDataFrame([(float(a), int(b), *[float(x[n][i]) for n in names]) for i, (a, b) in enumerate(zip(d, e))], "duration double, event int" + "".join(f", {n} double" for n in names))


def test_kaplan_meier(spark):
    k = survival.kaplan_meier(obs(spark, [1, 2, 3, 4, 5], [1, 0, 1, 1, 0])).orderBy("time").collect()
    assert [round(r.survival, 4) for r in k] == [0.8, 0.8, 0.5333, 0.2667, 0.2667] and [r.at_risk for r in k] == [5, 4, 3, 2, 1]
    c = survival.kaplan_meier(obs(spark, [1, 2, 3, 4], [1] * 4))
    assert survival.survival_at(c, 0.5) == 1.0 and survival.survival_at(c, 1) == 0.75 and survival.quantile(c) == 2.0
    assert survival.quantile(survival.kaplan_meier(obs(spark, range(1, 11), [1] + [0] * 9))) is None
    assert survival.restricted_mean(survival.kaplan_meier(obs(spark, [5, 6, 7], [0] * 3)), 4.0).first().rmst == 4.0
    n = survival.nelson_aalen(obs(spark, [1, 2, 3], [1] * 3)).orderBy("time").collect()
    assert [round(r.cumulative_hazard, 6) for r in n] == [0.333333, 0.833333, 1.833333]
    for bad in (obs(spark, [-1], [1]), obs(spark, [1], [2]), obs(spark, [1], [1]).where("false")):
        with pytest.raises(ValueError):
            survival.check(bad)


def test_logrank(spark):
    same = obs(spark, [1, 2, 3] * 2, [1] * 6, g=[0, 0, 0, 1, 1, 1])
    assert survival.logrank(same, "g").p_value == pytest.approx(1.0)
    apart = obs(spark, list(range(1, 21)) + list(range(101, 121)), [1] * 40, g=[0] * 20 + [1] * 20)
    assert survival.logrank(apart, "g").p_value < 1e-6


TOY = dict(d=[6, 7, 10, 15, 19, 25, 3, 4, 8, 12], e=[1, 1, 1, 0, 1, 0, 1, 1, 1, 1], x=[0] * 6 + [1] * 4)


def test_cox_derivatives_and_fit(spark):
    o = obs(spark, TOY["d"], TOY["e"], x=TOY["x"])
    at = lambda b: cox.likelihood(o, ["x"], [b]).first()
    h, r = 1e-4, at(0.37)
    assert r.g0 == pytest.approx((at(0.37 + h).ll - at(0.37 - h).ll) / (2 * h), abs=1e-5)
    assert r.h0_0 == pytest.approx((at(0.37 + h).g0 - at(0.37 - h).g0) / (2 * h), abs=1e-5)
    m = cox.fit_cox(o, ["x"], prefix="")
    assert abs(at(m.beta[0]).g0) < 1e-6 and m.converged and m.events == 8
    with pytest.raises(ValueError, match="collinear"):
        cox.fit_cox(obs(spark, TOY["d"], TOY["e"], x=TOY["x"], y=[2 * v for v in TOY["x"]]), ["x", "y"], prefix="")
    with pytest.raises(ValueError, match="no events"):
        cox.fit_cox(obs(spark, TOY["d"], [0] * 10, x=TOY["x"]), ["x"], prefix="")


def test_cached_evaluation_equals_frames(spark):
    """Blocks, ranges and ties cut anywhere: one duration holds a third of the cases, with events among them."""
    g = random.Random(6)
    rows = [(float(g.randrange(12)) if g.random() < 0.67 else 5.0, int(g.random() < 0.6), g.gauss(0, 1), g.gauss(3, 1)) for _ in range(400)]
    o = spark.createDataFrame(rows, "duration double, event int, a double, b double").repartition(3)
    for block, size in ((1 << 16, 1 << 20), (7, 1 << 20), (1000, 40), (5, 33)):
        blocks = cox.RiskBlocks(o, ["a", "b"], block=block, rows=size)
        for beta in ([0.0, 0.0], [0.4, -0.3]):
            ll, grad, h = blocks.at(beta)
            r = cox.likelihood(o, ["a", "b"], beta, centre=blocks.centre).first()
            assert (ll, *grad, h[0, 0], h[0, 1], h[1, 1]) == pytest.approx((r.ll, r.g0, r.g1, r.h0_0, r.h0_1, r.h1_1), rel=1e-9)
        blocks.close()


def test_exact_quantiles_by_refinement(spark):
    from tidemark.functions.quantiles import exact_quantiles

    g = random.Random(8)
    rows = [("a", g.expovariate(1e-3)) for _ in range(700)] + [("ties", float(g.randrange(3))) for _ in range(500)] + [("one", 4.0), ("none", None), (None, -1.0), (None, 2.5)]
    rows += [("wide", 10.0 ** g.uniform(-200, 200) * g.choice((-1, 1))) for _ in range(300)] + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    qs = (0.0, 0.1, 0.5, 0.9, 1.0)
    for limit, buckets in ((100_000, 1024), (20, 64), (0, 256)):
        got = {r.k: [r[f"q{i}"] for i in range(len(qs))] for r in exact_quantiles(df, ["k"], "v", qs, limit, buckets).collect()}
        assert set(got) == {"a", "ties", "one", None, "wide", "two"}
        for k, x in got.items():
            assert x == pytest.approx([stats.quantile([v for a, v in rows if a == k], q) for q in qs], rel=1e-12)
    assert exact_quantiles(df.where("false"), ["k"], "v", qs).count() == 0


def naive_concordance(d, e, r):
    good = pairs = 0
    for i in range(len(d)):
        for j in range(len(d)):
            if i != j and e[i] and (d[j] > d[i] or (d[j] == d[i] and not e[j])):
                pairs += 1
                good += 1 if r[i] > r[j] else 0.5 if r[i] == r[j] else 0
    return good, pairs


def test_concordance(spark):
    g = random.Random(3)
    d, e, r = [g.randrange(30) for _ in range(300)], [g.randrange(2) for _ in range(300)], [g.randrange(12) for _ in range(300)]
    o = obs(spark, d, e, risk=r)
    for f in (concordance.by_join, concordance.by_blocks, lambda x: concordance.by_blocks(x, rows=20)):
        got = f(o).first()
        assert (got.concordant, got.pairs) == naive_concordance(d, e, r)
    none = concordance.concordance(obs(spark, [1, 2], [0, 0], risk=[1, 2])).first()
    assert (none.c_index, none.pairs) == (0.5, 0)


def test_design(spark):
    df = spark.createDataFrame([("1", "Urgent", "Post", "0.5"), ("2", "Standard", "Phone", "1.5"), ("3", None, "Web Site", "2")], "case_id string, priority string, channel string, complexity string")
    m = design.design_matrix(df, ["complexity"], {"priority": "Urgent"}, ["channel"])
    assert m.names == ["complexity", "priority_urgent", "channel_post", "channel_web_site"] and m.references == {"channel": "Phone"}
    assert [tuple(r)[4:] for r in m.frame.orderBy("case_id").collect()] == [(0.5, 1, 1, 0), (1.5, 0, 0, 0), (2.0, 0, 0, 1)]
    with pytest.raises(Exception, match="not a number"):
        design.design_matrix(df, ["channel"]).frame.collect()


def test_scalars():
    assert stats.normal_cdf(1.959963984540054) == pytest.approx(0.975) and stats.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    for x, df in ((3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3), (18.307038053275146, 10)):
        assert stats.chi2_sf(x, df) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(0, 3) == 1.0 and stats.quantile([1, 2, 3, 4], 0.5) == 2.5
    with pytest.raises(ValueError):
        stats.solve([[1, 2], [2, 4]], [1, 1])
    assert np.allclose(stats.inverse([[2, 0], [0, 4]]), [[0.5, 0], [0, 0.25]]) and math.isclose(stats.mean([0.1] * 10), 0.1)


def test_running_sums_over_ranges(spark, monkeypatch):
    """Equal to those of one block, in ranges of even size however the keys are packed; text keys too."""
    from tidemark.functions import ordered

    df = spark.range(2000).select((F.col("id") / 1e9).alias("t"), F.lit(1).alias("n"), F.format_string("k%05d", "id").alias("s"))
    for order in ("t", "s"):
        a = ordered.cumulative(df, order, {"x": F.col("n")}, descending=True).orderBy(order).collect()
        monkeypatch.setattr(ordered, "ROWS", 100)
        at = ordered.lay_out(df, order)
        b = at.running({"x": F.col("n")}, descending=True).plain().orderBy(order).collect()
        monkeypatch.undo()
        assert [r.x for r in a] == [r.x for r in b] == list(range(2000, 0, -1))
        sizes = [r["count"] for r in at.frame.groupBy("_blk").count().collect()]
        assert at.blocks == 20 and max(sizes) <= 2 * 2000 / 20
    ordered.release()


def test_series_in_blocks_equal_one_block(spark, monkeypatch):
    """Charts, run rules and capability cut into many blocks (with ties at cuts) give what one block gives."""
    import random

    from tidemark.functions import ordered

    g = random.Random(4)
    rows, level = [], 0.0
    for i in range(400):
        level = 0.8 * level + g.gauss(0, 1)
        rows.append((i // 5, i, level if i % 60 > 20 else abs(level) + 1.5))
    df = spark.createDataFrame(rows, "g long, i long, v double")

    def every():
        x = charts.to_rows(charts.individuals(df, "v", "i")).collect()
        r = charts.to_rows(charts.moving_range(df, "v", "i")).collect()
        wide = nelson.expand(charts.xbar_r(df, "v", "g"), "index").orderBy("index").collect()
        return x, r, wide, capability.core(df, "v", ["i"], -2.0, 2.0).collect(), charts.to_text(charts.individuals(df, "v", "i"), "values")

    whole = every()
    monkeypatch.setattr(ordered, "ROWS", 9)
    cut = every()
    assert any(r.violations for r in whole[0]) and "X" in whole[4]
    for a, b in zip(whole, cut):
        assert a == pytest.approx(b, nan_ok=True) if isinstance(a, list) and a and isinstance(a[0], float) else [[round(x, 9) if isinstance(x, float) else x for x in r] for r in a] == [[round(x, 9) if isinstance(x, float) else x for x in r] for r in b]


def test_no_window_holds_all_durations(spark, monkeypatch):
    """No plan orders all of many distinct durations in one task: windows without keys run on sums of ranges alone."""
    import io
    from contextlib import redirect_stdout

    from tidemark.functions import ordered

    monkeypatch.setattr(ordered, "ROWS", 20)
    obs = spark.createDataFrame([(float(i) * 1.7, i % 3 > 0, i % 2, float(i % 7)) for i in range(200)], "duration double, e boolean, g int, x double").withColumn("event", F.col("e").cast("int"))
    frames = [survival.kaplan_meier(obs), survival.restricted_mean(survival.kaplan_meier(obs), 100.0), survival.nelson_aalen(obs), survival.logrank_core(obs, "g"), cox.likelihood(obs, ["x"], [0.1]), cox.baseline(obs, ["x"], [0.1])]
    for f in frames:
        text = io.StringIO()
        with redirect_stdout(text):
            f.explain()
        for line in text.getvalue().splitlines():
            if "Window [" in line:
                keys = line[line.index("windowspecdefinition(") :]
                assert keys.split("windowspecdefinition(")[1].startswith(("_blk#", "_kb#")) or "_blk#" in line.split("], [")[-1], line


def test_published_figures():
    """Figures of a published sample: sigma level of its DPMO, and the third week of its breach chart."""
    assert capability.sigma_level(332352.9) == pytest.approx(1.933, abs=5e-4)
    p, n, bad = 0.36858, 35, 1
    assert (bad / n - p) / (p * (1 - p) / n) ** 0.5 == pytest.approx(-4.1696, abs=1e-3)


def test_concordance_blocks_equal_all_pairs(spark):
    import random

    from tidemark.operators import concordance

    g = random.Random(2)
    for n, times in ((1, 3), (60, 5), (200, 1000), (150, 1)):
        obs = spark.createDataFrame([(float(g.randrange(times)), g.randrange(2), round(g.gauss(0, 1), 1)) for _ in range(n)], "duration double, event int, risk double")
        want = concordance.by_join(obs).first()
        assert [concordance.by_blocks(obs, rows=r).first() for r in (None, 7, 50)] == [want] * 3
    # one duration and one risk hold most cases
    rows = [(5.0 if g.random() < 0.6 else float(g.randrange(12)), g.randrange(2), 1.0 if g.random() < 0.4 else g.gauss(0, 1)) for _ in range(300)]
    obs = spark.createDataFrame(rows, "duration double, event int, risk double")
    assert [concordance.by_blocks(obs, rows=r).first() for r in (10, 60)] == [concordance.by_join(obs).first()] * 2
    # unrounded risks in a narrow band
    rows = [(float(g.randrange(300)), g.randrange(2), g.gauss(0, 1e-3)) for _ in range(2000)]
    obs = spark.createDataFrame(rows, "duration double, event int, risk double")
    assert concordance.by_blocks(obs, rows=100).first() == concordance.by_join(obs).first()


def test_column_forms_of_the_normal_law(spark):
    from tidemark.functions import stats

    df = spark.createDataFrame([(-1.96,), (0.0,), (None,)], "x double")
    got = [r[0] for r in df.select(stats.normal_cdf_column("x")).collect()]
    assert got[:2] == [stats.normal_cdf(-1.96), 0.5] and got[2] is None


def test_scored_curve_quantile_and_text(spark):
    obs = spark.createDataFrame([(float(i % 37 + 1), int(i % 4 > 0), float(i % 5)) for i in range(300)], "duration double, event int, x_a double")
    model = cox.fit_cox(obs, ["a"])
    q = cox.curve_quantile(model, {"a": 2.0}, 0.5)
    curve = {r.time: r.survival for r in cox.survival_curve(model, {"a": 2.0}).collect()}
    assert q == min(t for t, s in curve.items() if s <= 0.5)
    assert "a " in model.to_text() and "300 cases" in model.to_text()
    assert survival.curve_rows(survival.kaplan_meier(obs)).columns == ["time", "at_risk", "events", "survival", "std_error", "lower", "upper"]


@pytest.mark.parametrize("rows", [None, 9])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_against_a_scan(spark, rows, strict):
    """One key holds half of all rows and lies over many ranges; keys and times are null or equal here and there."""
    from tidemark.operators.asof import asof_join

    g = random.Random(5)
    key = lambda: g.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), g.choice([g.randrange(40), g.randrange(40), None])) for i in range(120)] + [(7, "hot", 3), (7, "hot", 3)]
    right = [(key(), g.choice([g.randrange(40), None]), g.choice([1, 2, None])) for _ in range(60)]
    got = asof_join(spark.createDataFrame(left, "id int, k string, t int").repartition(3), spark.createDataFrame(right, "k string, t int, v int"), ("t", "t"), ["k"], strict, rows)
    assert got.columns == ["id", "k", "t", "t_right", "v"]
    want = []
    for i, k, t in left:
        ok = [(u, -1 if v is None else v) for a, u, v in right if a == k and u is not None and t is not None and (u < t if strict else u <= t)]
        u, v = max(ok, default=(None, None))
        want.append((i, k, t, u, None if v == -1 else v))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_custom_rules_get_whole_cases(spark, log, size):
    import pandas as pd

    rows = [("a", 1), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 1), ("d", 1), ("d", 2)]
    frames = [pd.DataFrame(rows[i : i + size], columns=["case_id", "x"]) for i in range(0, len(rows), size)]
    seen = list(conformance._whole_cases(iter(frames), lambda f: [f]))
    assert [tuple(r) for f in seen for r in f.itertuples(index=False)] == rows
    ids = [set(f["case_id"]) for f in seen]
    assert sum(map(len, ids)) == len(set().union(*ids)) == 4
    both = [conformance.CustomRule(lambda c: ["long", "too long"] if len(c) > 3 else []), conformance.CustomRule(lambda f: f.groupby("case_id").size().loc[lambda n: n > 3].reset_index().assign(detail="long")[["case_id", "detail"]], whole=True)]
    got = [[(r.case_id, r.detail, r.at) for r in x.violations(log).orderBy("at").collect()] for x in both]
    assert got == [[("3", "long", 0), ("3", "too long", 1)], [("3", "long", 0)]]


def test_very_many_variants_of_one_case_share_tasks(spark):
    """A common start and equal counts: ranges of variants stay even, and ranks are whole."""
    from tidemark.functions import ordered

    n = 3000
    log = spark.range(n * 4).select((F.col("id") / 4).cast("long").cast("string").alias("case_id"), F.when(F.col("id") % 4 < 3, "start").otherwise(F.concat(F.lit("x"), (F.col("id") / 4).cast("long").cast("string"))).alias("activity"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.lit("").alias("resource"), F.col("id").alias("seq"))
    before = len(ordered._stored)
    got = mining.variant_coverage(log, rows=200).orderBy("rank").collect()
    sizes = [r["count"] for r in ordered._stored[before].groupBy("_blk").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 2 * 200
    assert [r.rank for r in got] == list(range(1, n + 1)) and got[-1].coverage == pytest.approx(1.0)
    assert [r.trace for r in got] == sorted(r.trace for r in got)


def test_batches_merge_without_reading_the_first_again(spark, log, tmp_path):
    from tidemark.operators import incremental

    noon = "timestamp_ntz'2026-03-02 10:30:00'"
    a, b = (incremental.summarize(log.where(f"ts {side} {noon}")) for side in ("<", ">="))
    a.write(str(tmp_path / "a"))
    both = incremental.merge(incremental.read_summary(spark, str(tmp_path / "a")), b)
    want, key = mining.edges(log), ["source", "target"]
    rounded = lambda d: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.orderBy(*key).collect()]
    assert rounded(incremental.graph(both)) == rounded(want)
    assert {tuple(r) for r in incremental.start_end(both).collect()} == {tuple(r) for r in mining.start_end(log).collect()}
    assert both.ends.agg(F.sum("events")).first()[0] == log.count()
    with pytest.raises(Exception, match="come before"):
        incremental.merge(b, a).steps.collect()


def test_chi_square_tail_as_a_column(spark):
    xs = [0.0, 1e-8, 0.3, 1.0, 3.84, 10.0, 55.0, 300.0, 1400.0]
    df = spark.createDataFrame([(x, k) for x in xs for k in (1, 2, 3, 7, 40, 500)] + [(None, 1), (1.0, 0), (1.0, None)], "x double, k int")
    for r in df.withColumn("p", stats.chi2_sf_column("x", "k")).collect():
        if r.x is None or not r.k:
            assert r.p is None
        else:
            assert r.p == pytest.approx(stats.chi2_sf(r.x, r.k), abs=1e-10)


def test_logrank_in_strata(spark):
    g = random.Random(12)
    rows = [(g.choice(["a", "a", "a", "b", None, "c"]), float(g.randrange(25)), g.randrange(2), g.randrange(2)) for _ in range(400)] + [("lone", 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "s string, duration double, event int, g int")
    for size in (None, 12):
        got = {r.s: r for r in survival.logrank_by(df, "s", "g", rows=size).collect()}
        assert set(got) == {"a", "b", "c", None, "lone"} and got["lone"].p_value == 1.0
        for k in ("a", "b", "c", None):
            want = survival.logrank(df.where(F.col("s").eqNullSafe(k)), "g")
            assert (got[k].statistic, got[k].p_value) == pytest.approx((want.statistic, want.p_value), rel=1e-9)
