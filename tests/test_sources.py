import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as cli
from tidemark.operators import cox, design, lint
from tidemark.plans import render
from tidemark.sources import eventcsv, synth, tabular
from tidemark.streaming import live

EVENTS = "case_id,activity,timestamp,resource,team\n1,B,2026-03-02 9:00:05,ann,x\n1,A,2026-03-02T09:00:05,,\n2,A,2026-03-02 10:30,bob,y\n2,B,2026-3-3,bob,y\n"
CASES = "case_id,arrived,duration_hours,resolved,sla_hours,priority\n1,2026-03-02 09:00:00,10.5,1,40,Urgent\n2,2026-03-02,50,no,40,Standard\n"


def test_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text(EVENTS)
    (tmp_path / "c.csv").write_text(CASES)
    e = eventcsv.read_events(spark, str(tmp_path / "e.csv"))
    rows = e.orderBy("ts", "seq").collect()
    assert [r.activity for r in rows] == ["B", "A", "A", "B"] and rows[1].resource == "" and rows[0].ts == dt.datetime(2026, 3, 2, 9, 0, 5)
    c = eventcsv.read_cases(spark, str(tmp_path / "c.csv"))
    assert [(r.case_id, r.resolved) for r in c.orderBy("case_id").collect()] == [("1", True), ("2", False)]
    eventcsv.write_cases(c, str(tmp_path / "out"))
    assert eventcsv.read_cases(spark, str(tmp_path / "out")).orderBy("case_id").collect() == c.orderBy("case_id").collect()
    eventcsv.write_events(e, str(tmp_path / "oute"))
    assert eventcsv.read_events(spark, str(tmp_path / "oute")).count() == 4
    (tmp_path / "bad.csv").write_text("case_id,activity\n1,A\n")
    with pytest.raises(ValueError, match="timestamp"):
        eventcsv.read_events(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "odd.csv").write_text("case_id,activity,timestamp\n1,A,yesterday\n")
    with pytest.raises(Exception, match="unrecognised timestamp"):
        eventcsv.read_events(spark, str(tmp_path / "odd.csv")).collect()


@pytest.fixture(scope="module")
def drawn(spark):
    e, c = synth.simulate(spark, synth.SynthConfig(cases=1200, seed=7))
    return e.persist(), c.persist()


def test_synth(spark, drawn):
    e, c = drawn
    again = synth.simulate(spark, synth.SynthConfig(cases=1200, seed=7))[1]
    assert again.orderBy("case_id").collect() == c.orderBy("case_id").collect()
    open_ = c.where("NOT resolved").count() / c.count()
    assert 0.02 < open_ < 0.3
    assert e.join(c, "case_id", "left_anti").count() == 0
    assert e.where("ts > '2026-06-30 17:00:00'").count() == 0
    with pytest.raises(ValueError):
        synth.simulate(spark, synth.SynthConfig(cases=0))


def test_true_coefficients_are_recovered(spark, drawn):
    _, c = drawn
    m = design.design_matrix(c.withColumns({"duration": F.col("duration_hours"), "event": F.col("resolved").cast("int")}), ["complexity", "backlog_index", "awaiting_third_party"], {"priority": "Urgent", "channel": "Post"})
    fit = cox.fit_cox(m.frame, m.names)
    for name, b, se in zip(fit.names, fit.beta, fit.std_error):
        assert abs(b - synth.TRUE_BETA[name]) < 3.5 * se, name


BIM = {"name": "M", "model": {"tables": [
    {"name": "Sales", "columns": [{"name": "SalesID", "dataType": "int64", "summarizeBy": "sum"}, {"name": "Amount", "dataType": "double"}, {"name": "Total", "expression": ["SUM(", "Sales[Amount])"]}],
     "measures": [{"name": "Rate", "expression": "SUM(Sales[Amount]) / COUNT([SalesID]) // FILTER(Sales, 1)"}, {"name": "Whole", "expression": "CALCULATE([Rate], FILTER('Sales', [Amount] > 1), Sales[Rate])"}]}]}}


def test_lint(spark, tmp_path):
    p = tmp_path / "m.bim"
    p.write_text(json.dumps(BIM))
    found = lint.lint(tabular.load_model(spark, str(p))).collect()
    codes = {(f.code, f.object) for f in found}
    assert {("MOD007", "Sales[SalesID]"), ("MOD006", "Sales[Amount]"), ("MOD012", "Sales[Total]"), ("DAX001", "Sales[Rate]"), ("DAX002", "Sales[Rate]"), ("DAX004", "Sales[Whole]"), ("DAX003", "Sales[Whole]")} <= codes
    assert ("DAX004", "Sales[Rate]") not in codes
    assert found[0].severity == "error" and {f.code for f in lint.lint(tabular.load_model(spark, str(p)), select=["dax001"]).collect()} == {"DAX001"}
    many = tabular.load_models(spark, str(p))
    assert lint.lint(many).count() == len(found)


def test_every_rule_fires_on_the_sample(spark):
    from tidemark.plans.sample_model import sample

    found = lint.lint(sample(spark)).collect()
    assert {f.code for f in found} == set(lint.SEVERITY)
    assert [f.object for f in found if f.code == "MOD011"] == ["Orders[Average Price]"]
    assert all(f.severity == lint.SEVERITY[f.code] for f in found)


def test_sample_files(spark, tmp_path):
    from tidemark.sources import samples

    got = samples.paths(spark, str(tmp_path), cases=30)
    assert samples.paths(spark, str(tmp_path)) == got
    assert eventcsv.read_events(spark, got["events"]).select("case_id").distinct().count() == eventcsv.read_cases(spark, got["cases"]).count() > 20
    assert tabular.load_model(spark, got["model"])["measures"].count() == 11


def test_tokens():
    t = lint.tokenize("VAR x = 1.5e3 /* a\nb */ RETURN 'It''s'[Col] <> \"q\"\"\" -- end")
    assert [(k, v) for k, _, v, _, _ in t] == [("identifier", "VAR"), ("identifier", "x"), ("operator", "="), ("number", "1.5e3"), ("identifier", "RETURN"), ("quoted", "It's"), ("bracket", "Col"), ("operator", "<>"), ("string", 'q"')]
    assert t[5][3:] == (2, 13) and lint.tokenize("a ? b")[1][0] == "operator"


def test_many_tmdl_folders(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.tmdl").write_text("table A\n\tmeasure Rate = SUM(A[X]) / 2\n\tpartition p = m\n\t\tmode: import\n\tcolumn X\n\t\tdataType: double\n\t\tisHidden\n")
        (tmp_path / name / "b.tmdl").write_text("table B\n\tdataCategory: Time\n\tmeasure Other =\n\t\tVAR x = 1\n\t\tRETURN x\n\t\tdisplayFolder: F\n")
    many, one = tabular.load_models(spark, str(tmp_path / "*" / "*.tmdl")), tabular.load_model(spark, str(tmp_path / "one"))
    for kind in tabular.SCHEMAS:
        rows = lambda d: sorted(map(tuple, d.collect()))
        assert rows(many[kind].where("model = 'one'")) == rows(one[kind])
    assert one["measures"].where("name = 'Other'").first().expression == "VAR x = 1\nRETURN x"
    assert [(r.table, r.mode, r.date_table) for r in one["tables"].orderBy("table").collect()] == [("A", "import", False), ("B", "", True)]
    assert lint.lint(many).where("code = 'DAX001'").count() == 2 and all(r.remedy for r in lint.lint(one).collect())


def test_tmdl(spark, tmp_path):
    (tmp_path / "t.tmdl").write_text("/// about\ntable Cases\n\tcolumn 'Case ID'\n\t\tdataType: int64\n\t\tsummarizeBy: sum\n\t\tisKey\n\n\tmeasure 'It''s Rate' =\n\t\t\tDIVIDE(1,\n\t\t\t2)\n\t\tformatString: 0.0\n\nrelationship abc\n\tfromColumn: Cases.'Case ID'\n\ttoColumn: Other.ID\n\tisActive: false\n")
    m = tabular.load_model(spark, str(tmp_path))
    c, s, r = m["columns"].first(), m["measures"].first(), m["relationships"].first()
    assert (c.name, c.key, c.summarize_by) == ("Case ID", True, "sum") and (s.name, s.expression, s.format_string) == ("It's Rate", "DIVIDE(1,\n2)", "0.0")
    assert (r.from_column, r.to_table, r.active) == ("Case ID", "Other", False)
    with pytest.raises(ValueError):
        tabular.load_model(spark, "model.txt")


def test_maps(spark, drawn):
    import xml.etree.ElementTree as ET

    g = render.collect_map(drawn[0])
    ET.fromstring(render.to_svg(g, 5))
    assert render.to_dot(g).startswith("digraph") and render.to_mermaid(g).startswith("flowchart")
    level, back = render.layers(g), render.back_edges(g)
    assert all(level[s] < level[t] for s, t in g.edges if (s, t) not in back)


def test_command_line(spark, drawn, tmp_path, capsys):
    out = str(tmp_path)
    e, c = drawn
    eventcsv.write_events(e, out + "/e")
    eventcsv.write_cases(c, out + "/c")
    assert cli.main(["mine", "--events", out + "/e", "--out", out + "/m"]) == 0
    assert cli.main(["spc", "--cases", out + "/c", "--out", out + "/s"]) == 0
    assert cli.main(["sla", "--cases", out + "/c", "--group", "priority", "--numeric", "complexity", "--binary", "channel=Post", "--out", out + "/l"]) == 0
    text = capsys.readouterr().out
    assert "concordance" in text and "log-rank" in text and (tmp_path / "m/process_map.svg").exists() and (tmp_path / "s/spc_breach_rate.csv").exists()
    (tmp_path / "m.bim").write_text(json.dumps(BIM))
    assert cli.main(["daxlint", out + "/m.bim"]) == 1 and cli.main(["daxlint", out + "/m.bim", "--fail-on", "never"]) == 0
    assert cli.main(["mine", "--events", out + "/e", "--top", "3"]) == 0
    assert cli.main(["daxlint", out + "/none.txt"]) == 2
    assert cli.main(["try", "--events", out + "/e", "--cases", out + "/c", "--model", out + "/m.bim", "--out", out + "/t"]) == 0
    assert "<svg" in (tmp_path / "t/report.html").read_text()
    assert cli.main(["export", "--events", out + "/e", "--cases", out + "/c", "--out", out + "/x.js"]) == 0
    assert (tmp_path / "x.js").read_text().startswith("window.")


def test_streams_match_batch(spark, tmp_path):
    from tidemark.operators import mining

    rows = [(str(i % 5), "ab"[i % 3 == 0], dt.datetime(2026, 3, 2) + dt.timedelta(hours=i), "", i) for i in range(60)]
    shape = "case_id string, activity string, ts timestamp_ntz, resource string, seq long"
    batch = spark.createDataFrame(rows, shape)
    order = [1, 0, 2]  # the second twenty events come first: late, but within the delay
    for k in order:
        batch.where((F.col("seq") >= 20 * k) & (F.col("seq") < 20 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([("z", "a", dt.datetime(2026, 4, 2), "", 60)], shape)
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all others
    stream = live.read_stream(spark, str(tmp_path / "in"), batch.schema)
    q = live.transitions(stream, "100 hours").writeStream.format("memory").queryName("moves").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("moves").groupBy("source", "target").agg(F.count("*").alias("frequency"), F.round(F.sum("hours"), 6).alias("h")).orderBy("source", "target").collect()
    want = mining.edges(batch).select("source", "target", "frequency", F.round("total_hours", 6).alias("h")).orderBy("source", "target").collect()
    assert got == want
    q = live.period_counts(live.read_stream(spark, str(tmp_path / "in"), batch.schema), "a").writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("days").collect()) == 61


def test_csv_records_over_splits(spark, tmp_path):
    """A file cut into many splits, inside quoted line breaks too, reads as it does whole, in order."""
    import random

    from tidemark.sources import eventcsv

    g = random.Random(3)
    texts = ["plain", "two\nlines", 'a ""quoted"" word', "", "comma, and\n\nblank\nlines, many", "é日本", "\n", "x" * 300 + "\n" + "y" * 500]
    for k, end in enumerate(("\n", "\r\n")):
        lines = ["\ufeffcase_id,activity,timestamp,resource,note"]
        for i in range(300):
            t = g.choice(texts)
            lines.append(f'{i},act{i % 3},2026-03-02 10:{i % 60:02d}:00,r{i % 5},' + (f'"{t}"' if g.random() < 0.8 or set(t) & set('",\n') else t))
            if g.random() < 0.05:
                lines.append("")
        (tmp_path / f"e{k}.csv").write_bytes((end.join(lines) + end).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        path = str(tmp_path / "*.csv")
        got = eventcsv.read_events(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        rows = [(r.case_id, r.activity, r.resource, r.note) for r in got.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for k in (0, 1):
        one = spark.read.csv(str(tmp_path / f"e{k}.csv"), header=True, multiLine=True, escape='"')
        want += [(r[0], r[1], r[3], r[4] or "") for r in one.collect()]
    norm = lambda rows: [tuple(x.replace("\r\n", "\n") for x in r) for r in rows]
    assert len(rows) == 600 and norm(rows) == norm(want)
    assert len({r.seq for r in got.select("seq").collect()}) == 600


def test_model_lookups(spark):
    from tidemark.plans.sample_model import sample

    m = sample(spark)
    first = m["measures"].orderBy("ordinal").first()
    assert tabular.table(m, first.table.upper()).first().table == first.table and tabular.table(m, "no such table").count() == 0
    assert [r.ordinal for r in tabular.measures(m).collect()] == sorted(r.ordinal for r in m["measures"].collect())
    assert {r.table for r in tabular.columns(m, first.table.lower()).collect()} == {first.table}
    assert first.name.lower() in {r.name for r in tabular.measure_names(m).collect()}
    assert tabular.column_names(m).count() <= m["columns"].count()
    assert tabular.auto_date_tables(m).count() == m["tables"].where("auto_date").count()
