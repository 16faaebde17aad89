"""Linting of tabular models: measures are tokenised once into a frame, and each rule is a query.

Frames are those of sources.tabular. tokens: model, owner_kind (measure or column), owner (ordinal),
idx, kind, text, value, line, col. Findings: model, code, severity, object, message, remedy, line.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Token kinds in the order in which they are tried.
TOKEN_PATTERNS = (
    ("comment", r"/\*.*?\*/"),
    ("comment", r"(?://|--)[^\n]*"),
    ("whitespace", r"\s+"),
    ("string", r'"(?:[^"]|"")*"'),
    ("quoted", r"'(?:[^']|'')*'"),
    ("bracket", r"\[[^\]]*\]"),
    ("number", r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"),
    ("identifier", r"[A-Za-z_][A-Za-z0-9_\.]*"),
    ("operator", r"<>|>=|<=|&&|\|\||[-+*/^=<>&]"),
    ("punctuation", r"[(),;{}]"),
)
# The names and functions by which the rules know keys, money, time and aggregates.
KEY_NAME = r"(?i)(?:^|[_\s]|(?<=[a-z]))(id|key|code|guid|number)$"
MONEY_NAME = r"(?i)(amount|value|price|cost|premium|balance|fee|charge|payment|salary|revenue)"
TIME_FUNCTIONS = r"(?i)\b(DATEADD|SAMEPERIODLASTYEAR|TOTALYTD|DATESYTD|PARALLELPERIOD)\b"
AGGREGATORS = ("SUM", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "DISTINCTCOUNT")
ITERATORS = {"SUMX": "SUM", "AVERAGEX": "AVERAGE", "MINX": "MIN", "MAXX": "MAX"}
#: What to do about a finding.
REMEDY = {
    "MOD001": "Say in the description what the measure counts and for whom.", "MOD002": "Put the measure into a display folder.", "MOD003": "Filter in one direction, and cross the other way inside the measures that need it.",
    "MOD004": "Remove the relationship, or activate it in a measure with USERELATIONSHIP.", "MOD005": "Turn automatic date tables off and relate one date table of your own.", "MOD006": "Store money as a fixed decimal number.",
    "MOD007": "Set the column's default summarisation to none.", "MOD008": "Hide the key; readers should use the attributes beside it.", "MOD009": "Mark one table as the date table, with one row for each day.",
    "MOD010": "Give the measure a format string.", "MOD011": "Keep one measure and let the others refer to it.", "MOD012": "Make it a measure: a calculated column is stored and ignores the reader's filters.",
    "DAX001": "Write DIVIDE(numerator, denominator), which allows for a zero.", "DAX002": "Name the column's table.", "DAX003": "Write the measure's name without a table.",
    "DAX004": "Filter the column, or use KEEPFILTERS, in place of the table.", "DAX005": "Handle the case that fails, for instance with DIVIDE or a test for blanks.", "DAX006": "Use the plain aggregate of the column.",
    "DAX007": "Keep the outer value in a VAR.", "DAX008": "Keep the repeated expression in a VAR.",
}
SEVERITY = {
    "MOD001": "info", "MOD002": "info", "MOD003": "warning", "MOD004": "warning", "MOD005": "warning", "MOD006": "warning", "MOD007": "error", "MOD008": "info", "MOD009": "error", "MOD010": "info",
    "MOD011": "warning", "MOD012": "warning", "DAX001": "warning", "DAX002": "warning", "DAX003": "info", "DAX004": "warning", "DAX005": "warning", "DAX006": "info", "DAX007": "info", "DAX008": "info",
}
_SCAN = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p) in enumerate(TOKEN_PATTERNS)) + "|(?P<k99>.)", re.S)
_KIND = {f"k{i}": k for i, (k, _) in enumerate(TOKEN_PATTERNS)} | {"k99": "operator"}
_BARE = {"bracket": None, "quoted": ("''", "'"), "string": ('""', '"')}


def tokenize(expression: str, keep_trivia: bool = False):
    """Tuples (kind, text, value, line, col), positions from 1."""
    out, line, start = [], 1, 0
    # `.` in a line comment or number never spans lines; only block comments need re.S, and take the least
    for m in _SCAN.finditer(expression):
        kind, text = _KIND[m.lastgroup], m.group()
        if keep_trivia or kind not in ("comment", "whitespace"):
            value = text
            if kind in _BARE:
                value = text[1:-1].replace(*_BARE[kind]) if _BARE[kind] else text[1:-1]
            out.append((kind, text, value, line, m.start() - start + 1))
        if "\n" in text:
            line += text.count("\n")
            start = m.start() + text.rfind("\n") + 1
    return out


def tokens(model: dict[str, DataFrame]) -> DataFrame:
    """Tokens of all measures and calculated columns, by an Arrow-batched map over expressions."""
    m = model["measures"].select("model", F.lit("measure").alias("owner_kind"), F.col("ordinal").alias("owner"), "expression")
    c = model["columns"].where("expression <> ''").select("model", F.lit("column").alias("owner_kind"), F.col("ordinal").alias("owner"), "expression")

    def run(batches):
        import pandas as pd

        names = ["model", "owner_kind", "owner", "idx", "kind", "text", "value", "line", "col"]
        for pdf in batches:
            rows = [(r.model, r.owner_kind, r.owner, i, *t) for r in pdf.itertuples() for i, t in enumerate(tokenize(r.expression))]
            yield pd.DataFrame(rows, columns=names)

    return m.union(c).where("expression <> ''").mapInPandas(run, "model string, owner_kind string, owner int, idx int, kind string, text string, value string, line int, col int")


def _w():
    return Window.partitionBy("model", "owner_kind", "owner").orderBy("idx")


def _ahead(column: str, k: int) -> Column:
    return F.lead(column, k).over(_w())


def function_calls(toks: DataFrame) -> DataFrame:
    """Identifiers directly followed by an opening parenthesis."""
    return toks.withColumn("_n", _ahead("text", 1)).where("kind = 'identifier' AND _n = '('").drop("_n")


def column_references(toks: DataFrame) -> DataFrame:
    """Bracketed names with the table written directly before them, if any."""
    prev = lambda c: F.lag(c).over(_w())
    d = toks.withColumns({"_k": prev("kind"), "_v": prev("value"), "_t": prev("text"), "_l": prev("line"), "_c": prev("col")})
    touches = F.col("_k").isin("identifier", "quoted") & (F.col("_l") == F.col("line")) & (F.col("_c") + F.length("_t") == F.col("col"))
    d = d.where("kind = 'bracket'").withColumn("table", F.when(touches, F.col("_v")))
    return d.select("model", "owner_kind", "owner", "idx", F.col("value").alias("name"), "table", "line")


def lint(model: dict[str, DataFrame], select: Sequence[str] | None = None, ignore: Sequence[str] = (), toks: DataFrame | None = None) -> DataFrame:
    """All findings with their remedies, by severity (errors first), code, object and line.

    toks: the model's tokens, where the caller keeps them."""
    t, c, m, r = (model[k] for k in ("tables", "columns", "measures", "relationships"))
    toks = tokens(model) if toks is None else toks
    m = m.withColumn("object", F.concat("table", F.lit("["), "name", F.lit("]")))
    c = c.withColumn("object", F.concat("table", F.lit("["), "name", F.lit("]")))
    named = m.select("model", F.col("ordinal").alias("owner"), "object")
    mtoks = toks.where("owner_kind = 'measure'").join(named, ["model", "owner"])
    scanned = m.where("expression <> ''")
    rel = F.concat(F.col("from_table"), F.lit("["), F.col("from_column"), F.lit("] -> "), F.col("to_table"), F.lit("["), F.col("to_column"), F.lit("]"))
    size = m.groupBy("model").agg(F.count("*").alias("_n"))
    calls = function_calls(toks)
    mcalls = calls.where("owner_kind = 'measure'").join(named, ["model", "owner"])
    refs = column_references(toks).where("owner_kind = 'measure'").join(named, ["model", "owner"]).withColumn("_low", F.lower("name"))
    m_names = m.select("model", F.lower("name").alias("_low")).distinct().withColumn("_m", F.lit(True))
    c_names = c.select("model", F.lower("name").alias("_low")).distinct().withColumn("_c", F.lit(True))
    refs = refs.join(m_names, ["model", "_low"], "left").join(c_names, ["model", "_low"], "left")

    def first(df: DataFrame) -> DataFrame:
        return df.groupBy("model", "owner", "object").agg(F.min_by(F.struct("text", "line"), "idx").alias("_f")).select("model", "object", F.col("_f.text").alias("text"), F.col("_f.line").alias("line"))

    def out(code: str, df: DataFrame, message: Column | str, line: str | None = None) -> DataFrame:
        text = F.lit(message) if isinstance(message, str) else message
        return df.select("model", F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), "object", text.alias("message"), F.lit(REMEDY[code]).alias("remedy"), (F.col(line) if line else F.lit(0)).cast("int").alias("line"))

    ahead = mtoks.withColumns({f"t{k}": F.lead("text", k).over(_w()) for k in range(1, 7)} | {f"k{k}": F.lead("kind", k).over(_w()) for k in (2, 4, 5)} | {f"v{k}": F.lead("value", k).over(_w()) for k in (2, 4)})
    tables = t.select("model", F.lower("table").alias("_table")).distinct()
    whole = ahead.where("upper(text) = 'FILTER' AND t1 = '(' AND k2 IN ('identifier', 'quoted') AND coalesce(t3, '') <> '('").join(tables, (F.lower("v2") == F.col("_table")) & (ahead.model == tables.model), "left_semi")
    over = ahead.where(F.upper("text").isin(*ITERATORS) & (F.col("t1") == "(") & (F.col("t3") == ",") & F.col("k2").isin("identifier", "quoted") & F.col("k4").isin("identifier", "quoted") & (F.col("k5") == "bracket") & (F.col("t6") == ")") & (F.lower("v2") == F.lower("v4")))
    plain = F.replace(F.upper("text"), F.lit("X"), F.lit(""))
    plain = F.when(F.upper("text") == "MAXX", "MAX").otherwise(plain)
    signature = ahead.where("kind = 'identifier' AND t1 = '('").withColumn("_s", F.upper(F.concat_ws(" ", "text", "t1", "t2", "t3")))
    repeats = signature.groupBy("model", "owner", "object", "_s").agg(F.count("*").alias("n")).groupBy("model", "owner", "object").agg(F.max("n").alias("n")).where("n >= 3")
    has_var = mtoks.where("upper(text) = 'VAR'").select("model", "owner").distinct()
    logic = scanned.select("model", "ordinal", "object").join(toks.where("owner_kind = 'measure'").groupBy("model", "owner").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.upper(x["text"]))).alias("_logic")).withColumnRenamed("owner", "ordinal"), ["model", "ordinal"], "left").withColumn("_logic", F.coalesce("_logic", F.lit("")))
    same = logic.groupBy("model", "_logic").agg(F.array_sort(F.collect_list(F.struct("ordinal", "object"))).alias("g")).where("size(g) > 1").select("model", F.col("g")[0]["object"].alias("object"), F.array_join(F.transform(F.slice("g", F.lit(2), F.size("g")), lambda x: x["object"]), ", ").alias("others"))
    stored = calls.where("owner_kind = 'column'").where(F.upper("text").isin(*AGGREGATORS, *ITERATORS)).groupBy("model", "owner").agg(F.concat_ws(", ", F.sort_array(F.collect_set(F.upper("text")))).alias("f")).join(c.select("model", F.col("ordinal").alias("owner"), "object"), ["model", "owner"])
    uses_relationship = m.where(F.contains(F.upper("expression"), F.lit("USERELATIONSHIP"))).select("model").distinct()
    timed = scanned.where(F.col("expression").rlike(TIME_FUNCTIONS)).select("model").distinct().withColumn("object", F.col("model"))
    foreign = r.select("model", F.lower("from_table").alias("_t"), F.lower("from_column").alias("_c")).distinct()
    seen = c.withColumns({"_t": F.lower("table"), "_c": F.lower("name")}).where("NOT hidden").join(foreign, ["model", "_t", "_c"], "left_semi")
    found = [
        out("MOD001", m.where("trim(description) = ''"), "measure has no description"),
        out("MOD002", m.join(size, "model").where("_n >= 10 AND trim(display_folder) = ''"), "measure is in no display folder"),
        out("MOD003", r.where("lower(cross_filter) = 'bothdirections'").withColumn("object", rel), "relationship filters in both directions"),
        out("MOD004", r.where("NOT active").withColumn("object", rel).join(uses_relationship, "model", "left_anti"), "inactive relationship that no measure activates"),
        out("MOD005", t.where("auto_date").groupBy("model").agg(F.count("*").alias("n")).withColumn("object", F.col("model")), F.format_string("%d automatic date tables in the model", "n")),
        out("MOD006", c.where((F.lower("data_type") == "double") & F.col("name").rlike(MONEY_NAME)), "money held as a floating-point double"),
        out("MOD007", c.where((~F.lower("summarize_by").isin("none", "")) & F.lower("data_type").isin("double", "int64", "decimal") & (F.col("key") | F.col("name").rlike(KEY_NAME))), F.concat(F.lit("identifier summed by default: "), F.col("summarize_by"))),
        out("MOD008", seen, "relationship key is visible"),
        out("MOD009", timed.join(t.where("date_table").select("model").distinct(), "model", "left_anti"), "time intelligence without a table marked as dates"),
        out("MOD010", m.where("trim(format_string) = '' AND NOT hidden"), "measure has no format string"),
        out("MOD011", same, F.concat(F.lit("same logic as "), F.col("others"))),
        out("MOD012", stored, F.concat(F.lit("calculated column aggregates: "), F.col("f"))),
        out("DAX001", first(mtoks.where("kind = 'operator' AND text = '/'")), "divides with / rather than DIVIDE", "line"),
        out("DAX002", refs.where("table IS NULL AND _m IS NULL AND _c"), F.concat(F.lit("column ["), F.col("name"), F.lit("] without its table")), "line"),
        out("DAX003", refs.where("table IS NOT NULL AND _m AND _c IS NULL"), F.concat(F.lit("measure ["), F.col("name"), F.lit("] written with a table")), "line"),
        out("DAX004", whole, F.concat(F.lit("FILTER over the whole table "), F.col("v2")), "line"),
        out("DAX005", first(mcalls.where("upper(text) IN ('IFERROR', 'ISERROR')")), F.concat(F.lit("errors swallowed by "), F.upper("text")), "line"),
        out("DAX006", over, F.concat(F.upper("text"), F.lit(" over a plain column: use "), plain), "line"),
        out("DAX007", first(mcalls.where("upper(text) = 'EARLIER'")), "EARLIER rather than a variable", "line"),
        out("DAX008", repeats.join(has_var, ["model", "owner"], "left_anti"), F.format_string("one call repeated %d times without a variable", "n")),
    ]
    wanted = {x.upper() for x in select} if select is not None else set(SEVERITY)
    wanted -= {x.upper() for x in ignore}
    got = None
    for code, f in zip(SEVERITY, found):
        if code in wanted:
            got = f if got is None else got.unionByName(f)
    if got is None:
        got = found[0].where("false")
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return got.orderBy(rank, "code", "object", "line")
