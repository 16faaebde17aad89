"""Event and case extracts as CSV, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.eventlog import CASE_CORE, EVENT_CORE

# Accepted time stamps, tried in this order. Fields may be unpadded.
FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d")


def parse_timestamp(text) -> Column:
    """The first format that fits, as TIMESTAMP_NTZ; any other text raises."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    got = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]).cast("timestamp_ntz")
    bad = F.raise_error(F.concat(F.lit("unrecognised timestamp: "), F.coalesce(t, F.lit("")))).cast("timestamp_ntz")
    return F.when(got.isNotNull(), got).otherwise(bad)


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, first, record: the records of CSV files, also those with line breaks in quotes, of files split at will.

    Lines are read as text, which splits files anywhere. A line starts a record where the quotes before it, in its
    split and those before, are even in number; a sum a split tells that. Whole lines go on as they are; only lines
    of longer records are gathered. seq rises with the place in the file and, above, with the file; first marks a
    file's first record."""
    d = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    d = d.withColumn("quotes", quotes)
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("file", "block").orderBy("id")
    # one row a split, and one a file
    splits = d.groupBy("file", "block").agg(F.sum("quotes").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    files = splits.select("file").distinct().select("file", F.row_number().over(Window.orderBy("file")).alias("nth"))
    d = d.join(splits, ["file", "block"]).withColumns({"row": F.row_number().over(inner), "upto": F.col("before") + F.sum("quotes").over(inner.rowsBetween(Window.unboundedPreceding, 0))})
    d = d.withColumns({"inside": (F.col("upto") - F.col("quotes")) % 2 == 1, "goes_on": F.col("upto") % 2 == 1})
    # a line takes a byte at least, so rows never pass the next split's start
    d = d.join(files, "file").withColumns({"seq": F.col("nth").cast("long") * (1 << 44) + F.col("block") + F.col("row") - 1, "first": (F.col("block") == 0) & (F.col("row") == 1)})
    whole = d.where(~F.col("inside") & ~F.col("goes_on")).select("file", "seq", "first", F.col("line").alias("record"))
    parts = d.where(F.col("inside") | F.col("goes_on")).select("file", "block", "seq", "first", "line", F.when(~F.col("inside"), F.col("seq")).alias("own"))
    starts = parts.groupBy("file", "block").agg(F.max("own").alias("last")).select("file", "block", F.last("last", ignorenulls=True).over(order).alias("above"))
    parts = parts.withColumn("own", F.last("own", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.join(starts, ["file", "block"]).withColumn("own", F.coalesce("own", "above"))
    longer = parts.groupBy("file", F.col("own").alias("seq")).agg(F.max("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("record"))
    return whole.unionByName(longer).withColumn("record", F.regexp_replace("record", "\r$", ""))


def _read(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """Rows of strings by the files' header, with _seq; every file has that header."""
    names = [c.lstrip("\ufeff") for c in spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8").columns]
    missing = sorted(set(needed) - set(names))
    if missing:
        raise ValueError("missing required column(s): " + ", ".join(missing))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records(spark, path).where("NOT first AND trim(record) <> ''").select(F.col("seq").alias("_seq"), F.from_csv("record", F.lit(schema), {"escape": '"'}).alias("_v"))
    return rows.select("_seq", *[F.col(f"_v.c{i}").alias(c) for i, c in enumerate(names)])


def read_events(spark: SparkSession, path: str, case_id="case_id", activity="activity", timestamp="timestamp", resource="resource") -> DataFrame:
    """Events with all other columns as string attributes.

    seq is the row's place, by file and position in the file, so events of one time stamp keep the order of the
    extract. Files are split, quoted line breaks or not."""
    raw = _read(spark, path, [case_id, activity, timestamp])
    core = {case_id, activity, timestamp, resource, "_seq"}
    who = F.coalesce(F.col(resource), F.lit("")) if resource in raw.columns else F.lit("")
    rest = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in raw.columns if c not in core]
    return raw.select(F.col(case_id).alias("case_id"), F.col(activity).alias("activity"), parse_timestamp(timestamp).alias("ts"), who.alias("resource"), F.col("_seq").alias("seq"), *rest)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path, list(CASE_CORE))
    rest = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in raw.columns if c not in (*CASE_CORE, "_seq")]
    return raw.select(
        "case_id", parse_timestamp("arrived").alias("arrived"), F.trim("duration_hours").cast("double").alias("duration_hours"),
        F.coalesce(F.trim("resolved").isin("1", "true", "True", "yes"), F.lit(False)).alias("resolved"), F.trim("sla_hours").cast("double").alias("sla_hours"), *rest,
    )


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("timestamp" if c == "ts" else c)


def write_events(events: DataFrame, path: str) -> None:
    """Core columns, then attributes in alphabetical order; seconds precision; in log order."""
    rest = sorted(c for c in events.columns if c not in EVENT_CORE)
    events.orderBy("ts", "case_id", "seq").select("case_id", "activity", _stamp("ts"), "resource", *rest).write.csv(path, header=True, mode="overwrite")


def write_cases(cases: DataFrame, path: str) -> None:
    rest = sorted(c for c in cases.columns if c not in CASE_CORE)
    four = lambda c: F.format_string("%.4f", c).alias(c)
    cases.orderBy("arrived", "case_id").select("case_id", _stamp("arrived"), four("duration_hours"), F.when(F.col("resolved"), "1").otherwise("0").alias("resolved"), four("sla_hours"), *rest).write.csv(path, header=True, mode="overwrite")


def write_rows(df: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    df.coalesce(1).write.csv(path, header=True, mode="overwrite")
