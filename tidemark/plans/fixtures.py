"""Events, cases and series over the order and event tables, as DataFrames and as SQL of the same frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGETS = {"1-URGENT": 240.0, "2-HIGH": 480.0, "3-MEDIUM": 720.0, "4-NOT SPECIFIED": 960.0, "5-LOW": 1440.0}
END = "2001-11-04"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(events: DataFrame, case) -> DataFrame:
    actor = F.concat(F.lit("R"), (F.get_json_object("props", "$.k").cast("int") % 12).cast("string"))
    return events.select(case.alias("case_id"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp_ntz").alias("ts"), actor.alias("resource"), F.col("event_id").alias("seq"))


def log_user(spark, sf_dir) -> DataFrame:
    return _log(table(spark, sf_dir, "events"), F.col("user_id").cast("string"))


def log_session(spark, sf_dir) -> DataFrame:
    return _log(table(spark, sf_dir, "events"), F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))


def order_cases(spark, sf_dir) -> DataFrame:
    """One case an order: hours to the first line shipped on or after the order date; censored at END if none."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    first = lines.join(orders, lines.l_orderkey == orders.o_orderkey).where("l_shipdate >= o_orderdate").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    c = orders.join(first, orders.o_orderkey == first.l_orderkey, "left")
    days = F.datediff(F.coalesce("first_ship", F.lit(END).cast("timestamp_ntz")).cast("date"), F.col("o_orderdate").cast("date"))
    sla = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in TARGETS.items()])
    return c.select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("arrived"), (days * 24.0).alias("duration_hours"),
        F.col("first_ship").isNotNull().alias("resolved"), sla.alias("sla_hours"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") / 1e5).alias("price"),
    )


def observations(spark, sf_dir) -> DataFrame:
    """duration, event, urgent, price of the order cases."""
    c = order_cases(spark, sf_dir)
    return c.select("case_id", F.col("duration_hours").alias("duration"), F.col("resolved").cast("int").alias("event"), F.when(F.col("priority") == "1-URGENT", 1).otherwise(0).alias("urgent"), "price")


def daily(spark, sf_dir) -> DataFrame:
    """day (string), n events, errors, mean value."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"), F.avg("value").alias("mean_value"))


def gage(spark, sf_dir) -> DataFrame:
    """part, operator, value: a balanced study of all lines. A replicate of a cell (line number, return flag) is the
    mean price, in thousands, of its lines whose order falls in one of ten groups by key."""
    l = table(spark, sf_dir, "lineitem")
    g = l.groupBy(F.col("l_linenumber").cast("string").alias("part"), F.col("l_returnflag").alias("operator"), (F.floor(F.col("l_orderkey") / 32) % 10).alias("replicate"))
    return g.agg((F.avg("l_extendedprice") / 1000).alias("value")).select("part", "operator", "value")


# The same frames in SQL, as common table expressions.
_EV = "SELECT {case} AS case_id, event_type AS activity, ts, 'R' || (CAST(json_extract_string(props, '$.k') AS INT) % 12) AS resource, event_id AS seq FROM events"
LOG_USER = "log AS (" + _EV.format(case="user_id::VARCHAR") + ")"
LOG_SESSION = "log AS (" + _EV.format(case="user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d')") + ")"
ORDERED = """o AS (SELECT *, row_number() OVER w AS pos, lead(activity) OVER w AS next_activity, lead(ts) OVER w AS next_ts, lead(resource) OVER w AS next_resource,
 lag(activity) OVER w AS prev_activity, lag(ts) OVER w AS prev_ts FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, seq))"""
CASES = f"""cases AS (SELECT o_orderkey::VARCHAR AS case_id, o_orderdate AS arrived, 24.0::DOUBLE * datediff('day', o_orderdate::DATE, coalesce(first_ship, TIMESTAMP '{END}')::DATE) AS duration_hours,
 first_ship IS NOT NULL AS resolved, (CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN {v}" for k, v in TARGETS.items())} END)::DOUBLE AS sla_hours, o_orderpriority AS priority, o_orderstatus AS status, o_totalprice / 1e5::DOUBLE AS price
 FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1) f ON o_orderkey = l_orderkey)"""
OBS = CASES + ", obs AS (SELECT case_id, duration_hours AS duration, resolved::INT AS event, (priority = '1-URGENT')::INT AS urgent, price FROM cases)"
DAILY = "d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum((event_type = 'error')::INT) AS errors, avg(value) AS mean_value FROM events GROUP BY 1)"
GAGE = "g AS (SELECT l_linenumber::VARCHAR AS part, l_returnflag AS operator, avg(l_extendedprice) / 1000.0::DOUBLE AS value FROM lineitem GROUP BY l_linenumber, l_returnflag, (l_orderkey // 32) % 10)"


def sql_elapsed(c: str) -> str:
    """Working microseconds before c, weekdays 9 to 17."""
    n = f"datediff('day', DATE '1970-01-05', ({c})::DATE)"
    m = f"((({n} % 7) + 7) % 7)"
    tod = f"(epoch_us({c}) - epoch_us(date_trunc('day', {c})))"
    return f"(28800000000 * (5 * floor({n} / 7.0::DOUBLE)::BIGINT + least({m}, 5)) + CASE WHEN {m} < 5 THEN greatest(0, least({tod} - 32400000000, 28800000000)) ELSE 0 END)"


def sql_hours(a: str, b: str) -> str:
    return f"(greatest(0, {sql_elapsed(b)} - {sql_elapsed(a)}) / 3600000000.0::DOUBLE)"


def sql_at(k: str) -> str:
    return f"(TIMESTAMP '1970-01-05 09:00:00' + to_days((7 * (({k}) // 28800000000 // 5) + ({k}) // 28800000000 % 5)::INT) + to_microseconds((({k}) % 28800000000)::BIGINT))"


def sql_week(d: str) -> str:
    return f"(lpad(isoyear({d})::VARCHAR, 4, '0') || '-W' || lpad(week({d})::VARCHAR, 2, '0'))"
