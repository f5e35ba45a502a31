"""Layout parsers on tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.base import entry, twin
from trajecta.functions.numeric import as_number
from trajecta.session import scratch_path
from trajecta.sources import detect, ingest


def _csv(df, name: str):
    """Write a derived table as CSV and read it through the ingest path."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return ingest.read_csv(df.sparkSession, path)


@entry("csv_long_layout", twin("""
  SELECT b.batch_id, yield, duration, quality, is_golden, n_values, round(total, 2) AS total
  FROM batches b JOIN (SELECT batch_id, count(value) AS n_values, sum(value) AS total
    FROM reading_cells WHERE variable IN ('quantity', 'discount') GROUP BY batch_id) USING (batch_id)""",
    "batches", "reading_cells"))
def csv_long_layout(spark, sf_dir):
    """CSV scan, role detection, coercion and the long parser end to end."""
    rows = fx.readings(spark, sf_dir).join(fx.yields(spark, sf_dir).select("batch_id", "yield"), "batch_id")
    raw = _csv(rows, "long")
    roles = detect.detect_long(raw)
    runs, readings = ingest.parse_long(
        raw, roles.batch_col, roles.time_col, roles.cpp_cols, roles.yield_col
    )
    totals = readings.groupBy("batch_id").agg(
        (F.count("quantity") + F.count("discount")).alias("n_values"),
        F.round(F.sum("quantity") + F.sum("discount"), 2).alias("total"),
    )
    return runs.join(totals, "batch_id")


@entry("column_roles", """
  SELECT * FROM (VALUES
    ('long', 'batch_id', 'time_index', NULL::VARCHAR, 'quantity,price,discount,tax', 0, NULL::BIGINT, 0),
    ('unnamed', 'l_suppkey', 'l_linenumber', NULL, 'l_quantity,l_extendedprice', 0, NULL, 0),
    ('wide', 'batch_id', NULL, 'yield', 'quantity,discount', 0, NULL, 0),
    ('pivot', NULL, 'Timestamp', NULL, '', (SELECT CAST(count(DISTINCT o_orderpriority) AS INTEGER) FROM orders),
      (SELECT count(DISTINCT o_orderdate) FROM orders), 0),
    ('stacked', NULL, 'l_orderkey', NULL,
      'l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax', 0, NULL, 0))
  r(layout, batch_col, time_col, yield_col, cpp_cols, n_batch_cols, n_timepoints, n_warnings)""")
def column_roles(spark, sf_dir):
    """Detected roles of the long, wide, pivot and stacked layouts."""
    long = detect.detect_long(fx.readings(spark, sf_dir))
    raw = detect.detect_long(fx.table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    wide = detect.detect_wide(_summary(spark, sf_dir))
    pivot = detect.detect_pivot(_order_pivot(spark, sf_dir, F.sum("o_totalprice")))
    stacked = detect.detect_stacked(fx.table(spark, sf_dir, "lineitem"))
    rows = [
        (name, r.batch_col, r.time_col, r.yield_col, ",".join(r.cpp_cols), len(r.batch_cols),
         r.n_timepoints, len(r.warnings))
        for name, r in (("long", long), ("unnamed", raw), ("wide", wide), ("pivot", pivot),
                        ("stacked", stacked))
    ]
    return spark.createDataFrame(
        rows, "layout string, batch_col string, time_col string, yield_col string, "
        "cpp_cols string, n_batch_cols int, n_timepoints long, n_warnings int",
    )


@entry("coerced_numbers", """
  SELECT event_type, count(*) AS n_rows, count(v) AS n_valid, round(sum(v), 2) AS total
  FROM (SELECT event_type, CASE WHEN isnan(x) THEN NULL ELSE x END AS v FROM (
    SELECT event_type, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN 'NaN'
      ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS x FROM events))
  GROUP BY event_type""")
def coerced_numbers(spark, sf_dir):
    text = (
        F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 11 == 0, "NaN")
        .otherwise(F.col("value").cast("string"))
    )
    return fx.table(spark, sf_dir, "events").withColumn("v", as_number(text)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_valid"),
        F.round(F.sum("v"), 2).alias("total"),
    )


def _summary(spark, sf_dir):
    means = fx.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.avg("l_quantity"), 6).alias("quantity"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
    )
    return means.select(
        F.col("l_suppkey").cast("string").alias("batch_id"), "quantity", "discount"
    ).join(fx.yields(spark, sf_dir).select("batch_id", "yield"), "batch_id")


@entry("wide_layout", twin("""
  SELECT batch_id, yield, 1 AS duration, quality, is_golden, quantity, discount
  FROM batches JOIN (SELECT CAST(l_suppkey AS VARCHAR) AS batch_id,
    round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount
    FROM lineitem GROUP BY l_suppkey) USING (batch_id)""", "batches"))
def wide_layout(spark, sf_dir):
    raw = _summary(spark, sf_dir)
    roles = detect.detect_wide(raw)
    runs, features = ingest.parse_wide(raw, roles.batch_col, roles.cpp_cols, roles.yield_col)
    return runs.join(features, "batch_id")


@entry("wide_last_row_wins", """
  SELECT CAST(l_orderkey AS VARCHAR) AS batch_id, max_by(l_quantity, rk) AS quantity,
    max_by(l_tax, rk) AS tax
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_suppkey, l_partkey, l_shipdate) AS rk FROM lineitem) GROUP BY l_orderkey""")
def wide_last_row_wins(spark, sf_dir):
    """Several rows per batch id: the last one gives the features."""
    raw = fx.table(spark, sf_dir, "lineitem")
    order = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    _, features = ingest.parse_wide(raw, "l_orderkey", ["l_quantity", "l_tax"], order=order)
    return features.withColumnsRenamed({"l_quantity": "quantity", "l_tax": "tax"})


# The order priorities of the given orders table.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _order_pivot(spark, sf_dir, measure):
    """Rows = days, one column per order priority."""
    orders = fx.table(spark, sf_dir, "orders")
    day = F.date_format(F.date_trunc("day", F.col("o_orderdate")), "dd-MM-yyyy HH:mm")
    return orders.groupBy(day.alias("Timestamp")).pivot("o_orderpriority", PRIORITIES).agg(measure)


fx.cte("order_days", (), """
  SELECT day, o_orderpriority AS batch_id, sum(o_totalprice) AS total, count(*) AS n
  FROM (SELECT date_trunc('day', o_orderdate) AS day, * FROM orders) GROUP BY ALL""")
fx.cte("order_grid", ("order_days",), """
  SELECT d.time_index, p.batch_id, t.total, t.n
  FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS time_index FROM
    (SELECT DISTINCT day FROM order_days)) d
  CROSS JOIN (SELECT DISTINCT batch_id FROM order_days) p
  LEFT JOIN order_days t ON t.day = d.day AND t.batch_id = p.batch_id""")


@entry("pivot_layout", twin("""
  SELECT batch_id, time_index, 'total' AS variable, round(total, 2) AS value FROM order_grid""",
    "order_grid"))
def pivot_layout(spark, sf_dir):
    raw = _order_pivot(spark, sf_dir, F.sum("o_totalprice"))
    roles = detect.detect_pivot(raw)
    return ingest.parse_pivot(raw, roles.time_col, roles.batch_cols, "total").withColumn(
        "value", F.round("value", 2))


@entry("merged_pivots", twin("""
  SELECT batch_id, count(*) AS n_steps, count(total) AS n_total, round(sum(total), 2) AS total,
    CAST(sum(n) AS DOUBLE) AS n_orders, any_value(q.quality) AS quality, any_value(q.duration) AS duration
  FROM order_grid JOIN (SELECT 'Unknown' AS quality, CAST(count(DISTINCT time_index) AS INTEGER) AS duration
    FROM order_grid) q ON true GROUP BY batch_id""", "order_grid"))
def merged_pivots(spark, sf_dir):
    parsed = [
        ingest.parse_pivot(_order_pivot(spark, sf_dir, m), "Timestamp", PRIORITIES, name)
        for name, m in (("total", F.sum("o_totalprice")), ("n", F.count(F.lit(1))))
    ]
    runs, readings = ingest.merge_pivots(parsed, ["total", "n"])
    sums = readings.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count("total").alias("n_total"),
        F.round(F.sum("total"), 2).alias("total"), F.sum("n").alias("n_orders"),
    )
    return sums.join(runs.select("batch_id", "quality", "duration"), "batch_id")


@entry("matched_by_position", twin("""
  SELECT r_name AS batch_id, count(total) AS n_values, round(sum(total), 2) AS total
  FROM order_grid JOIN (SELECT batch_id, row_number() OVER (ORDER BY batch_id) AS k
    FROM (SELECT DISTINCT batch_id FROM order_days)) USING (batch_id)
  JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region) USING (k)
  GROUP BY r_name""", "order_grid"))
def matched_by_position(spark, sf_dir):
    """Columns of a pivot file take the ids of a summary, left to right."""
    ids = [r["r_name"] for r in fx.table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    raw = _order_pivot(spark, sf_dir, F.sum("o_totalprice"))
    renamed = ingest.rename_by_position(raw, PRIORITIES, ids)
    return ingest.parse_pivot(renamed, "Timestamp", ids, "total").groupBy("batch_id").agg(
        F.count("value").alias("n_values"), F.round(F.sum("value"), 2).alias("total"))


@entry("stacked_layout", """
  WITH rows AS (SELECT row_number() OVER () - 1 AS pos, l_quantity FROM lineitem),
  runs AS (SELECT n_name AS batch_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal FROM nation),
  size AS (SELECT (SELECT count(*) FROM lineitem) // (SELECT count(*) FROM nation) AS steps)
  SELECT batch_id, count(*) AS n_steps, max(pos % steps)::DOUBLE AS last_step,
    round(sum(l_quantity), 2) AS quantity, round(sum(l_quantity * (pos % steps)), 2) AS weighted
  FROM rows, size JOIN runs ON runs.ordinal = pos // steps GROUP BY batch_id""")
def stacked_layout(spark, sf_dir):
    """Runs stacked in file order, one per nation."""
    rows = ingest.file_positions(fx.table(spark, sf_dir, "lineitem").select("l_quantity", "_metadata"))
    ids = fx.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("batch_id"))
    readings = ingest.parse_stacked(rows, "pos", ["l_quantity"], ids)
    return readings.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.max("time_index").alias("last_step"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum(F.col("l_quantity") * F.col("time_index")), 2).alias("weighted"),
    )


LINES = [f"L{i}" for i in range(1, 8)]


@entry("transposed_layout", """
  SELECT 'L' || l_linenumber AS batch_id, round(avg(l_quantity), 4) AS quantity,
    round(avg(l_tax), 4) AS tax,
    round(100 * avg(CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0 END), 4) AS yield
  FROM lineitem GROUP BY l_linenumber""")
def transposed_layout(spark, sf_dir):
    """Rows = parameters and the yield, columns = batches."""
    kept = F.when(F.col("l_returnflag") != "R", 100.0).otherwise(0.0)
    means = fx.table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("L"), "l_linenumber").alias("batch_id")
    ).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"), F.avg(kept).alias("Yield"))
    raw = means.unpivot("batch_id", ["quantity", "tax", "Yield"], "CPP_Name", "v").groupBy(
        "CPP_Name").pivot("batch_id", LINES).agg(F.first("v"))
    features, yields = ingest.parse_transposed(raw, "CPP_Name", LINES)
    return ingest.widen(features, ["quantity", "tax"]).join(yields, "batch_id").select(
        "batch_id", *[F.round(c, 4).alias(c) for c in ("quantity", "tax", "yield")])


@entry("uploaded_trajectories", """
  SELECT CAST(user_id AS VARCHAR) AS batch_id, count(*) AS n_points, round(avg(value), 6) AS mean,
    round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
    round(avg(CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) * 100 ELSE 0 END), 6) AS mean_pct
  FROM (SELECT user_id, value, CAST(epoch_us(ts) AS DOUBLE) AS t,
    min(CAST(epoch_us(ts) AS DOUBLE)) OVER (PARTITION BY user_id) AS t0,
    max(CAST(epoch_us(ts) AS DOUBLE)) OVER (PARTITION BY user_id) AS t1 FROM events)
  GROUP BY user_id""")
def uploaded_trajectories(spark, sf_dir):
    rows = fx.event_readings(spark, sf_dir)
    points, stats = ingest.parse_trajectory(rows, "time_index", "value", ["batch_id"])
    mean = points.groupBy("batch_id").agg(F.round(F.avg("time_pct"), 6).alias("mean_pct"))
    return stats.join(mean, "batch_id").withColumns(
        {c: F.round(c, 6) for c in ("mean", "std")})


@entry("yield_lines", """
  SELECT CAST(event_id AS VARCHAR) AS batch_id, value AS yield FROM events WHERE event_id % 5 <> 0""")
def yield_lines(spark, sf_dir):
    """``id: value`` lines between lines that do not parse."""
    number = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    text = F.concat(
        F.lit("recorded by hand\n "), F.col("event_id").cast("string"), F.lit(" :  "), number,
        F.lit("\r\nnote "), F.col("event_type"),
    )
    return ingest.parse_yield_lines(fx.table(spark, sf_dir, "events").select(text.alias("text")), "text")


@entry("variables_from_files", """
  SELECT 'lineitem' AS variable, count(*) AS n_rows FROM lineitem UNION ALL
  SELECT 'events', count(*) FROM events""")
def variables_from_files(spark, sf_dir):
    names = ["lineitem", "events"]
    tables = [
        fx.table(spark, sf_dir, n).groupBy(ingest.variable_of_file().alias("variable")).agg(
            F.count(F.lit(1)).alias("n_rows")) for n in names
    ]
    ingest.assert_unique(names)
    return tables[0].union(tables[1])


@entry("data_fingerprint")
def data_fingerprint(spark, sf_dir):
    return ingest.fingerprint({
        "readings": fx.readings(spark, sf_dir), "batches": fx.batches(spark, sf_dir)})
