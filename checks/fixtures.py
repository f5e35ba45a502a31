"""The shapes the engine works on, derived from the given tables.

Each shape exists twice: as a DataFrame here and as a named SQL piece for the
twins.  ``readings`` come from ``lineitem`` (batch = supplier) and from
``events`` (batch = user).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import cte
from trajecta.functions.numeric import rounded
from trajecta.operators.align import align
from trajecta.operators.features import basic_features
from trajecta.operators.label import default_target, label_quality, split_by_target
from trajecta.operators.profile import build_profile
from trajecta.operators.scale import lookup, plain, positions
from trajecta.session import cut_lineage

VARIABLES = ["quantity", "price", "discount", "tax"]
KINDS = ["click", "error", "purchase", "signup", "view"]


_STAGES: dict[tuple, DataFrame] = {}


def stage(fn):
    """Keep a shape that many steps of a query read: computed once per session."""

    @functools.wraps(fn)
    def once(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
        if key not in _STAGES:
            _STAGES[key] = cut_lineage(fn(spark, sf_dir), fn.__name__)
        return _STAGES[key]

    return once


def made(spark: SparkSession, sf_dir: str, shape) -> bool:
    """Whether this session keeps the shape already."""
    return (spark.sparkContext.applicationId, sf_dir, shape.__name__) in _STAGES


def forget(spark: SparkSession) -> None:
    """Drop every kept shape, so that the next query starts cold."""
    _STAGES.clear()
    spark.catalog.clearCache()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def lineitem_ordered(spark: SparkSession, sf_dir: str, runs: DataFrame | None = None) -> DataFrame:
    """Line items with their 0-based place in the supplier's history; of ``runs`` (l_suppkey)
    only, if given: whole runs, so that their places stay."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    )
    if runs is not None:
        rows = lookup(rows, runs, ["l_suppkey"], "left_semi")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")]
    placed, _ = positions(rows, ["l_suppkey"], order, micros("l_shipdate"), "pos")
    return plain(placed)


def measured(rows: DataFrame, *keys: Column) -> DataFrame:
    """Line items as ``keys`` and four variables."""
    return rows.select(
        *keys,
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def timed(placed: DataFrame) -> DataFrame:
    return measured(
        placed, F.col("l_suppkey").cast("string").alias("batch_id"), F.col("pos").cast("double").alias("time_index"))


@stage
def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of four variables; batches differ in length."""
    return timed(lineitem_ordered(spark, sf_dir))


@stage
def golden_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of the golden runs, whole."""
    key = table(spark, sf_dir, "lineitem").schema["l_suppkey"].dataType
    runs = golden_ids(spark, sf_dir).select(F.col("batch_id").cast(key).alias("l_suppkey"))
    return timed(lineitem_ordered(spark, sf_dir, runs))


@stage
def gappy_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with scattered gaps and with one variable missing in some batches."""
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return lineitem_ordered(spark, sf_dir).select(
        F.col("l_suppkey").cast("string").alias("batch_id"),
        F.col("pos").cast("double").alias("time_index"),
        F.when(key % 13 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_suppkey") % 10 != 3, F.col("l_extendedprice")).alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One variable at irregular times, batch = user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("batch_id"),
        micros("ts").cast("double").alias("time_index"),
        F.col("value"),
    )


def sparse_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sparse variables: every row carries the one of its event type."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("batch_id"),
        micros("ts").cast("double").alias("time_index"),
        *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in KINDS],
    )


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("l_returnflag") != "R", 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.round(100 * F.avg(kept), 2).alias("yield"),
        F.count(F.lit(1)).cast("int").alias("duration"),
    ).select(F.col("l_suppkey").cast("string").alias("batch_id"), "yield", "duration")


@stage
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_quality(cut_lineage(yields(spark, sf_dir), "yields"))  # one row per run, read several times


def golden_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).where("is_golden").select("batch_id")


@stage
def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)
    return label_quality(
        table(spark, sf_dir, "events").groupBy("user_id").agg(
            F.round(100 * F.avg(good), 2).alias("yield"),
            F.count(F.lit(1)).cast("int").alias("duration"),
        ).select(F.col("user_id").cast("string").alias("batch_id"), "yield", "duration")
    )


@stage
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(readings(spark, sf_dir), VARIABLES)


@stage
def golden_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(golden_readings(spark, sf_dir), VARIABLES)


def golden_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden runs of :func:`aligned`.  A run is aligned by itself, so the other runs are
    not placed and aligned for them."""
    if made(spark, sf_dir, aligned):
        return aligned(spark, sf_dir).join(golden_ids(spark, sf_dir), "batch_id", "left_semi")
    return golden_cells(spark, sf_dir)


@stage
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_profile(batches(spark, sf_dir), aligned(spark, sf_dir))


@stage
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded, so that equal means tie whatever the order of the additions; means and
    deviations need no places."""
    rows = measured(table(spark, sf_dir, "lineitem"), F.col("l_suppkey").alias("batch_id"))
    found = rounded(basic_features(rows, VARIABLES), 9, "value")
    return found.withColumn("batch_id", F.col("batch_id").cast("string"))


@stage
def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = batches(spark, sf_dir)
    return split_by_target(runs, default_target(runs))


# ── the same shapes in SQL ───────────────────────────────────────────────────

cte("li", (), """
  SELECT *, row_number() OVER (PARTITION BY l_suppkey
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM lineitem""")
cte("readings", ("li",), """
  SELECT CAST(l_suppkey AS VARCHAR) AS batch_id, CAST(pos AS DOUBLE) AS time_index,
    l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM li""")
cte("gappy", ("li",), """
  SELECT CAST(l_suppkey AS VARCHAR) AS batch_id, CAST(pos AS DOUBLE) AS time_index,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 <> 0 THEN l_quantity END AS quantity,
    CASE WHEN l_suppkey % 10 <> 3 THEN l_extendedprice END AS price,
    l_discount AS discount, l_tax AS tax FROM li""")
cte("event_readings", (), """
  SELECT CAST(user_id AS VARCHAR) AS batch_id, CAST(epoch_us(ts) AS DOUBLE) AS time_index, value
  FROM events""")
cte("sparse", (), """
  SELECT CAST(user_id AS VARCHAR) AS batch_id, CAST(epoch_us(ts) AS DOUBLE) AS time_index,
  """ + ", ".join(f"CASE WHEN event_type = '{k}' THEN value END AS {k}" for k in KINDS) + """
  FROM events""")
cte("reading_cells", ("readings",), """
  SELECT batch_id, time_index, variable, value FROM readings
  UNPIVOT INCLUDE NULLS (value FOR variable IN (quantity, price, discount, tax))""")
cte("gappy_cells", ("gappy",), """
  SELECT batch_id, time_index, variable, value FROM gappy
  UNPIVOT INCLUDE NULLS (value FOR variable IN (quantity, price, discount, tax))""")
cte("sparse_cells", ("sparse",), f"""
  SELECT batch_id, time_index, variable, value FROM sparse
  UNPIVOT INCLUDE NULLS (value FOR variable IN ({", ".join(KINDS)}))""")
cte("event_cells", ("event_readings",), """
  SELECT batch_id, time_index, 'value' AS variable, value FROM event_readings""")
cte("yields", (), """
  SELECT CAST(l_suppkey AS VARCHAR) AS batch_id,
    round(100 * avg(CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS yield,
    CAST(count(*) AS INTEGER) AS duration
  FROM lineitem GROUP BY l_suppkey""")
cte("event_yields", (), """
  SELECT CAST(user_id AS VARCHAR) AS batch_id,
    round(100 * avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS yield,
    CAST(count(*) AS INTEGER) AS duration
  FROM events GROUP BY user_id""")


def labelled(source: str) -> str:
    return f"""
  SELECT y.*,
    CASE WHEN c.n <> c.known OR c.n < 4 THEN 'Unknown' WHEN yield >= c.q75 THEN 'Golden'
      WHEN yield >= c.q50 THEN 'Good' ELSE 'Poor' END AS quality,
    coalesce(c.n = c.known AND c.n >= 4 AND yield >= c.q75, false) AS is_golden
  FROM {source} y, (SELECT count(*) AS n, count(yield) AS known,
    quantile_cont(yield, 0.75) AS q75, quantile_cont(yield, 0.5) AS q50 FROM {source}) c"""


cte("batches", ("yields",), labelled("yields"))
cte("event_batches", ("event_yields",), labelled("event_yields"))


def aligned_sql(cells: str, points: int = 100) -> str:
    """Alignment as segments between neighbouring samples."""
    top = points - 1
    return f"""
  SELECT batch_id, variable, step, step / {top}.0::DOUBLE AS time_norm,
    CASE WHEN step = 0 OR u1 IS NULL THEN v ELSE v + (v1 - v) * (step - u) / (u1 - u) END AS value
  FROM (
    SELECT batch_id, variable, u, v, u1, v1,
      unnest(generate_series(CAST(CASE WHEN first_row THEN 0 ELSE floor(u) + 1 END AS BIGINT),
             CAST(CASE WHEN u1 IS NULL THEN {top} ELSE floor(u1) END AS BIGINT))) AS step
    FROM (
      SELECT batch_id, variable, u, v, lead(u) OVER w AS u1, lead(v) OVER w AS v1,
        row_number() OVER w = 1 AS first_row
      FROM (
        SELECT c.batch_id, variable,
          CASE WHEN t1 > t0 THEN (time_index - t0) / (t1 - t0) * {top}
               WHEN n > 1 THEN (row_number() OVER (PARTITION BY c.batch_id, variable
                 ORDER BY time_index) - 1) / (n - 1) * {top} ELSE 0 END AS u,
          coalesce(value, avg(value) OVER (PARTITION BY c.batch_id, variable), 0) AS v
        FROM {cells} c JOIN (SELECT batch_id, min(time_index) AS t0, max(time_index) AS t1,
          count(DISTINCT time_index) AS n FROM {cells} GROUP BY batch_id) s USING (batch_id))
      WINDOW w AS (PARTITION BY batch_id, variable ORDER BY u))
    WHERE first_row OR u1 IS NOT NULL)"""


cte("aligned", ("reading_cells",), aligned_sql("reading_cells"))
cte("aligned_ids", ("aligned",), "SELECT DISTINCT batch_id FROM aligned", once=True)
cte("golden_choice", ("batches", "aligned_ids"), """
  SELECT CASE WHEN n0 >= 3 THEN 0.75 WHEN n1 >= 3 THEN 0.67 WHEN n2 >= 3 THEN 0.6
      WHEN n3 >= 3 THEN 0.5 END::DOUBLE AS golden_pct_used,
    CASE WHEN n0 >= 3 THEN c0 WHEN n1 >= 3 THEN c1 WHEN n2 >= 3 THEN c2 WHEN n3 >= 3 THEN c3 END AS yield_threshold,
    CASE WHEN n0 >= 3 THEN n0 WHEN n1 >= 3 THEN n1 WHEN n2 >= 3 THEN n2 WHEN n3 >= 3 THEN n3 END AS n_golden
  FROM (SELECT c0, c1, c2, c3, sum((yield >= c0)::INT) AS n0, sum((yield >= c1)::INT) AS n1,
      sum((yield >= c2)::INT) AS n2, sum((yield >= c3)::INT) AS n3
    FROM batches, (SELECT quantile_cont(yield, 0.75) AS c0, quantile_cont(yield, 0.67) AS c1,
      quantile_cont(yield, 0.6) AS c2, quantile_cont(yield, 0.5) AS c3 FROM batches)
    WHERE batch_id IN (SELECT batch_id FROM aligned_ids) GROUP BY ALL)""", once=True)
cte("golden_members", ("golden_choice",), """
  SELECT batch_id, golden_pct_used, yield_threshold FROM batches, golden_choice
  WHERE yield >= yield_threshold AND batch_id IN (SELECT batch_id FROM aligned_ids)""")
cte("golden_rows", ("golden_members", "aligned"), """
  SELECT * FROM aligned WHERE batch_id IN (SELECT batch_id FROM golden_members)""")
cte("erratic_rates", ("golden_rows",), """
  SELECT batch_id, variable, avg(CASE WHEN abs(value - m) / (s + 1e-9) > 2.5 THEN 1.0::DOUBLE ELSE 0 END) AS rate
  FROM golden_rows JOIN (SELECT variable, step, avg(value) AS m, stddev_pop(value) AS s
    FROM golden_rows GROUP BY variable, step) USING (variable, step)
  GROUP BY batch_id, variable""")
cte("erratic", ("erratic_rates",), """
  SELECT batch_id, worst_rate FROM (SELECT batch_id, worst_rate, count(*) OVER () AS n,
      sum((worst_rate <= 0.30)::INT) OVER () AS kept
    FROM (SELECT batch_id, max(rate) AS worst_rate FROM erratic_rates GROUP BY batch_id))
  WHERE worst_rate > 0.30 AND n >= 5 AND kept >= 3""")
cte("profile_rows", ("erratic",), """
  SELECT * FROM golden_rows WHERE batch_id NOT IN (SELECT batch_id FROM erratic)""")
# Student's t quantile: bisection over a Simpson integral of the density.
cte("t_size", ("profile_rows",), "SELECT count(DISTINCT batch_id) AS n FROM profile_rows")
cte("t_steps", ("t_size",), """
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, CAST(n - 1 AS DOUBLE) AS df FROM t_size
  UNION ALL
  SELECT i + 1, CASE WHEN area < 0.475 THEN mid ELSE lo END, CASE WHEN area < 0.475 THEN hi ELSE mid END, df
  FROM (SELECT i, lo, hi, df, (lo + hi) / 2 AS mid,
      exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (lo + hi) / 2 / 4000 / 3 *
      list_sum(list_transform(range(0, 4001), lambda k:
        (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) *
        pow(1 + pow((lo + hi) / 2 * k / 4000, 2) / df, -(df + 1) / 2))) AS area
    FROM t_steps WHERE i < 50)""")
cte("t_crit", ("t_steps",), "SELECT (lo + hi) / 2 AS t_crit FROM t_steps WHERE i = 50")
cte("profile_core", ("profile_rows",), """
  SELECT variable, step, max(time_norm) AS time_norm, avg(value) AS mean,
    stddev_pop(value) AS std, count(value) AS n_golden FROM profile_rows GROUP BY variable, step""")
cte("profile", ("profile_core", "t_crit"), """
  SELECT variable, step, time_norm, mean, std, greatest(ci, 2 * std) AS half_width,
    mean + greatest(ci, 2 * std) AS upper, mean - greatest(ci, 2 * std) AS lower,
    mean + ci AS ci_upper, mean - ci AS ci_lower,
    CASE WHEN ci > 2 * std THEN 'ci' ELSE 'sigma' END AS band_source, n_golden, t_crit
  FROM (SELECT p.*, t_crit, t_crit * std / sqrt(n_golden) AS ci FROM profile_core p, t_crit)""")
cte("phases", (), """
  SELECT * FROM (VALUES ('Startup', 0.0::DOUBLE, 0.33::DOUBLE), ('Reaction', 0.33, 0.67),
    ('Harvest', 0.67, 1.0)) AS t(phase, lo, hi)""")
cte("deviations", ("aligned", "profile"), """
  SELECT a.batch_id, a.variable, a.step, a.time_norm, a.value,
    a.value >= mean - half_width AND a.value <= mean + half_width AS inside,
    (a.value - mean) / greatest(std, 1e-9) AS z
  FROM aligned a JOIN profile p USING (variable, step)""")
cte("conformance_cpp", ("deviations",), """
  SELECT batch_id, variable, avg(CASE WHEN inside THEN 100.0::DOUBLE ELSE 0 END) AS score
  FROM deviations GROUP BY batch_id, variable""")
cte("conformance", ("conformance_cpp",), """
  SELECT batch_id, avg(score) AS overall FROM conformance_cpp GROUP BY batch_id""")
cte("features", ("reading_cells",), """
  SELECT batch_id, variable || '_' || stat AS feature, round(value, 9) AS value FROM (
    SELECT batch_id, variable, avg(value) AS mean, stddev_pop(value) AS std
    FROM reading_cells GROUP BY batch_id, variable)
  UNPIVOT INCLUDE NULLS (value FOR stat IN (mean, std))""")
cte("prepared", ("features", "batches"), """
  SELECT batch_id, feature, coalesce(value, m) AS value, yield
  FROM (SELECT f.batch_id, f.feature, f.value, b.yield, avg(f.value) OVER (PARTITION BY f.feature) AS m
    FROM features f JOIN batches b USING (batch_id))
  WHERE m IS NOT NULL AND yield IS NOT NULL""")
cte("target", ("batches",), """
  SELECT greatest(1.0, least(100.0, quantile_cont(yield, 0.75))) AS target FROM batches""")
cte("segmented", ("target",), """
  SELECT b.*, target, yield >= target AS is_target FROM batches b, target WHERE yield IS NOT NULL""")
