"""Result tables and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.base import cte, entry, twin
from checks.ranking import ranking
from trajecta.functions.numeric import rounded
from trajecta.operators import association as asn
from trajecta.operators import profile as pf
from trajecta.session import scratch_path
from trajecta.sources import ingest
from trajecta.sources.store import ResultStore, RunHeader, audit_rows, write_recipe


def _store(spark) -> ResultStore:
    return ResultStore(spark, scratch_path(spark, "results"))


def _by_nation(spark, sf_dir):
    """Batches of one run per nation of the supplier."""
    nation = fx.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("batch_id"), F.col("s_nationkey").cast("long").alias("run_id"))
    return fx.batches(spark, sf_dir).join(nation, "batch_id")


cte("owned", ("batches",), """
  SELECT b.*, CAST(s_nationkey AS BIGINT) AS run_id FROM batches b
  JOIN supplier ON CAST(s_suppkey AS VARCHAR) = batch_id""")
SAVED = "run_id, batch_id, yield_value, quality, is_golden, duration"


@entry("saved_batches", twin("""
  SELECT run_id, batch_id, CASE WHEN quality = 'Poor' AND CAST(batch_id AS BIGINT) % 4 = 0 THEN NULL
    ELSE yield END AS yield_value, quality, is_golden, duration FROM owned""", "owned"))
def saved_batches(spark, sf_dir):
    """Saved twice: the second save replaces the runs' partitions."""
    store = _store(spark)
    rows = _by_nation(spark, sf_dir).withColumn("yield", F.when(
        ~((F.col("quality") == "Poor") & (F.col("batch_id").cast("long") % 4 == 0)), F.col("yield")))
    store.save_batches(rows)
    store.save_batches(rows)
    store.assert_unique("batches", ["run_id", "batch_id"])
    return store.read("batches").select(*SAVED.split(", "))


@entry("batches_of_run", twin("""
  SELECT run_id, batch_id, yield AS yield_value, quality, is_golden, duration FROM owned WHERE run_id = 7""", "owned"))
def batches_of_run(spark, sf_dir):
    store = _store(spark)
    store.save_batches(_by_nation(spark, sf_dir))
    return store.batches(7).select(*SAVED.split(", "))


@entry("deleted_run", twin("""
  SELECT 'batches' AS table_name, run_id, count(*) AS n_rows FROM owned WHERE run_id <> 7 GROUP BY run_id
  UNION ALL SELECT 'batch_runs', run_id, 1 FROM (SELECT DISTINCT run_id FROM owned) WHERE run_id <> 7
  UNION ALL SELECT 'audit_log', CASE WHEN run_id <> 7 THEN run_id END, count(*) FROM (
    SELECT DISTINCT run_id FROM owned UNION ALL SELECT 7 WHERE EXISTS (SELECT 1 FROM owned WHERE run_id = 7))
  GROUP BY run_id""", "owned"))
def deleted_run(spark, sf_dir):
    """A deleted run takes its rows along; its audit rows lose the link."""
    store = _store(spark)
    rows = _by_nation(spark, sf_dir)
    store.save_batches(rows)
    heads = rows.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("n_batches"))
    store.save_runs(_headers(heads))
    store.audit_requests(heads.select(
        "run_id", F.lit("POST").alias("method"), F.lit("/runs").alias("path"), F.lit(200).alias("status_code")))
    store.delete_run(7)
    parts = [
        store.read(t).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table_name"), "run_id", "n_rows")
        for t in ("batches", "batch_runs", "audit_log")
    ]
    return parts[0].union(parts[1]).union(parts[2])


def _headers(counts):
    """Run headers with a creation time derived from the run id."""
    return counts.select(
        "run_id",
        F.when(F.col("run_id") % 3 == 0, F.concat(F.lit("Campaign "), "run_id")).alias("run_name"),
        F.when(F.col("run_id") % 3 != 1, F.concat(F.lit("nation_"), F.col("run_id").cast("string"), F.lit(".csv"))).alias("filename"),
        F.lit("long").alias("data_format"), "n_batches", F.lit(4).alias("n_cpps"),
        F.lit(None).cast("int").alias("n_time_steps"), F.lit(True).alias("has_yield"),
        F.lit(0.75).alias("golden_pct_used"), F.array(*map(F.lit, fx.VARIABLES)).alias("cpp_vars"),
        F.lit("{}").alias("pipeline_meta"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("run_id") * 90061).alias("created_at"),
    )


@entry("run_history", twin("""
  SELECT run_id, coalesce(CASE WHEN run_id % 3 = 0 THEN 'Campaign ' || run_id END,
      CASE WHEN run_id % 3 <> 1 THEN 'nation_' || run_id || '.csv' END, 'Run #' || run_id) AS label,
    n_batches, 4 AS n_cpps, strftime(to_timestamp(1704067200 + run_id * 90061) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS created
  FROM (SELECT run_id, CAST(count(*) AS INTEGER) AS n_batches FROM owned GROUP BY run_id)
  ORDER BY run_id DESC LIMIT 10""", "owned"))
def run_history(spark, sf_dir):
    store = _store(spark)
    counts = _by_nation(spark, sf_dir).groupBy("run_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_batches"))
    store.save_runs(_headers(counts))
    return store.runs(first=10, width=30)  # a top-k report


@entry("run_header", twin("""
  SELECT 0::BIGINT AS run_id, 'lineitem.parquet' AS filename, CAST((SELECT count(*) FROM batches) AS INTEGER) AS n_batches,
    4 AS n_cpps, 'quantity,price,discount,tax' AS variables, (SELECT max(yield) FROM batches) AS best_yield,
    action, 'success' AS status, CASE action WHEN 'pipeline_built' THEN (SELECT count(*) FROM batches)
      ELSE (SELECT count(*) FROM batches) END::BIGINT AS counted
  FROM (VALUES ('pipeline_built'), ('batches_saved')) AS t(action)""", "batches"))
def run_header(spark, sf_dir):
    """Header of run 0 and the audit rows of building and saving it."""
    store = _store(spark)
    runs = fx.batches(spark, sf_dir)
    best = runs.agg(F.max("yield")).first()[0]
    run_id = store.save_run(RunHeader(
        filename="lineitem.parquet", data_format="long", n_batches=runs.count(), n_cpps=len(fx.VARIABLES),
        has_yield=True, cpp_vars=fx.VARIABLES, facts={"best_yield": best}), run_id=0)
    store.save_batches(runs, run_id)
    heads = store.run(run_id).select(
        "run_id", "filename", "n_batches", "n_cpps", F.concat_ws(",", "cpp_vars").alias("variables"),
        F.get_json_object("pipeline_meta", "$.best_yield").cast("double").alias("best_yield"))
    counted = F.coalesce(F.get_json_object("detail", "$.rows"), F.get_json_object("detail", "$.batches"))
    return heads.join(store.audit_log(run_id).select(
        "run_id", "action", "status", counted.cast("long").alias("counted")), "run_id")


@entry("replaced_rows", twin("""
  SELECT run_id, batch_id FROM owned WHERE run_id = 7
  UNION ALL SELECT run_id, batch_id FROM owned WHERE run_id > 8""", "owned"))
def replaced_rows(spark, sf_dir):
    """An empty save empties a run; a deleted run that is saved again is back."""
    store = _store(spark)
    rows = _by_nation(spark, sf_dir).where("run_id >= 7")
    store.save_runs(_headers(rows.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("n_batches"))))
    store.save_batches(rows)
    store.save_batches(rows.where("run_id = 8").limit(0), 8)
    store.delete_run(7)
    store.save_batches(rows.where("run_id = 7"), 7)
    return store.read("batches").select("run_id", "batch_id")


@entry("unchanged_input", """
  SELECT 1::BIGINT AS run_of_same, NULL::BIGINT AS run_of_other, (SELECT count(*) FROM events) AS n_rows""")
def unchanged_input(spark, sf_dir):
    """The fingerprint finds the run of the same input in another row order, and no other."""
    store = _store(spark)
    rows = fx.event_readings(spark, sf_dir)
    first = ingest.fingerprint_text({"readings": rows})
    store.save_run(RunHeader("events", "long", 1, 1, facts={"fingerprint": first}))
    same = store.run_of(ingest.fingerprint_text({"readings": rows.orderBy(F.desc("value"))}))
    other = store.run_of(ingest.fingerprint_text({"readings": rows.withColumn("value", F.col("value") + 1)}))
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(same).cast("long").alias("run_of_same"), F.lit(other).cast("long").alias("run_of_other"), "n_rows")


@entry("saved_rankings", twin("""
  SELECT 3::BIGINT AS run_id, base_variable AS variable, CAST(rank AS INTEGER) AS rank, round(corr_score, 6) AS corr_score,
    CASE WHEN base_variable = 'tax' THEN NULL ELSE round(tree_score, 6) END AS tree_score,
    CASE WHEN base_variable = 'price' THEN NULL ELSE round(pca_score, 6) END AS pca_score,
    round(lasso_score, 6) AS lasso_score, round(weighted_score, 6) AS avg_score, method_agreement
  FROM ranking QUALIFY row_number() OVER (PARTITION BY base_variable ORDER BY ranking.rank) = 1""", "ranking"))
def saved_rankings(spark, sf_dir):
    """NaN and infinite scores are stored as NULL."""
    store = _store(spark)
    rows = rounded(asn.best_rows(ranking(spark, sf_dir)), 6, "corr_score", "tree_score", "pca_score",
                   "lasso_score", "avg_score").withColumns({
        "tree_score": F.when(F.col("variable") == "tax", float("nan")).otherwise(F.col("tree_score")),
        "pca_score": F.when(F.col("variable") == "price", float("inf")).otherwise(F.col("pca_score")),
    })
    for run_id in (2, 3, 3):
        store.save_rankings(rows, run_id)
    store.assert_unique("cpp_rankings", ["run_id", "variable"])
    return store.rankings(3).drop("created_at")


@entry("saved_profile", twin("""
  SELECT 5::BIGINT AS run_id, variable, round(avg(mean), 5) AS mean_avg, round(avg(std), 5) AS std_avg,
    round(max(upper), 5) AS upper_max, round(min(lower), 5) AS lower_min,
    (SELECT CAST(n AS INTEGER) FROM t_size) AS n_golden,
    (SELECT round(max(yield_threshold), 6) FROM golden_members) AS yield_threshold,
    (SELECT n FROM t_size) AS n_members
  FROM profile GROUP BY variable""", "profile", recursive=True))
def saved_profile(spark, sf_dir):
    store = _store(spark)
    members = pf.profile_members(fx.batches(spark, sf_dir), fx.aligned(spark, sf_dir))
    for _ in range(2):
        store.save_profile(fx.profile(spark, sf_dir), pf.profile_meta(members), 5, members)
    out = store.profile(5).select(
        "run_id", "n_golden", "yield_threshold", F.explode("cpp_stats").alias("variable", "s"))
    count = store.golden_members(5).agg(F.count(F.lit(1)).alias("n_members"))
    return rounded(out.crossJoin(count).select(
        "run_id", "n_golden", "n_members", F.round("yield_threshold", 6).alias("yield_threshold"), "variable", "s.*"), 5, "mean_avg", "std_avg", "upper_max", "lower_min")


def _requests(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        F.upper("event_type").alias("method"),
        F.concat(F.lit("/users/"), F.col("user_id").cast("string"), F.repeat(F.lit("/x"), (F.col("event_id") % 60).cast("int"))).alias("path"),
        (F.lit(200) + (F.col("event_id") % 4) * 100).cast("int").alias("status_code"),
        F.repeat(F.col("props"), 80).alias("user_agent"),
        F.col("value").cast("int").alias("duration_ms"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


cte("audit", (), """
  SELECT substr(upper(event_type) || ':/users/' || user_id || repeat('/x', CAST(event_id % 60 AS BIGINT)), 1, 100) AS action,
    'http_status=' || (200 + event_id % 4 * 100) || ' duration_ms=' || CAST(trunc(value) AS INTEGER) AS detail,
    CASE WHEN event_id % 4 < 2 THEN 'success' WHEN event_id % 4 = 2 THEN 'warning' ELSE 'failure' END AS status,
    substr(repeat(props, 80), 1, 500) AS user_agent, CAST(trunc(value) AS INTEGER) AS duration_ms,
    epoch_us(ts) AS "at" FROM events""")


@entry("audit_rows", twin("SELECT * FROM audit", "audit"))
def audit_rows_query(spark, sf_dir):
    rows = audit_rows(_requests(spark, sf_dir))
    return rows.select("action", "detail", "status", "user_agent", "duration_ms",
                       F.unix_micros("created_at").alias("at"))


@entry("audit_log_latest", twin("""
  SELECT action, detail, status, "at" FROM audit ORDER BY "at" DESC, action, detail LIMIT 100""", "audit"))
def audit_log_latest(spark, sf_dir):
    store = _store(spark)
    store.audit_requests(_requests(spark, sf_dir))
    return store.audit_log().select("action", "detail", "status", F.unix_micros("created_at").alias("at"))


@entry("recipe_csv", twin("""
  SELECT round(time_norm * 100, 1) AS time_pct, round(target_mean, 4) AS quantity_setpoint,
    round(target_lower, 4) AS quantity_lower_1sigma, round(target_upper, 4) AS quantity_upper_1sigma
  FROM curves WHERE variable = 'quantity'""", "curves"))
def recipe_csv(spark, sf_dir):
    """Written as CSV and read back."""
    curves = pf.target_trajectory(fx.aligned(spark, sf_dir), fx.segmented(spark, sf_dir))
    recipe = pf.recipe_export(curves, "quantity")
    path = scratch_path(spark, "recipe")
    write_recipe(recipe, path)
    return spark.read.option("header", True).schema(recipe.schema).csv(path)
