"""Result tables in a folder: runs, batches, rankings, profiles, audit log.

Tables are Parquet, partitioned by ``run_id``: a read of one run touches one
partition, saving it again replaces that partition (an empty save empties it),
and deleting a run removes its partitions.  Audit rows of a deleted run stay,
without the link.  Run ids are taken by creating a file, which only one writer
can do.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions.numeric import finite
from trajecta.session import cut_lineage, folder

# Names and types of the stored tables.
SCHEMAS = {
    "batch_runs": "run_id long, run_name string, filename string, data_format string, "
    "n_batches int, n_cpps int, n_time_steps int, has_yield boolean, golden_pct_used double, "
    "cpp_vars array<string>, pipeline_meta string, created_at timestamp",
    "batches": "batch_id string, yield_value double, quality string, is_golden boolean, "
    "duration int, created_at timestamp, run_id long",
    "cpp_rankings": "variable string, rank int, corr_score double, tree_score double, "
    "pca_score double, lasso_score double, avg_score double, method_agreement int, "
    "created_at timestamp, run_id long",
    "golden_profile_meta": "n_golden int, yield_threshold double, t_crit double, "
    "cpp_stats map<string,struct<mean_avg:double,std_avg:double,upper_max:double,lower_min:double>>, "
    "created_at timestamp, run_id long",
    "golden_members": "batch_id string, run_id long",
    "audit_log": "run_id long, action string, detail string, status string, ip_address string, "
    "user_agent string, duration_ms int, created_at timestamp",
}
OWNED = ("batch_runs", "batches", "cpp_rankings", "golden_profile_meta", "golden_members")


@dataclass(frozen=True)
class RunHeader:
    """What a run's row in ``batch_runs`` says; ``facts`` goes to ``pipeline_meta``."""

    filename: str
    data_format: str
    n_batches: int
    n_cpps: int
    cpp_vars: Sequence[str] = ()
    n_time_steps: int | None = None
    has_yield: bool = False
    golden_pct_used: float | None = None
    run_name: str | None = None
    facts: dict = field(default_factory=dict)


def profile_stats(profile: DataFrame) -> DataFrame:
    """One row per variable: mean level and spread, widest band."""
    return profile.groupBy("variable").agg(
        F.avg("mean").alias("mean_avg"), F.avg("std").alias("std_avg"),
        F.max("upper").alias("upper_max"), F.min("lower").alias("lower_min"),
    )


def audit_rows(requests: DataFrame) -> DataFrame:
    """Log rows from ``(method, path, status_code, ...)`` request records."""
    code = F.col("status_code")
    known = set(requests.columns)

    def optional(name: str, kind: str):
        return F.col(name).cast(kind) if name in known else F.lit(None).cast(kind)

    duration = optional("duration_ms", "int")
    # Fixed format of the stored detail.
    detail = F.concat(
        F.lit("http_status="), code.cast("string"),
        F.lit(" duration_ms="), F.coalesce(duration.cast("string"), F.lit("None")),
    )
    status = F.when(code < 400, "success").when(code < 500, "warning").otherwise("failure")
    stamp = F.col("created_at") if "created_at" in known else F.current_timestamp()
    return requests.select(
        optional("run_id", "long").alias("run_id"),
        F.substring(F.concat_ws(":", "method", "path"), 1, 100).alias("action"),
        detail.alias("detail"), status.alias("status"),
        optional("ip_address", "string").alias("ip_address"),
        F.substring(optional("user_agent", "string"), 1, 500).alias("user_agent"),
        duration.alias("duration_ms"), stamp.cast("timestamp").alias("created_at"),
    )


class ResultStore:
    """Reads and writes the result tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        """All rows of a table."""
        system, at = folder(self.spark, self._path(table))
        if not system.exists(at):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(self._path(table)).select(*_names(table))

    def _write(self, table: str, rows: DataFrame, mode: str) -> None:
        rows.select(*_names(table)).write.mode(mode).option(
            "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self._path(table))

    def _drop(self, table: str, run_id: int) -> None:
        system, at = folder(self.spark, f"{self._path(table)}/run_id={run_id}")
        system.delete(at, True)

    def _replace(self, table: str, rows: DataFrame, run_id: int | None) -> None:
        """Overwrite the runs that the rows name; ``run_id`` also if no row does."""
        if run_id is not None:
            rows = cut_lineage(rows, table)  # the rows may come from the partition that goes
            self._drop(table, run_id)
        self._write(table, rows, "overwrite")

    # ── runs ────────────────────────────────────────────────────────────────

    def take_run_id(self) -> int:
        """A free id above those in use, taken by creating its file."""
        top = self.read("batch_runs").agg(F.max("run_id")).first()[0]
        run_id = 1 if top is None else top + 1
        while True:
            system, at = folder(self.spark, f"{self.root}/_run_ids/{run_id}")
            try:
                if system.createNewFile(at):
                    return run_id
            except Exception as error:  # noqa: BLE001  only a file that is there already means taken
                if not system.exists(at):
                    raise error
            run_id += 1

    def save_run(self, header: RunHeader, run_id: int | None = None) -> int:
        """Write a run header and its audit row; returns the run id."""
        run_id = self.take_run_id() if run_id is None else run_id
        values = asdict(header)
        values["pipeline_meta"] = json.dumps(values.pop("facts"), sort_keys=True)
        schema = SCHEMAS["batch_runs"].rsplit(", ", 1)[0]
        row = tuple((values | {"run_id": run_id})[f.split()[0]] for f in _fields(schema))
        self._replace("batch_runs", _stamped(self.spark.createDataFrame([row], schema)), run_id)
        self.audit("pipeline_built", run_id, {
            "source": header.filename, "layout": header.data_format, "batches": header.n_batches})
        return run_id

    def save_runs(self, rows: DataFrame) -> None:
        """Write run headers in bulk."""
        self._write("batch_runs", _stamped(rows), "overwrite")

    def runs(self, first: int | None = None, width: int | None = None) -> DataFrame:
        """Runs with their display label, newest first; all of them unless ``first``
        is given, the label cut only to a given ``width``."""
        label = F.coalesce("run_name", "filename", F.concat(F.lit("Run #"), F.col("run_id").cast("string")))
        rows = self.read("batch_runs").orderBy(F.desc("created_at"), F.desc("run_id"))
        return (rows if first is None else rows.limit(first)).select(
            "run_id", (label if width is None else F.substring(label, 1, width)).alias("label"),
            "n_batches", "n_cpps", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"),
        )

    def run_of(self, fingerprint: str) -> int | None:
        """The newest run built from input with this fingerprint, if any."""
        row = self.read("batch_runs").where(
            F.get_json_object("pipeline_meta", "$.fingerprint") == fingerprint).agg(F.max("run_id")).first()
        return row[0]

    def run(self, run_id: int) -> DataFrame:
        return self.read("batch_runs").where(F.col("run_id") == run_id)

    def delete_run(self, run_id: int) -> bool:
        """Remove a run and everything it owns; False when it is not there."""
        header = self.run(run_id).select("run_name", "filename").first()
        if header is None:
            return False
        self.audit("run_deleted", run_id, {"run": run_id, "name": header["run_name"] or header["filename"]})
        unlinked = self.read("audit_log").where(F.col("run_id") == run_id).withColumn(
            "run_id", F.lit(None).cast("long"))
        self._write("audit_log", cut_lineage(unlinked, "unlinked"), "append")
        for table in ("audit_log", *OWNED):
            self._drop(table, run_id)
        return True

    # ── rows a run owns ─────────────────────────────────────────────────────

    def save_batches(self, batches: DataFrame, run_id: int | None = None) -> None:
        """Replace the batches of the run, or of every run the rows name."""
        rows = batches if run_id is None else batches.withColumn("run_id", F.lit(run_id))
        self._replace("batches", _stamped(rows.select(
            F.col("run_id").cast("long").alias("run_id"),
            F.col("batch_id").cast("string").alias("batch_id"),
            finite(F.col("yield")).alias("yield_value"),
            F.coalesce("quality", F.lit("Unknown")).alias("quality"),
            F.coalesce("is_golden", F.lit(False)).alias("is_golden"),
            F.col("duration").cast("int").alias("duration"),
        )), run_id)
        if run_id is not None:
            self.audit("batches_saved", run_id, {"rows": self.batches(run_id).count()})

    def batches(self, run_id: int) -> DataFrame:
        return self.read("batches").where(F.col("run_id") == run_id).orderBy("batch_id")

    def save_rankings(self, ranking: DataFrame, run_id: int) -> None:
        """Replace the rankings of a run, one row per variable."""
        scores = ("corr_score", "tree_score", "pca_score", "lasso_score", "avg_score")
        self._replace("cpp_rankings", _stamped(ranking.select(
            F.lit(run_id).cast("long").alias("run_id"), "variable", F.col("rank").cast("int").alias("rank"),
            *[finite(F.col(c)).alias(c) for c in scores],
            F.col("method_agreement").cast("int").alias("method_agreement"),
        )), run_id)
        self.audit("cpp_rankings_saved", run_id, {"rows": self.rankings(run_id).count()})

    def rankings(self, run_id: int) -> DataFrame:
        return self.read("cpp_rankings").where(F.col("run_id") == run_id).orderBy("rank")

    def save_profile(
        self, profile: DataFrame, meta: DataFrame, run_id: int, members: DataFrame | None = None
    ) -> None:
        """Replace the profile summary of a run, and its golden batches."""
        if members is not None:
            self._replace("golden_members", members.select(
                "batch_id", F.lit(run_id).cast("long").alias("run_id")), run_id)
        entry = F.struct("variable", F.struct("mean_avg", "std_avg", "upper_max", "lower_min"))
        stats = profile_stats(profile).agg(F.map_from_entries(F.collect_list(entry)).alias("cpp_stats"))
        self._replace("golden_profile_meta", _stamped(meta.crossJoin(stats).select(
            F.lit(run_id).cast("long").alias("run_id"), F.col("n_golden").cast("int").alias("n_golden"),
            finite(F.col("yield_threshold")).alias("yield_threshold"), finite(F.col("t_crit")).alias("t_crit"),
            "cpp_stats",
        )), run_id)
        self.audit("golden_profile_saved", run_id, {"golden_batches": self.golden_members(run_id).count()})

    def profile(self, run_id: int) -> DataFrame:
        return self.read("golden_profile_meta").where(F.col("run_id") == run_id)

    def golden_members(self, run_id: int) -> DataFrame:
        return self.read("golden_members").where(F.col("run_id") == run_id)

    # ── audit ───────────────────────────────────────────────────────────────

    def audit(self, action: str, run_id: int | None = None, detail: dict | None = None,
              status: str = "success") -> None:
        row = self.spark.createDataFrame(
            [(run_id, action, json.dumps(detail or {}, sort_keys=True), status, None, None, None)],
            SCHEMAS["audit_log"].rsplit(", ", 1)[0])
        self._write("audit_log", _stamped(row), "append")

    def audit_requests(self, requests: DataFrame) -> None:
        self._write("audit_log", audit_rows(requests), "append")

    def audit_log(self, run_id: int | None = None, first: int = 100) -> DataFrame:
        """Newest log rows, optionally of one run (a top-k report)."""
        rows = self.read("audit_log")
        if run_id is not None:
            rows = rows.where(F.col("run_id") == run_id)
        return rows.orderBy(F.desc("created_at"), "action", "detail").limit(first)

    def assert_unique(self, table: str, keys: Sequence[str]) -> None:
        """Raise when the rows of a table break their key."""
        broken = self.read(table).groupBy(*keys).count().where("count > 1").limit(1).count()
        if broken:
            raise ValueError(f"{table} has duplicate keys over {', '.join(keys)}")


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def _names(table: str) -> list[str]:
    return [f.split()[0] for f in _fields(SCHEMAS[table])]


def _stamped(rows: DataFrame) -> DataFrame:
    return rows if "created_at" in rows.columns else rows.withColumn("created_at", F.current_timestamp())


def write_recipe(recipe: DataFrame, path: str) -> None:
    """The setpoint table as one CSV with a header (a grid of steps)."""
    recipe.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
