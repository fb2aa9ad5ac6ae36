"""Runs of the chain: their log, what it says to readers, and the chain itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.functions import timegeo as T

#: The stages of a chain.
STAGES = ("ingest_who", "ingest_ecdc", "discover", "retrieve", "dedupe", "triage", "embed", "pregroup", "extract", "geocode", "match", "summarize")
OUTCOMES = "stage string, ok boolean, error string, counts map<string,bigint>"


def counts_of(json: Column) -> Column:
    """The whole numbers of a JSON object, by name; other values, booleans among them, are left out."""
    v = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    whole = F.map_filter(v, lambda k, x: F.schema_of_variant(x) == "BIGINT")
    return F.coalesce(F.transform_values(whole, lambda k, x: F.variant_get(x, "$", "bigint")), F.create_map().cast("map<string,bigint>"))


def stage_counts_of(json: Column) -> Column:
    """counts_of for each member of a JSON object that is an object itself."""
    v = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    objects = F.map_filter(v, lambda k, x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    return F.coalesce(F.transform_values(objects, lambda k, x: counts_of(F.to_json(x))), F.create_map().cast("map<string,map<string,bigint>>"))


def failures_of(json: Column) -> Column:
    """Failed stages (stage, error) of a JSON list that holds names or objects: unknown stages are dropped, and of an error
    no more than a class name is kept."""
    v = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")

    def one(x: Column) -> Column:
        plain = F.schema_of_variant(x) == "STRING"
        stage = F.when(plain, F.try_variant_get(x, "$", "string")).when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$.stage", "string"))
        error = F.when(~plain, X.exception_name(F.btrim(F.try_variant_get(x, "$.error", "string"))))
        return F.struct(stage.alias("stage"), error.alias("error"))

    return F.coalesce(F.filter(F.transform(v, one), lambda f: F.coalesce(f["stage"].isin(*STAGES), F.lit(False))), F.array().cast("array<struct<stage:string,error:string>>"))


def pipeline_runs(runs: DataFrame, now: Column, stale_minutes: int, limit: int = 20) -> DataFrame:
    """The latest runs (run_id, status, started_at, finished_at and JSON columns stage_counts, backlog, failed_stages), with
    what their JSON soundly says and whether a run looks dead."""
    page = runs.orderBy(F.desc("started_at"), "run_id").limit(limit)
    return page.withColumns({
        "stage_counts": stage_counts_of(F.col("stage_counts")), "backlog": counts_of(F.col("backlog")), "failures": failures_of(F.col("failed_stages")),
        "is_stale": T.stale_run(F.col("status"), F.col("finished_at"), F.col("started_at"), now, stale_minutes),
    }).drop("failed_stages")


def last_window_end(runs: DataFrame, chain: str) -> DataFrame:
    """One row: the window's end of the chain's latest run that is not running and had a window."""
    return runs.where((F.col("chain") == chain) & F.col("window_end").isNotNull() & (F.col("status") != "running")).agg(F.max_by("window_end", "started_at").alias("window_end"))


def started(runs: DataFrame, run: DataFrame) -> DataFrame:
    """The log with a run added that is running."""
    return runs.unionByName(run.withColumn("status", F.lit("running")), allowMissingColumns=True)


def finished(runs: DataFrame, outcomes: DataFrame, run_id: int, at: Column, backlog: DataFrame) -> DataFrame:
    """The log with a run finished: its stages' outcomes (as run_chain gives them) and the backlog (status, n) as JSON. It
    failed if all stages did, was partial if some did."""
    end = outcomes.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.when(F.col("ok"), F.struct("stage", "counts"))))).alias("_counts"),
        F.to_json(F.collect_list(F.when(~F.col("ok"), F.struct("stage", "error")))).alias("_failed"), F.count_if("ok").alias("_ok"), F.count("*").alias("_all"),
    )
    depth = backlog.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("status", "n")))).alias("_backlog"))
    j = runs.crossJoin(F.broadcast(end)).crossJoin(F.broadcast(depth))  # one row each
    own = F.col("run_id") == run_id
    status = F.when(F.col("_ok") == F.col("_all"), "succeeded").when(F.col("_ok") == 0, "failed").otherwise("partial")
    set_ = {"status": status, "finished_at": at, "stage_counts": F.col("_counts"), "failed_stages": F.col("_failed"), "backlog": F.col("_backlog")}
    return j.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in set_.items()}).select(runs.columns)


def run_chain(spark: SparkSession, stages: list[tuple[str, Callable[[], dict[str, int]]]]) -> DataFrame:
    """Run every stage in order; one that fails is recorded by its exception's class, and the others still run."""
    rows = []
    for name, stage in stages:
        try:
            rows.append((name, True, None, {k: int(v) for k, v in stage().items()}))
        except Exception as e:  # noqa: BLE001  any fault of a stage is its own
            rows.append((name, False, type(e).__name__, None))
    return spark.createDataFrame(rows, OUTCOMES)


def paced(requests: DataFrame, host: str, order: list[str], now: Column, seconds: float, most: int) -> DataFrame:
    """The first `most` requests, each with the time at which it may go: a host's requests are seconds apart. The limit of a
    run is the feature."""
    page = requests.orderBy(*order).limit(most)
    turn = F.row_number().over(Window.partitionBy(host).orderBy(*order)) - 1
    return page.withColumn("due_at", F.timestamp_micros((F.unix_micros(now) + turn * int(seconds * 1_000_000)).cast("long")))


def guarded_cases(cases: DataFrame, order: str, cost: str, most: float) -> DataFrame:
    """Cases of a model comparison by model, taken in order until their cost has used the budget up; the rest is not run."""
    spent = F.sum(cost).over(Window.partitionBy("model").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return cases.withColumn("ran", F.coalesce(spent, F.lit(0)) < most)
