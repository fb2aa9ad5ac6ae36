"""Model calls that are paid for once: a ledger of answers, and one budget for a whole run.

A call is known by the digest of its model, prompt and fault. Before it is made, the ledger is looked up; an answer that is
there is used again. Tasks log each answer in the shared folder as it comes, so a task that is tried again finds what the
one before it was answered, and only the call that was under way can be made twice.

The ladder is climbed in rounds. In each, every open request has its next call, and what is left of the budget is dealt to
them in order by running sums of what they are expected to cost. Nothing is left over in a partition that needs less.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.operators.graph import step_table
from harrier.operators.spans import running_total

CALLS = "id string, key string, content string, tokens_in long, tokens_out long, paid boolean"
ANSWERS = "key string, content string, tokens_in long, tokens_out long"
ATTEMPTS = "id string, round int, model string, tier int, attempt int, outcome string, reason string, content string, tokens_in long, tokens_out long, paid boolean"
Call = Callable[[str, str, str], tuple[str, int, int]]


def call_key(model: Column | str, prompt: Column, fault: Column) -> Column:
    model = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat_ws("\x1f", model, prompt, F.coalesce(fault, F.lit(""))), 256)


def _disk(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_log(folder: str) -> dict[str, tuple[str, int, int]]:
    """The answers that tasks of one round and part have logged, whole lines only."""
    from pyarrow import fs

    disk, root = _disk(folder)
    out = {}
    for f in disk.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        with disk.open_input_stream(f.path) as s:
            for line in s.read().split(b"\n")[:-1]:
                key, *answer = json.loads(line)
                out[key] = tuple(answer)
    return out


def answered(rows: Iterator, call: Call, folder: str, attempt: str) -> Iterator[tuple]:
    """(id, key, answer, paid) of rows (id, key, model, prompt, fault): answers of an earlier try of this task are taken
    from its log, others are asked for and logged before the next."""
    known = read_log(folder)
    disk, root = _disk(folder)
    log = None
    try:
        for r in rows:
            if r.key not in known:
                known[r.key] = tuple(call(r.model, r.prompt, r.fault or ""))
                if log is None:
                    disk.create_dir(root, recursive=True)
                    log = disk.open_output_stream(f"{root}/{attempt}.jsonl")
                log.write(json.dumps([r.key, *known[r.key]]).encode() + b"\n")
                log.flush()
            yield (r.id, r.key, *known[r.key], True)
    finally:
        if log is not None:
            log.close()


def _asked(call: Call, folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ctx = TaskContext.get()
        rows = (r for frame in frames for r in frame.itertuples(index=False))
        names, out = [c.split()[0] for c in CALLS.split(", ")], []
        for row in answered(rows, call, f"{folder}/part-{ctx.partitionId():05d}", f"{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"):
            out.append(row)
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


class Ledger:
    """Answers by key, in a folder that all tasks share: a table of the answers of earlier rounds, and the tasks' logs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.run = spark, path.rstrip("/"), uuid.uuid4().hex[:12]

    def answers(self) -> DataFrame:
        """One answer a key; of several, the least."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/answers")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ANSWERS)
        stored = self.spark.read.schema(ANSWERS).parquet(f"{self.path}/answers")
        return stored.groupBy("key").agg(F.min(F.struct("content", "tokens_in", "tokens_out")).alias("a")).select("key", "a.*")

    def append(self, calls: DataFrame) -> None:
        calls.where("paid").select("key", "content", "tokens_in", "tokens_out").write.mode("append").parquet(f"{self.path}/answers")

    def ask(self, wanted: DataFrame, call: Call, number: int) -> DataFrame:
        """CALLS of wanted (id, key, model, prompt, fault), written: of equal keys one is asked for, by the least id, and
        only what the ledger does not have."""
        known = self.answers()
        first = wanted.groupBy("key").agg(F.min("id").alias("id"))
        new = wanted.join(known.select("key"), "key", "left_anti").join(first, ["key", "id"], "left_semi")
        # What a task has logged belongs to its part, so parts must not change when it is tried again: a written table.
        parts = step_table(self.spark, new.select("id", "key", "model", "prompt", "fault").repartition(F.col("key")), "wanted")
        asked = step_table(self.spark, parts.mapInPandas(_asked(call, f"{self.path}/log-{self.run}-{number}"), CALLS), "asked")
        self.append(asked)
        answers = asked.select("key", "content", "tokens_in", "tokens_out", F.col("id").alias("payer")).unionByName(known.withColumn("payer", F.lit(None).cast("string")))
        return wanted.select("id", "key").join(answers, "key").select("id", "key", "content", "tokens_in", "tokens_out", F.coalesce(F.col("payer") == F.col("id"), F.lit(False)).alias("paid"))


def climb_within(requests: DataFrame, ladder: list[tuple[str, int]], call: Call, check: Callable[[Column, Column], Column], budget: float, ledger: Ledger, expected: Column | None = None, cost: Column | None = None) -> DataFrame:
    """ATTEMPTS of requests (id, prompt, body): each rung (model, tier) is asked once and, with the fault named, once more,
    until an answer has no fault. check gives a fault or null for the columns content and body.

    budget: what all calls of this run may cost. expected: a call's cost before it is made (1 unless given), of the columns
    model, prompt and fault; cost: after it, of tokens_in and tokens_out (expected's unless given). Answers that the ledger
    has cost nothing. A request whose call is not dealt anything comes out once more as deferred."""
    spark = requests.sparkSession
    expected = F.lit(1) if expected is None else expected
    steps = [(m, t, k) for m, t in ladder for k in (1, 2)]
    at = lambda what: F.element_at(F.array(*[F.lit(s[what]) for s in steps]), F.col("step") + 1)
    open_ = step_table(spark, requests.select(F.col("id").cast("string").alias("id"), "prompt", "body", F.lit(0).alias("step"), F.lit(None).cast("string").alias("fault")), "open")
    found, left, number = [], budget, 0
    while True:
        number += 1
        # A rung's first try is asked without the fault of the rung before.
        todo = open_.where(F.col("step") < len(steps)).select("*", at(0).alias("model"), at(1).alias("tier"), at(2).alias("attempt")).withColumn("fault", F.when(F.col("attempt") == 2, F.col("fault")))
        todo = todo.withColumn("key", call_key(F.col("model"), F.col("prompt"), F.col("fault")))
        known = ledger.answers().select("key").withColumn("known", F.lit(True))
        first = todo.groupBy("key").agg(F.min("id").alias("payer"))
        free = F.coalesce("known", F.lit(False)) | (F.col("payer") != F.col("id"))
        priced = todo.join(known, "key", "left").join(first, "key").withColumn("price", F.when(free, F.lit(0)).otherwise(expected)).drop("known", "payer")
        dealt = step_table(spark, running_total(priced, ["step", "id"], F.col("price"), "through"), "dealt")
        go = dealt.where((F.col("through") <= left) | (F.col("price") == 0))
        # An equal call that another pays for waits with it.
        paying = go.where("price > 0").select("key").unionByName(ledger.answers().select("key")).distinct()
        go = go.join(paying, "key", "left_semi")
        if go.isEmpty():
            break
        calls = step_table(spark, ledger.ask(go.select("id", "key", "model", "prompt", "fault"), call, number), "calls")
        spent = calls.where("paid").join(go.select("id", "price"), "id").agg(F.sum(F.col("price") if cost is None else cost)).first()[0] or 0
        left -= spent
        judged = go.join(calls.drop("key"), "id").withColumn("reason", check(F.col("content"), F.col("body")))
        judged = step_table(spark, judged, "judged")
        outcome = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
        found.append(judged.select("id", F.lit(number).alias("round"), "model", "tier", "attempt", outcome.alias("outcome"), "reason", "content", "tokens_in", "tokens_out", "paid"))
        again = judged.where("reason IS NOT NULL").select("id", "prompt", "body", (F.col("step") + 1).alias("step"), F.col("reason").alias("fault"))
        waiting = dealt.join(go.select("id"), "id", "left_anti").select("id", "prompt", "body", "step", "fault")
        open_ = step_table(spark, again.unionByName(waiting), "open")
    put_off = todo.select("id", F.lit(number).alias("round"), "model", "tier", "attempt", F.lit("deferred").alias("outcome"), F.lit("budget").alias("reason"), F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"), F.lit(False).alias("paid"))
    return reduce(DataFrame.unionByName, [*found, put_off])


def cost_rows(attempts: DataFrame) -> DataFrame:
    """What a run's calls are booked as, by model: calls that were paid for, and their tokens."""
    return attempts.where("paid").groupBy("model", "tier").agg(F.count("*").alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def run_status(attempts: DataFrame) -> DataFrame:
    """One row: succeeded if every request has its last word, partial if the budget put some off, failed if it put off all
    before any answer; with how many requests there were and how many were put off."""
    last = attempts.groupBy("id").agg(F.max(F.struct("round", "outcome")).alias("l"), F.count_if(F.col("outcome") != "deferred").alias("n"))
    g = last.agg(F.count("*").alias("n_requests"), F.count_if(F.col("l.outcome") == "deferred").alias("n_deferred"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_attempts"))
    status = F.when(F.col("n_deferred") == 0, "succeeded").when(F.col("n_attempts") == 0, "failed").otherwise("partial")
    return g.withColumn("status", status)
