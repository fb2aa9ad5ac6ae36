"""Calls are paid for once, and a budget holds for the whole run."""

import os
import sys
from collections import Counter, namedtuple

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from harrier.operators import ledger as L
from harrier.operators.spans import running_total

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module
Row = namedtuple("Row", "id key model prompt fault")
CHECK = lambda content, body: F.when(~F.contains(content, body), "thin")


def counted(path):
    def call(model, prompt, fault):
        with open(f"{path}/{os.getpid()}", "a") as f:
            f.write(f"{model}|{prompt}|{fault}\n")
        return (f"{model} {prompt} {'again' if fault else ''}", len(prompt), 2)

    return call


def made(path):
    return Counter(line.strip() for name in os.listdir(path) for line in open(f"{path}/{name}"))


def test_a_task_that_is_tried_again_asks_for_nothing_twice(tmp_path):
    rows, asked = [Row(str(i), f"k{i}", "m", f"p{i}", None) for i in range(9)], Counter()

    def call(model, prompt, fault):
        asked[prompt] += 1
        if prompt == "p5" and asked[prompt] == 1:
            raise OSError("lost")
        return (prompt, 1, 1)

    folder, got = f"{tmp_path}/part-0", []
    with pytest.raises(OSError):
        for r in L.answered(iter(rows), call, folder, "try-1"):
            got.append(r)
    assert len(got) == 5
    with open(f"{folder}/try-1.jsonl", "ab") as f:
        f.write(b'["k6", "half a li')  # what a lost task was writing
    assert [r[:3] for r in L.answered(iter(rows), call, folder, "try-2")] == [(str(i), f"k{i}", f"p{i}") for i in range(9)]
    assert asked == Counter({f"p{i}": 1 for i in range(9)} | {"p5": 2})
    assert len(list(L.answered(iter(rows), call, folder, "try-3"))) == 9 and sum(asked.values()) == 10


@pytest.mark.parametrize("parts", [1, 5])
def test_budget_of_a_run(spark, tmp_path, parts):
    """Half of the prompts are sound at the second try; equal prompts are asked once; the budget is used up to the last
    call, however the requests are partitioned; a second run pays for the rest only."""
    (tmp_path / "calls").mkdir()
    rows = [(f"r{i:02d}", f"p{i % 16}", "again" if i % 2 else "m") for i in range(20)]
    requests = spark.createDataFrame(rows, "id string, prompt string, body string").repartition(parts)
    call, ledger = counted(tmp_path / "calls"), lambda: L.Ledger(spark, f"file://{tmp_path}/ledger")
    done = L.climb_within(requests, [("m", 1)], call, CHECK, 19, ledger())
    got = done.collect()
    assert sum(r.paid for r in got) == 19 == sum(made(tmp_path / "calls").values()) and max(made(tmp_path / "calls").values()) == 1
    assert [tuple(r) for r in L.cost_rows(done).select("n_calls").collect()] == [(19,)]
    assert L.run_status(done).first().status == "partial"
    accepted = {r.id for r in got if r.outcome == "accepted"}
    assert {i for i, _, b in rows if b == "m"} <= accepted and len(accepted) == 10 + 5  # of the odd ones: three that pay, and two with the same prompts
    after = L.climb_within(requests, [("m", 1)], call, CHECK, 1000, ledger())
    assert {r.id for r in after.collect() if r.outcome == "accepted"} == {r[0] for r in rows}
    assert sum(made(tmp_path / "calls").values()) == 16 + 8 and max(made(tmp_path / "calls").values()) == 1
    assert L.run_status(after).first().status == "succeeded" and after.where("paid").count() == 5


def test_costs_by_tokens(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    requests = spark.createDataFrame([(f"r{i}", "x" * (10 * (i + 1)), "m") for i in range(6)], "id string, prompt string, body string")
    done = L.climb_within(requests, [("m", 1)], counted(tmp_path / "calls"), CHECK, 60, L.Ledger(spark, f"file://{tmp_path}/ledger"), F.length("prompt"), F.col("tokens_in"))
    assert sorted((r.id, r.outcome) for r in done.collect()) == [(f"r{i}", "accepted" if i < 3 else "deferred") for i in range(6)]
    assert done.where("paid").agg(F.sum("tokens_in")).first()[0] == 60


def test_nothing_to_ask(spark, tmp_path):
    none = spark.createDataFrame([], "id string, prompt string, body string")
    done = L.climb_within(none, [("m", 1)], lambda *a: ("", 0, 0), CHECK, 5, L.Ledger(spark, f"file://{tmp_path}/ledger"))
    assert done.count() == 0 and L.run_status(done).first().n_requests == 0


def test_running_total(spark):
    rows = [(i * 7 % 101, i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    total, want = 0, []
    for k, v in sorted(rows):
        total += v
        want.append((k, v, total))
    assert sorted(map(tuple, running_total(df, ["k"], F.col("v"), "t").collect())) == want
