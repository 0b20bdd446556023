"""Costs are summed exactly, so that ties come out alike in any order of rows."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__
from textloom.operators import cost


def test_ties_of_efficiency_are_exact(spark, tmp_path):
    rng, rows = random.Random(5), []
    for user in range(60):
        cents = [rng.randrange(1, 600) for _ in range(49)]
        short = 50 * 320 - sum(cents)
        rows += [(user, c / 100, 5) for c in rng.sample([*cents, short], 50)]  # 5 / (3.20 * 1000) is 0.0015625
    table = {"event_id": range(len(rows)), "ts": [datetime.datetime(2024, 1, 30)] * len(rows), "user_id": [r[0] for r in rows], "event_type": ["view"] * len(rows), "value": [r[1] for r in rows], "props": [f'{{"k": {r[2]}}}' for r in rows]}
    pq.write_table(pa.table({k: list(v) for k, v in table.items()}), tmp_path / "events.parquet")
    found = __spark_entry__.queries()["cost_efficiency"](spark, str(tmp_path)).collect()
    assert {r.efficiency for r in found} == {0.001563} and len(found) == 60


def test_totals_of_any_costs(spark):
    rows = [(1, 0.1), (1, 0.2), (1, 0.3), (1, None), (2, 1e-15), (2, 1e-15), (3, 1e300), (3, 1.0), (4, None), (5, float("nan")), (5, 1.0)]
    found = {r.k: r.s for r in spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(cost.total(F.col("v")).alias("s")).collect()}
    assert found[1] == 0.6 and found[2] == 2e-15 and found[3] == 1e300 and found[4] is None and found[5] != found[5]
