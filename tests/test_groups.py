"""Groups of specifications against a plain loop, and stateful sessions against the batch result after a restart."""

import random

from pyspark.sql import functions as F

from textloom.operators import spec_groups
from textloom.streaming import events, sessions


def plain(starts, categories, properties):
    related = lambda i, j: (starts[i] is not None and starts[j] is not None and abs(starts[i] - starts[j]) < 300) or categories[i] == categories[j] or bool(set((properties[i] or "").lower().split()) & set((properties[j] or "").lower().split()))
    used, out = set(), []
    for i in range(len(starts)):
        if i not in used:
            group = [i] + [j for j in range(len(starts)) if j != i and j not in used and related(i, j)]
            used.update(group)
            out.append(sorted(group))
    return out


def test_groups_of():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 25)
        starts = sorted((rng.choice([None, *range(0, 6000, 50)]) for _ in range(n)), key=lambda s: -1 if s is None else s)
        categories = [rng.choice([None, *range(12)]) for _ in range(n)]
        properties = [rng.choice([None, "", "pH", "Bulk density", "tapped Density", "shelf life", f"p{rng.randint(0, 30)}"]) for _ in range(n)]
        assert spec_groups.groups_of(starts, categories, properties) == plain(starts, categories, properties)


def test_many_specifications_in_time():
    import time

    began = time.time()
    n = 100_000
    groups = spec_groups.groups_of([i * 10 for i in range(n)], list(range(n)), [f"p{i}" for i in range(n)])
    assert sum(map(len, groups)) == n and time.time() - began < 20


def test_compound_specifications(spark, folder):
    from textloom.operators import compounds
    from textloom.plans import compounds as stated
    from textloom.plans import registry

    specs = compounds.food_specifications(stated._rows(spark, folder), "doc_id", "text").collect()
    want = {}
    for key in {r["doc_id"] for r in specs}:
        own = sorted((r for r in specs if r["doc_id"] == key), key=lambda r: (r["start"], r["end"], r["property"], r["value"]))
        for g in plain([r["start"] for r in own], [r["category"] for r in own], [r["property"] for r in own]):
            if len(g) > 1:
                mean = sum(own[i]["confidence"] for i in g) / len(g)
                best = max(g, key=lambda i: own[i]["confidence"])
                want[key, g[0]] = (own[best]["property"], len(g), round(mean, 6), " | ".join(own[i]["context"] for i in g), round(min(1.0, 0.8 + 0.1 * (len(g) > 2) + 0.1 * mean), 6))
    got = {(r["doc_id"], r["seed"]): (r["main_property"], r["size"], r["confidence"], r["contexts"], r["preservation"]) for r in registry.queries()["compound_specifications"](spark, folder).collect()}
    assert got == want and len(got) >= 4
    assert spec_groups.compound_specifications(compounds.food_specifications(stated._rows(spark, folder).limit(0), "doc_id", "text"), "doc_id").count() == 0


def test_sessions_across_restart(spark, folder, tmp_path):
    """Two runs from one checkpoint, files out of order and events repeated, send out the sessions of the batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("value").cast("double").alias("value"), F.col("props").cast("string").alias("props"))
    rows = rows.where("event_id % 3 = 0")
    cut = rows.agg(F.expr("percentile(unix_micros(cast(ts AS timestamp)), 0.5)")).first()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= cut
    source = str(tmp_path / "in")

    def run():
        stream = sessions.user_sessions(events.read_events(spark, source), 1800, "40 days")  # files are out of order by weeks
        events.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    rows.where(~early).coalesce(1).write.mode("append").parquet(source)
    run()
    odd = spark.createDataFrame([(-1, None, 1, "x", 1.0, None), (-2, None, None, "x", 1.0, None)], rows.schema)
    rows.where(early).union(rows.where(~early).limit(5)).union(odd).coalesce(1).write.mode("append").parquet(source)
    run()
    last = spark.createDataFrame([(-9, 999, "end", 0.0)], "event_id long, user_id long, event_type string, value double").select("event_id", F.to_timestamp_ntz(F.lit("2024-09-01 00:00:00")).alias("ts"), "user_id", "event_type", "value", F.lit(None).cast("string").alias("props"))
    last.coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    told = lambda df: sorted((r["user_id"], str(r["started"]), str(r["ended"]), r["n_events"], round(r["total_value"], 3), r["types"]) for r in df.collect())
    got = told(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
    assert got == told(sessions.batch_sessions(rows.withColumn("ts", F.col("ts").cast("timestamp")))) and len(got) > 50
