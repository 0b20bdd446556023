"""Related specifications as one, and sessions of users as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import compounds, spec_groups
from textloom.plans import compounds as stated
from textloom.plans.registry import query
from textloom.sources.tables import load
from textloom.streaming import sessions


@query()
def compound_specifications(spark, folder):
    """Groups of food specifications in the documents and the stated texts; seed-ordered, tested against a plain loop."""
    found = compounds.food_specifications(stated._rows(spark, folder), "doc_id", "text")
    return spec_groups.compound_specifications(found, "doc_id")


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    m AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM e),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
    SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n_events, round(sum(coalesce(value, 0)), 4) AS total_value, list_sort(list(DISTINCT event_type))::VARCHAR AS types
    FROM s GROUP BY user_id, session""")
def session_histories(spark, folder):
    """What the stateful stream sends out once every session is closed."""
    found = sessions.batch_sessions(load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    listed = F.concat(F.lit("["), F.array_join("types", ", "), F.lit("]"))
    return found.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n_events", "total_value", listed.alias("types"))
