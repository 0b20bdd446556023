"""Operators on small stated inputs."""

import difflib

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.vectors import cosine, trigram_similarity
from textloom.operators import chunking, classify, clusters, cost, extraction, graph, maintenance, providers, quality, relations, search
from textloom.sources.tables import matching, text_match


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clean_text(spark):
    raw = "Page 3 of 9\n12345\nabc\n  Loss   on drying 5 %  \nSecond line here"
    assert one(spark, X.clean(F.lit(raw))) == "Loss on drying 5 % Second line here"
    assert one(spark, X.clean(F.lit(""))) == ""


def test_normalize(spark):
    assert one(spark, X.normalized_product(F.lit("NPK-20-20"))) == "NPK 20 20"
    assert one(spark, X.normalized_product(F.lit("green_leaf feed mix plus"))) == "Green Leaf Feed Mix Plus"
    assert one(spark, X.normalized_specification(F.lit("pH=6.5-7.0"))) == "pH 6.5-7.0"
    assert one(spark, X.normalized_specification(F.lit("25 percent of 3 kilograms"))) == "25% of 3 kg"


def test_length_score(spark):
    for t, want in (("", 0.0), ("ab", 0.1), ("short name", 1.0), ("a b c d e f g", 0.3), ("x" * 40, 0.8), ("x" * 60, 0.6)):
        assert one(spark, X.length_score(F.lit(t))) == want


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(spark, cosine(a, b)) - 0.5**0.5) < 1e-12
    assert one(spark, cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, trigram_similarity(F.lit("word"), F.lit("word"))) == 1.0
    assert 0 < one(spark, trigram_similarity(F.lit("word"), F.lit("two words"))) < 1


def test_classify(spark):
    assert one(spark, classify.intent(F.lit("What is the dose?"))) == "definition"
    assert one(spark, classify.intent(F.lit("hello"))) == "general"
    assert one(spark, classify.domain(F.lit("allergen and nutrition facts"))) == "food"
    assert one(spark, classify.domain(F.lit("nothing"))) == "agricultural"
    assert one(spark, classify.mode(F.lit("pH"))) == "simple"
    assert one(spark, classify.mode(F.lit("a b c d e f g h i j k and? more?"))) == "hybrid"
    assert one(spark, classify.language(F.lit("der Hund und die Katze"))) == "de"


def test_splitter():
    text = ("Sentence number one. " * 100).strip()
    parts = chunking.split_text(text, 300, 40)
    assert all(len(t) <= 300 for _, t in parts)
    assert all(text[a:].lstrip().startswith(t[:50]) for a, t in parts)
    covered = set()
    for a, t in parts:
        covered |= set(range(text.index(t, a), text.index(t, a) + len(t)))
    assert all(text[i].isspace() or i in covered for i in range(len(text)))
    assert chunking.split_text("") == [] and chunking.split_text("abc") == [(0, "abc")]
    assert [len(t) for _, t in chunking.split_text("x" * 1000, 300, 0)] == [300, 300, 300, 100]


def test_splitter_frame(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "k int, t string")
    assert [tuple(r) for r in chunking.split_documents(df, "k", "t").collect()] == [(1, 0, 0, "a b c")]


def test_pipe_tables(spark):
    df = spark.createDataFrame([(1, "x\n| a | b |\n| 1 | 2 |\ny\n| c | d | e |")], "k int, t string")
    got = sorted(tuple(r) for r in chunking.pipe_tables(df, "k", "t").select("first_line", "n_rows", "n_columns", "header").collect())
    assert got == [(1, 2, 4, "| a | b |"), (4, 1, 5, "| c | d | e |")]


def test_spans_and_relations(spark):
    text = "Composition: 25% active, pH 6.5-7.0, apply 2.5 kg/ha. Storage at 25 °C. CAS 123-45-6, H300."
    df = spark.createDataFrame([(1, text), (2, None)], "k int, t string")
    found = extraction.scored(extraction.spans(df, "k", "t"))
    rows = {r["kind"]: r for r in found.collect()}
    assert rows["ph"]["value"] == "pH 6.5-7.0" and rows["mass"]["value"] == "2.5 kg/ha" and rows["cas_number"]["value"] == "123-45-6"
    assert text[rows["percent"]["start"] : rows["percent"]["end"]] == "25%"
    assert all(0.3 <= r["confidence"] <= 1 for r in rows.values())
    near = extraction.near_pairs(found, "k", ["mass"], ["percent", "ph"]).collect()
    assert {(r["source_value"], r["target_value"]) for r in near} == {("2.5 kg/ha", "25%"), ("2.5 kg/ha", "pH 6.5-7.0")}


def test_band_join(spark):
    import random

    rng = random.Random(5)
    a = [(i, rng.randint(0, 2), rng.randint(0, 300)) for i in range(80)]
    b = [(i, rng.randint(0, 2), rng.randint(0, 300)) for i in range(80)]
    x, y = spark.createDataFrame(a, "i int, g int, u int"), spark.createDataFrame(b, "j int, g int, v int")
    got = sorted((r["i"], r["j"]) for r in relations.band_join(x, y, "g", "u", "v", 25).collect())
    assert got == sorted((i, j) for i, g, u in a for j, h, v in b if g == h and abs(u - v) <= 25)


def test_first_spans(spark):
    rows = [("d", 0, 10, 0.1), ("d", 2, 9, 0.9), ("d", 9, 20, 0.5), ("d", 30, 31, 0.2)]
    df = spark.createDataFrame(rows, "k string, a long, b long, c double")
    assert sorted(r["a"] for r in relations.first_spans(df, ["k"], "a", "b").collect()) == [0, 9, 30]
    assert sorted(r["a"] for r in relations.first_spans(df, ["k"], "a", "b", best="c").collect()) == [2, 9, 30]


def test_first_spans_of_lines(spark, folder):
    """The registered query against plain Python over the spans of all lines."""
    from textloom.plans import registry

    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey", day.alias("a"), F.col("l_quantity").cast("long").alias("n")).collect()
    want = {}
    for k, a, b in sorted({(r["l_suppkey"], r["a"], r["a"] + r["n"]) for r in lines}):
        kept = want.setdefault(k, [])
        if all(min(b, y) - max(a, x) <= 0.5 * min(b - a, y - x) for x, y in kept):
            kept.append((a, b))
    got = sorted(map(tuple, registry.queries()["interval_overlap_dedupe"](spark, folder).select("k", "a", "b").collect()))
    assert got == sorted((k, *s) for k, spans in want.items() for s in spans)


def test_clusters(spark):
    names = ["red widget", "red widgets", "Red Widget", "blue gear", "blue gears x"]
    df = spark.createDataFrame([(n, float(i)) for i, n in enumerate(names)], "n string, c double")
    got = {r["leader"]: r["size"] for r in clusters.similarity_clusters(df, F.lit("all"), "n", "c").collect()}
    leaders = []
    for n in reversed(names):
        if not any(difflib.SequenceMatcher(None, n.lower(), x.lower()).ratio() > 0.85 for x in leaders):
            leaders.append(n)
    assert set(got) == set(leaders) and sum(got.values()) == len(names)


def test_clusters_of_parts(spark, folder):
    """The registered query against plain Python over all names of each type."""
    from textloom.plans import registry

    best, mentions = {}, {}
    for r in spark.read.parquet(f"{folder}/part.parquet").collect():
        key = (r["p_type"], r["p_name"])
        best[key] = max(best.get(key, r["p_retailprice"]), r["p_retailprice"])
        mentions[key] = mentions.get(key, 0) + 1
    want = {}
    for t, n in sorted(best, key=lambda k: (-best[k], k[1])):
        near = next((x for x in want if x[0] == t and difflib.SequenceMatcher(None, n.lower(), x[1].lower()).ratio() > 0.85), (t, n))
        want.setdefault(near, []).append(n)
    got = {(r["block"], r["leader"]): (r["size"], r["mentions"], r["members"]) for r in registry.queries()["entity_clusters"](spark, folder).collect()}
    assert got == {k: (len(v), sum(mentions[k[0], n] for n in v), sorted(v)) for k, v in want.items()}
    assert any(a[:3].lower() != k[1][:3].lower() for k, v in want.items() for a in v)


def test_access(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "k int, owner int")
    grants = spark.createDataFrame([(2,), (2,)], "k int")
    assert sorted(r["k"] for r in relations.secured(rows, "owner", 7, "k", grants).collect()) == [1, 2]


def test_ingest(spark):
    old = spark.createDataFrame([("p", "a.pdf", "h1", 1), ("p", "a.pdf", "h2", 2)], "project string, name string, digest string, version int")
    new = spark.createDataFrame([("p", "a.pdf", "h2"), ("p", "a.pdf", "h3"), ("p", "b.pdf", "h4")], "project string, name string, digest string")
    got = {(r["name"], r["digest"], r["version"]) for r in maintenance.ingest(old, new, "project", "name", "digest").collect()}
    assert got == {("a.pdf", "h3", 3), ("b.pdf", "h4", 1)}
    twice = spark.createDataFrame([("p", "b.pdf", "h5"), ("p", "c.pdf", "h5"), ("p", "b.pdf", "h5"), ("q", "b.pdf", "h5")], "project string, name string, digest string")
    got = sorted((r["project"], r["name"], r["digest"], r["version"]) for r in maintenance.ingest(old, twice, "project", "name", "digest").collect())
    assert got == [("p", "b.pdf", "h5", 1), ("q", "b.pdf", "h5", 1)]  # two equal new files are one


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "s string, t string")
    start = spark.createDataFrame([("a",)], "n string")
    assert {tuple(r) for r in graph.reachable(edges, start, "s", "t", 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert tuple(graph.metrics(edges, "s", "t").first()) == (4, 3, 1.5, 0.5)


def test_cost(spark):
    usage = spark.createDataFrame([(1, "big-mini", 1000), (2, "other", 1000)], "k int, model string, tokens long")
    prices = spark.createDataFrame([(0, "big-mini", 1.0, 2.0), (1, "big", 9.0, 9.0)], "ordinal int, name string, input_price double, output_price double")
    assert {r["k"]: r["cost_usd"] for r in usage.withColumn("cost_usd", cost.priced(F.col("model"), F.col("tokens"), [tuple(p) for p in prices.collect()], 5.0)).collect()} == {1: 0.0013, 2: 0.005}
    split = usage.withColumn("cost_usd", cost.priced(F.col("model"), F.col("tokens"), [tuple(p) for p in prices.collect()], 5.0, F.when(F.col("k") == 1, 100), F.when(F.col("k") == 1, 900)))
    assert {r["k"]: r["cost_usd"] for r in split.collect()} == {1: 0.0019, 2: 0.005}


def test_quality(spark):
    rows = spark.createDataFrame([("Soil pH", 0.9, "soil acid"), ("xy", 0.9, None), ("Good name", 0.1, "")], "t string, c double, ctx string")
    got = {r["t"]: (r["passed"], r["rejection_reason"]) for r in quality.assessed(rows, "t", "c", F.lit(0.2), "ctx", ["soil"]).collect()}
    assert got == {"Soil pH": (True, None), "xy": (False, "low_semantic"), "Good name": (False, "low_confidence")}


def test_embedder(spark):
    e = providers.OfflineEmbedder()
    assert e.embed(["abc"]) == e.embed(["abc"]) and len(e.embed(["x"])[0]) == 384
    df = spark.createDataFrame([(1, "abc"), (2, None)], "k int, t string")
    assert [len(r["vector"]) for r in providers.embedded(df, "t", e).collect()] == [384, 384]


def test_filters(spark):
    df = spark.createDataFrame([("A%b", 1), ("axb", 2), (None, 3)], "t string, n int")
    assert [r["n"] for r in df.where(text_match(["t"], "a%B")).collect()] == [1]
    assert [r["n"] for r in df.where(matching({"n": [2, 3], "t": None})).orderBy("n").collect()] == [2, 3]


def test_search_ties(spark):
    df = spark.createDataFrame([(i, "ring", 1.0) for i in (3, 1, 2)], "k int, v string, c double")
    assert [r["k"] for r in search.entities(df, "v", "ring", "c", "k", 2).collect()] == [1, 2]


def test_streaming(spark, folder, tmp_path):
    import shutil

    from textloom.streaming import events

    (tmp_path / "in").mkdir()
    shutil.copy(f"{folder}/events.parquet", tmp_path / "in/a.parquet")
    rows = events.read_events(spark, str(tmp_path / "in"))
    counted = rows.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).groupBy("event_type").count()
    q = counted.writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sum(r["count"] for r in spark.table("seen").collect()) == spark.read.parquet(f"{folder}/events.parquet").count()
    events.write_batches(events.usage_by_window(rows), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    batch = events.usage_by_window(spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert 0 < spark.read.parquet(str(tmp_path / "out")).count() <= batch.count()
