"""Packing of sections against plain Python."""

from pyspark.sql import functions as F

from textloom.operators import structure


def packed(content, large=60, size=40):
    if len(content) <= large:
        return [content]
    out, now = [], ""
    for para in content.split("\n\n"):
        if len(now + para) < size:
            now += para + "\n\n"
        else:
            if now.strip():
                out.append(now.strip())
            now = para + "\n\n"
    return out + [now.strip()] * bool(now.strip())


def test_packed(spark):
    texts = ["", "short", "a" * 61, "one two\n\nthree " * 9, "\n\n".join("x" * n for n in (5, 39, 40, 41, 1, 1, 1, 60)), "\n\n\n\n" * 30, "p\n\n" * 40, "é" * 30 + "\n\n" + "日" * 31]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", structure.packed(F.col("t"), 60, 40).alias("got"))
    assert {r["i"]: r["got"] for r in df.collect()} == {i: packed(t) for i, t in enumerate(texts)}
    rows = spark.createDataFrame([(1, 0, "T", "general", 1, "long enough " * 10), (1, 1, "U", "general", 1, "short"), (2, 0, None, None, None, None)], "doc long, place int, title string, section_type string, page int, content string")
    assert [(r["doc"], r["part"]) for r in structure.section_chunks(rows, "doc").collect()] == [(1, 0)]
