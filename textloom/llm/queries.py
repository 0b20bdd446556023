"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontaminate, filter_audit, html_extract, lm_score, packing, quality_rules, secret_scan, simhash_dedup, suffix_dedup, token_counts, toxicity
from .frames import pick, table

#: A text that holds marks of common templates.
_FORGED = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", _FORGED), (-7, 1, "assistant", _FORGED)], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_chats(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(more))
    read = chat_format.read_chats(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).drop("ratio", "chunk_share")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.group(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = [op1_chat_format, op2_secret_scan, op3_token_counts, op4_decontaminate, op5_html_extract, op6_quality_rules, op7_simhash_dedup, op8_toxicity, op9_packing, op10_suffix_dedup, op11_lm_score, op12_filter_audit, op13_collocations]
    return {f.__name__: f for f in named} | {"pipeline": pipeline}


OP1_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), turns AS (
    SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
    SELECT *,
        length(replace(replace(replace(text, '\', '\b'), '##', '#\h'), '</turn>', '<\s/turn>')) AS text_chars,
        CASE WHEN before = role THEN 9
             ELSE CASE WHEN place = 1 THEN 0 ELSE 8 END + 6
                + length(replace(replace(replace(replace(role, '\', '\b'), '##', '#\h'), '</turn>', '<\s/turn>'), ':', '\c')) END AS mark_chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(mark_chars + text_chars) + 8)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP4_SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM documents
), b AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS said
    FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
    SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS said
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows))
), hits AS (
    SELECT doc_id, item_id, size, i FROM places JOIN windows USING (size, said)
), words AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP12_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, FALSE) AS copy
    FROM documents
), l AS (
    SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flags AS (
    SELECT part, map(['A', 'B', 'C', 'D', 'E'], [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), copy]) AS fails,
        coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
    FROM d LEFT JOIN l USING (doc_id)
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT part, filter_order, step, filter_order[step] AS filter, fails[filter_order[step]] AS failed, good, toxic,
        len(list_filter(map_values(fails), lambda f: f)) AS n_fails,
        len(list_filter(range(1, step), lambda s: fails[filter_order[s]])) AS before
    FROM flags, orders, range(1, 6) AS r(step)
), counted AS (
    SELECT part, filter_order, step::INTEGER AS step, filter, count(*) FILTER (before = 0 AND NOT failed) AS kept,
        count(*) FILTER (before = 0 AND failed) AS removed, count(*) FILTER (before > 0 AND failed) AS redundant,
        count(*) FILTER (failed AND n_fails = 1) AS unique_fails, count(*) FILTER (before = 0 AND failed AND good) AS good_lost,
        count(*) FILTER (before = 0 AND failed AND toxic) AS toxic_lost
    FROM steps GROUP BY ALL
)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""

OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), counts AS (
    SELECT lang, size, phrase, count(*) AS a
    FROM (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
          FROM worded, range(1, 5) AS s(size) WHERE len(w) >= size)
    GROUP BY ALL HAVING count(*) >= 30
), found AS (
    SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1
), scored AS (
    SELECT f.lang, f.phrase, f.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * f.a) // (x.a + y.a))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM found) f
    JOIN counts x ON x.lang = f.lang AND x.phrase = array_to_string(f.w[1:k], ' ')
    JOIN counts y ON y.lang = f.lang AND y.phrase = array_to_string(f.w[k + 1:], ' ')
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
    SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS around
    FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM found WHERE size > 2))
    GROUP BY ALL
)
SELECT * FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best LEFT JOIN around USING (lang, phrase) JOIN totals USING (lang)
    WHERE around IS NULL OR 100 * around < 80 * a
) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op4_decontaminate": OP4_SQL, "op12_filter_audit": OP12_SQL, "op13_collocations": OP13_SQL}
