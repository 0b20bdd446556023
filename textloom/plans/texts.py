"""Cleaning, splitting, classifying, scoring and searching texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import clean, hits, length_score, shortened, words
from textloom.operators import chunking, classify, extraction, maintenance, quality, search
from textloom.plans.registry import query
from textloom.sources.tables import load

_SP = r"[ \t\n\r\f\x0B]"
_SQUEEZE = rf"trim(regexp_replace({{0}}, '{_SP}+', ' ', 'g'))"
_WORDS = rf"list_filter(regexp_split_to_array({{0}}, '{_SP}+'), lambda w: w <> '')"


def _docs(spark, folder):
    return load(spark, folder, "documents").select("doc_id", "text", "lang", "source")


@query(rf"""SELECT doc_id, sha256(t) AS digest, length(t)::INTEGER AS n FROM (SELECT doc_id, {_SQUEEZE.format("array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: " + _SQUEEZE.format("x") + "), lambda x: length(x) >= 5 AND NOT regexp_matches(x, '(?i)^page [0-9]+ of [0-9]+$') AND NOT regexp_matches(x, '^[0-9]+$')), ' ')")} AS t FROM documents)""")
def clean_text(spark, folder):
    return _docs(spark, folder).withColumn("t", clean(F.col("text"))).select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("n"))


@query("""SELECT doc_id, chunk_order::INTEGER AS chunk_order, length(trim(c))::INTEGER AS n_chars, (chunk_order // 3 + 1)::INTEGER AS page_number FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, unnest(range(len(string_split(text, chr(10))))) AS chunk_order FROM documents) WHERE trim(c) <> ''""")
def paragraph_chunks(spark, folder):
    return chunking.paragraphs(_docs(spark, folder), "doc_id", "text", "\n").select("doc_id", "chunk_order", F.length("chunk_text").alias("n_chars"), "page_number")


@query("""SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS c FROM documents) WHERE trim(c) <> '' GROUP BY source""")
def chunk_counts(spark, folder):
    parts = chunking.paragraphs(_docs(spark, folder), "doc_id", "text", "\n", "source")
    return parts.groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


@query(rf"""SELECT doc_id, n_chars::INTEGER AS n_chars, n_words::INTEGER AS n_words, len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''))::INTEGER AS n_paragraphs,
    len(regexp_extract_all(text, '[.!?]( |\n|$)'))::INTEGER AS n_sentences, greatest(1, round(n_words / 200))::INTEGER AS reading_minutes, round(len(regexp_extract_all(text, '[#$%&*|<>]')) / greatest(n_chars, 1), 6) AS special_share
    FROM (SELECT doc_id, text, length(text) AS n_chars, len({_WORDS.format("text")}) AS n_words FROM documents)""")
def doc_structure(spark, folder):
    return _docs(spark, folder).withColumns(chunking.structure(F.col("text"))).drop("text", "lang", "source")


@query(r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[#$%&*|<>]')) > 0.02 * length(text) THEN 'medium' WHEN len(regexp_extract_all(text, '[.!?]( |\n|$)')) = 0 THEN 'low' ELSE 'high' END AS quality FROM documents""")
def text_quality(spark, folder):
    special, ends = F.regexp_count("text", F.lit("[#$%&*|<>]")), F.regexp_count("text", F.lit("[.!?]( |\n|$)"))
    grade = F.when(special > 0.02 * F.length("text"), "medium").when(ends == 0, "low").otherwise("high")
    return _docs(spark, folder).select("doc_id", grade.alias("quality"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
    m AS (SELECT *, regexp_matches(line, '^([0-9]+\. .*|#+ .*|[A-Z][A-Z0-9 !,.-]{3,})$')::INTEGER AS h FROM l),
    s AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section_no FROM m)
    SELECT doc_id, section_no::BIGINT AS section_no, max(CASE WHEN h = 1 THEN line END) AS title, count(*) FILTER (h = 0) AS n_lines, sum(CASE WHEN h = 0 THEN length(line) ELSE 0 END)::BIGINT AS n_chars FROM s GROUP BY 1, 2""")
def section_islands(spark, folder):
    return chunking.sections(_docs(spark, folder), "doc_id", "text")


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
    p AS (SELECT *, length(line) - length(replace(line, '|', '')) AS pipes FROM l WHERE length(line) - length(replace(line, '|', '')) > 2),
    r AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM p)
    SELECT doc_id, min(n)::INTEGER AS first_line, count(*) AS n_rows, (min_by(pipes, n) + 1)::INTEGER AS n_columns, min_by({_SQUEEZE.format("line")}, n) AS header FROM r GROUP BY doc_id, run""")
def markdown_tables(spark, folder):
    return chunking.pipe_tables(_docs(spark, folder), "doc_id", "text")


@query()
def recursive_chunks(spark, folder):
    """Pieces of the recursive splitter; sequential, tested by invariants and against plain Python."""
    return chunking.split_documents(_docs(spark, folder), "doc_id", "text").select("doc_id", "chunk_order", "start", F.length("chunk_text").alias("n_chars"))


_TYPES = [("licensed", "license"), ("contact", "@"), ("list", " | "), ("shouting", "!!")]


@query(f"SELECT doc_id, CASE {' '.join(f'''WHEN contains(lower(text), '{t}') THEN '{n}' ''' for n, t in _TYPES)} ELSE 'general' END AS doc_type FROM documents")
def doc_type_ladder(spark, folder):
    from textloom.functions.text import ladder

    low = F.lower("text")
    return _docs(spark, folder).select("doc_id", ladder("general", *[(F.contains(low, F.lit(t)), n) for n, t in _TYPES]).alias("doc_type"))


def _votes() -> str:
    return ", ".join(f"len(list_filter(w, lambda x: list_contains({v}, x))) AS {k}" for k, v in classify.LANGUAGES.items())


_CASE = "CASE WHEN greatest({0}) = 0 THEN '{1}' {2} END"


def _argmax(names: list[str], default: str) -> str:
    return _CASE.format(", ".join(names), default, " ".join(f"WHEN {n} = greatest({', '.join(names)}) THEN '{n}'" for n in names))


@query(rf"SELECT doc_id, {_argmax(list(classify.LANGUAGES), 'en')} AS voted, lang FROM (SELECT doc_id, lang, {_votes()} FROM (SELECT doc_id, lang, {_WORDS.format('lower(text)')} AS w FROM documents))")
def language_vote(spark, folder):
    return _docs(spark, folder).select("doc_id", classify.language(F.col("text")).alias("voted"), "lang")


def _hit_sql(column: str, terms: list[str]) -> str:
    return " + ".join(f"contains(lower({column}), '{t}')::INTEGER" for t in terms)


@query(f"SELECT conv_id, turn, {_argmax(list(classify.DOMAINS), 'agricultural')} AS domain FROM (SELECT conv_id, turn, {', '.join(f'{_hit_sql('text', v)} AS {k}' for k, v in classify.DOMAINS.items())} FROM conversations)")
def query_domain(spark, folder):
    return load(spark, folder, "conversations").select("conv_id", "turn", classify.domain(F.col("text")).alias("domain"))


_EN = ["the", "and", "that", "with"]


@query(rf"SELECT conv_id, turn, CASE WHEN c >= 2 THEN 'hybrid' WHEN c = 1 THEN 'enhanced' ELSE 'simple' END AS mode FROM (SELECT conv_id, turn, (len({_WORDS.format('text')}) > 10)::INTEGER + (contains(lower(text), 'and') OR contains(lower(text), 'or'))::INTEGER + (length(text) - length(replace(text, '?', '')) > 1)::INTEGER AS c FROM conversations)")
def query_mode(spark, folder):
    return load(spark, folder, "conversations").select("conv_id", "turn", classify.mode(F.col("text")).alias("mode"))


@query()
def query_intent(spark, folder):
    """Intent by longest and earliest match; tested on stated questions."""
    return load(spark, folder, "conversations").select("conv_id", "turn", classify.intent(F.col("text")).alias("intent"))


@query(f"SELECT doc_id, round(({_hit_sql('text', _EN)}) / 4.0::DOUBLE, 6) AS score FROM documents WHERE ({_hit_sql('text', _EN)}) > 0 ORDER BY score DESC, doc_id LIMIT 50")
def keyword_search_topk(spark, folder):
    return search.keyword_score(_docs(spark, folder), "text", _EN).orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", "score")


@query(f"SELECT source, doc_id, score, place FROM (SELECT source, doc_id, round(({_hit_sql('text', _EN)}) / 4.0::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY ({_hit_sql('text', _EN)}) DESC, doc_id)::INTEGER AS place FROM documents WHERE ({_hit_sql('text', _EN)}) > 0) WHERE place <= 5")
def keyword_search_by_source(spark, folder):
    found = search.keyword_score(_docs(spark, folder), "text", _EN)
    return search.top_k_per(found, "source", 5, F.desc("score"), "doc_id").select("source", "doc_id", "score", "place")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS snippet FROM documents")
def snippets(spark, folder):
    return _docs(spark, folder).select("doc_id", shortened(F.col("text"), 200).alias("snippet"))


_SCORE = "CASE WHEN length(v) = 0 THEN 0.0 WHEN length(v) < 3 THEN 0.1 WHEN wc > 6 THEN 0.3 WHEN length(v) <= 30 AND wc <= 4 THEN 1.0 WHEN length(v) <= 50 AND wc <= 6 THEN 0.8 ELSE 0.6 END::DOUBLE"


@query(rf"SELECT v, n, {_SCORE} AS score FROM (SELECT v, count(*) AS n, len({_WORDS.format('v')}) AS wc FROM (SELECT unnest(string_split(text, '. ')) AS v FROM documents) GROUP BY v)")
def length_scores(spark, folder):
    parts = _docs(spark, folder).select(F.explode(F.split("text", "\\. ")).alias("v"))
    return parts.groupBy("v").agg(F.count("*").alias("n")).withColumn("score", length_score(F.col("v")))


@query("SELECT count(*) AS total, sum(quality)::BIGINT AS passed, round(avg(quality), 6) AS pass_rate, round(1 - avg(quality), 6) AS noise_reduction, count(*) FILTER (toxic = 1) AS toxic FROM labels")
def quality_stats(spark, folder):
    rows = load(spark, folder, "labels")
    return rows.agg(F.count("*").alias("total"), F.sum("quality").alias("passed"), F.round(F.avg("quality"), 6).alias("pass_rate"), F.round(1 - F.avg("quality"), 6).alias("noise_reduction"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def _assessed(spark, folder):
    rows = load(spark, folder, "part").withColumn("confidence", F.round(F.col("p_size") / 50, 6)).withColumn("context", F.concat_ws(" ", "p_type", "p_name"))
    return quality.assessed(rows, "p_name", "confidence", F.when(F.col("p_type") == "ECONOMY", 0.3).otherwise(0.1), "context", ["economy", "ring"])


@query()
def quality_filter(spark, folder):
    """Scores and verdicts of named entities; tested against plain Python."""
    return _assessed(spark, folder).select("p_partkey", "semantic", "length_part", "context_part", "final", "passed", "rejection_reason")


@query("""SELECT CASE WHEN round(p_size / 50.0::DOUBLE, 6) < 0.4 THEN 'low_confidence' END AS rejection_reason, count(*) AS n FROM part GROUP BY 1""")
def rejection_counts(spark, folder):
    return _assessed(spark, folder).groupBy("rejection_reason").agg(F.count("*").alias("n"))


@query("""SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def hash_dedupe(spark, folder):
    return _docs(spark, folder).groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1")
def exact_dup_first_wins(spark, folder):
    keyed = _docs(spark, folder).select("doc_id", "lang", F.sha2(F.lower("text"), 256).alias("key"))
    return maintenance.first_of(keyed, [F.col("key")], "doc_id").select("doc_id", "lang")


def _extract(pattern: str, column: str) -> str:
    return f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{pattern}'))) AS {column} FROM documents"


_EMAIL, _NUMBER, _ACRONYM = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[0-9]+[.][0-9]+", "[A-Z]{2,}[0-9]+"


@query(_extract(_EMAIL, "email"))
def extract_emails(spark, folder):
    return _docs(spark, folder).select("doc_id", F.explode(extraction.all_matches(F.col("text"), _EMAIL)).alias("email"))


@query(_extract(_NUMBER, "number"))
def extract_numbers(spark, folder):
    return _docs(spark, folder).select("doc_id", F.explode(extraction.all_matches(F.col("text"), _NUMBER)).alias("number"))


@query(_extract(_ACRONYM, "acronym"))
def extract_acronyms(spark, folder):
    return _docs(spark, folder).select("doc_id", F.explode(extraction.all_matches(F.col("text"), _ACRONYM)).alias("acronym"))


def _technical(spark, folder):
    """Documents, and texts with technical values of every kind."""
    stated = [(-1, "Composition: 25% active, pH 6.5-7.0, apply 2.5 kg/ha. Storage at 25 °C. CAS 123-45-6, H300."), (-2, "E330, ISO 22000-1 and 5 mg of it: 10 %"), (-3, None)]
    return _docs(spark, folder).select("doc_id", "text").union(spark.createDataFrame(stated, "doc_id long, text string"))


@query()
def technical_spans(spark, folder):
    """Spans of technical patterns with scores; tested on stated texts."""
    return extraction.scored(extraction.spans(_technical(spark, folder), "doc_id", "text")).select("doc_id", "kind", "start", "end", "value", "confidence")


@query()
def technical_relations(spark, folder):
    found = extraction.scored(extraction.spans(_technical(spark, folder), "doc_id", "text"))
    return extraction.near_pairs(found, "doc_id", ["mass", "cas_number"], ["percent", "ph"])


@query(rf"""SELECT d.lang, round(avg(len({_WORDS.format('text')})), 4) AS avg_words, max(length(text))::BIGINT AS longest, mode(source) IS NOT NULL AS has_source FROM documents d GROUP BY 1""")
def corpus_by_language(spark, folder):
    return _docs(spark, folder).groupBy("lang").agg(F.round(F.avg(F.size(words(F.col("text")))), 4).alias("avg_words"), F.max(F.length("text")).cast("long").alias("longest"), F.mode("source").isNotNull().alias("has_source"))


@query(f"SELECT doc_id, ({_hit_sql('text', ['the', 'les', 'und', 'que'])})::INTEGER AS hits FROM documents")
def keyword_hits(spark, folder):
    return _docs(spark, folder).select("doc_id", hits(F.col("text"), ["the", "les", "und", "que"]).alias("hits"))
