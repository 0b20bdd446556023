"""Queries that make questions ready for retrieval: domains, intents, candidates, matches, expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import enhance
from textloom.operators.question_values import DOMAIN_WORDS, INTENTS
from textloom.plans.registry import query
from textloom.sources.tables import load


def _turns(spark, folder):
    return load(spark, folder, "conversations").select("conv_id", "turn", "text")


def _count(terms: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{t}')::INTEGER" for t in terms)


@query(f"""SELECT conv_id, turn, CASE WHEN legal > greatest(food_industry, agricultural) THEN 'legal' WHEN food_industry > agricultural THEN 'food_industry' WHEN agricultural > food_industry THEN 'agricultural'
    WHEN mixed > 0 OR food_industry > 0 THEN 'mixed' ELSE 'agricultural' END AS domain
    FROM (SELECT conv_id, turn, {", ".join(f"{_count(v)} AS {k}" for k, v in DOMAIN_WORDS.items())} FROM conversations)""")
def question_domain(spark, folder):
    return _turns(spark, folder).select("conv_id", "turn", enhance.rule_domain(F.col("text")).alias("domain"))


def _strength(pattern: str) -> str:
    part = f"regexp_extract(text, '(?i){pattern}', 0)"
    return f"CASE WHEN length({part}) > 0 THEN length({part}) / length(text) * (1 - (instr(text, {part}) - 1) / length(text) * 0.3::DOUBLE) ELSE 0.0::DOUBLE END"


@query(f"""WITH s AS (SELECT conv_id, turn, {", ".join(f"least(1.0::DOUBLE, {' + '.join(map(_strength, ps))}) AS {k}" for k, ps in INTENTS.items())} FROM conversations),
    b AS (SELECT *, greatest({", ".join(INTENTS)}) AS best FROM s)
    SELECT conv_id, turn, CASE WHEN coalesce(best, 0) <= 0 THEN 'general' {" ".join(f"WHEN {k} = best THEN '{k}'" for k in INTENTS)} END AS intent, round(coalesce(best, 0), 6) AS intent_score,
    ({" + ".join(f"coalesce({k} > 0.3, false)::INTEGER" for k in INTENTS)}) > 1 AS multi_intent FROM b""")
def question_intent(spark, folder):
    return enhance.with_intents(_turns(spark, folder), "text").select("conv_id", "turn", "intent", "intent_score", "multi_intent")


@query()
def question_mentions(spark, folder):
    """Mentions in the turns; overlaps are settled in order, tested against stated questions."""
    stated = spark.createDataFrame([(-1, 0, "Is the red widget, or a Small Ring, used with wheat and corn?"), (-1, 1, "What does the contract say of a red widget? A RED WIDGET!"), (-1, 2, None)], "conv_id long, turn long, text string")
    rows = _turns(spark, folder).union(stated).withColumn("domain", enhance.rule_domain(F.col("text"))).withColumn("at", F.concat_ws("/", "conv_id", "turn"))
    return enhance.mentions(rows, "at", "text", "domain", {"PRODUCT": ["red widget", "small ring"]})


def _entities(spark, folder):
    rows = load(spark, folder, "part").groupBy("p_name").agg(F.max("p_size").alias("confidence"), F.count("*").alias("frequency"), F.min("p_type").alias("kind"))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("frequency").alias("_most")))).withColumn("share", F.col("frequency") / F.col("_most")).drop("_most")


def _questions(spark, folder):
    """Part names with their brand as questions."""
    text = F.concat(F.lit("what is "), F.col("p_name"), F.lit(" for corn"))
    return load(spark, folder, "part").select("p_partkey", text.alias("text"), enhance.search_terms(F.array(F.col("p_name")), F.col("p_name")).alias("terms"))


_ORDER = lambda: [F.desc("confidence"), F.asc("p_name")]


def _found(spark, folder):
    """An array of candidates for each question."""
    return enhance.candidate_lists(_questions(spark, folder), "p_partkey", "terms", _entities(spark, folder), "p_name", _ORDER())


_FOUND = """e AS (SELECT p_name, max(p_size) AS confidence, count(*) AS frequency, min(p_type) AS kind FROM part GROUP BY 1),
    q AS (SELECT p_partkey, list_concat(list_filter([p_name], lambda x: length(x) > 2), list_filter(string_split(p_name, ' '), lambda x: length(x) > 2))[1:5] AS terms FROM part),
    t AS (SELECT p_partkey, lower(unnest(terms)) AS term, unnest(range(len(terms))) AS term_place FROM q),
    r AS (SELECT term, e.*, row_number() OVER (PARTITION BY term ORDER BY confidence DESC, p_name) AS term_rank FROM (SELECT DISTINCT term FROM t) JOIN e ON contains(lower(p_name), term)),
    f AS (SELECT p_partkey, p_name, confidence, frequency, kind, term_place, term_rank FROM t JOIN r USING (term) WHERE term_rank <= 20 QUALIFY row_number() OVER (PARTITION BY p_partkey, lower(p_name) ORDER BY term_place, term_rank) = 1),
    c AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY term_place, term_rank)::INTEGER AS place FROM f QUALIFY place <= 50)"""


@query(f"WITH {_FOUND} SELECT p_partkey, p_name, place FROM c")
def entity_candidates(spark, folder):
    return _found(spark, folder).select("p_partkey", F.inline("candidates")).select("p_partkey", "p_name", "place")


def _scored(spark, folder):
    """Questions with their text and terms, and the scored candidates of each distinct pair of these: no list of candidates goes with a question."""
    questions = _questions(spark, folder)
    every = enhance.asked_terms(questions, "p_partkey", "terms")
    asking = questions.select("p_partkey", "text").join(every, "p_partkey")
    texts = enhance.with_intents(asking.select("text", "_asked").distinct(), "text").select("text", "_asked", "intent")
    lists = enhance.answers(every, _entities(spark, folder), "p_name", _ORDER())
    pairs = texts.join(lists, "_asked").select("text", "_asked", "intent", F.inline("candidates")).withColumn("context", F.concat_ws(" ", F.lit("corn and"), "p_name"))
    return asking, enhance.match_scores(pairs, "text", "intent", "p_name", "kind", "context", "share")


def _told(asking, answered):
    """What was answered, for each question that asks it."""
    asked = answered.withColumnsRenamed({"text": "_said", "_asked": "_sought"})
    return asking.join(asked, F.col("text").eqNullSafe(F.col("_said")) & (F.col("_asked") == F.col("_sought")))


@query()
def entity_match_scores(spark, folder):
    """Scores of candidate entities; the sequence ratio isn't expressible in SQL, tested against plain Python."""
    asking, scored = _scored(spark, folder)
    return _told(asking, scored.select("text", "_asked", "p_name", "score", "reason")).select("p_partkey", "p_name", "score", "reason")


@query()
def enhanced_questions(spark, folder):
    """Questions with their best matches, expansion terms and confidence; tested on stated rows."""
    asking, scored = _scored(spark, folder)
    best = enhance.best_matches(scored, ["text", "_asked", "intent"], "p_name", "kind")
    domain = enhance.rule_domain(F.col("text"))
    made = best.select(
        "text",
        "_asked",
        enhance.enhanced_text(F.col("text"), F.col("matches")).alias("enhanced"),
        F.array_join(enhance.expansion_terms(domain, F.col("intent"), F.col("matches")), ", ").alias("terms"),
        enhance.enhancement_confidence(F.col("matches")).alias("confidence"),
    )
    return _told(asking.distinct(), made).select("p_partkey", "enhanced", "terms", "confidence")
