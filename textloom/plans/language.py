"""The language of entity samples, of entities, and chemical validity, over the names of parts and stated values of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import entity_language as language
from textloom.plans.registry import query
from textloom.sources.tables import load

VALUES = ["the", "dans", "Fiche de données", "SÉCURITÉ", "safety data sheet", "product specification", "en cas de contact avec", "contact with skin", "dans  la FDS", "mesures de protection", "GLYCOLYS® TM", "Acme TM", "REGAL", "be used as filler", "selon", "A", "", None,
          "sodium starch glycolate", "Sodium Chloride 5", "LYCATAB® C", "magnésium oxyde", "Sulfure de zinc et", "it is used", "high purity", "may be toxic", "suitable for use", "destiné pour usage", "peut être toxique", "one-two three", "x / y", "citric acid of", "hypromellose acétate", "five words in this value", "Poly (vinyl) ether™", "niveau important de"]
#: (key, place, value): one key for English values, one for French ones, and one for each value alone.
STATED = [(f"s{i:02}", 0, v) for i, v in enumerate(VALUES)] + [("mixed", i, v) for i, v in enumerate(VALUES)] + [("long", i, "plain") for i in range(50)] + [("long", 50, "dans la FDS"), (None, 0, "de la")]


def _rows(spark, folder):
    parts = load(spark, folder, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("place"), F.col("p_name").alias("v"))
    return parts.union(spark.createDataFrame(STATED, "k string, place long, v string"))


def _q(x):
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


_R = f"(SELECT p_brand AS k, p_partkey AS place, p_name AS v FROM part UNION ALL SELECT * FROM (VALUES {', '.join(f'({_q(k)}, {p}, {_q(v)})' for k, p, v in STATED)}) AS s(k, place, v))"
_LIST = lambda words: "(" + ", ".join(map(_q, words)) + ")"
_HIT = lambda text, p, blind=False: f"regexp_matches({text}, {_q(language.sql(p, blind))})"
_ANY = lambda text, ps, blind=False: "(" + " OR ".join(_HIT(text, p, blind) for p in ps) + ")"
_SUM = lambda lang: f"CASE WHEN low IN {_LIST(language.WORDS[lang])} THEN 2 ELSE 0 END + " + " + ".join([f"{_HIT('low', p)}::INTEGER" for p in language.PATTERNS[lang]] + [f"3 * {_HIT('low', p)}::INTEGER" for p in language.PHRASES[lang]] + ([f"2 * {_HIT('v', p, True)}::INTEGER" for p in language.FRENCH_MARKS] if lang == "french" else []))
_V = f"(SELECT k, place, coalesce(v, '') AS v, lower(coalesce(v, '')) AS low FROM {_R})"


@query(f"""SELECT *, CASE WHEN french >= 2 AND french > english THEN 'french' ELSE 'english' END AS language FROM (
    SELECT k, sum({_SUM("english")})::BIGINT AS english, sum({_SUM("french")})::BIGINT AS french
    FROM (SELECT * FROM {_V} QUALIFY row_number() OVER (PARTITION BY k ORDER BY place, v) <= 50) GROUP BY k)""")
def sample_language(spark, folder):
    return language.sample_language(_rows(spark, folder), "k", "place", "v")


_AGAINST = lambda wrong: f"CASE WHEN low IN {_LIST(language.WORDS[wrong])} THEN 0.2 WHEN {_ANY('low', language.PHRASES[wrong])} THEN 0.1 WHEN {_ANY('low', language.PATTERNS[wrong])} THEN 0.3 WHEN {_ANY('v', language.TRADEMARKS)} THEN 1.0 ELSE 0.9 END"


@query(f"""SELECT k, place, v, ({_AGAINST("french")})::DOUBLE AS as_english, (CASE WHEN {_ANY("low", language.PHRASES["french"])} THEN 0.1 ELSE {_AGAINST("english")} END)::DOUBLE AS as_french, 0.8::DOUBLE AS as_other FROM {_V}""")
def language_scores(spark, folder):
    score = lambda expected: language.language_score(F.col("v"), F.lit(expected))
    return _rows(spark, folder).select("k", "place", F.coalesce("v", F.lit("")).alias("v"), score("english").alias("as_english"), score("french").alias("as_french"), score("dutch").alias("as_other"))


_HOLDS = lambda words: "(" + " OR ".join(f"contains(low, {_q(w)})" for w in words) + ")"
_POINT = lambda test, p: f"CASE WHEN {test} THEN {p} ELSE 0 END"


#: The validity of v, with its lower case in low.
VALIDITY = f"""round(greatest(0.0, least(1.0, 0.5 + {_POINT(_ANY("v", language.VALID_NAMES, True), 0.3)} - {_POINT(_ANY(f"regexp_replace(low, '^{language.SPACE}+|{language.SPACE}+$', '', 'g')", language.INVALID_NAMES), 0.4)}
    + {_POINT(f"len(list_filter(regexp_split_to_array(v, '{language.SPACE}+'), lambda w: w <> '')) <= 4", 0.1)} + {_POINT(_HOLDS(language.FOR), 0.2)} + {_POINT("regexp_matches(v, '[®™]')", 0.2)}
    + {_POINT("regexp_matches(v, '^[A-Z]')", 0.1)} - {_POINT(_HOLDS(language.AGAINST), 0.3)})), 6)"""


@query(f"SELECT k, place, v, {VALIDITY}::DOUBLE AS validity FROM {_V}")
def chemical_validity(spark, folder):
    return _rows(spark, folder).select("k", "place", F.coalesce("v", F.lit("")).alias("v"), language.chemical_validity(F.col("v")).alias("validity"))
