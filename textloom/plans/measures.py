"""Named values, facts, farm entities and specifications, over the documents and texts that hold every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import measures
from textloom.plans.documents import _quoted, _values
from textloom.plans.registry import query
from textloom.sources.tables import load

TEXTS = [
    (-1, "CAS: 7732-18-5, EINECS 231-791-2. pH: 6.5 - 7.5 at 20-25 °C, 12.5 %w 30 % bar; 3.5 bar or 50 psi; 12 cP; 40 microns and 5 nm"),
    (-2, "Molecular weight: 180.16 g/mol. Flash point 93 °C, melting point: 146 °C, boiling point 343 °C. Density 1.54 g/ml x; shelf life: 24 months"),
    (-3, "WARNING: H301 and P264, ghs07, EUH066. Danger! ISO 9001 and EN 12766-1 by FDA, EFSA or HACCP. Acme GmbH and Foo Ltd, Acme GmbH"),
    (-4, "The crop Zea mays and corn, Maize; variety Golden delicious apple. NPK 20-20-20 fertilizer with Bacillus subtilis and XR7®. Nitrogen content, Zn level, total nitrogen, K"),
    (-5, "gave 15 % yield increase, 2.5 kg/ha, 3 tonnes per hectare (p < 0.05) after foliar application, seed treatment and fertigation; banding"),
    (-6, "Insurance shall be kept in force by the lessee at all times within 30 days of signing. Liability shall not exceed the sum of all fees paid so far."),
    (-7, "The standard of service delivered to users shall be 99.5 percent. Pay $1,000,000.50 as a fee to the seller. Notice not later than 14 days of the breach of duty"),
    (-8, ""),
    (-9, None),
]


def _rows(spark, folder):
    return load(spark, folder, "documents").select("doc_id", "text").union(spark.createDataFrame(TEXTS, "doc_id long, text string"))


_T = f"(SELECT doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT doc_id, coalesce(t, '') FROM {_values(TEXTS, 'doc_id, t')})"
_told = lambda columns: F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.array_join(v, "|")) for k, v in columns.items()])


def _found(pattern: str, group: int) -> str:
    return f"regexp_extract_all(t, {_quoted(pattern)}, {group})"


@query(f"SELECT doc_id, {" || ';' || ".join(f'''{_quoted(k + '=')} || coalesce(array_to_string({_found(p, 1)}, '|'), '')''' for k, p in measures.TECHNICAL.items())} AS found FROM {_T}")
def technical_values(spark, folder):
    return _rows(spark, folder).select("doc_id", _told(measures.technical(F.col("text"))).alias("found"))


_ONCE = {"ghs_codes": measures.TECHNICAL["ghs_code"], "signal_words": measures.SIGNALS, "standards": measures.TECHNICAL["iso_standard"], "bodies": measures.TECHNICAL["regulatory_body"], "companies": measures.COMPANY}


@query(f"SELECT doc_id, {" || ';' || ".join(f'''{_quoted(k + '=')} || coalesce(array_to_string(list_sort(list_distinct({_found(p, 1)})), '|'), '')''' for k, p in _ONCE.items())} AS found FROM {_T}")
def safety_facts(spark, folder):
    return _rows(spark, folder).select("doc_id", _told(measures.facts(F.col("text"))).alias("found"))


def _farm(kind: str) -> str:
    patterns, once = measures.FARM[kind]
    found = " || ".join(_found(f"(?i){p}", 1 if kind == "crops" else 0) for p in patterns)
    found = f"list_transform({found}, lambda x: trim(x))" if kind == "crops" else found
    # A letter with an accent is no word border; the words of this kind have none.
    found = found.replace("_all(t,", "_all(regexp_replace(t, '[^\\x00-\\x7F]', 'q', 'g'),") if kind == "nutrients" else found
    return f"array_to_string(list_sort({f'list_distinct({found})' if once else found}), '|')"


@query(f"SELECT doc_id, {', '.join(f'coalesce({_farm(k)}, {chr(39) * 2}) AS {k}' for k in measures.FARM if k != 'products')} FROM {_T}")
def farm_entities(spark, folder):
    """Values of each kind but products, listed in order of the alphabet."""
    return _rows(spark, folder).select("doc_id", *[F.array_join(F.array_sort(v), "|").alias(k) for k, v in measures.farm_entities(F.col("text")).items() if k != "products"])


@query()
def farm_products(spark, folder):
    """Names of products; word borders beside letters with accents aren't those of SQL, so it's tested against plain Python."""
    return _rows(spark, folder).select("doc_id", measures.farm_entities(F.col("text"))["products"].alias("products"))


_NAMED = [(i, v, k) for i, (v, k) in enumerate([("", "product"), (None, "product"), ("Glyco®", "product"), ("12", "value"), ("de", "word"), ("AB", "regulatory"), ("about three words", "other"), ("CAS 50-00-0 is one of them", "Chemical_Compound"), ("a b c d e f", "x"), ("5 kg", None)])]
_N = f"(SELECT id, v, k FROM {_values(_NAMED, 'id, v, k')} UNION ALL SELECT 1000 + p_partkey, p_name || ' ' || p_size || '%', p_type FROM part)"
_RE = lambda patterns: "(" + " OR ".join(f"regexp_matches(v, {_quoted(p)})" for p in patterns) + ")"


@query(f"""SELECT id, CASE WHEN coalesce(v, '') = '' THEN 0.1 ELSE round(greatest(0.1, least(1.0, 0.5 + CASE WHEN lower(k) IN ('product', 'chemical_compound', 'specification', 'regulatory') THEN 0.2 ELSE 0 END
    + CASE WHEN len(list_filter(string_split(v, ' '), lambda w: w <> '')) BETWEEN 3 AND 5 THEN 0.1 ELSE 0 END + CASE WHEN {_RE(measures.MEANING)} THEN 0.15 ELSE 0 END - CASE WHEN {_RE(measures.NOISE)} THEN 0.3 ELSE 0 END)), 6) END::DOUBLE AS confidence FROM {_N}""")
def estimated_confidence(spark, folder):
    more = load(spark, folder, "part").select(1000 + F.col("p_partkey"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("%")), "p_type")
    rows = spark.createDataFrame(_NAMED, "id long, v string, k string").union(more)
    return rows.select("id", measures.estimated(F.col("v"), F.col("k")).alias("confidence"))


@query("""SELECT e.n AS entity_count, r.n AS relation_count, round(e.m, 6) AS entity_mean, round(r.m, 6) AS relation_mean, round(least(1.0, e.n / 50), 6)::DOUBLE AS completeness, round((e.m + r.m) / 2, 6) AS overall
    FROM (SELECT count(*) AS n, avg(p_size / 50.0::DOUBLE) AS m FROM part) e, (SELECT count(*) AS n, avg(l_discount) AS m FROM lineitem) r""")
def extraction_quality(spark, folder):
    entities = load(spark, folder, "part").select((F.col("p_size") / 50).alias("confidence"))
    return measures.extraction_quality(entities, load(spark, folder, "lineitem").select(F.col("l_discount").alias("confidence")), "confidence")


@query()
def legal_specifications(spark, folder):
    """Specifications of contracts with places; tested on stated texts."""
    return measures.legal_specifications(_rows(spark, folder), "doc_id", "text")
