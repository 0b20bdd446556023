"""Food questions over parts as ingredients, record preparation over users and events, and access checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import foods, records
from textloom.plans.documents import _quoted, _values
from textloom.plans.registry import query
from textloom.sources.tables import load

_STATUS = {"ECONOMY": "gras", "STANDARD": "fda_approved", "SMALL": "pending", "MEDIUM": "efsa_approved"}


def _tables(spark, folder):
    """entities, foods, nutrition, allergens."""
    part = load(spark, folder, "part").withColumn("id", F.col("p_partkey"))
    status = F.lit(None).cast("string")
    for k, v in _STATUS.items():
        status = F.when(F.col("p_type") == k, v).otherwise(status)
    entities = part.select("id", F.col("p_name").alias("entity_value"), F.when(F.col("p_size") > 20, F.lower(F.concat_ws(" ", "p_name", "p_type"))).alias("normalized_value"))
    listed = F.concat(F.lit('["'), F.replace("p_name", F.lit(" "), F.lit('","')), F.lit('"]'))
    info = F.when(F.col("p_size") > 30, F.concat(F.lit('{"'), F.lower("p_type"), F.lit('": 1}')))
    food = part.select("id", F.col("p_type").alias("food_type"), status.alias("regulatory_status"), (F.col("p_size") > 10).alias("food_grade"), listed.alias("applications"), info.alias("allergen_info"), F.col("p_size").alias("shelf_life_days"))
    nutrition = part.where("p_size > 25").select("id", F.col("p_retailprice").alias("calories"), (F.col("p_size") / 2).alias("protein_g"))
    presence = F.when(F.col("p_size") > 40, "contains").when(F.col("p_size") > 30, "may_contain").otherwise("free")
    allergens = part.where("p_type <> 'LARGE'").select("id", F.lower("p_type").alias("allergen_type"), presence.alias("presence"), F.when(F.col("p_size") > 35, F.col("p_size")).alias("last_test"))
    return entities, food, nutrition, allergens


_T = f"""e AS (SELECT p_partkey AS id, p_name AS entity_value, CASE WHEN p_size > 20 THEN lower(p_name || ' ' || p_type) END AS normalized_value FROM part),
    f AS (SELECT p_partkey AS id, p_type AS food_type, CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} END AS regulatory_status, p_size > 10 AS food_grade, '["' || replace(p_name, ' ', '","') || '"]' AS applications,
        CASE WHEN p_size > 30 THEN '{{"' || lower(p_type) || '": 1}}' END AS allergen_info, p_size AS shelf_life_days FROM part),
    n AS (SELECT p_partkey AS id, p_retailprice AS calories, p_size / 2.0::DOUBLE AS protein_g FROM part WHERE p_size > 25),
    a AS (SELECT p_partkey AS id, lower(p_type) AS allergen_type, CASE WHEN p_size > 40 THEN 'contains' WHEN p_size > 30 THEN 'may_contain' ELSE 'free' END AS presence, CASE WHEN p_size > 35 THEN p_size END AS last_test FROM part WHERE p_type <> 'LARGE')"""
_NAMED = "(contains(lower(entity_value), '{0}') OR contains(coalesce(normalized_value, ''), '{0}'))"


@query(f"""WITH {_T} SELECT id, entity_value, regulatory_status, food_grade, protein_g FROM e JOIN f USING (id) LEFT JOIN n USING (id) WHERE {_NAMED.format('ring')} AND food_grade AND regulatory_status IN ('gras', 'fda_approved', 'pending')
    AND NOT EXISTS (SELECT 1 FROM a WHERE a.id = e.id AND allergen_type IN ('economy', 'small') AND presence IN ('contains', 'may_contain'))""")
def ingredients_allowed(spark, folder):
    """All ingredients that a search leaves, without those that hold an allergen."""
    found = foods.ingredients(*_tables(spark, folder), "ring", food_grade=True, status=["gras", "fda_approved", "pending"], free_of=["economy", "small"], limit=1_000_000)
    return found.select("id", "entity_value", "regulatory_status", "food_grade", "protein_g")


@query(f"""WITH {_T} SELECT id, protein_g, allergen_free FROM (SELECT id, protein_g, food_grade, NOT EXISTS (SELECT 1 FROM a WHERE a.id = e.id AND allergen_type = 'economy' AND presence IN ('contains', 'may_contain')) AS allergen_free
    FROM e JOIN f USING (id) LEFT JOIN n USING (id) WHERE {_NAMED.format('red ring')}) ORDER BY food_grade DESC, protein_g DESC NULLS LAST, id LIMIT 20""")
def ingredient_order(spark, folder):
    """Order by flags and by protein with unknown amounts last, with a flag for each ingredient free of an allergen."""
    from textloom.operators.relations import flagged

    entities, food, nutrition, allergens = _tables(spark, folder)
    held = allergens.where(F.col("presence").isin(foods.HELD) & (F.col("allergen_type") == "economy"))
    found = flagged(foods.named(entities, food, "red ring").join(nutrition, "id", "left"), held, "id", "id", "held")
    return found.orderBy(F.desc("food_grade"), F.desc_nulls_last("protein_g"), "id").limit(20).select("id", "protein_g", (~F.col("held")).alias("allergen_free"))


@query(f"""WITH {_T} SELECT id, CASE WHEN list_contains(from_json(applications, '["VARCHAR"]'), 'ring') THEN 0.9 WHEN contains(lower(applications), 'ring') THEN 0.7 ELSE 0.3 END::DOUBLE AS suitability,
    coalesce(regulatory_status IN ('fda_approved', 'gras', 'efsa_approved'), false) AS compliant, CASE WHEN regulatory_status IN ('fda_approved', 'gras', 'efsa_approved') THEN 0.9 WHEN regulatory_status = 'pending' THEN 0.5 ELSE 0.2 END::DOUBLE AS compatibility,
    '{{"allergen_risk":"' || replace(coalesce(allergen_info, '{{}}'), '"', '\\"') || '","shelf_life_days":' || shelf_life_days || '}}' AS risk FROM e JOIN f USING (id) WHERE food_grade""")
def application_fit(spark, folder):
    entities, food, _, _ = _tables(spark, folder)
    status = F.col("regulatory_status")
    return entities.join(food, "id").where("food_grade").select(
        "id", foods.suitability(F.col("applications"), "ring").alias("suitability"), F.coalesce(status.isin(foods.APPROVED), F.lit(False)).alias("compliant"), foods.compatibility(status).alias("compatibility"), foods.risk(F.col("shelf_life_days"), F.col("allergen_info")).alias("risk")
    )


@query(f"""WITH {_T} SELECT id, food_type FROM e JOIN f USING (id) WHERE food_grade AND NOT coalesce(list_contains(json_keys(allergen_info), 'economy'), false) AND (food_type LIKE 'S%' OR food_type LIKE 'ECO%') AND contains(lower(coalesce(allergen_info, 'none')), 'o')""")
def foods_without_key(spark, folder):
    """Negated test of a JSON key, prefix patterns and text search inside JSON; an empty filter would be no filter."""
    _, food, _, _ = _tables(spark, folder)
    kept = food.where(F.col("food_grade") & ~foods.has_key(F.col("allergen_info"), "economy") & (F.col("food_type").like("S%") | F.col("food_type").like("ECO%")))
    return kept.where(F.contains(F.lower(F.coalesce("allergen_info", F.lit("none"))), F.lit("o"))).select("id", "food_type")


@query(f"WITH {_T} SELECT id, allergen_type, presence, CASE WHEN last_test IS NOT NULL THEN 'tested' ELSE 'not_tested' END AS testing_status FROM e JOIN f USING (id) JOIN a USING (id) WHERE {_NAMED.format('ring')}")
def allergen_summary(spark, folder):
    entities, food, _, allergens = _tables(spark, folder)
    return foods.allergen_summary(entities, food, allergens, "ring")


@query(f"WITH {_T} SELECT id, calories, protein_g FROM e JOIN f USING (id) JOIN n USING (id) WHERE {_NAMED.format('ring')} ORDER BY id LIMIT 1")
def nutrition_profile(spark, folder):
    entities, food, nutrition, _ = _tables(spark, folder)
    return foods.profile(entities, food, nutrition, "ring")


# records

_IDS = ["123e4567-e89b-12d3-a456-426614174000", "123E4567E89B12D3A456426614174000", "{123e4567-e89b-12d3-a456-426614174000}", "doc-7", "", None, "123e4567-e89b-12d3-a456-42661417400g"]
_RIGHT = "regexp_matches(lower(x), '^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$')"
_LOG = [(i, x, i % 2 == 0) for i, x in enumerate(_IDS)]


@query(f"""SELECT id, CASE WHEN {_RIGHT.replace('x)', "regexp_replace(x, '[{}]', '', 'g'))", 1)} THEN x END AS document_id, CASE WHEN NOT {_RIGHT.replace('x)', "regexp_replace(x, '[{}]', '', 'g'))", 1)} AND x <> '' THEN x END AS kept, CASE WHEN p THEN 'v' END AS payload FROM (SELECT * FROM {_values(_LOG, 'id, x, p')} UNION ALL SELECT 1000 + event_id, CASE WHEN event_id % 3 = 0 THEN '123e4567-e89b-12d3-a456-' || lpad(event_id::VARCHAR, 12, '0') ELSE event_type || event_id END, event_id % 2 = 0 FROM events)""")
def usage_log_rows(spark, folder):
    """Calls with ids of documents that are none: kept in the payload."""
    named = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("123e4567-e89b-12d3-a456-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))).otherwise(F.concat("event_type", F.col("event_id").cast("string")))
    calls = load(spark, folder, "events").select(1000 + F.col("event_id"), named, F.col("event_id") % 2 == 0)
    rows = spark.createDataFrame(_LOG, "id long, document_id string, p boolean").union(calls).withColumns({"user_id": F.col("id"), "request_payload": F.when(F.col("p"), F.create_map(F.lit("k"), F.lit("v")))})
    return records.usage_log(rows).select("id", "document_id", F.get(F.array(F.col("request_payload")["original_document_id"]), 0).alias("kept"), F.col("request_payload")["k"].alias("payload"))


@query("""SELECT 'project' AS kind, c_custkey AS id, coalesce(c_mktsegment, '') AS said FROM customer UNION ALL SELECT 'access', c_custkey, 'admin' FROM customer WHERE c_nationkey < 10""")
def new_project_rows(spark, folder):
    """Projects and the access rows of owners with valid ids."""
    user = F.when(F.col("c_nationkey") < 10, F.lit(_IDS[0])).otherwise(F.lit("guest"))
    rows = load(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), user.alias("user_id"))
    projects, access = records.new_projects(rows)
    return projects.select(F.lit("project").alias("kind"), "id", F.col("description").alias("said")).union(access.select(F.lit("access"), "project_id", "access_level"))


_FIELDS = {"food": records.FOOD_DEFAULTS, "nutrition": records.NUTRITION_DEFAULTS, "allergen": records.ALLERGEN_DEFAULTS, "farm": records.FARM_DEFAULTS, "document": records.DOCUMENT_DEFAULTS, "chunk": records.CHUNK_DEFAULTS}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, p_partkey AS id, concat_ws('|', {', '.join(f'''coalesce({'p_type' if i == 0 else 'NULL'}, {_quoted(v)})''' for i, v in enumerate(d.values()))}) AS said FROM part" for k, d in _FIELDS.items()).replace("coalesce(p_type,", "coalesce(nullif(p_type, 'SMALL'),"))
def record_defaults(spark, folder):
    """Rows of each kind with one field given, but for some, and defaults for the others."""
    out = None
    for kind, defaults in _FIELDS.items():
        first = next(iter(defaults))
        rows = load(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias(first))
        one = records.with_defaults(rows, defaults).select(F.lit(kind).alias("kind"), "id", F.concat_ws("|", *defaults).alias("said"))
        out = one if out is None else out.union(one)
    return out


@query("""SELECT event_id, event_type, list_sort(list_filter(json_keys(props), lambda k: k <> 'ref')) AS rest FROM events""")
def leftover_fields(spark, folder):
    """The fields of an event's properties that no column takes."""
    fields = F.from_json("props", "map<string,string>")
    return load(spark, folder, "events").select("event_id", "event_type", F.array_sort(F.map_keys(records.leftover(fields, ["ref"]))).alias("rest"))


@query("""WITH new AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT c_custkey, CASE WHEN e IS NOT NULL THEN 'user ' || e ELSE c_name END AS c_name, c_mktsegment, CASE WHEN e IS NOT NULL THEN DATE '2024-02-01' ELSE DATE '2023-01-01' END AS updated_at FROM customer LEFT JOIN new ON c_custkey = user_id""")
def touched_rows(spark, folder):
    """Partial updates with the time of the change; a field that isn't given stays."""
    old = load(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit("2023-01-01").cast("date").alias("updated_at"))
    new = load(spark, folder, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.concat(F.lit("user "), F.max("event_id")).alias("c_name")).withColumn("c_mktsegment", F.lit(None).cast("string"))
    return records.touched(old, new, "c_custkey", ["c_name", "c_mktsegment"], F.lit("2024-02-01").cast("date"))


_GRANTS = [(i, r, g) for i, (r, g) in enumerate((r, g) for r in ("admin", "user", None) for g in ("read", "write", "admin", None))]


@query(f"""SELECT id, coalesce(r = 'admin', false) OR g IS NOT NULL AS may_read, coalesce(r = 'admin', false) OR coalesce(g IN ('write', 'admin'), false) AS may_write, coalesce(r = 'admin', false) OR coalesce(g = 'admin', false) AS may_administer FROM (SELECT * FROM {_values(_GRANTS, 'id, r, g')} UNION ALL SELECT 1000 + c_custkey, CASE WHEN c_nationkey = 3 THEN 'admin' ELSE 'user' END, CASE c_nationkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'admin' END FROM customer)""")
def access_checks(spark, folder):
    nation = F.col("c_nationkey")
    more = load(spark, folder, "customer").select(1000 + F.col("c_custkey"), F.when(nation == 3, "admin").otherwise("user"), F.when(nation % 4 == 0, "read").when(nation % 4 == 1, "write").when(nation % 4 == 2, "admin"))
    rows = spark.createDataFrame(_GRANTS, "id long, r string, g string").union(more)
    return rows.select("id", *[records.may(F.col("r"), F.col("g"), w).alias(n) for w, n in (("read", "may_read"), ("write", "may_write"), ("admin", "may_administer"))])
