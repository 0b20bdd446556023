"""Rows made ready for their tables: identifiers, defaults, leftover fields as metadata, access rows, change times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEX = "[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}"

# What a field is where it isn't given.
FOOD_DEFAULTS = {"food_industry_type": "unspecified", "product_category": "general", "food_grade": "true", "allergen_info": "{}", "nutritional_value": "{}", "applications": "[]", "processing_methods": "[]", "storage_conditions": "{}", "quality_parameters": "{}", "supplier_info": "{}", "cost_information": "{}", "certifications": "[]"}
NUTRITION_DEFAULTS = {"vitamins": "{}", "minerals": "{}", "amino_acids": "{}", "fatty_acids": "{}", "other_nutrients": "{}", "serving_size_g": "100", "nutritional_claims": "[]"}
ALLERGEN_DEFAULTS = {"allergen_type": "", "presence_level": "allergen_free", "cross_contamination_risk": "low", "labeling_requirements": "{}", "regulatory_compliance": "{}", "supply_chain_controls": "{}", "cleaning_protocols": "{}", "test_results": "{}"}
FARM_DEFAULTS = {"confidence_score": "1.0", "extraction_method": "automatic"}
DOCUMENT_DEFAULTS = {"filename": "unknown.pdf", "num_pages": "1"}
CHUNK_DEFAULTS = {"chunk_text": "", "chunk_index": "0", "page_number": "1"}


def is_uuid(value: Column) -> Column:
    """32 hex digits, in groups or not, in braces or after urn:uuid: or not; no null."""
    return F.coalesce(F.regexp_replace(F.lower(value), "^(urn:)?(uuid:)?[{]?|[}]?$", "").rlike(f"^{_HEX}$"), F.lit(False))


def as_uuid(value: Column) -> Column:
    """The usual spelling of a valid identifier, null of any other."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(value), "^(urn:)?(uuid:)?", ""), "[^0-9a-f]", "")
    return F.when(is_uuid(value), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def with_defaults(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Fields that rows lack, or have null, get their default."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})


def leftover(fields: Column, known: list[str]) -> Column:
    """The fields of a map that no column takes, with a value."""
    return F.map_filter(fields, lambda k, v: ~k.isin(known) & v.isNotNull())


def promoted(value: Column, metadata: Column, name: str) -> Column:
    """The value, or else what the metadata has under that name; empty ones count as none."""
    return F.coalesce(F.when(value != "", value), F.get(F.array(metadata[name]), 0))


def new_projects(rows: DataFrame, user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(projects, access): an empty description for none, and an admin row for the owner whose id is valid.

    Both frames come from the same rows, so neither is written for rows that the
    other refuses: there is nothing to take back.
    """
    access = rows.where(is_uuid(F.col(user))).select(F.col(user).alias("user_id"), F.col("id").alias("project_id"), F.lit("admin").alias("access_level"))
    return rows.withColumn("description", F.coalesce("description", F.lit(""))).drop(user), access


def usage_log(rows: DataFrame) -> DataFrame:
    """document_id where it's a valid identifier, else kept in the payload as original_document_id."""
    odd = (F.col("document_id") != "") & ~is_uuid(F.col("document_id"))
    payload = F.when(odd, F.map_concat(F.coalesce("request_payload", F.create_map().cast("map<string,string>")), F.create_map(F.lit("original_document_id"), F.col("document_id"))))
    return rows.withColumns({"request_payload": F.coalesce(payload, F.col("request_payload")), "document_id": F.when(is_uuid(F.col("document_id")), F.col("document_id")), "user_id": F.col("user_id").cast("string")})


def touched(old: DataFrame, new: DataFrame, key: str, fields: list[str], now: Column) -> DataFrame:
    """Partial update: fields given in new replace old ones, and rows that get any have the time of the change.

    The new side has one row a key.
    """
    given = new.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = old.join(given, F.col(key) == F.col("_k"), "left")
    changed = joined.withColumn("updated_at", F.when(F.col("_k").isNotNull(), now).otherwise(F.col("updated_at")))
    return changed.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop("_k", *[f"_{f}" for f in fields])


def may(role: Column, level: Column, wanted: str) -> Column:
    """Admins may all; reading takes any grant, writing a write or admin one, administering an admin one; no null."""
    enough = {"read": level.isNotNull(), "write": level.isin("write", "admin"), "admin": level == "admin"}[wanted]
    return F.coalesce(role == "admin", F.lit(False)) | F.coalesce(enough, F.lit(False))
