"""Ingredient search, suitability for an application, allergen and nutrition profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.vectors import trigram_similarity
from textloom.operators.relations import flagged

# States of approval that count as compliant, and levels of presence that count as held.
APPROVED = ["fda_approved", "gras", "efsa_approved"]
HELD = ["contains", "may_contain"]


def named(entities: DataFrame, foods: DataFrame, term: str) -> DataFrame:
    """Entities with food facts whose value or normal spelling contains the term."""
    low = F.lit(term.lower())
    met = F.contains(F.lower("entity_value"), low) | F.contains(F.lower(F.coalesce("normalized_value", F.lit(""))), low)
    return entities.where(met).join(foods, "id")


def ingredients(entities: DataFrame, foods: DataFrame, nutrition: DataFrame, allergens: DataFrame, term: str, food_grade: bool = False, status: list[str] | None = None, least_protein: float | None = None, most_calories: float | None = None, free_of: list[str] | None = None, limit: int = 20) -> DataFrame:
    """The ingredients nearest to a term; each filter only where it is given, held allergens then leave an ingredient out."""
    found = named(entities, foods, term).join(nutrition, "id", "left")
    if food_grade:
        found = found.where("food_grade")
    if status is not None:
        found = found.where(F.col("regulatory_status").isin(status))
    if least_protein is not None:
        found = found.where(F.col("protein_g") >= least_protein)
    if most_calories is not None:
        found = found.where(F.col("calories") <= most_calories)
    if free_of is not None:
        held = allergens.where(F.col("allergen_type").isin(free_of) & F.col("presence").isin(HELD))
        found = flagged(found, held, "id", "id", "_held").where("NOT _held").drop("_held")
    near = F.round(trigram_similarity(F.coalesce("normalized_value", "entity_value"), F.lit(term)), 6)
    return found.withColumn("similarity", near).orderBy(F.desc("similarity"), F.desc("food_grade"), F.desc_nulls_last("protein_g"), "id").limit(limit)


def suitability(applications: Column, target: str) -> Column:
    """0.9 if the JSON list has the application, 0.7 if its text contains it, else 0.3."""
    listed = F.array_contains(F.from_json(applications, "array<string>"), target)
    return F.when(listed, 0.9).when(F.contains(F.lower(applications), F.lit(target.lower())), 0.7).otherwise(0.3)


def compatibility(status: Column) -> Column:
    return F.when(status.isin(APPROVED), 0.9).when(status == "pending", 0.5).otherwise(0.2)


def risk(shelf_life: Column, allergen_info: Column) -> Column:
    """What is known of risks, as one JSON object; nothing known of allergens is an empty one."""
    return F.to_json(F.struct(F.coalesce(allergen_info, F.lit("{}")).alias("allergen_risk"), shelf_life.alias("shelf_life_days")))


def has_key(json: Column, key: str) -> Column:
    """Whether a JSON object has the key; no null."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def allergen_summary(entities: DataFrame, foods: DataFrame, allergens: DataFrame, name: str) -> DataFrame:
    tested = F.when(F.col("last_test").isNotNull(), "tested").otherwise("not_tested")
    return named(entities, foods, name).select("id").join(allergens, "id").select("id", "allergen_type", "presence", tested.alias("testing_status"))


def profile(entities: DataFrame, foods: DataFrame, nutrition: DataFrame, name: str) -> DataFrame:
    """The nutrition of the first entity of that name, by id."""
    return named(entities, foods, name).join(nutrition, "id").orderBy("id").limit(1).select("id", "calories", "protein_g")
