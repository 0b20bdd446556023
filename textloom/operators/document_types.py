"""What kind of document, section, table or measure a text is: ladders of words, each the first that holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import hits, ladder

# The words of each ladder, in the order in which its steps are tried.
AGRICULTURAL_WORDS = [
    "crop", "crops", "yield", "harvest", "cultivation", "agriculture", "agricultural", "farming", "field trial", "field study", "efficacy", "agronomic", "agronomy",
    "corn", "wheat", "tomato", "soybean", "rice", "cotton", "maize", "barley", "zea mays", "triticum", "solanum lycopersicum", "glycine max", "oryza sativa",
    "fertilizer", "bio-stimulant", "biostimulant", "pesticide", "herbicide", "fungicide", "npk", "nitrogen", "phosphorus", "potassium", "nutrient", "nutrients",
    "bacillus subtilis", "rhizobium", "mycorrhizae", "trichoderma", "beneficial microorganisms",
    "soil ph", "field capacity", "application rate", "foliar application", "fertigation", "growth stage", "pre-emergence", "post-emergence", "flowering stage",
    "statistical significance", "p-value", "anova", "randomized block", "treatment effect", "yield increase", "percent increase", "kg/ha", "tonnes per hectare", "bushels per acre",
]
AGRICULTURAL_NAMES = ["agro", "agriculture", "crop", "yield", "fertilizer", "field_trial", "efficacy", "biostimulant", "nutrient", "farming"]
GENERAL_TEXT = [
    ("safety_data_sheet", ["safety data sheet", "sds", "msds", "hazard"]),
    ("technical", ["specification", "technical data", "parameters", "properties"]),
    ("chemical", ["cas no", "chemical", "ingredient", "formulation"]),
    ("legal", ["agreement", "contract", "party", "clause", "legal", "law"]),
]
GENERAL_NAME = [("safety_data_sheet", ["sds", "msds", "safety"]), ("technical", ["spec", "technical", "datasheet"]), ("legal", ["contract", "agreement", "legal"])]
PRODUCT_NAME = [
    ("SDS", ["sds", "safety", "msds"]),
    ("PRODUCT_SPECIFICATION", ["pspe", "specification"]),
    ("TECHNICAL_DATASHEET", ["datasheet", "technical"]),
    ("BROCHURE", ["brochure", "range", "portfolio"]),
]
#: Counted in lowered text, so those in capitals never occur.
PRODUCT_TEXT = {
    "SDS": [r"safety\s+data\s+sheet", r"\bSDS\b", r"\bMSDS\b", r"material\s+safety", r"hazard\s+identification", r"first\s+aid\s+measures"],
    "TECHNICAL_DATASHEET": [r"technical\s+datasheet", r"technical\s+data\s+sheet", r"product\s+information", r"technical\s+specifications", r"product\s+overview"],
    "PRODUCT_SPECIFICATION": [r"product\s+specification", r"\bPSPE\b", r"specification\s+sheet", r"quality\s+parameters", r"testing\s+methods"],
    "BROCHURE": [r"brochure", r"product\s+range", r"product\s+portfolio", r"specialty\s+products", r"applications\s+guide"],
}
FOOD_TEXT = [
    ("FOOD_SDS", ["safety data sheet", "sds", "msds", "haccp"]),
    ("NUTRITIONAL_INFO", ["nutrition facts", "nutritional information", "vitamin", "mineral"]),
    ("INGREDIENT_SPEC", ["ingredient specification", "food grade", "additive"]),
    ("COA", ["certificate of analysis", "coa", "microbiological"]),
    ("ALLERGEN_DECLARATION", ["allergen", "contains", "may contain", "free from"]),
    ("REGULATORY_COMPLIANCE", ["gras", "fda approved", "efsa", "regulation"]),
]
#: (words that open the step, steps inside it, what else it is): a step inside may be a plain name.
UPLOAD_TEXT = [
    (
        ["food grade", "gras", "fda approved", "ingredient specification"],
        [
            ("NUTRITIONAL_INFO", ["nutrition facts", "nutritional information", "vitamin", "mineral"]),
            ("ALLERGEN_DECLARATION", ["allergen", "contains", "may contain"]),
            ("COA", ["certificate of analysis", "coa", "test results"]),
            ("RECIPE_FORMULATION", ["recipe", "formulation", "formula", "batch sheet"]),
        ],
        "INGREDIENT_SPEC",
    ),
    (["flow chart", "process flow", "workflow", "process map"], [], "FLOW_CHART"),
    (["manufacturing", "production", "operations", "procedure"], [("MANUFACTURING_RECORDS", ["batch record", "production log", "process log"])], "INDUSTRIAL_PROCESS"),
    (["safety data sheet", "sds", "msds"], [("FOOD_SDS", ["food", "ingredient", "additive"])], "SDS"),
    (["compliance", "regulation", "approved", "certified"], [], "REGULATORY_COMPLIANCE"),
    (["fertilizer", "pesticide", "herbicide", "crop"], [], "AGRICULTURAL"),
]
CATEGORIES = [
    ("safety_data_sheet", ["sds", "msds", "safety data sheet", "hazard", "risk assessment"]),
    ("technical_specification", ["specification", "technical data", "parameters", "properties", "datasheet"]),
    ("legal_contract", ["agreement", "contract", "terms", "conditions", "party", "clause"]),
    ("compliance_certificate", ["certificate", "conformity", "compliance", "standard", "iso", "gmp"]),
    ("product_brochure", ["brochure", "product information", "marketing", "features", "benefits"]),
    ("research_report", ["research", "study", "analysis", "findings", "methodology", "results"]),
    ("financial_document", ["financial", "budget", "cost", "invoice", "payment", "accounting"]),
    ("manufacturing_record", ["batch", "lot", "production", "manufacturing", "quality control"]),
    ("regulatory_submission", ["submission", "regulatory", "approval", "license", "permit"]),
]
MERGED = [
    ("safety_data_sheet", ["safety data sheet", "sds", "msds", "hazard", "precaution"]),
    ("technical_specification", ["specification", "technical data", "standard", "requirements"]),
    ("certificate", ["certificate", "certification", "certified", "compliance"]),
    ("marketing_material", ["brochure", "marketing", "product overview"]),
]
SECTIONS = [
    ("product_identification", ["identification", "product", "overview"]),
    ("hazard_classification", ["hazard", "classification", "danger"]),
    ("composition", ["composition", "ingredient", "component"]),
    ("emergency_measures", ["first aid", "emergency", "medical"]),
    ("handling_storage", ["handling", "storage", "precaution"]),
    ("physical_chemical_properties", ["physical", "chemical", "properties"]),
    ("stability_reactivity", ["stability", "reactivity"]),
    ("toxicological_information", ["toxicological", "health", "exposure"]),
    ("ecological_information", ["ecological", "environmental", "ecotoxicity"]),
    ("disposal_considerations", ["disposal", "waste"]),
    ("transport_information", ["transport", "shipping"]),
    ("regulatory_information", ["regulatory", "legal", "classification"]),
    ("application_instructions", ["application", "use", "instruction"]),
]
MEASURES = [
    ("physical_properties", ["ph", "density", "viscosity", "melting", "boiling", "appearance", "color", "odor"]),
    ("composition", ["purity", "assay", "concentration", "content", "active ingredient"]),
    ("chemical_properties", ["solubility", "stability", "reactivity", "decomposition"]),
    ("storage_conditions", ["storage", "temperature", "humidity", "shelf life"]),
    ("quality_parameters", ["limit", "maximum", "minimum", "specification", "test"]),
]
TABLES = [
    ("specification", ["parameter", "property", "specification", "value", "limit", "range"]),
    ("composition", ["component", "ingredient", "compound", "percentage", "content"]),
    ("safety", ["hazard", "warning", "precaution", "ghs", "safety"]),
    ("regulatory", ["standard", "regulation", "compliance", "approval"]),
]
SHARES = {
    "agricultural": ["crop", "soil", "fertilizer", "pest", "yield", "farm", "agriculture", "harvest"],
    "food_industry": ["food", "nutrition", "ingredient", "processing", "quality", "safety", "allergen"],
    "legal": ["regulation", "compliance", "law", "legal", "contract", "policy", "requirement"],
}


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether the lowered text contains a term; no null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms])


def first_of(text: Column, steps: list[tuple[str, list[str]]], default: str) -> Column:
    return ladder(default, *[(has_any(text, terms), name) for name, terms in steps])


def general(text: Column, filename: Column, preset: Column) -> Column:
    """A preset type wins; then farming by three words or the file's name, then words of the text, then of the name."""
    farm = (hits(F.coalesce(text, F.lit("")), AGRICULTURAL_WORDS) >= 3) | has_any(filename, AGRICULTURAL_NAMES)
    steps = [(has_any(text, t), n) for n, t in GENERAL_TEXT] + [(has_any(filename, t), n) for n, t in GENERAL_NAME]
    return F.coalesce(preset, ladder("general", (farm, "agricultural"), *steps))


def product(text: Column, filename: Column) -> Column:
    """By the file's name, else the type whose patterns match most often in the text, the first of equals."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = {n: sum((F.regexp_count(low, F.lit(p)) for p in ps), F.lit(0)) for n, ps in PRODUCT_TEXT.items()}
    most = F.greatest(*counts.values())
    by_text = ladder("TECHNICAL_DATASHEET", (most == 0, "TECHNICAL_DATASHEET"), *[(c == most, n) for n, c in counts.items()])
    return F.coalesce(F.when(has_any(filename, [t for _, ts in PRODUCT_NAME for t in ts]), first_of(filename, PRODUCT_NAME, "")), by_text)


def food(text: Column) -> Column:
    return first_of(text, FOOD_TEXT, "FOOD_DATASHEET")


def upload(text: Column) -> Column:
    out = F.lit("TECHNICAL_SPECIFICATION")
    for opens, inside, other in reversed(UPLOAD_TEXT):
        out = F.when(has_any(text, opens), first_of(text, inside, other) if inside else F.lit(other)).otherwise(out)
    return out


def category(text: Column, filename: Column) -> Column:
    """By any word in the file's name, else two or more in the text."""
    two = [(hits(F.coalesce(text, F.lit("")), t) >= 2, n) for n, t in CATEGORIES]
    return ladder("general_document", *[(has_any(filename, t), n) for n, t in CATEGORIES], *two)


def domain_shares(text: Column) -> dict[str, Column]:
    """Each domain's share of words hit, normalized; 0.33 each without any."""
    own = {k: hits(F.coalesce(text, F.lit("")), v) / len(v) for k, v in SHARES.items()}
    total = sum(own.values(), F.lit(0.0))
    return {k: F.round(F.when(total > 0, v / total).otherwise(0.33), 6) for k, v in own.items()}
