"""The stated configuration of product and food entities: a user may pass another of the same shape."""

from __future__ import annotations

# ruff: noqa: E501

#: Patterns of product entities, case-blind (fixed values).
PRODUCT_PATTERNS = {
    "PRODUCT": ["GLYCOLYS®?", "PEARLITOL", "LYCATAB", r"®\s*\w+", r"\b[A-Z]{2,}\s*[A-Z0-9-]*\b", r"\b[A-Z][a-z]+\s*[A-Z]{2,}\b"],
    "CHEMICAL_COMPOUND": [r"sodium\s+starch\s+glycolate", r"\b[A-Z][a-z]+\s+[a-z]+\s+[a-z]+\b", r"\b[A-Z]\d+H\d+[A-Z]\d*\b", r"\bCAS\s*[:\-]?\s*\d{1,7}-\d{2}-\d\b", r"\bEINECS?\s*[:\-]?\s*\d{3}-\d{3}-\d\b"],
    "SPECIFICATION": [r"\b\d+(?:\.\d+)?\s*%\b", r"\b\d+(?:\.\d+)?\s*(?:mg|g|kg|µm|mm|cm)\b", r"\bpH\s*[:\-]?\s*\d+(?:\.\d+)?\b", r"\b\d+(?:\.\d+)?\s*°C\b", r"\b\d+(?:\.\d+)?\s*(?:kPa|MPa|bar|psi)\b", r"\b\d+(?:\.\d+)?\s*(?:cP|mPa\.s)\b"],
    "APPLICATION": ["disintegrant", r"dissolution\s+aid", "pharmaceutical", r"agricultural\s+applications", r"food\s+applications", r"tablet\s+disintegration", "excipient", r"binding\s+agent", r"flow\s+aid"],
    "SAFETY_INFO": [r"\bGHS\d+\b", r"\bH\d{3}\b", r"\bP\d{3}\b", r"\bEUH\d{3}\b", r"skin\s+irritation", r"eye\s+irritation", r"respiratory\s+sensitization", r"\bLD50\b", r"\bLC50\b"],
    "REGULATORY": [r"\bFDA\b", r"\bEMA\b", r"\bEFSA\b", r"\bUSP\b", r"\bEP\b", r"\bJP\b", r"\bGMP\b", r"\bHACCP\b", r"\bISO\s*\d+\b", r"\bEN\s*\d+\b"],
    "STORAGE_CONDITION": [r"store\s+at\s+\d+(?:-\d+)?\s*°C", r"relative\s+humidity\s+\d+(?:-\d+)?\s*%", r"shelf\s+life\s+\d+\s+(?:months?|years?)", r"keep\s+(?:dry|cool|away\s+from)", r"protect\s+from\s+(?:light|moisture|heat)"],
    "COMPANY_INFO": ["Roquette", r"\b[A-Z][a-z]+\s+(?:GmbH|Ltd|Inc|Corp|SA|SAS|BV)\b", r"\b\d{5}\s+[A-Z][a-z]+\b", r"\b[a-z]+@[a-z]+\.[a-z]{2,}\b", r"\+?\d{1,3}[-\s]?\d{1,4}[-\s]?\d{4,}\b"],
}
#: Words near a product entity that speak for it (fixed values).
PRODUCT_KEYWORDS = {
    "PRODUCT": ["product", "brand", "trade name", "chemical name", "ingredient"],
    "CHEMICAL_COMPOUND": ["chemical", "compound", "formula", "CAS", "EINECS", "molecular"],
    "SPECIFICATION": ["specification", "property", "parameter", "value", "limit", "range"],
    "APPLICATION": ["application", "use", "purpose", "function", "role"],
    "SAFETY_INFO": ["safety", "hazard", "precaution", "warning", "risk", "toxicity"],
    "REGULATORY": ["regulatory", "approval", "compliance", "standard", "certification"],
    "STORAGE_CONDITION": ["storage", "handling", "condition", "temperature", "humidity"],
    "COMPANY_INFO": ["company", "manufacturer", "supplier", "contact", "address"],
}
#: Patterns of food entities, case-blind (fixed values).
FOOD_PATTERNS = {
    "FOOD_INGREDIENT": [r"(?i)\b(?:sodium|potassium|calcium)\s+(?:benzoate|sorbate|citrate|phosphate|chloride)\b", r"(?i)\b(?:xanthan|guar|locust bean|konjac)\s+gum\b", r"(?i)\b(?:lecithin|carrageenan|pectin|agar|gellan|algin)\b", r"(?i)\b(?:maltodextrin|dextrose|fructose|lactose|trehalose)\b", r"(?i)\b(?:ascorbic|citric|lactic|acetic|malic|tartaric)\s+acid\b", r"(?i)\b(?:beta-carotene|lycopene|curcumin|annatto|chlorophyll)\b"],
    "FOOD_ADDITIVE_TYPE": [r"(?i)\b(?:preservative|antioxidant|emulsifier|stabilizer|thickener)\b", r"(?i)\b(?:flavor\s+enhancer|colorant|sweetener|binding\s+agent)\b", r"(?i)\b(?:anti-caking|firming|foaming|glazing|bulking)\s+agent\b", r"(?i)\b(?:humectant|sequestrant|enzyme|releasing\s+agent)\b"],
    "FOOD_APPLICATION": [r"(?i)\b(?:dairy|bakery|beverage|meat|confectionery)\s+(?:products?|goods?|processing)\b", r"(?i)\b(?:frozen|canned|snack|convenience)\s+foods?\b", r"(?i)\b(?:infant\s+formula|dietary\s+supplements|functional\s+foods)\b", r"(?i)\b(?:pet\s+food|sports\s+nutrition|meal\s+replacement)\b"],
    "FOOD_SAFETY_STANDARD": [r"(?i)\bGRAS\s+(?:status|approved)\b", r"(?i)\b(?:FDA|EFSA|FSIS)\s+approved\b", r"(?i)\bE\d{3,4}\b", r"(?i)\bINS\s+\d{3,4}\b", r"(?i)\b(?:HACCP|BRC|SQF|IFS|FSSC|GFSI)\b", r"(?i)\b(?:Kosher|Halal|Organic|Non-GMO)\s+(?:certified|verified)\b", r"(?i)\b(?:USP|EP|Food)\s+grade\b"],
    "NUTRITIONAL_COMPONENT": [r"(?i)\bvitamin\s+[A-K]\d*\b", r"(?i)\b(?:thiamine|riboflavin|niacin|folate|biotin|pantothenic)\b", r"(?i)\b(?:omega-3|omega-6|DHA|EPA|ALA)\b", r"(?i)\b(?:probiotics|prebiotics|antioxidants|polyphenols|flavonoids)\b", r"(?i)\b(?:amino\s+acids|peptides|coenzyme|glucosamine|chondroitin)\b"],
    "FOOD_PROCESSING_METHOD": [r"(?i)\b(?:spray|freeze)\s+drying\b", r"(?i)\b(?:fermentation|extraction|distillation|extrusion)\b", r"(?i)\b(?:micro)?encapsulation\b", r"(?i)\b(?:pasteurization|sterilization|homogenization)\b", r"(?i)\b(?:high\s+pressure|pulsed\s+electric|supercritical)\s+(?:processing|extraction)\b", r"(?i)\b(?:membrane\s+filtration|cold\s+pressing|ultrasound\s+processing)\b"],
    "FOOD_STORAGE_CONDITION": [r"(?i)\b(?:refrigerated|frozen|dry|ambient)\s+storage\b", r"(?i)\b(?:light|moisture|oxygen)-protected\b", r"(?i)\b(?:nitrogen-flushed|vacuum-packed|inert\s+atmosphere)\b", r"(?i)\bfood\s+grade\s+packaging\b", r"(?i)\b(?:modified|controlled)\s+atmosphere\b"],
    "ALLERGEN_INFO": [r"(?i)\bcontains\s+(?:milk|eggs|wheat|soy|nuts|fish|shellfish|sesame)\b", r"(?i)\b(?:gluten|dairy|nut|egg|soy|fish)-free\b", r"(?i)\bmay\s+contain\s+(?:traces|allergens)\b", r"(?i)\bprocessed\s+in\s+facility\b", r"(?i)\b(?:cross-contamination|dedicated\s+facility|allergen\s+control)\b"],
    "RECIPE_COMPONENT": [r"(?i)\b(?:main|minor|key|active)\s+ingredient\b", r"(?i)\b(?:processing\s+aid|flavor\s+system|base\s+formulation)\b", r"(?i)\b(?:premix|concentrate|recipe\s+optimization)\b", r"(?i)\b(?:ingredient\s+ratio|batch\s+formula|master\s+recipe)\b"],
    "INDUSTRIAL_PROCESS_STEP": [r"(?i)\b(?:mixing|blending|heating|cooling|packaging)\b", r"(?i)\b(?:quality\s+control|raw\s+material\s+receiving)\b", r"(?i)\b(?:ingredient\s+weighing|process\s+monitoring)\b", r"(?i)\b(?:final\s+inspection|batch\s+recording|cleaning\s+validation)\b"],
    "FLOW_CHART_ELEMENT": [r"(?i)\b(?:start|end|decision)\s+point\b", r"(?i)\b(?:process\s+step|quality\s+check)\b", r"(?i)\b(?:critical\s+control\s+point|hazard\s+analysis)\b", r"(?i)\b(?:flow\s+direction|process\s+branch|feedback\s+loop)\b"],
}
#: Examples of food entities, found as whole words whatever their case (fixed values).
FOOD_EXAMPLES = {
    "FOOD_INGREDIENT": ["sodium benzoate", "potassium sorbate", "xanthan gum", "lecithin", "citric acid", "ascorbic acid", "tocopherol", "carrageenan", "pectin", "maltodextrin", "monosodium glutamate", "aspartame", "sucralose", "stevia extract", "vanillin", "beta-carotene", "lycopene", "curcumin", "annatto", "spirulina extract"],
    "FOOD_ADDITIVE_TYPE": ["preservative", "antioxidant", "emulsifier", "stabilizer", "thickener", "flavor enhancer", "colorant", "sweetener", "anti-caking agent", "binding agent", "pH adjuster", "firming agent", "foaming agent", "glazing agent", "bulking agent", "humectant", "sequestrant", "enzyme", "flour treatment agent", "releasing agent"],
    "FOOD_APPLICATION": ["dairy products", "bakery goods", "beverages", "meat processing", "confectionery", "sauces and dressings", "frozen foods", "canned foods", "snack foods", "infant formula", "dietary supplements", "functional foods", "ready meals", "pet food", "sports nutrition", "meal replacement", "plant-based alternatives"],
    "FOOD_SAFETY_STANDARD": ["GRAS status", "FDA approved", "EFSA approved", "E-number", "INS number", "HACCP", "BRC", "SQF", "IFS", "FSSC 22000", "Kosher certified", "Halal certified", "Organic certified", "Non-GMO verified", "Food grade", "USP grade", "EP grade", "Global Food Safety Initiative", "ISO 22000", "FDA HARPC", "FSIS approved"],
    "NUTRITIONAL_COMPONENT": ["vitamin A", "vitamin C", "vitamin D", "vitamin E", "thiamine", "riboflavin", "niacin", "folate", "calcium", "iron", "omega-3", "probiotics", "prebiotics", "protein", "fiber", "antioxidants", "polyphenols", "carotenoids", "flavonoids", "amino acids", "peptides", "coenzyme Q10", "glucosamine", "chondroitin"],
    "FOOD_PROCESSING_METHOD": ["spray drying", "freeze drying", "fermentation", "extraction", "distillation", "encapsulation", "microencapsulation", "homogenization", "pasteurization", "sterilization", "ultrafiltration", "reverse osmosis", "crystallization", "extrusion", "high pressure processing", "pulsed electric field", "ultrasound", "membrane filtration", "supercritical extraction", "cold pressing"],
    "FOOD_STORAGE_CONDITION": ["refrigerated storage", "frozen storage", "dry storage", "controlled atmosphere", "light-protected", "moisture-protected", "nitrogen-flushed", "vacuum-packed", "food grade packaging", "temperature controlled", "humidity controlled", "inert atmosphere", "desiccant packaging", "modified atmosphere packaging"],
    "ALLERGEN_INFO": ["contains milk", "contains eggs", "contains wheat", "contains soy", "contains nuts", "contains fish", "contains shellfish", "contains sesame", "gluten-free", "dairy-free", "nut-free", "allergen-free", "may contain traces", "processed in facility", "cross-contamination", "dedicated facility", "allergen control program"],
    "RECIPE_COMPONENT": ["main ingredient", "minor ingredient", "processing aid", "flavor system", "base formulation", "premix", "concentrate", "recipe optimization", "ingredient ratio", "batch formula", "master recipe", "standard recipe"],
    "INDUSTRIAL_PROCESS_STEP": ["mixing", "blending", "heating", "cooling", "packaging", "quality control", "raw material receiving", "ingredient weighing", "process monitoring", "final inspection", "batch recording", "cleaning validation", "line changeover"],
    "FLOW_CHART_ELEMENT": ["start point", "end point", "decision point", "process step", "input", "output", "quality check", "critical control point", "hazard analysis", "flow direction", "process branch", "alternative path", "feedback loop"],
}
#: Verbs of relations between food entities (fixed values).
FOOD_RELATIONS = {
    "USED_IN_FOOD": [r"used\s+in", r"added\s+to", r"incorporated\s+in", r"applied\s+to", r"formulated\s+in"],
    "HAS_FUNCTION": [r"functions\s+as", r"acts\s+as", r"serves\s+as", "provides", r"performs\s+as"],
    "APPROVED_FOR": [r"approved\s+for", r"permitted\s+in", r"allowed\s+in", r"GRAS\s+for", r"certified\s+for"],
    "CONTAINS_ALLERGEN": ["contains", r"source\s+of", r"derived\s+from", r"may\s+contain", "includes"],
    "REPLACES_INGREDIENT": ["replaces", r"substitute\s+for", r"alternative\s+to", r"instead\s+of", r"can\s+replace"],
    "ENHANCES_PROPERTY": ["enhances", "improves", "increases", "stabilizes", "extends", "optimizes"],
    "PROCESS_FOLLOWS": [r"followed\s+by", "then", r"next\s+step", "subsequently", "after"],
    "PRECEDES_STEP": ["before", r"prior\s+to", "precedes", r"leads\s+to", r"followed\s+by"],
    "CONTROLS_PROCESS": ["controls", "regulates", "monitors", "manages", "governs"],
    "RECIPE_INCLUDES": ["includes", "contains", "requires", "specifies", r"calls\s+for"],
}
#: How a product entity's value is brought to one form (fixed values).
NORMALIZE = {
    "PRODUCT": {"remove": ["®", "™", "©"], "case": "title"},
    "CHEMICAL_COMPOUND": {"case": "lower"},
    "SPECIFICATION": {"units": {"percent": "%", "degree celsius": "°C", "degrees celsius": "°C", "micrometer": "µm", "micron": "µm"}},
}
#: What a product entity's text must keep to (fixed values).
VALIDATE = {
    "SPECIFICATION": {"pattern": r"\d+(?:\.\d+)?\s*\w+"},
    "CHEMICAL_COMPOUND": {"min_length": 3, "max_length": 100, "forbidden": ["@", "#", "$"]},
    "PRODUCT": {"min_length": 2, "max_length": 50, "uppercase": True},
}
#: Words near a food entity that speak for it, 0.15 each (fixed values).
FOOD_INDICATORS = {
    "FOOD_INGREDIENT": ["ingredient", "additive", "preservative", "stabilizer"],
    "FOOD_ADDITIVE_TYPE": ["function", "purpose", "used as", "acts as"],
    "FOOD_APPLICATION": ["used in", "suitable for", "application", "product"],
    "FOOD_SAFETY_STANDARD": ["approved", "certified", "compliant", "standard"],
    "NUTRITIONAL_COMPONENT": ["vitamin", "mineral", "nutrient", "supplement"],
    "ALLERGEN_INFO": ["contains", "allergen", "free", "may contain"],
}
#: Patterns near a food entity of a kind that speak for it, once, and by how much (fixed values).
FOOD_BONUSES = {
    "FOOD_SAFETY_STANDARD": (r"haccp|gmp|brc|sqf|ifs|fssc|gras|fda approved|food grade|kosher|halal|organic|non-gmo", 0.2),
    "NUTRITIONAL_COMPONENT": (r"\d+\s*(?:mg|g|%|iu)", 0.15),
    "ALLERGEN_INFO": (r"allergen|contains", 0.2),
}
#: Patterns of what stands near a food entity, case-blind (fixed values).
FOOD_VALUES = {
    "vitamin": r"\bvitamin\s+([A-K]\d*)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*([μmg/IU]+)",
    "mineral": r"\b(calcium|iron|zinc|magnesium|potassium)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(mg|g|%)",
    "gras": r"\b(GRAS)\s*(?:status|approved|recognized)?\b",
    "e_number": r"\bE\s*(\d{3,4})\b",
    "contains": r"\b(?:contains?|may contain)\s+([^.]+)",
    "free": r"\b(gluten|dairy|nut|soy|egg|fish|shellfish)-free\b",
    "shelf_life": r"\bshelf\s+life\s*[:\-]?\s*(\d+)\s*(days?|months?|years?)\b",
}
#: Words that speak for a relation, 0.25 each up to 0.7 (fixed values).
RELATION_INDICATORS = {
    "USED_IN_FOOD": ["used in", "added to", "incorporated", "ingredient in"],
    "HAS_FUNCTION": ["functions as", "acts as", "serves as", "provides"],
    "APPROVED_FOR": ["approved for", "permitted", "GRAS for", "allowed"],
    "CONTAINS_ALLERGEN": ["contains", "source of", "derived from", "may contain"],
    "REPLACES_INGREDIENT": ["replaces", "substitute", "alternative", "instead of"],
    "ENHANCES_PROPERTY": ["enhances", "improves", "stabilizes", "extends", "preserves"],
}
#: Kinds of source and target that speak for a relation, and words of food that do (fixed values).
RELATION_PAIRS = {
    "USED_IN_FOOD": [("FOOD_INGREDIENT", "FOOD_APPLICATION"), ("NUTRITIONAL_COMPONENT", "FOOD_APPLICATION")],
    "HAS_FUNCTION": [("FOOD_INGREDIENT", "FOOD_ADDITIVE_TYPE"), ("NUTRITIONAL_COMPONENT", "FOOD_ADDITIVE_TYPE")],
    "APPROVED_FOR": [("FOOD_INGREDIENT", "FOOD_SAFETY_STANDARD"), ("NUTRITIONAL_COMPONENT", "FOOD_SAFETY_STANDARD")],
    "CONTAINS_ALLERGEN": [("FOOD_INGREDIENT", "ALLERGEN_INFO"), ("PRODUCT", "ALLERGEN_INFO")],
}
RELATION_WORDS = ["food", "ingredient", "additive", "preservative"]
