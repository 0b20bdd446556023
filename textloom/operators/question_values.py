"""Fixed values of the question operators: keywords, patterns and terms, as results depend on them."""

# Keywords of each domain.
DOMAIN_WORDS = {
    "agricultural": ["fertilizer", "pesticide", "herbicide", "crop", "field", "soil", "agriculture", "farming", "plant", "seed", "cultivation", "harvest", "fungicide", "insecticide", "nitrogen", "phosphorus", "potassium"],
    "food_industry": [
        "ingredient", "additive", "preservative", "flavor", "nutrition", "food", "beverage", "dietary", "allergen", "vitamin", "mineral", "protein", "supplement", "gras", "fda", "e-number", "kosher", "halal",
        "bakery", "dairy", "confectionery", "snack", "emulsifier", "stabilizer", "sweetener", "colorant", "thickener", "antioxidant", "pectin", "gelatin", "lecithin", "carrageenan", "xanthan", "agar", "maltodextrin", "dextrose",
    ],
    "legal": [
        "contract", "agreement", "clause", "provision", "obligation", "liability", "warranty", "indemnity", "breach", "compliance", "regulatory", "license", "intellectual property", "confidentiality",
        "non-disclosure", "terms", "conditions", "governing law", "jurisdiction", "arbitration", "dispute", "termination", "force majeure", "amendment", "assignment", "sublicense",
    ],
    "mixed": ["organic", "natural", "extract", "processing", "manufacturing", "quality", "safety", "regulatory", "certification"],
}

# Patterns of each intent.
INTENTS = {
    "product_information": [r"what is.*?(?:product|fertilizer|pesticide)", r"(?:tell me about|describe|information about).*?(?:product|brand)", r"(?:properties|characteristics|features) of", r"(?:composition|ingredients|active.*?ingredient)"],
    "application_instructions": [r"how to (?:apply|use|mix)", r"application (?:rate|method|timing)", r"when to (?:apply|spray|use)", r"(?:dosage|dose|rate|amount) (?:for|of|per)"],
    "efficacy_performance": [r"(?:effectiveness|efficacy|performance|results)", r"(?:yield|increase|improvement|benefit)", r"(?:trial|test|study|research) results?", r"(?:compared to|vs|versus|against)"],
    "safety_regulatory": [r"(?:safety|hazard|risk|precaution)", r"(?:ghs|sds|msds|safety data)", r"(?:registration|approval|certified|compliant)", r"(?:ppe|protective equipment|warning)"],
    "compatibility_mixing": [r"(?:compatible|mix|tank.*?mix|combine)", r"(?:can.*?be.*?mixed|mixing|blend)", r"(?:incompatible|do not mix|avoid)"],
    "crop_specific": [r"(?:for|on|in) (?:corn|wheat|tomato|soybean|rice)", r"crop (?:specific|recommendation|application)", r"variety|cultivar|species"],
    "technical_specs": [r"(?:specification|parameter|property)", r"(?:ph|density|solubility|concentration)", r"(?:analysis|analytical|test.*?method)", r"(?:storage|shelf.*?life|stability)"],
    "comparison": [r"(?:compare|comparison|vs|versus|against)", r"(?:difference|similar|alternative|substitute)", r"(?:better|best|optimal|recommend)"],
    "ingredient_information": [
        r"what is.*?(?:ingredient|additive|preservative|stabilizer)", r"(?:tell me about|describe|information about).*?(?:ingredient|food additive)",
        r"(?:properties|characteristics|features) of.*?(?:ingredient|additive)", r"(?:composition|components|formula) of.*?(?:ingredient|food product)",
    ],
    "nutritional_inquiry": [r"(?:nutritional|nutrition) (?:content|value|information)", r"(?:vitamin|mineral|protein|calories) (?:content|level|amount)", r"how (?:much|many) (?:calories|protein|vitamin|mineral)", r"(?:macro|micro)nutrients? in", r"daily value|dv|recommended daily"],
    "allergen_safety": [
        r"(?:allergen|allergenic) (?:information|content|declaration)", r"(?:contains|has|includes) (?:any|which) (?:allergens?)", r"(?:allergen|dairy|gluten|nut|soy|egg|fish|shellfish).{0,5}free",
        r"(?:may contain|processed in|cross.{0,5}contamination)", r"allergen labeling|allergen statement",
    ],
    "food_regulatory": [r"(?:gras|fda|efsa) (?:status|approved|certified)", r"(?:e.{0,5}number|ins.{0,5}number|food additive number)", r"(?:regulatory|compliance) (?:status|approval|certification)", r"(?:kosher|halal|organic) certified", r"food grade|food quality"],
    "food_application": [
        r"(?:used|suitable|applied) (?:in|for) (?:food|beverage|dairy|bakery)", r"(?:applications?|uses?) (?:in|for) (?:food industry|food products)", r"(?:bakery|dairy|beverage|meat|confectionery|snack) (?:applications?|products?)",
        r"can.*?be used in.*?(?:food|beverage|product)", r"suitable for.*?(?:food|beverage|dairy|bakery)",
    ],
    "food_processing": [r"(?:processing|manufacturing) (?:method|technique|process)", r"(?:spray dry|freeze dry|extract|ferment|encapsulat)", r"(?:stability|shelf life|storage) (?:conditions?|requirements?)", r"(?:solubility|dispersibility|flow) properties"],
    "substitution_alternatives": [r"(?:alternative|substitute|replacement) (?:to|for)", r"what can (?:replace|substitute)", r"(?:alternatives|substitutes) (?:to|for)", r"(?:natural|synthetic) alternative", r"clean label (?:alternative|substitute)"],
    "contract_analysis": [r"(?:contract|agreement) (?:terms|conditions|provisions)", r"(?:analyze|review|examine) (?:contract|agreement)", r"(?:obligations|responsibilities) (?:under|in) (?:contract|agreement)", r"contractual (?:obligations|terms|provisions)"],
    "compliance_inquiry": [r"(?:compliance|regulatory) (?:requirements|obligations)", r"(?:must|required to|obligated to|shall)", r"(?:regulation|law|standard) (?:requires|mandates|specifies)", r"(?:compliance with|adherence to|conform to)"],
    "liability_warranty": [r"(?:liability|responsibility|fault) (?:for|of|under)", r"(?:warranty|guarantee|assurance) (?:of|for|that)", r"(?:indemnification|indemnity|hold harmless)", r"(?:damages|loss|injury|harm) (?:arising|resulting)"],
    "intellectual_property": [r"(?:intellectual property|ip|patent|trademark|copyright)", r"(?:proprietary|confidential) (?:information|data|technology)", r"(?:license|licensing) (?:rights|agreement|terms)", r"(?:non-disclosure|confidentiality|trade secret)"],
    "termination_dispute": [r"(?:termination|end|cancel|dissolution) (?:of|clause|provision)", r"(?:breach|violation|default) (?:of|under)", r"(?:dispute|conflict|disagreement) (?:resolution|procedure)", r"(?:arbitration|mediation|litigation|court)"],
}

# Patterns of mentions, and which hold in a domain (all in others).
MENTIONS = {
    "product_name": r"\b(?:product|brand|formulation|ingredient)\s+([A-Za-z0-9\-\s]+)",
    "chemical_compound": r"\b([A-Z][a-z]*(?:\s+[A-Z][a-z]*)*)\s+(?:compound|chemical|acid|salt)",
    "crop_name": r"\b(?:crop|plant|variety|cultivar)\s+([A-Za-z\s]+)",
    "application_method": r"\b(?:spray|apply|use|mix)\s+([A-Za-z\s]+)",
    "measurement": r"(\d+(?:\.\d+)?)\s*(kg|g|ml|l|ppm|%|percent)",
    "food_ingredient": r"\b(?:ingredient|additive|preservative|stabilizer|emulsifier)\s+([A-Za-z0-9\-\s]+)",
    "vitamin_mineral": r"\b(vitamin\s+[A-K]\d*|calcium|iron|zinc|magnesium|potassium)",
    "allergen": r"\b(dairy|gluten|nuts?|soy|eggs?|fish|shellfish|wheat|sesame)",
    "food_category": r"\b(bakery|dairy|beverage|meat|confectionery|snack|sauce)\s+(?:product|application)",
    "certification": r"\b(organic|kosher|halal|non-gmo|gras|fda\s+approved)",
    "e_number": r"\bE\s*(\d{3,4})\b",
    "processing_method": r"\b(spray\s+dry|freeze\s+dry|extract|ferment|encapsulat)",
}
MENTIONS_OF = {
    "agricultural": ["product_name", "chemical_compound", "crop_name", "application_method", "measurement"],
    "food_industry": ["measurement", "food_ingredient", "vitamin_mineral", "allergen", "food_category", "certification", "e_number", "processing_method"],
}

# How much an entity type matters to an intent (0.3 if not listed).
RELEVANCE = {
    "product_information": {"PRODUCT": 1.0, "CHEMICAL_COMPOUND": 0.9, "SPECIFICATION": 0.8, "COMPANY_INFO": 0.7, "REGULATORY": 0.6},
    "application_instructions": {"APPLICATION": 1.0, "METHOD": 1.0, "TIMING": 0.9, "CROP": 0.8, "PRODUCT": 0.8, "METRIC": 0.7},
    "efficacy_performance": {"METRIC": 1.0, "APPLICATION": 0.9, "CROP": 0.8, "PRODUCT": 0.8, "SPECIFICATION": 0.6},
    "safety_regulatory": {"SAFETY_HAZARD": 1.0, "REGULATORY": 1.0, "CHEMICAL_COMPOUND": 0.8, "PRODUCT": 0.7, "STORAGE_CONDITION": 0.9},
    "compatibility_mixing": {"PRODUCT": 1.0, "CHEMICAL_COMPOUND": 0.9, "APPLICATION": 0.8, "METHOD": 0.7},
    "crop_specific": {"CROP": 1.0, "APPLICATION": 0.9, "PRODUCT": 0.8, "TIMING": 0.8, "METHOD": 0.7},
    "technical_specs": {"SPECIFICATION": 1.0, "CHEMICAL_COMPOUND": 0.9, "PRODUCT": 0.8, "STORAGE_CONDITION": 0.8, "REGULATORY": 0.6},
    "comparison": {"PRODUCT": 1.0, "METRIC": 0.9, "SPECIFICATION": 0.8, "APPLICATION": 0.7, "CROP": 0.7},
    "ingredient_information": {"FOOD_INGREDIENT": 1.0, "NUTRITIONAL_COMPONENT": 0.9, "FOOD_ADDITIVE_TYPE": 0.8, "FOOD_SAFETY_STANDARD": 0.7, "FOOD_PROCESSING_METHOD": 0.6},
    "nutritional_inquiry": {"NUTRITIONAL_COMPONENT": 1.0, "FOOD_INGREDIENT": 0.9, "FOOD_APPLICATION": 0.7, "ALLERGEN_INFO": 0.6},
    "allergen_safety": {"ALLERGEN_INFO": 1.0, "FOOD_INGREDIENT": 0.9, "FOOD_SAFETY_STANDARD": 0.8, "FOOD_APPLICATION": 0.7},
    "food_regulatory": {"FOOD_SAFETY_STANDARD": 1.0, "FOOD_INGREDIENT": 0.9, "NUTRITIONAL_COMPONENT": 0.7, "FOOD_ADDITIVE_TYPE": 0.8},
    "food_application": {"FOOD_APPLICATION": 1.0, "FOOD_INGREDIENT": 0.9, "FOOD_ADDITIVE_TYPE": 0.8, "FOOD_PROCESSING_METHOD": 0.7},
    "food_processing": {"FOOD_PROCESSING_METHOD": 1.0, "FOOD_STORAGE_CONDITION": 0.9, "FOOD_INGREDIENT": 0.8, "FOOD_ADDITIVE_TYPE": 0.7},
    "substitution_alternatives": {"FOOD_INGREDIENT": 1.0, "FOOD_ADDITIVE_TYPE": 0.9, "NUTRITIONAL_COMPONENT": 0.8, "FOOD_APPLICATION": 0.7},
    "contract_analysis": {"LEGAL_PROVISION": 1.0, "LEGAL_OBLIGATION": 0.9, "LEGAL_CLAUSE": 0.8, "LEGAL_TERM": 0.7, "PARTY": 0.8, "AGREEMENT_TYPE": 0.9},
    "compliance_inquiry": {"REGULATORY_REQUIREMENT": 1.0, "LEGAL_OBLIGATION": 0.9, "COMPLIANCE_STANDARD": 0.8, "LEGAL_PROVISION": 0.7, "REGULATORY_BODY": 0.8},
    "liability_warranty": {"LIABILITY_CLAUSE": 1.0, "WARRANTY_PROVISION": 1.0, "INDEMNITY_CLAUSE": 0.9, "DAMAGE_TYPE": 0.8, "LEGAL_REMEDY": 0.7},
    "intellectual_property": {"IP_RIGHT": 1.0, "CONFIDENTIAL_INFO": 0.9, "LICENSE_TERM": 0.8, "PROPRIETARY_TECH": 0.8, "TRADE_SECRET": 0.9},
    "termination_dispute": {"TERMINATION_CLAUSE": 1.0, "BREACH_TYPE": 0.9, "DISPUTE_RESOLUTION": 0.8, "ARBITRATION_CLAUSE": 0.8, "GOVERNING_LAW": 0.7},
}

# Expansion terms by domain and intent, by entity type, by domain, and synonyms.
INTENT_TERMS = {
    "agricultural": {
        "product_information": ["specification", "datasheet", "technical", "properties"],
        "application_instructions": ["rate", "method", "timing", "instructions", "guidelines"],
        "efficacy_performance": ["yield", "effectiveness", "results", "performance", "trial"],
        "safety_regulatory": ["safety", "ghs", "hazard", "regulation", "approval"],
        "compatibility_mixing": ["compatible", "tank mix", "combination", "mixing"],
        "crop_specific": ["crop", "variety", "cultivar", "species"],
        "technical_specs": ["analysis", "parameter", "specification", "property"],
        "comparison": ["compare", "alternative", "versus", "similar"],
    },
    "food_industry": {
        "ingredient_information": ["datasheet", "specification", "properties", "composition"],
        "nutritional_inquiry": ["nutrition", "vitamin", "mineral", "content", "value"],
        "allergen_safety": ["allergen", "safe", "free", "declaration", "labeling"],
        "food_regulatory": ["gras", "approved", "certified", "compliant", "regulation"],
        "food_application": ["application", "use", "suitable", "bakery", "dairy"],
        "food_processing": ["processing", "stability", "storage", "shelf life"],
        "substitution_alternatives": ["alternative", "substitute", "replacement", "similar"],
    },
    "legal": {
        "contract_analysis": ["clause", "provision", "term", "obligation", "condition"],
        "compliance_inquiry": ["requirement", "mandate", "regulation", "standard", "compliance"],
        "liability_warranty": ["liability", "warranty", "indemnity", "damages", "responsibility"],
        "intellectual_property": ["patent", "trademark", "copyright", "confidential", "proprietary"],
        "termination_dispute": ["termination", "breach", "dispute", "arbitration", "resolution"],
    },
}
TYPE_TERMS = {
    "PRODUCT": ["application", "rate", "instructions", "specification"],
    "CROP": ["variety", "cultivation", "growth", "harvest"],
    "CHEMICAL_COMPOUND": ["formula", "properties", "safety", "analysis"],
    "FOOD_INGREDIENT": ["specification", "application", "usage", "properties"],
    "NUTRITIONAL_COMPONENT": ["content", "value", "bioavailability", "daily value"],
    "ALLERGEN_INFO": ["declaration", "labeling", "cross contamination", "free"],
    "FOOD_SAFETY_STANDARD": ["approved", "certified", "compliant", "regulation"],
    "FOOD_APPLICATION": ["suitable", "use", "processing", "manufacturing"],
}
DOMAIN_TERMS = {"food_industry": ["food grade", "kosher", "halal", "organic", "non-gmo"], "agricultural": ["field", "farm", "crop protection", "yield"]}
SYNONYMS = {
    "nitrogen": ["n", "nitrate", "ammonium"],
    "phosphorus": ["p", "phosphate", "p2o5"],
    "potassium": ["k", "potash", "k2o"],
    "fertilizer": ["nutrient", "plant food", "amendment"],
    "pesticide": ["crop protection", "pest control", "chemical"],
    "vitamin c": ["ascorbic acid", "l-ascorbic acid", "ascorbate"],
    "vitamin e": ["tocopherol", "alpha-tocopherol", "d-alpha-tocopherol"],
    "preservative": ["antimicrobial", "antioxidant", "stabilizer"],
    "emulsifier": ["surfactant", "lecithin", "stabilizer"],
    "sweetener": ["sugar substitute", "artificial sweetener", "low calorie sweetener"],
    "thickener": ["hydrocolloid", "gelling agent", "viscosity modifier"],
    "colorant": ["food coloring", "food dye", "natural color"],
    "flavoring": ["flavor enhancer", "natural flavor", "artificial flavor"],
}

# Document types to search, by domain.
DOCUMENT_TYPES = {
    "food_industry": ["food_sds", "nutritional_info", "ingredient_spec", "coa", "allergen_declaration", "regulatory_compliance"],
    "legal": ["contract", "agreement", "legal_document", "compliance_doc", "regulatory_filing"],
    "agricultural": ["agricultural", "general"],
    "mixed": ["agricultural", "food_sds", "legal_document", "general"],
}
