"""Value sets, thresholds and word lists."""

from __future__ import annotations

# Allowed labels and their order.
MATURITY_LEVELS = ("weak_signal", "emerging", "established", "megatrend")
RADAR_STAGES = ("act", "prepare", "watch")
PORTFOLIO_STATUSES = ("active", "review", "rejected", "dormant", "merged")
CHANGE_TYPES = ("new", "classification_changed", "content_changed", "evidence_only", "unchanged")
REVIEW_STATUSES = ("pending", "not_required", "approved", "rejected")
PESTEL_DIMENSIONS = ("political", "economic", "social", "technological", "environmental", "legal")
CATEGORIES = ("climate", "technology", "digital", "markets")
SUPPORTED_LANGUAGES = ("de", "en")
DECISION_ACTIONS = ("confirm", "correct", "reject", "restore", "link", "create", "merge")
RADAR_SECTORS = ("environmental", "technological", "social", "legal", "political", "economic")

# Fields compared between a run and the portfolio.
PROPOSED_FIELDS = (
    "title", "summary", "maturity", "pestel", "category", "impact", "urgency", "uncertainty", "radar_stage",
)
ALWAYS_MATERIAL = ("title", "maturity", "pestel", "category", "radar_stage")
SCORE_FIELDS = ("impact", "urgency", "uncertainty")

# Thresholds and limits.
EMBEDDING_DIM = 384
MATCH_THRESHOLD = 0.62
REVIEW_THRESHOLD = 0.50
MATCH_MARGIN = 0.08
NUMERIC_NOISE = 0.05
MATERIAL_SCORE_DELTA = 2.0
MAX_NEW_TRENDS = 5
MAX_TOPICS = 12
MAX_QUARTERS = 24
EVIDENCE_K = 6
NEAR_DUPLICATE_RATIO = 0.94
NEAR_DUPLICATE_LOOKBACK = 200
OVERLAP_THRESHOLD = 0.18
MAX_SEED_QUERIES = 12
MATURITY_IMPACT = {"weak_signal": 3.0, "emerging": 5.5, "established": 7.0, "megatrend": 9.0}
DEPTH_PROFILES = {
    "quick": {"max_docs": 30, "rounds": 1, "per_query": 10},
    "standard": {"max_docs": 100, "rounds": 2, "per_query": 15},
    "deep": {"max_docs": 200, "rounds": 3, "per_query": 25},
}
RING_BANDS = {"act": (0.14, 0.36), "prepare": (0.40, 0.66), "watch": (0.70, 0.98)}

# Query parameters without meaning for the identity of a page.
TRACKING_PARAMS = ("fbclid", "gclid", "ref", "source")

# Indicator terms per macro dimension.
PESTEL_LEXICON = {
    "political": (
        "policy policies government governmental subsidy subsidies tariff tariffs geopolitical geopolitics public "
        "funding incentive incentives sovereignty trade ministry municipal election sanction sanctions diplomacy "
        "federal parliament programme program initiative governance"
    ).split(),
    "economic": (
        "market markets cost costs investment investments price prices pricing demand supply economic economy "
        "business growth servitization productivity competition competitor financing finance capital revenue "
        "profitability inflation procurement export import industry manufacturer startup venture adoption "
        "commercialization commercialisation leasing"
    ).split(),
    "social": (
        "social society societal demographic demographics skills workforce user users health wellbeing well-being "
        "community labour labor talent people silver aging ageing occupant occupants tenant tenants resident "
        "residents comfort affordable affordability housing urbanization urbanisation migration lifestyle "
        "acceptance education craftsman shortage safety accessibility"
    ).split(),
    "technological": (
        "technology technologies digital sensor sensors automation software innovation smart platform robotic "
        "robotics data twin modular prefabrication ai algorithm machine learning iot bim printing additive coating "
        "nanotechnology photovoltaic photovoltaics electrochromic aerogel prototype patent material materials "
        "glazing actuator interoperability cyber"
    ).split(),
    "environmental": (
        "climate carbon sustainability sustainable energy emission emissions circular circularity green "
        "environmental decarbonization decarbonisation resilience renewable renewables recycling recycled embodied "
        "biodiversity pollution waste warming adaptation mitigation heatwave cradle lifecycle life-cycle ecological "
        "solar geothermal"
    ).split(),
    "legal": (
        "legal law laws compliance standard standards directive directives epbd certification certified regulation "
        "regulations regulatory norm norms mandate mandatory liability warranty code codes taxonomy disclosure "
        "audit gdpr din iso ce permit permits zoning"
    ).split(),
}

# Indicator terms per thematic category; the order breaks ties.
CATEGORY_LEXICON = {
    "climate": (
        "climate carbon decarbonization decarbonisation sustainability energy emission green resilience circular "
        "circularity renewable regenerative"
    ).split(),
    "technology": (
        "material materials sensor facade envelope building photovoltaic bipv glass construction insulation skin"
    ).split(),
    "digital": "ai digital software automation autonomous data platform iot twin computing algorithm".split(),
    "markets": (
        "market markets servitization business renovation retrofit investment skills industrialization "
        "industrialisation service"
    ).split(),
}
CATEGORY_DEFAULT_PESTEL = {
    "climate": "environmental", "markets": "economic", "digital": "technological", "technology": "technological",
}

# ISO-2 countries per macro region.
REGION_COUNTRIES = {
    "Europe": "DE AT CH FR GB IT ES NL BE DK SE NO FI PL PT IE CZ GR RO HU".split(),
    "Asia": "CN JP KR IN SG HK TW ID MY TH AE SA IL TR VN".split(),
    "North America": "US CA MX".split(),
    "South America": "BR AR CL CO".split(),
    "Africa": "ZA EG NG MA KE".split(),
    "Oceania": "AU NZ".split(),
}

# Words without weight in the overlap evaluation.
OVERLAP_STOP = (
    "and", "the", "for", "with", "from", "into", "trend", "trends", "building", "buildings", "construction",
)

# Words skipped when queries are expanded from titles.
EXPANSION_STOP = tuple(
    (
        "with from into over under about their there this that these those which where when what while will would "
        "could should shall might must have has had been being also more most less least very much many some such "
        "only just than then them they your yours ours mine between among within without across during before "
        "after above below again further once here both each other same study review analysis based using towards "
        "toward paper article research results"
    ).split()
)

# Search context per region and the six query lenses.
REGION_CONTEXT = {
    "global": "",
    "europe": "Europe European Union",
    "dach": "Germany Austria Switzerland DACH",
    "north_america": "North America United States Canada",
    "asia_pacific": "Asia Pacific APAC",
    "china": "China Chinese market",
}
PESTEL_LENSES = (
    "policy public funding geopolitics",
    "market costs investment demand supply chain",
    "users health workforce demographics society",
    "technology innovation automation digitalization",
    "climate emissions energy circularity resilience",
    "regulation standards compliance certification law",
)

# Our own short list of English function words for topic keywords (a parameter of every operator using it).
STOP_WORDS = tuple(
    (
        "a about above after again against all am an and any are as at be because been before being below between "
        "both but by can could did do does doing down during each few for from further had has have having he her "
        "here hers him his how i if in into is it its itself just me more most my no nor not now of off on once "
        "only or other our ours out over own same she should so some such than that the their theirs them then "
        "there these they this those through to too under until up very was we were what when where which while "
        "who whom why will with would you your yours"
    ).split()
)
