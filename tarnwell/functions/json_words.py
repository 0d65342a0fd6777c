"""The words, patterns and weights by which JSON documents are told apart."""

# Words and patterns by which documents are told apart, and the weights and thresholds of the decision.
DRILL_DOWN = ("drill_down", "breakdown", "hierarchical_analysis", "detailed_view", "sub_analysis", "nested_data")
KEY_TYPES = {"identifiers": ("id", "key", "uuid", "guid"), "names": ("name", "title", "label"), "values": ("value", "amount", "price", "cost"), "descriptions": ("description", "summary", "detail"), "categories": ("type", "category", "class", "group")}
DOMAINS = {
    "analytics": ("metric", "analysis", "performance", "trend"),
    "configuration": ("config", "setting", "parameter", "option"),
    "business_data": ("customer", "product", "order", "transaction"),
    "temporal": ("time", "date", "period", "timestamp"),
    "geographical": ("location", "region", "country", "geo"),
}
METRIC_PATTERNS = {"percentage": "percent|%|ratio|rate", "change": "change|delta|diff|growth|decline", "count": "count|total|sum|number|quantity", "average": "average|mean|avg", "comparison": r"vs|versus|compare|period\d+"}
TEMPORAL = r"\d{4}-\d{2}-\d{2}|time|date"
PERFORMANCE = ("performance", "metric", "score", "rate", "change", "growth")
REASONING = ("reason", "because", "due", "analysis", "explanation")
METADATA = ("meta", "config", "info", "header", "settings")
COLLECTIONS = ("data", "items", "entities", "records", "results")
TECHNICAL = ("id", "type", "count", "total", "sum", "max", "min", "config", "meta", "info", "data", "key", "value")
STRATEGIES = ("flat", "hierarchical", "semantic", "dimensional", "hybrid")
THRESHOLDS = {"max_flat_depth": 3, "max_flat_keys": 20, "min_hierarchical_depth": 4, "dimensional_array_ratio": 0.4, "large_document_size": 1_000_000, "min_confidence": 0.4}
TYPES, WRITTEN = (*KEY_TYPES, "numeric_key", "constant", "snake_case", "camelCase", "other"), ("snake_case", "camelCase", "UPPER_CASE", "lowercase", "kebab-case", "mixed")
TEXTS = ("date_iso", "numeric_string", "long_text", "sentence", "uppercase_text", "short_text")
# End of the fixed values.
