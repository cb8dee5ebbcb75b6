"""Name-based rules: target hints, PII / sensitive hints, domain tokens.

All matching is done on the *normalised* column name: lower-case, spaces
replaced by ``_``.  The rules are applied as Spark column expressions over a
catalog DataFrame (one row per column of every table), never in a Python loop
over data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for identical results) ---------
# Target-name hints, in priority order.
TARGET_HINTS = ("target", "label", "class", "outcome", "response", "y",
                "churn", "attrition", "default", "purchase")
# Dataset-profile PII and sensitive hints (substring match).
PROFILE_PII_HINTS = ("email", "phone", "ssn", "passport", "address", "dob", "name")
PROFILE_SENSITIVE_HINTS = ("income", "salary", "health", "medical", "credit",
                           "religion", "race", "gender")
# Risk-assessment PII and sensitive hints (substring match).
RISK_PII_HINTS = ("email", "phone", "ssn", "social", "passport", "dob",
                  "date_of_birth", "address", "name")
RISK_SENSITIVE_HINTS = ("income", "salary", "medical", "health", "ethnicity",
                        "gender", "race", "religion", "credit")
# Business domain: first group with a token found in the joined feature names.
DOMAIN_RULES = (
    ("customer_analytics", ("churn", "retention", "customer", "sales", "purchase")),
    ("financial_risk", ("fraud", "transaction", "payment", "chargeback", "risk")),
    ("healthcare", ("health", "medical", "patient", "diagnosis")),
    ("nlp", ("review", "text", "comment", "message", "description")),
    ("computer_vision", ("image", "pixel", "vision", "camera")),
    ("time_series", ("time", "date", "timestamp", "month", "year")),
)
DOMAIN_DEFAULT = "general_tabular"
# Industry from domain first, then tokens, else analytics.
INDUSTRY_BY_DOMAIN = (
    ("financial_risk", "fintech"),
    ("healthcare", "healthcare"),
    ("time_series", "operations"),
    ("nlp", "media"),
)
INDUSTRY_TOKEN_RULES = (
    ("retail", ("retail", "product", "inventory")),
    ("human_resources", ("hr", "employee", "attrition", "salary")),
)
INDUSTRY_DEFAULT = "analytics"
# Specialist tags (per table).
TAG_TIME_TOKENS = ("date", "time", "timestamp", "month", "day", "year")
TAG_TEXT_TOKENS = ("text", "review", "comment", "description", "message", "content", "note")
TAG_RECOMMENDER_TOKENS = ("user", "item", "product", "rating", "movie", "purchase")
# ---------------------------------------------------------------------------


def normalise(col: Column) -> Column:
    """lower-case, spaces -> underscore."""
    return F.replace(F.lower(col), F.lit(" "), F.lit("_"))


def contains_any(col: Column, tokens) -> Column:
    """True when any token is a substring of ``col`` (no regex escaping issues)."""
    expr = F.lit(False)
    for t in tokens:
        expr = expr | F.contains(col, F.lit(t))
    return expr


def sql_contains_any(expr: str, tokens) -> str:
    """Same predicate as ``contains_any`` written in ANSI SQL (for oracles)."""
    return "(" + " OR ".join(f"contains({expr}, '{t}')" for t in tokens) + ")"
