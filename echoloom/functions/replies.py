"""Model replies: find the JSON, repair it, normalise labels, check and adjust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions.steps import compact, first_contained, lookup
from echoloom.functions.text import compute_once, strip, text_or_empty

REPLY = (
    "feedback_type string, severity_level string, component string, type_confidence string, severity_confidence string, "
    "component_confidence string, version string, keywords array<string>, sentiment string, "
    "urgency_indicators array<string>, item_id string, corrupt string"
)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "allowSingleQuotes": "false"}


def json_span(reply: Column, opening: str = "{", closing: str = "}") -> Column:
    """From the first opening to the last closing bracket, '' when there is none."""
    return F.regexp_extract(text_or_empty(reply), rf"(?s)\{opening}.*\{closing}", 0)


def repair_steps(span: Column) -> list[Column]:
    """The text after each repair: trailing commas, single quotes, stray quotes inside strings.

    The last repair also harms well-formed strings, so the steps are tried one by one and
    the first text that parses is used.
    """
    commas = F.regexp_replace(span, r",(\s*[}\]])", "$1")
    keys = F.regexp_replace(commas, r"'([^']*)':", '"$1":')
    values = F.regexp_replace(keys, r":\s*'([^']*)'", ': "$1"')
    strays = F.regexp_replace(values, r'([^\\])"([^"]*)"([^"]*)"', r'$1"$2$3"')
    return [commas, values, strays]


def _parse(span: Column) -> Column:
    parsed = F.from_json(span, REPLY, _OPTIONS)
    return F.when((span != "") & parsed["corrupt"].isNull(), parsed)


def parse_columns(df, reply: str, out: str = "reply_json"):
    """Add the parsed reply: as it came, else with commas repaired, else fully repaired, else NULL."""
    span = f"__{out}_span"
    df = df.withColumn(span, json_span(F.col(reply)))
    tries = [_parse(F.col(span)), *[_parse(text) for text in repair_steps(F.col(span))]]
    return compute_once(df, out, F.coalesce(*tries)).drop(span)


def _label(value: Column, allowed: list[str], rules, default: str) -> Column:
    word = strip(F.lower(text_or_empty(value)))
    ruled = first_contained(word, rules, default)
    return F.when(word.isin(allowed), word).when(word == "", default).otherwise(ruled)


def feedback_type(value: Column) -> Column:
    return _label(value, K.FEEDBACK_TYPES, K.TYPE_RULES, "other")


def severity_level(value: Column) -> Column:
    return _label(value, K.SEVERITY_LEVELS, K.SEVERITY_RULES, "medium")


def component(value: Column) -> Column:
    return _label(value, K.COMPONENTS, K.COMPONENT_RULES, "other")


def severity_to_score(level: Column) -> Column:
    return lookup(level, K.SEVERITY_SCORES, 0.5)


def mean_confidence(a: Column, b: Column, c: Column) -> Column:
    return (a + b + c) / F.lit(3.0)


def adjusted_severity(kind: Column, level: Column) -> Column:
    return (
        F.when((kind == "feature_request") & level.isin("critical", "high"), "medium")
        .when((kind == "bug") & (level == "minimal"), "low")
        .otherwise(level)
    )


def adjusted_severity_confidence(kind: Column, level: Column, confidence: Column) -> Column:
    return (
        F.when((kind == "feature_request") & level.isin("critical", "high"), F.least(confidence, F.lit(0.7)))
        .when((kind == "bug") & (level == "minimal"), F.least(confidence, F.lit(0.6)))
        .otherwise(confidence)
    )


def validation_errors(kind, level, type_conf, severity_conf, component_conf, overall) -> Column:
    outside = lambda c: ~c.between(0.0, 1.0)
    ranged = [("Type", type_conf), ("Severity", severity_conf), ("Component", component_conf), ("Overall", overall)]
    return compact(
        *[F.when(outside(c), f"{name} confidence must be between 0.0 and 1.0") for name, c in ranged],
        F.when(overall < 0.3, "Overall confidence is very low, consider manual review"),
        F.when((kind == "bug") & (level == "minimal"), "Bug reports should not be minimal severity"),
        F.when((kind == "feature_request") & (level == "critical"), "Feature requests should not be critical severity"),
    )
