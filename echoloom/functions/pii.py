"""Masking of personal data. Patterns run in a fixed order, each on the text the last one left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions.text import compute_once, rebuild, text_or_empty


def unicode_pattern(pattern: str) -> str:
    return "(?U)" + pattern


def _mask(email: Column) -> Column:
    at = F.instr(email, "@")
    local = F.substring(email, F.lit(1), at - 1)
    domain = F.substring(email, at, F.length(email))
    size = F.length(local)
    inner = F.concat(
        F.substring(local, 1, 1), F.repeat(F.lit("*"), F.greatest(size - 2, F.lit(0))), F.substring(local, -1, 1)
    )
    return F.concat(F.when(size <= 2, F.repeat(F.lit("*"), size)).otherwise(inner), domain)


def scrub_emails(col: Column) -> Column:
    return F.when(col.contains("@"), rebuild(col, unicode_pattern(K.EMAIL), _mask)).otherwise(col)


def _replace_all(col: Column, patterns: list[str], tag: str, digits: bool = False) -> Column:
    out = col
    for pattern in patterns:
        out = F.regexp_replace(out, unicode_pattern(pattern), tag)
    # texts without any digit skip the digit patterns after one cheap scan
    return F.when(col.rlike(r"\p{Nd}"), out).otherwise(col) if digits else out


def scrub_phones(col: Column) -> Column:
    return _replace_all(col, K.PHONES, "[PHONE]", digits=True)


def scrub_cards(col: Column) -> Column:
    return _replace_all(col, [K.CARD], "[CREDIT_CARD]", digits=True)


def scrub_ssns(col: Column) -> Column:
    return _replace_all(col, [K.SSN], "[SSN]", digits=True)


def scrub_names(col: Column) -> Column:
    return _replace_all(col, K.NAMES, "[NAME]")


def scrub_ips(col: Column) -> Column:
    return _replace_all(col, [K.IPV4], "[IP_ADDRESS]", digits=True)


def scrub_urls(col: Column) -> Column:
    return _replace_all(col, [K.URL], "[URL]")


# name, label in the report, patterns, scrubber: the fixed order of the masks
_STEPS = [
    ("email", "email addresses", [K.EMAIL], scrub_emails, None),
    ("phone", "phone numbers", K.PHONES, scrub_phones, "[PHONE]"),
    ("credit_card", "credit card numbers", [K.CARD], scrub_cards, "[CREDIT_CARD]"),
    ("ssn", "SSNs", [K.SSN], scrub_ssns, "[SSN]"),
    ("name", "potential names", K.NAMES, scrub_names, "[NAME]"),
    ("ip_address", "IP addresses", [K.IPV4], scrub_ips, "[IP_ADDRESS]"),
]


def scrub_columns(df, column: str, prefix: str = "pii", drop_steps: bool = True):
    """Add `<prefix>_text`, `<prefix>_detected` and `<prefix>_count` to a table.

    Every stage is its own projection so that Catalyst evaluates each regex pass once
    instead of nesting the chain again under each counter.
    """
    text = f"__{prefix}_0"
    df = df.withColumn(text, text_or_empty(F.col(column)))
    labels, steps = [], [text]
    for number, (name, label, patterns, scrub, tag) in enumerate(_STEPS, 1):
        nxt, count = f"__{prefix}_{number}", f"__{prefix}_n_{name}"
        if tag is None:
            found = F.regexp_count(F.col(text), F.lit(unicode_pattern(patterns[0])))
            df = df.withColumn(count, F.when(F.col(text).contains("@"), found).otherwise(0))
            df = df.withColumn(nxt, scrub(F.col(text)))
        else:
            # a mask's own tag cannot match any later pattern, so matches = new tags
            df = df.withColumn(nxt, scrub(F.col(text)))
            tags = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(tag), F.lit("")))) / len(tag)
            more = (tags(F.col(nxt)) - tags(F.col(text))).cast("int")
            df = df.withColumn(count, F.when(F.col(nxt) == F.col(text), 0).otherwise(more))
        labels.append(F.when(F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(" " + label))))
        steps += [nxt, count]
        text = nxt
    df = df.withColumn(f"{prefix}_text", F.col(text))
    df = compute_once(df, f"{prefix}_detected", F.array_compact(F.array(*labels)))
    df = df.withColumn(f"{prefix}_count", F.size(f"{prefix}_detected"))
    return df.drop(*steps) if drop_steps else df


def pii_types(col: Column) -> Column:
    """Kinds of personal data present in the untouched text."""
    text = text_or_empty(col)
    return F.array_compact(F.array(*[F.when(_any(text, p), F.lit(name)) for name, _, p, _, _ in _STEPS]))


def _any(text: Column, patterns: list[str]) -> Column:
    out = text.rlike(unicode_pattern(patterns[0]))
    for pattern in patterns[1:]:
        out = out | text.rlike(unicode_pattern(pattern))
    return out
