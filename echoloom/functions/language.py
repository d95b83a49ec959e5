"""Language detection by common words, vowel shares and link domains."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions.pii import unicode_pattern
from echoloom.functions.text import WORD, compute_once, text_or_empty

RESULT = "struct<confidence:double,rank:int,language:string,method:string>"


def clean_for_detection(col: Column) -> Column:
    """Lower-case words and digits, one space between them, links and e-mails removed."""
    out = text_or_empty(col)
    # a link or an address needs its sign; single blanks, nearly all gaps, are not matched
    bare = F.regexp_replace(F.regexp_replace(out, f"https?://{WORD}", ""), unicode_pattern(K.EMAIL), "")
    out = F.when(out.contains("://") | out.contains("@"), bare).otherwise(out)
    gap = r"[^\p{L}\p{N}_]"
    return F.lower(F.trim(F.regexp_replace(out, f"{gap}(?:(?<! )|(?={gap})){gap}*", " ")))


def _result(confidence: Column, rank: int, language: Column, method: str) -> Column:
    return F.struct(
        confidence.alias("confidence"),
        F.lit(rank).alias("rank"),
        language.alias("language"),
        F.lit(method).alias("method"),
    ).cast(RESULT)


def _named(names, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position)


def spaced_words(cleaned: Column) -> Column:
    """Words of a text with single blanks between them and none at its ends."""
    blanks = F.length(cleaned) - F.length(F.replace(cleaned, F.lit(" "), F.lit("")))
    return F.when(cleaned == "", 0).otherwise(blanks + 1)


def _by_first_letter(listed: list[str]) -> str:
    """Alternatives for whole words; each first letter is tried once."""
    rest: dict[str, list[str]] = {}
    for word in listed:
        rest.setdefault(word[0], []).append(re.escape(word[1:]))
    return "|".join(f"{re.escape(first)}(?:{'|'.join(ends)})" for first, ends in rest.items())


def word_shares(cleaned: Column) -> Column:
    """array<double>: share of common words, one entry per language."""
    padded = F.concat(F.lit(" "), cleaned, F.lit(" "))
    total = F.greatest(spaced_words(cleaned), F.lit(1))
    patterns = [f" (?:{_by_first_letter(ws)})(?= )" for ws in K.COMMON_WORDS.values()]
    return F.array(*[F.regexp_count(padded, F.lit(p)) / total for p in patterns])


def vowel_shares(cleaned: Column) -> Column:
    """array<double>: share of a, e, i, o, u among all characters."""
    size = F.greatest(F.length(cleaned), F.lit(1))
    return F.array(*[(F.length(cleaned) - F.length(F.replace(cleaned, F.lit(v), F.lit("")))) / size for v in "aeiou"])


def vowel_scores(shares: Column) -> Column:
    """array<double>: mean closeness of the shares to each language's expected ones."""
    scores = []
    for expected in K.VOWEL_SHARES.values():
        total = F.lit(0.0)
        for i, value in enumerate(expected.values()):
            total = total + (1 - F.abs(shares[i] - F.lit(value)) / F.lit(value))
        scores.append(total / len(expected))
    return F.array(*scores)


def link_votes(text: Column) -> Column:
    """array<int>: how often each language's domain endings occur in the links."""
    urls = F.regexp_extract_all(text, F.lit(unicode_pattern(K.URL)), F.lit(0))
    languages = list(dict.fromkeys(K.DOMAIN_LANGUAGES.values()))
    counts = []
    for name in languages:
        endings = [e for e, lang in K.DOMAIN_LANGUAGES.items() if lang == name]
        counts.append(
            F.aggregate(urls, F.lit(0), lambda n, u: n + sum((u.contains(e).cast("int") for e in endings), F.lit(0)))
        )
    return F.when(text.contains("://"), F.array(*counts))


def detect_columns(df, column: str, default: str = "en", prefix: str = "lang"):
    """Add a `<prefix>` struct (confidence, language, method) for a text column.

    Three votes: common words (three words, share above 0.1), vowel shares (ten
    characters, score above 0.6) and link domains (majority). The most confident vote
    wins, an equal one loses to the vote before it; within a vote the language listed
    first wins a tie. Each step is its own projection, so nothing is evaluated twice.
    """
    n = lambda part: f"__{prefix}_{part}"
    df = df.withColumn(n("clean"), clean_for_detection(F.col(column)))
    clean = F.col(n("clean"))
    df = df.withColumn(n("words"), word_shares(clean)).withColumn(n("vowels"), vowel_shares(clean))
    df = df.withColumn(n("vscores"), vowel_scores(F.col(n("vowels")))).withColumn(n("links"), link_votes(F.col(column)))
    df = (
        df.withColumn(n("wtop"), F.array_max(n("words")))
        .withColumn(n("vtop"), F.array_max(n("vscores")))
        .withColumn(n("ltop"), F.array_max(n("links")))
        .withColumn(n("ltotal"), F.aggregate(n("links"), F.lit(0), lambda a, x: a + x))
    )
    first = lambda part, top: F.array_position(F.col(n(part)), F.col(n(top))).cast("int")
    by_words = F.when(
        (spaced_words(clean) >= 3) & (F.col(n("wtop")) > 0.1),
        _result(F.least(n("wtop"), F.lit(1.0)), 3, _named(K.COMMON_WORDS, first("words", "wtop")), "word_frequency"),
    )
    by_vowels = F.when(
        (F.length(clean) >= 10) & (F.col(n("vtop")) > 0.6),
        _result(F.least(n("vtop"), F.lit(1.0)), 2, _named(K.VOWEL_SHARES, first("vscores", "vtop")), "character_patterns"),
    )
    link_languages = dict.fromkeys(K.DOMAIN_LANGUAGES.values())
    by_links = F.when(
        F.col(n("ltotal")) > 0,
        _result(F.col(n("ltop")) / F.col(n("ltotal")), 1, _named(link_languages, first("links", "ltop")), "url_analysis"),
    )
    empty = _result(F.lit(0.0), 0, F.lit(default), "default")
    fallback = _result(F.lit(0.5), 0, F.lit(default), "fallback")
    best = F.coalesce(F.array_max(F.array(by_words, by_vowels, by_links)), fallback)
    df = compute_once(df, prefix, F.when(clean == "", empty).otherwise(best))
    return df.drop(*[n(p) for p in ("clean", "words", "vowels", "vscores", "links", "wtop", "vtop", "ltop", "ltotal")])
