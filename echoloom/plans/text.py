"""Cleaning, masking, language and normalisation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions import language, pii, text
from echoloom.operators import normalize
from echoloom.plans import tables as T
from echoloom.plans.registry import plan
from echoloom.plans.tables import with_tables

# RE2 has ASCII \b, \w, \s only. Masking decisions are compared on folded text: non-ASCII
# letters become "_" (a word character), Unicode spaces become a blank, on both sides.
_LETTERS = "[ªµºÀ-ÖØ-öø-ʯͰ-ῼ]"
_SPACES = "[\u0085   -     　]"


def _fold(col):
    return F.regexp_replace(F.regexp_replace(col, _LETTERS, "_"), _SPACES, " ")


def _fold_sql(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '{_LETTERS}', '_', 'g'), '{_SPACES}', ' ', 'g')"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _docs(spark, sf):
    return T.spread(T.read(spark, sf, "documents")).select("doc_id", "text")


def _pages(spark, sf):
    return T.spread(T.read(spark, sf, "pages")).select("page_id", "html")


# --- HTML ------------------------------------------------------------------------------
_ENTITY_SQL = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "middot": "·",
}


def _markup_sql(expr: str) -> str:
    for pattern in (
        r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>",
        r"(?s)<[!?][^>]*>", r"""(?s)</?[A-Za-z][^\s/>"']*(?:"[^"]*"|'[^']*'|[^'">])*>""",
    ):
        expr = f"regexp_replace({expr}, {_q(pattern)}, '', 'g')"
    return expr


def _entities_sql(expr: str) -> str:
    for name, char in list(_ENTITY_SQL.items())[1:]:
        expr = f"replace({expr}, '&{name};', {_q(char)})"
    expr = f"replace({expr}, '&#39;', '''')"
    return f"replace({expr}, '&amp;', '&')"


_CLEAN_SQL = "trim(regexp_replace({}, '[\\s ]+', ' ', 'g'))"
_CLEAN_PAGE_SQL = _CLEAN_SQL.format(_entities_sql(_markup_sql("html")))


@plan("h01_clean_html", f"SELECT page_id, md5({_CLEAN_PAGE_SQL}) AS body_md5, length({_CLEAN_PAGE_SQL}) AS body_length FROM pages")
def _(spark, sf):
    df = text.clean_html_columns(_pages(spark, sf), "html", "body")
    return df.select("page_id", F.md5(F.encode("body", "UTF-8")).alias("body_md5"), F.length("body").cast("bigint").alias("body_length"))


@plan("h02_collapse_spaces", f"SELECT doc_id, md5(regexp_replace({_fold_sql('text')}, '\\s+', ' ', 'g')) AS text_md5 FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(F.encode(text.collapse_spaces(_fold(F.col("text"))), "UTF-8")).alias("text_md5"))


@plan(
    "h03_break_after_blocks",
    """SELECT page_id, md5(regexp_replace(html, '(</(?:p|div|br|h1|h2|h3|h4|h5|h6|li)>)', '\\1' || chr(10), 'g')) AS html_md5,
    CAST(len(regexp_extract_all(html, '</(?:p|div|br|h1|h2|h3|h4|h5|h6|li)>')) AS BIGINT) AS breaks FROM pages""",
)
def _(spark, sf):
    out = text.break_after_blocks(F.col("html"))
    return _pages(spark, sf).select(
        "page_id",
        F.md5(F.encode(out, "UTF-8")).alias("html_md5"),
        (F.length(out) - F.length("html")).cast("bigint").alias("breaks"),
    )


_BASIC_SQL = "regexp_replace(html, '<[^>]+>', '', 'g')"
for _entity, _char in text.BASIC_ENTITIES:
    _BASIC_SQL = f"replace({_BASIC_SQL}, '{_entity}', {_q(_char)})"


@plan("h04_basic_html_clean", f"SELECT page_id, {_CLEAN_SQL.format(_BASIC_SQL)} AS body FROM pages")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", text.basic_html_clean(F.col("html")).alias("body"))


@plan(
    "h05_extract_links",
    f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a\\s*>')) AS a FROM pages)
    SELECT page_id, regexp_extract(a, '(?is)\\shref\\s*=\\s*"([^"]*)"', 1) AS url,
    {_CLEAN_SQL.format(_entities_sql(_markup_sql('a')))} AS text, count(*) AS n FROM a GROUP BY ALL""",
)
def _(spark, sf):
    links = _pages(spark, sf).select("page_id", F.explode(text.extract_links(F.col("html"))).alias("link"))
    return (
        links.select("page_id", "link.url", text.collapse_spaces(F.col("link.text")).alias("text"))
        .groupBy("page_id", "url", "text")
        .agg(F.count("*").alias("n"))
    )


@plan(
    "h06_extract_images",
    """WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<img\\s[^>]*>')) AS i FROM pages)
    SELECT page_id, count(*) AS images, count(*) FILTER (WHERE regexp_matches(i, '(?is)\\salt\\s*=')) AS with_alt
    FROM i WHERE regexp_matches(i, '(?is)\\ssrc\\s*=') GROUP BY page_id""",
)
def _(spark, sf):
    images = _pages(spark, sf).select("page_id", F.explode(text.extract_images(F.col("html"))).alias("img"))
    return images.groupBy("page_id").agg(F.count("*").alias("images"), F.count_if(F.col("img.alt") != "").alias("with_alt"))


_TITLE_SRC = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' ' || url"
_TITLE_CLEAN = _CLEAN_SQL.format(_entities_sql(_markup_sql(f"repeat({_TITLE_SRC} || ' ', 3)")))


@plan(
    "h07_clean_title",
    f"""SELECT page_id, CASE WHEN length(t) > 200 THEN trim(substring(t, 1, 200) || '...') ELSE t END AS title
    FROM (SELECT page_id, {_TITLE_CLEAN} AS t FROM pages)""",
)
def _(spark, sf):
    source = F.concat(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(" "), F.col("url"), F.lit(" "))
    df = T.spread(T.read(spark, sf, "pages")).select("page_id", F.repeat(source, 3).alias("source"))
    df = text.clean_html_columns(df, "source", "title")
    return df.select("page_id", text.cut_title(F.col("title")).alias("title"))


# --- personal data ---------------------------------------------------------------------
_MASKED_EMAIL_SQL = f"""(SELECT string_agg(part || coalesce(mask, ''), '' ORDER BY i) FROM (
    SELECT generate_subscripts(parts, 1) AS i, unnest(parts) AS part,
    unnest(list_resize(list_transform(hits, lambda e: CASE WHEN position('@' IN e) - 1 <= 2 THEN repeat('*', position('@' IN e) - 1)
    ELSE substring(e, 1, 1) || repeat('*', position('@' IN e) - 3) || substring(e, position('@' IN e) - 1, 1) END
    || substring(e, position('@' IN e))), len(parts))) AS mask))"""
_EMAIL_SPLIT_SQL = f"""SELECT doc_id, t AS original, regexp_split_to_array(t, {_q(K.EMAIL)}) AS parts, regexp_extract_all(t, {_q(K.EMAIL)}) AS hits
    FROM (SELECT doc_id, {_fold_sql('text')} AS t FROM documents)"""


@plan(
    "h08_scrub_email",
    f"SELECT doc_id, CASE WHEN len(hits) = 0 THEN md5(original) ELSE md5({_MASKED_EMAIL_SQL}) END AS text_md5, CAST(len(hits) AS BIGINT) AS emails FROM ({_EMAIL_SPLIT_SQL})",
)
def _(spark, sf):
    return _docs(spark, sf).select(
        "doc_id",
        F.md5(F.encode(_fold(pii.scrub_emails(F.col("text"))), "UTF-8")).alias("text_md5"),
        F.regexp_count("text", F.lit(pii.unicode_pattern(K.EMAIL))).cast("bigint").alias("emails"),
    )


def _scrub_sql(patterns: list[str], tag: str, expr: str) -> str:
    for pattern in patterns:
        expr = f"regexp_replace({expr}, {_q(pattern)}, '{tag}', 'g')"
    return expr


def _single_mask(name: str, scrub, patterns: list[str], tag: str) -> None:
    masked = _scrub_sql(patterns, tag, "t")
    oracle = f"""SELECT doc_id, md5({masked}) AS text_md5, CAST((length({masked}) - length(replace({masked}, '{tag}', ''))) / {len(tag)} AS BIGINT) AS masks
        FROM (SELECT doc_id, {_fold_sql('text')} AS t FROM documents)"""

    @plan(name, oracle)
    def _(spark, sf):
        df = _docs(spark, sf).withColumn("masked", _fold(scrub(F.col("text"))))
        masks = (F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(tag), F.lit("")))) / len(tag)
        return df.select("doc_id", F.md5(F.encode("masked", "UTF-8")).alias("text_md5"), masks.cast("bigint").alias("masks"))


_single_mask("h09_scrub_phone", pii.scrub_phones, K.PHONES, "[PHONE]")
_single_mask("h10_scrub_card", pii.scrub_cards, [K.CARD], "[CREDIT_CARD]")
_single_mask("h11_scrub_ssn", pii.scrub_ssns, [K.SSN], "[SSN]")
_single_mask("h12_scrub_name", pii.scrub_names, K.NAMES, "[NAME]")
_single_mask("h13_scrub_ip", pii.scrub_ips, [K.IPV4], "[IP_ADDRESS]")
_single_mask("h14_scrub_url", pii.scrub_urls, [K.URL], "[URL]")

_CHAIN = [
    ("phone numbers", K.PHONES, "[PHONE]"), ("credit card numbers", [K.CARD], "[CREDIT_CARD]"), ("SSNs", [K.SSN], "[SSN]"),
    ("potential names", K.NAMES, "[NAME]"), ("IP addresses", [K.IPV4], "[IP_ADDRESS]"),
]


def _scrub_all_sql() -> str:
    sql = f"SELECT doc_id, CASE WHEN len(hits) = 0 THEN original ELSE {_MASKED_EMAIL_SQL} END AS t0, len(hits) AS n0 FROM ({_EMAIL_SPLIT_SQL})"
    for i, (_, patterns, tag) in enumerate(_CHAIN, 1):
        sql = f"SELECT *, {_scrub_sql(patterns, tag, f't{i - 1}')} AS t{i} FROM ({sql})"
    count = lambda t, tag: f"(length({t}) - length(replace({t}, '{tag}', ''))) // {len(tag)}"
    labels = ["CASE WHEN n0 > 0 THEN n0 || ' email addresses' END"]
    for i, (label, _, tag) in enumerate(_CHAIN, 1):
        n = f"({count(f't{i}', tag)} - {count(f't{i - 1}', tag)})"
        labels.append(f"CASE WHEN {n} > 0 THEN {n} || ' {label}' END")
    found = f"list_filter([{', '.join(labels)}], lambda x: x IS NOT NULL)"
    return f"""SELECT doc_id, md5(t5) AS text_md5, array_to_string({found}, '|') AS detected,
        CAST(len({found}) AS BIGINT) AS pii_count FROM ({sql})"""


@plan("h15_scrub_all", _scrub_all_sql())
def _(spark, sf):
    df = pii.scrub_columns(_docs(spark, sf), "text")
    return df.select(
        "doc_id",
        F.md5(F.encode(_fold(F.col("pii_text")), "UTF-8")).alias("text_md5"),
        F.array_join("pii_detected", "|").alias("detected"),
        F.col("pii_count").cast("bigint").alias("pii_count"),
    )


def _types_sql() -> str:
    kinds = [("email", [K.EMAIL]), ("phone", K.PHONES), ("credit_card", [K.CARD]), ("ssn", [K.SSN]), ("name", K.NAMES), ("ip_address", [K.IPV4])]
    cases = [
        "CASE WHEN " + " OR ".join(f"regexp_matches(t, {_q(p)})" for p in patterns) + f" THEN '{name}' END" for name, patterns in kinds
    ]
    return f"""SELECT doc_id, array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), '|') AS kinds
        FROM (SELECT doc_id, {_fold_sql('text')} AS t FROM documents)"""


@plan("h16_pii_types", _types_sql())
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(pii.pii_types(F.col("text")), "|").alias("kinds"))


# --- language --------------------------------------------------------------------------
def _detect_clean_sql(expr: str) -> str:
    return (
        f"lower(trim(regexp_replace(regexp_replace(regexp_replace({expr}, 'https?://[^\\s ]+', '', 'g'), "
        f"{_q(K.EMAIL)}, '', 'g'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')))"
    )


@plan("h17_clean_for_detection", f"SELECT doc_id, md5({_detect_clean_sql('text')}) AS text_md5 FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(F.encode(language.clean_for_detection(F.col("text")), "UTF-8")).alias("text_md5"))


def _word_shares_sql(words: str) -> str:
    shares = []
    for common in K.COMMON_WORDS.values():
        members = "[" + ", ".join(f"'{w}'" for w in common) + "]"
        shares.append(f"CAST(len(list_filter({words}, lambda w: list_contains({members}, w))) AS DOUBLE) / greatest(len({words}), 1)")
    return "[" + ", ".join(shares) + "]"


_LANGS = "[" + ", ".join(f"'{k}'" for k in K.COMMON_WORDS) + "]"
_WORDS_SQL = "list_filter(string_split(c, ' '), lambda w: w <> '')"


@plan(
    "h18_word_vote",
    f"""SELECT doc_id, CASE WHEN n >= 3 AND list_max(s) > 0.1 THEN {_LANGS}[list_position(s, list_max(s))] END AS language,
    CASE WHEN n >= 3 AND list_max(s) > 0.1 THEN round(list_max(s), 9) END AS confidence
    FROM (SELECT doc_id, len({_WORDS_SQL}) AS n, {_word_shares_sql(_WORDS_SQL)} AS s
    FROM (SELECT doc_id, {_detect_clean_sql('text')} AS c FROM documents))""",
)
def _(spark, sf):
    df = _docs(spark, sf).withColumn("c", language.clean_for_detection(F.col("text")))
    df = df.withColumn("s", language.word_shares(F.col("c"))).withColumn("top", F.array_max("s"))
    ok = (F.regexp_count("c", F.lit("[^ ]+")) >= 3) & (F.col("top") > 0.1)
    names = F.array(*[F.lit(k) for k in K.COMMON_WORDS])
    return df.select(
        "doc_id",
        F.when(ok, F.element_at(names, F.array_position(F.col("s"), F.col("top")).cast("int"))).alias("language"),
        F.when(ok, F.round("top", 9)).alias("confidence"),
    )


def _vowel_scores_sql() -> str:
    scores = []
    for expected in K.VOWEL_SHARES.values():
        parts = [
            f"(1 - abs(CAST(length(c) - length(replace(c, '{v}', '')) AS DOUBLE) / greatest(length(c), 1) - CAST({e} AS DOUBLE)) / CAST({e} AS DOUBLE))"
            for v, e in expected.items()
        ]
        scores.append("(" + " + ".join(parts) + ") / 5")
    return "[" + ", ".join(scores) + "]"


_VLANGS = "[" + ", ".join(f"'{k}'" for k in K.VOWEL_SHARES) + "]"


@plan(
    "h19_vowel_vote",
    f"""SELECT doc_id, CASE WHEN length(c) >= 10 AND list_max(s) > 0.6 THEN {_VLANGS}[list_position(s, list_max(s))] END AS language,
    CASE WHEN length(c) >= 10 AND list_max(s) > 0.6 THEN round(list_max(s), 9) END AS confidence
    FROM (SELECT doc_id, c, {_vowel_scores_sql()} AS s FROM (SELECT doc_id, {_detect_clean_sql('text')} AS c FROM documents))""",
)
def _(spark, sf):
    df = _docs(spark, sf).withColumn("c", language.clean_for_detection(F.col("text")))
    df = df.withColumn("v", language.vowel_shares(F.col("c"))).withColumn("s", language.vowel_scores(F.col("v")))
    df = df.withColumn("top", F.array_max("s"))
    ok = (F.length("c") >= 10) & (F.col("top") > 0.6)
    names = F.array(*[F.lit(k) for k in K.VOWEL_SHARES])
    return df.select(
        "doc_id",
        F.when(ok, F.element_at(names, F.array_position(F.col("s"), F.col("top")).cast("int"))).alias("language"),
        F.when(ok, F.round("top", 9)).alias("confidence"),
    )


_LINK_LANGS = list(dict.fromkeys(K.DOMAIN_LANGUAGES.values()))


def _link_votes_sql(source: str) -> str:
    counts = []
    for name in _LINK_LANGS:
        hits = [
            f"len(list_filter(u, lambda x: contains(x, '{e}')))" for e, lang in K.DOMAIN_LANGUAGES.items() if lang == name
        ]
        counts.append(" + ".join(hits))
    return f"SELECT *, [{', '.join(counts)}] AS votes FROM (SELECT *, regexp_extract_all({source}, {_q(K.URL)}) AS u FROM pages)"


@plan(
    "h20_link_vote",
    f"""SELECT page_id, {_LINK_LANGS}[list_position(votes, list_max(votes))] AS language,
    round(CAST(list_max(votes) AS DOUBLE) / list_sum(votes), 9) AS confidence
    FROM ({_link_votes_sql("url || ' ' || html")}) WHERE list_sum(votes) > 0""",
)
def _(spark, sf):
    df = T.spread(T.read(spark, sf, "pages")).withColumn("t", F.concat_ws(" ", "url", "html"))
    df = df.withColumn("votes", language.link_votes(F.col("t"))).withColumn("top", F.array_max("votes"))
    df = df.withColumn("total", F.aggregate("votes", F.lit(0), lambda a, x: a + x)).where("total > 0")
    names = F.array(*[F.lit(k) for k in _LINK_LANGS])
    return df.select(
        "page_id",
        F.element_at(names, F.array_position(F.col("votes"), F.col("top")).cast("int")).alias("language"),
        F.round(F.col("top") / F.col("total"), 9).alias("confidence"),
    )


def _detect_sql(source: str, keep: str) -> str:
    """Full detector over a subquery with a `full_text` column."""
    clean = f"SELECT *, {_detect_clean_sql('full_text')} AS c, regexp_extract_all(full_text, {_q(K.URL)}) AS u FROM ({source})"
    votes = []
    for name in _LINK_LANGS:
        hits = [f"len(list_filter(u, lambda x: contains(x, '{e}')))" for e, lang in K.DOMAIN_LANGUAGES.items() if lang == name]
        votes.append(" + ".join(hits))
    parts = f"""SELECT *, {_word_shares_sql(_WORDS_SQL)} AS ws, {_vowel_scores_sql()} AS vs, [{', '.join(votes)}] AS lv,
        len({_WORDS_SQL}) AS nw FROM ({clean})"""
    tops = f"""SELECT *, CASE WHEN nw >= 3 AND list_max(ws) > 0.1 THEN least(list_max(ws), 1.0) ELSE -1 END AS wc,
        CASE WHEN length(c) >= 10 AND list_max(vs) > 0.6 THEN least(list_max(vs), 1.0) ELSE -1 END AS vc,
        CASE WHEN list_sum(lv) > 0 THEN CAST(list_max(lv) AS DOUBLE) / list_sum(lv) ELSE -1 END AS lc FROM ({parts})"""
    return f"""SELECT {keep},
        CASE WHEN c = '' THEN 'default' WHEN greatest(wc, vc, lc) < 0 THEN 'fallback' WHEN wc >= vc AND wc >= lc THEN 'word_frequency'
             WHEN vc >= lc THEN 'character_patterns' ELSE 'url_analysis' END AS method,
        CASE WHEN c = '' OR greatest(wc, vc, lc) < 0 THEN 'en' WHEN wc >= vc AND wc >= lc THEN {_LANGS}[list_position(ws, list_max(ws))]
             WHEN vc >= lc THEN {_VLANGS}[list_position(vs, list_max(vs))] ELSE {_LINK_LANGS}[list_position(lv, list_max(lv))] END AS language,
        CASE WHEN c = '' THEN CAST(0 AS DOUBLE) WHEN greatest(wc, vc, lc) < 0 THEN CAST(0.5 AS DOUBLE) ELSE greatest(wc, vc, lc) END AS confidence
        FROM ({tops})"""


_DETECT_DOCS_SQL = _detect_sql("SELECT doc_id, text AS full_text FROM documents", "doc_id")


def _detected(spark, sf):
    df = language.detect_columns(_docs(spark, sf), "text")
    return df.select("doc_id", "lang.language", "lang.confidence", "lang.method")


@plan("h21_detect_language", f"SELECT doc_id, language, round(confidence, 9) AS confidence, method FROM ({_DETECT_DOCS_SQL})")
def _(spark, sf):
    return _detected(spark, sf).withColumn("confidence", F.round("confidence", 9))


@plan("h22_word_count", f"SELECT doc_id, CAST(len(regexp_extract_all({_fold_sql('text')}, '[^\\s]+')) AS BIGINT) AS words FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("words"))


@plan("h23_normalize_documents")
def _(spark, sf):
    df = normalize.normalize_documents(T.raw_feedback(spark, sf))
    return df.select(
        "raw_feedback_id", "title", F.md5(F.encode("body", "UTF-8")).alias("body_md5"), "author", "language",
        F.col("word_count").cast("bigint").alias("word_count"), F.array_join("pii_detected", "|").alias("pii"),
        F.round("language_confidence", 9).alias("language_confidence"),
        F.col("processing_metadata.language_detected").alias("method"),
    )



@plan(
    "d03_language_stats",
    f"""SELECT sum(n) OVER ()::BIGINT AS total_items, round(sum(s) OVER () / sum(n) OVER (), 9) AS average_confidence,
    first_value(language) OVER (ORDER BY n DESC, language) AS most_common_language, language, n AS documents
    FROM (SELECT language, count(*) AS n, sum(confidence) AS s FROM ({_DETECT_DOCS_SQL}) GROUP BY language)""",
)
def _(spark, sf):
    docs = _detected(spark, sf).withColumn("language_confidence", F.col("confidence"))
    stats = normalize.language_stats(docs)
    return stats.select(
        "total_items", F.round("average_confidence", 9).alias("average_confidence"), "most_common_language",
        F.explode("language_distribution").alias("language", "documents"),
    )


@plan(
    "b14_language_filter",
    f"SELECT doc_id, language, round(confidence, 9) AS language_confidence FROM ({_DETECT_DOCS_SQL}) WHERE language = 'en' OR confidence < 0.3",
)
def _(spark, sf):
    docs = _detected(spark, sf).withColumnRenamed("confidence", "language_confidence").drop("method")
    return normalize.filter_by_language(docs).withColumn("language_confidence", F.round("language_confidence", 9))


@plan(
    "b12_word_count_gate",
    f"SELECT doc_id FROM documents WHERE len(regexp_extract_all({_fold_sql('text')}, '[^\\s]+')) >= 40",
)
def _(spark, sf):
    return _docs(spark, sf).where(text.word_count(F.col("text")) >= 40).select("doc_id")


@plan(
    "b13_truncate_words",
    """SELECT doc_id, CASE WHEN len(w) > 100 THEN md5(array_to_string(w[1:100], ' ')) ELSE md5(text) END AS text_md5
    FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\\s   　]+') AS w FROM documents)""",
)
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(F.encode(text.truncate_words(F.col("text"), 100), "UTF-8")).alias("text_md5"))


@plan(
    "d01_processing_stats",
    with_tables("docs")
    + """SELECT 'total' AS dimension, '' AS value, count(*) AS documents, round(avg(coalesce(word_count, 0)), 6) AS average_word_count FROM docs
    UNION ALL SELECT 'language', coalesce(language, 'unknown'), count(*), round(avg(coalesce(word_count, 0)), 6) FROM docs GROUP BY ALL
    UNION ALL SELECT 'source', source_type, count(*), round(avg(coalesce(word_count, 0)), 6) FROM docs GROUP BY ALL""",
)
def _(spark, sf):
    return normalize.processing_stats(T.documents(spark, sf))


@plan(
    "b08_pending_raw",
    with_tables("raw") + "SELECT id, source_type FROM raw WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = raw.id)",
)
def _(spark, sf):
    done = T.read(spark, sf, "labels").select(F.col("doc_id").alias("raw_feedback_id"))
    return normalize.pending(T.raw_feedback(spark, sf), done).select("id", "source_type")


@plan("d01_detected_languages", f"SELECT language, method, count(*) AS documents FROM ({_DETECT_DOCS_SQL}) GROUP BY ALL")
def _(spark, sf):
    return _detected(spark, sf).groupBy("language", "method").agg(F.count("*").alias("documents"))
