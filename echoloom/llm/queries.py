"""One query for each operator, over its whole table, and SQL where it can say the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.llm import bpe, decontaminate, jaccard, language, lexical, license, line_dedup, nearest, quantize, secrets, simhash, toxicity, url_filter
from echoloom.llm.common import fold, table

#: Rules of the URL query (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Lexicon:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.read_spec(tokenizer_path()))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_documents(table(spark, sf_dir, "documents")).drop("places")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, fold(F.col("doc_id"), 4) != 2)
    out = language.predict(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, "source", "text", dropped="dropped_lines")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score_documents(docs, toxicity_model(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "matches")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_bpe, op2_decontaminate, op3_nearest, op4_license, op5_language, op6_secrets, op7_jaccard, op8_url_filter, op9_line_dedup, op10_toxicity,
    op11_lexical, op12_vector_codes, op13_simhash,
)}

def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """SQL of the same codebooks: one pair of table expressions for each round."""
    steps = [f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT n, generate_subscripts(embedding, 1) - 1 AS spot, unnest(embedding) AS x, len(embedding) // {parts} AS width FROM kept),
ints AS MATERIALIZED (SELECT n, spot // width AS part, spot % width AS pos, CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM cells),
book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, pos, v AS c FROM ints WHERE n <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
far{r} AS (SELECT i.n, i.part, b.entry, sum((i.v - b.c) * (i.v - b.c)) AS d FROM ints i JOIN book{r} b ON i.part = b.part AND i.pos = b.pos GROUP BY ALL),
near{r} AS MATERIALIZED (SELECT n, part, entry, d FROM far{r} QUALIFY row_number() OVER (PARTITION BY n, part ORDER BY d, entry) = 1)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (SELECT i.part, a.entry, i.pos, CAST(sum(i.v) AS BIGINT) AS s, count(*) AS m FROM ints i JOIN near{r} a ON i.n = a.n AND i.part = a.part GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce((s - ((s % m) + m) % m) // m, b.c) AS c FROM book{r} b LEFT JOIN sums{r} USING (part, entry, pos))""")
    steps.append(f"""
coded AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY n),
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds})""")
    return ",".join(steps).strip() + """
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256 FROM kept k JOIN coded c USING (n) CROSS JOIN digest d"""


ORACLES = {
    "op11_lexical": r"""
WITH words AS (SELECT n, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS n, doc_id, text FROM documents)),
tfs AS MATERIALIZED (SELECT n, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT n, CAST(sum(tf) AS BIGINT) AS n_terms FROM tfs GROUP BY n),
totals AS (SELECT count(*) AS docs, CAST(sum(n_terms) AS BIGINT) AS terms FROM sizes),
ms AS (SELECT n, 75 + (25 * n_terms * docs) // terms AS m FROM sizes CROSS JOIN totals),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
weights AS (SELECT a.item, a.item_id, a.term, count(*) AS times, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * any_value(df) + 1))) AS BIGINT) AS w
  FROM asked a JOIN dfs USING (term) CROSS JOIN totals GROUP BY a.item, a.item_id, a.term),
scores AS (SELECT w.item, w.item_id, t.n, t.doc_id, CAST(sum(w.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * m.m))) AS BIGINT) AS score
  FROM weights w JOIN tfs t USING (term) JOIN ms m ON m.n = t.n GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 20
""".strip(),
    "op12_vector_codes": vector_codes_sql(),
    "op8_url_filter": """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id,
  translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fit AS (SELECT p.n, r.verdict, r.host || r.path AS rule, row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fit f ON f.n = p.n AND f.place = 1
""".strip(),
    "op9_line_dedup": """
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, source, text FROM documents),
lines AS (SELECT n, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs),
seen AS (SELECT source, trim(line) AS line, count(DISTINCT n) AS pages FROM lines WHERE trim(line) <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS total FROM docs GROUP BY source),
bad AS (SELECT s.source, s.line FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source WHERE s.pages >= 3 AND s.pages / t.total > 0.05),
marked AS (SELECT l.*, b.line IS NOT NULL AS dropped FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line) = b.line),
kept AS (SELECT n, count(*) FILTER (dropped) AS dropped_lines, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '') AS text FROM marked GROUP BY n)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, coalesce(k.dropped_lines, 0) AS dropped_lines FROM docs d LEFT JOIN kept k USING (n)
""".strip(),
}
