import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions import language, pii, text
from echoloom.operators import normalize

TEXTS = [
    "", "   ", "Write to a@b.co, jo@b.co or bob@b.co and alice.smith@mail.example.com!", "x(555) 123-4567 but (555) 123-4567 not",
    "call 555-123-4567 or 555.123.4567, id 123456789, card 4111 1111 1111 1111, ip 10.0.0.1", "Dr. John Smith met Mary Jones and Élodie Durand",
    "short ab@x.org contains b@x.org", "não à b c Ünïcode naïve Änd", "see https://a.fr/x https://b.fr/y https://c.com/z bonjour",
    "el la de que y a en un es se no", "one two", "aaaaaaaaaaaa eeee", "Le Monde Libre est là", "Über Alles Über", "12 345 6789 000-00-0000",
]


def _texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def plain(html):
    parser = _Plain()
    parser.feed(html)
    parser.close()
    return re.sub(r"\s+", " ", "".join(parser.out)).strip()


def test_html_like_a_parser(spark):
    pages = [
        "<p>Hello&nbsp;<b>world</b> &amp; co</p>", "a < b and c > d", "<script>var a = '<p>';</script>x<style>p{}</style>y", "<!-- <b>no</b> -->yes",
        '<a title="x > y" href="/q">link</a>', "<!DOCTYPE html><html><body>t&#233;st &#x41; &eacute; &unknown; &</body></html>", "<br/>one<br>two", "plain", "",
        "<div>unclosed <i>tag", "line\n\n\nbreaks\t tab",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, h string")
    got = {r["id"]: r["b"] for r in text.clean_html_columns(df, "h", "b").collect()}
    assert got == {i: plain(h) for i, h in enumerate(pages)}


def test_html_of_all_pages_like_a_parser(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = text.clean_html_columns(df, "html", "b").collect()
    assert [r["b"] for r in rows] == [plain(r["html"]) for r in rows]


def test_closing_tag_text_gets_a_break(spark):
    df = spark.createDataFrame([("a &lt;/p&gt; b",)], "h string")
    assert text.clean_html_columns(df, "h", "b").first()["b"] == "a </p>\n b"


def test_links_and_images(spark):
    html = '<a class=x href="/one"> One <b>two</b></a><a name=y>none</a><a href=\'/t&amp;u\'>T</a><img src=a.png alt="A"><img alt="no source"><img title=t src="b.png">'
    row = spark.createDataFrame([(html,)], "h string").select(text.extract_links(F.col("h")), text.extract_images(F.col("h"))).first()
    assert [tuple(x) for x in row[0]] == [("/one", "One two"), ("/t&u", "T")]
    assert [tuple(x) for x in row[1]] == [("a.png", "A", ""), ("b.png", "", "t")]


@pytest.mark.parametrize("size, want", [(200, "x" * 200), (201, "x" * 200 + "...")])
def test_title_cut(one, size, want):
    assert one(t="x" * size)(text.cut_title(F.col("t"))) == want


def _scrub(value):
    """The definition, by Python's own regular expressions."""
    def mask(m):
        local, domain = m.group().split("@", 1)
        return ("*" * len(local) if len(local) <= 2 else local[0] + "*" * (len(local) - 2) + local[-1]) + "@" + domain

    found = []
    value, n = re.subn(K.EMAIL, mask, value)
    found.append((n, "email addresses"))
    for patterns, tag, label in (
        (K.PHONES, "[PHONE]", "phone numbers"), ([K.CARD], "[CREDIT_CARD]", "credit card numbers"), ([K.SSN], "[SSN]", "SSNs"),
        (K.NAMES, "[NAME]", "potential names"), ([K.IPV4], "[IP_ADDRESS]", "IP addresses"),
    ):
        total = 0
        for pattern in patterns:
            value, n = re.subn(pattern, tag, value)
            total += n
        found.append((total, label))
    return value, [f"{n} {label}" for n, label in found if n]


def test_masks(spark):
    rows = pii.scrub_columns(_texts(spark), "t").collect()
    for r in rows:
        assert (r["pii_text"], r["pii_detected"]) == _scrub(TEXTS[r["id"]])
        assert r["pii_count"] == len(r["pii_detected"])


def test_masks_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    for r in pii.scrub_columns(df, "text").collect():
        assert (r["pii_text"], r["pii_detected"]) == _scrub(r["text"])


def _detect(value):
    cleaned = re.sub(r"https?://\S+", "", value)
    cleaned = re.sub(K.EMAIL, "", cleaned)
    cleaned = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", cleaned)).strip().lower()
    if not cleaned:
        return "en", 0.0, "default"
    results, words = [], cleaned.split()
    if len(words) >= 3:
        shares = {k: sum(w in ws for w in words) / len(words) for k, ws in K.COMMON_WORDS.items()}
        best = max(shares, key=shares.get)
        if shares[best] > 0.1:
            results.append((best, min(shares[best], 1.0), "word_frequency"))
    if len(cleaned) >= 10:
        scores = {}
        for k, expected in K.VOWEL_SHARES.items():
            scores[k] = sum(1 - abs(cleaned.count(c) / len(cleaned) - e) / e for c, e in expected.items()) / len(expected)
        best = max(scores, key=scores.get)
        if scores[best] > 0.6:
            results.append((best, min(scores[best], 1.0), "character_patterns"))
    langs = [lang for u in re.findall(K.URL, value) for d, lang in K.DOMAIN_LANGUAGES.items() if d in u]
    if langs:
        best = max(dict.fromkeys(K.DOMAIN_LANGUAGES.values()), key=langs.count)
        results.append((best, langs.count(best) / len(langs), "url_analysis"))
    return max(results, key=lambda r: r[1]) if results else ("en", 0.5, "fallback")


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    for df, column in ((_texts(spark), "t"), (docs, "text")):
        for r in language.detect_columns(df, column).collect():
            name, confidence, method = _detect(r[column])
            assert (r["lang"]["language"], r["lang"]["method"]) == (name, method), r[column][:80]
            assert r["lang"]["confidence"] == pytest.approx(confidence)


def test_words(spark):
    for r in _texts(spark).select("t", text.word_count(F.col("t")).alias("n"), text.truncate_words(F.col("t"), 3).alias("c")).collect():
        words = r["t"].split()
        assert r["n"] == len(words)
        assert r["c"] == (" ".join(words[:3]) if len(words) > 3 else r["t"])


def test_normalize_drops_short_and_cuts_long(spark):
    rows = [(1, "s", "1", "u", "T", "two words", None, None, None), (2, "s", "2", "u", None, "one two three four five six", "x", None, None), (3, "s", "3", "u", "T", None, "x", None, None)]
    schema = "id int, source_type string, source_id string, url string, title string, content string, author string, author_url string, timestamp timestamp_ntz"
    out = normalize.normalize_documents(spark.createDataFrame(rows, schema), max_words=5).collect()
    assert [(r["raw_feedback_id"], r["title"], r["body"], r["word_count"]) for r in out] == [(2, "", "one two three four five", 5)]


def test_normalize_counts_words_once_and_skips_single_blanks(spark):
    """The words of a body are split once to count and once to cut; gaps of one blank are left alone, others become one."""
    texts = ["".join("ab \n\t\x85　-"[(i * 7919 + k * k * 31 + k * i) % 8] for k in range(i % 23)) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    out = df.select("t", text.collapse_spaces(F.col("t")).alias("c"), language.clean_for_detection(F.col("t")).alias("d"))
    for r in text.clean_html_columns(out, "t", "h").collect():
        assert r["c"] == re.sub(r"\s+", " ", r["t"]) and r["h"] == r["c"].strip()
        assert r["d"] == re.sub(r"[\W]+", " ", r["t"]).strip().lower()
    raw = df.selectExpr("id", "'s' source_type", "t title", "t content", "'' author", "'' url", "timestamp_ntz'2024-01-01' timestamp")
    plan = normalize.normalize_documents(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2  # three before
    assert f", {text.SPACE}+,  , 1)" not in plan  # every gap was replaced before
