"""Text cleaning as column expressions (no Python in the row path)."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space the way Python's str methods see it, as plain ranges: a Unicode property
# lookup per character costs many times as much.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_SPACES}]"
WORD = f"[^{_SPACES}]+"

_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
# Small fixed table of the plain fallback cleaner.
BASIC_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
_BLOCKS = ["p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li"]


def compute_once(df, name: str, value: Column):
    """Add a costly column that later filters must not duplicate.

    A filter on a projected column is pushed below the projection by substitution, which
    runs the whole expression again inside the filter. A one-element generator stops that.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def collapse_spaces(col: Column) -> Column:
    """One blank for each run of white space; single blanks, nearly all runs, are not matched."""
    return F.regexp_replace(col, f"{SPACE}(?:(?<! )|(?={SPACE})){SPACE}*", " ")


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(col, rf"\A{SPACE}+|{SPACE}+\z", "")


def let(value: Column, use) -> Column:
    """`use(value)` with `value` evaluated once, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(col: Column) -> Column:
    """Words between white space; one literal split is far cheaper than a regex per word."""
    blanks = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    return F.array_remove(F.split(F.translate(col, blanks, " " * len(blanks)), " "), "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


def truncate_words(col: Column, limit: int, count: Column | None = None) -> Column:
    """First `limit` words joined by one space; shorter texts stay as they are. `count`: the words, if known."""
    return F.when((word_count(col) if count is None else count) > limit, F.array_join(F.slice(words(col), 1, limit), " ")).otherwise(col)


def rebuild(col: Column, pattern: str, replace) -> Column:
    """Replace each match of `pattern` by `replace(match)`.

    The text is cut at the matches and zipped back with the rewritten matches, which is
    exact where folding `replace` calls is not (a match can be a substring of another).
    """
    parts = F.split(col, pattern, -1)
    found = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        parts, found, lambda part, hit: F.concat(part, F.when(hit.isNull(), F.lit("")).otherwise(replace(hit)))
    )
    return F.when(F.size(found) == 0, col).otherwise(F.array_join(pieces, ""))


def _entity_map() -> Column:
    pairs = []
    for name, code in sorted(name2codepoint.items()):
        pairs += [F.lit(name), F.lit(chr(code))]
    return F.create_map(*pairs, F.lit("apos"), F.lit("'"))


def _code_point(number: Column) -> Column:
    """Character of a code point: big-endian UTF-32 bytes decoded by the JVM."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _decode_one(entity: Column) -> Column:
    body = F.substring(entity, 2, 40)
    body = F.substring(body, F.lit(1), F.length(body) - 1)
    hexa = F.conv(F.substring(body, 3, 8), 16, 10).try_cast("bigint")
    deci = F.substring(body, 2, 8).try_cast("bigint")
    number = F.when(F.lower(F.substring(body, 1, 2)) == "#x", hexa).when(F.substring(body, 1, 1) == "#", deci)
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.coalesce(F.when(valid, _code_point(number)), F.try_element_at(_entity_map(), body), entity)


def decode_entities(col: Column) -> Column:
    return F.when(col.contains("&"), rebuild(col, _ENTITY, _decode_one)).otherwise(col)


def strip_markup(col: Column) -> Column:
    """Drop comments, script and style elements, declarations and tags; entities stay."""
    out = F.regexp_replace(col, r"(?s)<!--.*?(?:-->|\z)", "")
    out = F.regexp_replace(out, r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)", "")
    out = F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)", "")
    out = F.regexp_replace(out, r"(?s)<[!?][^>]*>", "")
    return F.regexp_replace(out, r"""(?s)</?[A-Za-z][^\s/>"']*(?:"[^"]*"|'[^']*'|[^'">])*>""", "")


def break_after_blocks(col: Column) -> Column:
    """New line after a literal closing block tag that survived entity decoding."""
    broken = F.regexp_replace(col, "(</(?:" + "|".join(_BLOCKS) + ")>)", "$1\n")
    return F.when(col.contains("</"), broken).otherwise(col)


def _strip_collapsed(col: Column) -> Column:
    """`strip` of a text whose white space is blanks and new lines only."""
    ends = [f(F.lit(c)) for f in (col.startswith, col.endswith) for c in (" ", "\n")]
    return F.when(ends[0] | ends[1] | ends[2] | ends[3], F.btrim(col, F.lit(" \n"))).otherwise(col)


def clean_html_columns(df, column: str, out: str):
    """Add the plain text of an HTML column; one projection per pass, nothing runs twice."""
    marked = f"__{out}_marked"
    raw = text_or_empty(F.col(column))
    df = df.withColumn(marked, F.when(raw.contains("<"), strip_markup(raw)).otherwise(raw))
    df = df.withColumn(marked, decode_entities(F.col(marked)))
    df = df.withColumn(marked, collapse_spaces(F.col(marked)))
    df = df.withColumn(marked, break_after_blocks(F.col(marked)))
    return compute_once(df, out, _strip_collapsed(F.col(marked))).drop(marked)


def cut_title(cleaned: Column, limit: int = 200) -> Column:
    cut = F.concat(F.substring(cleaned, 1, limit), F.lit("..."))
    return strip(F.when(F.length(cleaned) > limit, cut).otherwise(cleaned))


def basic_html_clean(col: Column) -> Column:
    """Plain fallback: drop anything in angle brackets, decode six entities."""
    out = F.regexp_replace(text_or_empty(col), "<[^>]+>", "")
    for entity, char in BASIC_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(collapse_spaces(out))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, NULL when the tag does not have it."""
    quoted = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    present = tag.rlike(rf"(?is)\s{name}\s*=")
    value = F.concat(*[F.regexp_extract(tag, quoted, i) for i in (1, 2, 3)])
    return F.when(present, decode_entities(value))


def extract_links(col: Column) -> Column:
    """array<struct<url,text>> of anchors that carry an href."""
    body = F.regexp_replace(text_or_empty(col), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<a\s[^>]*>.*?(?:</a\s*>|(?=<a\s)|\z)"), F.lit(0))
    links = F.transform(
        found,
        lambda a: F.struct(
            _attribute(F.regexp_extract(a, r"(?is)\A<a\s[^>]*>", 0), "href").alias("url"),
            strip(decode_entities(strip_markup(a))).alias("text"),
        ),
    )
    return F.filter(links, lambda link: link["url"].isNotNull())


def extract_images(col: Column) -> Column:
    """array<struct<src,alt,title>> of images that carry a src."""
    body = F.regexp_replace(text_or_empty(col), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<img\s[^>]*>"), F.lit(0))
    images = F.transform(
        found,
        lambda tag: F.struct(
            _attribute(tag, "src").alias("src"),
            F.coalesce(_attribute(tag, "alt"), F.lit("")).alias("alt"),
            F.coalesce(_attribute(tag, "title"), F.lit("")).alias("title"),
        ),
    )
    return F.filter(images, lambda img: img["src"].isNotNull())
