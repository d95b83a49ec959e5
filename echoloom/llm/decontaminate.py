"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become templates: numbers, names (capitalised words inside a sentence)
and units turn into typed placeholders, other words lose case and punctuation. Windows of template
words are hashed and joined, once with the capitalised words that begin a sentence as words and once as names; an item counts as leaked into a text when enough of its windows are
there and its slots are consistent, i.e. every value of the item is replaced by one and the same
value throughout one alignment of item and text, a run of neighbouring alignments, or the first
places of all windows. Equal values make an exact leak, others a re-parameterised question.

Only DataFrame functions are used. Every text is read once and never shuffled. A word table of fixed size tells
which words the benchmark knows; only places whose words are all known or may be placeholders, with
one of the window's longest plain words among them, get a template and a hash. A template depends on a word and the two
before it, so it is made of the place alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import frozen, let, spare

WINDOW = 8
COVERAGE = 0.5
#: Windows of the benchmark that are sent to all tasks at most; more are joined by a shuffle.
BLOCK = 500_000
#: The table of word classes has 2 ** CELLS cells of two bits at most.
CELLS = 23
#: Words before a window on which its template depends.
LEAD = 2

#: Unit words after a number.
UNITS = (
    "km m cm mm kg g mg lb lbs oz l ml mph kmh km/h ft in inch inches mi miles meter meters metre metres gram grams litre litres liter liters "
    "s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years % percent "
    "dollar dollars euro euros pound pounds cent cents usd eur gbp celsius fahrenheit kelvin degrees"
).split()
NAME, NUMBER, UNIT, START, PAIR = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"


def spaced(text: Column) -> Column:
    """White space as single blanks, none at the ends; NULL as an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u00A0\u2000-\u200A\u3000]+", " "))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), f"[^\\p{{L}}\\p{{N}}{NAME}{NUMBER}{UNIT}{START} ]+", "")


def templates(text: Column) -> Column:
    """Two rows of words of a spaced text with placeholders, each with as many words as the text has.

    A capitalised word that begins a sentence is an ordinary word in the first and a name in the second.
    """
    named = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;:] )\p{Lu}[\p{L}'’\-]+", NAME)
    marked = F.regexp_replace(named, r"(?<![\p{L}\p{N}'’\-])(?=\p{Lu}[\p{L}'’\-])", START)
    numbered = F.regexp_replace(marked, r"[$€£]?\d+(?:[.,:/]\d+)*", NUMBER)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    plain = _plain(F.regexp_replace(numbered, f"(?<={NUMBER} ?)(?:{units})(?![\\p{{L}}\\p{{N}}])", UNIT))
    return let(plain, lambda p: F.array(F.split(F.translate(p, START, ""), " "), F.split(F.regexp_replace(p, f"{START}\\p{{L}}+", NAME), " ")))


def values(text: Column) -> Column:
    """The same words with their values, to compare slots."""
    return F.split(_plain(text), " ")


def _slotted(word: Column) -> Column:
    return F.exists(F.array(F.lit(NAME), F.lit(NUMBER), F.lit(UNIT)), lambda h: word.contains(h))


def _longest(words: Column) -> Column:
    return F.element_at(F.sort_array(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), 1)["w"]


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, total, set, at, hash, said, strict, known, anchor) of all windows of `items` (item_id, raw).

    set 0 and 1 are the templates of `templates`, set 2 the words of items shorter than a window. said holds the
    item's values where the template has placeholders; a window without a plain word is strict, i.e. all
    its values must be met again. known are words a text must have in these places, anchor is one of them.
    """
    split = items.select("item_id", templates(F.col("raw")).alias("shapes"), values(F.col("raw")).alias("said"))
    split = frozen(split.where(F.exists("said", lambda w: w != "")), items.count())
    whole = split.where(F.size("said") >= size).select("item_id", (F.size("said") - size + 1).alias("total"), "said", F.posexplode("shapes").alias("set", "shape"))
    whole = whole.select("item_id", "total", "set", "said", "shape", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("at"))
    whole = whole.select("item_id", "total", "set", "at", F.slice("shape", F.col("at") + 1, size).alias("shape"), F.slice("said", F.col("at") + 1, size).alias("all"))
    few = split.where(F.size("said") < size).select("item_id", F.lit(1).alias("total"), F.lit(2).alias("set"), F.lit(0).alias("at"), F.col("said").alias("shape"), F.col("said").alias("all"))
    cut = whole.unionByName(few).withColumn("plain", F.filter("shape", lambda w: ~_slotted(w)))
    strict = (F.col("set") == 2) | ~F.exists("plain", lambda w: w != "")
    said = F.when(strict, F.col("all")).otherwise(F.zip_with("shape", "all", lambda s, v: F.when(_slotted(s), v)))
    known = F.when(strict, F.col("all")).otherwise(F.col("plain"))
    rows = cut.select("item_id", "total", "set", "at", F.xxhash64("shape").alias("hash"), said.alias("said"), strict.alias("strict"), known.alias("known"))
    return rows.withColumn("anchor", _longest(F.col("known")))


def word_classes(parts: DataFrame) -> tuple[Column, int]:
    """(table, cells): two bits for each cell of word hashes, 1 for known words, 3 for anchors.

    The table has a size fixed by CELLS whatever the number of words; words that share a cell only add
    places to look at.
    """
    words = parts.select(F.explode("known").alias("word"), F.lit(1).alias("code")).unionByName(parts.select(F.col("anchor").alias("word"), F.lit(3).alias("code")))
    units = parts.sparkSession.createDataFrame([(u, 1) for u in UNITS], "word string, code int")
    words = words.unionByName(units).groupBy("word").agg(F.max("code").alias("code"))
    cells = 1 << min(max(12, (64 * words.count()).bit_length()), CELLS)
    cell = F.xxhash64("word").bitwiseAND(F.lit(cells - 1))
    bits = F.call_function("shiftleft", F.col("code").cast("long"), (cell.bitwiseAND(F.lit(31)) * 2).cast("int"))
    table = [0] * (cells // 32)
    for r in words.groupBy(F.shiftright(cell, 5).alias("at")).agg(F.bit_or(bits).alias("bits")).collect():  # cells / 32 rows at most
        table[r["at"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), cells


def _places(rows: DataFrame, classes: tuple[Column, int], sizes: list[int], size: int) -> DataFrame:
    """(doc_id, row, size, pos, lead, local, said): the places of texts (raw) where a window may match.

    All words of such a place are known, or may be a placeholder (they have a capital or a digit), and one is
    an anchor. local is the place with `lead` words before it, which is all that its template depends on.
    """
    table, cells = classes

    def code(word: Column) -> Column:
        cell = F.xxhash64(word).bitwiseAND(F.lit(cells - 1))
        return F.call_function("shiftrightunsigned", F.get(table, F.shiftright(cell, 5).cast("int")), (cell.bitwiseAND(F.lit(31)) * 2).cast("int")).bitwiseAND(F.lit(3))

    split = rows.select("doc_id", "row", F.split("raw", " ").alias("words"), values(F.col("raw")).alias("said"))
    coded = split.select("doc_id", "row", "words", "said", F.transform("said", code).alias("codes"))
    kind = F.zip_with("codes", "words", lambda c, w: F.when(c > 0, c).when(w.rlike(r"[\p{Lu}\p{N}]"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    marked = coded.select("doc_id", "row", "words", "said", kind.alias("kinds"))
    shape = "array<struct<size:int,pos:int,lead:int,local:string,said:array<string>>>"

    def of_size(n: int) -> Column:
        def fits(i: Column) -> Column:
            each = [F.get(F.col("kinds"), i + k) for k in range(n)]
            return reduce(Column.__and__, [e > 0 for e in each]) & reduce(Column.__or__, [e == 3 for e in each])

        starts = F.filter(F.sequence(F.lit(0), F.size("kinds") - n), fits)
        lead = lambda s: F.least(s, F.lit(LEAD))
        place = lambda s: F.struct(
            F.lit(n).alias("size"), s.alias("pos"), lead(s).alias("lead"),
            F.array_join(F.slice("words", s + 1 - lead(s), lead(s) + n), " ").alias("local"), F.slice("said", s + 1, n).alias("said"),
        )
        return F.when(F.size("kinds") >= n, F.transform(starts, place)).otherwise(F.array().cast(shape))

    found = marked.select("doc_id", "row", F.explode(F.concat(*[of_size(n) for n in [*sizes, size]])).alias("p"))
    return found.select("doc_id", "row", "p.*")


def _hashed(places: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, from, pos, hash, said): the windows of the places; of the second template only those that differ."""
    shaped = places.withColumn("shapes", F.when(F.col("size") == size, templates(F.col("local"))))
    shaped = shaped.withColumn("hashes", F.transform("shapes", lambda w: F.xxhash64(F.slice(w, F.col("lead") + 1, size))))
    entry = lambda kind, value: F.struct(F.lit(kind).alias("from"), value.alias("hash"))
    first, second = F.col("hashes")[0], F.col("hashes")[1]
    both = F.when(first == second, F.array(entry(0, first))).otherwise(F.array(entry(0, first), entry(1, second)))
    each = F.when(F.col("size") == size, both).otherwise(F.array(entry(2, F.xxhash64("said"))))
    return shaped.select("doc_id", "row", "pos", "said", F.explode(each).alias("e")).select("doc_id", "row", "e.*", "pos", "said")


# a pair of slot values is one text, so that sets of pairs are hashed
def _item_value(pair: Column) -> Column:
    return F.substring_index(pair, PAIR, 1)


def _doc_value(pair: Column) -> Column:
    return F.substring_index(pair, PAIR, -1)


def _consistent(pairs: Column) -> Column:
    return F.size(F.array_distinct(F.transform(pairs, _item_value))) == F.size(pairs)


def _judged(ats: Column, pairs: Column) -> Column:
    return F.struct(F.forall(pairs, lambda p: _item_value(p) == _doc_value(p)).alias("same"), F.size(ats).alias("windows"), pairs.alias("pairs"))


def _best_run(sets: Column, least: Column) -> Column:
    """The best of the runs of neighbouring alignments, put together as long as their slots agree; NULL if none is good."""
    one_type = "struct<ats:array<int>,pairs:array<string>>"
    best_type = "struct<same:boolean,windows:int,pairs:array<string>>"
    start = F.struct(F.lit(None).cast(one_type).alias("run"), F.lit(None).cast(best_type).alias("best"))

    def add(state: Column, one: Column) -> Column:
        this = F.struct(one["ats"].alias("ats"), one["pairs"].alias("pairs"))
        both = F.struct(F.array_union(state["run"]["ats"], one["ats"]).alias("ats"), F.array_union(state["run"]["pairs"], one["pairs"]).alias("pairs"))
        joined = let(both, lambda b: F.when(b["ats"].isNotNull() & _consistent(b["pairs"]), b).otherwise(this))
        judged = lambda run: F.when(F.size(run["ats"]) >= least, _judged(run["ats"], run["pairs"]))
        return let(joined, lambda run: F.struct(run.alias("run"), F.greatest(state["best"], judged(run)).alias("best")))

    return F.aggregate(sets, start, add)["best"]


def find_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, kind, coverage, windows, slots) of every leaked item of every text.

    docs has doc_id and text, items has item_id and text; other columns play no part. kind is `exact` or
    `reparameterised`; coverage is the share of the item's windows found; slots maps the item's slot values to the
    text's. Items with equal words count as the one with the smallest id. Windows without a plain word, and items
    with fewer words than a window, match with equal values only. NULL and empty texts and items,
    items without letters and digits and items with a NULL id take no part. Rows that repeat a doc_id count as one document;
    rows with a NULL doc_id are documents of their own and reported as NULL.
    """
    listed = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), spaced(F.col("text")).alias("raw"))
    parts = item_windows(listed.groupBy("raw").agg(F.min("item_id").alias("item_id")), size)
    parts = frozen(parts, parts.count())
    sizes = sorted(r[0] for r in parts.where("set = 2").select(F.size("said")).distinct().collect())  # fewer than `size` numbers
    wanted = parts.select("item_id", "total", "set", "at", "hash", F.col("said").alias("theirs"), "strict")
    if parts.count() <= block:
        wanted = F.broadcast(wanted)

    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row")
    rows = _hashed(_places(docs.select("doc_id", own, spaced(F.col("text")).alias("raw")), word_classes(parts), sizes, size), size)
    hits = rows.join(wanted, "hash")
    # the second template also meets windows that are alike in both
    hits = hits.where((F.col("from") == F.col("set")) | ((F.col("from") == 0) & (F.col("set") == 1)))
    slots = F.filter(F.zip_with("theirs", "said", lambda a, b: F.when(a.isNotNull(), F.concat(a, F.lit(PAIR), b))), lambda p: p.isNotNull())
    hits = hits.select("doc_id", "row", "item_id", "total", "set", "strict", "at", "pos", F.array_distinct(slots).alias("pairs"))
    hits = frozen(hits.where(~F.col("strict") | F.forall("pairs", lambda p: _item_value(p) == _doc_value(p))))

    # windows of one alignment (place in the text less place in the item) are one copy of the item
    key = ["doc_id", "row", "item_id", "total", "set"]
    least, found = F.col("total") * coverage, hits.count()
    shifts = hits.groupBy(*key, (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("ats"), F.collect_set("pairs").alias("pairs"))
    shifts = frozen(shifts.withColumn("pairs", F.array_sort(F.array_distinct(F.flatten("pairs")))).where(_consistent(F.col("pairs"))), found)
    alone = shifts.where(F.size("ats") >= least).select(*key, _judged(F.col("ats"), F.col("pairs")).alias("best"))
    alone = frozen(alone.groupBy(*key).agg(F.max("best").alias("best")), found)
    # texts with words put in or left out: runs of alignments, or the first places of all windows
    settled = alone.where("best.same").select(*[F.col(c).alias(f"__{c}") for c in key])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    runs = shifts.join(settled, same, "left_anti").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("shift", "ats", "pairs"))).alias("sets"))
    runs = runs.select(*key, _best_run(F.col("sets"), least).alias("best"))
    firsts = hits.join(settled, same, "left_anti").groupBy(*key, "at").agg(F.min_by("pairs", "pos").alias("pairs"))
    firsts = firsts.groupBy(*key).agg(F.collect_list("at").alias("ats"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pairs")))).alias("pairs"))
    firsts = firsts.where((F.size("ats") >= least) & _consistent(F.col("pairs"))).select(*key, _judged(F.col("ats"), F.col("pairs")).alias("best"))
    # each template by itself, so that what one tells apart does not hide what the other finds
    leaks = alone.unionByName(runs).unionByName(firsts).where("best is not null").groupBy("doc_id", "row", "item_id", "total").agg(F.max("best").alias("best"))
    kind = F.when(F.col("best.same"), "exact").otherwise("reparameterised")
    told = F.array_sort(F.transform("best.pairs", lambda p: F.concat(_item_value(p), F.lit("="), _doc_value(p))))
    return leaks.select(
        "doc_id", "item_id", kind.alias("kind"), (F.col("best.windows") / F.col("total")).alias("coverage"), F.col("best.windows").cast("long").alias("windows"), told.alias("slots"),
    )


def drop_leaked(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """`docs` without the documents that hold a leaked item; all columns stay, NULL ids are kept."""
    key = spare(docs, "leaked_id")
    bad = find_leaks(docs, items, coverage).where("doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(key), "left_anti")
