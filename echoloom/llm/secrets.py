"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are long words with a digit (letters, digits and `+ / _ -`). Features are their length,
how surprising their letter sequences are next to the corpus's ordinary words (character
transitions), how much of them ordinary words cover, whether they lie in a path or address, and what
words stand before them. The forest is trained on labelled findings. Only DataFrame functions and
Spark's own forest are used.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import frozen, sampled

MIN_LENGTH = 16
SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 40, 8, 11
LEAST = 0.5

#: Words that announce a secret.
KEYWORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "auth", "credential", "private_key", "bearer"]
#: Published formats of keys that name their issuer.
FORMATS = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_live_[A-Za-z0-9]{16,}$|^xox[abpr]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$"
#: Frequent letter pairs of European words.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie un ue qu ai au".split()

FEATURES = ["length", "digits", "uppers", "classes", "changes", "odd_pairs", "covered", "hex", "distinct", "in_path", "at_sign", "keyword", "assigned", "quoted", "known_format"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, place, before, word, found) of every candidate of every whole text.

    place is the number of the word between blanks, `before` the three words in front of it, `found` the
    candidate inside the word. NULL and empty texts have none; repeated rows give repeated rows.
    """
    words = F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+")
    rows = docs.select("doc_id", words.alias("words"))
    long_ones = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))),
        lambda x: (F.length(x["word"]) >= MIN_LENGTH) & x["word"].rlike(r"[0-9]") & x["word"].rlike(r"[A-Za-z0-9+/_\-]{16}"),
    )
    picked = rows.select("doc_id", "words", F.explode(long_ones).alias("w"))
    start = F.greatest(F.col("w.place") - 2, F.lit(1))
    before = F.lower(F.array_join(F.slice("words", start, F.col("w.place") + 1 - start), " "))
    inside = F.regexp_extract_all(F.col("w.word"), F.lit(r"([A-Za-z0-9+/_\-]{16,}=*)"), 1)
    picked = picked.select("doc_id", F.col("w.place").cast("long").alias("place"), before.alias("before"), F.col("w.word").alias("word"), F.explode(inside).alias("found"))
    return picked.where(F.col("found").rlike("[0-9]"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """The candidates with one number for each of FEATURES."""
    word = F.col("found")
    size = F.length(word).cast("double")
    low = F.lower(word)
    kinds = sum(word.rlike(p).cast("double") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[+/_\-=]"))
    pairs = _count(low, "(?=[a-z][a-z])")
    usual = _count(low, "(?=" + "|".join(PAIRS) + ")")
    runs = F.aggregate(F.regexp_extract_all(low, F.lit("[a-z]{4,}"), F.lit(0)), F.lit(0), lambda a, w: a + F.length(w)).cast("double")
    prefix = F.substring(F.col("word"), F.lit(1), F.call_function("locate", word, F.col("word")) - 1)
    near = F.concat(F.col("before"), F.lit(" "), F.lower(prefix))
    return found.select(
        "*",
        size.alias("length"), (_count(word, "[0-9]") / size).alias("digits"), (_count(word, "[A-Z]") / size).alias("uppers"), kinds.alias("classes"),
        (_count(word, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]") / size).alias("changes"),
        F.when(pairs > 0, 1 - usual / pairs).otherwise(1.0).alias("odd_pairs"), (runs / size).alias("covered"),
        F.when(low.rlike("^[0-9a-f]+$"), 1.0).otherwise(0.0).alias("hex"),
        (F.size(F.array_distinct(F.split(word, ""))) / size).alias("distinct"),
        F.when(F.lower(F.col("word")).rlike(r"https?:|www\.|^/|\.(?:html?|com|net|org|php|js|css|png|jpe?g)\b|/.*/"), 1.0).otherwise(0.0).alias("in_path"),
        F.when(F.col("word").contains("@"), 1.0).otherwise(0.0).alias("at_sign"),
        F.when(near.rlike("(?:" + "|".join(KEYWORDS) + r")\W*$"), 1.0).otherwise(0.0).alias("keyword"),
        F.when(near.rlike(r"[=:]\W*$"), 1.0).otherwise(0.0).alias("assigned"),
        F.when(prefix.rlike("[\"']$"), 1.0).otherwise(0.0).alias("quoted"),
        F.when(word.rlike(FORMATS), 1.0).otherwise(0.0).alias("known_format"),
    )


def labelled_findings(found: DataFrame) -> DataFrame:
    """Findings with a label from reviewers' rules of thumb: 1, 0, or none (left out).

    1: published key formats, and random-looking values assigned to a word that announces a secret.
    0: addresses and paths, numbers, and values with mostly ordinary letter sequences that nothing announces.
    """
    random_like = (F.col("digits") > 0.15) & (F.col("digits") < 0.95) & (F.col("covered") < 0.6)
    yes = (F.col("known_format") == 1) | ((F.col("keyword") == 1) & (F.col("assigned") == 1) & random_like)
    no = (F.col("keyword") == 0) & (F.col("known_format") == 0) & (
        (F.col("in_path") == 1) | (F.col("at_sign") == 1) | (F.col("digits") >= 0.95) | ((F.col("odd_pairs") < 0.7) & (F.col("covered") > 0.5))
    )
    return found.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).where("label is not null")


def fit(featured: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """The forest, from at most about `sample_rows` labelled findings; None if one label is missing."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two labels
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1.0, min(1.0, sample_rows / 2 / counts[1.0])).otherwise(min(1.0, sample_rows / 2 / counts[0.0]))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", "place", "found"), F.lit(1 << 30)) < share * (1 << 30))
    picked = frozen(picked)
    counts = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}  # of the sample: it is what the weights balance
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1.0, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(picked.withColumn("weight", weight)).select("features", "label", "weight")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(data)


def scan(docs: DataFrame, labelled: DataFrame | None = None, least: float = LEAST, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, place, found_sha256, length, probability, is_secret) of every candidate.

    `labelled` are findings with the columns of FEATURES and `label`; without it the rules of
    `labelled_findings` label the corpus's own. The secret itself is not returned, only its digest.
    With fewer than two labels to learn from, known formats have probability 1, all others 0.
    """
    featured = frozen(with_features(candidates(docs)))
    model = fit(featured, labelled_findings(featured) if labelled is None else labelled, sample_rows)
    if model is None:
        scored = featured.withColumn("probability", F.col("known_format"))
    else:
        judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured))
        scored = judged.withColumn("probability", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "place", F.sha2("found", 256).alias("found_sha256"), F.col("length").cast("long").alias("length"),
        F.round("probability", 6).alias("probability"), (F.col("probability") >= least).alias("is_secret"),
    )
