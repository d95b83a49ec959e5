"""BPE, licences, language, toxicity against brute force, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm import bpe, language, license, queries, toxicity

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "   \n\n  x"), (4, "Don't stop<|endoftext|> now 12345  \t end"), (5, "日本語 тест ñandú 🎉🎉 ½ ² Ⅷ \u0558 \x1c \x85 \u200b"),
    (5, "Don't stop<|endoftext|> now 12345  \t end"), (None, "null id"), (7, "long " * 40_000), (8, "'s 'S 're I'll we've _under_ a_b"),
]


@pytest.fixture(scope="module")
def spec():
    return bpe.read_spec(queries.tokenizer_path())


def digests(spec, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    out = []
    for text in texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def test_bpe_matches_the_library(spark, tables, spec):
    rows = tables("documents")
    want = sorted(zip(rows.doc_id.tolist(), digests(spec, rows.text)))
    got = sorted((r[0], tuple(r[1:])) for r in queries.op1_bpe(spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("block_chars", [50, 16_000_000])
def test_bpe_edges(docs, spec, block_chars):
    got = bpe.round_trip(docs(ODD), spec, block_chars, bucket_chars=1000).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == sorted((repr(i), *d) for (i, _), d in zip(ODD, digests(spec, [t for _, t in ODD])))


def test_bpe_ids_and_decoding(docs, spec):
    table = docs(ODD)
    back = bpe.decode(bpe.encode(table, spec), spec).collect()
    assert sorted(r["decoded"] for r in back) == sorted(t or "" for _, t in ODD)
    assert bpe.encode(docs([(1, None)]).where("false"), spec).count() == 0


def test_word_cutting_by_character(spec):
    """The standard module's, regex's and the library's classes agree wherever they are used."""
    words = bpe.Words(spec)
    for code in [*range(1, 0x3000), *range(0x3000, 0x11000, 7)]:
        if 0xD800 <= code < 0xE000:
            continue
        text = f"a{chr(code)}1 {chr(code)}{chr(code)}! {chr(code)} b"
        assert words.of(text) == [text[i:j] for _, (i, j) in words.tokenizer.pre_tokenizer.pre_tokenize_str(text)], hex(code)


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(i, label) for phrase, label in license.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [p for p, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in places}))


def test_license_base(spark, tables, docs):
    rows = tables("documents")
    got = {r["doc_id"]: tuple(r)[1:6] for r in queries.op4_license(spark, SF).collect()}
    assert got == {i: brute_license(t) for i, t in zip(rows.doc_id.tolist(), rows.text)}
    odd = [(1, None), (2, ""), (3, "MIT License MIT license the mit-license éMIT license"), (4, "Under the MIT\u00a0license x"), (5, "Apache License, Version 2.0 / CC BY-NC" * 9000)]
    got = license.scan_documents(docs(odd)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == {i: brute_license(t) for i, t in odd}
    assert {r["doc_id"]: r["score"] for r in got}[1] == 0.0


def test_license_base_phrases(docs):
    """The MIT phrase of the base scan is four words long; the shorter notice gives the method's label only."""
    rows = license.scan_documents(docs([(1, "Use it Under the MIT License."), (2, "MIT License"), (3, "under the mit licenses"), (4, "cc by nc, under the mit license")])).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in rows}
    assert got == {1: (6, 1, 2, 2, "mit", "mit"), 2: (2, 0, None, None, "", "mit"), 3: (4, 0, None, None, "", ""), 4: (7, 2, 0, 3, "cc-by-nc,mit", "cc-by-nc,mit")}


def test_license_expressions(docs):
    assert license.postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert license.postfix("(MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0") == ["mit", "apache-2.0", "or", "gpl-2.0", "classpath-exception-2.0", "with", "and"]
    assert license.postfix("(MIT OR") is None and license.postfix("AND MIT") is None and license.postfix(")") is None
    assert license.evaluate("MIT OR GPL-3.0")[1] == 1.0 and license.evaluate("MIT AND GPL-3.0")[1] == 0.5
    row = license.scan_documents(docs([(1, "// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note OR MIT\ncode")])).first()
    assert row["labels"] == "gpl-2.0-only-with-linux-syscall-note,mit" and row["base_labels"] == "" and row["score"] == 1.0


def test_language_held_out(spark, tables):
    rows = {r["doc_id"]: r for r in queries.op5_language(spark, SF).collect()}
    truth = tables("documents")
    assert len(rows) == len(truth)
    held = [(i, v) for i, v in zip(truth.doc_id.tolist(), truth.lang) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in rows.items() if r["held_out"]} == {i for i, _ in held}
    assert np.mean([rows[i]["lang_pred"] == v for i, v in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_edges(docs):
    table = docs([(i, "das ist ein Satz über die Welt und den Tag", "de", "s") for i in range(1, 9)] + [(i, "this is the way of the world and the day", "en", "s") for i in range(9, 17)] + [(20, None), (21, ""), (22, "12 !! 34"), (23, "the world and the day"), (None, "die Welt und der Tag")])
    model = language.fit(table)
    got = [(r["doc_id"], r["lang_pred"]) for r in language.predict(table, model).where("doc_id >= 20 or doc_id is null").collect()]
    assert sorted(got, key=repr) == sorted([(20, "und"), (21, "und"), (22, "und"), (23, "en"), (None, "de")], key=repr)
    nothing = language.fit(table.where("false"))
    assert {r["lang_pred"] for r in language.predict(table, nothing).collect()} == {"und"}


def test_toxicity_folding_and_matching():
    machine = toxicity.Lexicon({"idiot": 1.0, "trash": 0.5, "clown": 0.5}).automaton()
    hits = lambda t: toxicity.features(t, machine)[0]
    assert hits("You 1d10t!") == 1 and hits("уou іdіоt") == 1 and hits("ＩＤＩＯＴ") == 1 and hits("tr@sh") == 1
    assert hits("the idiotic trashcan") == 0 and hits("a trash can, a clown fish") == 0 and hits("trash in a trash can") == 1
    for text in ("an idiot, a clown: idiot", "trash trash", "trash can trash"):
        folded = toxicity.fold_text(text)
        brute = sum(len(re.findall(rf"\b{w}\b", re.sub("trash can|clown fish", "#", folded))) for w in ("idiot", "trash", "clown"))
        assert hits(text) == brute


def test_toxicity_query(spark, tables):
    rows = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert len(rows) == len(tables("documents"))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    assert {i for i, r in rows.items() if r["held_out"]} == {i for i in rows if zlib.crc32(str(i).encode()) % 3 == 1}


def test_toxicity_edges(spark, docs):
    words = "one two three four five six seven eight nine ten".split()
    plain = [(i, " ".join(words[(i * j) % 10] for j in range(1, 40))) for i in range(1, 41)]
    bad = [(i, f"{words[i % 10]} {words[i % 7]} you gronk {words[i % 9]} {words[i % 4]} {i * 'x'}") for i in range(41, 71)]
    table = docs(plain + bad + [(90, None), (91, ""), (92, "gronk"), (None, "gronk"), (93, "word " * 50_000)])
    labels = spark.createDataFrame([(i, 0) for i, _ in plain] + [(i, 1) for i, _ in bad] + [(None, 1), (95, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(table, labels)
    assert "gronk" in lexicon.weights
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(table, lexicon).collect()}
    assert got[92] == 1 and got[None] == 1 and got[90] == got[91] == got[93] == 0 and not any(got[i] for i, _ in plain)
    assert toxicity.fit(table, labels.where("false")).weights.keys() == set(toxicity.SEEDS)
    clash = table.withColumn("score", F.lit("x")).withColumn("matches", F.lit(1))
    assert toxicity.drop_toxic(clash, lexicon).columns == clash.columns
    assert toxicity.drop_toxic(clash, lexicon).where("text = 'gronk'").count() == 0
