"""Texts of many copies, lines, numbers and rows without ids, and decontamination against plain Python."""

import random
import time

import regex
from pyspark.sql import functions as F

from echoloom.llm import decontaminate, jaccard, line_dedup

NAME, NUMBER, UNIT, START = decontaminate.NAME, decontaminate.NUMBER, decontaminate.UNIT, decontaminate.START


# --- decontamination in plain Python ----------------------------------------------------
def plain(text):
    return regex.sub(f"[^\\p{{L}}\\p{{N}}{NAME}{NUMBER}{UNIT}{START} ]+", "", text.lower())


def shapes(text):
    named = regex.sub(r"(?<=[\p{Ll}\p{N},;:] )\p{Lu}[\p{L}'’\-]+", NAME, text)
    marked = regex.sub(r"(?<![\p{L}\p{N}'’\-])(?=\p{Lu}[\p{L}'’\-])", START, named)
    numbered = regex.sub(r"[$€£]?[0-9]+(?:[.,:/][0-9]+)*", NUMBER, marked)
    units = "|".join(sorted(decontaminate.UNITS, key=len, reverse=True))
    out = plain(regex.sub(f"(?<={NUMBER} ?)(?:{units})(?![\\p{{L}}\\p{{N}}])", UNIT, numbered))
    return out.replace(START, "").split(" "), regex.sub(f"{START}\\p{{L}}+", NAME, out).split(" ")


def slotted(word):
    return any(h in word for h in (NAME, NUMBER, UNIT))


def consistent(pairs):
    return len({a for a, _ in pairs}) == len(pairs)


def brute_leaks(docs, items, size=8, coverage=0.5):
    """{(doc, item): kind} over all windows of all texts and items."""
    first = {}
    for item_id, text in sorted(items):
        first.setdefault(" ".join(text.split()), item_id)
    found = {}
    for doc_id, text in docs:
        raw = " ".join((text or "").split())
        said, two = plain(raw).split(" "), shapes(raw)
        for item, item_id in first.items():
            theirs, forms = plain(item).split(" "), shapes(item)
            best = None
            for kind in (0, 1) if len(theirs) >= size else (2,):
                form, n = (theirs, len(theirs)) if kind == 2 else (forms[kind], size)
                hits = []
                for at in range(len(form) - n + 1):
                    strict = kind == 2 or not any(w and not slotted(w) for w in form[at : at + n])
                    slots = [k for k in range(n) if strict or slotted(form[at + k])]
                    for pos in range(len(said) - n + 1):
                        if any((said if kind == 2 else w)[pos : pos + n] == form[at : at + n] for w in ({2: [said], 0: two[:1], 1: two}[kind])):
                            pairs = {(theirs[at + k], said[pos + k]) for k in slots}
                            if not strict or all(a == b for a, b in pairs):
                                hits.append((at, pos, pairs))
                total = max(1, len(form) - n + 1)
                judge = lambda ats, pairs: (all(a == b for a, b in pairs), len(ats)) if len(ats) >= total * coverage and consistent(pairs) else None
                shifts = {}
                for at, pos, pairs in hits:
                    ats, seen = shifts.setdefault(pos - at, (set(), set()))
                    ats.add(at)
                    seen |= pairs
                run, tries = None, [judge(*s) for s in shifts.values()]
                for _, (ats, pairs) in sorted(shifts.items()):
                    if consistent(pairs):
                        both = (run[0] | ats, run[1] | pairs) if run else (ats, pairs)
                        run = both if consistent(both[1]) else (ats, pairs)
                        tries.append(judge(*run))
                places = {}
                for at, pos, pairs in sorted(hits, key=lambda h: h[:2]):
                    places.setdefault(at, pairs)
                tries.append(judge(set(places), set().union(*places.values())) if places else None)
                best = max([t for t in [*tries, best] if t], default=None)
            if best:
                found[doc_id, item_id] = "exact" if best[0] else "reparameterised"
    return found


def test_leaks_equal_plain_python(spark, docs):
    rng = random.Random(12)
    words = ["the", "bus", "takes", "of", "to", "and", "old", "bridge", "then", "far"]
    names, units = ["Ann", "Bob", "Tom's", "İda", "Éva"], ["km", "kg", "hours"]

    def text(n):
        out = []
        for _ in range(n):
            kind = rng.random()
            out.append(rng.choice(words) if kind < 0.62 else rng.choice(names) if kind < 0.74 else f"{rng.randrange(9)} {rng.choice(units)}" if kind < 0.84 else str(rng.randrange(30)) + rng.choice(["", ",", "%"]) if kind < 0.92 else rng.choice(["Then", "and,", "bridge.", "—", "$5", "(Ann)"]))
        return " ".join(out)

    items = [(i, text(rng.choice([9, 14, 30]))) for i in range(12)] + [(20, "old bridge"), (21, "12 15 18 21 24 27 30 33 36 39"), (22, "Ann 5 km Bob 7 kg Tom's 8 km Ann 5")]
    change = lambda t: " ".join(rng.choice(names) if w in names and rng.random() < 0.7 else str(rng.randrange(90)) if w.isdigit() and rng.random() < 0.7 else w for w in t.split())
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(6))]
        for _ in range(rng.randrange(1, 4)):
            item = rng.choice(items)[1]
            form = rng.choice([lambda t: t, change, change, lambda t: " ".join(t.split()[rng.randrange(4) :]), lambda t: t.replace(" of ", " of quite ")])
            parts += [form(item), text(rng.randrange(6))]
        rows.append((i, rng.choice([" ", ". ", "\n"]).join(parts)))
    rows += [(70, None), (71, ""), (72, "12 15 18 21 24 27 30 33 36 39"), (73, " ".join(map(str, range(200))))]
    want = brute_leaks(rows, items)
    table = docs(rows).withColumn("row", F.lit("clash")).withColumn("words", F.lit("clash"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit("clash"))
    for block in (500_000, 0):
        got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find_leaks(table, asked, block=block).collect()}
        assert set(got) == set(want)
        # a text with an exact alignment is not looked through for better ones
        assert sum(got[k] != want[k] for k in want) <= 0.05 * len(want)
    assert set(want.values()) == {"exact", "reparameterised"} and not {(73, 21)} & set(want)


def test_many_copies_and_numbers_in_a_text(spark, docs):
    item = "A train leaves Boston with 40 people and later another train with 40 people leaves for the coast at 9 km distance"
    numbers = "12 15 18 21 24 27 30 33 36 39"
    rows = [(1, (item + " ") * 1000), (2, " ".join(item.replace("40", str(i)) for i in range(50, 400))), (3, " ".join(map(str, range(20_000)))), (4, numbers), (None, " ".join(item.split()[:13])), (None, " ".join(item.split()[9:]))]
    items = spark.createDataFrame([(1, item), (2, numbers)], "item_id long, text string")
    began = time.time()
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find_leaks(docs(rows), items, coverage=0.9).collect()}
    assert got == {(1, 1): "exact", (2, 1): "reparameterised", (4, 2): "exact"}
    assert time.time() - began < 60


# --- line dedup -------------------------------------------------------------------------
def test_a_text_of_many_lines(spark, docs):
    lines = [f"line number {i} of a long page" for i in range(200_000)]
    rows = [(1, "\n".join(lines), None, "a"), (2, "\n".join(lines[:150_000]), None, "a"), (3, "\n".join(lines[:140_000]), None, "a"), (4, "own", None, "a")]
    began = time.time()
    got = {r["doc_id"]: (r["text"], r["n"]) for r in line_dedup.drop_boilerplate(docs(rows), dropped="n").collect()}
    want = {1: ("\n".join(lines[140_000:]), 140_000), 2: ("\n".join(lines[140_000:150_000]), 140_000), 3: ("", 140_000), 4: ("own", 0)}
    right = [got[i] == want[i] for i in want]  # texts too long for a report of differences
    assert right == [True] * 4
    long = "\n".join(f"{i} " + "word " * 50 for i in range(5000))
    table = docs([(i, long, None, "a") for i in range(3)] + [(9, long + "\nown", None, "b")])
    for limit in (0, 100_000):
        got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(table, steps=line_dedup.STEPS, broadcast_lines=limit).collect()}
        assert [got[i] == "" for i in range(3)] == [True] * 3 and len(got[9]) == len(long) + 4
    assert time.time() - began < 90


# --- near duplicates --------------------------------------------------------------------
def test_near_duplicates_without_ids(spark, docs):
    rng = random.Random(3)
    pairs = []
    for _ in range(700):
        words = [f"v{rng.randrange(5000)}" for _ in range(60)]
        pairs += [" ".join(words), " ".join([*words[:-1], "end"])]
    table = docs([(None, t) for t in pairs] + [(5, pairs[0]), (5, pairs[2]), (4, pairs[3])]).withColumn("gone_id", F.lit("clash"))
    began = time.time()
    rows = jaccard.near_duplicate_groups(table).collect()
    assert len(rows) == 1403 and sum(r["component_id"] is not None for r in rows) == 7
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in rows if r["component_id"]) == [(0, 4), (0, 4), (0, 5), (0, 5), (4, 4), (5, 4), (5, 5)]
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns and kept.where("doc_id is not null").count() == 1
    assert time.time() - began < 120
