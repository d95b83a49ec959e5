"""Ranked lexical search, vector code compression and SimHash near-dedup."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from oracle_check import compare, connect
from pyspark.sql import functions as F

from echoloom.llm import lexical, quantize, queries, simhash

SF = "/root/testdata/sf0.001"


# --- ranked lexical search --------------------------------------------------------------
def brute_search(docs, items, top=20):
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w, Counter(w)) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, w, c in held:
            m = 100 - 25 + (25 * len(w) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def test_lexical_search(spark, docs, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{min(rng.randrange(400), rng.randrange(400))}"
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.choice([1, 3, 20, 80, 300]))) for i in range(300)] + [(1000 + i, "Éa été W1; w2 w2\x00w3") for i in range(30)]
    rows += [(5, None), (6, ""), (7, " .,;- "), (None, "w1 w2 w3 w4"), (8, "w1 w1 w2"), (8, "w1 w1 w2"), (9, "w7 " * 60_000), (10, "W9-w9'w9 123")]
    items = [(i, text(rng.choice([1, 5, 30]))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (None, "w5 w5 w6"), (93, "w1 w1 w2"), (93, "w1 w1 w2"), (94, "w7"), (95, "É ÉA été")]
    table = docs(rows, 5).withColumn("digest", F.lit("clash")).withColumn("items", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("number", F.lit("clash"))
    want = brute_search(rows, items)
    for levels, terms, seeds in ((lexical.LEVELS, 200_000, 48), ((1, 2), 60, 20)):
        monkeypatch.setattr(lexical, "LEVELS", levels)
        got = lexical.search(table, asked, block_terms=terms, seeds=seeds)
        assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == want
    for d, i in ((table.where("false"), asked), (table, asked.where("false")), (docs([(1, None), (2, "..")]), asked)):
        assert lexical.search(d, i).count() == 0


def test_lexical_bounds():
    """Bounds are never under the score, and exact where no signature errs."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 400))) for _ in range(64)]
    vocabulary = {f"w{i}".encode(): i for i in range(60)}
    batches = list(lexical._indexed(vocabulary)(iter([__import__("pyarrow").RecordBatch.from_pydict({"doc_id": list(range(64)), "digest": list(range(64)), "text": texts})])))
    held = [Counter(lexical.terms(t)) for t in texts]
    total = sum(sum(c.values()) for c in held)
    df = [sum(t in c for c in held) for t in vocabulary]
    counts = [{rng.randrange(60): rng.randrange(1, 3) for _ in range(12)} for _ in range(10)]
    asked = lexical.Queries(list(range(10)), list(vocabulary), [lexical.weight(64, n) for n in df], counts, 64, total)
    hashes, matrix = lexical._prepared(asked)
    seen = 0
    for width, ids, _, sizes, bits in lexical._blocks(b for b in batches if b.column("bits").null_count == 0):
        found = lexical.bounds(width, sizes, bits, asked, hashes, matrix)
        for j, doc in enumerate(ids):
            m = lexical.length_factor(sizes[j], 64, total)
            for item in range(10):
                true = sum(n * asked.weights[t] * lexical.saturation(held[doc][f"w{t}".encode()], m) for t, n in counts[item].items() if held[doc][f"w{t}".encode()])
                assert found[item, j] >= true
                seen += found[item, j] <= 1.2 * true + 1
    assert seen > 0.8 * 640


def test_lexical_query(spark):
    assert compare(connect(SF), queries.ORACLES["op11_lexical"], queries.op11_lexical(spark, SF)) is None


# --- vector codes -----------------------------------------------------------------------
def plain_codes(rows, rounds=6):
    """[(vec_id, label, code, error)] and the codebooks, by plain loops over Python integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    length = 8 * max(1, -(-max((len(v) for _, v, _ in rows), default=0) // 8))
    width = length // 8
    ints = [[math.floor(4096 * x) for x in v] + [0] * (length - len(v)) for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:16]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[i], p) for i in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda j: (far(cut(v, p), books[p][j]), j)) for p in range(8)] for v in ints]
    for _ in range(rounds):
        codes = assign()
        for p in range(8):
            for j in range(len(books[p])):
                mine = [cut(v, p) for v, c in zip(ints, codes) if c[p] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    codes = assign()
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(8)) for v, c in zip(ints, codes)]
    return [(r[0], r[2], bytes(c).hex(), e) for r, c, e in zip(rows, codes, errors)], books


def test_vector_codes(spark):
    rng = np.random.default_rng(6)
    vector = lambda: [float(x) for x in np.round(rng.normal(size=16), 1)]  # coarse, so that distances tie
    rows = [(i, vector(), int(i % 3) if i % 4 else None) for i in range(400)]
    rows += [(500 + i, rows[i % 5][1], 1) for i in range(60)] + [(3, rows[3][1], 0), (3, rows[3][1], 0), (None, vector(), None)]
    rows += [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 2), (904, [0.0] * 16, 2), (905, [1.0, 2.0], 2), (906, [], 2), (907, [30000.0] * 16, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash")).withColumn("part", F.lit(1)).repartition(5)
    for case in (rows, rows + [(908, [1e12] * 16, 5), (909, [-1e300] * 16, 6)]):
        extra = spark.createDataFrame(case, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash")).repartition(5)
        want, books = plain_codes(case)
        got = quantize.compress(extra).collect()
        top = (1 << 63) - 1
        assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted([(*w[:3], min(w[3], top)) for w in want], key=repr)
        sums = Counter()
        for _, label, _, error in want:
            sums[label] += min(error, top)
        assert all(r["label_error"] == min(sums[r["label"]], top) for r in got)
        assert {r["codebooks_sha256"] for r in got} == {__import__("hashlib").sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()}
    assert quantize.compress(table.where("false")).count() == 0 and quantize.compress(table.where("vec_id >= 900 and vec_id < 904")).count() == 0
    assert [r["code"] for r in quantize.compress(table.where("vec_id in (904, 905)")).collect()].count("00" * 8) >= 1


def test_codes_from_bounds_equal_codes_without():
    """Every round's codes are those of a full scan, and bounds leave most distances unmeasured in the end."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-3000, 3000, size=(20, 32))
    vectors = (centres[rng.integers(0, 20, 3000)] + rng.integers(-200, 200, size=(3000, 32))).astype(np.int64)
    book = vectors[:16].astype(object).reshape(16, 8, 4).transpose(1, 0, 2)
    history, wide = [book], 1 + quantize.GROUPS
    codes, stamps, bounds = np.zeros((3000, 8), np.uint8), np.full((3000, 8, wide), quantize.NEW, np.uint8), np.zeros((3000, 8, wide), np.float32)
    for number in range(7):
        codes, stamps, bounds, measured = quantize.reassign(vectors, codes, stamps, bounds, history)
        full = np.stack([((vectors[:, None, p * 4 : p * 4 + 4] - history[-1][p].astype(np.int64)[None]) ** 2).sum(axis=2) for p in range(8)], axis=1)
        assert (codes == full.argmin(axis=2)).all()
        away = [[np.where(np.arange(16)[None, :] == codes[:, p, None], np.inf, np.sqrt(full[:, p]))[:, g].min(axis=1) for g in np.array_split(np.arange(16), quantize.GROUPS)] for p in range(8)]
        fresh = stamps[:, :, 1:] == number
        assert (bounds[:, :, 1:] <= np.transpose(np.array(away), (2, 0, 1)) + 1e-3)[fresh].all()
        book = history[-1].copy()
        for p, j in np.ndindex(8, 16):
            mine = vectors[codes[:, p] == j, p * 4 : p * 4 + 4]
            if len(mine):
                book[p, j] = [int(x) // len(mine) for x in mine.sum(axis=0)]
        history.append(book)
    assert measured < 0.5 * 3000 * 8 * 16


def test_vector_codes_query(spark):
    assert compare(connect(SF), queries.ORACLES["op12_vector_codes"], queries.op12_vector_codes(spark, SF)) is None


# --- SimHash ----------------------------------------------------------------------------
def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_parts(fps):
    """fingerprint -> a name of its part under links of at most two bits."""
    part = {f: f for f in fps}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    listed = sorted(part)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= 2:
                part[root(a)] = root(b)
    return {f: root(f) for f in part}


def test_simhash_groups(spark, docs, monkeypatch):
    rng = random.Random(2)
    base = [" ".join(f"v{rng.randrange(500)}" for _ in range(rng.choice([4, 40, 400]))) for _ in range(30)]
    rows = list(enumerate(base))
    for i in range(150):
        words = base[i % 30].split()
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "One"), (404, "one TWO"), (404, "one TWO"), (405, "a b c"), (None, base[0]), (406, base[1].upper()), (None, "only here"), (407, "é ü ß" * 3), (408, "y z " * 40_000)]
    table = docs(rows, 5).withColumn("fp", F.lit("clash")).withColumn("key", F.lit(0))
    fps = [plain_fingerprint(t) for _, t in rows]
    parts, least = plain_parts(set(fps)), {}
    for (doc_id, _), fp in zip(rows, fps):
        if doc_id is not None:
            least[parts[fp]] = min(least.get(parts[fp], doc_id), doc_id)
    want = sorted([(d, f"{fp:016x}", least.get(parts[fp])) for (d, _), fp in zip(rows, fps)], key=repr)
    assert sorted(map(tuple, simhash.near_duplicate_groups(table).collect()), key=repr) == want
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert sorted(map(tuple, simhash.near_duplicate_groups(table, limit=2).collect()), key=repr) == want
    assert simhash.near_duplicate_groups(table.where("false")).count() == 0


@pytest.mark.parametrize("limit", [4096, 3])
def test_multi_index_links(spark, limit):
    """Dense balls and random fingerprints: the parts are those of all pairs, with few rows for them."""
    rng = random.Random(limit)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            f = centre
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(4), limit).collect()
    pairs = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in found}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    part = {f: f for f in fps}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in pairs:
        part[root(a)] = root(b)
    want = plain_parts(fps)
    assert len({(root(f), want[f]) for f in fps}) == len({root(f) for f in fps}) == len(set(want.values()))
    assert len(pairs) < 20 * len(fps)
