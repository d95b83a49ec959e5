"""BPE encoding and decoding over a table of distinct words.

Encoding. Texts are cut into words by the tokenizer's own pattern, in blocks of about BLOCK_CHARS
characters. A block becomes (a) the positions: for every text the number of each of its words in the
block's list of distinct words, and (b) the distinct words. The words are shuffled by their hash, so
that all occurrences of a word meet and the word is encoded once; the ids go back to their block,
where they are put in place of the word numbers. Texts are never shuffled, only positions and distinct
words are, packed.

Decoding joins ids with the table of pieces; that table is the tokenizer's vocabulary, whose size
is fixed, so the join is on the map side.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import tidy

BLOCK_CHARS = 16_000_000
BUCKET_CHARS = 4_000_000
MEMO_WORDS = 500_000

#: Fixed value: the pre-tokenizer's pattern, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# For texts of ASCII and Latin letters the same classes as the standard module writes them.
_FAST = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_FAST_TEXT = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")
_SLOW = regex.compile(PATTERN)
#: Fixed value: ranges whose characters have kept their classes for long.
_KNOWN_TEXT = re.compile(
    "[\t-\r -~\u00a0-\u0377\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u0481\u05d0-\u05ea\u0620-\u064a\u0904-\u0939"
    "\u2010-\u2027\u2030-\u205e\u20ac\u2190-\u21ff\u2500-\u25ff\u3000-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"
)


class Words:
    """Cuts texts as the tokenizer does: added tokens first, then the pattern.

    Texts with characters whose class may differ between Unicode versions go through the
    tokenizer's own pre-tokenizer.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def of(self, text: str) -> list[str]:
        if self.cut is None or not any(a in text for a in self.added):
            return self._plain(text)
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if _FAST_TEXT.fullmatch(text):
            return _FAST.findall(text)
        if _KNOWN_TEXT.fullmatch(text):
            return _SLOW.findall(text)
        return [text[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, each on its own."""
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _blocks(batches: Iterator[pa.RecordBatch], spec: str, block_chars: int):
    """(block, doc_id, numbers, end of block?, dictionary) text by text.

    A block is a run of texts of one partition; its name holds the partition and its number, so
    that two reads of the same files name it alike.
    """
    words = Words(spec)
    part, number, size, known = 0, 0, 0, {}
    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py() << 32
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            if size and size + len(text) > block_chars:
                yield part + number, None, None, known
                number, size, known = number + 1, 0, {}
            size += len(text) + 1
            found = words.of(text)
            numbers = np.array([known.setdefault(w, len(known)) for w in found], dtype=np.uint32)
            yield part + number, doc_id, numbers, None
    if size:
        yield part + number, None, None, known


def _positions(spec: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for block, doc_id, numbers, known in _blocks(batches, spec, block_chars):
            if known is None:
                rows.append((block, doc_id, _pack(numbers)))
            if len(rows) >= 2000:
                yield _positions_batch(rows)
                rows = []
        yield _positions_batch(rows)

    return run


def _positions_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["block", "doc_id", "places"])


def _parcels(spec: str, block_chars: int, buckets: int):
    """(block, bucket, numbers, words) of the distinct words of each block, by the words' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, known in _blocks(batches, spec, block_chars):
            if known is None:
                continue
            parts: list[tuple[list[int], list[bytes]]] = [([], []) for _ in range(buckets)]
            for word, number in known.items():
                data = word.encode("utf-8", "surrogatepass")
                numbers, datas = parts[zlib.crc32(data) % buckets]
                numbers.append(number)
                datas.append(struct.pack("<I", len(data)) + data)
            full = [(b, p) for b, p in enumerate(parts) if p[0]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * len(full), pa.int64()), pa.array([b for b, _ in full], pa.int32()),
                    pa.array([_pack(np.diff(np.array(p[0], np.uint32), prepend=np.uint32(0))) for _, p in full], pa.binary()),
                    pa.array([zstandard.compress(b"".join(p[1]), 3) for _, p in full], pa.binary()),
                ],
                ["block", "bucket", "numbers", "words"],
            )

    return run


def _split_words(blob: bytes) -> list[str]:
    data, out, at = zstandard.decompress(blob), [], 0
    while at < len(data):
        (size,) = struct.unpack_from("<I", data, at)
        out.append(data[at + 4 : at + 4 + size].decode("utf-8", "surrogatepass"))
        at += 4 + size
    return out


def _encoded(spec: str, memo_words: int):
    """Encode each distinct word of a bucket once; rows of a bucket follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bucket, ids = Words(spec), None, {}
        for batch in batches:
            counts, flats = [], []
            for own, blob in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if own != bucket or len(ids) > memo_words:
                    bucket, ids = own, {}
                here = _split_words(blob)
                new = [w for w in here if w not in ids]
                for word, found in zip(new, words.encode(new)):
                    ids[word] = np.array(found, np.uint32)
                lists = [ids[w] for w in here]
                counts.append(_pack(np.array([len(x) for x in lists], np.uint32)))
                flats.append(_pack(np.concatenate(lists) if lists else np.zeros(0, np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("numbers"), pa.array(counts, pa.binary()), pa.array(flats, pa.binary())], ["block", "numbers", "counts", "ids"])

    return run


def _assembled(batches: Iterator[pa.RecordBatch], finish, fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, parcels before positions: put ids in place of word numbers."""
    block, parcels, tables = None, [], None
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("block", "doc_id", "places", "numbers", "counts", "ids")]
        for own, doc_id, places, numbers, counts, ids in zip(*cols):
            if own != block:
                block, parcels, tables = own, [], None
            if places is None:
                parcels.append((np.cumsum(_unpack(numbers, np.uint32), dtype=np.int64), _unpack(counts, np.uint32), _unpack(ids, np.uint32)))
                continue
            if tables is None:
                tables = _tables(parcels)
                parcels = []
            out.append((doc_id, *finish(_placed(_unpack(places, np.uint32), *tables))))
        cols = list(zip(*out)) if out else [[] for _ in fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def _tables(parcels: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and count of each word's ids, by word number, and all ids."""
    if not parcels:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    numbers = np.concatenate([p[0] for p in parcels])
    counts = np.concatenate([p[1] for p in parcels]).astype(np.int64)
    flat = np.concatenate([p[2] for p in parcels])
    begin = np.cumsum(counts) - counts
    starts, sizes = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    starts[numbers], sizes[numbers] = begin, counts
    return starts, sizes, flat


def _placed(places: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    if not len(places):
        return np.zeros(0, np.uint32)
    count = sizes[places]
    ends = np.cumsum(count)
    index = np.arange(ends[-1]) + np.repeat(starts[places] - (ends - count), count)
    return flat[index]


def read_spec(path: str) -> str:
    """The tokenizer's file, read on the driver; tasks get its content."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(spec: str) -> list[bytes]:
    """The id-to-piece table: the bytes of every id of the vocabulary, added tokens included."""
    content = json.loads(spec)
    letters = byte_letters()
    table = {i: bytes(letters[c] for c in piece) for piece, i in content["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in content["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def _planned(docs: DataFrame, spec: str, block_chars: int, bucket_chars: int) -> DataFrame:
    """Rows of positions and of encoded words, sorted by block with the words first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(max(8, min(4096, -(-chars // bucket_chars))))
    parcels = rows.mapInArrow(tidy(_parcels(spec, block_chars, buckets)), "block long, bucket int, numbers binary, words binary")
    parcels = parcels.repartition("bucket").sortWithinPartitions("bucket", "block")
    encoded = parcels.mapInArrow(tidy(_encoded(spec, MEMO_WORDS)), "block long, numbers binary, counts binary, ids binary")
    placed = rows.mapInArrow(tidy(_positions(spec, block_chars)), "block long, doc_id long, places binary")
    both = encoded.unionByName(placed, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", F.col("places").isNotNull())


def encode(docs: DataFrame, spec: str, block_chars: int = BLOCK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(doc_id, ids array<long>) for every row of `docs` (doc_id, text).

    `docs` must be a stored table (or frozen): it is read twice and must come in the same order. A NULL
    or empty text has no ids; repeated rows and NULL doc_ids give rows of their own; other columns
    play no part. Strings of added tokens in a text become those tokens.
    """
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]

    def run(batches):
        return _assembled(batches, lambda ids: (ids.astype(np.int64),), fields)

    return _planned(docs, spec, block_chars, bucket_chars).mapInArrow(tidy(run), "doc_id long, ids array<long>")


def decode(encoded: DataFrame, spec: str) -> DataFrame:
    """`encoded` with a column `decoded`: the text of `ids`, special tokens kept.

    Bytes that are no UTF-8 become replacement characters; ids beyond the vocabulary and NULL ids
    have no bytes; NULL ids give a NULL text.
    """
    table = encoded.sparkSession.sparkContext.broadcast(pieces(spec))  # the vocabulary: a fixed size

    @F.pandas_udf("string")
    def joined(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = table.value
        for series in lists:
            yield series.map(lambda ids: None if ids is None else b"".join(known[int(i)] for i in ids if i is not None and 0 <= i < len(known)).decode("utf-8", "replace"))

    return encoded.withColumn("decoded", joined("ids"))


def round_trip(docs: DataFrame, spec: str, block_chars: int = BLOCK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode, and digest both results.

    ids are digested as little-endian unsigned 32-bit integers, the decoded text as UTF-8. A NULL or
    empty text has no tokens and the digests of nothing.
    """
    table = docs.sparkSession.sparkContext.broadcast(pieces(spec))  # the vocabulary: a fixed size
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches):
        known = table.value

        def finish(ids: np.ndarray):
            text = b"".join([known[i] for i in ids.tolist()]).decode("utf-8", "replace")
            return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

        return _assembled(batches, finish, fields)

    return _planned(docs, spec, block_chars, bucket_chars).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
