"""License scans: Aho-Corasick for tags and notice phrases, shunting-yard for licence expressions.

A text is reduced to its words (runs of digits, letters and non-ASCII characters, A-Z lower-cased).
One automaton finds all notice phrases and the identifier tag in one pass over them. Where a tag stands,
the expression behind it is parsed with the shunting-yard method and evaluated: `with` binds a
licence to its exception, `and` asks for all parts, `or` for one of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notice phrases of the base scan and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases.
NOTICES = {
    "mit license": "mit", "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc license": "isc", "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd", "cc0 1 0": "cc0", "public domain": "public-domain", "the unlicense": "unlicense", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: How freely a licence lets texts be used.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0, "cc-by": 0.9,
    "mpl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "agpl": 0.4, "cc-by-nc": 0.3, "cc-by-nd": 0.2, "proprietary": 0.0,
}
UNKNOWN = 0.5

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
_TAGGED = re.compile(r"spdx-license-identifier\s*:\s*([^\n\r*<>\"']+)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+\-]+")
_BINDING = {"or": 1, "and": 2, "with": 3}


def freedom(label: str) -> float:
    """Of the longest known name the label starts with."""
    known = [n for n in FREEDOM if label == n or label.startswith((f"{n}-", f"{n}+"))]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, up to the first word that cannot follow.

    None if the expression is broken: unbalanced brackets or an operator without operands.
    """
    out, waiting, operand_next = [], [], True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _BINDING:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _BINDING[waiting[-1]] >= _BINDING[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            waiting.append(token)
        elif token == ")":
            if operand_next or "(" not in waiting:
                return None
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            if not operand_next:
                break
            out.append(word.strip(".-"))
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[list[str], float] | None:
    """(labels, freedom) of a licence expression; None if it is broken.

    A licence with an exception is labelled `licence-with-exception` and is as free as the licence.
    """
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[list[str], float]] = []
    for item in order:
        if item not in _BINDING:
            stack.append(([item], freedom(item)))
            continue
        if len(stack) < 2:
            return None
        right, left = stack.pop(), stack.pop()
        if item == "with":
            stack.append(([f"{x}-with-{right[0][0]}" for x in left[0]], left[1]))
        else:
            stack.append((left[0] + right[0], (min if item == "and" else max)(left[1], right[1])))
    return stack[0] if len(stack) == 1 else None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label, base in [*((p, v, True) for p, v in BASE.items()), *((p, v, False) for p, v in NOTICES.items()), (TAG, None, False)]:
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, base))
    found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, all labels, score, places) of one text.

    score is the freedom of the least free finding; 0 without any. places lists (word, label).
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    line = b" " + b" ".join(words) + b" "
    line = line.decode("latin-1")
    base, places, tagged = [], [], False
    for end, (size, label, is_base) in machine.iter(line):
        at = line.count(" ", 0, end + 1 - size)
        if label is None:
            tagged = True
            continue
        places.append((at, label))
        if is_base:
            base.append((at, label))
    labels = {label for _, label in places}
    scores = [freedom(label) for label in labels]
    if tagged:
        for match in _TAGGED.finditer(text):
            known = evaluate(match.group(1))
            if known:
                labels.update(known[0])
                scores.append(known[1])
    starts = [at for at, _ in base]
    return (
        len(words), len(base), min(starts) if starts else None, max(starts) if starts else None,
        ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), min(scores, default=0.0), sorted(places),
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts, labels, score and the places of all phrases.

    NULL and empty texts have no words, no labels and score 0. One pass, no shuffle.
    """
    shape = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<word:long,label:string>>"

    @F.pandas_udf(shape)
    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
        for texts in parts:
            out = pd.DataFrame([scan(t, machine) for t in texts], columns=names)
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out["places"] = [[{"word": w, "label": v} for w, v in p] for p in out["places"]]
            yield out

    return docs.select("doc_id", scanned("text").alias("s")).select("doc_id", "s.*")
