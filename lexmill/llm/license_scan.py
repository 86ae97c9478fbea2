"""License scans: an Aho-Corasick automaton finds identifier tags and notice
phrases in whole texts, and a shunting-yard parser evaluates the licence
expression behind a tag.

Cases: a null text counts as empty and gives no words, no labels and score 0;
texts of any length are scanned whole; repeated rows give repeated results; an
empty table gives an empty one. Only the id and text columns are read, so that
further columns, whatever their names, cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Phrases, as words, whose places are counted; with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases of common licences, with their labels.
NOTICES = {
    "apache license": "apache-2.0",
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl-2.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "creative-commons",
    "public domain": "public-domain",
    "cc0 1 0": "cc0-1.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
}
TAG = "spdx license identifier"
#: How much a licence forbids, from 0 (nothing) to 1 (all), by the start of its label.
BURDEN = {
    "cc0": 0.05, "public-domain": 0.05, "unlicense": 0.05, "0bsd": 0.1, "mit": 0.1, "bsd": 0.1, "isc": 0.1,
    "apache": 0.15, "cc-by-nc": 0.8, "cc-by-sa": 0.5, "cc-by": 0.2, "creative-commons": 0.4, "mpl": 0.4,
    "lgpl": 0.5, "agpl": 0.9, "gpl": 0.7, "reserved": 1.0,
}
UNKNOWN_BURDEN = 0.6
#: An exception takes this share from what its licence forbids.
EXCEPTION_RELIEF = 0.5

WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
LINE_END = re.compile(rb"[\r\n]")
RANK = {"or": 1, "and": 2, "with": 3}


def burden(label: str) -> float:
    return next((v for k, v in sorted(BURDEN.items(), key=lambda x: -len(x[0])) if label.startswith(k)), UNKNOWN_BURDEN)


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the tokens of the longest well-formed start of a licence
    expression in postfix order, operators in lower case; None if there is none."""
    out: list[str] = []
    held: list[str] = []
    wants_operand = True
    best: tuple[int, list[str]] | None = None
    for found in TOKEN.finditer(expression):
        token = found[0]
        low = token.lower()
        if wants_operand:
            if low == "(":
                held.append(low)
                continue
            if low in RANK or low == ")":
                break
            out.append(token)
            wants_operand = False
        elif low in RANK:
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[low]:
                out.append(held.pop())
            held.append(low)
            wants_operand = True
        elif low == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        else:
            break
        if not wants_operand and "(" not in held:
            best = len(out), held[::-1]
    return best and out[:best[0]] + best[1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """The labels that an expression names and what it forbids: OR lets the
    user choose the lighter side, AND binds to the heavier one, WITH relieves
    its licence."""
    tokens = postfix(expression)
    if tokens is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for token in tokens:
        if token in RANK:
            (right, weight_r), (left, weight_l) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, weight_l * EXCEPTION_RELIEF))
            else:
                stack.append((left | right, (min if token == "or" else max)(weight_l, weight_r)))
        else:
            label = token.lower().rstrip("+.")
            stack.append(({label}, burden(label)))
    return stack[0]


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        found.add_word(f" {phrase} ", (phrase, label))
    found.make_automaton()
    return found


def scan(text: str | None, trie: ahocorasick.Automaton) -> dict:
    """What one text holds."""
    raw = (text or "").encode()
    words = raw.translate(WORD_BYTES).split()
    spaced = f" {b' '.join(words).decode()} "
    hits = [(end - len(phrase) - 1, phrase, label) for end, (phrase, label) in trie.iter(spaced)]
    base = [at for at, phrase, _ in hits if phrase in BASE]
    labels = {label for _, phrase, label in hits if phrase != TAG}
    weight = max((burden(label) for label in labels), default=0.0)
    starts = np.cumsum([0, *(len(w.decode()) + 1 for w in words)]) if hits else np.zeros(1)
    tags = sum(phrase == TAG for _, phrase, _ in hits)
    if tags:
        spans = [m.end() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", raw.lower())]
        for at, phrase, _ in hits:
            if phrase == TAG:
                after = spans[int(np.searchsorted(starts, at)) + 2]
                end = LINE_END.search(raw, after)
                line = raw[after:end.start() if end else len(raw)].decode(errors="ignore")
                if got := evaluate(line):
                    labels |= got[0]
                    weight = max(weight, got[1])
    first, last = (int(np.searchsorted(starts, f(base))) for f in (min, max)) if base else (None, None)
    return {
        "n_words": len(words), "n_base": len(base), "first_word": first, "last_word": last,
        "base_labels": ",".join(sorted({BASE[p] for _, p, _ in hits if p in BASE})), "labels": ",".join(sorted(labels)), "score": float(weight), "n_tags": tags,
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, the counts and places of the base
    phrases, all labels found, and the burden of the heaviest as score."""
    phrases = {**(NOTICES if notices is None else notices), **BASE, TAG: "tag"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = automaton(phrases)
        for batch in batches:
            rows = [scan(t, trie) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[c.split()[0]] for r in rows], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *(c.split()[0] for c in SCHEMA.split(", "))])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(narrow, run, f"id long, {SCHEMA}").withColumnRenamed("id", id_col)
