"""License scans: exact phrases, and short notices with a bounded number of edits."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, ids_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices searched with edits, one for each 10 characters. Words in brackets tell a licence from its likes and take no edit.
NOTICES = {
    "under the [mit] license": "mit",
    "under the [bsd] license": "bsd",
    "under the [isc] license": "isc",
    "under the [gpl] license": "gpl",
    "under the [mpl] license": "mpl",
    "under the [apache] license": "apache",
    "[apache] license version [2]": "apache-2",
    "[gnu general] public license": "gpl",
    "[gnu lesser] general public license": "lgpl",
    "[gnu affero] general public license": "agpl",
    "[mozilla] public license": "mpl",
    "[eclipse] public license": "epl",
    "[boost] software license": "bsl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution [noncommercial]": "cc-by-nc",
    "creative commons attribution [sharealike]": "cc-by-sa",
}


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces with their offsets: with at most that many edits, one of them stands unchanged."""
    n = len(notice)
    cuts = [n * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern(notice: str, edits: int) -> regex.Pattern:
    """Best match of the notice between word bounds: edits in the parts outside brackets only; their sum is checked on the match."""
    parts = re.split(r"[\[\]]", notice)
    body = "".join(regex.escape(p) if i % 2 else f"(?:{regex.escape(p)}){{e<={edits}}}" if p else "" for i, p in enumerate(parts))
    return regex.compile(f"(?b)(?<![^ ])(?:{body})(?![^ ])")


@lru_cache(4)
def _searcher(notices: tuple[tuple[str, str], ...], per_edit: int):
    seeds, rules = {}, []
    for i, (notice, label) in enumerate(notices):
        plain = re.sub(r"[\[\]]", "", notice)
        edits = len(plain) // per_edit
        rules.append((pattern(notice, edits), edits, len(plain), label))
        for at, piece in pieces(plain, edits):
            seeds.setdefault(piece, []).append((i, at))
    machine = ahocorasick.Automaton()
    for piece, where in seeds.items():
        machine.add_word(piece, (len(piece), where))
    machine.make_automaton()
    return machine, rules


def fuzzy(text: str, notices: tuple[tuple[str, str], ...], per_edit: int = 10) -> list[tuple[int, int, int, str]]:
    """start, end, edits, label of each notice found in a text of words joined by one space.

    A seed at a place puts the notice within `edits` of one offset; such stretches that overlap are joined, and the bounded-error
    pattern runs over each stretch only. Places side by side stay apart.
    """
    machine, rules = _searcher(notices, per_edit)
    stretches: dict[int, list[list[int]]] = {}
    for end, (n, where) in machine.iter(text):
        for i, at in where:
            _, edits, size, _ = rules[i]
            a = max(0, end + 1 - n - at - edits)
            b = min(len(text), end + 1 - n - at + size + edits)
            have = stretches.setdefault(i, [])
            if have and a <= have[-1][1] and a >= have[-1][0]:
                have[-1][1] = max(b, have[-1][1])
            else:
                have.append([a, b])
    out = []
    for i, have in stretches.items():
        rule, edits, _, label = rules[i]
        for a, b in have:
            gaps = [(a, b)]  # the best match of a stretch comes first, so both sides of it are searched again
            while gaps:
                a, b = gaps.pop()
                m = rule.search(text, a, b) if a < b else None
                if m and m.end() > m.start():
                    if sum(m.fuzzy_counts) <= edits and (m.end() == len(text) or text[m.end()] == " ") and (m.start() == 0 or text[m.start() - 1] == " "):
                        out.append((m.start(), m.end(), sum(m.fuzzy_counts), label))
                        gaps += [(a, m.start()), (m.end(), b)]
                    else:
                        gaps.append((m.start() + 1, b))
                        gaps.append((a, m.end() - 1))
    return sorted(set(out))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, per_edit: int = 10) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every document.

    spans: (start, end, edits, label) of the fuzzy finds, in characters of the text. Finds lie between word bounds; words of a notice
    in brackets stand unchanged. score: 1 with a base phrase, else 1 - edits / length of the best find, else 0. Null or empty text: no
    words, no labels, score 0. Rows of equal doc_id and repeated rows each get a row; doc_id may be null; an empty table gives no
    rows; extra columns are not read. Texts are whole; no shuffle.
    """
    listed = tuple((notices or NOTICES).items())
    phrases = [(regex.compile(f"(?<![^ ]){p}(?![^ ])"), label) for p, label in BASE.items()]
    span = [("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("label", pa.string())]
    longs = [(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    out = pa.schema([*longs, ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct(span)))])

    def run(frames):
        for doc_ids, texts in ids_texts(frames):
            rows = []
            for doc_id, t in zip(doc_ids, texts):
                lower = t.translate(LOWER)
                words = WORD.findall(lower)
                text = " ".join(words)
                base = [(m.start(), label) for p, label in phrases for m in p.finditer(text, overlapped=True)]
                finds = fuzzy(text, listed, per_edit)
                at = [text.count(" ", 0, a) for a in (min(base)[0], max(base)[0])] if base else [None, None]
                exact = {x for _, x in base}
                score = 1.0 if base else max((1 - e / max(1, b - a) for a, b, e, _ in finds), default=0.0)
                rows.append((doc_id, len(words), len(base), *at, ",".join(sorted(exact)), ",".join(sorted(exact | {f[3] for f in finds})), score, in_text(lower, words, finds)))
            yield arrow_batch(out, *zip(*rows))

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: int, end: int, edits: int, label: string>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def in_text(text: str, words: list[str], finds: list[tuple]) -> list[dict]:
    """Finds in the words joined by a space, with their places in the text itself."""
    if not finds:
        return []
    starts = [m.start() for m in WORD.finditer(text)]
    joined = list(accumulate((len(w) + 1 for w in words), initial=0))

    def place(x: int) -> int:
        i = bisect_right(joined, x) - 1
        return starts[i] + x - joined[i]

    return [{"start": place(a), "end": place(b - 1) + 1, "edits": e, "label": label} for a, b, e, label in finds]
