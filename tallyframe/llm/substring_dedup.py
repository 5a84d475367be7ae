"""Substring dedup over words, by suffix automata and matching statistics."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import cut_repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SHARD_WORDS = 60_000


class Automaton:
    """The suffix automaton of several sequences; first: the smallest document in which a state's strings occur."""

    def __init__(self):
        self.step, self.link, self.length, self.first = [{}], [-1], [0], [None]

    def _state(self, length: int, step: dict, link: int, first) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state of the strings of q that are one longer than p's; takes over the steps to q from p and its suffixes."""
        step, link, length = self.step, self.link, self.length
        if length[p] + 1 == length[q]:
            return q
        clone = self._state(length[p] + 1, dict(step[q]), link[q], None)
        link[q] = clone
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return clone

    def add(self, sequence, document) -> None:
        step, link, length, first = self.step, self.link, self.length, self.first
        last = 0
        for c in sequence:
            q = step[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                new = self._state(length[last] + 1, {}, 0, None)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, c, step[p][c])
                last = new
            if first[last] is None or document < first[last]:
                first[last] = document

    def close(self) -> None:
        """Hands the smallest document on to the suffixes of each state, longest states first."""
        first, link = self.first, self.link
        for v in np.argsort(-np.array(self.length), kind="stable").tolist():
            u = link[v]
            if u > 0 and first[v] is not None and (first[u] is None or first[v] < first[u]):
                first[u] = first[v]

    def statistics(self, sequence, size: int):
        """Of each place from the size-th on: the smallest document with the `size` symbols that end there (None: no document has them).

        The matching statistic is the longest suffix at a place that the automaton has; it is followed down to the state that holds
        the suffix of `size` symbols, as longer ones aren't needed.
        """
        step, link, length, first = self.step, self.link, self.length, self.first
        v = matched = 0
        for i, c in enumerate(sequence):
            while v and c not in step[v]:
                v = link[v]
                matched = length[v]
            if c in step[v]:
                v = step[v][c]
                matched += 1
            while v and length[link[v]] >= size:
                v = link[v]
                matched = length[v]
            if i >= size - 1:
                yield first[v] if matched >= size else None


def earliest_documents(contents: list, size: int):
    """Kernel of repeats: an automaton for each shard of some SHARD_WORDS words (an anchor is never divided), past which its passages stream.

    A content that is the only one of its anchor has nothing to be matched with: its windows stand in its own documents alone.
    """
    shard, held = [], 0
    for i, x in enumerate(contents):
        words = x[1].split()
        starts = not i or x[0] != contents[i - 1][0]
        if held > SHARD_WORDS and starts:
            yield from _of_shard(shard, size)
            shard, held = [], 0
        alone = starts and (i + 1 == len(contents) or contents[i + 1][0] != x[0])
        shard.append((words, x[2], alone))
        held += 0 if alone else len(words)
    yield from _of_shard(shard, size)


def _of_shard(shard: list, size: int):
    automaton, number = Automaton(), {}
    rows = [(None if alone else [number.setdefault(w, len(number)) for w in words], len(words), document) for words, document, alone in shard]
    for words, _, document in rows:
        if words is not None:
            automaton.add(words, document)
    automaton.close()
    for words, n, document in rows:
        yield np.full(n - size + 1, document) if words is None else np.array(list(automaton.statistics(words, size)), np.int64)


def _kept(text: str, spans: np.ndarray) -> tuple[list[str], int]:
    words = WORDS.findall(text)
    out, at = [], 0
    for a, b in spans.tolist():
        out += words[at:a]
        at = b
    return out + words[at:], len(words)


def dedup_words(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, text (kept words joined by a space) of each document.

    Removes words covered by a window of `size` words that also starts in a document with a smaller doc_id; see repeats. Null or
    empty text: no words. Null doc_id: the largest. Rows with equal doc_id are one document, none earlier than another; each has a
    row, and repeated rows come out alike. An empty table gives no rows. Clashing or extra columns are not read.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def row(values, text, spans):
        kept, n = _kept(text, spans)
        left = " ".join(kept)
        return values[0], n, n - len(kept), hashlib.sha256(left.encode()).hexdigest(), left

    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return cut_repeats(source, ["doc_id"], "words", size, 5, False, earliest_documents, row, out, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")


def dedup_documents(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, text, lang, source, n_chars of documents with the repeated passages cut out of their texts; others stay as they are.

    Documents left without a word go; null and empty texts too. Nulls, repeated rows and an empty table as in dedup_words.
    """
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])

    def row(values, text, spans):
        if len(spans):
            text = " ".join(_kept(text, spans)[0])
        return values[0], text, values[1], values[2], len(text)

    source = docs.selectExpr("cast(doc_id as long) doc_id", "text", "lang", "source")
    left = cut_repeats(source, ["doc_id", "lang", "source"], "words", size, 5, False, earliest_documents, row, out, "doc_id long, text string, lang string, source string, n_chars long")
    return left.where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
