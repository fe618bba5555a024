"""License scans by template-markup matching.

A template is license wording with markup: ``[[ ... ]]`` is an optional region,
``{{name:1-3}}`` a replaceable region of that many words, ``(a|b)`` a choice of
words.  Each template is compiled into a token automaton; a text is accepted
where its words match all mandatory wording exactly and in order, with optional
regions present or not and any words in replaceable ones.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Base
labels come from places where a phrase's words stand consecutively; templates
add labels of their own.  ``score`` is 1 for an accepted text, else the largest
share of a template's mandatory words matched from some start, 0 where no
license word occurs at all (none that the given phrases and templates need).

Every word of every whole text is counted (a vectorised pass over the bytes);
only texts with a word that some phrase or template needs go through the
automata, all texts where one needs no word.  Defined cases: a null or empty text has 0 words and no labels;
repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import common as C

# Phrases and labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label -> template.  The wording is that of the public license notices.
TEMPLATES = {
    "gpl-notice": "[[this {{thing:1-3}} is]] (licensed|released|distributed) under [[the terms of]] [[the]] gnu general public license "
                  "[[as published by the free software foundation]] [[either]] [[version {{number:1-2}}]] [[of the license]] "
                  "[[or [[at your option]] any later version]]",
    "apache-notice": "(licensed|released|distributed) under [[the terms of]] the apache license [[version {{number:1-2}}]]",
    "mit-notice": "(licensed|released|distributed) under [[the terms of]] the mit license",
    "cc-by-notice": "(licensed|released|distributed) under [[a]] [[creative commons]] [[the]] cc by (1|2|3|4) (0|5)",
    "cc-by-nc-notice": "(licensed|released|distributed) under [[a]] [[creative commons]] [[the]] cc by nc [[(1|2|3|4) (0|5)]]",
    "cc-by-sa-notice": "(licensed|released|distributed) under [[a]] [[creative commons]] [[the]] cc by sa [[(1|2|3|4) (0|5)]]",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of {{work:1-6}} and associated documentation "
                 "files [[the software]] to deal in the software without restriction including without limitation the rights to use "
                 "copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd-grant": "redistribution and use [[of {{work:1-6}}]] in source and binary forms with or without modification are permitted "
                 "provided that the following conditions are met",
    "gpl-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                 "the free software foundation",
}
#: Parts of license words; a phrase or template with one of them needs it.
_STEMS = (b"licen", b"cc", b"permission", b"redistribut")

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


class Automaton:
    """Word automaton of a template: moves[state] lists (word set or None for any, next state)."""

    def __init__(self, template: str):
        self.moves: list[list[tuple[frozenset | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.progress = [0]
        self.required: list[frozenset] = []             # words of which each accepted text has one
        parts = re.findall(r"\[\[|\]\]|\{\{\w+:\d+-\d+\}\}|\([^)]*\)|[^\s\[\]{}()]+", template)
        opened: list[int] = []
        at = 0
        for part in parts:
            if part == "[[":
                opened.append(at)
                at = self._state(at, skip=True)
                continue
            if part == "]]":
                end = self._state(at, skip=True)
                self.skips[opened.pop()].append(end)
                at = end
                continue
            if part.startswith("{{"):
                low, high = map(int, re.search(r":(\d+)-(\d+)", part).groups())
                ends = [at] if low == 0 else []
                for k in range(high):
                    new = self._state(at)
                    self.moves[at].append((None, new))
                    at = new
                    if k + 1 >= low:
                        ends.append(at)
                end = self._state(at)
                for s in ends:
                    self.skips[s].append(end)
                at = end
                continue
            words = frozenset(part.strip("()").split("|"))
            if not opened:
                self.required.append(words)
            new = self._state(at, add=0 if opened else 1)
            self.moves[at].append((words, new))
            at = new
        self.accept = at
        self.mandatory = self.progress[at]
        first = [w for s in self._closure({0}) for w, _ in self.moves[s]]
        if any(w is None for w in first):
            raise ValueError("a template must begin with a word")
        self.first = frozenset().union(*first)

    def _state(self, like: int, add: int = 0, skip: bool = False) -> int:
        self.moves.append([])
        self.skips.append([])
        self.progress.append(self.progress[like] + add)
        if skip:
            self.skips[like].append(len(self.moves) - 1)
        return len(self.moves) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[str], start: int) -> tuple[int, int]:
        """End of the longest accepted run from ``start`` (-1: none) and mandatory words matched."""
        states, best, reached = self._closure({0}), -1, 0
        for i in range(start, len(words) + 1):
            reached = max(reached, max(self.progress[s] for s in states))
            if self.accept in states:
                best = i
            if i == len(words):
                break
            w = words[i]
            states = self._closure({t for s in states for words_of, t in self.moves[s] if words_of is None or w in words_of})
            if not states:
                break
        return best, reached


_compiled: dict[tuple, dict[str, Automaton]] = {}


def automata(templates: dict[str, str]) -> dict[str, Automaton]:
    key = tuple(templates.items())
    if key not in _compiled:
        _compiled[key] = {label: Automaton(t) for label, t in templates.items()}
    return _compiled[key]


def scan_words(words: list[str], phrases: dict[str, str], templates: dict[str, str]) -> tuple[list, list, float]:
    """Places (label, start, end) of phrases and of templates, and the score."""
    base, found, score = [], [], 0.0
    split = {tuple(p.split()): label for p, label in phrases.items()}
    starts = {}
    for p in split:
        starts.setdefault(p[0], []).append(p)
    machines = automata(templates)
    for i, w in enumerate(words):
        for p in starts.get(w, ()):
            if tuple(words[i:i + len(p)]) == p:
                base.append((split[p], i, i + len(p)))
        for label, m in machines.items():
            if w in m.first:
                end, reached = m.match(words, i)
                if end >= 0:
                    found.append((label, i, end))
                    score = 1.0
                elif m.mandatory:
                    score = max(score, reached / m.mandatory * 0.99)
    return base, found, score


def needed(phrases: dict[str, str], templates: dict[str, str]) -> tuple[bytes, ...]:
    """Strings of which every text with a phrase or an accepted template has one; the empty string where there are none."""
    out: set[bytes] = set()
    for groups in [[{w} for w in p.split()] for p in phrases] + [m.required for m in automata(templates).values()]:
        groups = [[w.encode() for w in g] for g in groups]
        stems = {x for x in _STEMS for g in groups if all(x in w for w in g)}
        out |= stems or set(max(groups, key=lambda g: min(map(len, g)), default=[b""]))
    return tuple(sorted(out))


def _word_counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    inside = _WORD[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < len(raw)]
    start[first] = inside[first]
    total = np.concatenate(([0], np.cumsum(start)))
    return total[off[1:]] - total[off[:-1]]


_DDL = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, matches array<struct<label: string, first: long, end: long>>")


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
                 text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: word and base counts, labels, score, and the places of all template matches."""
    C.prepare(docs.sparkSession)
    parts = needed(phrases, templates)
    match_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            raw, off = C.string_buffers(b.column("text"))
            n_words = _word_counts(raw, off)
            out = [[] for _ in range(7)]
            for i in range(len(off) - 1):
                text = raw[off[i]:off[i + 1]].tobytes()
                low = text.lower()                      # bytes: A-Z only
                base, found, score = [], [], 0.0
                if any(x in low for x in parts):
                    base, found, score = scan_words(_WORDS(low.decode("utf-8", "replace")), phrases, templates)
                at = [s for _, s, _ in base]
                tags = {x for x, _, _ in base}
                for col, v in zip(out, (len(base), min(at, default=None), max(at, default=None), ",".join(sorted(tags)),
                                        ",".join(sorted(tags | {x for x, _, _ in found})), score,
                                        [{"label": x, "first": s, "end": e} for x, s, e in found])):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words.astype(np.int64)), *[pa.array(c, pa.int64()) for c in out[:3]],
                 pa.array(out[3], pa.string()), pa.array(out[4], pa.string()), pa.array(out[5], pa.float64()), pa.array(out[6], match_type)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _DDL)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(C.load(spark, sf_dir, "documents")).drop("matches")
