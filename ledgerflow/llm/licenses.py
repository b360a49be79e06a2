"""License scans by template markup.

A template is license wording with marked regions:

* ``<<beginOptional>> ... <<endOptional>>``: words that may be left out
  (regions may nest);
* ``<<var;name=holder;match=0-40>>``: from 0 to 40 words of any kind in place
  of the region.

All other words are mandatory.  ``Automaton`` compiles templates into one
nondeterministic automaton over words; a text is read by its subset automaton,
built lazily: a state (a set of template positions) and a word give the next
state, worked out once and then looked up.  A template matches where the words
from one place on lead to one of its final positions: mandatory wording exact
and in order, regions as marked.  Of the matches of a template that start at
one word, the longest counts; matches may overlap.

Only words that can begin a template start a match, so a text costs one look
into a small table for most of its words.  Words are lower-cased (A-Z) runs of
digits, ASCII letters and non-ASCII characters, known by a 64-bit hash.  All
starts of a slice of some MB of text advance together, word by word; no
shuffle, and the templates travel with the task (their number is the caller's).
The table of known states is emptied when it holds ``STATES`` of them, which
changes no result.

Defined cases: a null or empty text has no words and no match; very long texts
are read whole; a tie between labels is none, since labels are a set; repeated
rows are rows of their own; an empty table gives none; other columns are kept,
whatever their names.  A template without a mandatory word, with an unclosed
region, or that could begin with any word is an error.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, byte_class, word_slices

STATES = 4096
ANY = -1  # the symbol of a replaceable word
MARK = re.compile(r"<<(.*?)>>", re.S)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Template(NamedTuple):
    label: str
    markup: str
    base: bool = False  # a bare phrase; the others are notices or texts


# The phrases of the contract, and public license notices and texts.
TEMPLATES = [
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "released under <<beginOptional>>the terms of<<endOptional>> the mit license"),
    Template("mit", "licensed under <<beginOptional>>the terms of<<endOptional>> the mit license"),
    Template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<beginOptional>>including the next paragraph
        <<endOptional>> shall be included in all copies or substantial portions of the software"""),
    Template("apache-2.0", """licensed under the apache license version 2 0 <<beginOptional>>the license you may not use
        this <<var;name=object;match=1-3>> except in compliance with the license<<endOptional>>"""),
    Template("gpl-2.0", """licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license
        <<beginOptional>>gpl<<endOptional>> <<beginOptional>>as published by the free software foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> version 2"""),
    Template("gpl-3.0", """licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license
        <<beginOptional>>gpl<<endOptional>> <<beginOptional>>as published by the free software foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> version 3"""),
    Template("gpl-2.0-or-later", """redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 2 of the license or <<beginOptional>>at your option
        <<endOptional>> any later version"""),
    Template("gpl-3.0-or-later", """redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 3 of the license or <<beginOptional>>at your option
        <<endOptional>> any later version"""),
    Template("lgpl-2.1", """gnu lesser general public license <<beginOptional>>lgpl<<endOptional>>
        <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>>
        version 2 1"""),
    Template("agpl-3.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu affero general public license "
                         "<<beginOptional>>as published by the free software foundation<<endOptional>> version 3"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("bsd", """redistribution and use in source and binary forms with or without modification are permitted
        provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code
        must retain the above copyright notice this list of conditions and the following disclaimer"""),
    Template("isc", """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for
        any purpose with or without fee is hereby granted provided that the above copyright notice and this permission
        notice appear in all copies"""),
    Template("zlib", """permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following restrictions"""),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc0-1.0", "to the extent possible under law <<var;name=holder;match=1-40>> has waived all copyright and "
                        "related or neighboring rights to"),
    Template("cc-by-4.0", "licensed under cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    Template("cc-by-nc-4.0", "licensed under <<beginOptional>>the<<endOptional>> cc by nc 4 0 "
                             "<<beginOptional>>license<<endOptional>>"),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
    Template("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0"),
]


class Piece(NamedTuple):
    """A part of a template: a word, ``least`` to ``most`` replaceable words,
    or an optional region's bounds."""
    kind: str
    word: str = ""
    least: int = 0
    most: int = 0


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate({c: c + 32 for c in range(0x41, 0x5B)}))


def parse(markup: str) -> list[Piece]:
    out, depth, place = [], 0, 0
    for m in [*MARK.finditer(markup), None]:
        out += [Piece("word", w) for w in words_of(markup[place: m.start() if m else len(markup)])]
        if m is None:
            break
        place, tag = m.end(), m.group(1).strip()
        if tag == "beginOptional":
            depth += 1
            out.append(Piece("open"))
        elif tag == "endOptional":
            depth -= 1
            if depth < 0:
                raise ValueError(f"a region ends that never began: {markup!r}")
            out.append(Piece("close"))
        else:
            width = re.fullmatch(r"var;.*match=(\d+)-(\d+)", tag, re.S)
            if not width or int(width[1]) > int(width[2]) or not int(width[2]):
                raise ValueError(f"not a region: <<{tag}>>")
            out.append(Piece("var", "", int(width[1]), int(width[2])))
    if depth:
        raise ValueError(f"a region is not closed: {markup!r}")
    return out


def mandatory(markup: str) -> int:
    """Words that every match of the template holds."""
    depth = n = 0
    for p in parse(markup):
        depth += (p.kind == "open") - (p.kind == "close")
        n += p.kind == "word" and not depth
    return n


def weight(t: Template) -> float:
    """The evidence of a match, from 0 to 1: more mandatory words, more."""
    n = mandatory(t.markup)
    return n / (n + 2)


class Automaton:
    """Templates as one automaton over word numbers.  Positions are numbered
    through all templates; ``symbol[p]`` is read at position p on the way to
    p + 1, and ``skip[p]`` are positions reached from p without a word."""

    def __init__(self, templates: list[Template]):
        self.labels = [t.label for t in templates]
        self.base = np.array([t.base for t in templates], dtype=bool)
        self.weights = [weight(t) for t in templates]
        words = sorted({p.word for t in templates for p in parse(t.markup) if p.kind == "word"})
        number = {w: i for i, w in enumerate(words)}
        self.words = len(words)  # the number of every other word
        h = _hashes(words)
        order = np.argsort(h)
        self.vocab, self.number = h[order], order
        self.symbol, self.skip, self.final, starts = [], {}, {}, []
        for k, t in enumerate(templates):
            starts.append(len(self.symbol))
            opened = []
            for p in parse(t.markup):
                here = len(self.symbol)
                if p.kind == "word":
                    self.symbol.append(number[p.word])
                elif p.kind == "open":
                    opened.append(here)
                elif p.kind == "close":
                    self.skip.setdefault(opened.pop(), []).append(here)
                else:
                    for i in range(p.most):
                        if i >= p.least:
                            self.skip.setdefault(here + i, []).append(here + p.most)
                    self.symbol += [ANY] * p.most
            self.final[len(self.symbol)] = k
            self.symbol.append(None)  # nothing is read past the end
            if not mandatory(t.markup):
                raise ValueError(f"no mandatory word: {t.markup!r}")
        self.start = self.closure(starts)
        first = {self.symbol[p] for p in self.start}
        if ANY in first:
            raise ValueError("a template could begin with any word")
        self.begins = np.zeros(self.words + 1, dtype=bool)
        self.begins[list(first)] = True
        self.reset()

    def closure(self, positions) -> frozenset:
        out, todo = set(), list(positions)
        while todo:
            p = todo.pop()
            if p not in out:
                out.add(p)
                todo += self.skip.get(p, ())
        return frozenset(out)

    def reset(self):
        """Forget the known states."""
        self.sets, self.known, self.accepts = [], {}, []
        self.table = np.full((64, self.words + 1), -2, dtype=np.int32)  # -2: not worked out; -1: dead

    def state(self, positions: frozenset) -> int:
        if not positions:
            return -1
        if positions not in self.known:
            self.known[positions] = len(self.sets)
            self.sets.append(positions)
            self.accepts.append(sorted(self.final[p] for p in positions if p in self.final))
            if len(self.sets) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -2)])
        return self.known[positions]

    def step(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The next state of every state and word."""
        if len(self.sets) > STATES:  # begin anew with the states in use
            used, back = np.unique(states, return_inverse=True)
            live = [self.sets[s] for s in used]
            self.reset()
            states = np.array([self.state(x) for x in live], dtype=np.int64)[back]
        out = self.table[states, tokens]
        new = np.flatnonzero(out == -2)
        if len(new):
            keys = np.unique(states[new] * (self.words + 1) + tokens[new])
            for s, t in zip((keys // (self.words + 1)).tolist(), (keys % (self.words + 1)).tolist()):
                to = [p + 1 for p in self.sets[s] if self.symbol[p] is not None and self.symbol[p] in (t, ANY)]
                to = self.state(self.closure(to))  # may enlarge the table
                self.table[s, t] = to
            out[new] = self.table[states[new], tokens[new]]
        return out

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of hashes."""
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, self.number[at], self.words)

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, start, end) of all matches in a slice, by start and template."""
        wanted = np.zeros(1 << 16, dtype=bool)
        wanted[(self.vocab[self.begins[self.number]] & np.uint64(0xFFFF)).astype(np.int64)] = True
        start = np.flatnonzero(wanted[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        start = start[self.begins[self.tokens(w.hash[start])]]
        stop = w.first[np.searchsorted(w.first, start, side="right")] if len(start) else start
        pos, state = start.copy(), np.full(len(start), self.state(self.start), dtype=np.int64)
        found = []
        while len(pos):
            state = self.step(state, self.tokens(w.hash[pos])).astype(np.int64)
            pos = pos + 1
            for s in np.unique(state[state >= 0]).tolist():
                x = np.flatnonzero(state == s) if self.accepts[s] else ()
                for k in self.accepts[s]:
                    found.append((np.full(len(x), k), start[x], pos[x]))
            go = (state >= 0) & (pos < stop)
            start, stop, pos, state = start[go], stop[go], pos[go], state[go]
        if not found:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        k, s, e = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((e, k, s))
        k, s, e = k[order], s[order], e[order]
        longest = np.append((s[1:] != s[:-1]) | (k[1:] != k[:-1]), True)
        return k[longest], s[longest], e[longest]


def _hashes(words: list[str]) -> np.ndarray:
    out = [w.hash for _, _, w in word_slices(pa.array(words, pa.string()), byte_class("alnum"))]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


PLACE = pa.struct([("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
FOUND_DDL = "struct<n_words:long,matches:array<struct<template:int,start:long,end:long>>>"


def matches_column(text: Column, templates: list[Template] = TEMPLATES) -> Column:
    """A column struct(n_words, matches): of each match the number of its
    template and its words (from 0, end exclusive), by start and template."""
    automaton = Automaton(templates)

    @F.arrow_udf(FOUND_DDL)
    def run(texts: pa.Array) -> pa.Array:
        counts, places = [], []
        for a, b, w in word_slices(texts, byte_class("alnum")):
            k, s, e = automaton.matches(w)
            doc = np.searchsorted(w.first, s, side="right") - 1
            ends = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
            counts.append(w.counts)
            places.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                [pa.array(k, pa.int32()), pa.array(s - w.first[doc], pa.int64()),
                 pa.array(e - w.first[doc], pa.int64())], names=["template", "start", "end"])))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(counts) if counts else [], pa.int64()),
             pa.concat_arrays(places) if places else pa.array([], pa.list_(PLACE))], names=["n_words", "matches"])

    return run(text.cast("string"))


def _each(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan(docs: DataFrame, text_col: str = "text", templates: list[Template] = TEMPLATES,
         out: str = "licenses") -> DataFrame:
    """``docs`` with a column ``out``: struct(n_words, matches (label, base,
    start, end), labels, score).  The score is the weight of the strongest
    match, 0 without one."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {out}")
    labels, base, weights = (_each(x) for x in zip(*[(t.label, t.base, weight(t)) for t in templates]))
    found = docs.withColumn(out, matches_column(F.col(text_col), templates))
    m = F.col(out)["matches"]
    return found.withColumn(out, F.struct(
        F.col(out)["n_words"].alias("n_words"),
        F.transform(m, lambda x: F.struct(F.get(labels, x["template"]).alias("label"), F.get(base, x["template"]).alias("base"),
                                          x["start"].alias("start"), x["end"].alias("end"))).alias("matches"),
        F.array_sort(F.array_distinct(F.transform(m, lambda x: F.get(labels, x["template"])))).alias("labels"),
        F.coalesce(F.array_max(F.transform(m, lambda x: F.get(weights, x["template"]))), F.lit(0.0)).alias("score")))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's report of ``docs`` (doc_id, text)."""
    found = scan(docs.select("doc_id", "text")).select(
        "doc_id", "licenses", F.expr("filter(licenses.matches, x -> x.base)").alias("places"))
    return found.select(
        "doc_id", "licenses.n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join("licenses.labels", ",").alias("labels"), "licenses.score")


def pattern(t: Template) -> str:
    """The template as a regular expression over words that are each followed
    by one space (for the SQL of a query, and for tests)."""
    out = ""
    for p in parse(t.markup):
        out += {"word": f"{p.word} ", "open": "(?:", "close": ")?", "var": f"(?:[^ ]+ ){{{p.least},{p.most}}}"}[p.kind]
    return out
