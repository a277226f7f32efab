"""Licence scan: templates with markup are compiled to token automata that accept texts whose mandatory wording matches.

Markup of a template, in the manner of public licence lists: ``[[ ... ]]`` is an optional region (may be nested), and
``<<name:n>>`` is a replaceable region of at most ``n`` words, none included. All else are mandatory words, compared as
lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, so case, punctuation and line breaks don't matter.

All templates share one automaton. Its states are numbers of places in templates; running it means holding the set of
places reached so far, and sets met before are looked up, so a text costs a lookup per word where some template could
begin or go on, and next to nothing elsewhere. One pass over whole texts, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.arrow import map_batches
from kinweave.llm.words import Texts, alnum_bytes, chunks, find_words, lowered, span_hashes, texts_of


class Template(NamedTuple):
    label: str
    text: str
    #: Base phrases are counted place by place.
    base: bool = False
    #: The beginning of a longer wording; it tells a label of its own and adds nothing to a score.
    opening: bool = False


#: Fixed values of the contract: phrases and their labels.
BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
# The public wording of licences and notices, with what their users may leave out or replace.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files [[the <<alias:2>>]] to deal in the software without restriction",
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
    "the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies "
    "or substantial portions of the software the software is provided as is without warranty of any kind express or "
    "implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement in no event shall <<holders:10>> be liable for any claim damages or other liability whether in an action "
    "of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in "
    "the software",
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met",
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and "
    "the following disclaimer in the documentation and or other materials provided with the distribution",
    "[[3]] neither the name of <<holder:10>> nor the names of [[its]] [[their]] contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission",
    "this software is provided by <<holders:10>> as is and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
    "<<holders:10>> be liable for any direct indirect incidental special exemplary or consequential damages including but "
    "not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
)
_ISC = (
    "permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted",
    "provided that the above copyright notice and this permission notice appear in all copies the software is provided as "
    "is and <<author:10>> disclaims all warranties with regard to this software including all implied warranties of "
    "merchantability and fitness in no event shall <<author:10>> be liable for any special direct indirect or consequential "
    "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
    "negligence or other tortious action arising out of or in connection with the use or performance of this software",
)
_APACHE_NOTICE = (
    "licensed under the apache license version 2 0 [[the license]] you may not use this <<work:1>> except in compliance with "
    "the license you may obtain a copy of the license at [[http]] [[https]] [[www]] apache org licenses license 2 0 [[txt]] "
    "[[html]] unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license "
    "for the specific language governing permissions and limitations under the license"
)
_GPL = (
    "this <<work:1>> is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "as published by the free software foundation either version {} of the license or at your option any later version "
    "this <<work:1>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
    "of merchantability or fitness for a particular purpose see the gnu general public license for more details",
)
#: Whole wordings, their openings under labels of their own, and notices that name a licence.
TEMPLATES = (
    *BASE,
    Template("mit", " ".join(_MIT)),
    Template("mit-opening", _MIT[0], opening=True),
    Template("mit", "[[this work is]] [[released]] [[licensed]] under [[the terms of]] the mit license"),
    Template("bsd-2-clause", " ".join([_BSD[0], _BSD[1], _BSD[3]])),
    Template("bsd-3-clause", " ".join(_BSD)),
    Template("bsd-opening", _BSD[0], opening=True),
    Template("isc", " ".join(_ISC)),
    Template("isc-opening", _ISC[0], opening=True),
    Template("apache-2.0", "licensed under the apache license version 2 0 [[the license]]"),
    Template("apache-2.0-notice", _APACHE_NOTICE),
    Template("gpl-3.0", "[[this work is]] licensed under the gnu general public license version 3 [[or [[at your option]] any later version]]"),
    Template("gpl-2.0", "[[this work is]] licensed under the gnu general public license version 2 [[or [[at your option]] any later version]]"),
    Template("gpl-2.0-notice", " ".join(_GPL).format(2)),
    Template("gpl-3.0-notice", " ".join(_GPL).format(3)),
    Template("gpl-opening", _GPL[0], opening=True),
    Template("lgpl", "gnu lesser general public license"),
    Template("cc-by-nc-4.0", "licensed under [[a]] cc by nc 4 0 [[license]]"),
    Template("cc-by-nc-4.0", "licensed under [[a]] creative commons attribution noncommercial 4 0 [[international]] [[license]]"),
    Template("cc-by-4.0", "licensed under [[a]] cc by 4 0 [[license]]"),
    Template("cc-by-4.0", "licensed under [[a]] creative commons attribution 4 0 [[international]] [[license]]"),
    Template("unlicense-opening", "this is free and unencumbered software released into the public domain", opening=True),
    Template("all-rights-reserved", "copyright <<year:4>> <<holder:6>> all rights reserved", opening=True),
)

_MARKUP = re.compile(r"(\[\[)|(\]\])|<<[^:>]*:(\d+)>>|([a-z0-9\x80-\U0010FFFF]+)")
_ANY = None


class Automaton:
    """All templates as one automaton. A place is a state; from it lead steps by a word, by any word, and empty ones.

    ``done[place]`` is the number of mandatory words passed on the way there, ``whole[t]`` those of template ``t``.
    """

    def __init__(self, templates: Sequence[Template]):
        self.templates = list(templates)
        self.step: list[list[tuple[str | None, int]]] = []
        self.empty: list[list[int]] = []
        self.done: list[int] = []
        self.owner: list[int] = []
        self.starts, self.ends, self.whole = [], [], []
        for number, template in enumerate(self.templates):
            self._compile(number, template.text.lower())
        self.end_of = {e: i for i, e in enumerate(self.ends)}
        self._closed: dict[int, frozenset[int]] = {}
        self._next: dict[tuple[frozenset[int], str], frozenset[int]] = {}
        self.start = frozenset().union(*(self._closure(s) for s in self.starts))
        if any(e in self.start for e in self.ends):
            raise ValueError("a template needs a mandatory word")
        #: Words with which some template can begin; None if one begins with a replaceable region.
        self.first = {w for p in self.start for w, _ in self.step[p]}

    def _new(self, owner: int, done: int) -> int:
        self.step.append([])
        self.empty.append([])
        self.done.append(done)
        self.owner.append(owner)
        return len(self.step) - 1

    def _compile(self, owner: int, text: str) -> None:
        at, depth, done = self._new(owner, 0), [], 0
        self.starts.append(at)
        for mark in _MARKUP.finditer(text):
            if mark[1]:
                depth.append(at)
                at, before = self._new(owner, done), at
                self.empty[before].append(at)
            elif mark[2]:
                self.empty[depth[-1]].append(at)
                depth.pop()
            elif mark[3]:
                last = self._new(owner, done)
                self.empty[at].append(last)
                for _ in range(int(mark[3])):
                    after = self._new(owner, done)
                    self.step[at].append((_ANY, after))
                    self.empty[after].append(last)
                    at = after
                at = last
            else:
                done += not depth
                after = self._new(owner, done)
                self.step[at].append((mark[4], after))
                at = after
        if depth:
            raise ValueError(f"an optional region stays open: {text}")
        self.ends.append(at)
        self.whole.append(done)

    def _closure(self, place: int) -> frozenset[int]:
        if place not in self._closed:
            seen, todo = {place}, [place]
            while todo:
                for p in self.empty[todo.pop()]:
                    if p not in seen:
                        seen.add(p)
                        todo.append(p)
            self._closed[place] = frozenset(seen)
        return self._closed[place]

    def follow(self, places: frozenset[int], word: str) -> frozenset[int]:
        key = (places, word)
        if key not in self._next:
            out: set[int] = set()
            for p in places:
                for want, after in self.step[p]:
                    if want is _ANY or want == word:
                        out |= self._closure(after)
            if len(self._next) > 200_000:  # only a memory of results
                self._next.clear()
            self._next[key] = frozenset(out)
        return self._next[key]

    def run(self, words: Sequence[str], start: int) -> tuple[dict[int, int], float]:
        """Begin at one word: the templates accepted, with the first end at which each is, and the largest share of a
        template's mandatory words that was met."""
        accepted: dict[int, int] = {}
        places, share = self.start, 0.0
        for at in range(start, len(words)):
            places = self.follow(places, words[at])
            if not places:
                break
            share = max(share, max((self.done[p] / self.whole[o] for p in places if not self.templates[o := self.owner[p]].opening), default=0.0))
            for p in places:
                if p in self.end_of:
                    accepted.setdefault(self.end_of[p], at)
        return accepted, share


class Found(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    matches: list[dict]


_KIND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


class _Scanner:
    def __init__(self, templates: Sequence[Template]):
        self.automaton = Automaton(templates)
        self.own = self.automaton.templates
        first = sorted(w for w in self.automaton.first if w is not None)
        self.anywhere = None in self.automaton.first
        raw = [w.encode() for w in first]
        ends = np.cumsum([len(w) for w in raw])
        self.first = np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))

    def columns(self, texts: Texts) -> list[list]:
        low = Texts(lowered(texts.data), texts.offsets)
        words = find_words(low, alnum_bytes())
        hashes = span_hashes(low.data, words.starts, words.ends)
        place = np.minimum(np.searchsorted(self.first, hashes), max(len(self.first) - 1, 0))
        begins = np.ones(len(hashes), bool) if self.anywhere else self.first[place] == hashes if len(self.first) else np.zeros(len(hashes), bool)
        at = np.flatnonzero(begins)
        bounds = np.searchsorted(at, words.first)
        rows = []
        for i, n in enumerate(words.counts.tolist()):
            some = at[bounds[i] : bounds[i + 1]]
            rows.append(self.of_text(low.data, words, i, n, some) if len(some) else Found(n, 0, None, None, "", "", 0.0, []))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in _KIND]

    def of_text(self, data: np.ndarray, words, i: int, n: int, begins: np.ndarray) -> Found:
        first = int(words.first[i])
        spans = list(zip(words.starts[first : first + n].tolist(), words.ends[first : first + n].tolist(), strict=True))
        raw, base = data[spans[0][0] : spans[-1][1]].tobytes(), spans[0][0]
        text = _Lazy(raw, base, spans)
        places, labels, base_labels, matches, score = [], set(), set(), [], 0.0
        for start in (begins - first).tolist():
            accepted, share = self.automaton.run(text, start)
            whole = any(not self.own[number].opening for number in accepted)
            score = max(score, 1.0 if whole else share)
            for number, end in accepted.items():
                template = self.own[number]
                labels.add(template.label)
                matches.append({"label": template.label, "start": start, "end": end})
                if template.base:
                    places.append(start)
                    base_labels.add(template.label)
        ends = (min(places), max(places)) if places else (None, None)
        return Found(n, len(places), *ends, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, matches)


class _Lazy:
    """Words of a text, made into strings when they are asked for."""

    def __init__(self, raw: bytes, base: int, spans: list[tuple[int, int]]):
        self.raw, self.base, self.spans = raw, base, spans

    def __len__(self) -> int:
        return len(self.spans)

    def __getitem__(self, i: int) -> str:
        a, b = self.spans[i]
        return self.raw[a - self.base : b - self.base].decode("utf-8", "replace")


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, what was found, and ``matches`` (label, first and last word) of every row of ``docs``.

    ``n_base`` counts the places of base templates, ``first_word`` and ``last_word`` are their smallest and largest start
    (null without any), ``base_labels`` and ``labels`` the distinct labels of base and of all templates, sorted and
    joined by commas (empty without any). ``score`` is 1 if a template that is no opening is accepted, else the largest
    share of such a template's mandatory words met in a row from its beginning. Words after a whole wording are no part of
    it and change nothing; ``matches`` tells where it ends. A null text is empty; a text without words has none of
    it. Repeated rows are scanned each. Matches may overlap; of one template and start the shortest is told.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    templates = list(templates)

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        scanner = _Scanner(templates)
        for first, part in chunks(texts_of(batch.column(1))):
            yield [batch.column(0).slice(first, len(part.offsets) - 1), *scanner.columns(part)]

    return map_batches(rows, of_batch, T.StructType([rows.schema["doc_id"], *_KIND.fields]))
