"""License scans by template-markup matching (operator 5).

A license is a template of words with markup: ``[[...]]`` is an optional region
and ``{{lo..hi}}`` a replaceable one of ``lo`` to ``hi`` arbitrary words.  Each
template compiles to a token automaton over word hashes.  A place in a text is
accepted if the automaton, begun at the template's first two words (always
mandatory), reaches its end: all mandatory wording matches exactly, optional
regions are there or not, replaceable ones hold anything.

Plain phrases (``BASE``) are found beside it by comparing the hashes of
consecutive words.

Nulls and edge cases: a null or empty text has no words, no places and score 0;
a template that is cut off at the end of a text is not accepted; places may
overlap and all count; repeated rows are judged row by row; an empty table gives an
empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm import textbuf as tb

#: Phrases of the contract: words, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# The wording of licenses, in their own order.
_NO_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{1..8}} be "
    "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
    "out of or in connection with the software or the use or other dealings in the software")
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list "
    "of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided "
    "with the distribution")
_BSD_NO_WARRANTY = (
    "this software is provided by {{1..12}} as is and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
    "{{1..12}} be liable for any direct indirect incidental special exemplary or consequential damages including but "
    "not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence "
    "or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage")
#: Whole licenses: label, markup.
FULL = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files [[the software]] to deal in the software without restriction including without "
            "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
            "software and to permit persons to whom the software is furnished to do so subject to the following "
            "conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be "
            "included in all copies or substantial portions of the software " + _NO_WARRANTY),
    ("bsd-2-clause", f"{_BSD_CONDITIONS} {_BSD_NO_WARRANTY}"),
    ("bsd-3-clause", f"{_BSD_CONDITIONS} [[3]] neither the name of {{{{1..12}}}} nor the names of {{{{1..2}}}} contributors "
                     "may be used to endorse or promote products derived from this software without specific prior "
                     f"written permission {_BSD_NO_WARRANTY}"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies "
            "the software is provided as is and {{1..8}} all warranties with regard to this software including all "
            "implied warranties of merchantability and fitness in no event shall {{1..8}} be liable for any special "
            "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
            "profits whether in an action of contract negligence or other tortious action arising out of or in "
            "connection with the use or performance of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify "
                  "publish use compile sell or distribute this software either in source code form or as a compiled "
                  "binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize "
                  "copyright laws the author or authors of this software dedicate any and all copyright interest in the "
                  "software to the public domain we make this dedication for the benefit of the public at large and to "
                  "the detriment of our heirs and successors we intend this dedication to be an overt act of "
                  "relinquishment in perpetuity of all present and future rights to this software under copyright law "
                  + _NO_WARRANTY),
)

#: Templates: label, markup.  A label that ends in ``HEADER`` tells that the text opens as
#: the license does, and no more.
HEADER = "-header"
TEMPLATES = (
    *FULL,
    ("apache-2.0", "licensed under the apache license [[version]] [[2]] [[0]] [[the license]]"),
    ("apache-2.0", "released under [[the terms of]] the apache [[2]] [[0]] license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit-header", "permission is hereby granted free of charge to any person obtaining a copy of this "
                   "software and associated documentation files"),
    ("bsd-header", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under [[the terms of]] [[the]] bsd [[2]] [[3]] [[clause]] license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "gnu general public license [[as published by the free software foundation]] "
                "[[either]] version 3 [[of the license]] [[or at your option any later version]]"),
    ("gpl-2.0", "gnu general public license [[as published by the free software foundation]] "
                "[[either]] version 2 [[of the license]] [[or at your option any later version]]"),
    ("lgpl", "gnu lesser general public license [[version {{1..2}}]]"),
    ("agpl", "gnu affero general public license [[version {{1..2}}]]"),
    ("mpl-2.0", "mozilla public license [[version]] [[v]] 2 0"),
    ("isc-header", "permission to use copy modify and [[or]] distribute this software for any purpose with "
                   "or without fee is hereby granted"),
    ("unlicense-header", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "this work is in the public domain"),
    ("cc0", "cc0 1 0 [[universal]]"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-sa", "cc by sa [[2]] [[3]] [[4]] [[0]]"),
    ("cc-by-nc", "cc by nc [[2]] [[3]] [[4]] [[0]]"),
    ("cc-by-nd", "cc by nd [[2]] [[3]] [[4]] [[0]]"),
    ("cc-by-nc-sa", "cc by nc sa [[2]] [[3]] [[4]] [[0]]"),
    ("cc-by-nc-nd", "cc by nc nd [[2]] [[3]] [[4]] [[0]]"),
    ("cc-by", "creative commons attribution [[{{1..3}}]] license"),
    ("proprietary", "copyright c {{1..2}} {{1..6}} all rights reserved"),
    ("proprietary", "this document is confidential and proprietary"),
)


def _words(text: str) -> list[int]:
    column = tb.Texts(pa.array([text]))
    return [int(h) for h in tb.Words(column, tb.ALNUM).hash]


class TokenAutomaton:
    """Nondeterministic automaton of one template over word hashes.

    State ``i`` moves to ``i + 1`` on its word (``None``: any word), and along
    ``skip`` without reading."""

    def __init__(self, markup: str):
        self.step: list[int | None] = []
        self.skip: dict[int, list[int]] = {}
        opened: list[int] = []
        for piece in re.findall(r"\[\[|\]\]|\{\{\d+\.\.\d+\}\}|[^\s\[\]{}]+", markup):
            here = len(self.step)
            if piece == "[[":
                opened.append(here)
            elif piece == "]]":
                self.skip.setdefault(opened.pop(), []).append(here)
            elif piece.startswith("{{"):
                low, high = map(int, piece[2:-2].split(".."))
                self.step += [None] * high
                for i in range(low, high):
                    self.skip.setdefault(here + i, []).append(here + high)
            else:
                self.step += _words(piece)
        self.end = len(self.step)
        if opened or self.end < 2 or None in self.step[:2] or {0, 1} & set(self.skip):
            raise ValueError(f"a template must close its regions and begin with two mandatory words: {markup}")
        self.head = (self.step[0], self.step[1])

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.skip.get(todo.pop(), ()):
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    def accept(self, words: list[int]) -> int:
        """Number of words in the longest accepted prefix of ``words``; 0 if none."""
        states, longest = self._closed({0}), 0
        for i, word in enumerate(words):
            states = self._closed({s + 1 for s in states if s < self.end and self.step[s] in (None, word)})
            if not states:
                break
            if self.end in states:
                longest = i + 1
        return longest


SCHEMA = ("doc_id long, n_words long, matches array<struct<kind:string,label:string,first:long,"
          "words:long,start:long,end:long>>")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=BASE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, matches)``, one row per row of ``docs``.

    A match has its kind (``phrase``, ``template`` or ``header``), label, first word, number
    of words, and code-point offsets into the original text (end exclusive)."""
    templates, phrases = tuple(templates), tuple(phrases)

    def run(batches: Iterator[pa.RecordBatch]):
        automata = [(label, TokenAutomaton(markup)) for label, markup in templates]
        heads: dict[tuple, list] = {}
        for label, a in automata:
            heads.setdefault(a.head, []).append((label, a))
        longest = max((a.end for _, a in automata), default=0)
        first_words = np.array(sorted({h[0] for h in heads}), np.uint64)
        plain = [(label, np.array(_words(text), np.uint64)) for text, label in phrases]
        for batch in tb.slices(batches):
            texts = tb.Texts(batch.column(1))
            words = tb.Words(texts, tb.ALNUM)
            h, n = words.hash, len(words)
            room = np.repeat(words.off[1:], words.n) - np.arange(n)
            found: list[tuple] = []
            for label, own in plain:
                if n < len(own):
                    continue
                here = room >= len(own)
                for j, w in enumerate(own):
                    here[:n - j] &= h[j:] == w
                found += [(int(i), len(own), "phrase", label) for i in np.flatnonzero(here)]
            for i in np.flatnonzero(np.isin(h, first_words) & (room >= 2)):
                for label, a in heads.get((int(h[i]), int(h[i + 1])), ()):
                    k = a.accept(h[i:i + min(int(room[i]), longest)].tolist())
                    if k:
                        found.append((int(i), k, "header" if label.endswith(HEADER) else "template", label))
            # The opening of a license that is there as a whole says nothing more.
            whole = {f[0] for f in found if f[2] == "template"}
            found = sorted(f for f in found if f[2] != "header" or f[0] not in whole)
            first = np.array([f[0] for f in found], np.int64)
            size = np.array([f[1] for f in found], np.int64)
            doc = np.searchsorted(words.off, first, side="right") - 1
            start, end = first, first
            if len(first):
                base = texts.points[texts.off[doc]]
                start = texts.points[words.start[first]] - base
                end = texts.points[words.end[first + size - 1]] - base
            match = pa.StructArray.from_arrays(
                [pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.string()),
                 pa.array(first - words.off[doc], pa.int64()), pa.array(size), pa.array(start, pa.int64()),
                 pa.array(end, pa.int64())], ["kind", "label", "first", "words", "start", "end"])
            at = np.searchsorted(doc, np.arange(texts.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.n, pa.int64()), pa.ListArray.from_arrays(pa.array(at), match)],
                ["doc_id", "n_words", "matches"])

    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return data.mapInArrow(run, SCHEMA)


def summarise(found: DataFrame) -> DataFrame:
    """Counts, labels and score per document from ``scan_licenses``.

    Every place is evidence that the text states a license, a phrase or the opening of a
    license of weight 0.5 and an accepted template of weight 0.9; the score is one minus the
    product of what each leaves open."""
    base = F.filter("matches", lambda m: m["kind"] == "phrase")
    starts = F.transform("base", lambda m: m["first"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    n_base, n_full = F.size("base"), F.size(F.filter("matches", lambda m: m["kind"] == "template"))
    return found.withColumn("base", base).select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names("base").alias("base_labels"), names("matches").alias("labels"),
        (1 - F.pow(F.lit(0.5), F.size("matches") - n_full) * F.pow(F.lit(0.1), n_full)).alias("score"))
