"""License scan: phrases, and license templates matched by token automata.

A template is written in a small markup: words are mandatory, ``[ ... ]`` is optional, ``<n>`` stands
for one to n words of any kind. Each template is compiled into an automaton over tokens, whose state sets
are made deterministic as texts need them; a text is accepted where all mandatory words stand exactly
and in order, with or without the optional ones. Besides, a few phrases are counted wherever their
words stand consecutively.

The score is 1 for a template met in full, 0.8 for a phrase alone, 0.2 for license wording without
either, else 0.

A template or phrase can only stand in a text that holds its longest mandatory word, so a text is cut into tokens only if
it has one of those words, bounded as the scan bounds words; templates of a caller's own bring their own words.

Rows: a null or empty text has no words, no labels and score 0; repeated rows are judged alike, and where templates of one
label meet twice the label is given once; texts of any length are scanned whole; an empty table gives an empty result; extra
columns are left out.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phrases and labels of the base scan.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_WARRANTY = ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
             "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
             "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software")
_BSD_TERMS = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
              "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
              "[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
              "and or other materials provided with the distribution")
_BSD_WARRANTY = ("this software is provided by <9> as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
                 "and fitness for a particular purpose are disclaimed in no event shall <9> be liable for any direct indirect incidental special exemplary or "
                 "consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
                 "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out "
                 "of the use of this software even if advised of the possibility of such damage")
#: Wording of public licenses and notices; full texts where they are short, else their notices.
TEMPLATES = (
    ("mit", "released under the [terms of the] mit license"),
    ("mit", "licensed under the [terms of the] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
            "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
            "software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
            "permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software " + _WARRANTY),
    ("isc", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
            "notice and this permission notice appear in all copies the software is provided as is and <5> disclaims all warranties with regard to this software "
            "including all implied warranties of merchantability and fitness in no event shall <6> be liable for any special direct indirect or consequential damages "
            "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of "
            "or in connection with the use or performance of this software"),
    ("bsd-2-clause", f"{_BSD_TERMS} {_BSD_WARRANTY}"),
    ("bsd-3-clause", f"{_BSD_TERMS} [3] neither the name of <9> nor the names of its contributors may be used to endorse or promote products derived from this software "
                     f"without specific prior written permission {_BSD_WARRANTY}"),
    ("apache-2.0", "licensed under the [terms of the] apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at <1> www apache org licenses license 2 0 "
                   "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties "
                   "or conditions of any kind either express or implied"),
    ("gpl-3.0", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3"),
    ("gpl-2.0", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2"),
    ("gpl-3.0", "<2> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
                "foundation [either] version 3 of the license [or at your option any later version]"),
    ("gpl-2.0", "<2> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
                "foundation [either] version 2 of the license [or at your option any later version]"),
    ("lgpl-3.0", "licensed under the [terms of the] gnu lesser general public license [either] version 3"),
    ("agpl-3.0", "licensed under the [terms of the] gnu affero general public license [either] version 3"),
    ("cc-by-nc-4.0", "licensed under [a] [the] [creative commons] cc by nc 4 0 [international] [license]"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution non commercial 4 0 international license"),
    ("cc-by-4.0", "licensed under [a] [the] cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under [a] [the] cc by sa 4 0"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "copyright [c] <6> all rights reserved"),
)
HINT = re.compile(rb"licen[cs]|apache|copyright|permi(?:ssion|tted)|redistribut|\bcc\b|mozilla public")
_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_word = np.ones(256, bool)
_word[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_phrases = [(p.encode().split(), label) for p, label in PHRASES]
_parts = re.compile(r"\[|\]|<\d+>|[^\s\[\]<>]+")
DIGEST = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Automaton:
    """All templates at once: nondeterministic positions, made deterministic as tokens come."""

    def __init__(self, templates=TEMPLATES):
        self.steps: list[tuple[bytes | None, int, frozenset | None]] = []  # (word or None for any, next position, -)
        self.skips: dict[int, list[int]] = {}
        self.accepts: dict[int, str] = {}
        self.first: set[int] = set()
        for label, text in templates:
            tokens = _parts.findall(text)
            start = at = self._place()
            self.first.add(start)
            opened = []
            for t in tokens:
                if t == "[":
                    opened.append(at)
                elif t == "]":
                    self.skips.setdefault(opened.pop(), []).append(at)
                elif t[0] == "<":
                    ends = []
                    for _ in range(int(t[1:-1])):
                        at = self._step(at, None)
                        ends.append(at)
                    for e in ends[:-1]:
                        self.skips.setdefault(e, []).append(at)
                else:
                    at = self._step(at, t.encode())
            self.accepts[at] = label
        self.start = self._closed(self.first)
        self.table: dict[tuple, tuple[frozenset, frozenset]] = {}

    def _place(self) -> int:
        self.steps.append((None, -1, None))
        return len(self.steps) - 1

    def _step(self, at: int, word: bytes | None) -> int:
        to = self._place()
        self.steps[at] = (word, to, None)
        return to

    def _closed(self, places) -> frozenset:
        done, todo = set(), list(places)
        while todo:
            p = todo.pop()
            if p not in done:
                done.add(p)
                todo += self.skips.get(p, [])
        return frozenset(done)

    def labels(self, tokens: list[bytes]) -> set[str]:
        state, found, table = self.start, set(), self.table
        for t in tokens:
            got = table.get((state, t))
            if got is None:
                reached = self._closed({to for p in state for word, to, _ in [self.steps[p]] if to >= 0 and (word is None or word == t)})
                got = (reached | self.start, frozenset(self.accepts[p] for p in reached if p in self.accepts))
                if len(table) > 200_000:
                    table.clear()
                table[state, t] = got
            state = got[0]
            if got[1]:
                found |= got[1]
        return found


def anchors(templates=TEMPLATES) -> re.Pattern:
    """Finds, bounded as words are, one of the longest mandatory words of the templates and phrases; everything, if a template has none."""
    found = {max(words, key=len) for words, _ in _phrases}
    for _, text in templates:
        depth, mandatory = 0, []
        for t in _parts.findall(text):
            depth += (t == "[") - (t == "]")
            if not depth and t != "]" and t[0] != "<":
                mandatory.append(t.encode())
        if not mandatory:
            return re.compile(b"")
        found.add(max(mandatory, key=len))
    return re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(map(re.escape, sorted(found))) + rb")(?![0-9a-z\x80-\xff])")


def scanned(text: str | None, automaton: Automaton, gate: re.Pattern) -> tuple:
    raw = (text or "").encode("utf-8", "replace").translate(_lower)
    inside = _word[np.frombuffer(raw, np.uint8)]
    n = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) and inside[0])
    if not gate.search(raw):
        return n, 0, None, None, "", "", 0.2 if HINT.search(raw) else 0.0
    tokens = _words.findall(raw)
    places, base = [], set()
    for words, label in _phrases:
        k, i = len(words), -1
        while True:
            try:
                i = tokens.index(words[0], i + 1)
            except ValueError:
                break
            if tokens[i:i + k] == words:
                places.append(i)
                base.add(label)
    met = automaton.labels(tokens)
    score = 1.0 if met else 0.8 if base else 0.2 if HINT.search(raw) else 0.0
    return (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)), score)


def scan(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, gate = Automaton(templates), anchors(templates)
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for texts in batches:
            out = pd.DataFrame([scanned(t, automaton, gate) for t in texts], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    digest = F.pandas_udf(run, DIGEST)
    return docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("d")).select("doc_id", "d.*")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _regex(template: str) -> str:
    """A template as a regular expression over words that each have a space before and after them."""
    parts = []
    for t in re.findall(r"\[[^\]]*\]|<\d+>|[^\s\[\]<>]+", template):
        if t[0] == "[":
            parts.append("(?:" + "".join(f" {w} " for w in t[1:-1].split()) + ")?")
        elif t[0] == "<":
            parts.append(f"(?: [^ ]+ ){{1,{t[1:-1]}}}")
        else:
            parts.append(f" {t} ")
    return "".join(parts)


def _sql() -> str:
    spaced = lambda p: "".join(f" {w} " for w in p.split())
    hits = ", ".join(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()!r}), lambda i: i - 1)" for p, _ in PHRASES)
    base = ", ".join(f"CASE WHEN contains(s, '{spaced(p)}') THEN '{label}' END" for p, label in PHRASES)
    more = ", ".join(f"CASE WHEN regexp_matches(s, '{_regex(t)}') THEN '{label}' END" for label, t in TEMPLATES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    join = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda x: x IS NOT NULL))), ',')"
    return rf"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
cut AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
seen AS (SELECT doc_id, t, w, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS s FROM cut),
found AS (SELECT doc_id, t, len(w) AS n_words, flatten([{hits}]) AS p, [{base}] AS b, [{more}] AS m FROM seen),
named AS (SELECT doc_id, n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, {join('b')} AS base_labels,
  {join('list_concat(b, m)')} AS labels, {join('m')} AS met,
  regexp_matches(t, 'licen[cs]|apache|copyright|permi(?:ssion|tted)|redistribut|\bcc\b|mozilla public') AS hint FROM found)
SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
  CASE WHEN met <> '' THEN 1.0 WHEN base_labels <> '' THEN 0.8 WHEN hint THEN 0.2 ELSE 0.0 END::DOUBLE AS score FROM named"""


SQL = _sql()
