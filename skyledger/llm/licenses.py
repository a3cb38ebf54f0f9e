"""License scans: template markup compiled to token automata.

A template is licence wording with markup: ``[[ ... ]]`` encloses a region that may be left
out, ``{{n}}`` stands for up to n words of any kind (a name, a year), ``<< a | b >>`` for
one of the wordings a and b. Everything else is mandatory and must stand word for word. A template compiles to an automaton over words
(states with literal, wildcard and empty moves); it accepts where its mandatory
wording matches exactly. Automata start only where a template's opening words stand, which
are found by byte search on the normalised text.

Base phrases are counted beside that: places where a phrase's words stand consecutively.

Defined results: null is an empty text; an empty text has no words, places or labels, null
first and last words and score 0; equal rows give equal results, a row for each; places of one
phrase may overlap and all count; a very long text costs in proportion to its length; an empty
table gives no rows. Only doc_id, of any type, and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame

#: Base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_MARK = "[[ <<1|2|3|4|a|b|c|d|i|ii|iii|iv>> ]]"
_AS_IS = "<<as is|“as is”>>"
_VERSION = "version <<1|2|2 0|2 1|3|3 0>>"


def _gnu_header(kind: str) -> str:
    """The FSF's notice for source files; kind is empty, lesser or affero. The grant is mandatory whole."""
    name, fsf = f"gnu {kind} general public license", "as published by the free software foundation"
    return f"""[[this {{{{3}}}}]] is free software you can redistribute it and or modify it under the terms of
        << the {name} {fsf} [[either]] {_VERSION} of the license | the {name} {_VERSION} [[only]] {fsf} | {_VERSION} of the {name} {fsf} >> [[or at your option any later version]]
        [[ [[this]] {{{{3}}}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the {name} for more details [[you should have received a copy of the {name} along with {{{{4}}}} if not]] ]]"""


#: Templates of the common notices and of whole licence texts (-text), by label.
TEMPLATES = {
    "mit-notice": "[[this {{4}} is]] <<released|licensed|distributed|available>> under the [[terms of the]] mit license",
    "mit-text": f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the <<software|“software”>>
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
        the software is provided {_AS_IS} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose
        and <<noninfringement|non infringement>> in no event shall {{{{10}}}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
    "apache-notice": "licensed under the apache license <<version 2 0|2 0|version 2|v2>> [[the <<license|“license”>>]]",
    "apache-header": f"""licensed under the apache license version 2 0 [[the <<license|“license”>>]] you may not use this file except in compliance with the license
        you may obtain a copy of the license at {{{{8}}}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an {_AS_IS} basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
    "gpl-notice": "this {{3}} is licensed under the [[terms of the]] gnu [[lesser]] general public license [[as published by the free software foundation]] [[either]] version {{1}} [[of the license]] [[or at your option any later version]]",
    "gpl-header": _gnu_header(""),
    "lgpl-header": _gnu_header("<<lesser|library>>"),
    "agpl-header": _gnu_header("affero"),
    "cc-by-notice": "licensed under [[a]] [[the]] cc by [[nc]] [[sa]] [[nd]] {{2}} 0",
    "cc-by-long": "licensed under [[a]] [[the]] creative commons attribution [[noncommercial]] [[sharealike]] [[noderivatives]] {{2}} [[international]] license",
    "bsd-text": f"""redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        {_MARK} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        {_MARK} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        [[ {_MARK} all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {{{{12}}}} ]]
        [[ {_MARK} << neither the name of {{{{12}}}} nor the names of [[<<its|any|the|their>>]] contributors may be used to endorse or promote products derived from this software without specific prior written permission
        | the name of {{{{6}}}} may not be used to endorse or promote products derived from this software without specific prior written permission >> ]]
        this software is provided by {{{{12}}}} {_AS_IS} and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
        in no event shall {{{{12}}}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
        arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "isc-text": f"""permission to use copy modify <<and or|and>> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies
        the software is provided {_AS_IS} and {{{{8}}}} <<disclaims|disclaim>> all warranties with regard to this software including all implied warranties of merchantability and fitness
        in no event shall {{{{8}}}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved-notice": "copyright [[c]] {{8}} all rights reserved",
}

_MARKUP = re.compile(r"\[\[|\]\]|<<|>>|\||\{\{\d+\}\}|[^\s\[\]{}<>|]+")

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: str | None) -> bytes:
    """Lower-case words (digits, letters, all beyond ASCII) with a space before and after each."""
    return b" " + b" ".join((text or "").encode().translate(_KEEP).split()) + b" "


@dataclass
class Automaton:
    """moves[state] = (literal word -> state, states by any word, states by no word)."""

    words: list[dict[bytes, int]] = field(default_factory=list)
    any: list[list[int]] = field(default_factory=list)
    none: list[list[int]] = field(default_factory=list)
    final: int = 0
    openings: list[bytes] = field(default_factory=list)
    mandatory: int = 0

    def state(self) -> int:
        self.words.append({})
        self.any.append([])
        self.none.append([])
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.none[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, tokens: list[bytes]) -> int:
        """Words that the longest accepted beginning of tokens has; -1 if none is accepted."""
        now, best = self.closure({0}), -1
        for i in range(len(tokens) + 1):
            if self.final in now:
                best = i
            if i == len(tokens):
                break
            after: set[int] = set()
            for s in now:
                after.update(self.any[s])
                if (t := self.words[s].get(tokens[i])) is not None:
                    after.add(t)
            if not after:
                break
            now = self.closure(after)
        return best

    @property
    def longest(self) -> int:
        return len(self.words)


def compile_template(markup: str) -> Automaton:
    out = Automaton()
    at = out.state()
    opened: list[int] = []
    choices: list[tuple[int, list[int]]] = []
    for token in _MARKUP.findall(markup):
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            out.none[opened.pop()].append(at)
            joint = out.state()
            out.none[at].append(joint)
            at = joint
        elif token == "<<":
            # each wording starts at a state of its own: words of the same state would share their moves
            choices.append((at, []))
            out.none[at].append(first := out.state())
            at = first
        elif token in ("|", ">>"):
            start, ends = choices[-1]
            ends.append(at)
            at = out.state()
            if token == "|":
                out.none[start].append(at)
            else:
                choices.pop()
                for end in ends:
                    out.none[end].append(at)
        elif token.startswith("{{"):
            first = at
            steps = [first]
            for _ in range(int(token[2:-2])):
                after = out.state()
                out.any[at].append(after)
                steps.append(at := after)
            end = out.state()
            for s in steps:
                out.none[s].append(end)
            at = end
        else:
            after = out.state()
            out.words[at][token.encode()] = after
            out.mandatory += not opened and not choices
            at = after
    out.final = at
    out.openings = [b" " + w + b" " for w in sorted({w for s in out.closure({0}) for w in out.words[s]})]
    return out


def _anchor(markup: str) -> tuple[bytes, int]:
    """The template's longest run of mandatory words, and how many words may stand before it at most."""
    runs, depth, before, run = [], 0, 0, []
    for token in [*_MARKUP.findall(markup), "[["]:
        plain = token not in ("[[", "]]", "<<", ">>", "|") and not token.startswith("{{")
        if plain and not depth:
            run.append(token.encode())
            continue
        if run:
            runs.append((b" " + b" ".join(run) + b" ", before))
            before, run = before + len(run), []
        depth += (token in ("[[", "<<")) - (token in ("]]", ">>"))
        before += int(token[2:-2]) if token.startswith("{{") else plain
    return max(runs, key=lambda x: len(x[0]))


class Scanner:
    """Base phrases and compiled templates over one text."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.templates = [(label, compile_template(t), *_anchor(t)) for label, t in templates.items()]

    def matches(self, text: bytes) -> list[tuple[str, int, int]]:
        """(label, first word, words) of each accepted template; the earliest start of each anchor place."""
        out, spaces = [], None
        for label, automaton, anchor, before in self.templates:
            at = text.find(anchor)
            while at >= 0:
                spaces = _spaces(text) if spaces is None else spaces
                word = int(np.searchsorted(spaces, at))
                for start in range(max(0, word - before), word + 1):
                    reach = int(spaces[min(start + automaton.longest + 1, len(spaces) - 1)])
                    n = automaton.accepts(text[spaces[start] + 1 : reach].split())
                    if n > word - start:
                        out.append((label, start, n))
                        break
                at = text.find(anchor, at + 1)
        return out

    def places(self, text: bytes) -> list[tuple[str, int]]:
        out, spaces = [], None
        for phrase, label in self.phrases:
            at = text.find(phrase)
            while at >= 0:
                spaces = _spaces(text) if spaces is None else spaces
                out.append((label, int(np.searchsorted(spaces, at))))
                at = text.find(phrase, at + 1)
        return out


def _spaces(text: bytes) -> np.ndarray:
    """Where the blanks of a normal() text are: word i starts after the i-th."""
    return np.flatnonzero(np.frombuffer(text, np.uint8) == 32)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,words:long>>"


def _scan(phrases: dict[str, str], templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = normal(text.as_py())
                places, found = scanner.places(data), scanner.matches(data)
                words = max(0, data.count(b" ") - 1)
                if data == b"  ":
                    words = 0
                starts = [at for _, at in places]
                base, extra = {label for label, _ in places}, {label for label, _, _ in found}
                rows.append(
                    {
                        "n_words": words,
                        "n_base": len(places),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | extra)),
                        "score": 1.0 if extra else 0.5 if base else 0.0,
                        "matches": [{"label": a, "first": b, "words": c} for a, b, c in found],
                    }
                )
            match = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]
            names = list(rows[0]) if rows else []
            added = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)]
            if rows:
                yield pa.record_batch([batch.column("doc_id"), *added], names=["doc_id", *names])

    return run


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, base places, labels, accepted templates with their words, and a score: 1 where a whole
    template is accepted, 0.5 where only a base phrase stands, else 0."""
    scan = _scan(BASE_PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {SCHEMA}")
