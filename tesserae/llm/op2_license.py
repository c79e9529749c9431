"""Operator 2: license scans by template markup.

A template is a license notice in markup: ``<<optional>>...<</optional>>`` may be absent, ``<<var:1-6>>`` stands for that
many words, whatever they are. It is compiled into an automaton over word tokens; a place of a text is accepted if its
words match the mandatory wording of the template exactly. The automaton is run on sets of states, so the time is
linear in the text for each template.

Words are maximal runs of ASCII letters and digits, with A-Z lower-cased, and of all characters beyond ASCII.

Defined results: a null or empty text has no words, no labels, null positions and score 0. Score is the share of the
text's words that stand in an accepted place or base phrase, 0 where there are none. Rows are independent; a null
doc_id is carried; columns beside doc_id and text have no effect; texts are scanned whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import arrow_map, table, texts

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates: label and marked-up wording, without marks of punctuation. The wording of the licenses.
TEMPLATES = {
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "<<optional>>http<</optional>> <<optional>>https<</optional>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "bsd-2-clause": "<<bsd>> <<bsd-end>>",
    "bsd-3-clause": (
        "<<bsd>> <<optional>>3<</optional>> neither the name of <<var:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission <<bsd-end>>"
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser<</optional>> <<optional>>affero<</optional>> general public license as published by the "
        "free software foundation either version <<var:1-2>> of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without "
        "even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<optional>>lesser<</optional>> <<optional>>affero<</optional>> general public license for more details"
    ),
    "isc": (
        "permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and <<var:1-8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall <<var:1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence "
        "or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "mit-full": (
        "<<optional>><<optional>>the<</optional>> mit license <<optional>>mit<</optional>><</optional>> <<optional>>copyright <<optional>>c<</optional>> <<var:1-16>><</optional>> "
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the "
        "software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall <<var:1-10>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "software or the use or other dealings in the software"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
        "binary for any purpose commercial or non commercial and by any means"
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone "
        "to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<optional>>1<</optional>> the origin of this software "
        "must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment <<optional>>see the following<</optional>> in the product documentation "
        "would be appreciated but is not required <<optional>>2<</optional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "<<optional>>3<</optional>> this notice may not be removed or altered from any source distribution"
    ),
    "agpl-3.0": "<<optional>>this work is<</optional>> licensed under the gnu affero general public license <<optional>>version<</optional>> <<optional>>v<</optional>> 3",
    "all-rights-reserved": "all rights reserved",
    "apache-2.0": "licensed under the apache license <<optional>>version<</optional>> 2 0 <<optional>>the license<</optional>>",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "<<optional>>this work is<</optional>> licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> <<optional>>creative commons attribution<</optional>> cc by 4 0",
    "cc-by-nc-4.0": "<<optional>>this work is<</optional>> licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> cc by nc 4 0",
    "cc-by-sa-4.0": "<<optional>>this work is<</optional>> licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> cc by sa 4 0",
    "copyright": "copyright <<optional>>c<</optional>> <<var:1-8>> all rights reserved",
    "gpl-3.0": "<<optional>>this work is<</optional>> licensed under the gnu general public license <<optional>>version<</optional>> <<optional>>v<</optional>> 3 <<optional>>or any later version<</optional>>",
    "gpl-2.0": "<<optional>>this work is<</optional>> licensed under the gnu general public license <<optional>>version<</optional>> <<optional>>v<</optional>> 2 <<optional>>or any later version<</optional>>",
    "mit": "<<optional>>released under the<</optional>> mit license <<optional>>mit<</optional>>",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>the software<</optional>> to deal in the software without restriction",
    "mpl-2.0": "subject to the terms of the mozilla public license <<optional>>v<</optional>> <<optional>>version<</optional>> 2 0",
}

_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<</optional>> redistributions of source code must "
    "retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_END = (
    "this software is provided by <<var:1-10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<var:1-10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use "
    "data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of "
    "this software even if advised of the possibility of such damage"
)
TEMPLATES = {label: markup.replace("<<bsd>>", _BSD).replace("<<bsd-end>>", _BSD_END) for label, markup in TEMPLATES.items()}

#: Sets of states that an automaton remembers at most.
MOST_STEPS = 100_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SHAPE = bytes(97 if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    """A template as a token automaton: state -> transitions; a transition on None takes any word."""

    def __init__(self, markup: str):
        self.on: list[dict[str | None, set[int]]] = [{}]
        self.skip: list[set[int]] = [set()]
        at, opened, self.anchor = 0, [], b""
        for part in re.findall(r"<<[^>]*>>|[^\s<]+", markup.lower()):
            if part == "<<optional>>":
                opened.append(at)
            elif part == "<</optional>>":
                self.skip[opened.pop()].add(at)
            elif m := re.fullmatch(r"<<var:(\d+)-(\d+)>>", part):
                for k in range(int(m[2])):
                    end = self._step(at, None)
                    if k >= int(m[1]):
                        self.skip[at].add(end)
                    at = end
            elif part.startswith("<<"):
                raise ValueError(f"unknown markup {part}")
            else:
                if not opened and len(part) > len(self.anchor):
                    self.anchor = part.encode()
                at = self._step(at, part)
        if opened or not self.anchor:
            raise ValueError("a template needs closed regions and a mandatory word")
        self.end = at
        self.start = self._closed({0})
        self.words = {w for on in self.on for w in on if w is not None}
        self.steps: dict[frozenset[int], dict[bytes | None, frozenset[int]]] = {}

    def _step(self, at: int, word: str | None) -> int:
        self.on.append({})
        self.skip.append(set())
        self.on[at].setdefault(word.encode() if word else None, set()).add(len(self.on) - 1)
        return len(self.on) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = [*states], set(states)
        while todo:
            for s in self.skip[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def _after(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        """The states that a word leads to; sets of states met before are looked up, all words that the template lacks as one."""
        known = self.steps.setdefault(states, {})
        key = word if word in self.words else None
        if key not in known:
            known[key] = self._closed({t for s in states for w in {key, None} for t in self.on[s].get(w, ())})
            if len(self.steps) > MOST_STEPS:
                self.steps = {states: known}
        return known[key]

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Longest accepted place at each start, leftmost first and apart: (first word, word after the last)."""
        found, i, first = [], 0, {w for s in self.start for w in self.on[s]}
        while i < len(words):
            if None not in first and words[i] not in first:
                i += 1
                continue
            states, j, end = self.start, i, 0
            while states:
                if self.end in states and j > i:
                    end = j
                if j == len(words):
                    break
                states = self._after(states, words[j])
                j += 1
            if end:
                found.append((i, end))
            i = max(end, i + 1)
        return found


def compiled(templates: dict[str, str]) -> dict[str, Automaton]:
    return {label: Automaton(markup) for label, markup in sorted(templates.items())}


def scan(text: str, automata: dict[str, Automaton]) -> dict:
    """Labels, base places and accepted places of one text."""
    raw = text.encode().lower()  # lower-cases A-Z alone
    out = {"n_words": len(raw.translate(_SHAPE).split()), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "places": []}
    wanted = [(label, a) for label, a in automata.items() if a.anchor in raw]
    if b"license" not in raw and not wanted:
        return out
    words = WORD.findall(raw)
    base: list[tuple[int, int, str]] = []
    where: dict[bytes, list[int]] = {}
    for k, w in enumerate(words):
        if w == b"license":
            where.setdefault(w, []).append(k)
    for phrase, label in PHRASES.items():
        spelt = phrase.encode().split()
        base += [(k - len(spelt) + 1, k + 1, label) for k in where.get(b"license", ()) if words[max(0, k - len(spelt) + 1) : k + 1] == spelt]
    places = [(a, b, label) for label, auto in wanted for a, b in auto.places(words)]
    covered: set[int] = set()
    for a, b, _ in base + places:
        covered.update(range(a, b))
    starts = [a for a, _, _ in base]
    return out | {
        "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({x for *_, x in base})), "labels": ",".join(sorted({x for *_, x in base + places})),
        "score": len(covered) / len(words) if words else 0.0, "places": sorted(places),
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text) to labels and places (``label:first word:word after the last``, comma-joined)."""
    templates = TEMPLATES if templates is None else templates
    automata = compiled(templates)

    def each(batch: pa.RecordBatch):
        rows = [scan(t, automata) for t in texts(batch)]
        out = {k: [r[k] for r in rows] for k in rows[0] if k != "places"}
        return out | {"doc_id": batch.column("doc_id"), "places": [",".join(f"{x}:{a}:{b}" for a, b, x in r["places"]) for r in rows]}

    return arrow_map(docs.select("doc_id", "text"), each, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


#: The base counts are plain text matching, the templates' automata are not SQL; tests/llm/test_ops.py has the brute force.
SQL = None
