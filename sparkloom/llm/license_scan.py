"""License notices by template-markup matching.

A template is text with two marks: ``<<beginOptional>> ... <<endOptional>>`` for wording that may be missing, and ``<<var;n>>`` for up to n words
of any wording. It is compiled to a token automaton; a text holds the license where the automaton accepts a run of
its words, all mandatory words standing there exactly. Punctuation and A-Z case do not count, as words are what is compared.

Base phrases are searched beside the templates and count every place, overlapping ones too.

Defined cases: a null text has no words and no labels; an empty table gives an empty table; repeated rows and rows of one doc_id are scanned
each on their own; overlapping matches of different templates all count; a very long text is scanned once for each template, and
automata run only from words that open one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow

# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of public license notices, with markup.
TEMPLATES = {
    "apache-2.0": """licensed under the apache license version 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed
        under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license<<endOptional>>""",
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        <<var;4>> to deal in <<var;2>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of <<var;2>> and to permit persons to whom <<var;2>> is furnished to do so subject to the following conditions
        <<beginOptional>>the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software<<endOptional>>""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<beginOptional>><<var;1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer<<endOptional>>""",
    "isc": """permission to use copy modify and <<var;2>> distribute this software for any purpose with or without fee is hereby granted
        <<beginOptional>>provided that the above copyright notice and this permission notice appear in all copies<<endOptional>>""",
    "gpl-notice": """this program is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license
        <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either version <<var;2>> of the license or at your option any later version<<endOptional>>""",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-notice": "licensed under a creative commons attribution <<var;6>> license",
    "spdx": "spdx license identifier <<var;1>>",
    "mit-short": "<<beginOptional>>released<<endOptional>> licensed under the mit license",
    "mpl-2.0-notice": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file
        you can obtain one at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> mozilla org mpl 2 0""",
    "epl-2.0-notice": """this program and the accompanying materials are made available under the terms of the eclipse public license <<beginOptional>>v<<endOptional>> 2 0
        <<beginOptional>>which <<var;1>> available at <<var;8>><<endOptional>>""",
    "cc0-notice": "to the extent possible under law <<var;12>> waived all copyright and related or neighboring rights to <<var;8>>",
    # whole texts
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>>
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall <<var;10>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
        or the use or other dealings in the software""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<var;1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<var;1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        this software is provided by <<var;8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
        in no event shall <<var;8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
        arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<var;1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<var;1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        <<var;1>> neither the name of <<var;12>> nor the names of <<beginOptional>>its<<endOptional>> <<beginOptional>>other<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission
        this software is provided by <<var;8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
        in no event shall <<var;8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
        arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "isc-text": """permission to use copy modify <<beginOptional>>and or<<endOptional>> <<beginOptional>>and<<endOptional>> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and <<var;6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
        in no event shall <<var;6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "zlib-text": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        <<var;1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software
        if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        <<var;1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        <<var;1>> this notice may not be removed or altered from any source distribution""",
    "unlicense-text": """this is free and unencumbered software released into the public domain
        anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
        in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
        we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
        we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
}

#: Words that may separate a run of a template; a label needs a whole template.
_MARK = re.compile(r"<<(beginOptional|endOptional|var;\d+)>>")
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ANY = None


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII digits, letters (A-Z lowered) and any other character beyond ASCII."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class Automaton:
    """States from 0; ``steps[s]`` lists (word or ANY, next state), ``free[s]`` the states reached without a word."""

    def __init__(self, template: str):
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        open_at: list[int] = []
        state = 0
        for k, part in enumerate(_MARK.split(template)):
            if k % 2 == 0:
                for word in words_of(part):
                    state = self._step(state, word)
            elif part == "beginOptional":
                open_at.append(state)
            elif part == "endOptional":
                self.free[open_at.pop()].append(state := self._skip(state))
            else:
                before, end = [state], state
                for _ in range(int(part.partition(";")[2])):
                    before.append(end := self._step(end, ANY))
                state = self._skip(end)
                for s in before:
                    self.free[s].append(state)
        self.accept = state
        self.first = {word for s in self._closure({0}) for word, _ in self.steps[s]}

    def _new(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _step(self, state: int, word: bytes | None) -> int:
        new = self._new()
        self.steps[state].append((word, new))
        return new

    def _skip(self, state: int) -> int:
        new = self._new()
        self.free[state].append(new)
        return new

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run from ``start``; -1 if there is none."""
        states, end, at = self._closure({0}), -1, start
        while states:
            if self.accept in states:
                end = at
            if at == len(words):
                break
            word = words[at]
            states = self._closure({new for s in states for want, new in self.steps[s] if want == word or want is ANY})
            at += 1
        return end

    def lead(self) -> list[bytes]:
        """The mandatory words that every match begins with."""
        out, state = [], 0
        while len(self.steps[state]) == 1 and not self.free[state] and self.steps[state][0][0] is not ANY:
            out.append(self.steps[state][0][0])
            state = self.steps[state][0][1]
        return out


def compile_templates(templates: dict[str, str]) -> list[tuple[str, Automaton, bytes]]:
    """(label, automaton, a string that any text it matches holds) of each template."""
    out = []
    for label, template in templates.items():
        automaton = Automaton(template)
        lead = automaton.lead()[:4]
        if not lead:  # it begins with optional wording: the longest mandatory run within
            depth, runs = 0, [[]]
            for k, part in enumerate(_MARK.split(template)):
                if k % 2:
                    depth += {"beginOptional": 1, "endOptional": -1}.get(part, 0)
                    runs.append([])
                elif not depth:
                    runs[-1].extend(words_of(part))
            lead = max(runs, key=len)
        out.append((label, automaton, b" " + b" ".join(lead) + b" "))
    return out


def places_of(phrase: bytes, joined: bytes) -> Iterator[int]:
    """Word numbers at which the phrase stands in `` w0 w1 ... ``."""
    want, at, word = b" " + phrase + b" ", 0, 0
    while (found := joined.find(want, at)) >= 0:
        word += joined.count(b" ", at, found)
        yield word
        at, word = found + 1, word + 1


def scan_text(text: str | None, compiled: list[tuple[str, Automaton, bytes]]) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int]]]:
    """Number of words, base places (label, word), and template matches (label, first word, end)."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = [(label, at) for phrase, label in BASE_PHRASES.items() for at in places_of(phrase.encode(), joined)]
    matches = []
    for label, automaton, needs in compiled:
        if needs not in joined:
            continue
        at = 0
        starts = (k for k, w in enumerate(words) if w in automaton.first)
        for k in starts:
            if k >= at and (end := automaton.longest(words, k)) > k:
                matches.append((label, k, end))
                at = end
    return len(words), base, matches


#: Trust in a document of base phrases alone; a whole template gives 1.
PHRASE_SCORE = 0.5


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_templates(templates)
        place = pa.struct([("label", pa.string()), ("word", pa.int64())])
        match = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = [scan_text(t, compiled) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"label": a, "word": b} for a, b in base] for _, base, _ in found], pa.list_(place)),
                    pa.array([[{"label": a, "first": b, "end": c} for a, b, c in got] for _, _, got in found], pa.list_(match)),
                    pa.array([1.0 if got else PHRASE_SCORE if base else 0.0 for _, base, got in found], pa.float64()),
                ],
                ["doc_id", "n_words", "base", "matches", "score"],
            )

    return run


def scan_licenses(docs: DataFrame, doc: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Per document row: ``doc_id``, ``n_words``, ``base`` (places of base phrases), ``matches`` (spans of templates), ``score``."""
    kind = docs.schema[doc].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, base array<struct<label:string,word:long>>, matches array<struct<label:string,first:long,end:long>>, score double"
    return map_arrow(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), _scan(templates or TEMPLATES), schema)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "matches.label")).alias("labels"),
        "score",
    )
