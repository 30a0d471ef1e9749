"""License scans: phrases, and template markup compiled into token automata.

A template is wording with two kinds of markup: ``<<optional>> .. <<end>>`` may be missing, and
``<<any N>>`` stands for up to N words of any kind. Its automaton runs over words (A-Z lower-cased,
marks dropped). A text has the template's label if the automaton accepts a run of its words: all
mandatory wording, in order and unchanged.

A template begins with two mandatory words. Places with those two are found by hashes over whole
batches; automata run only from there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm import textvec
from pixelyard.llm.common import map_batches

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_BSD_OPENING = "redistribution and use <<optional>> of this software <<end>> in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_ONE = "<<any 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_TWO = "<<any 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_THREE = "<<any 1>> neither the name of <<any 12>> nor the names of <<any 6>> may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = "this software is provided by <<any 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_AS_IS = "the software is provided as is"

#: Wording of common licences, whole, and of the notices that name one, by label.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software "
    + _AS_IS
    + " without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<any 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    + _AS_IS
    + " and <<any 6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any 6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": f"{_BSD_OPENING} {_BSD_ONE} {_BSD_TWO} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_OPENING} {_BSD_ONE} {_BSD_TWO} {_BSD_THREE} {_BSD_END}",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<any 1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<any 1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<any 1>> this notice may not be removed or altered from any source distribution",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any 9>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu <<any 2>> general public license as published by the free software foundation either version <<any 1>> of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<any 2>> general public license for more details",
    "gpl-3.0": "gnu general public license <<optional>> as published by the free software foundation either <<end>> version 3 <<optional>> of the license <<end>>",
    "gpl-2.0": "gnu general public license <<optional>> as published by the free software foundation either <<end>> version 2 <<optional>> of the license <<end>>",
    "apache-2.0": "apache license <<optional>> version <<end>> 2 0",
    "mit-notice": "under the <<optional>> terms of the <<end>> mit license",
    "cc-by-4.0": "cc by <<optional>> license <<end>> 4 0",
    "cc-by-sa-4.0": "cc by sa <<optional>> license <<end>> 4 0",
    "cc-by-nc-4.0": "cc by nc <<optional>> license <<end>> 4 0",
    "cc-by-nd-4.0": "cc by nd <<optional>> license <<end>> 4 0",
    "cc-attribution-4.0": "creative commons attribution <<any 2>> 4 0 <<optional>> international <<end>>",
    "all-rights-reserved": "all rights reserved",
}

_TOKEN = re.compile(r"<<(optional|end|any) ?(\d*)>>|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")


@dataclass
class Automaton:
    """States are places between tokens; ``word[s]`` leads to s + 1, ``skip[s]`` to later places for nothing."""

    label: str
    word: list[bytes | None]
    """None: any word"""
    skip: list[list[int]]
    mandatory: list[int]
    """mandatory words before each state"""

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def run(self, words) -> tuple[bool, float]:
        """From the first of ``words`` on: whether a run of them is accepted, and the share of mandatory words seen."""
        states, most, last = self.closure({0}), 0, len(self.word)
        for w in words:
            states = self.closure({s + 1 for s in states if s < last and self.word[s] in (None, w)})
            if not states:
                break
            most = max(most, max(self.mandatory[s] for s in states))
            if last in states:
                return True, 1.0
        return False, most / max(1, self.mandatory[last])


def compile_template(label: str, template: str) -> Automaton:
    word: list[bytes | None] = []
    skip: list[list[int]] = [[]]
    mandatory, opened = [0], None
    for kind, count, token in (m.groups() for m in _TOKEN.finditer(template)):
        if kind == "optional":
            opened = len(word)
        elif kind == "end":
            skip[opened].append(len(word))
            opened = None
        elif kind == "any":
            for _ in range(int(count or 1)):
                skip[len(word)].append(len(word) + 1)
                word.append(None)
                skip.append([])
                mandatory.append(mandatory[-1])
        else:
            word.append(token.lower().encode())
            skip.append([])
            mandatory.append(mandatory[-1] + (opened is None))
    if len(word) < 2 or skip[0] or skip[1] or None in word[:2]:
        raise ValueError(f"{label}: a template begins with two mandatory words")
    return Automaton(label, word, skip, mandatory)


def _hash_of(word: bytes) -> np.uint64:
    (w,) = textvec.words(pa.array([word.decode()]))
    return w.hashes()[0]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row of ``docs(doc_id, text)``.

    ``n_base`` counts the places where a base phrase stands, ``first_word`` and ``last_word`` are the
    smallest and largest of them (null without one). ``labels`` adds the labels of accepted templates.
    ``score`` is the largest share of a template's mandatory words that follow each other from one of
    its beginnings, and at least a half beside a base phrase. A null or empty text has no words and no
    labels (empty strings, score 0). Repeated rows give repeated rows; other columns are ignored.
    """
    automata = [compile_template(k, t) for k, t in (TEMPLATES if templates is None else templates).items()]

    def scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        phrases = [([_hash_of(x.encode()) for x in p.split()], p.encode().split(), label) for p, label in PHRASES.items()]
        starts = [(_hash_of(a.word[0]), _hash_of(a.word[1]), a) for a in automata]
        n_words, n_base, score = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
        first, last = [None] * n, [None] * n
        base: list[set[str]] = [set() for _ in range(n)]
        own: list[set[str]] = [set() for _ in range(n)]
        for w in textvec.words(batch["text"]):
            n_words[w.first : w.last] = w.counts
            h, tail = w.hashes(), w.begin[w.doc + 1]
            if len(h) < 2:
                continue
            for hashes, words, label in phrases:
                at = np.flatnonzero(h[: len(h) - len(hashes) + 1] == hashes[0])
                for k, x in enumerate(hashes[1:], 1):
                    at = at[h[at + k] == x]
                for i in at[at + len(hashes) <= tail[at]].tolist():
                    if [w.text(i + k) for k in range(len(words))] == words:
                        d = w.first + int(w.doc[i])
                        place = i - int(w.begin[w.doc[i]])
                        n_base[d] += 1
                        first[d] = place if first[d] is None else min(first[d], place)
                        last[d] = place if last[d] is None else max(last[d], place)
                        base[d].add(label)
                        score[d] = max(score[d], 0.5)
            for one, two, a in starts:
                at = np.flatnonzero((h[:-1] == one) & (h[1:] == two))
                for i in at[at + 2 <= tail[at]].tolist():
                    d = w.first + int(w.doc[i])
                    if a.label in own[d]:
                        continue
                    accepted, share = a.run((w.text(j) for j in range(i, int(tail[i]))))
                    score[d] = max(score[d], share)
                    if accepted:
                        own[d].add(a.label)
        arrays = [batch["doc_id"], pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64())]
        arrays += [pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(b | o)) for b, o in zip(base, own, strict=True)], pa.string()), pa.array(score)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan_batch, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
