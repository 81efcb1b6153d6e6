"""License scans: templates with optional and replaceable regions, matched as token automata.

A template is written in the public matching markup: literal words,
``<<beginOptional>>``/``<<endOptional>>`` around wording that may be absent (they
nest), and ``<<var;MIN;MAX>>`` for a region that any MIN to MAX words replace.  It
is compiled into a nondeterministic automaton over words.  The automaton is run
from each place where a template can begin, and accepts if all mandatory wording
stands there exactly, in order and without other words between; the longest match
from a place counts.

Edge cases: a null or empty text has no words and no label; very long texts are
scanned whole, from the places alone where a template can begin; repeated rows are
scanned row by row; an empty table gives no rows; equal labels from several places
are listed once, and of matches that begin at one place the longest counts; a
template whose wording is all optional or replaceable is refused.  Only the id and the text are read, so further columns
cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelode.llm import _kernel as K

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases of the base and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Templates of the method and their labels: short references, and notices and texts of public licenses.
TEMPLATES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
    ("mit", "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software <<beginOptional>>the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;1;12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software<<endOptional>>"),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies <<beginOptional>>the software is provided as is and <<var;1;8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;1;8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software<<endOptional>>"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var;0;1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<var;0;1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>>this software is provided by <<var;1;12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed<<endOptional>>"),
    ("bsd-3-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<var;0;1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<var;0;1>> neither the name of <<var;1;12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission <<beginOptional>>this software is provided by <<var;1;12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed<<endOptional>>"),
    ("bsd-3-clause", "neither the name of <<var;1;12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<var;0;1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<var;0;1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<var;0;1>> this notice may not be removed or altered from any source distribution"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("boost", "under the boost software license <<beginOptional>>version 1 0<<endOptional>>"),
    ("bsd", "under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>new<<endOptional>> <<beginOptional>>simplified<<endOptional>> <<beginOptional>>2 clause<<endOptional>> <<beginOptional>>3 clause<<endOptional>> bsd <<beginOptional>>style<<endOptional>> license"),
    ("apache-2", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var;1;8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis <<beginOptional>>without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license<<endOptional>>"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version <<beginOptional>>this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details <<beginOptional>>you should have received a copy of the gnu general public license along with this program if not see <<var;1;6>><<endOptional>><<endOptional>>"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version <<beginOptional>>this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details<<endOptional>>"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>library<<endOptional>> general public license as published by the free software foundation either version <<var;1;2>> of the license or at your option any later version"),
    ("gpl-3", "under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version 3"),
    ("gpl-2", "under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version 2"),
    ("lgpl", "under the <<beginOptional>>terms of the<<endOptional>> gnu lesser general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version <<var;1;1>>"),
    ("agpl-3", "under the <<beginOptional>>terms of the<<endOptional>> gnu affero general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 <<beginOptional>>if a copy of the mpl was not distributed with this file you can obtain one at <<var;1;6>><<endOptional>>"),
    ("mpl-2", "under the <<beginOptional>>terms of the<<endOptional>> mozilla public license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"),
    ("cc-by", "under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by <<var;1;1>> 0"),
    ("cc-by", "under a creative commons attribution <<var;1;1>> 0 <<beginOptional>>international<<endOptional>> license"),
    ("cc-by-sa", "under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc0", "cc0 1 0 <<beginOptional>>universal<<endOptional>>"),
    ("unlicense", "this is free and unencumbered software released into the public domain <<beginOptional>>anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means<<endOptional>>"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("all-rights-reserved", "all rights reserved"),
)


@dataclass(frozen=True)
class Automaton:
    """State k reads ``words[k]`` (None: any word) and goes to k + 1; ``skips[k]`` are the states that k is also in."""

    label: str
    words: tuple[bytes | None, ...]
    skips: tuple[tuple[int, ...], ...]
    needs: frozenset[bytes]

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for k in self.skips[todo.pop()]:
                if k not in out:
                    out.add(k)
                    todo.append(k)
        return out

    def longest(self, tokens: list[bytes], at: int) -> int:
        """The end of the longest match from ``at``, or -1."""
        end, states, last = -1, self.closure({0}), len(self.words)
        while states:
            if last in states:
                end = at
            if at == len(tokens):
                break
            states = self.closure({k + 1 for k in states if k < last and self.words[k] in (None, tokens[at])})
            at += 1
        return end

    def firsts(self) -> frozenset[bytes | None]:
        return frozenset(self.words[k] for k in self.closure({0}) if k < len(self.words))


def compile_template(label: str, template: str) -> Automaton:
    words: list[bytes | None] = []
    skips: dict[int, list[int]] = {}
    opened: list[int] = []
    needs: set[bytes] = set()
    for piece in re.findall(r"<<.*?>>|[^\s<]+", template):
        if piece == "<<beginOptional>>":
            opened.append(len(words))
        elif piece == "<<endOptional>>":
            if not opened:
                raise ValueError(f"{label}: endOptional without beginOptional")
            skips.setdefault(opened.pop(), []).append(len(words))
        elif piece.startswith("<<var"):
            least, most = map(int, piece[2:-2].split(";")[1:3])
            if not 0 <= least <= most:
                raise ValueError(f"{label}: bad bounds in {piece}")
            words += [None] * least
            for k in range(most - least):
                skips.setdefault(len(words), []).append(len(words) + most - least - k)
                words.append(None)
        else:
            words.append(piece.encode())
            if not opened:
                needs.add(words[-1])
    if opened:
        raise ValueError(f"{label}: beginOptional without endOptional")
    if not needs:
        raise ValueError(f"{label}: a template needs wording that is neither optional nor replaceable")
    return Automaton(label, tuple(words), tuple(tuple(skips.get(k, ())) for k in range(len(words) + 1)), frozenset(needs))


@dataclass(frozen=True)
class Found:
    """What one text holds: base places (start, label), and matches (start, end, label)."""

    base: list[tuple[int, str]]
    matches: list[tuple[int, int, str]]


def scan_words(tokens: list[bytes], automata: list[Automaton], base: list[Automaton]) -> Found:
    """Runs every automaton whose mandatory words all occur; base phrases count at all places."""
    have = set(tokens)
    places: dict[bytes, list[int]] = {}
    runnable = [(a, a in base) for a in automata if a.needs <= have]
    wanted = {w for a, _ in runnable for w in a.firsts()}
    for at, w in enumerate(tokens) if runnable else ():
        if w in wanted:
            places.setdefault(w, []).append(at)
    hits: list[tuple[int, str]] = []
    matches: list[tuple[int, int, str]] = []
    for a, is_base in runnable:
        starts = range(len(tokens)) if None in a.firsts() else sorted(p for w in a.firsts() for p in places.get(w, ()))
        for at in starts:
            if (end := a.longest(tokens, at)) >= 0:
                matches.append((at, end, a.label))
                if is_base:
                    hits.append((at, a.label))
    return Found(hits, matches)


def _needles(automata: list[Automaton]) -> list[bytes]:
    """Words such that every template needs one of them: for each, its longest mandatory word."""
    return sorted({max(a.needs, key=lambda w: (len(w), w)) for a in automata})


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch], templates: tuple) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    base = [compile_template(label, phrase) for phrase, label in BASE]
    automata = base + [a for a in (compile_template(*t) for t in templates) if a not in base]
    needles = K.word_hashes(_needles(automata))
    for batch in batches:
        if not batch.num_rows:
            continue
        n_words, rows = [], {}
        for at, to, buf, offs in K.chunks(batch.column(1)):
            lower = K.LOWER[buf]
            starts, ends, woffs = K.words(lower, offs, K.NOT_WORD)
            n_words.append(np.diff(woffs))
            hits = np.flatnonzero(np.isin(K.span_hash(K.prefix_hash(lower), starts, ends), needles))
            for k in np.unique(np.searchsorted(woffs, hits, "right") - 1):
                rows[at + int(k)] = scan_words(WORD.findall(lower[offs[k] : offs[k + 1]].tobytes()), automata, base)
        count = np.concatenate(n_words)
        cols: list[list] = [[0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows, [""] * batch.num_rows, [""] * batch.num_rows, [0.0] * batch.num_rows]
        for k, found in rows.items():
            starts = [s for s, _ in found.base]
            covered: set[int] = set()
            for s, e, _ in found.matches:
                covered.update(range(s, e))
            own = (len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found.base})), ",".join(sorted({x for _, _, x in found.matches})), len(covered) / max(1, int(count[k])))
            for col, v in zip(cols, own, strict=True):
                col[k] = v
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """One row for each document: its words, base places and labels; score is the share of words in matches."""
    for t in templates:
        compile_template(*t)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.frugal(lambda it: _scan(it, templates)), _SCHEMA)
