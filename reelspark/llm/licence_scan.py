"""Licence scans with a generalised suffix automaton over the tokens of licence templates.

Each text is streamed through the automaton, which yields matching statistics: at
every word the longest run ending there that occurs in any template, and where it
occurs. Maximal runs of at least `least_match` words are chained, template by
template, into spans in which text and template positions both advance; a span that
covers enough of its template gives the template's label. Fixed phrases give base
labels besides.

Cases: a null or empty text has no words, no labels and score 0. Repeated licence
lines give a span each and one label. Long texts are streamed whole, in time linear
in their words. Extra columns pass through `keep` only; one that bears the
name of a result column comes back with "_input" appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, kept_names, table

#: Phrases of the contract and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public licence notices, short ones first, then whole licences and headers (fixed values).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
]
#: A-Z become a-z; a-z, 0-9 and bytes beyond ASCII stay; the rest parts words.
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PARTS).split()


@dataclass
class Automaton:
    """All runs of all templates. The places where a state's runs occur, as (template, position after the run), are a slice of one list."""

    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    places: list[tuple[int, int]] = field(default_factory=list)
    slices: list[tuple[int, int]] = field(default_factory=list)

    def _state(self, length: int, link: int, go: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.go.append(go)
        return len(self.go) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A state for q's shorter runs, which p reaches by the token."""
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = twin
        while p >= 0 and self.go[p].get(token) == q:
            self.go[p][token] = twin
            p = self.link[p]
        return twin

    def extend(self, last: int, token: int) -> int:
        if (q := self.go[last].get(token)) is not None:  # the run is known from an earlier template
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.go[p]:
            self.go[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    @staticmethod
    def of(templates: list[list[int]]) -> Automaton:
        own, stops = Automaton(), {}
        for k, tokens in enumerate(templates):
            state = 0
            for i, token in enumerate(tokens):
                state = own.extend(state, token)
                stops.setdefault(state, []).append((k, i + 1))
        below: list[list[int]] = [[] for _ in own.go]
        for s in range(1, len(own.go)):
            below[own.link[s]].append(s)
        own.slices = [(0, 0)] * len(own.go)
        left = [(0, -1)]  # a state, and where its places begin once all below it are listed
        while left:
            s, begin = left.pop()
            if begin >= 0:
                own.slices[s] = begin, len(own.places)
                continue
            left.append((s, len(own.places)))
            own.places += stops.get(s, [])
            left += [(t, -1) for t in below[s]]
        return own

    def ends(self, state: int) -> list[tuple[int, int]]:
        begin, end = self.slices[state]
        return sorted(self.places[begin:end])

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For every token the state and the length of the longest known run that ends there."""
        state = size = 0
        for token in tokens:
            while state and token not in self.go[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.go[state]:
                state, size = self.go[state][token], size + 1
            yield state, size


@dataclass(frozen=True)
class Span:
    template: int
    first: int
    last: int
    covered: int


class Scanner:
    def __init__(self, templates=TEMPLATES, least_match: int = 4, most_gap: int = 8):
        self.labels = [label for label, _ in templates]
        tokens = [words_of(text) for _, text in templates]
        self.ids = {w: i for i, w in enumerate(sorted({w for t in tokens for w in t}))}
        self.sizes = [len(t) for t in tokens]
        self.automaton = Automaton.of([[self.ids[w] for w in t] for t in tokens])
        self.least_match, self.most_gap = least_match, most_gap

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(template, its first token, first word, length) of maximal runs. Only stretches of template words are streamed."""
        known = [self.ids.get(w, -1) for w in words] + [-1]
        begin = 0
        while begin < len(words):
            if known[begin] < 0:
                begin += 1
                continue
            end = known.index(-1, begin)
            if end - begin >= self.least_match:
                found = [*self.automaton.statistics(known[begin:end]), (0, 0)]
                for i, ((state, size), (_, after)) in enumerate(zip(found, found[1:])):
                    if size >= self.least_match and after <= size:
                        for template, stop in self.automaton.ends(state):
                            yield template, stop - size, begin + i + 1 - size, size
            begin = end

    def spans(self, words: list[bytes]) -> list[Span]:
        """Chains of runs of one template, in which both positions advance; each run joins its template's open chain or begins another."""
        open_: dict[int, tuple[int, int, int, int]] = {}  # template: first word, end in the text, end in the template, covered
        done = []
        for template, at, first, size in self.matches(words):
            chain = open_.get(template)
            if chain:
                begun, text_end, template_end, covered = chain
                cut = max(0, text_end - first, template_end - at)
                if first <= text_end + self.most_gap and first + size > text_end and at + size > template_end and cut < size and at >= template_end - size:
                    open_[template] = begun, first + size, at + size, covered + size - cut
                    continue
                if first < text_end and size <= covered:
                    continue  # another place of the template for words that the chain has already
                done.append(Span(template, begun, text_end - 1, covered))
            open_[template] = first, first + size, at + size, size
        return done + [Span(k, a, b - 1, c) for k, (a, b, _, c) in open_.items()]

    def phrases(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase."""
        joined = b" " + b" ".join(words) + b" "
        found = []
        for phrase, label in PHRASES.items():
            key, at, seen, counted = b" " + phrase.encode() + b" ", -1, 0, 0
            while (at := joined.find(key, at + 1)) >= 0:
                counted += joined.count(b" ", seen, at)
                seen = at
                found.append((counted, label))
        return found


_scanners: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates=tuple(TEMPLATES), least_match: int = 4, most_gap: int = 8) -> DataFrame:
    """keep, n_words, base (array of word and label) and spans (array of label, first and last word, share of the template covered)."""

    def run(batches):
        own = _scanners.setdefault(key, None) or Scanner(templates, least_match, most_gap)
        _scanners[key] = own
        for batch in batches:
            n, base, spans = [], [], []
            for body in batch.column(batch.num_columns - 1).to_pylist():
                words = words_of(body)
                n.append(len(words))
                base.append([{"word": w, "label": x} for w, x in own.phrases(words)])
                spans.append([{"label": own.labels[s.template], "first": s.first, "last": s.last, "covered": s.covered / own.sizes[s.template]} for s in own.spans(words)])
            columns = [pa.array(n, pa.int64()), pa.array(base, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*[f"k{i}" for i in range(len(keep))], "n_words", "base", "spans"])

    bounded_batches(docs.sparkSession)
    key = (templates, least_match, most_gap)
    given = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(given.schema.fields[:-1]))
    done = given.mapInArrow(run, f"{kinds}, n_words long, base array<struct<word:long,label:string>>, spans array<struct<label:string,first:long,last:long,covered:double>>")
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, ("n_words", "base", "spans")))], "n_words", "base", "spans")


#: Share of a template that a span must cover to give its label.
LEAST_COVERED = 0.75


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    enough = F.transform(F.filter("spans", lambda s: s["covered"] >= LEAST_COVERED), lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.col("base.label")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, enough)).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max("spans.covered"), F.lit(0.0)))).alias("score"),
    )


QUERIES = {"op8_license_scan": op8_license_scan}
