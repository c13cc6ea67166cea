"""License scans: an exact set-similarity join of text blocks with license templates.

Base: places where a known phrase's words stand consecutively. Method: every block (each line, each run of
``BLOCK_LINES`` lines, and for each template every stretch of 1/``THRESHOLD`` times its words, wherever the text's lines
break) is a set of words, as is each template. A block matches a template if it holds at least ``THRESHOLD`` of the
template's words. For lines and runs of lines, words are ordered by their document frequency over all
documents, rarest first; a block can only match if it holds a word of the template's prefix (|T| - needed + 1 rarest
words), has enough distinct words (length filter) and has enough of both sets left after the first common word
(positional filter). What passes is counted in full. Stretches are counted word by word wherever the whole text holds
enough of a template's words, so the join is exact.

The templates are a fixed short list and their vocabulary is broadcast; documents are never shuffled.

Defined cases: null text is empty: no words, no places, empty labels, score 0; repeated rows are answered one by one;
labels are sorted, distinct and comma-joined; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_rows, word_list

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices in common use, and the texts of short licenses, by label.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program.""",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions""",
    ],
}
THRESHOLD = 0.8
BLOCK_LINES = 3

REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _vocabulary(templates, phrases) -> set[bytes]:
    return {w for texts in templates.values() for t in texts for w in word_list(t.encode())} | {w for p in phrases for w in p.encode().split()}


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the (fixed, small) vocabulary stands; counted over all documents."""

    def run(batches):
        import pyarrow as pa

        counts: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for w in vocabulary.intersection(word_list(text.as_py())):
                    counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    found = map_batches(docs.select(F.col("text").cast("binary")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in found.collect()}  # at most one row per vocabulary word


class TemplateIndex:
    def __init__(self, frequencies: dict[bytes, int], templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, block_lines: int = BLOCK_LINES):
        self.threshold, self.block_lines = threshold, block_lines
        self.vocabulary = _vocabulary(templates, phrases)
        order = {w: i for i, w in enumerate(sorted(self.vocabulary, key=lambda w: (frequencies.get(w, 0), w)))}
        self.order = order
        self.phrases = [(b" " + p.encode() + b" ", frozenset(p.encode().split()), label) for p, label in phrases.items()]
        self.templates, self.prefix, self.stretches = [], {}, []
        for label, texts in templates.items():
            for text in texts:
                tokens = sorted(set(word_list(text.encode())), key=order.get)
                need = math.ceil(threshold * len(tokens) - 1e-9)
                self.templates.append((label, tokens, need))
                self.stretches.append((label, frozenset(tokens), need, math.floor(len(word_list(text.encode())) / threshold + 1e-9)))
                for i, w in enumerate(tokens[: len(tokens) - need + 1]):
                    self.prefix.setdefault(w, []).append((len(self.templates) - 1, i))
        self.prefix_words = frozenset(self.prefix)

    def match(self, block: list[bytes]) -> dict[str, float]:
        """Labels whose templates this block contains, with the containment."""
        distinct = set(block)
        tokens = sorted(distinct & self.vocabulary, key=self.order.get)
        outside, best, tried = len(distinct) - len(tokens), {}, set()
        for j, w in enumerate(tokens):
            for t, i in self.prefix.get(w, ()):
                if t in tried:
                    continue
                tried.add(t)  # the first common word of block and prefix
                label, template, need = self.templates[t]
                if len(distinct) < need or 1 + min(len(template) - i - 1, len(tokens) - j - 1) < need:
                    continue
                share = len(distinct.intersection(template)) / len(template)
                if share >= self.threshold - 1e-9:
                    best[label] = max(best.get(label, 0.0), share)
        return best

    def match_stretches(self, words: list[bytes], seen: set[bytes]) -> dict[str, float]:
        """Labels whose templates some stretch of the text contains, with the largest containment."""
        best: dict[str, float] = {}
        for label, template, need, length in self.stretches:
            if len(template & seen) < need:
                continue
            places, counts, first, most = [i for i, w in enumerate(words) if w in template], {}, 0, 0
            for place in places:
                counts[words[place]] = counts.get(words[place], 0) + 1
                while places[first] <= place - length:
                    w = words[places[first]]
                    counts[w] -= 1
                    if not counts[w]:
                        del counts[w]
                    first += 1
                most = max(most, len(counts))
            if most >= need:
                best[label] = max(best.get(label, 0.0), most / len(template))
        return best

    def scan(self, data: bytes | None) -> tuple:
        words = word_list(data)
        seen = self.vocabulary.intersection(words)
        places, base, found = [], set(), {}
        if seen:
            joined = None
            for phrase, parts, label in self.phrases:
                if parts <= seen:
                    joined = joined or b" " + b" ".join(words) + b" "
                    at, counted, before = joined.find(phrase), 0, 0
                    while at >= 0:
                        before += joined.count(b" ", counted, at)  # on from the last place, so one pass in all
                        counted = at
                        places.append(before)
                        base.add(label)
                        at = joined.find(phrase, at + 1)
            if not seen.isdisjoint(self.prefix_words):
                lines = [word_list(line) for line in data.split(b"\n")]
                lines = [line for line in lines if line]
                for i, line in enumerate(lines):
                    blocks = [line] + ([[w for x in lines[i : i + self.block_lines] for w in x]] if i + 1 < len(lines) else [])
                    for block in blocks:
                        if not self.prefix_words.isdisjoint(block):
                            for label, share in self.match(block).items():
                                found[label] = max(found.get(label, 0.0), share)
                for label, share in self.match_stretches(words, seen).items():
                    found[label] = max(found.get(label, 0.0), share)
        score = max([*found.values(), 1.0 if base else 0.0])
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), float(score)


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per document row; see the module's text."""
    counted = word_frequencies(docs, _vocabulary(templates, phrases))
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(counted, templates, phrases, threshold, block_lines))

    def make():
        scan = index.value.scan

        def each(ids, texts):
            for doc_id, text in zip(ids, texts):
                yield doc_id, *scan(text)

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, REPORT)
