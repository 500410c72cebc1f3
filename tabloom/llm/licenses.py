"""Licence texts and notices in documents, by winnowed fingerprints and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabloom.llm.align import align, bands
from tabloom.llm.common import id_and_text, map_arrow
from tabloom.llm.seeds import Index, Vocabulary, grams, word_spans, words

GROUP_WORDS = 3
WINDOW = 2                   # four shared words in a row are sure to share a fingerprint
COVERAGE = 0.8               # share of a template's words that must be matched
BLOCK_WORDS = 1_000_000      # words of templates that are looked up in one pass

# fixed values: public licence texts and the notices that name them
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def winnowed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints: of every window of neighbouring word groups the one with the least hash.

    Groups with words outside the vocabulary lose to any other; the last of equals is taken.
    """
    places, hashes = grams(numbers, min(GROUP_WORDS, max(1, len(numbers))))
    if not len(places):
        return places, hashes
    # windows only matter where they hold a group of the vocabulary: each group is chosen unless, in every window that
    # covers it, a neighbour has a smaller hash
    chosen = np.zeros(len(places), dtype=bool)
    for shift in range(WINDOW):                       # the group is number ``shift`` of its window
        least = np.ones(len(places), dtype=bool)
        for other in range(WINDOW):
            if other != shift:
                at = np.searchsorted(places, places + other - shift)
                there = np.minimum(at, len(places) - 1)
                present = places[there] == places + other - shift
                wins = hashes < hashes[there] if other > shift else hashes <= hashes[there]
                least &= ~present | wins
        chosen |= least
    return places[chosen], hashes[chosen]


def license_spans(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE,
                  block_words: int = BLOCK_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every passage of a document that matches a template.

    Columns: ``doc_id``, ``license`` (name of the template), ``coverage`` (matched words as a share of the template's),
    ``matched_words``, ``first_char`` and ``end_char`` (the span, in characters from 0). Templates that are edited,
    wrapped or in other letter case are found as long as ``coverage`` of their words stand in order.

    Fingerprints of the templates form an inverted index that is broadcast in blocks of about ``block_words`` words, so
    its size is bounded whatever the number of templates. Documents are fingerprinted whole; only templates that share
    a fingerprint are aligned, in a band around the shared places. Documents are independent: nothing is shuffled.

    NULL and empty texts match nothing, nor do templates without words. Repeated documents give their rows each, a
    passage that matches several templates one row each. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_column, text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, license string, coverage double, matched_words int, first_char int, end_char int"
    blocks: list[list[tuple[str, list[bytes]]]] = [[]]
    for name, text in sorted(templates.items()):
        if found := words(text):
            if sum(len(w) for _, w in blocks[-1]) + len(found) > block_words:
                blocks.append([])
            blocks[-1].append((name, found))
    result = docs.sparkSession.createDataFrame([], schema)
    for block in blocks:
        if not block:
            continue
        vocabulary = Vocabulary(w for _, w in block)
        numbers = [vocabulary.of(w) for _, w in block]
        index = Index({(int(h), k, int(p)) for k, n in enumerate(numbers) for p, h in zip(*winnowed(n))})
        shared = docs.sparkSession.sparkContext.broadcast((vocabulary, index, numbers, [name for name, _ in block]))
        result = result.unionByName(map_arrow(rows, _matcher(shared, coverage), schema))
    return result


def _matcher(shared, coverage: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index, numbers, names = shared.value
        for batch in batches:
            out: list[tuple] = []
            for row, value in enumerate(batch["text"]):
                text = value.as_py()
                document = vocabulary.of(words(text))
                query, diagonal = index.hits(*winnowed(document))
                spans = word_spans(text) if len(query) else []
                for k in np.unique(query).tolist():
                    template = numbers[k]
                    found = {(a.text_start, a.text_end): a for a in (
                        align(template, document, low, high)
                        for low, high in bands(diagonal[query == k], min(max(1, len(template) // 4), 128)))}
                    for a in found.values():
                        if a.matches >= coverage * len(template):
                            out.append((row, names[k], a.matches / len(template), a.matches, spans[a.text_start][0],
                                        spans[a.text_end - 1][1]))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(columns[0])), pa.array(columns[1]), pa.array(columns[2]),
                     *(pa.array(c, pa.int32()) for c in columns[3:])],
                    ["doc_id", "license", "coverage", "matched_words", "first_char", "end_char"])
    return match
