"""License scans: exact phrases, and an exact set-similarity join of license templates with text blocks.

Templates are statements of a line and whole license texts. A block is a run of words that begins with a word of the template and
is as long as the template and its slack, the share of words that `percent` lets go. A template is found where a block holds
at least `percent` of the template's distinct words, all of its NAMES, and within the template's length no word of KIN, which
says that it is a sister of the license. A template of fewer than SHORT distinct words may miss one word that is no name instead,
and has to stand in its order within its length and one word more; that many stray words come together in any text.

Template words are put in order of their frequency over all documents, rarest first. A block that holds enough of a template
holds one of the first size - need + 1 words of it (prefix filter), so only the words around those are looked at. Such a stretch is
out if it has fewer words than are needed (length filter), or when, in the order, more words have been missed than may be missing
(positional filter: the matches so far and the words after this place don't reach what is needed). Blocks of what is left are
counted out exactly.

Scale: two maps over the scan. Between them goes one combined count for each template word, whose number is fixed by the
templates; so the broadcast is bounded. No text is shuffled.

Cases: null and empty texts have no words and no label, score 0. Repeated rows give repeated rows. A null id stays.
Ties of word frequency go by the word. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, raw_texts

#: Phrases that give a label wherever they stand.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: License statements and whole license texts by label.
TEMPLATES = {
    "agpl-3": ("licensed under the gnu affero general public license version 3",),
    "apache-2": (
        "licensed under the apache license version 2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
        "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out "
        "of the use of this software even if advised of the possibility of such damage",
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": ("licensed under cc by nc 4", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        "it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable "
        "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
}

#: Words that name a license or its version; a template with one of them missing is another license's text.
NAMES = frozenset(b"affero apache attribution cc commons creative general gnu mit mozilla nc noncommercial public 2 3 4".split())

#: Words that turn a license's name into that of a sister.
KIN = frozenset(b"affero lesser nc noncommercial noderivatives sharealike".split())

#: Distinct words from which on a template's words need no order.
SHORT = 10
PERCENT = 80

#: Bytes of words: letters, digits and all beyond ASCII, with A-Z in lower case; every other byte becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


class Template:
    """One template for a threshold: its words in frequency order, and what a block needs."""

    def __init__(self, label: str, text: str, frequency: dict[bytes, int], percent: int):
        words = words_of(text.encode())
        self.label, self.order = label, sorted({*words}, key=lambda w: (frequency.get(w, 0), w))
        self.words, self.length = frozenset(words), len(words)
        self.names = NAMES & self.words
        self.short = None
        if len(self.order) < SHORT:
            plain = [i for i, w in enumerate(words) if w not in NAMES]
            self.short = [[w for i, w in enumerate(words) if i != out] for out in plain]
            self.need, self.block = len(self.order) - 1, len(words) + 1
        else:
            self.need, self.block = -(-percent * len(self.order) // 100), len(words) + -(-(100 - percent) * len(words) // 100)
        self.prefix = frozenset(self.order[: len(self.order) - self.need + 1])

    def may_hold(self, present: set[bytes]) -> bool:
        """The positional filter on the words of a stretch."""
        missing = 0
        for w in self.order:
            if w not in present:
                missing += 1
                if len(self.order) - missing < self.need:
                    return False
        return True

    def holds(self, block: list[bytes]) -> bool:
        """Whether a block with enough of the words states this license."""
        if not self.names.issubset(block) or any(w in KIN and w not in self.words for w in block[: self.length]):
            return False
        return self.short is None or any(all(w in run for w in kept) for kept in self.short for run in [iter(block)])

    def best(self, words: list[bytes], near: list[int], tally: Counter) -> float:
        """Highest share of the template's words in a block that states it, 0 if none does. near: places of prefix words."""
        found, at = 0, 0
        while at < len(near):
            lo, end = max(0, near[at] - self.block + 1), near[at] + self.block
            while at < len(near) and near[at] < end:
                end = near[at] + self.block
                at += 1
            stretch = words[lo:end]
            tally["stretches"] += 1
            if len(stretch) < self.need:
                tally["length"] += 1
            elif not self.may_hold(set(stretch)):
                tally["position"] += 1
            else:
                tally["counted"] += 1
                found = max(found, self.counted(stretch))
        return found / len(self.order)

    def counted(self, stretch: list[bytes]) -> int:
        """The most distinct words of the template in a block of a stretch that states it; a block ends `block` words after its first."""
        places = [i for i, w in enumerate(stretch) if w in self.words]
        held, distinct, end, found = Counter(), 0, 0, 0
        for first in places:
            while end < len(places) and places[end] < first + self.block:
                w = stretch[places[end]]
                distinct += not held[w]
                held[w] += 1
                end += 1
            if distinct >= self.need and distinct > found and self.holds(stretch[first : first + self.block]):
                found = distinct
            held[stretch[first]] -= 1
            distinct -= not held[stretch[first]]
        return found


def word_counts(docs: DataFrame, words: frozenset[bytes]) -> dict[bytes, int]:
    """How often each of a bounded set of words stands in all texts."""

    def run(batches):
        for b in batches:
            seen = Counter()
            for raw in raw_texts(b):
                seen.update(filter(words.__contains__, words_of(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return {bytes(r.word): r.n for r in map_batches(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    vocabulary = frozenset(w for ts in templates.values() for t in ts for w in words_of(t.encode()))
    frequency = word_counts(docs, vocabulary)
    known = [Template(label, t, frequency, percent) for label, ts in sorted(templates.items()) for t in ts]
    wanted = [(tuple(words_of(p.encode())), label) for p, label in phrases.items()]

    def run(batches):
        # a phrase is looked for where its longest word stands
        anchors, starts, tally = defaultdict(list), defaultdict(list), Counter()
        for ws, label in wanted:
            at = max(range(len(ws)), key=lambda i: len(ws[i]))
            anchors[ws[at]].append((ws, at, label))
        for k, t in enumerate(known):
            for w in t.prefix:
                starts[w].append(k)
        marked = starts.keys() | anchors.keys()
        for b in batches:
            out = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), raw_texts(b), strict=True):
                words = words_of(raw)
                hits = [i for i, w in enumerate(words) if w in marked] if not marked.isdisjoint(words) else []
                base, best, places, near = set(), {}, [], defaultdict(list)
                for i in hits:
                    for ws, at, label in anchors.get(words[i], ()):
                        if i >= at and tuple(words[i - at : i - at + len(ws)]) == ws:
                            places.append(i - at)
                            base.add(label)
                    for k in starts.get(words[i], ()):
                        near[k].append(i)
                for k, at in near.items():
                    if share := known[k].best(words, at, tally):
                        best[known[k].label] = max(share, best.get(known[k].label, 0.0))
                out.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *best})), 1.0 if base else max(best.values(), default=0.0)))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(docs, run, SCHEMA)
