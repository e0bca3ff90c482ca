"""Licence scans by a positional index of rare words.

The templates' words are counted over the whole corpus first: their document frequency gives
their IDF. Of each template the `rare` positions of highest IDF stand for it, and the index
is one map for all templates, from a word to its postings (template, position). A file looks its licence
words up in it, and each place of such a word votes for the starts (template, place - position).
At a start that was voted for, the template's rare positions are intersected with the file's words by their
relative positions: those in place must have a share of `agree` of their IDF. Only the rarest positions are looked up, just so many that the others
together have less than that, so no start is lost, and a template of which a file has no rare word costs nothing.
A candidate is verified by the template's mandatory key phrases near its place; its score is the share of the template's words in place.
Short phrases (PHRASES) are found the same way through their rarest word, at
every place where their words stand consecutively.

Null and empty texts have no words, no labels and a score of 0; a null doc_id stays null. Texts are read whole,
however long. Repeated rows are scanned each. Words of equal IDF are ordered by their bytes, then position. Other columns of the
table are not read, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: word sequences that must stand in the candidate's span
    keys: tuple[str, ...]


#: Passages of public licence notices, with their key phrases.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("hereby granted free of charge", "without restriction")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("agpl-3.0", "under the terms of the gnu affero general public license", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "are permitted provided")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses")),
    Template("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("affero general public license", "version 3")),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "endorse or promote products")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("express or implied warranty", "will the authors be held liable")),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining", "accompanying documentation")),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("accompanying materials", "eclipse public license")),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("extent possible under law", "related or neighboring rights")),
    Template("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("verbatim or modified copies", "as long as the name is changed")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


class Index:
    """One map from a word to its postings (template, position), with words ranked by document frequency."""

    def __init__(self, df: dict[bytes, int], n_docs: int, templates: Sequence[Template] = TEMPLATES, *, rare: int = 12, agree: float = 0.5, slack: int = 3):
        self.slack = slack
        #: in thousandths, so that sums are exact
        self.idf = {w: 1 + math.floor(1000 * math.log((n_docs + 2) / (df.get(w, 0) + 1))) for w in vocabulary(templates)}
        self.templates = [(t.label, t.words.encode().split(), [k.encode().split() for k in t.keys]) for t in templates]
        #: of each template: its positions of highest IDF with their IDF, and how much of it must be in place
        self.rare: list[list[tuple[int, int]]] = []
        self.needed: list[int] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, words, _) in enumerate(self.templates):
            rarest = sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], words[i], i))[:rare]
            weights = [self.idf[words[at]] for at in rarest]
            needed, rest = math.ceil(agree * sum(weights)), sum(weights)
            for at, weight in zip(rarest, weights, strict=True):
                if rest < needed:
                    break
                self.postings[words[at]].append((number, at))
                rest -= weight
            self.rare.append(list(zip(rarest, weights, strict=True)))
            self.needed.append(needed)
        self.phrases = []
        for phrase, label in PHRASES:
            words = phrase.encode().split()
            lead = max(range(len(words)), key=lambda i: (self.idf[words[i]], i))
            self.phrases.append((label, words, lead))
        self.asked = frozenset(self.postings) | {words[lead] for _, words, lead in self.phrases}

    def starts(self, places: dict[bytes, list[int]]) -> set[tuple[int, int]]:
        """The starts (template, place) that the rarest words vote for."""
        return {(number, p - at) for w, here in places.items() for number, at in self.postings.get(w, ()) for p in here}

    def scan(self, words: list[bytes]) -> tuple[list[int], list[str], list[str], float]:
        """Starts of all phrases, the base labels, all labels, and the best share of a template or phrase found in place."""
        places: dict[bytes, list[int]] = {w: [] for w in self.asked.intersection(words)}
        if not places:
            return [], [], [], 0.0
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        starts, base = [], set()
        for label, phrase, lead in self.phrases:
            found = [p - lead for p in places.get(phrase[lead], ()) if p >= lead and words[p - lead : p - lead + len(phrase)] == phrase]
            if found:
                starts += found
                base.add(label)
        score, own = 0.5 if base else 0.0, set()
        for number, start in self.starts(places):
            label, template, keys = self.templates[number]
            in_place = lambda at: 0 <= start + at < len(words) and words[start + at] == template[at]  # noqa: B023, E731
            if sum(weight for at, weight in self.rare[number] if in_place(at)) < self.needed[number]:
                continue
            span = words[max(0, start - self.slack) : max(0, start + len(template) + self.slack)]
            if all(any(span[i : i + len(k)] == k for i in range(len(span) - len(k) + 1)) for k in keys):
                own.add(label)
                score = max(score, sum(map(in_place, range(len(template)))) / len(template))
        return starts, sorted(base), sorted(base | own), score


def vocabulary(templates: Sequence[Template] = TEMPLATES) -> frozenset[bytes]:
    """The words of all templates and phrases."""
    return frozenset(w for s in [*(t.words for t in templates), *(p for p, _ in PHRASES)] for w in s.encode().split())


def frequencies(texts: DataFrame, templates: Sequence[Template] = TEMPLATES) -> tuple[dict[bytes, int], int]:
    """How many texts have each word of the vocabulary, and the number of texts."""
    licence = vocabulary(templates)

    def counted(them):
        n, seen = 0, Counter()
        for batch in them:
            n += batch.num_rows
            for raw in text.as_bytes(batch.column(0)):
                seen.update(licence.intersection(text.plain_words(raw)))
        yield pa.record_batch([pa.array(["", *(w.decode() for w in seen)]), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    counts = texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in counts}  # a row for each word of the vocabulary at most
    return df, df.pop(b"", 0)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES, **how: object) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs. templates: the notices to look for, in lower case; how: Index's parameters."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    index = docs.sparkSession.sparkContext.broadcast(Index(*frequencies(texts, templates), templates, **how))  # as large as the templates

    def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: Sequence[list] = ([], [], [], [], [], [], [])
        for raw in text.as_bytes(batch.column("text")):
            words = text.plain_words(raw)
            starts, base, labels, score = index.value.scan(words)
            row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return pa.record_batch([batch.column("doc_id"), *map(pa.array, out, kinds)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(text.batches(scanned), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
