"""Licence scans by a positional index of rare words.

Templates (short licence passages with the key phrases that must occur in them) are indexed by word: each word
has postings (template, position). Document frequencies of the templates' words over all documents give their
IDF. For each file, the occurrences of every template's highest-IDF words are looked up, postings are intersected
by relative position (file position minus template position must agree), and a place counts once the template's
key phrases stand there word for word. A phrase's rarest word is always looked up, so no place is missed.

Null and empty texts have no words and no labels. Repeated rows give equal rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.common import slices, table

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Passages of public licences; each lists the key phrases (part of the passage) that must stand there.
PASSAGES = [
    ("gpl", "this program is free software you can redistribute it and or modify it", ["free software you can redistribute it"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "gnu affero general public license", ["gnu affero general public license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms with or without modification"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("cc-by", "creative commons attribution", ["creative commons attribution"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["distribute this software for any purpose"]),
]
ANCHORS = 3

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits or of any other code points, A to Z lower-cased."""
    return text.encode().translate(_SPLIT).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]  # (position, phrase)
    base: bool


def templates() -> list[Template]:
    out = [Template(label, tuple(phrase.encode().split()), ((0, tuple(phrase.encode().split())),), True) for phrase, label in BASE.items()]
    for label, passage, keys in PASSAGES:
        words, found = tuple(passage.encode().split()), []
        for key in keys:
            phrase = tuple(key.encode().split())
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            found.append((at, phrase))
        out.append(Template(label, words, tuple(found), False))
    return out


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> DataFrame:
    """(word, docs) over all documents for a fixed vocabulary; each task sends a row per word and slice at most."""

    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            count = Counter()
            for t in batch.column(0).to_pylist():
                count.update(vocabulary.intersection(words_of(t or "")))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("docs"))


class PositionalIndex:
    """Postings of the templates' anchor words: word -> (template, position)."""

    def __init__(self, found: list[Template], idf: dict[bytes, float], anchors: int = ANCHORS):
        self.templates, self.idf, self.postings, self.needed = found, idf, defaultdict(list), []
        for k, t in enumerate(found):
            inside = {p for at, phrase in t.keys for p in range(at, at + len(phrase))}
            rare = sorted(inside, key=lambda p: (-idf.get(t.words[p], 0.0), p))[: min(anchors, len(inside))]
            self.needed.append(len(rare))
            for p in rare:
                self.postings[t.words[p]].append((k, p))

    def scan(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) of every place where a template's key phrases stand; start is its first key phrase's."""
        hits = [(i, w) for i, w in enumerate(words) if w in self.postings]
        votes = Counter((k, i - p) for i, w in hits for k, p in self.postings[w])
        out = []
        for (k, offset), n in votes.items():
            t = self.templates[k]
            if n == self.needed[k] and all(offset + at >= 0 and tuple(words[offset + at : offset + at + len(phrase)]) == phrase for at, phrase in t.keys):
                out.append((k, offset + t.keys[0][0]))
        return out

    def score(self, words: list[bytes], k: int, start: int) -> float:
        """Share of the template's IDF weight that stands at its place."""
        t = self.templates[k]
        first = start - t.keys[0][0]
        weight = [self.idf.get(w, 1.0) for w in t.words]
        there = sum(x for j, (w, x) in enumerate(zip(t.words, weight)) if 0 <= first + j < len(words) and words[first + j] == w)
        return there / sum(weight) if sum(weight) else 1.0


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, and places (label, start word)."""
    found = templates()
    vocabulary = {w for t in found for w in t.words}
    total = docs.count()
    counts = {r["word"].encode(): r["docs"] for r in document_frequencies(docs, vocabulary).collect()}  # a row per template word
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-9 for w in vocabulary}
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long>>"

    def run(batches):
        index = PositionalIndex(found, idf)
        for batch in slices(batches, "text"):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text or "")
                places = index.scan(words)
                base = [s for k, s in places if found[k].base]
                score = max((index.score(words, k, s) for k, s in places), default=0.0)
                labels = {found[k].label for k, _ in places}
                based = {found[k].label for k, _ in places if found[k].base}
                spots = sorted({(found[k].label, s) for k, s in places})
                rows.append((key, len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(based)), ",".join(sorted(labels)), min(1.0, score), [{"label": a, "start": s} for a, s in spots]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))]
            names = "doc_id n_words n_base first_word last_word base_labels labels score places".split()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")
