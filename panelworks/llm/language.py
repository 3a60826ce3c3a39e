"""Language identification with string kernels.

Kernel: two texts share a blended-spectrum presence kernel, the number of distinct 1- to 4-grams of letters that
occur in both, divided by the geometric mean of their distinct n-grams. Landmarks from the training sample give a
Nyström feature map, on which one-versus-rest ridge regression is fitted. Since K(x, L) A = X (L' A) / sqrt(|x|),
with the sparse presence rows X and the landmarks' rows L, a batch of documents is scored by the product of its
presence rows with one (n-gram, language) matrix. The n-grams are counted in 2 ** BITS hashed places, so two that share
a place count as one.

Training uses at most ``PER_LANG`` labelled rows a language (rounded up over ``SALTS`` equal shares), the first by
a hash of doc_id. Fitting happens on the driver over that bounded sample; scoring covers all rows.

Null texts, texts without letters, and all texts when there is nothing to learn from are ``und`` with score 0. Equal
texts get equal predictions; ties go to the language that sorts first. Null doc_ids are never held out nor learned
from. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.common import slices, table

ORDERS = (1, 2, 3, 4)
BITS = 18
PER_LANG = 256
SALTS = 32
LANDMARKS = 128
RIDGE = 1e-3
# Without evidence all sums are near 0, so the score is 0.5 and the best two differ little.
LEAST_SCORE = 0.525
LEAST_MARGIN = 0.25
PIECE = 1 << 18  # n-grams in one product

_TABLES: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and a scratch slot per n-gram bucket."""
    if not _TABLES:
        _TABLES["letters"] = np.array([chr(i).isalpha() for i in range(0x110000)])
        _TABLES["slots"] = np.zeros(1 << BITS, np.int64)
    return _TABLES["letters"], _TABLES["slots"]


def grams(text: str) -> np.ndarray:
    """The distinct n-gram buckets of a text, empty without letters. Everything but letters counts as one blank."""
    letters, slots = _tables()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of a run of blanks, the first stays
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
    found = []
    rolling = np.zeros(len(codes), np.uint32)
    for n in ORDERS:
        rolling = rolling[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        found.append(((rolling ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    at = np.concatenate(found).astype(np.int64)
    mine = np.arange(len(at))
    slots[at] = mine
    return at[slots[at] == mine]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_grams(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, np.ndarray]]:
    """(lang, n-grams) of the bounded sample of labelled rows."""
    key = F.xxhash64("doc_id")
    labelled = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    first = Window.partitionBy("lang", F.pmod(key, F.lit(SALTS))).orderBy(key, "doc_id")
    chosen = labelled.select("doc_id", "lang", F.row_number().over(first).alias("n")).where(F.col("n") <= math.ceil(per_lang / SALTS))
    ids = chosen.select("doc_id").distinct()

    def run(batches):
        for batch in slices(batches, "text"):
            found = [grams(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["lang", "grams"])

    sample = labelled.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")  # at most per_lang ids a language
    rows = sample.mapInArrow(run, "lang string, grams array<long>").collect()
    return sorted(((r["lang"], np.array(r["grams"], np.int64)) for r in rows if r["grams"]), key=lambda x: (x[0], len(x[1]), x[1].tobytes()))


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """The languages and the (n-gram bucket, language) matrix L' A."""
    langs = sorted({lang for lang, _ in sample})
    weights = np.zeros((1 << BITS, len(langs)), np.float32)
    if not langs:
        return langs, weights
    each = max(1, landmarks // len(langs))
    by_lang = {lang: [g for own, g in sample if own == lang] for lang in langs}
    marks = [own[i * len(own) // min(each, len(own))] for own in by_lang.values() for i in range(min(each, len(own)))]
    flat = np.concatenate([g for _, g in sample])
    starts = np.cumsum([0] + [len(g) for _, g in sample[:-1]])
    sizes = np.array([len(g) for _, g in sample], float)

    def kernel(mark: np.ndarray) -> np.ndarray:
        there = np.zeros(1 << BITS, np.int64)
        there[mark] = 1
        return np.add.reduceat(there[flat], starts) / np.sqrt(sizes * len(mark))

    cross = np.stack([kernel(m) for m in marks], axis=1)
    presence = [np.isin(np.arange(1 << BITS), m, assume_unique=True) for m in marks]
    own = np.array([[np.count_nonzero(b[m]) / math.sqrt(len(m) * len(n)) for m in marks] for b, n in zip(presence, marks)])
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = cross @ root
    target = np.array([[1.0 if lang == own_lang else -1.0 for lang in langs] for own_lang, _ in sample])
    gram = features.T @ features + ridge * len(sample) * np.eye(features.shape[1])
    dual = root @ np.linalg.solve(gram, features.T @ target)
    for mark, row in zip(marks, dual):
        weights[mark] += (row / math.sqrt(len(mark))).astype(np.float32)
    return langs, weights


def products(presence: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The product of the sparse presence rows, each divided by its length's root, with the weights: a row per text."""
    sizes = np.array([len(p) for p in presence])
    out = np.zeros((len(presence), weights.shape[1]))
    full = np.flatnonzero(sizes)
    at = 0
    while at < len(full):  # as many texts at once as hold about PIECE n-grams, or one that holds more
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[full[at:]]), PIECE, "right")))
        rows = full[at:stop]
        flat = np.concatenate([presence[i] for i in rows])
        starts = np.concatenate(([0], np.cumsum(sizes[rows])[:-1]))
        out[rows] = np.add.reduceat(weights[flat].astype(np.float64), starts, axis=0) / np.sqrt(sizes[rows])[:, None]
        at = stop
    return out


def identify(docs: DataFrame, langs: list[str], weights: np.ndarray, margin: bool = False) -> DataFrame:
    """All columns of docs with lang_pred and score (present ones are replaced).

    With ``margin`` also lang_margin, the best language's sum less the next one's (less 0 if there is one language).
    """
    added = [("lang_pred", "string"), ("score", "double"), *([("lang_margin", "double")] if margin else [])]
    kept = docs.drop(*(name for name, _ in added))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS rows

    def run(batches):
        table_ = shared.value
        for batch in slices(batches, "text"):
            preds, scores, margins = [], [], []
            presence = [grams(text or "") for text in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            for found, sums in zip(presence, products(presence, table_)):
                if not len(found) or not langs:
                    preds.append("und")
                    scores.append(0.0)
                    margins.append(0.0)
                    continue
                best = int(np.argmax(sums))
                preds.append(langs[best])
                scores.append(float(min(1.0, max(0.0, (sums[best] + 1) / 2))))
                margins.append(float(sums[best] - np.delete(sums, best).max(initial=0.0 if len(langs) == 1 else -np.inf)))
            new = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())][: len(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(name for name, _ in added)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *(f"{name} {kind}" for name, kind in added)])
    return kept.mapInArrow(run, schema)


def identify_language(docs: DataFrame) -> DataFrame:
    return identify(docs, *fit(training_grams(docs)))


def known_language(docs: DataFrame, least_score: float = LEAST_SCORE, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """Documents whose language is known. The columns of docs stay.

    What is und goes, and what has neither the score nor the margin of a learned language: other scripts and noise.
    """
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "lang", "text")
    found = identify(rows.select("row", "text"), *fit(training_grams(docs)), margin=True)
    known = (F.col("lang_pred") != "und") & ((F.col("score") >= least_score) | (F.col("lang_margin") >= least_margin))
    return found.where(known).select("row.*").select(*names)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), *fit(training_grams(docs)))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
