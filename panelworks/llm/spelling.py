"""Spelling variants: words at edit distance one, found by an index of variable-length grams.

Dictionary: a gram of ``SHORTEST`` to ``LONGEST`` letters is cut where it stops being frequent. A gram that more than ``LIST``
word places begin with is frequent and goes on by another letter (at most ``MOST`` frequent grams, the commonest first; which
ones are kept changes the work, not the result). Words get a mark in front and ``LONGEST - 1`` behind.

Decomposition: from each place of a word the shortest gram that isn't frequent. It depends on the letters from its own place on
only, so one edit changes just the grams that cover it: a word's bound is the most grams that cover one of its letters
(at most ``LONGEST``, and there are more grams than that in any word of ``LEAST_LETTERS``).

List merging: words one edit apart share at least (grams - bound) grams, so they meet in the bound + 1 shortest lists of each.
A shared gram lies at the same place, or, in a word with a letter more, at the same place or the next: lists are keyed by (gram,
length, place), and every merge is an equi-join, whose pairs the exact distance verifies at once. Marks and equal grams within a
word need no care, as matches keep their order.

Words are counted over all documents in bounded memory (a counter a task, given out when it holds ``HELD`` words) and then by
Spark. A null or empty text has no words; a null doc_id counts as the empty text in the edit rule; repeated rows count each;
equal n is decided by code points. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.common import discard, slices, stored, table, texts

LEAST_LETTERS = 6
LEAST_COUNT = 5
EDIT_EVERY = 199
FORM_TIMES = 5
SHORTEST, LONGEST = 2, 5
LIST = 64
MOST = 200_000
HELD = 400_000
FRONT, BACK = "^", "$"

# Runs of A-Z, a-z and U+00C0 to U+00FF as UTF-8: the latter are the byte C3 and a byte of 80 to BF.
_OTHER = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]*")
_RUNS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """The text's runs of letters of at least LEAST_LETTERS bytes, A to Z lower-cased, in UTF-8."""
    return [w for w in _OTHER.sub(b" ", text.encode()).translate(_RUNS).lower().split() if len(w) >= LEAST_LETTERS]


def edited(run: bytes, h: int) -> bytes:
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, every: int = EDIT_EVERY) -> DataFrame:
    """(word, n): how often each word of LEAST_LETTERS code points or more occurs, LEAST_COUNT times at least.

    In a document, runs for which crc32 of ``<doc_id>:<run>`` is divisible by ``every`` lose a letter first.
    """

    def given(counts):
        held = [(w, n) for w, n in counts.items() if n]
        for i in range(0, len(held), 1 << 16):
            part = held[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    def run(batches):
        counts = Counter()
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
                runs, start = runs_of(text), zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                counts.update(runs)
                for w in runs:
                    h = zlib.crc32(w, start)
                    if not h % every:
                        counts[w] -= 1
                        counts[edited(w, h)] += 1
            if len(counts) > HELD:
                yield from given(counts)
                counts = Counter()
        yield from given(counts)

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").where(F.char_length("word") >= LEAST_LETTERS)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _marked(word: str) -> str:
    return FRONT + word + BACK * (LONGEST - 1)


def frequent_grams(words: DataFrame) -> frozenset[str]:
    """The grams that go on, at most MOST of them; with a gram its beginnings are always there."""

    def run(batches):
        for batch in batches:
            counts = Counter()
            for word in batch.column(0).to_pylist():
                s = _marked(word)
                for q in range(SHORTEST, LONGEST):
                    counts.update([s[p : p + q] for p in range(len(word) + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    counts = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    kept = counts.where(F.col("n") > LIST).orderBy(F.desc("n"), F.char_length("gram"), "gram").limit(MOST)
    return frozenset(r.gram for r in kept.select("gram").toLocalIterator())


def decompose(word: str, frequent: frozenset[str]) -> list[str]:
    """The gram of each place, from the mark in front on."""
    s, out = _marked(word), []
    for p in range(len(word) + 1):
        q = SHORTEST
        while q < LONGEST and s[p : p + q] in frequent:
            q += 1
        out.append(s[p : p + q])
    return out


def affected(grams: list[str]) -> int:
    """The most grams that one edit can change: those that cover one letter."""
    steps = [0] * (len(grams) + LONGEST + 1)
    for p, g in enumerate(grams):
        steps[p] += 1
        steps[p + len(g)] -= 1
    most = now = 0
    for i, step in enumerate(steps[: len(grams)]):
        now += step
        most = max(most, now if i else 0)
    return most


def gram_index(words: DataFrame) -> DataFrame:
    """(word, size, bound, place, gram): a row a gram."""
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words))

    def run(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            grams = [decompose(w, frequent.value) for w in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in found], pa.int32()), pa.array([affected(g) for g in grams], pa.int32()), pa.array(grams, pa.list_(pa.string()))],
                ["word", "size", "bound", "grams"],
            )

    rows = words.select("word").mapInArrow(run, "word string, size int, bound int, grams array<string>")
    return rows.select("word", "size", "bound", F.posexplode("grams").alias("place", "gram"))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): all pairs of words one edit apart; b has a letter more, or as many and comes later in code-point order."""
    index = stored(gram_index(words), "grams")
    lists = index.groupBy("gram").agg(F.count(F.lit(1)).alias("length"))
    order = Window.partitionBy("word").orderBy("length", "gram", "place")
    short = index.join(lists, "gram").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("bound") + 1)
    short = stored(short.select("word", "size", "place", "gram"), "lists")

    def key(size: int, place: int):
        return F.xxhash64("gram", F.col("size") + size, F.col("place") + place)

    probes = short.select(F.col("word").alias("a"), F.explode(F.array(key(0, 0), key(1, 0), key(1, 1))).alias("key"))
    held = short.select(F.col("word").alias("b"), key(0, 0).alias("key"))
    size_a, size_b = F.char_length("a"), F.char_length("b")
    ordered = (size_a < size_b) | ((size_a == size_b) & (F.col("a") < F.col("b")))
    pairs = probes.join(held, "key").where(ordered & (F.levenshtein("a", "b", 1) == 1))
    found = stored(pairs.select("a", "b").distinct(), "near")
    discard(index)
    discard(short)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word of each chain. Steps double, and n grows five-fold along a chain, so rounds are few."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.where("moved").head(1):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        nxt = stored(nxt, "roots")
        discard(now)
        now = nxt
    return now.select("word", "root")


def variant_groups(docs: DataFrame, every: int = EDIT_EVERY, times: int = FORM_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word's commonest near word where that is ``times`` as common, and the end of its chain."""
    words = stored(word_counts(docs, every), "words")
    near = near_words(words)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("word", "near")
    both = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    rows = stored(rows, "forms")
    ends = roots(rows.where("form IS NOT NULL"))
    out = rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = stored(out, "variants")
    for t in (words, near, rows, ends):
        discard(t)
    return out


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents"))
