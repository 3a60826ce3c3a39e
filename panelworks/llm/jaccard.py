"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence.

A document's row holds its set of distinct word n-grams (lower-cased A to Z, words split at ASCII white space; with fewer
words than n the whole sequence is one), as 64-bit hashes. Equal sets are one row, a class. Two rows link when
overlap >= t * union, that is overlap >= t / (1 + t) * (size + size).

Bounds from the sizes alone thin the product:
- columns have one global order, rare n-grams first, by counts over all documents in ORDER_BUCKETS hashed places. A pair that
  links shares one of the first size - ceil(t * size) + 1 columns of both rows, so only these meet (any order is exact; a good
  one keeps columns that many rows have out of them);
- a row of size s links only with sizes from t * s to s / t;
- beyond its first columns a row of size s has ceil(t * s) - 1 more, so a pair must share enough of the first ones already:
  overlap counts are accumulated over them, and pairs that cannot reach their bound any more are discarded before any text is fetched;
- inside a block counts are accumulated slab by slab of columns, and a block ends once no pair can reach its bound.

Blocks: each row first meets the first row of its columns; these links give most of the components. Rows of different
components that still share columns then meet in tiles: a tile holds rows of one family (a component, or rows that share
most columns with one first row) up to TILE_GRAMS n-grams, and two tiles that share enough columns are multiplied once. A block
gives a spanning set of its links, never all its pairs. Components are found on Spark (panelworks.llm.components).

Null and empty texts have an empty set and link with nothing. Rows of equal doc_id each get a row; a null doc_id names a
component only where no other id is in it (the id is null then). Very long texts are one row, alone in a tile if need be.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.common import discard, slices, stored, table, texts
from panelworks.llm.components import min_labels
from panelworks.llm.passages import rolling, word_hashes

SHINGLE = 3
PERCENT = 90  # 100 * intersection >= PERCENT * union
ORDER_BUCKETS = 1 << 20
BLOCK = 4096  # places counted in one row
TILE_GRAMS = 1 << 17
SLAB = 4096
FEW = 1_000_000  # keys of 8 or 16 bytes that may be broadcast


def gram_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams."""
    words = word_hashes(text)
    return np.unique(rolling(words, min(shingle, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _places(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64) % ORDER_BUCKETS


def column_levels(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How often each hashed place of n-grams occurs, in quarters of a power of two: ORDER_BUCKETS bytes at any size of the corpus."""

    blocks = ORDER_BUCKETS // BLOCK

    def count(batches):
        counts = np.zeros(ORDER_BUCKETS, np.int32)
        for batch in slices(batches, "text"):
            sets = [gram_set(t, shingle) for t in texts(batch)]
            counts += np.bincount(_places(np.concatenate([*sets, np.zeros(0, np.uint64)])), minlength=ORDER_BUCKETS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array([c.tobytes() for c in counts.reshape(blocks, BLOCK)], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["block", "counts"])

    parts = docs.select("text").mapInArrow(count, "block int, counts binary").repartition("block")
    levels = np.zeros((blocks, BLOCK), np.uint8)
    for row in parts.mapInArrow(add, "block int, counts binary").collect():  # ORDER_BUCKETS numbers
        levels[row.block] = np.floor(4 * np.log2(np.maximum(np.frombuffer(row.counts, "<i8"), 1)))
    return levels.reshape(-1)


def incidence(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, n, same, prefix): size and 128-bit hash of each row's set, and its first columns; h is a hash of the text."""
    levels = docs.sparkSession.sparkContext.broadcast(column_levels(docs, shingle))

    def run(batches):
        order = levels.value
        for batch in slices(batches, "text"):
            sets = [gram_set(t, shingle) for t in texts(batch)]
            prefixes = []
            for s in sets:
                first = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                ranks = np.lexsort((s, order[_places(s)]))
                prefixes.append(s[ranks[:first]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["doc_id", "h", "n", "same", "prefix"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, n long, same binary, prefix array<long>")


def linked(sizes_a: np.ndarray, sizes_b: np.ndarray, overlap: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * overlap >= percent * union."""
    return (100 + percent) * overlap >= percent * (sizes_a[:, None] + sizes_b[None, :])


def block_product(rows_a: list[np.ndarray], rows_b: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """A boolean matrix of links between two lists of sorted sets: the incidence matrices' product, slab by slab of columns."""
    sizes = [np.array([len(r) for r in rows], np.int64) for rows in (rows_a, rows_b)]
    flat = [np.concatenate([*rows, np.zeros(0, np.uint64)]) for rows in (rows_a, rows_b)]
    columns = np.intersect1d(*(np.unique(f) for f in flat), assume_unique=True)
    places = []
    for rows, f in zip((rows_a, rows_b), flat):
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.searchsorted(columns, f)
        held = at < len(columns)
        held[held] = columns[at[held]] == f[held]
        order = np.argsort(at[held], kind="stable")
        places.append((owner[held][order], at[held][order]))
    overlap = np.zeros((len(rows_a), len(rows_b)), np.int64)
    rest = [np.bincount(owner, minlength=len(s)) for (owner, _), s in zip(places, sizes)]
    for low in range(0, len(columns), SLAB):
        slab = []
        for i, (owner, at) in enumerate(places):
            a, b = np.searchsorted(at, (low, low + SLAB))
            dense = np.zeros((len(sizes[i]), min(SLAB, len(columns) - low)), np.float32)
            dense[owner[a:b], at[a:b] - low] = 1
            rest[i] = rest[i] - np.bincount(owner[a:b], minlength=len(sizes[i]))
            slab.append(dense)
        overlap += np.rint(slab[0] @ slab[1].T).astype(np.int64)
        if not linked(*sizes, overlap + np.minimum(rest[0][:, None], rest[1][None, :]), percent).any():
            break
    return linked(*sizes, overlap, percent) & (sizes[0][:, None] > 0)


def spanning(met: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, its group's least id) that join what the boolean matrix joins."""
    keep_a, keep_b = met.any(axis=1), met.any(axis=0)
    met, ids_a, ids_b = met[keep_a][:, keep_b], ids_a[keep_a], ids_b[keep_b]
    if not met.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = np.iinfo(np.int64).max
    least_a, least_b = ids_a.copy(), ids_b.copy()
    while True:
        new_b = np.minimum(least_b, np.where(met, least_a[:, None], far).min(axis=0))
        new_a = np.minimum(least_a, np.where(met, new_b[None, :], far).min(axis=1))
        if (new_a == least_a).all() and (new_b == least_b).all():
            break
        least_a, least_b = new_a, new_b
    nodes, roots = np.concatenate((ids_a, ids_b)), np.concatenate((least_a, least_b))
    return nodes[nodes != roots], roots[nodes != roots]


def _few_first(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that have one of the keys: by broadcast while the keys are counted to be few, else by shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, "left_semi")


def _multiplied(docs: DataFrame, classes: DataFrame, blocks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of class ids within ``blocks`` (block, side, id): side 0 against side 1, whole texts, one block at a time."""
    blocks = stored(blocks, "blocks")
    wanted = stored(blocks.select("id").distinct().join(classes.select("id", F.coalesce("doc_id", F.lit(-1)).alias("key"), "h"), "id"), "wanted")
    keyed = docs.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("key"), F.xxhash64("text").alias("h"), "text")
    whole = _few_first(keyed, wanted.select("key", "h"), ["key", "h"]).dropDuplicates(["key", "h"]).join(wanted, ["key", "h"]).select("id", "text")
    rows = blocks.join(whole, "id").select("block", "side", "id", "text")

    def run(batches):
        block, held = None, ([], [], [], [])

        def links():
            if not held[0] or not held[1]:
                return []
            sizes = [len(s) for s in held[0]]
            out, start = [], 0
            while start < len(sizes):  # rows of side 0 in pieces, so that one product stays small whatever the block holds
                stop = start + max(1, min(len(sizes) - start, (1 << 22) // max(1, len(held[1]))))
                met = block_product(held[0][start:stop], held[1], percent)
                out.append(spanning(met, np.array(held[2][start:stop], np.int64), np.array(held[3], np.int64)))
                start = stop
            return out

        for batch in slices(batches, "text"):
            done = []
            for at, side, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != block:
                    done += links()
                    block, held = at, ([], [], [], [])
                held[side].append(gram_set(text, shingle))
                held[2 + side].append(key)
            yield from _arrow(done)
        yield from _arrow(links())

    def _arrow(done):
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[i] for d in done]), pa.int64()) for i in (0, 1)], ["a", "b"])

    found = stored(rows.repartition("block").sortWithinPartitions("block", "side").mapInArrow(run, "a long, b long").distinct(), "links")
    discard(blocks)
    discard(wanted)
    return found


def _labels(links: DataFrame) -> DataFrame:
    """(id, label) of every class that has a link."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return stored(min_labels(links, ends.withColumn("label", F.col("node"))).withColumnRenamed("node", "id"), "labels")


def _can_link(shared, low_a, low_b, most, percent: int):
    """Whether rows of at least ``low_a`` and ``low_b`` columns, of at most ``most``, that share so many of their first columns can reach the bound.

    Beyond its first columns a row has ceil(t * size) - 1 more; the row whose first columns end earlier shares at most those.
    """
    return (100 + percent) * (shared + F.ceil(percent * most / F.lit(100)) - 1) >= percent * (low_a + low_b)


def _star(cells: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, lead, shared), each row with the first rows of its columns; and the blocks of those whose bounds allow a link.

    ``shared`` counts only the columns that the lead is first in; what it lets slip meets in the tiles.
    """
    sizes = classes.select(F.col("id").alias("lead"), F.col("n").alias("lead_n"))
    met = cells.where("id != lead").groupBy("id", "n", "lead").agg(F.count(F.lit(1)).alias("shared")).join(sizes, "lead")
    met = stored(met.where(100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")), "star")
    able = met.where(_can_link(F.col("shared"), F.col("n"), F.col("lead_n"), F.greatest("n", "lead_n"), percent))
    parts = able.groupBy("lead").agg(F.ceil(F.sum("n") / TILE_GRAMS).alias("parts"))
    tiled = able.join(parts, "lead").select("id", "lead", F.xxhash64("lead", F.pmod(F.xxhash64("id"), "parts")).alias("block"))
    heads = tiled.select("block", F.lit(0).alias("side"), F.col("lead").alias("id")).distinct()
    return met, heads.unionByName(tiled.select("block", F.lit(1).alias("side"), "id"))


def _tiles(cells: DataFrame, met: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Blocks of rows of different components that share enough columns to reach the bound."""
    rows = cells.join(labels, "id", "left").select("gram", "place", "id", F.coalesce("label", "id").alias("comp"))
    held = rows.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("gram")
    rows = stored(rows.join(held, "gram"), "rest")
    home = met.where("shared > 1").groupBy("id").agg(F.max_by("lead", "shared").alias("home"))
    family = rows.select("id", "comp").distinct().join(labels, "id", "left").join(home, "id", "left")
    family = family.select("id", "comp", F.coalesce("label", "home", "id").alias("family")).join(classes.select("id", "n"), "id")
    parts = family.groupBy("family").agg(F.ceil(F.sum("n") / TILE_GRAMS).alias("parts"))
    tiled = family.join(parts, "family").select("id", "n", "comp", F.xxhash64("family", F.pmod(F.xxhash64("id"), "parts")).alias("tile"))
    tiled = stored(tiled, "tiled")
    columns = rows.select("gram", "place", "id").join(tiled, "id").groupBy("gram", "tile").agg(
        F.min("comp").alias("first"), F.max("comp").alias("last"), F.min("n").alias("low"), F.max("n").alias("most"), F.min("place").alias("place"), F.max("place").alias("place_to")
    )
    a, b = (columns.select("gram", *(F.col(c).alias(f"{c}_{x}") for c in columns.columns if c != "gram")) for x in "ab")
    apart = F.least("first_a", "first_b") < F.greatest("last_a", "last_b")
    near = (100 * F.col("most_a") >= percent * F.col("low_b")) & (100 * F.col("most_b") >= percent * F.col("low_a"))
    # of one row each: before a shared column at most the lesser place is shared, from it on at most what the shorter rest has
    single = (F.col("low_a") == F.col("most_a")) & (F.col("low_b") == F.col("most_b")) & (F.col("place_a") == F.col("place_to_a")) & (F.col("place_b") == F.col("place_to_b"))
    reach = F.least("place_a", "place_b") + F.least(F.col("low_a") - F.col("place_a"), F.col("low_b") - F.col("place_b"))
    placed = ~single | ((100 + percent) * reach >= percent * (F.col("low_a") + F.col("low_b")))
    pairs = a.join(b, "gram").where((F.col("tile_a") <= F.col("tile_b")) & apart & near & placed).groupBy("tile_a", "tile_b").agg(
        F.count(F.lit(1)).alias("shared"), F.min("low_a").alias("low_a"), F.min("low_b").alias("low_b"), F.max(F.greatest("most_a", "most_b")).alias("most")
    )
    pairs = pairs.where(_can_link(F.col("shared"), F.col("low_a"), F.col("low_b"), F.col("most"), percent))
    pairs = stored(pairs.select(F.col("tile_a").alias("ta"), F.col("tile_b").alias("tb")), "pairs")
    block = F.xxhash64("ta", "tb", F.lit("tiles")).alias("block")
    sides = [pairs.select(F.col(t).alias("tile"), block, F.lit(i).alias("side")) for i, t in enumerate(("ta", "tb"))]
    return sides[0].unionByName(sides[1]).join(tiled.select("tile", "id"), "tile").select("block", "side", "id")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): each row's set size and the smallest doc_id that links reach, its own included."""
    docs = docs.select("doc_id", "text")
    rows = stored(incidence(docs, shingle, percent), "incidence")
    classes = rows.where("n > 0").groupBy("same").agg(F.min(F.struct("doc_id", "h", "n", "prefix")).alias("one"), F.min("doc_id").alias("first"))
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "same", "one.doc_id", "one.h", "one.n", "one.prefix", "first")
    classes = stored(classes, "classes")
    cells = classes.select("id", "n", F.posexplode("prefix").alias("place", "gram"))
    leads = cells.groupBy("gram").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("gram", "lead")
    cells = stored(cells.join(leads, "gram"), "cells")
    met, blocks = _star(cells, classes, percent)
    links = _multiplied(docs, classes, blocks, shingle, percent)
    labels = _labels(links)
    more = _multiplied(docs, classes, _tiles(cells, met, classes, labels, percent), shingle, percent)
    every = stored(links.unionByName(more), "every")
    found = _labels(every)
    least = classes.join(found, "id").groupBy("label").agg(F.min("first").alias("least"))
    named = classes.join(found, "id", "left").join(least, "label", "left").select("same", F.coalesce("least", "first").alias("component_id"))
    out = rows.join(named, "same", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = stored(out, "jaccard")
    for t in (rows, classes, cells, met, links, labels, more, every, found):
        discard(t)
    return out


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, list_aggregate(w[i : i + 2], 'string_agg', ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (
  SELECT x.r AS a, y.r AS b FROM s x JOIN s y ON x.g = y.g JOIN n p ON p.r = x.r JOIN n q ON q.r = y.r
  WHERE 10 * least(p.n, q.n) >= 9 * greatest(p.n, q.n)
  GROUP BY x.r, y.r, p.n, q.n HAVING 190 * count(*) >= 90 * (p.n + q.n)
), reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, m.id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT a AS r, min(o.doc_id) AS id FROM reach JOIN d o ON o.r = reach.b GROUP BY a) m USING (r)
"""
