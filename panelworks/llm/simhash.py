"""SimHash near-duplicates by multi-index hashing.

Fingerprints: each text is lower-cased (A to Z), split at ASCII white space and cut into word shingles,
repeats included; a bit is 1 if it is set in over half of the shingles' XXH64 values.

Search: distinct fingerprints are split into ``segments`` parts. If two fingerprints differ in at most
``radius`` bits, one of the first ``b + 1`` parts differs in at most ``a`` bits or one of the others in at most
``a - 1`` (radius = segments * a + b). So each fingerprint enumerates those small Hamming balls, fetches the
table's matches by an equi-join on (segment, value), and the join verifies the whole distance. Copies meet only
once, as one fingerprint. The links go to connected components on Spark (panelworks.llm.components).

Null and empty texts have the fingerprint zero and are linked like any other. Rows with equal doc_id each get a
row; a null doc_id never names a component while a group holds another. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.common import discard, durable, slices, stored, table, texts
from panelworks.llm.components import min_labels
from panelworks.llm.passages import mix, rolling, word_hashes

SHINGLE = 3
RADIUS = 2
SEGMENTS = 2
SEED = 42
# The deduplicating stage: five-word shingles, similarity 0.8.
DEDUP_SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20  # of BAND_ROWS min-hashes: a pair at 0.8 shares a band in 1 - (1 - 0.8 ** 5) ** 20 = 0.9996 of cases
BAND_ROWS = 5
# Two texts with a similarity of 0.8 differ in 51 of these bits on average, with a standard deviation of 7.
SKETCH_BITS = 512
SKETCH_RADIUS = 76
BROADCAST_IDS = 1_000_000  # 8 bytes each
TILE = 128
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, SKETCH_BITS, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + 65536], stops[i : i + 65536])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _segments(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, width, most differing bits) of each segment that is looked up."""
    a, b = divmod(radius, segments)
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(edges[i], edges[i + 1] - edges[i], most) for i in range(segments) if (most := a if i <= b else a - 1) >= 0]


def _value(fp, start: int, width: int):
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _cells(fps: DataFrame, parts: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``fps`` once for each (segment, value) of the small Hamming balls around ``fp``, and once for each of its own."""

    def ball(i: int, start: int, width: int, most: int):
        masks = [sum(1 << p for p in at) for r in range(most + 1) for at in combinations(range(width), r)]
        own = _value("fp", start, width)
        return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.struct(F.lit(i).alias("segment"), own.bitwiseXOR(m).alias("value")))

    balls = F.concat(*(ball(i, *part) for i, part in enumerate(parts)))
    homes = F.array(*(F.struct(F.lit(i).alias("segment"), _value("fp", start, width).alias("value")) for i, (start, width, _) in enumerate(parts)))
    return tuple(fps.select("*", F.explode(at).alias("at")).select(*fps.columns, "at.segment", "at.value") for at in (balls, homes))


def hamming_links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``fp`` that differ in at most ``radius`` bits."""
    probes, homes = _cells(fps.select("fp"), _segments(radius, segments))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return probes.withColumnRenamed("fp", "a").join(homes.withColumnRenamed("fp", "b"), ["segment", "value"]).where(near).select("a", "b").distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach, the row's own included."""
    prints = durable(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = durable(hamming_links(nodes.select("fp"), radius, segments))
    linked = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    labels = min_labels(links, linked.select(F.col("fp").alias("node"), F.col("fp").alias("label"))).withColumnRenamed("node", "fp")
    least = nodes.join(labels, "fp").groupBy("label").agg(F.min("first_id").alias("least"))  # several fingerprints can have one smallest doc_id
    classes = nodes.join(labels, "fp", "left").join(least, "label", "left").select("fp", F.coalesce("least", "first_id").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def _minima(text: str) -> np.ndarray:
    """SKETCH_BITS min-hashes of the text's set of five-word shingles."""
    words = word_hashes(text)
    shingles = rolling(words, min(DEDUP_SHINGLE, len(words))) if len(words) else np.zeros(1, np.uint64)
    least = np.full(SKETCH_BITS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, np.multiply.outer(_FACTORS, shingles[i : i + 1024]).min(axis=1), out=least)
    return least


def _signs(least: np.ndarray) -> np.ndarray:
    """One bit of each min-hash, as signed 64-bit integers."""
    return np.packbits((least >> np.uint64(24)).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def _sketch(text: str) -> np.ndarray:
    return _signs(_minima(text))


def _bands(least: np.ndarray) -> np.ndarray:
    """A hash of each band's number and min-hashes."""
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _word_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, same, fp, bands, sketch): a 128-bit hash of the text's words, its fingerprint of five-word shingles, its min-hash
    bands with the fingerprint as one more, its min-hash sketch."""

    def run(batches):
        for batch in slices(batches, "text"):
            found = texts(batch)
            same = [xxhash.xxh3_128_digest(b" ".join(t.encode().lower().split())) for t in found]
            minima = [_minima(t) for t in found]
            fps = np.array([fingerprint(t, DEDUP_SHINGLE) for t in found], np.uint64).view(np.int64).tolist()
            longs = pa.list_(pa.int64())
            bands = pa.array([[*_bands(m).tolist(), fp] for m, fp in zip(minima, fps)], longs)
            columns = [batch.column(0), pa.array(same, pa.binary()), pa.array(fps, pa.int64()), bands, pa.array([_signs(m).tolist() for m in minima], longs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "same", "fp", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, same binary, fp long, bands array<long>, sketch array<long>")


def _shingle_set(text: str | None) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + DEDUP_SHINGLE]) for i in range(max(1, len(words) - DEDUP_SHINGLE + 1))}


def _ids_first(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """A semi or anti join on doc_id: by broadcast while the ids are counted to be few, else by shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def near_duplicate_links(docs: DataFrame, prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of doc_ids: different texts with a Jaccard similarity of their five-word shingles of ``similarity`` or more.

    Candidates: texts whose SimHash fingerprints differ in at most RADIUS bits (multi-index hashing, as ``hamming_links`` does
    it), and, since a similarity of 0.8 can turn more bits, texts that share one of BANDS bands of min-hashes and whose min-hash
    sketches differ in at most SKETCH_RADIUS bits; these depend on the similarity alone, not on where the texts differ. Every candidate is
    verified on whole texts. First each text meets the first text near its fingerprint and of its bands, which joins large groups
    of near copies; then all candidates meet unless links join them already, so the links give the components of all pairs.
    """
    one = prints.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch"))
    one = durable(one.drop("same"))
    near = durable(_near_prints(one))
    one = one.drop("fp")
    sketches = one.select("doc_id", "sketch")
    cells = one.select("doc_id", F.posexplode("bands").alias("band", "cell"))
    leads = cells.groupBy("cell").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").drop("last")
    cells = durable(cells.join(leads, "cell"))
    star = cells.where("lead < doc_id").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    star = star.join(sketches.toDF("a", "sketch"), "a").join(sketches.toDF("b", "sketch_b"), "b").where(_differing() <= SKETCH_RADIUS).select("a", "b")
    star = star.unionByName(near.groupBy("a").agg(F.min("b").alias("b")))
    some = durable(_verified(docs, star.select("a", "b", F.col("b").alias("g")), similarity))
    ends = some.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    classes = min_labels(some, ends.withColumn("label", F.col("node")))
    cells = cells.drop("lead").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    cells = durable(cells.select("cell", "band", "doc_id", F.coalesce("label", "doc_id").alias("known")))
    for c in ("a", "b"):
        near = near.join(classes.toDF(c, f"known_{c}"), c, "left").withColumn(f"known_{c}", F.coalesce(f"known_{c}", c))
    apart = near.where("known_a <> known_b").select("a", "b", F.col("known_b").alias("g"))
    return some.unionByName(_verified(docs, _band_mates(cells, one).unionByName(apart), similarity))


def _near_prints(one: DataFrame) -> DataFrame:
    """(a, b), a > b: the first texts of different fingerprints that differ in at most RADIUS bits. Equal ones meet as a band."""
    firsts = one.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = hamming_links(firsts.select("fp")).withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    met = links.join(firsts.toDF("fp_a", "x"), "fp_a").join(firsts.toDF("fp_b", "y"), "fp_b")
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _differing():
    return sum(F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_BITS // 64))


def _band_mates(cells: DataFrame, one: DataFrame) -> DataFrame:
    """(a, b, g): texts of different groups ``known`` that share a cell and have near sketches; g is b's group.

    The group with most texts in a cell never meets itself there, and two texts meet in the first band they share only.
    """
    held = cells.groupBy("cell", "known").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("cell").agg(F.min("known").alias("low"), F.max("known").alias("high"), F.max_by("known", "n").alias("crowd"))
    rows = cells.join(held.where("low < high").select("cell", "crowd"), "cell").join(one, "doc_id")
    rows = durable(rows.select("cell", "band", "doc_id", "known", "sketch", "bands", (F.col("known") == F.col("crowd")).cast("int").alias("side")))
    probes = rows.where("side = 0").select("cell", "band", F.col("doc_id").alias("a"), "known", "sketch", "bands")
    homes = rows.select("cell", F.col("doc_id").alias("b"), F.col("known").alias("known_b"), F.col("sketch").alias("sketch_b"), F.col("bands").alias("bands_b"), "side")
    once = (F.col("side") == 1) | (F.col("a") < F.col("b"))
    earlier = F.lit(False)
    for i in range(BANDS):  # the fingerprint is the last
        earlier |= (F.col("band") > i) & (F.col("bands")[i] == F.col("bands_b")[i])
    met = probes.join(homes, "cell").where(once & (F.col("known") != F.col("known_b")) & (_differing() <= SKETCH_RADIUS) & ~earlier)
    return met.select("a", "b", F.col("known_b").alias("g"))


def _verified(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are as similar.

    The pairs of a group ``g`` are cut into tiles of about TILE by TILE texts, so a text is sent once a tile and not
    once a pair, and a task holds one tile at a time.
    """
    pairs = stored(pairs.distinct(), "pairs")
    parts = [pairs.select("g", c).distinct().groupBy("g").agg(F.ceil(F.count(F.lit(1)) / TILE).alias(f"{c}_tiles")) for c in ("a", "b")]
    sizes = stored(parts[0].join(parts[1], "g"), "sizes")  # a row a group
    tile = F.xxhash64("g", F.pmod(F.xxhash64("a"), "a_tiles"), F.pmod(F.xxhash64("b"), "b_tiles"))
    tiled = stored(pairs.join(sizes, "g").select(tile.alias("tile"), "a", "b"), "tiles")
    members = stored(tiled.select("tile", F.col("a").alias("doc_id")).distinct().unionByName(tiled.select("tile", F.col("b").alias("doc_id")).distinct()).distinct(), "members")
    whole = _ids_first(docs.select("doc_id", "text"), members.select("doc_id").distinct(), "left_semi")
    held = members.join(whole, "doc_id").select("tile", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), F.coalesce("text", F.lit("")).alias("text"))
    rows = held.unionByName(tiled.select("tile", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))

    def run(batches):
        at, sets = None, {}
        for batch in slices(batches, "text"):
            kept = []
            for tile, kind, a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != at:
                    at, sets = tile, {}
                if kind == 0:
                    sets.setdefault(a, []).append(_shingle_set(text))
                elif any(len(s & t) >= similarity * (len(s) + len(t) - len(s & t)) for s in sets.get(a, ()) for t in sets.get(b, ())):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    found = stored(rows.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(run, "a long, b long").distinct(), "verified")
    for table_ in (pairs, sizes, tiled, members):
        discard(table_)
    return found


def keep_first_of_each(docs: DataFrame) -> DataFrame:
    """Documents without near-duplicates: of each group only the document with the smallest doc_id stays.

    Groups are the components of equal texts and of near_duplicate_links. All columns stay. Of rows with equal
    doc_id and text the least stays, by its columns in order; rows of one doc_id with different texts are one document, which goes if one of
    them has a group with a smaller doc_id. Rows without doc_id are kept.
    """
    known = docs.where("doc_id IS NOT NULL")
    prints = durable(_word_prints(known))
    links = durable(near_duplicate_links(known, prints))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = min_labels(links, ends.withColumn("label", F.col("node")))
    firsts = prints.groupBy("same").agg(F.min("doc_id").alias("node"))
    owner = firsts.join(labels, "node", "left").select("same", F.coalesce("label", "node").alias("stays"))
    gone = prints.join(owner, "same").where("doc_id > stays").select("doc_id").distinct()
    kept = _ids_first(known, durable(gone), "left_anti").select(*(f"`{c}`" for c in docs.columns))
    again = prints.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.head(1):  # repeated rows of one doc_id
        kept = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*(f"`{c}`" for c in docs.columns))).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
