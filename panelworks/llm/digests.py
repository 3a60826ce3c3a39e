"""Document fingerprints: improbable-feature digests.

Every 16-byte window of a text has an entropy; a histogram of all documents' windows tells how rare each entropy
is. In every run of 16 consecutive windows the rarest (leftmost of equals) gets a point, and windows with enough
points are the text's features. Their hashes set five bits each in a 2,048-bit Bloom filter, and a full filter
(160 features) starts the next one of the chain. Likeness: each filter of the shorter chain meets its best partner in
the other; common bits count beyond what chance gives, normalised to 0..1, and the mean is taken.

The entropy of all windows is exact integer arithmetic on running sums, so equal texts have equal fingerprints
wherever they lie. The rule is one for all lengths: a text with fewer windows than a run has one run of all its
windows, a text in which no window has enough points has its rarest window as its feature, and a text shorter than a
window is filled up with zero bytes. The empty text has no feature. Two equal fingerprints have likeness 1, the empty text has
likeness 0 to any other.

``with_next`` finds each row's successor by descending doc_id without a global sort: rows go to ranges of doc_id,
each range also gets the first row of the next range, and tasks stream over their sorted ranges. Rows of equal
doc_id are ordered by text; a null doc_id counts as the smallest. Null texts are empty. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.common import slices, table

WINDOW = 16
RUN = 16
BINS = 1000
LOW = 100  # bins of entropies that long runs of few bytes have; never selected
POINTS = 4
PER_FILTER = 160
BITS = 2048
HASHES = 5
CUTOFF = 0.3
SLICE = 1 << 18

_MOST = int(np.log2(WINDOW)) << 20  # the entropy of a window of different bytes
_F = np.rint(np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1)) * (1 << 20)).astype(np.int64)
_GAIN = np.diff(_F)  # what one more equal byte adds to the sum of c log2 c


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The entropy bin (0 to BINS - 1) of every window of a byte array."""
    size = len(data)
    before, after = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    for d in range(1, min(WINDOW, size)):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    inward = np.concatenate(([0], np.cumsum(_GAIN[before])))
    outward = np.concatenate(([0], np.cumsum(_GAIN[after])))
    total = inward[WINDOW:] - outward[: size - WINDOW + 1]  # sum of c log2 c over the window's bytes
    share = _MOST * WINDOW - total  # entropy, times WINDOW << 20
    return np.clip(share * BINS // (_MOST * WINDOW), 0, BINS - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def digest(batch: list[bytes], rarity: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(features, filters as rows of 32 words) of each text; ``rarity`` has a rank per bin, lowest first."""
    lengths = np.array([len(t) and max(len(t), WINDOW) for t in batch], np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(t and t.ljust(WINDOW, b"\0") for t in batch) + bytes(WINDOW + RUN), np.uint8)
    bins = entropy_bins(data)
    full = np.flatnonzero(lengths)
    start, windows = offsets[:-1][full], lengths[full] - WINDOW + 1

    def inside(first, n):  # of the places, those among the n from each first on
        marks = np.zeros(len(data) + 1, np.int64)
        np.add.at(marks, first, 1)
        np.add.at(marks, first + n, -1)
        return np.cumsum(marks) > 0

    rank = np.where(inside(start, windows)[: len(bins)], rarity[bins], np.int64(1) << 30)
    least = (rank << 32) | np.arange(len(bins))
    step = 1
    while step < RUN:  # places after a text's last window have the highest rank, so a short text's only run ends with it
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    runs = inside(start, np.maximum(1, windows - RUN + 1))[: len(least)]
    points = np.bincount(least[runs] & 0xFFFFFFFF, minlength=len(bins))
    place = np.flatnonzero((points >= POINTS) & (rank < 1 << 29))
    owner = np.searchsorted(offsets, place, "right") - 1
    bare = full[~np.isin(full, owner)]  # no window has the points: the one rarest
    single = [offsets[k] + int(np.argmin(rank[offsets[k] : offsets[k + 1] - WINDOW + 1])) for k in bare]
    place, owner = np.concatenate((place, np.array(single, np.int64))), np.concatenate((owner, bare))
    order = np.argsort(owner, kind="stable")
    place, owner = place[order], owner[order]
    words = data[place[:, None] + np.arange(WINDOW)].view("<u8")
    hashes = np.zeros(len(place), np.uint64)
    for column in words.T:
        hashes = _mix(hashes + np.uint64(0x9E3779B97F4A7C15) ^ column)
    counts = np.bincount(owner, minlength=len(batch))
    firsts = np.concatenate(([0], np.cumsum(counts)))
    chain = -(-counts // PER_FILTER)
    bases = np.concatenate(([0], np.cumsum(chain)))
    row = bases[owner] + (np.arange(len(owner)) - firsts[owner]) // PER_FILTER
    bits = np.zeros((bases[-1], BITS), bool)
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1).view("<u8")
    return [(int(counts[k]), packed[bases[k] : bases[k + 1]]) for k in range(len(batch))]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Normalised bit overlap in 0..1."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    short, other = sorted((a[1], b[1]), key=len)
    n_other, scores = np.bitwise_count(other).sum(axis=1).astype(float), []
    for own in short:
        n = float(np.bitwise_count(own).sum())
        common = np.bitwise_count(own & other).sum(axis=1)
        chance, most = n * n_other / BITS, np.minimum(n, n_other)
        floor = chance + CUTOFF * (most - chance)
        scores.append(float(np.max(np.where(common > floor, (common - floor) / np.maximum(most - floor, 1e-9), 0.0))))
    return min(1.0, float(np.mean(scores)))


def as_string(d: tuple[int, np.ndarray]) -> str:
    return f"{d[0]}:{base64.b64encode(d[1].tobytes()).decode()}"


def entropy_rarity(docs: DataFrame) -> np.ndarray:
    """A rank per entropy bin, the rarest over all windows of all documents first; BINS rows come to the driver."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            total = np.zeros(BINS, np.int64)
            raw = [t.encode() for t in batch.column(0).to_pylist() if t]
            raw = [t for t in raw if len(t) >= WINDOW]
            if raw:
                offsets = np.cumsum([len(t) for t in raw])
                bins = entropy_bins(np.frombuffer(b"".join(raw), np.uint8))
                valid = np.ones(len(bins), bool)
                for end in offsets[:-1]:
                    valid[end - WINDOW + 1 : end] = False
                total += np.bincount(bins[valid], minlength=BINS)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bin", "n"])

    rows = docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS, np.int64)
    for r in rows:
        counts[r["bin"]] = r["n"]
    rank = np.empty(BINS, np.int64)
    rank[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS)
    rank[:LOW] = 1 << 29
    return rank


def with_next(docs: DataFrame) -> DataFrame:
    """(range, ahead, key, doc_id, text) in partitions sorted so that each row's successor by descending doc_id follows it.

    ``ahead`` rows only end a range: they are the next range's first rows.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if rows.head(1) else []
    bounds = np.unique(np.array(cuts, float).clip(-(2.0**62), 2.0**62).astype(np.int64))

    def range_of(keys: pa.Array) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False), "right")

    def slim(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(batch.column(0)).astype(np.int32)), batch.column(0)], ["range", "key"])

    tops = {r["range"]: r["key"] for r in rows.select("key").mapInArrow(slim, "range int, key long").groupBy("range").agg(F.max("key").alias("key")).collect()}
    used = sorted(tops)
    before = {tops[r]: used[i - 1] for i, r in enumerate(used)}  # the range that a range's first row also ends
    first_keys = np.array(sorted(before), np.int64)

    def deal(batches):
        for batch in batches:
            keys = batch.column("key")
            own = pa.array(range_of(keys).astype(np.int32))
            names = ["range", "ahead", *batch.schema.names]
            yield pa.RecordBatch.from_arrays([own, pa.array(np.zeros(batch.num_rows, bool)), *batch.columns], names)
            again = np.flatnonzero(np.isin(keys.to_numpy(zero_copy_only=False), first_keys))
            if len(again):
                part = batch.take(pa.array(again))
                to = pa.array([before[k] for k in part.column("key").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(again), bool)), *part.columns], names)

    dealt = rows.mapInArrow(deal, "range int, ahead boolean, doc_id long, key long, text string")
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", F.desc("key"), "text")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the start of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rarity = entropy_rarity(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held = None
        for batch in slices(batches, "text", SLICE):
            found = list(zip(*(batch.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text"))))
            rows = list(zip(found, digest([r[3].encode() for r in found], rarity)))
            if held:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0][0] == b[0][0] and not a[0][1]]
            changed = [edited(a[0][3], b[0][3]).encode() for a, b in pairs]
            out = []
            for (a, b), raw, new in zip(pairs, changed, digest(changed, rarity)):
                out.append((a[0][2], len(a[0][3]), hashlib.sha256(raw).hexdigest(), as_string(a[1]), as_string(new), likeness(a[1], new), likeness(a[1], b[1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in schema.split(", ")])

    return with_next(docs).drop("key").mapInArrow(run, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
