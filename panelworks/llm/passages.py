"""Substring deduplication by compact windows.

1. A document is its sequence of 5-word shingles (lower-cased, split at ASCII white space). Under each of ``HASHES``
   min-hash functions, a shingle that is the minimum of some run of at least ``MIN_SHINGLES`` shingles is an anchor
   with a compact window [l, r]: every run inside it that holds the anchor has that min-hash. Anchors are the
   sliding minima, and their windows follow from the Cartesian tree of anchors (previous and next smaller anchor),
   since the ancestors of an anchor are anchors themselves. There are about 2 / (MIN_SHINGLES + 1) a shingle.
2. Windows are grouped by signature (function, min-hash). A groupBy with map-side combine gives the signatures that
   occur in more than one document, with their first document; the windows with these are joined to it.
3. Within a signature no pairs are listed: each window is linked to the signature's first document. That document may
   hold only a part of the passage or own the shingle by chance, so each window also carries hashes of its surroundings,
   ``LEVELS`` shingles wide to the left and to the right. A window that differs from the first is grouped again by
   (signature, side, surroundings up to the narrowest level that differs) and linked to the first window there, and so
   on, level by level, until it agrees with a first on that side or is alone. So each window is linked, on either side, to
   the first window that shares its surroundings as far as any does, up to the step between levels.
   A link whose windows differ within ``LEVELS[0]`` shingles on both sides is no candidate.
4. Links are joined as intervals: those of one document pair on one diagonal become the hull of their windows. One
   link makes a candidate. The other document's word hashes inside the intervals are fetched
   in blocks and every candidate is verified: runs of equal words on the diagonals are chained when a few words
   apart, and a chain counts if it has at least ``MIN_WORDS`` words on both sides and its shingle sets have a Jaccard
   similarity of at least ``SIMILARITY``.

Null and empty texts, and texts under ``MIN_WORDS`` words, have no passages. Rows without doc_id take no part and
are kept. Rows that share a doc_id count as one document (repeats inside a document, or between its rows, are not passages that
repeat across documents); equal rows are handled alike, and different texts of one doc_id are each searched whole. Ties go to the smallest doc_id and place. An empty table gives an empty result. Very long texts are
handled in bounded pieces by the same code; extra columns are carried along.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.common import discard, free_name, slices, stored, table

SHINGLE = 5
MIN_WORDS = 50
MIN_SHINGLES = MIN_WORDS - SHINGLE + 1
HASHES = 3
SIMILARITY = 0.8
BLOCK = 64  # words; a candidate is sent few beyond its reach
SLACK = 12  # words between chained runs
DRIFT = 6  # words put in or left out at one place
THIN = 12  # of a shingle that comes again and again, one anchor in so many places; any two of them align the run
LEVELS = (6, 16, 26, 36, 46)
LEVEL_BITS = 6
REACH = MIN_SHINGLES + SLACK  # words beyond a hull in which a passage can go on

BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20  # bytes of one text hashed at a time
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, by which a hash of any run is a difference of two running sums."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            _POWERS[name] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, np.uint64(base)))))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word."""
    raw, out, at = (text or "").encode().lower(), [], 0
    while at < len(raw):
        stop = min(len(raw), at + PIECE)
        while stop < len(raw) and not _BLANK[raw[stop]]:  # pieces end between words
            stop += 1
        data = np.frombuffer(raw, np.uint8, stop - at, at)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[data], [True])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        up, down = _powers(len(data))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((data + np.uint64(1)) * up)))
        out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        at = stop
    return out[0] if len(out) == 1 else np.concatenate([*out, np.zeros(0, np.uint64)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` values (none if there are fewer)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(BASE) + values[i : i + n]
    return mix(out)


def compact_windows(values: np.ndarray, least: int, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, left, right), bounds included, of all compact windows of at least ``least`` values; leftmost minimum wins.

    Of equal neighbours in one ``block``, only the first and the series' last are kept.
    """
    n = len(values)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    minima, width = values, 1
    place = np.arange(n)
    while width < least:  # sliding minima by doubling, with their places
        step = min(width, least - width)
        a, b = minima[:-step], minima[step:]
        take = b < a
        minima, place = np.where(take, b, a), np.where(take, place[step:], place[:-step])
        width += step
    anchor = place[np.concatenate(([True], place[1:] != place[:-1]))]
    own = values[anchor]
    if block is not None and len(anchor) > 2:
        inner = (own[1:-1] == own[:-2]) & (own[1:-1] == own[2:]) & (block[anchor[1:-1]] == block[anchor[:-2]])
        anchor = anchor[np.concatenate(([True], ~inner, [True]))]
        own = values[anchor]
    m = len(anchor)
    before, after = np.arange(m) - 1, np.arange(m) + 1
    todo = np.arange(m)
    while len(todo := todo[before[todo] >= 0]):  # an equal earlier value bounds a window, a later one does not
        todo = todo[own[before[todo]] > own[todo]]
        before[todo] = before[before[todo]]
    todo = np.arange(m)
    while len(todo := todo[after[todo] < m]):
        todo = todo[own[after[todo]] >= own[todo]]
        after[todo] = after[after[todo]]
    left = np.where(before >= 0, anchor[before] + 1, 0)
    right = np.where(after < m, anchor[np.minimum(after, m - 1)] - 1, n - 1)
    long = right - left + 1 >= least
    return anchor[long], left[long], right[long]


def _surroundings(shingles: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """LEVEL_BITS of a hash of the LEVELS shingles up to each anchor, narrowest level first, then the same from it on.

    A level that reaches beyond the text (its shingles are first to last) is 0, others are not.
    """
    up, down = _powers(len(shingles))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(shingles * up)))
    out = np.zeros(len(anchor), np.uint64)
    for side in (0, 1):
        for width in LEVELS:
            start = anchor if side else anchor - width + 1
            there = (start >= first) & (start + width - 1 <= last)
            at = np.where(there, start, 0)
            hashed = mix((sums[np.where(there, at + width, 0)] - sums[at]) * down[at]) >> np.uint64(64 - LEVEL_BITS)
            out = out << np.uint64(LEVEL_BITS) | np.where(there, np.maximum(hashed, np.uint64(1)), np.uint64(0))
    return out


def batch_windows(batch: list[str | None]) -> tuple[np.ndarray, ...]:
    """(text's number, key, anchor, reach to the left, reach to the right, surroundings) of many texts at once.

    The texts' shingles stand in one array; those that would span two texts get the least value, and so bound
    every window. Reaches beyond MIN_SHINGLES are cut there: no run of that length that holds the anchor goes further.
    """
    words = [word_hashes(t) for t in batch]
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    shingles = rolling(np.concatenate([*words, np.zeros(SHINGLE, np.uint64)]), SHINGLE)
    place = np.arange(len(shingles))
    owner = np.minimum(np.searchsorted(starts, place, "right") - 1, len(batch) - 1)
    inside = place + SHINGLE <= starts[owner + 1]
    block = (place - starts[owner]) // THIN
    parts = []
    for i in range(HASHES):
        values = mix(shingles * np.uint64(2 * (0x632BE59BD9B4E019 * (i + 1) % (1 << 62)) + 1))
        values = np.where(inside, values | np.uint64(1), np.uint64(0))
        anchor, left, right = compact_windows(values, MIN_SHINGLES, block)
        keep = inside[anchor]
        anchor, left, right = anchor[keep], left[keep], right[keep]
        key, text = mix(values[anchor] + np.uint64(2 * i)).view(np.int64), owner[anchor]
        first, last = starts[text], starts[text + 1] - SHINGLE
        around = _surroundings(shingles, anchor, first, last).view(np.int64)
        parts.append((text, key, anchor - first, np.minimum(anchor - left, MIN_SHINGLES), np.minimum(right - anchor, MIN_SHINGLES), around))
    return tuple(np.concatenate(c) for c in zip(*parts))


def windows(docs: DataFrame) -> DataFrame:
    """(key, doc_id, at, around) per compact window; ``at`` packs the anchor and its reaches."""

    def run(batches):
        for batch in slices(batches, "text"):
            text, key, anchor, left, right, around = batch_windows(batch.column(1).to_pylist())
            ids = batch.column(0).to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids, pa.int64()), pa.array(anchor << 16 | left << 8 | right), pa.array(around)], ["key", "doc_id", "at", "around"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return rows.mapInArrow(run, "key long, doc_id long, at long, around long")


def _side(column: str, side: int):
    """The surroundings on one side, narrowest level in the highest bits."""
    bits = LEVEL_BITS * len(LEVELS)
    return F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) if side else F.shiftrightunsigned(column, bits)


def _odd(side: int):
    """The group in which a window goes on where it differs from the first window on this side, else null."""
    own, group = _side("around", side), F.lit(None).cast("long")
    odd = own.bitwiseXOR(_side("rep_around", side))
    for level in range(len(LEVELS), 0, -1):
        rest = LEVEL_BITS * (len(LEVELS) - level)
        group = F.when(F.shiftrightunsigned(odd, rest) != 0, F.xxhash64("key", F.lit(side), F.lit(level), F.shiftrightunsigned(own, rest))).otherwise(group)
    return group


def _met(rows: DataFrame, sides, gate: bool) -> DataFrame:
    """A row (doc_id, at, rep, rep_at) per link of a window to the first window of its key, if documents differ, and a row
    (side, key, doc_id, at, around) per side on which a window goes on in another group. Keys of one document drop out.

    The first documents are stored before the join, so Spark can split a key with many windows there.
    """
    by = stored(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last"), "keys")
    met = stored(rows.join(by, "key"), "repeated")
    firsts = met.where("doc_id = rep").groupBy("key").agg(F.min("at").alias("rep_at"), F.min_by("around", "at").alias("rep_around"))
    firsts = stored(firsts, "firsts")
    near = F.lit(False)
    for side in (0, 1):
        near |= F.shiftrightunsigned(_side("around", side).bitwiseXOR(_side("rep_around", side)), LEVEL_BITS * (len(LEVELS) - 1)) == 0
    link = F.struct(F.lit(None).cast("int").alias("side"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("around"), "rep", "rep_at")
    ways = [F.when((F.col("doc_id") > F.col("rep")) & (near if gate else F.lit(True)), link)]
    for side in (0, 1):
        group = F.struct(F.lit(side).alias("side"), _odd(side).alias("key"), "around", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("rep_at"))
        ways.append(F.when(sides(side) & _odd(side).isNotNull(), group))
    told = met.join(firsts, "key").select("doc_id", "at", F.explode(F.filter(F.array(*ways), lambda x: x.isNotNull())).alias("w"))
    out = stored(told.select("doc_id", "at", "w.*"), "links")
    for table_ in (by, met, firsts):
        discard(table_)
    return out


def links(docs: DataFrame) -> DataFrame:
    """(doc_id, at, rep, rep_at): windows of repeated signatures, linked to the first window of the signature and to the
    first of each group of surroundings in which they go on."""
    rows, out = stored(windows(docs), "windows"), None
    for level in range(len(LEVELS) + 1):
        found = _met(rows, lambda side, level=level: F.lit(True) if level == 0 else F.col("side") == side, level == 0)
        told = found.where("side IS NULL").select("doc_id", "at", "rep", "rep_at")
        out = out.unionByName(told) if out else told
        if level == 0:
            discard(rows)
        rows = found.where("side IS NOT NULL").select("side", "key", "doc_id", "at", "around")
        if not rows.head(1):
            break
    return out


def interval_candidates(found: DataFrame) -> DataFrame:
    """(doc_id, rep, hulls): linked document pairs, and the hull of the linked windows on each diagonal."""
    anchor, rep_anchor = F.shiftright("at", 16), F.shiftright("rep_at", 16)
    left, right = F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255))
    rows = found.select("doc_id", "rep", (anchor - rep_anchor).alias("diagonal"), (anchor - left).alias("low"), (anchor + right + SHINGLE).alias("high"))
    hulls = rows.groupBy("doc_id", "rep", "diagonal").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return hulls.groupBy("doc_id", "rep").agg(F.collect_list(F.struct("diagonal", "low", "high")).alias("hulls"))


def _merged(diagonal: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of places (first to stop) on diagonals, in order, those that meet on one diagonal put together."""
    keep = stop - first >= SHINGLE
    begin, end = (diagonal[keep] << 40) + first[keep], (diagonal[keep] << 40) + stop[keep]
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))[: len(begin)]
    last = np.concatenate((new[1:], [len(begin)])) - 1 if len(new) else new
    diagonal = begin[new] >> 40
    return diagonal, begin[new] - (diagonal << 40), end[last] - (diagonal << 40)


def _equal(a: np.ndarray, b: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, start in a, length) of the runs of at least SHINGLE equal words on merged spans."""
    diagonal, first, stop = spans
    if not len(first):
        return spans
    sizes = stop - first + 1  # the last place of each parts it from the next
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    x = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, sizes)
    y = x - np.repeat(diagonal, sizes)
    same = np.zeros(offsets[-1] + 1, bool)
    same[1:] = a[np.minimum(x, len(a) - 1)] == b[np.minimum(y, len(b) - 1)]
    same[offsets[1:]] = False
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= SHINGLE
    starts, ends = starts[keep], ends[keep]
    own = np.searchsorted(offsets, starts, "right") - 1
    return diagonal[own], starts - offsets[own] + first[own], ends - starts


def _runs(a: np.ndarray, b: np.ndarray, hulls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of runs of at least SHINGLE equal words on the hulls' diagonals.

    The columns of ``hulls`` are a diagonal (place in a less place in b), the bounds in a, and the bounds of b's part to
    search. Where no one run covers a hull, words may have been put in or left out, which moves the rest to a diagonal nearby.
    """
    diagonal, low, high, b_first, b_stop = hulls.T

    def span(diagonal, low, high, b_first, b_stop):
        return diagonal, np.maximum(np.maximum(0, low - REACH), b_first + diagonal), np.minimum(np.minimum(len(a), high + REACH), b_stop + diagonal)

    own = span(*hulls.T)
    d, x, n = _equal(a, b, _merged(*own))
    short = own[2] - own[1] < SHINGLE
    begin = np.maximum(low, own[1])
    at = np.searchsorted((d << 40) + x, (diagonal << 40) + begin, "right") - 1
    whole = (at >= 0) & (d[at] == diagonal) & (x[at] + n[at] >= np.minimum(high, own[2])) if len(d) else np.zeros(len(short), bool)
    odd = ~(whole | short)
    if odd.any():
        drift = np.concatenate((np.arange(-DRIFT, 0), np.arange(1, DRIFT + 1)))
        near = span((diagonal[odd][:, None] + drift).ravel(), *(np.repeat(c[odd], len(drift)) for c in (low, high, b_first, b_stop)))
        d, x, n = _equal(a, b, _merged(*(np.concatenate(c) for c in zip(own, near))))
    return x, x - d, n


def _similar(a: np.ndarray, b: np.ndarray) -> float:
    x, y = (set(rolling(w.astype(np.uint64), SHINGLE).tolist()) for w in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def _chains(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The runs, ordered by start, in chains: each follows the open chain with the nearest diagonal, then the smallest gap."""
    if len(runs) == 1:
        return [runs]
    chains, ends = [], {}  # diagonal -> the open chains that end there
    for x, y, n in runs:
        best, reach = None, SLACK + SHINGLE
        near = range(x - y - reach, x - y + reach + 1)
        for d in [d for d in ends if abs(x - y - d) <= reach] if len(ends) < len(near) else near:
            if d not in ends:
                continue
            ends[d] = [c for c in ends[d] if x - c[-1][0] - c[-1][2] <= SLACK]
            if not ends[d]:
                del ends[d]
                continue
            for chain in ends[d]:
                px, py, pn = chain[-1]
                gap_a, gap_b = x - px - pn, y - py - pn
                if -SHINGLE <= gap_a and -SHINGLE <= gap_b <= SLACK:
                    best = min((abs(gap_a - gap_b), gap_a, d, chain), best or (SLACK * 4,), key=lambda c: c[:3])
        if best:
            ends[best[2]] = [c for c in ends[best[2]] if c is not best[3]]
            best[3].append((x, y, n))
        else:
            chains.append([(x, y, n)])
        ends.setdefault(x - y, []).append(best[3] if best else chains[-1])
    return chains


def _span(runs: list[tuple[int, int, int]]) -> tuple[int, int, int, int]:
    return runs[0][0], runs[0][1], runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]


def _long(runs: list[tuple[int, int, int]]) -> bool:
    x0, y0, x1, y1 = _span(runs)
    return x1 - x0 >= MIN_WORDS and y1 - y0 >= MIN_WORDS


def _stretches(chain: list[tuple[int, int, int]], similar) -> list[tuple[list[tuple[int, int, int]], float]]:
    """The maximal stretches of a chain's runs that are long and similar enough, with their similarity.

    By matched shingles M of A and B, a stretch is similar where M - SIMILARITY (A + B - M) >= 0, a difference of two sums
    over the chain; ``similar`` then decides on sets of shingles.
    """
    ends, begins, matched = [], [], 0.0
    for x, y, n in chain:
        begins.append((1 + SIMILARITY) * matched - SIMILARITY * (x + y + 2 * (SHINGLE - 1)))
        matched += n - SHINGLE + 1
        ends.append((1 + SIMILARITY) * matched - SIMILARITY * (x + y + 2 * n))
    out, done, ends = [], -1, np.array(ends)
    for i, begin in enumerate(begins):
        for j in (done + 1 + np.flatnonzero(ends[done + 1 :] >= begin - 1e-9))[::-1].tolist():
            if j < i or not _long(chain[i : j + 1]):
                break
            s = 1.0 if i == j else similar(chain[i : j + 1])
            if s >= SIMILARITY:
                out.append((chain[i : j + 1], s))
                done = j
                break
    return out


def verify(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """(start in a, words, start in b, words, similarity) of the passages that chains of runs make."""

    def similar(runs):
        x0, y0, x1, y1 = _span(runs)
        return _similar(a[x0:x1], b[y0:y1])

    out = []
    for chain in _chains(runs):
        if not _long(chain):
            continue
        s = 1.0 if len(chain) == 1 else similar(chain)
        for runs, s in [(chain, s)] if s >= SIMILARITY else _stretches(chain, similar):
            x0, y0, x1, y1 = _span(runs)
            out.append((x0, x1 - x0, y0, y1 - y0, s))
    return out


def _blocks_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(rep, block, hashes): the word hashes of the needed blocks; ``docs`` is cut by all its columns so that one exchange serves twice."""
    names, wanted_blocks = docs.columns, free_name(docs.columns, "_blocks")

    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for key, text, blocks in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", wanted_blocks))):
                words = word_hashes(text)
                rows += [(key, b, words[b * BLOCK : (b + 1) * BLOCK].astype(np.uint32).tobytes()) for b in blocks if b * BLOCK < len(words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[], [], []], [pa.int64(), pa.int64(), pa.binary()])], ["rep", "block", "hashes"])

    wanted = needed.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_set("block").alias(wanted_blocks))
    return docs.join(wanted, "doc_id").select(*(f"`{c}`" for c in names), f"`{wanted_blocks}`").mapInArrow(run, "rep long, block long, hashes binary")


def _numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with ids that tell different texts of one doc_id apart (doc_id * R + number, in the order of a hash), and R.

    R is 1, and docs as they are, where no doc_id has two texts. Equal rows keep equal ids.
    """
    h = F.xxhash64("text")
    known = docs.where("doc_id IS NOT NULL").select("doc_id", h.alias("h"))
    if not known.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").head(1):
        return docs, 1
    order = Window.partitionBy("doc_id").orderBy("h")
    kinds = stored(known.distinct().withColumn("number", F.row_number().over(order).cast("long") - 1), "kinds")
    times = kinds.agg(F.max("number")).first()[0] + 1
    key = free_name(docs.columns, "_h")
    number = free_name([*docs.columns, key], "_number")
    met = docs.withColumn(key, h).join(kinds.toDF("doc_id", key, number), ["doc_id", key], "left")
    own = (F.col("doc_id") * times + F.col(number)).alias("doc_id")
    return met.select(*(own if c == "doc_id" else f"`{c}`" for c in docs.columns)), times


def _plain(column: str, times: int):
    """The doc_id of an id of ``_numbered``."""
    return F.col(column) if times == 1 else F.expr(f"(`{column}` - pmod(`{column}`, {times})) DIV {times}")


def _blocks_under(hull):
    """The numbers of the other document's blocks in which a passage at a hull can lie."""
    reach = REACH + DRIFT
    low = F.greatest(F.lit(0), F.floor((hull["low"] - hull["diagonal"] - reach) / BLOCK))
    return F.sequence(low, F.greatest(low, F.floor((hull["high"] - hull["diagonal"] + reach) / BLOCK)))


def _with_candidates(docs: DataFrame, how: str, name: str, times: int = 1) -> DataFrame:
    """docs joined with the column ``name``: per matched document its hulls and the blocks under them; rows of one doc_id never match.

    The blocks are by far the most of it (candidates grow faster than documents do), so they are dealt once, by doc_id, and the
    documents too: rows without doc_id stay out of both joins, so that one exchange serves both.
    """
    linked = links(docs)
    pairs = stored(interval_candidates(linked).where(_plain("rep", times) < _plain("doc_id", times)), "pairs")
    discard(linked)
    need = pairs.select("doc_id", "rep", F.explode(F.array_distinct(F.flatten(F.transform("hulls", _blocks_under)))).alias("block"))
    known = docs.where("doc_id IS NOT NULL")
    blocks = _blocks_of(known, need.select("rep", "block"))
    got = need.join(blocks, ["rep", "block"]).groupBy("doc_id").agg(F.collect_set(F.struct("rep", "block", "hashes")).alias("blocks"))  # repeated rows give equal blocks
    reps = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("rep", "hulls")).alias("reps")).join(got, "doc_id")
    reps = reps.select("doc_id", F.struct("reps", "blocks").alias(name))
    met = known.join(reps, "doc_id", how).select(*(f"`{c}`" for c in docs.columns), f"`{name}`")
    rest = docs.where("doc_id IS NULL").withColumn(name, F.lit(None).cast(reps.schema[name].dataType))
    return met.unionByName(rest) if how == "left" else met


def _passages(text: str | None, found_in: dict | None) -> list[tuple[int, int, int, int, int, float]]:
    """(start, words, rep, rep start, rep words, similarity) of one document; none lies inside another with the same rep."""
    if not found_in:
        return []
    held = defaultdict(list)
    for x in found_in["blocks"]:
        held[x["rep"]].append((x["block"], x["hashes"]))
    reps = [rep for rep in found_in["reps"] if rep["rep"] in held]
    if not reps:
        return []
    a = word_hashes(text).astype(np.uint32)
    parts, at, hulls, owners = [], 0, [], []  # stretches of adjacent blocks, one word apart, in one array
    for k, rep in enumerate(reps):
        blocks, starts = sorted(held[rep["rep"]]), []
        for i, (block, raw) in enumerate(blocks):
            if not i or block != blocks[i - 1][0] + 1:
                at += bool(parts)
                parts.append(b"\0" * 4 * bool(parts))
                owners.append((at, k, block * BLOCK))
                starts.append([block, at, at])
            parts.append(raw)
            at += len(raw) // 4
            starts[-1][2] = at
        for x in rep["hulls"]:
            first = max(0, x["low"] - x["diagonal"] - REACH - DRIFT) // BLOCK
            block, begin, end = starts[bisect.bisect_right(starts, first, key=lambda s: s[0]) - 1]
            hulls.append((x["diagonal"] + block * BLOCK - begin, x["low"], x["high"], begin, end))
    b = np.frombuffer(b"".join(parts), np.uint32)
    x, y, n = _runs(a, b, np.array(hulls, np.int64))
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order]
    part = np.searchsorted([o[0] for o in owners], y, "right") - 1
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(len(owners) + 1))
    runs = np.stack((x, y, n), axis=1)[order]
    found = [[] for _ in reps]
    for (begin, k, b0), i, j in zip(owners, edges, edges[1:]):
        if j > i and (j - i > 1 or runs[i, 2] >= MIN_WORDS):
            found[k] += [(x, n, y - begin + b0, m, s) for x, n, y, m, s in verify(a, b, list(map(tuple, runs[i:j].tolist())))]
    out = []
    for rep, passages in zip(reps, found):
        end = 0
        for x, n, y, m, s in sorted(set(passages), key=lambda p: (p[0], -p[1], -p[4], p[2])):
            if x + n > end:
                out.append((x, n, rep["rep"], y, m, s))
                end = x + n
    return sorted(out)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """A row per verified passage: doc_id, start_word, n_words, match_doc_id, match_start_word, match_words, similarity.

    match_doc_id is a smaller doc_id that has the passage too. Of the passages that two documents share, those whose words
    (start_word, n_words) lie inside another's are left out.
    """
    schema = "doc_id long, start_word long, n_words long, match_doc_id long, match_start_word long, match_words long, similarity double"
    kinds = [pa.int64()] * 6 + [pa.float64()]

    def run(batches):
        for batch in slices(batches, "text"):
            cols = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "_reps"))
            rows = [(key, *p) for key, text, reps in zip(*cols) for p in _passages(text, reps)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

    rows, times = _numbered(docs.where("doc_id IS NOT NULL").select("doc_id", "text"))
    found = _with_candidates(rows, "inner", "_reps", times).mapInArrow(run, schema)
    return found.withColumns({c: _plain(c, times) for c in ("doc_id", "match_doc_id")}) if times > 1 else found


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words (start, number)."""
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    gone = np.zeros(len(places), bool)
    for start, n in spans:
        gone[start : start + n] = True
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(text[at : places[first][0]])
        at = places[stop - 1][1]
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every passage removed that a smaller doc_id has too; n_chars, if there, follows.

    A document of which nothing but white space is left goes; documents without such passages stay as they are.
    """
    names, candidates = docs.columns, free_name(docs.columns, "_reps")

    def run(batches):
        for batch in slices(batches, "text"):
            at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            texts_ = batch.column(at["text"]).to_pylist()
            keep = []
            changed = {}
            for i, (text, reps) in enumerate(zip(texts_, batch.column(at[candidates]).to_pylist())):
                spans = [(p[0], p[1]) for p in _passages(text, reps)]
                if spans:
                    texts_[i] = changed[i] = _without(text, spans)
                if not spans or texts_[i].strip():
                    keep.append(i)
            columns = [batch.column(at[c]) for c in names]
            columns[names.index("text")] = pa.array(texts_, pa.string())
            if "n_chars" in names:
                old = batch.column(at["n_chars"])
                columns[names.index("n_chars")] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(columns, names).take(pa.array(keep, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows, times = _numbered(docs)
    kept = _with_candidates(rows, "left", candidates, times).mapInArrow(run, schema)
    return kept.select(*(_plain(c, times).alias(c) if c == "doc_id" else f"`{c}`" for c in names)) if times > 1 else kept


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
