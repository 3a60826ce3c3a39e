"""Hierarchical multi-length packing.

1. Encode every text, append the end id and cut documents longer than the largest window into whole
   windows and a rest. The pieces are dealt evenly over partitions by a hash of (document, start), so a
   hot source or a huge document spreads out.
2. In each partition a shard of pieces of bounded size at a time is packed: every piece is routed to the
   smallest tier (window size, a power of two) that holds it. Tiers are packed from the longest window
   down, longest piece first; a window's gap is filled from shorter tiers, best fit first, and closed by
   cutting one piece. Windows therefore end full, at a power of two. What is left over goes on into the next
   shard; the last remainder of a partition is cut into smaller powers of two, so nothing is padded.
3. Windows of one tier are ordered by attention cost (the sum of squared piece lengths) and dealt out in a
   serpentine over step groups, so that groups of equal tokens also have nearly equal cost.

A null text is the empty text: its only id is the end id. Rows with equal doc_id are packed one by one.
Null doc_ids stay null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.common import slices, table, texts
from panelworks.llm.wordtok import tokenizer

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
SHARD_TOKENS = 2_000_000
STEP_TOKENS = 8 * 4096

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = f"{PIECES}, sequence_id long, offset long, tier int, step_group long, window_cost long"


def encoded_pieces(docs: DataFrame, vocabulary: str, window: int = TIERS[-1], end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) with at most ``window`` ids a row; ids are little-endian, 16 or 32 bits wide."""

    def run(batches):
        coder = tokenizer(vocabulary)
        width, end = coder.dtype.itemsize, np.array([end_id], coder.dtype).tobytes()
        for batch in slices(batches, "text"):
            keys, rows = batch.column(0).to_pylist(), []
            for key, ids in zip(keys, coder.encode(texts(batch))):
                ids += end
                n = len(ids) // width
                for start in range(0, n, window):
                    part = ids[start * width : (start + window) * width]
                    rows.append((key, start, len(part) // width, n, part))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(lengths: list[int], tiers=TIERS, last: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows, each a list of (item, start, length), and what is left over (nothing if ``last``)."""
    pool = sorted((n, i, 0) for i, n in enumerate(lengths) if n)  # (length, item, start), shortest first
    windows = []

    def fill(size: int, window: list) -> int:
        gap = size
        while gap and pool:
            at = bisect.bisect_right(pool, (gap, len(lengths), 0)) - 1
            if at >= 0:
                n, item, start = pool.pop(at)
            else:  # every piece is longer than the gap: cut the shortest
                n, item, start = pool.pop(0)
                bisect.insort(pool, (n - gap, item, start + gap))
                n = gap
            window.append((item, start, n))
            gap -= n
        return gap

    total = sum(n for n, _, _ in pool)
    for k in range(len(tiers) - 1, -1, -1):
        size, below = tiers[k], tiers[k - 1] if k else 0
        while pool and pool[-1][0] > below and total >= size:
            n, item, start = pool.pop()
            window = [(item, start, n)]
            fill(size - n, window)
            total -= size
            windows.append(window)
    if last:
        while pool:
            size = 1 << (min(total, tiers[-1]).bit_length() - 1)
            window: list = []
            fill(size, window)
            total -= size
            windows.append(window)
    return windows, [(item, start, n) for n, item, start in pool]


def step_groups(windows: list[list[tuple[int, int, int]]], step_tokens: int = STEP_TOKENS) -> list[tuple[int, int, int]]:
    """(tier, group, cost) of each window: groups of one tier hold equal tokens and balanced cost."""
    size = [sum(n for _, _, n in w) for w in windows]
    cost = [sum(n * n for _, _, n in w) for w in windows]
    out, first = [(0, 0, 0)] * len(windows), 0
    for tier in sorted(set(size)):
        own = sorted((i for i in range(len(windows)) if size[i] == tier), key=lambda i: -cost[i])
        groups = -(-len(own) * tier // step_tokens)
        for rank, i in enumerate(own):
            lap, seat = divmod(rank, groups)
            out[i] = (tier, first + (seat if lap % 2 == 0 else groups - 1 - seat), cost[i])
        first += groups
    return out


def pack_documents(docs: DataFrame, vocabulary: str, tiers=TIERS, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: where it comes from (doc_id, start, length, doc_tokens), its ids, and where it lies.

    ``sequence_id`` is unique over the table and ``offset`` is the place of the piece's first id in its
    sequence. Pieces are sorted by a hash within each partition, so a task that runs again packs alike.
    """
    spread = F.xxhash64("doc_id", "start")
    pieces = encoded_pieces(docs, vocabulary, tiers[-1], end_id)
    dealt = pieces.repartition(spread).sortWithinPartitions(spread, "doc_id", "start", "length")

    def run(batches):
        width = tokenizer(vocabulary).dtype.itemsize
        base = TaskContext.get().partitionId() << 32
        made, groups, held, tokens = 0, 0, [], 0

        def emit(last: bool):
            nonlocal made, groups, held, tokens
            windows, rest = pack([r[2] for r in held], tiers, last)
            rows, dealt_out = [], step_groups(windows)
            for k, (window, (tier, group, cost)) in enumerate(zip(windows, dealt_out)):
                offset = 0
                for item, start, n in window:
                    doc, first, _, whole, ids = held[item]
                    rows.append((doc, first + start, n, whole, np.frombuffer(ids, f"<u{width}")[start : start + n].astype("<u4").tobytes(), base + made + k, offset, tier, base + groups + group, cost))
                    offset += n
            groups += 1 + max((g for _, g, _ in dealt_out), default=-1)
            made += len(windows)
            held = [(held[i][0], held[i][1] + s, n, held[i][3], held[i][4][s * width : (s + n) * width]) for i, s, n in rest]
            tokens = sum(r[2] for r in held)
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2
            names = "doc_id start length doc_tokens ids sequence_id offset tier step_group window_cost".split()
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096]), kinds)], names)

        for batch in slices(batches, "ids"):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                tokens += row[2]
            if tokens >= shard_tokens:
                yield from emit(False)
        yield from emit(True)

    return dealt.mapInArrow(run, PACKED)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    packed = pack_documents(table(spark, sf_dir, "documents"), str(public.path("word_bpe_49k.json")))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
