"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a SentencePiece model (B) cover the same bytes.

Both encode a space and the text. Per batch of documents, two pandas ``merge_asof`` keyed by document find for each token's
start the other side's covering token; the union of both directions gives all overlaps, and the offsets at which tokens of both
sides end cut them into groups. All A and B tokens of a group are linked. An id pair counts the documents that hold it linked.

Encoding is cached by chunk: white space and what follows up to the next space or line end after another character. No token of
either side crosses such a place (``Pair`` checks the vocabulary for it, and takes texts whole where that fails or where
notions of white space differ), so a text's tokens are its chunks' tokens.

Counts over the corpus come from a groupBy with map-side combine. They go back to the documents by broadcast while they are
counted to be at most ``FEW_PAIRS``, and by shuffle beyond that.

Texts that are null, empty, or that a tokenizer doesn't give back byte for byte have no tokens: zeros, and '' for the hash.
Repeated rows count each. Very long texts are one row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.common import discard, slices, stored, table, texts

FEW_PAIRS = 4_000_000  # 13 bytes each
GENERATION = 500_000
SPACE_MARK = "▁"
# White space and what follows; a new chunk begins at a space or line end that doesn't follow white space.
_CHUNKS = re.compile(r"\s+\S*(?:[^\S \n]\s*\S*)*")
_DOUBTFUL = re.compile("[\u180e\u2581]")
_FAR = re.compile("[^\x00-\u024f]")  # letters whose class might depend on a library's Unicode version
# Fixed value: how a byte-level BPE of this kind splits text before merging.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PAIRS: dict = {}


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1 as bytes, left-aligned, and how many there are."""
    width = len(str(n))
    digits = np.array([str(i) for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)
    return digits, (digits > 0).sum(axis=1)


class Pair:
    """The two tokenizers with a bounded cache of chunks; one per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.n_b = self.b.get_piece_size()
        size_a = max(self.a.get_vocab().values()) + 1
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
        entries = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(letters.get(c, 0) for c in entries.get(i, "")) for i in range(size_a)]
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(SPACE_MARK)
        crossing = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}|\n")
        self.whole = any(crossing.search(p) for p in pieces)
        self.length_a, self.length_b = (np.array([len(b) for b in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.digits, self.n_digits = _decimals(max(size_a, self.n_b))
        self.merger = self._merger()
        self.reset()

    def _merger(self):
        """A's own merges run by tiktoken, where its ids are in the order of its merges; else None."""
        import tiktoken

        spec = json.loads(self.a.to_str())
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"].get("merges", [])]
        kind = (spec["pre_tokenizer"] or {}).get("type"), spec["normalizer"], (spec["pre_tokenizer"] or {}).get("add_prefix_space")
        if kind != ("ByteLevel", None, False) or [spec["model"]["vocab"][m] for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("merges", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.fine = np.zeros(0, bool)

    def _apart(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """The ids of chunks on both sides, one by one, and whether they give the chunk's bytes."""
        ids_a = [self.a.encode(c, add_special_tokens=False).ids for c in chunks]
        # B puts a space in front: it is the chunk's own, or goes where the chunk starts with a line end.
        ids_b = [i[1:] if c[0] != " " and (i := self.b.encode(c))[:1] == [self.mark] else [self.mark] if c == " " else self.b.encode(c.removeprefix(" ")) for c in chunks]
        joined = (b"".join(map(of.__getitem__, i)) for of, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)) for i in ids)
        given = list(joined)
        return ids_a, ids_b, [x == y == c.encode() for x, y, c in zip(given, given[len(chunks) :], chunks)]

    def _joined(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(ids, how many each chunk has) of both sides for chunks that end without white space, encoded in one go; None if that can't be done."""
        text = " a" + "".join(chunks)
        stops, cut = 2 + np.cumsum([0, *(len(c.encode()) for c in chunks)]), []
        ids_a = self.merger(text) if self.merger else self.a.encode(text, add_special_tokens=False).ids
        for ids, of, lengths in ((ids_a, self.bytes_a, self.length_a), (self.b.encode(text[1:]), self.bytes_b, self.length_b)):
            if b"".join(map(of.__getitem__, ids)) != text.encode():
                return None
            ids = np.array(ids, np.int64)
            ends = np.cumsum(lengths[ids])
            at = np.searchsorted(ends, stops)
            if (ends[at] != stops).any():
                return None
            cut.append((ids[at[0] + 1 :], np.diff(at)))
        return cut

    def _learn(self, chunks: list[str]) -> None:
        plain, odd = [], []
        for c in chunks:
            (odd if self.whole or c[-1].isspace() or _FAR.search(c) else plain).append(c)
        parts = [x[i : i + 2048] for x in (plain, odd) for i in range(0, len(x), 2048)]
        for i, part in enumerate(parts):
            cut, fine = self._joined(part) if i < -(-len(plain) // 2048) else None, [True] * len(part)
            if cut is None:
                *ids, fine = self._apart(part)
                cut = [(np.array([i for x in side for i in x], np.int64), np.array([len(x) for x in side], np.int64)) for side in ids]
            self.known.update(zip(part, range(len(self.fine), len(self.fine) + len(part))))
            self.fine = np.concatenate((self.fine, np.array(fine, bool)))
            for side, (flat, sizes) in enumerate(cut):
                self.flat[side] = np.concatenate((self.flat[side], flat.astype(np.int32)))
                self.ends[side] = np.concatenate((self.ends[side], self.ends[side][-1] + np.cumsum(sizes)))

    def encode(self, batch: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of both sides, and each one's place in the batch; texts without tokens have none."""
        found = [[] if not t else [f" {t}"] if self.whole or _DOUBTFUL.search(t) else _CHUNKS.findall(f" {t}") for t in batch]
        wanted = set().union(*found)
        if len(self.known) > GENERATION:
            self.reset()
        if new := [c for c in wanted if c not in self.known]:
            self._learn(new)
        sizes = np.array([len(x) for x in found], np.int64)
        at = np.fromiter((i for x in found for i in map(self.known.__getitem__, x)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(batch)), sizes)
        bad = np.bincount(owner, ~self.fine[at], minlength=len(batch)) > 0
        at, owner = at[~bad[owner]], owner[~bad[owner]]
        ids, owners = [], []
        for side in (0, 1):
            low, high = self.ends[side][at], self.ends[side][at + 1]
            n = high - low
            first = np.cumsum(n) - n
            ids.append(self.flat[side][np.repeat(low - first, n) + np.arange(n.sum())].astype(np.int64))
            owners.append(np.repeat(owner, n))
        return ids, owners

    def groups_text(self, ids: list[np.ndarray], group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``a1,a2|b1;`` of all groups in a row, and where each group's bytes end."""
        held = [np.bincount(g, minlength=int(group[0][-1]) + 1) for g in group]
        before = [np.cumsum(h) - h for h in held]
        total = len(ids[0]) + len(ids[1])
        place = (np.arange(len(ids[0])) + before[1][group[0]], np.arange(len(ids[1])) + (before[0] + held[0])[group[1]])
        value, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        for side in (0, 1):
            value[place[side]] = ids[side]
            last = np.concatenate((group[side][1:] != group[side][:-1], [True]))
            mark[place[side][last]] = ord("|;"[side])
        n = self.n_digits[value]
        ends = np.cumsum(n + 1)
        out = np.empty(int(ends[-1]), np.uint8)
        starts = ends - n - 1
        for k in range(self.digits.shape[1]):
            longer = n > k
            out[starts[longer] + k] = self.digits[value[longer], k]
        out[ends - 1] = mark
        return out, ends[np.cumsum(held[0] + held[1]) - 1]


def overlaps(start_a: np.ndarray, start_b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A's place, B's place) of all tokens that share a byte, sorted; starts ascend over the whole batch."""
    a = pd.DataFrame({"start": start_a, "doc": doc_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"start": start_b, "doc": doc_b, "b": np.arange(len(start_b))})
    covering = pd.merge_asof(a, b, on="start", by="doc"), pd.merge_asof(b, a, on="start", by="doc")
    pairs = np.concatenate([c["a"].to_numpy(np.int64) * (len(start_b) + 1) + c["b"].to_numpy(np.int64) for c in covering])
    pairs = np.unique(pairs)
    return pairs // (len(start_b) + 1), pairs % (len(start_b) + 1)


def align(ids: list[np.ndarray], owners: list[np.ndarray], lengths: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each side's group of every token, and the linked (A place, B place) pairs, of a batch of documents."""
    ends = [np.cumsum(n) for n in lengths]
    starts = [e - n for e, n in zip(ends, lengths)]
    a, b = overlaps(starts[0], starts[1], *owners)
    closing = ends[0][a] == ends[1][b]  # two tokens that overlap and end together close a group
    closes = np.zeros(len(ids[0]), np.int64)
    closes[a[closing]] = 1
    group_a = np.cumsum(closes) - closes
    group_b = np.empty(len(ids[1]), np.int64)
    group_b[b] = group_a[a]  # what overlaps is in one group
    n_b = np.bincount(group_b)
    times = n_b[group_a]
    first = np.cumsum(n_b) - n_b
    left = np.repeat(np.arange(len(group_a)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[group_a], times)
    return [group_a, group_b], left, right


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): each document's figures and its distinct linked id pairs,
    as A id * size of B + B id, with how often they are linked."""

    def run(batches):
        if (path_a, path_b) not in _PAIRS:
            _PAIRS[path_a, path_b] = Pair(path_a, path_b)
        pair = _PAIRS[path_a, path_b]
        for batch in slices(batches, "text"):
            n = batch.num_rows
            ids, owners = pair.encode(texts(batch))
            counts = [np.bincount(o, minlength=n) for o in owners]
            n_groups, n_links, hashes = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
            codes, times, bounds = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
            if len(ids[0]):
                group, left, right = align(ids, owners, [pair.length_a[ids[0]], pair.length_b[ids[1]]])
                first = np.concatenate(([True], group[0][1:] != group[0][:-1]))
                n_groups = np.bincount(owners[0][first], minlength=n)
                n_links = np.bincount(owners[0][left], minlength=n)
                out, ends = pair.groups_text(ids, group)
                stops = np.cumsum(n_groups)
                for i in np.flatnonzero(n_groups):
                    low = ends[stops[i] - n_groups[i] - 1] if stops[i] > n_groups[i] else 0
                    hashes[i] = hashlib.sha256(out[low : ends[stops[i] - 1] - 1]).hexdigest()
                keys, found = np.unique(owners[0][left] << 32 | ids[0][left] * pair.n_b + ids[1][right], return_counts=True)
                codes, times = keys & 0xFFFFFFFF, found
                bounds = np.searchsorted(keys, np.arange(n + 1) << 32)
            offsets = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(x, pa.int64()) for x in (*counts, n_groups, n_links)),
                    pa.array(hashes),
                    pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether no other pair of its A id is in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("a", F.floor(F.col("pair") / n_b)), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return stored(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _by_broadcast(rows: DataFrame, counts: DataFrame) -> DataFrame:
    found = counts.toArrow().sort_by("pair")
    held = rows.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        pair, n, best = held.value
        for batch in batches:
            lists, times = batch.column(1), batch.column(2).values.to_numpy().astype(np.int64)
            at = np.searchsorted(pair, lists.values.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            low = int(lists.offsets[0].as_py())
            at, times = at[low : low + len(owner)], times[low : low + len(owner)]
            total, tops = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, owner, times * n[at])
            np.add.at(tops, owner, times * best[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tops), pa.array(total)], ["row", "n_best", "count_sum"])

    return rows.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long")


def _by_shuffle(rows: DataFrame, counts: DataFrame) -> DataFrame:
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), "link.times")
    best = F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)
    return links.join(counts, "pair").groupBy("row").agg(F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, few: int = FEW_PAIRS) -> DataFrame:
    """Each document's token, group and link counts, with ``n_best`` and ``count_sum`` of its links over the whole corpus."""
    import sentencepiece

    rows = stored(alignments(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size())
    sums = (_by_broadcast if counts.count() <= few else _by_shuffle)(rows, counts)
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
    out = stored(out, "alignment")
    discard(rows)
    discard(counts)
    return out


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return aligned_documents(table(spark, sf_dir, "documents"), str(public.path("byte_bpe_50k.json")), str(public.path("piece_bpe_32k.model")))
