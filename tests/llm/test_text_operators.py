"""Text operators against brute force, exact round trips and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelworks.llm import digests, language, licenses, media, mixing, packing, passages, simhash, token_counts, warc

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [prose(rng, rng.choice([1, 4, 60, 200, 700])) for _ in range(60)]
    passage = prose(rng, 70)
    words = base[3].split() if len(base[3].split()) > 50 else prose(rng, 200).split()
    near = words.copy()
    near[40] = "changed"
    texts = base + [base[0], base[0], " ".join(words), " ".join(near), None, "", "  \n", prose(rng, 9000), "ünï çödé " * 9]
    texts += [prose(rng, 80) + " " + passage + " " + prose(rng, 80) for _ in range(3)]
    return [(i, t, rng.choice(["x", "y", None]), rng.choice(["s1", "s1", "s2", None]), None, "clash", None) for i, t in enumerate(texts)] + [(None, "no id here", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_is_gapless_and_whole(docs, rows):
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).withColumn("crc", F.crc32("ids")).collect()
    want = {r[0]: whole.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    seen = {}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.crc
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for key, ids in want.items():
        at = 0
        for start, n in sorted(seen[key]):
            assert start == at
            at += n
        assert at == len(ids)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0


def test_ids_are_the_librarys_also_with_added_tokens():
    from tokenizers import Tokenizer

    from panelworks.llm.wordtok import tokenizer

    path = str(public.path("word_bpe_49k.json"))
    whole, added = Tokenizer.from_file(path), [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    found = ["hello <|endoftext|> world", "a b", *(f"x{t}y {t}" for t in added), "", "Σίσυφος is\u00a0here"]
    assert [np.frombuffer(raw, tokenizer(path).dtype).tolist() for raw in tokenizer(path).encode(found)] == [whole.encode(t, add_special_tokens=False).ids for t in found]


def test_extra_columns_with_clashing_names_stay(spark):
    """Each stage keeps columns that have the names of its own columns, and texts beyond one slice, repeated rows and ties."""
    rng = random.Random(31)
    long = prose(rng, 190_000)
    texts = [prose(rng, 60), long, long + " " + prose(rng, 60), prose(rng, 60), None, "", prose(rng, 60)]
    rows = [(min(i, 5), t, "x", "s", 777, 777, 777, 777, 777) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _reps int, _blocks int, _size int, _plan int, tile int")
    for stage in (passages.without_repeats, mixing.mixed_documents, simhash.keep_first_of_each, language.known_language):
        got = stage(docs)
        assert got.columns == docs.columns and {tuple(r[4:]) for r in got.collect()} <= {(777,) * 5}
    kept = {r.doc_id: r.text for r in passages.without_repeats(docs).collect() if r.doc_id != 5}
    assert kept[1] == long and len(kept[2].split()) == 60
    assert {r._size for r in mixing.mix(docs).collect()} == {777}
    assert sorted(r.doc_id for r in simhash.keep_first_of_each(docs).collect()) == [0, 1, 3, 4]  # 5 has the empty text too


def test_products_equal_row_sums():
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(1 << language.BITS, 3)).astype(np.float32)
    presence = [np.unique(rng.integers(0, 1 << language.BITS, n)) for n in (5, 0, 400, 1, 300_000, 7)]
    got = language.products(presence, weights)
    for p, row in zip(presence, got):
        assert np.allclose(row, weights[p].astype(float).sum(axis=0) / max(1, len(p)) ** 0.5)


def test_pack_leaves_nothing_out():
    rng = random.Random(1)
    lengths = [rng.randint(1, 4096) for _ in range(300)]
    windows, rest = packing.pack(lengths)
    assert not rest and sum(n for w in windows for _, _, n in w) == sum(lengths)
    groups = packing.step_groups(windows)
    by = {}
    for w, (tier, group, _) in zip(windows, groups):
        by.setdefault(group, set()).add(tier)
    assert all(len(t) == 1 for t in by.values())


def test_fingerprints_of_edited_texts(docs, rows):
    got = {r.doc_id: r for r in digests.fingerprint_pairs(docs).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    texts = [r[1] or "" for r in order]
    for i, r in enumerate(order):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        n = len(t) // 3
        assert got[r[0]].edited_sha256 == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
        assert got[r[0]].n_chars == len(t) and 0 <= got[r[0]].near_edited <= 1
    assert got[0].fingerprint == got[60].fingerprint == got[61].fingerprint
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.3 > 0.05 > np.median([r.near_next for r in long])


def _features(text, rarity):
    """Plain form of the selection: one window and run width for every length."""
    raw = text.ljust(16, b"\0")
    windows = [raw[i : i + 16] for i in range(len(raw) - 15)]
    place = [(int(rarity[digests.entropy_bins(np.frombuffer(w, np.uint8))[0]]), i) for i, w in enumerate(windows)]
    points = dict.fromkeys(range(len(windows)), 0)
    for first in range(max(1, len(windows) - 15)):
        points[min(place[first : first + 16])[1]] += 1
    found = [i for i, n in points.items() if n >= 4 and place[i][0] < 1 << 29]
    return [windows[i] for i in found or [min(place)[1]]] if text else []


def _bits(window):
    h = np.zeros(1, np.uint64)
    for part in (window[:8], window[8:]):
        h = digests._mix(h + np.uint64(0x9E3779B97F4A7C15) ^ np.frombuffer(part, "<u8"))
    return {int(h[0]) >> 11 * k & 2047 for k in range(5)}


def test_selection_bits_and_likeness_match_brute_force():
    rng = random.Random(21)
    rarity = np.array(rng.sample(range(digests.BINS), digests.BINS))
    rarity[: digests.LOW] = 1 << 29
    texts = [prose(rng, 2000)[:n].encode() for n in (0, 1, 7, 15, 16, 17, 30, 31, 32, 40, 251, 258, 9000)] + [b"a" * 500, "ünï çödé ".encode() * 9]
    got = digests.digest(texts, rarity)
    chains = []
    for text, (n, filters) in zip(texts, got):
        features = _features(text, rarity)
        chain = [set().union(*map(_bits, features[i : i + 160])) for i in range(0, len(features), 160)]
        assert n == len(features) and [set(np.flatnonzero(np.unpackbits(f.view(np.uint8)))) for f in filters] == chain
        chains.append(chain)
    for i, a in enumerate(chains):
        for j, b in enumerate(chains):
            scores = []
            for own in min(a, b, key=len):
                best = 0.0
                for other in max(b, a, key=len):
                    chance = len(own) * len(other) / 2048
                    floor = chance + 0.3 * (min(len(own), len(other)) - chance)
                    best = max(best, (len(own & other) - floor) / (min(len(own), len(other)) - floor))
                scores.append(best)
            want = 1.0 if a == b and got[i][0] == got[j][0] else float(np.mean(scores)) if scores else 0.0
            assert abs(digests.likeness(got[i], got[j]) - want) < 1e-9


@pytest.mark.parametrize("n", [200, 250, 256, 400, 2000])
def test_likeness_does_not_break_at_a_length(n):
    rng = random.Random(n)
    rarity = np.arange(digests.BINS)[::-1].copy()
    near = []
    for _ in range(40):
        text = prose(rng, n)[:n]
        a, b = digests.digest([text.encode(), (text + " another").encode()], rarity)
        near.append(digests.likeness(a, b))
    assert np.mean(near) > 0.85


def test_entropy_bins_match_counting():
    data = np.frombuffer(bytes(random.Random(3).choices(b"aab cdefg", k=300)), np.uint8)
    for i, got in enumerate(digests.entropy_bins(data)):
        p = np.bincount(data[i : i + 16]) / 16
        p = p[p > 0]
        assert abs(got - 1000 * -(p * np.log2(p)).sum() / 4) <= 1.01


def test_word_hashes_agree_wherever_a_word_stands():
    rng = random.Random(3)
    for text in (prose(rng, 400), "A b\x0bB\ta  ünï\u00a0x \r\n z", "", " ", "x" * 3000 + " y", None):
        words = (text or "").encode().lower().split()
        got = passages.word_hashes(text).tolist()
        assert got == [passages.word_hashes(w.decode())[0] for w in words] and len(set(got)) == len(set(words))
    whole, passages.PIECE = passages.word_hashes(prose(random.Random(3), 400)).tolist(), 64
    try:
        assert passages.word_hashes(prose(random.Random(3), 400)).tolist() == whole
    finally:
        passages.PIECE = 1 << 20


def test_compact_windows_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, least = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        v = rng.integers(0, 25, n).astype(np.uint64)
        a, left, r = passages.compact_windows(v, least)
        want = []
        for c in range(n):
            i = j = c
            while i > 0 and v[i - 1] > v[c]:
                i -= 1
            while j < n - 1 and v[j + 1] >= v[c]:
                j += 1
            if j - i + 1 >= least:
                want.append((c, i, j))
        assert sorted(zip(a.tolist(), left.tolist(), r.tolist())) == sorted(want)


def test_repeated_passages_are_found_and_removed(docs, rows):
    found = {r.doc_id for r in passages.repeated_passages(docs).collect()}
    texts = {r[0]: (r[1] or "").lower().split() for r in rows if r[0] is not None}
    first, want = {}, set()
    for i in sorted(texts):
        for k in range(len(texts[i]) - passages.MIN_WORDS + 1):
            if first.setdefault(tuple(texts[i][k : k + passages.MIN_WORDS]), i) != i:
                want.add(i)
    assert want and want <= found and found - want <= {62, 63}
    after = passages.without_repeats(docs)
    assert after.columns == docs.columns
    left = {r.doc_id: r for r in after.collect()}
    n = len(rows)
    assert len(left[n - 3].text.split()) < len(texts[n - 3]) and left[n - 4].text == rows[n - 4][1]
    assert left[None].text == "no id here"


def test_language_on_invented_languages(spark):
    rng = random.Random(5)

    def text(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))

    rows = [(i, text("abcde" if i % 2 else "cdefg", rng.randint(5, 60)), "p" if i % 2 else "q", None, None, None, None) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None, "p", None, None, None, None), (1001, "12 34 !", None, None, None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in language.identify_language(docs).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows]) > 0.97
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert language.known_language(docs).count() <= 400


def test_media_round_trips(docs, rows):
    files = media.payload_digests(media.media_features(media.text_media(docs))).collect()
    want = {r[0]: (r[1] or "").encode() for r in rows}
    for r in files:
        raw = want[r.doc_id]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.payload_bytes == len(payload) and r.n_bytes == len(raw)
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.error is None
    pixels = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert (media.decode(media.encode_pgm(pixels)) == pixels).all()
    assert (media.decode_netpbm(b"P1\n# c\n3 2\n1 0 1\n0 1 0") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    assert np.allclose(media.resize_area(np.ones((5, 7)) * 9, 3, 4), 9) and np.isclose(media.resize_area(pixels, 1, 1)[0, 0], pixels.mean())
    head = b"BM" + (54 + 8 * 2).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    head += (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    bmp = media.decode(head + bytes([1, 2, 3, 4, 5, 6, 0, 0]) + bytes([7, 8, 9, 10, 11, 12, 0, 0]))
    assert bmp.tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]


def test_bad_media_give_errors(spark):
    files = spark.createDataFrame([(1, b"junk"), (2, None), (3, b"P5\n9 9\n255\n")], "id int, media binary")
    assert all(r.error and r.tile is None for r in media.media_features(files).collect())
    head = b"BM" + bytes(8) + (66).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (32).to_bytes(2, "little") + (3).to_bytes(4, "little") + bytes(20)
    masks = [(0xFF0000, 0xFF00, 0xFF), (0xFF, 0xFF00, 0xFF0000)]
    good, swapped = (head + b"".join(m.to_bytes(4, "little") for m in ms) + bytes([3, 2, 1, 0]) for ms in masks)
    assert media.decode(good).tolist() == [[[1, 2, 3]]]
    for bad in (swapped, b"P1\n2 1\n9 1"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_mixing_comes_near_its_targets(docs, rows):
    got = mixing.mix(docs).collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    taken, target, size = {}, {}, {}
    for r in got:
        assert r.taken <= 3 * int(r["size"]) and r.taken == r.copies * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert len(got) == len(rows) and abs(sum(target.values()) - total) < 1e-6
    assert all(target[s] <= 3 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 0.1 * target[s] for s in target)
    assert sorted((r.doc_id or -1, r.taken) for r in mixing.mix(docs).collect()) == sorted((r.doc_id or -1, r.taken) for r in got)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_warc_reads_back(spark, tmp_path):
    rows = [(1, "u1", "<p>a</p>", 0), (2, "u2", "<p>a</p>", 0), (3, None, None, 0), (4, "u4", "", 0), (5, "x\ny", "é\r\n\r\nz" * 5000, 0), (None, "n", "<p>a</p>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, frame int")
    got = {r.page_id: r for r in warc.read_records(warc.archive(pages, str(tmp_path / "w"))).collect()}
    assert len(got) == 6 and got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == "response"
    assert got[3].refers_to == 4 and got[5].payload == rows[4][2].encode() and got[None].record_type == "response"
    assert got[1].payload_bytes == 8 and got[1].payload_digest == got[2].payload_digest and len(got[1].payload_digest) == 32


def test_licences_match_brute_force(spark):
    texts = ["MIT License", "x cc-by, CC BY cc  by", "the GNU General Public License and the Apache License, Version 2.0", None, "", "mit licenses", "été MIT license", "mit license " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(docs).collect():
        words = [w.decode() for w in licenses.words_of(texts[r.doc_id] or "")]
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert r.n_base == len(places) and r.n_words == len(words)
        assert r.first_word == min((p[0] for p in places), default=None) and r.last_word == max((p[0] for p in places), default=None)
        assert r.base_labels == ",".join(sorted({p[1] for p in places})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert 0 <= r.score <= 1


def test_length_histogram_matches_counting(docs, rows):
    encoder = token_counts._encoder(str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    want = [len(encoder.encode_ordinary(r[1] or "")) for r in rows]
    got = token_counts.length_histogram(token_counts.encoded_lengths(docs, str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)).collect()
    for r in got:
        assert r.docs == want.count(r.n_tokens) and r.docs_longer == sum(x > r.n_tokens for x in want)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in want) and r.tokens_within == sum(x for x in want if x <= r.n_tokens)


def test_simhash_matches_brute_force(docs, rows):
    def brute(text):
        words = text.encode().lower().split()
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {r[0]: brute(r[1] or "") for r in rows}
    parent = {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)), key=lambda k: 1 << 62 if k is None else k)
                parent[y] = x
    for r in simhash.simhash_components(docs).collect():
        assert r.fp & (1 << 64) - 1 == fps[r.doc_id] and r.component_id == find(r.doc_id)


def test_near_duplicates_go(docs):
    kept = simhash.keep_first_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {60, 61, 63} and None in ids and {1, 2, 4} <= ids


def test_empty_tables(spark, empty):
    path = str(public.path("word_bpe_49k.json"))
    assert packing.pack_documents(empty, path).count() == 0
    assert digests.fingerprint_pairs(empty).count() == 0
    assert passages.repeated_passages(empty).count() == 0 and passages.without_repeats(empty).count() == 0
    assert language.identify_language(empty).count() == 0
    assert media.media_features(media.text_media(empty)).count() == 0
    assert mixing.mix(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_first_of_each(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_bundles(warc.with_record_types(pages))).count() == 0


def test_sketches_estimate_similarity():
    rng = random.Random(5)
    words = prose(rng, 300).split()
    for changed in (0, 6, 30, 120):
        other = words.copy()
        for i in rng.sample(range(300), changed):
            other[i] = "changed%d" % i
        s, t = (simhash._shingle_set(" ".join(w)) for w in (words, other))
        a, b = (simhash._sketch(" ".join(w)) for w in (words, other))
        alike = 1 - 2 * int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) / simhash.SKETCH_BITS
        assert abs(alike - len(s & t) / len(s | t)) < 0.17
    assert len(simhash._sketch("")) == len(simhash._sketch("one")) == simhash.SKETCH_BITS // 64


def test_components_of_near_texts_match_brute_force(spark):
    """A crowd of near copies of one text, some further off, its exact copies, and unlike texts: against all pairs."""
    rng = random.Random(9)
    base, texts = prose(rng, 150).split(), []
    for k in range(240):
        w = base.copy()
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    texts += [prose(rng, 150) for _ in range(40)] + texts[5:8]
    sets = [simhash._shingle_set(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    want = {i for i in range(len(texts)) if find(i) == i}
    got = {r.doc_id for r in simhash.keep_first_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert 40 < len(want) < 200 and got == want


def test_near_duplicates_with_block_edits_go(spark):
    """A header, a footer, a cut or a replaced paragraph: 0.8 or more alike, with many other words."""
    rng = random.Random(11)
    texts, copies = [], []
    for i in range(40):
        w = prose(rng, 200).split()
        block = prose(rng, 40).split()
        copy = [block + w, w + block, w[36:], w[:80] + block[:16] + w[96:]][i % 4]
        s, t = (simhash._shingle_set(" ".join(x)) for x in (w, copy))
        assert len(s & t) >= 0.8 * len(s | t)
        texts += [" ".join(w), " ".join(copy)]
        copies.append(2 * i + 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first_of_each(docs).collect()} == set(range(80)) - set(copies)


def test_texts_of_the_same_words_in_another_order_are_all_compared(spark):
    """An unlike text with the smallest doc_id and the same distinct words hides no pair."""
    rng = random.Random(12)
    words = sorted(set(prose(rng, 300).split()))[:200]
    orders = [rng.sample(words, 200) for _ in range(3)]
    texts = [" ".join(w) for w in (*orders, orders[1][90:] + orders[1][:90], orders[2][5:] + orders[2][:5])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first_of_each(docs).collect()} == {0, 1, 2}


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(6)

    def text(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))

    rows = [(i, text("abcde" if i % 2 else "cdefg", rng.randint(5, 60)), "p" if i % 2 else "q", None, None, None, None) for i in range(400)]
    odd = [(1000 + i, text("бвгдежз" if i % 2 else "漢字仮名交文章", 5 + 10 * i), None, None, None, None, None) for i in range(20)]
    left = {r.doc_id for r in language.known_language(spark.createDataFrame([*rows, *odd], SCHEMA)).collect()}
    assert not left & {r[0] for r in odd} and len(left) >= 396


def test_a_near_passage_beside_heavy_edits_is_verified():
    """96 words with one edit, then an edit in every seventh word: the whole is unlike, the 96 words are not."""
    a = np.arange(1000, 1400, dtype=np.uint32)
    b = a.copy()
    b[48] = 1
    b[96::7] = np.arange(2, 2 + len(b[96::7]))

    def found(a, b):
        runs = np.stack(passages._runs(a, b, np.array([(0, 0, 90, 0, len(b))])), axis=1)
        return passages.verify(a, b, sorted(map(tuple, runs.tolist())))

    assert any(x == 0 and x + n >= 96 and s >= 0.8 for x, n, _, _, s in found(a, b))
    assert not found(a[96:], b[96:])


def test_runs_find_their_chain_among_many_open_ones():
    runs = [(0, 0, 30), *((31, 5000 + 100 * k, 6) for k in range(6)), (38, 38, 30)]
    assert [(0, 0, 30), (38, 38, 30)] in passages._chains(runs)


def test_passages_that_the_first_document_holds_in_part_are_found(spark):
    """D0 has 30 words of a passage that D1 and D2 share whole: D2 is found by D1."""
    rng = random.Random(21)
    texts = []
    for _ in range(30):
        passage = prose(rng, 80).split()
        texts += [prose(rng, 60).split() + part + prose(rng, 60).split() for part in (passage[25:55], passage, passage)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id for r in passages.repeated_passages(docs).where("n_words >= 80").collect()}
    assert found == set(range(2, 90, 3))


def test_passages_are_found_whatever_part_of_them_earlier_documents_hold(spark):
    """55 equal words in two documents, and an earlier document with 12 to 49 of them; all texts are unlike otherwise."""
    rng = random.Random(25)
    texts = []
    for i in range(200):
        passage, n = prose(rng, 55).split(), (12, 25, 34, 40, 45, 49)[i % 6]
        start = rng.randrange(0, 55 - n + 1)
        texts += [prose(rng, 60).split() + part + prose(rng, 60).split() for part in (passage[start : start + n], passage, passage)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.match_doc_id) for r in passages.repeated_passages(docs).where("n_words >= 55").collect()}
    assert found == {(i + 2, i + 1) for i in range(0, 600, 3)}


def test_a_passage_at_two_places_of_a_document_is_found_at_both(spark):
    rng = random.Random(23)
    texts, want = [], set()
    for i in range(20):
        common = prose(rng, 60)
        texts += [" ".join((prose(rng, 60), common, prose(rng, 60))), " ".join((prose(rng, 60), common, prose(rng, 60), common, prose(rng, 60)))]
        want |= {(2 * i + 1, 60, 60), (2 * i + 1, 180, 60)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.start_word, r.n_words) for r in passages.repeated_passages(docs).collect()} == want


def test_repeated_lines_are_found_whole(spark):
    """One line again and again, of any period, in documents of different lengths."""
    rng = random.Random(24)
    texts = []
    for period in (1, 2, 7, 11, 13, 30):
        line = prose(rng, period)
        texts += [prose(rng, 60) + " " + " ".join([line] * (90 // period)) + " " + prose(rng, 60), prose(rng, 70) + " " + " ".join([line] * (400 // period))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    covered = {}
    for r in passages.repeated_passages(docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    for i in range(1, len(texts), 2):
        assert covered[i] >= set(range(70, len(texts[i].split())))


def test_recall_of_near_passages_at_the_threshold(spark):
    """50 to 56 words with one edit (similarity 0.80 to 0.83) in unlike surroundings: 399 of 400 or more are found."""
    rng = random.Random(22)
    texts = []
    for i in range(400):
        a = prose(rng, 50 + i % 7).split()
        b = a.copy()
        b[rng.randrange(10, 40)] = "changed"
        assert passages._similar(*(passages.word_hashes(" ".join(x)) for x in (a, b))) >= 0.8
        texts += [prose(rng, 60).split() + x + prose(rng, 60).split() for x in (a, b)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id for r in passages.repeated_passages(docs).collect()}
    assert found <= set(range(1, 800, 2)) and len(found) >= 399
