"""The joins, alignments and variants of round 3, and repeated rows, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelworks.llm import alignment, jaccard, passages, spelling, wordtok

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gram string, word string"


def rows_of(texts):
    return [(i, t, None, None, None, "clash", None) for i, t in texts]


def prose(rng, n, letters="abcdefgh"):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(1))][0] if n == 1 else " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def near(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


# ---- op11


def jaccard_brute(rows):
    sets = []
    for _, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets.append({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted(((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)), key=str)


def jaccard_rows():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (1, 2, 3, 4, 5, 12, 40, 90, 200, 400)]
    rows = list(enumerate(base))
    for b in base[6:]:
        for edits in (0, 1, 1, 2, 3, 3, 4, 6, 9, 12):
            rows.append((len(rows), near(rng, b, edits)))
    common = prose(rng, 30)  # a line that many texts share
    rows += [(len(rows) + i, f"{common} {prose(rng, 25)} {common}") for i in range(25)]
    whole = prose(rng, 120)
    rows += [(len(rows) + i, near(rng, whole, i % 5)) for i in range(40)]  # one large group of near copies
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, base[0].upper()), (504, base[1]), (7, base[8]), (7, base[8]), (None, base[9]), (None, "only here")]
    return rows


@pytest.mark.parametrize("tile", [jaccard.TILE_GRAMS, 300])
def test_jaccard_components_are_those_of_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_GRAMS", tile)
    rows = jaccard_rows()
    got = jaccard.jaccard_components(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == jaccard_brute(rows)


def test_block_product_is_exact_in_slabs(monkeypatch):
    monkeypatch.setattr(jaccard, "SLAB", 7)
    rng = random.Random(5)
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(1, 30))), np.uint64) for _ in range(40)]
    sets += [s.copy() for s in sets[:5]] + [s[1:] for s in sets if len(s) > 12]
    want = [[100 * len(a & b) >= 90 * len(a | b) for b in map(lambda s: set(s.tolist()), sets)] for a in map(lambda s: set(s.tolist()), sets)]
    assert jaccard.block_product(sets, sets).tolist() == want


def test_first_columns_of_linked_sets_meet():
    """Any order of columns is exact: two sets at the threshold share one of their first columns."""
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = set(rng.sample(range(10**6), n))
        b = set(rng.sample(sorted(a), max(1, n - rng.randint(0, 6)))) | set(rng.sample(range(10**6), rng.randint(0, 3)))
        if 100 * len(a & b) >= 90 * len(a | b):
            order = {x: rng.random() for x in a | b}
            first = [set(sorted(s, key=order.get)[: len(s) - -(-90 * len(s) // 100) + 1]) for s in (a, b)]
            assert first[0] & first[1]


# ---- op12


def aligned_brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    pair = alignment.Pair(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    docs, counts = [], Counter()
    for key, t in rows:
        a, b = (a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)) if t else ([], [])
        raw = b" " + (t or "").encode()
        if not t or b"".join(pair.bytes_a[x] for x in a) != raw or b"".join(pair.bytes_b[x] for x in b) != raw:
            a, b = [], []
        groups, x, y = [], 0, 0
        while x < len(a):
            ga, gb, ea, eb = [], [], 0, 0
            while not ga or not gb or ea != eb:
                if ea <= eb:
                    ga.append(a[x])
                    ea += len(pair.bytes_a[a[x]])
                    x += 1
                else:
                    gb.append(b[y])
                    eb += len(pair.bytes_b[b[y]])
                    y += 1
            groups.append((ga, gb))
        links = [(p, q) for ga, gb in groups for p in ga for q in gb]
        counts.update(set(links))
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        docs.append((key, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    top = Counter()
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    return sorted(((k, a, b, g, len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), h) for k, a, b, g, links, h in docs), key=str)


def aligned_rows():
    rng = random.Random(11)
    letters = "ab cé\n\t \r　᠎▁<s>|endoftext0x0A日本😀.,'s  \x85\x1f​\x00ﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["<|endoftext|> x", "</s><s> <unk> <0x0A>", None, "", " ", "\n", "a\n", "  a", "a  ", "It's  the\n\n end.", "It's  the\n\n end.", prose(rng, 3000)]
    return list(enumerate(texts)) + [(3, "again"), (None, "no id here")]


@pytest.mark.parametrize("few", [alignment.FEW_PAIRS, 0])
def test_alignment_equals_a_walk_over_both_sides(spark, few):
    rows = aligned_rows()
    paths = str(public.path("byte_bpe_50k.json")), str(public.path("piece_bpe_32k.model"))
    got = alignment.aligned_documents(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(2), *paths, few).collect()
    assert sorted((tuple(r) for r in got), key=str) == aligned_brute(rows)


def test_chunks_encode_as_whole_texts_when_the_cache_is_small(monkeypatch):
    monkeypatch.setattr(alignment, "GENERATION", 5)
    pair = alignment.Pair(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    for _ in range(4):
        batch = [prose(rng, 20, "abcé") for _ in range(3)]
        ids, owners = pair.encode(batch)
        for i, t in enumerate(batch):
            assert ids[0][owners[0] == i].tolist() == pair.a.encode(" " + t, add_special_tokens=False).ids
            assert ids[1][owners[1] == i].tolist() == pair.b.encode(t)


# ---- op13


def variants_brute(rows, every):
    counts, lower = Counter(), str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for key, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near_ = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near_.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near_[w]), words.get(form.get(w))) for w, n in words.items())


def variant_rows():
    rng = random.Random(17)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(30)] + ["aaaaaaa", "abababab", "Ééaabbèè", "nation", "nations", "nationss"]
    texts = [" ".join(rng.choice(stems)[: rng.randint(5, 9)] + rng.choice(["", "", "a", "b"]) for _ in range(120)) for _ in range(40)]
    texts += ["nation " * 700, "nations " * 130, "nationss " * 20, None, "", "x1y2 — «¿aaaaaa÷×aaaaaa» Ωaaaaaa aaaaaaΩ", "AAAAAAĀaaaaaa " * 5]
    return list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]


@pytest.mark.parametrize("most,limit", [(spelling.MOST, 4), (spelling.MOST, spelling.LIST), (3, 4), (0, 64)])
def test_variants_equal_all_pairs_under_any_dictionary(spark, most, limit, monkeypatch):
    monkeypatch.setattr(spelling, "MOST", most)
    monkeypatch.setattr(spelling, "LIST", limit)
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = variant_rows()
    got = spelling.variant_groups(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(3), 7)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == variants_brute(rows, 7)


def test_an_edit_changes_no_more_grams_than_the_bound():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 12))) for _ in range(60)]
    counts = Counter(spelling._marked(w)[p : p + q] for w in words for q in range(spelling.SHORTEST, spelling.LONGEST) for p in range(len(w) + 1))
    frequent = frozenset(g for g, n in counts.items() if n > 5)
    for w in words:
        grams = spelling.decompose(w, frequent)
        bound = spelling.affected(grams)
        assert bound < len(grams)
        for _ in range(20):
            i, c = rng.randrange(len(w) + 1), rng.choice("abc")
            for v, shift in ((w[:i] + c + w[i:], 1), (w[:i] + w[i + 1 :], -1), (w[:i] + c + w[i + 1 :], 0)):
                other = set(enumerate(spelling.decompose(v, frequent)))
                kept = sum((p, g) in other or (p + shift, g) in other for p, g in enumerate(grams))
                assert kept >= len(grams) - bound


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    paths = str(public.path("byte_bpe_50k.json")), str(public.path("piece_bpe_32k.model"))
    assert jaccard.jaccard_components(empty).count() == 0
    assert alignment.aligned_documents(empty, *paths).count() == 0
    assert spelling.variant_groups(empty).count() == 0


# ---- earlier operators


def test_repeated_rows_lose_no_passage(spark):
    rng = random.Random(23)
    shared = prose(rng, 1500)
    a, b = f"{prose(rng, 300)} {shared}", f"{shared} {prose(rng, 200)}"
    docs = spark.createDataFrame([(1, a), (1, a), (2, b), (2, b)], "doc_id long, text string")
    found = {(r.doc_id, r.match_doc_id, r.n_words) for r in passages.repeated_passages(docs).collect()}
    assert found == {(2, 1, 1500)}
    kept = {r.doc_id: len(r.text.split()) for r in passages.without_repeats(docs).collect()}
    assert kept == {1: 1800, 2: 200}


def test_different_texts_of_one_id_are_each_searched(spark):
    rng = random.Random(29)
    x, y = prose(rng, 400), prose(rng, 256)
    docs = spark.createDataFrame([(-1, x), (-1, y), (-1, f"{y} {x}"), (2, f"{prose(rng, 60)} {x}"), (3, f"{y} {prose(rng, 60)}"), (None, x)], "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()  # both texts of an id that have a passage may be named
    assert {(r.doc_id, r.match_doc_id) for r in found} == {(2, -1), (3, -1)}
    assert {k: max(r.n_words for r in found if r.doc_id == k) for k in (2, 3)} == {2: 400, 3: 256}
    kept = sorted((str(r.doc_id), len(r.text.split())) for r in passages.without_repeats(docs).collect())
    assert kept == [("-1", 256), ("-1", 400), ("-1", 656), ("2", 60), ("3", 60), ("None", 400)]


def test_ids_do_not_depend_on_neighbours():
    path = str(public.path("word_bpe_49k.json"))
    batch = ["see <|ENDOFTEXT|> here", "a\x01b", "odd　space <|StartOfText|>", "plain"]
    together = wordtok.CachedTokenizer(path).encode(batch)
    for raw, text in zip(together, batch):
        assert raw == wordtok.CachedTokenizer(path)._whole(text)


def test_components_with_one_smallest_id_for_several_texts(spark):
    from panelworks.llm import simhash

    rng = random.Random(31)
    x, y = prose(rng, 300), prose(rng, 300)
    rows = [(7, x), (7, y), (8, near(rng, x, 1)), (9, near(rng, y, 1)), (7, x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.simhash_components(docs, radius=12, segments=4)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(7, 7), (7, 7), (7, 7), (8, 7), (9, 7)]


def test_pipeline_on_a_small_table(spark, tmp_path):
    import corpus_pipeline as cp
    from panelworks.llm import language

    rng = random.Random(41)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(60)] for lang, letters in (("aa", "abcdeiou"), ("bb", "stuvwxyz"))}

    def text(lang, n):
        return " ".join(rng.choice(vocabulary[lang]) for _ in range(n))

    rows = [(i, text(lang, 150), lang, ("s1", "s2")[i % 3 == 0]) for i, lang in enumerate(["aa", "bb"] * 40)]
    shared = text("aa", 80)
    rows += [(100, near(rng, rows[0][1], 2), "aa", "s1"), (101, f"{text('aa', 40)} {shared}", "aa", "s1"), (102, f"{text('aa', 50)} {shared}", "aa", "s2"), (103, None, "aa", "s1"), (104, "", None, "s1"), (0, rows[0][1], "aa", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    read, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES:
        out = stage(spark, read, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        kept[name] = read.collect()
    ids = {n: sorted(r.doc_id for r in rows_) for n, rows_ in kept.items()}
    assert 103 not in ids["language_id"] and 104 not in ids["language_id"] and set(range(80)) <= set(ids["language_id"])
    assert 100 not in ids["simhash_near_dedup"] and ids["simhash_near_dedup"].count(0) == 1 and set(range(80)) <= set(ids["simhash_near_dedup"])
    later = {r.doc_id: r.text for r in kept["substring_dedup"]}
    assert len(later[102].split()) == 50 and len(later[101].split()) == 120 and all(later[i] == rows[i][1] for i in range(80))
    assert set(ids["mixing"]) <= set(later)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in kept["packing"]:
        pieces[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 4096 and sorted(p)[0][0] == 0 for p in pieces.values())
    words = sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept["mixing"])
    assert sum(r.length for r in kept["packing"]) == words
    assert cp.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] == words
