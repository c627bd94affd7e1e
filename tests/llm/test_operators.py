"""Small tests of the operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from merkleframe.llm import language, linedup, neighbours, packing, pieces, rptrees, sharding, simhash, tokenids, toxicity
from merkleframe.llm.pieces import PieceEncoder, decode_pieces, encode_pieces, round_trip_digests
from merkleframe.llm.queries import OP1_SQL, tokenizer_path

LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [None, "", " \n\t ", "a", "a b", "a b c", "A B C", "a b c", "é ß 中文 \x00 🙂", LONG, LONG]


# sharding


def greedy_shards(sizes: list[int], capacity: int) -> int:
    n, room = 0, -1
    for s in sizes:
        if s > capacity:
            n, room = n + 1, -1
        elif s > room:
            n, room = n + 1, capacity - s
        else:
            room -= s
    return n


@pytest.mark.parametrize("kind", ["even", "hot", "few", "wild"])
def test_minimax_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    r = random.Random(kind)
    sizes = {"even": [1] * 300, "hot": [3] * 200 + [2000, 5000], "few": [7, 9, 1], "wild": [int(r.lognormvariate(4, 2)) + 1 for _ in range(400)]}[kind]
    rows = sorted(("%032x" % r.getrandbits(128), s) for s in sizes)
    groups = spark.createDataFrame(rows, "group_key string, bytes long")
    capacity, starts = sharding.boundaries(groups, 16)
    ordered = [s for _, s in rows]
    floor = max(1, -(-sum(sizes) // 16) // 4)
    smallest = next(c for c in range(floor, sum(sizes) + 1) if greedy_shards(ordered, c) <= 16)
    assert capacity == smallest
    fill = [0] * 16
    members = [0] * 16
    for key, s in rows:
        k = sum(key >= x for x in starts)
        fill[k] += s
        members[k] += 1
    assert all(f <= capacity or m == 1 for f, m in zip(fill, members))


def test_shard_documents(spark, docs, clashing):
    got = sharding.shard_documents(clashing(docs(*ODD, ids=[0, 1, 2, 3, 4, 4, None, 7, 8, 9, 10])))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = got.collect()
    assert len(got) == len(ODD) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        text = dict(zip([0, 1, 2, 3, 4, None, 7, 8, 9, 10], [*ODD[:5], *ODD[6:]])).get(r.doc_id)
        assert r.doc_id == 4 or (r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode()))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in got if r.doc_id in (9, 10)}) == 1
    assert sharding.shard_documents(docs()).count() == 0


def test_equal_texts_stay_together(docs):
    r = random.Random(2)
    texts = ["copy " * 40] * 60 + [" ".join(r.choice("abcdefg") for _ in range(r.randint(1, 50))) for _ in range(200)]
    got = sharding.shard_documents(docs(*texts)).collect()
    where = {}
    for row in got:
        where.setdefault(texts[row.doc_id], set()).add(row.shard)
    assert all(len(s) == 1 for s in where.values())


# packing


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80))
def test_packing_keeps_all_pieces(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    sequence, offset, final = packing.pack(sizes, (16, 32, 64), 2)
    for q in range(len(final)):
        own = [k for k in np.flatnonzero(sequence == q) if sizes[k]]
        ends = sorted((offset[k], offset[k] + sizes[k]) for k in own)
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and (not ends or ends[0][0] == 0)
        used = ends[-1][1] if ends else 0
        assert final[q] == next(c for c in (16, 32, 64) if c >= used)
    if sizes.sum():
        single = sum(packing.pack(sizes, (64,), 2)[2])
        assert final.sum() <= single


def slow_pack(sizes, lengths, overhead):
    """Best fit by looking at every open sequence: (capacity, pieces) of each; of equal rooms, the one that came to it last."""
    open_, left = [], sum(sizes)
    for k, size in enumerate(sizes):
        left -= size
        if not size:
            break
        fitting = [(o["room"], -o["since"], j) for j, o in enumerate(open_) if o["room"] >= size]
        if fitting:
            own = open_[min(fitting)[2]]
        else:
            mean = left / (len(sizes) - k - 1) if k + 1 < len(sizes) else 0
            cost = lambda c: (c + overhead) / (size + (min(left, max(0.0, c - size - mean / 2)) if mean else 0.0))  # noqa: B023, E731
            own = {"capacity": min((c for c in lengths if c >= size), key=lambda c: (cost(c), c)), "room": 0, "pieces": []}
            own["room"] = own["capacity"]
            open_.append(own)
        own["room"] -= size
        own["since"] = k
        own["pieces"].append(size)
    return open_


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 64), min_size=1, max_size=40))
def test_packing_equals_slow_best_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    sequence, _, final = packing.best_fit(np.array(sizes, np.int64), (16, 32, 64), (16, 32, 64), 2)
    expected = slow_pack(sizes, (16, 32, 64), 2)
    got = [[s for s, q in zip(sizes, sequence) if q == k and s] for k in range(len(final))]
    assert [g for g in got if g] == [o["pieces"] for o in expected]


def test_packing_is_near_the_optimum():
    """Against the cheapest of all ways to part a few pieces."""
    lengths, overhead, r = (16, 32, 64), 2, random.Random(3)

    def cheapest(rest):
        if not rest:
            return 0
        best = float("inf")
        for chosen in range(1 << (len(rest) - 1)):  # who shares a sequence with the first piece
            own = rest[0] + sum(s for j, s in enumerate(rest[1:]) if chosen >> j & 1)
            if own <= lengths[-1]:
                best = min(best, next(c for c in lengths if c >= own) + overhead + cheapest(tuple(s for j, s in enumerate(rest[1:]) if not chosen >> j & 1)))
        return best

    ratios = []
    for _ in range(60):
        sizes = sorted((r.randint(1, 64) for _ in range(r.randint(1, 7))), reverse=True)
        final = packing.pack(np.array(sizes, np.int64), lengths, overhead)[2]
        ratios.append((final.sum() + overhead * len(final)) / cheapest(tuple(sizes)))
    assert min(ratios) >= 1 and np.mean(ratios) < 1.1 and max(ratios) < 1.7


def test_sequences_are_full(spark):
    from pyspark.sql import functions as F

    rows = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    each = rows.groupBy("group", "sequence").agg(F.sum("n_tokens").alias("used"), F.max("sequence_length").alias("length"))
    used, length = each.agg(F.sum("used"), F.sum("length")).first()
    assert used / length > 0.995


def test_pack_documents(spark, docs, clashing):
    got = packing.pack_documents(clashing(docs(*ODD, ids=[0, 1, 2, 3, 4, 4, None, 7, 8, 9, 10])), (64, 512)).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        assert r.offset + r.n_tokens <= r.sequence_length
    assert tokens[9] == 20001 and tokens[0] == tokens[1] == 0 and tokens[7] == 4 and tokens[4] == 7
    assert sorted(r.piece for r in got if r.doc_id == 10) == list(range(-(-20001 // 512)))
    assert packing.pack_documents(docs()).count() == 0
    spread = packing.pack_documents(docs(*["w " * 50] * 200), group_pieces=20)
    assert spread.select("group").distinct().count() > 5


# SimHash


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbBé \t\n\x0b\x1cß中", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint_text(text) == slow_fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(str(k % 37) for k in range(1000))
    whole = simhash.fingerprint_text(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint_text(text) == whole == slow_fingerprint(text)


def components_by_force(values):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[:k]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


@pytest.mark.parametrize("bound", [1, 4, 64])
def test_links_give_the_same_components(spark, bound):
    from merkleframe.llm.components import connected_components

    r = random.Random(5)
    values = []
    for _ in range(30):
        v = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):  # chains and crowds within few bits
            values.append(v)
            for _ in range(r.randint(0, 3)):
                v ^= 1 << r.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bound)
    for e in edges.collect():
        assert bin((e.u ^ e.v) & (2**64 - 1)).count("1") <= 2
    got = {row.node: row.root for row in connected_components(edges).collect()}
    expected = components_by_force(signed)
    same = lambda m: {frozenset(v for v in signed if m.get(v, v) == x) for x in {m.get(v, v) for v in signed}}
    assert same(got) == same(expected)


def test_components_of_paths_and_stars(spark):
    from merkleframe.llm.components import connected_components

    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 180)] + [(7, 7), (None, 3), (1, 0)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 180)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_and_keep_one(spark, docs, clashing):
    base = " ".join(f"w{k}" for k in range(300))
    near = base.replace("w150 ", "other ")
    r = random.Random(3)
    far = " ".join(str(r.random()) for _ in range(300))
    table = docs(base, far, base, None, "", near, None, ids=[5, 1, 2, 9, 4, 7, None])
    got = {row.doc_id: row.component_id for row in simhash.near_duplicates(clashing(table)).collect()}
    assert got[5] == got[2] == 2 and got[1] == 1 and got[9] == got[4] == got[None] == 4
    assert (got[7] == 2) == (bin(simhash.fingerprint_text(base) ^ simhash.fingerprint_text(near)).count("1") <= 2)
    kept = simhash.keep_one(clashing(table).drop("a.b"))
    assert {row.doc_id for row in kept.collect()} >= {1, 2, 4} and "__kept" in kept.columns
    twice = simhash.keep_one(table.unionAll(table).unionAll(docs(far, ids=[1])))
    assert twice.filter("doc_id = 1").count() == 1 and twice.filter("doc_id = 2").count() == 1
    assert simhash.keep_one(docs()).count() == 0 and simhash.near_duplicates(docs()).count() == 0


# token ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70000) | st.just(0), max_size=200))
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    words, first, _ = tokenids.simple8b_encode(v)
    assert (tokenids.simple8b_decode(words, len(v)) == v).all()
    assert len(first) == 0 or (first[0] == 0 and (np.diff(first) > 0).all())


def test_simple8b_packs():
    assert len(tokenids.simple8b_encode(np.ones(600, np.uint64))[0]) == 10
    assert len(tokenids.simple8b_encode(np.full(300, 50000, np.uint64))[0]) == 100


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "   ", "\n", "\n\n\n", "\t", "é", "ß", "×", "中", "\u3000", "\u2003", "'s", "1", "!", "<|endoftext|>", "\x1c", "\xa0", "don't", ".", "x.\ny", "🙂", "l" * 30]), max_size=14).map("".join))
def test_word_tokenizer_equals_library(text):
    own = tokenids._tokenizer(tokenizer_path("byte_bpe_50k.json"))
    assert np.frombuffer(own([text])[0], "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs, clashing):
    path = tokenizer_path("byte_bpe_50k.json")
    table = clashing(docs(*ODD, ids=[5, 3, 8, 1, None, 2, 2, 9, 11, 10, 12]))
    got = tokenids.token_ids(table, path, 2).orderBy("start").collect()
    library = tokenids._tokenizer(path).library
    ordered = sorted(zip([5, 3, 8, 1, None, 2, 2, 9, 11, 10, 12], ODD), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in ordered]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    for i, t in ordered:
        if i != 2:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
            assert next(np.frombuffer(r.ids, "<u4").tolist() for r in got if r.doc_id == i) == ids
    assert tokenids.token_ids(docs(), path, 2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**31), min_size=1, max_size=40), st.integers(0, 4000), st.integers(0, 4000))
def test_marks_lead_into_a_block(values, a, b):
    ids = np.resize(np.array(values, np.uint64) % 50_000, 4000)
    row = tokenids.block(0, 0, 0, pa.array([1]), np.array([len(ids)]), ids)
    a, b = min(a, b), max(a, b)
    assert (tokenids.ids_between(row["words"], row["marks"], a, b) == ids[a:b]).all()


def test_marks_lead_past_escapes():
    ids = np.array([1 << 63, 5] * 3000, np.uint64)
    row = tokenids.block(0, 0, 0, pa.array([1]), np.array([len(ids)]), ids)
    for a, b in ((0, 6000), (1023, 1025), (2047, 2049), (5999, 6000), (7, 7), (1024, 2048)):
        assert (tokenids.ids_between(row["words"], row["marks"], a, b) == ids[a:b]).all()


def test_read_documents(spark, docs, tmp_path):
    path = tokenizer_path("byte_bpe_50k.json")
    table = docs("one text", "another", "x " * 5000, None, "one text", ids=[4, 7, 9, None, 4])
    tokenids.write_token_files(table, str(tmp_path / "t"), path, 2, block_ids=100)
    every = tokenids.read_token_files(spark, str(tmp_path / "t"))
    got = tokenids.read_documents(spark, str(tmp_path / "t"), spark.createDataFrame([(4,), (9,), (9,), (5,)], "doc_id long"))
    assert sorted((r.doc_id, bytes(r.ids)) for r in got.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in every.collect() if r.doc_id in (4, 9))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(tokenids, "_CHUNK", 50)
    own = tokenids._tokenizer(tokenizer_path("byte_bpe_50k.json"))
    texts = ["", "the cat,  sat\n on the 中 mat. " * 20, "x", "", "y" * 300, "it's é " * 50, ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_memory_is_renewed():
    path = tokenizer_path("byte_bpe_50k.json")
    own = tokenids.WordTokenizer(path, memo=40)
    r = np.random.default_rng(3)
    for _ in range(30):
        texts = [" ".join("".join(r.choice(list("abcé.,1中"), 5)) for _ in range(30)) + " the end" for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(tokenids._Table, "hashed", staticmethod(lambda keys, kinds: (keys[:, 0] >> np.uint64(9)) % np.uint64(3)))
    own = tokenids.WordTokenizer(tokenizer_path("byte_bpe_50k.json"))
    for text in ("one two three four five six, seven", "seven eight one nine; nine 9 nine"):
        assert np.frombuffer(own([text])[0], "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


# pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "   ", "\n", "▁", "é", "中", "ing", "tion", "aaaa", "bcbc", "<s>", "<0x41>", "\x00", "🙂", "ﬁ"]), max_size=14).map("".join))
def test_pieces_equal_library(text):
    own = encoder()
    ids = np.frombuffer(own([text])[0], "<u4").tolist()
    assert ids == own.library.encode(text, add_bos=True, add_eos=True)


_ENCODER = []


def encoder() -> PieceEncoder:
    if not _ENCODER:
        _ENCODER.append(PieceEncoder(tokenizer_path("piece_bpe_32k.model")))
    return _ENCODER[0]


def test_long_words_equal_library():
    r = random.Random(4)
    texts = ["a" * 3000, " " * 50 + "x" + " " * 33, "the" * 500, "".join(r.choice("abcdetniorsl") for _ in range(4000))]
    own = encoder()
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == own.library.encode(texts, add_bos=True, add_eos=True)


@pytest.mark.parametrize("letters", [" ", "\n", "a", "ACGT", "abcdefghijklmnopqrstuvwxyz", "▁th"])
def test_million_characters_without_a_space(letters):
    text = "".join(random.Random(6).choices(letters, k=1_000_000))
    own = encoder()
    start = time.perf_counter()
    got = own([text])[0]
    assert time.perf_counter() - start < 30
    assert np.frombuffer(got, "<u4").tolist() == own.library.encode(text, add_bos=True, add_eos=True)
    assert all(len(w) <= pieces.KEPT for w in own.memo)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="athenorisACGT▁ ", max_size=300))
def test_disturbed_merges_equal_library(text):
    assert np.frombuffer(encoder()([text])[0], "<u4").tolist() == encoder().library.encode(text, add_bos=True, add_eos=True)


def test_piece_tables(spark, docs, clashing):
    path = tokenizer_path("piece_bpe_32k.model")
    table = clashing(docs(*ODD))
    rows = decode_pieces(encode_pieces(table, path), path).collect()
    library = encoder().library
    for r in rows:
        ids = library.encode(ODD[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
    assert round_trip_digests(table, path).count() == len(ODD) and round_trip_digests(docs(), path).count() == 0


# language


def corpus(seed: int, n: int) -> list[tuple[str, str]]:
    r = random.Random(seed)
    parts = {"xx": ["tion", "the", "ing", "er", "an"], "yy": ["keit", "sch", "ung", "ein", "ü"], "zz": ["ció", "que", "os", "ar", "ñ"]}
    word = lambda p: "".join(r.choice(p) for _ in range(r.randint(1, 3)))
    return [(" ".join(word(parts[k]) for _ in range(r.randint(5, 40))), k) for _ in range(n) for k in parts]


def test_language_held_out(spark, clashing):
    rows = [(k, t, lang) for k, (t, lang) in enumerate(corpus(1, 60))]
    table = clashing(spark.createDataFrame([*rows, (9000, None, "xx"), (9001, "text", None)], "doc_id long, text string, lang string"))
    model = language.learn(table)
    assert model.names == ["xx", "yy", "zz"]
    langs, scores = model.predict([t for t, _ in corpus(2, 40)])
    assert np.mean([a == b for a, (_, b) in zip(langs, corpus(2, 40))]) > 0.97
    assert ((scores >= 0) & (scores <= 1)).all()
    assert model.predict([None, "", "123 !?"])[0] == ["und"] * 3
    got = {r.doc_id: r for r in language.identify(table, model).collect()}
    assert got[9000].lang_pred == "und" and got[9000].score == 0 and len(got) == len(rows) + 2
    sparse = language.learn(table.limit(3).repartition(8))  # tasks without rows
    assert sparse.names == ["xx", "yy", "zz"]
    nothing = language.learn(table.limit(0))
    assert nothing.predict(["abc"])[0] == ["und"]


@pytest.mark.parametrize("size", [1, 2, 7, 999])
def test_language_slices_of_long_texts(monkeypatch, size):
    texts = [LONG[:3000], "x", None, "日本語のテキスト。" * 40, "a1b  cd" * 30, "İstanbul ΣΑΣ" * 9]
    whole = language.Trigrams(64).bundles(texts)
    monkeypatch.setattr(language, "_CHARACTERS", size)
    parts = language.Trigrams(64).bundles(texts)
    assert np.allclose(whole[0], parts[0], atol=1e-2) and (whole[1] == parts[1]).all()


def by_hand(t, text):
    """The sum of bound trigrams around each letter, with anything between letters as one class."""
    import unicodedata

    points = []
    for c in f" {text.lower()} ":
        point = ord(c) if unicodedata.category(c)[0] == "L" else 0
        if point or not points or points[-1]:
            points.append(point)
    out = np.zeros(t.dimensions)
    for a, b, c in zip(points, points[1:], points[2:]):
        if b:
            out += np.roll(t.letter(a), 2) * np.roll(t.letter(b), 1) * t.letter(c)
    return out


def test_language_bundle_is_the_sum_of_bound_trigrams():
    t = language.Trigrams(64)
    texts = ["Ab", "Ab, cd!! Ab", "漢字かな交じり文 한글 тест", "é" * 5, "", " 12 "]
    assert (t.bundles(texts)[0] == np.array([by_hand(t, x) for x in texts])).all()
    assert len({t.letter(ord(c)).tobytes() for c in "漢字体文かなカナ한글"}) == 10


def test_language_predictions_equal_brute_force(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate(corpus(3, 30))]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dimensions=256)
    t = language.Trigrams(256)
    unit = lambda x: x / np.linalg.norm(x)
    sums = {name: sum(unit(by_hand(t, x)) for _, x, lang in rows if lang == name) for name in ("xx", "yy", "zz")}
    profiles = {name: unit(x) for name, x in sums.items()}
    mean = unit(sum(profiles.values()))
    apart = lambda x: unit(x - (x @ mean) * mean)
    test = [x for x, _ in corpus(4, 20)]
    langs, scores = model.predict(test)
    for text, lang, score in zip(test, langs, scores):
        near = {name: apart(by_hand(t, text)) @ apart(x) for name, x in profiles.items()}
        assert lang == max(near, key=near.get) and abs(score - np.clip(near[lang], 0, 1)) < 1e-4


def test_language_unspaced_text_takes_bounded_memory():
    import tracemalloc

    t = language.Trigrams(64)
    t.bundles(["字" * 1000])
    tracemalloc.start()
    t.bundles(["漢字かな" * 1_000_000])
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


# toxicity


def labelled(seed: int, n: int) -> list[tuple[str, int]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "in", "on", "re", "and"]) for _ in range(r.randint(1, 4)))
    out = []
    for k in range(n):
        words = [word() for _ in range(r.randint(20, 120))]
        if k % 4 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["blorgfish", "zwackhead", "snivelplug"]))
        out.append((" ".join(words), int(k % 4 == 0)))
    return out


def test_toxicity_held_out(spark, clashing):
    rows = [(k, t, y) for k, (t, y) in enumerate(labelled(1, 800))]
    docs = clashing(spark.createDataFrame([(k, t) for k, t, _ in rows] + [(9000, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(9000, 1), (None, 1), (5, None), (12345, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    test = labelled(2, 300)
    p, y = model.scores([t for t, _ in test]), np.array([c for _, c in test])
    assert (p[y == 1][:, None] > p[y == 0][None, :]).mean() > 0.97
    assert ((p >= 0.5) == y).mean() > 0.95
    got = {r.doc_id: r for r in toxicity.detect(docs, model).collect()}
    assert len(got) == 801 and 0 <= got[9000].score < 0.5 and got[9000].predicted == 0
    assert np.allclose(model.scores([None, ""]), got[9000].score)


def test_toxicity_dictionaries_and_window_lengths():
    """Scores by hand: each window is compressed with either dictionary, on its own."""
    import zstandard

    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "be", "co", "du", "el"]) for _ in range(r.randint(1, 4)))
    plain = [" ".join(word() for _ in range(80)) for _ in range(300)]
    bad = [" ".join(x for w in t.split() for x in ([w, f"snarf{word()}"] if r.random() < 0.05 else [w])) for t in plain[:100]]
    stretches = toxicity.toxic_stretches(bad, plain[100:])
    assert stretches and all(w.startswith(b"snarf") for s in stretches for w in s.split())
    assert sum(len(s.split()) for s in stretches) == sum(t.count("snarf") for t in bad)
    model = toxicity.fit([*bad, *plain[100:]], [1] * 100 + [0] * 200)
    assert len(model.ordinary) == len(model.toxic) and b"snarf" in model.toxic and b"snarf" not in model.ordinary
    form = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)

    def length(window: str, dictionary: bytes) -> int:
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=form)
        return len(zstandard.ZstdCompressor(dict_data=content, compression_params=form).compress(window.encode()))

    for text in (bad[0], plain[200], bad[1].upper(), "", None):
        words = (text or "").lower().split()
        d = [length(f" {' '.join(words[k : k + 8])} ", model.ordinary) - length(f" {' '.join(words[k : k + 8])} ", model.toxic) for k in range(0, max(1, len(words)), 8)]
        top = sorted(d, reverse=True)
        mean = lambda x: sum(x) / len(x)
        least = lambda k: sum(x >= k for x in d)
        figures = [top[0], mean(top[:2]), mean(top[:4]), mean(d), least(3) / len(d), least(4) ** 0.5, least(5) / len(d), least(5) ** 0.5, np.log(len(d))]
        z = sum((f - m) / s * w for f, m, s, w in zip(figures, model.mean, model.scale, model.weights)) + model.weights[-1]
        assert abs(model.scores([text])[0] - 1 / (1 + np.exp(-z))) < 1e-9
    assert (model.scores(bad) >= 0.5).mean() > 0.9 and (model.scores(plain[100:]) >= 0.5).mean() < 0.1


def test_toxicity_passages_shared_by_texts_mark_nothing():
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = text(40)
    assert toxicity.toxic_stretches([text(50) + " " + passage for _ in range(60)], [text(90) for _ in range(60)]) == []


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.scores(["x", None]).tolist() == [0.5, 0.5]


# line dedup


def words(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n))


def dedup(docs, *texts, ids=None, **options):
    got = linedup.drop_repeated_runs(docs(*texts, ids=ids), count="gone", **options).collect()
    return {r.doc_id: r.text for r in got} if ids is None else got


def test_line_runs(docs):
    run = [words(x, 12) for x in "pqrst"]  # 60 words in five lines
    first, second = "\n".join(["own a", *run, "tail a"]), "\n".join(["own b", *run[:3], "", *run[3:], "tail b"])
    got = dedup(docs, first, second, "\n".join(run[:4]), "x\n" + words("z", 60), words("z", 60) + "\ny")
    assert got[0] == first and got[1] == "own b\ntail b"
    assert got[2] == "\n".join(run[:4])  # 48 words
    assert got[3] == "x\n" + words("z", 60) and got[4] == "y"


def test_line_runs_odd(docs, clashing):
    whole = words("w", 80)
    got = dedup(docs, whole, None, "", whole, "short\nshort\nshort", None, "\n".join([whole + "!"] * 3), "a\n\n")
    assert got == {0: whole, 1: None, 2: "", 3: "", 4: "short\nshort\nshort", 5: None, 6: whole + "!", 7: "a\n\n"}
    repeated = dedup(docs, whole, whole, whole, ids=[3, 3, None])
    assert sorted((r.doc_id or -1, r.text, r.gone) for r in repeated) == [(-1, "", 1), (3, whole, 0), (3, whole, 0)]
    assert linedup.drop_repeated_runs(docs()).count() == 0
    table = clashing(docs(whole, whole)).drop("a.b")
    assert linedup.drop_repeated_runs(table).columns == table.columns


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a b c", "d e", "f", "g h i j", "", " "]), max_size=14), min_size=1, max_size=6))
def test_line_runs_equal_brute_force(spark, texts):
    texts = ["\n".join(t) for t in texts]
    least = 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linedup.drop_repeated_runs(docs, least).collect()}
    positions = [[(k, line) for k, line in enumerate(t.split("\n")) if line.split()] for t in texts]
    runs: dict[tuple, list[tuple[int, int]]] = {}
    gone = [set() for _ in texts]
    for d, lines in enumerate(positions):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                part = tuple(line for _, line in lines[a:b])
                if sum(len(x.split()) for x in part) >= least:
                    if part in runs:
                        gone[d] |= set(range(lines[a][0], lines[b - 1][0] + 1))
                    else:
                        runs[part] = [(d, a)]
    assert got == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in enumerate(texts)}


# embeddings


def clouds(seed: int, n: int, dim: int = 16) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.standard_normal((max(1, n // 8), dim))
    return (centres[r.integers(0, len(centres), n)] + 0.12 * r.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize(("leaf", "n"), [(24, 300), (768, 120)])
def test_forest_equals_brute_force(spark, clashing, leaf, n):
    x = clouds(1, n)
    x[5] = x[4]
    label = [k % 2 for k in range(n)]
    rows = [(k, x[k].tolist(), label[k]) for k in range(n)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, x[0].tolist(), None), (905, [], 1), (906, [1.0], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in rptrees.near_duplicates(table.withColumn("c", table.vec_id), leaf=leaf, trees=14).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    found, true = sum(r.n_links for r in got.values()), int(near.sum())
    assert all(got[k].n_links <= near[k].sum() for k in range(n)) and found >= 0.995 * true and true > n
    if leaf > n:
        assert [got[k].n_links for k in range(n)] == near.sum(1).tolist()
        root = list(range(n))
        for _ in range(n):
            root = [min([root[k], *(root[j] for j in np.flatnonzero(near[k]))]) for k in range(n)]
        assert [got[k].component_id for k in range(n)] == root
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert rptrees.near_duplicates(table.limit(0)).count() == 0


def test_crowd_that_no_split_tells_apart(spark):
    """Scaled copies: different vectors at the same place, more than a leaf takes."""
    rows = [(k, [float(2**k % 1000003)] * 4, 1) for k in range(130)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = rptrees.near_duplicates(table, leaf=16, trees=2).collect()
    assert {r.n_links for r in got} == {129} and {r.component_id for r in got} == {0}


def test_dense_group_loses_no_links(spark):
    """Different vectors at pairwise cosines around 0.96, many times a leaf, beside others."""
    r = np.random.default_rng(4)
    x = r.standard_normal((1500, 32))
    x[:1200] = x[0] + 0.2 * r.standard_normal((1200, 32))
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {row.vec_id: row for row in rptrees.near_duplicates(table, leaf=24).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    found = np.array([got[k].n_links for k in range(1500)])
    assert near.sum() > 1_000_000 and (found <= near.sum(1)).all() and found.sum() >= 0.999 * near.sum()
    assert len({got[k].component_id for k in range(1200)}) == 1


def test_rows_of_one_id_equal_sql(spark, tmp_path):
    import duckdb

    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [0.0, 0.0, -1.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (4, c, 0), (4, c, 1), (4, c, 1), (5, near(c), 1), (None, a, 0), (None, None, None), (6, a, 0), (6, a, 0), (7, None, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    table.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    expected = con.sql(f"select vec_id, n_links, component_id, kept from ({OP1_SQL})").fetchall()
    assert sorted(map(str, map(tuple, rptrees.near_duplicates(table).collect()))) == sorted(map(str, expected))


def test_forest_that_splits_equals_brute_force(spark):
    """One label with many times a leaf, at the shipped parameters."""
    n = 10_000
    r = np.random.default_rng(8)
    x = (r.standard_normal((n // 8, 32))[r.integers(0, n // 8, n)] + 0.18 * r.standard_normal((n, 32))).astype(np.float32)
    table = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(8)
    found = np.zeros(n, int)
    for row in rptrees.near_duplicates(table).collect():
        found[row.vec_id] = row.n_links
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.93).sum(1) - 1
    assert (found <= true).all() and found.sum() >= 0.998 * true.sum() and true.sum() > 3 * n


@pytest.mark.parametrize("n", [5, 120, 1500])
def test_search_recall(spark, clashing, n):
    x = clouds(2, n)
    x[1] = x[0]
    rows = [(k, x[k].tolist()) for k in range(n)] + [(10**6, None), (10**6 + 100, [0.0] * 16), (10**6 + 200, [float("inf")] * 16), (None, x[0].tolist()), (10**6 + 300, [1.0])]
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").drop("v"))
    got: dict = {}
    for r in neighbours.search(table, table.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    asked = [k for k in range(n) if k % 100 == 0]
    assert sorted(got) == asked
    hit = 0
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(n), d))[: min(10, n - 1)]
        own = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(best) + 1))
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(best.tolist()))
    assert hit >= 0.9 * len(asked) * min(10, n - 1)
    assert neighbours.search(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_search_probes_few_lists(spark, kind, monkeypatch):
    """Lists at the shipped parameters: recall against brute force, and the share of lists that is probed."""
    r = np.random.default_rng(7)
    n = 24_000
    x = r.standard_normal((n, 32))
    if kind == "clustered":
        x = 3 * r.standard_normal((300, 32))[r.integers(0, 300, n)] + 0.5 * x
    probed = []
    was = neighbours.probes_for
    monkeypatch.setattr(neighbours, "probes_for", lambda *a: probed.append(was(*a)) or probed[-1])
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8).cache()
    hit = 0
    for row in neighbours.search(table, table.filter("vec_id % 400 = 0")).groupBy("query_id").agg({"vec_id": "collect_set"}).collect():
        d = ((x - x[row[0]]) ** 2).sum(1)
        d[row[0]] = np.inf
        hit += len(set(row[1]) & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 10 * 60
    assert probed[0] <= 0.25 * neighbours.LISTS_BY * n**0.5


def test_search_equals_sql_in_one_list(spark, tmp_path):
    import duckdb

    x = clouds(9, 700).astype(float)
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    table.write.parquet(str(tmp_path / "e"))
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in neighbours.search(table, table.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    expected = duckdb.sql(f"""
      SELECT * FROM (
        SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding, e.embedding), e.vec_id) AS rank,
               e.vec_id, round(list_distance(q.embedding, e.embedding), 9)
        FROM '{tmp_path}/e/*.parquet' q JOIN '{tmp_path}/e/*.parquet' e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
      WHERE rank <= 10 ORDER BY 1, 2""").fetchall()
    assert len(set(got) & set(expected)) >= 0.97 * len(expected) and len(got) == len(expected)


def test_scan_abandons_nothing_that_is_near():
    x = clouds(3, 800).astype(float)
    turn = neighbours.rotation(16)
    ids = np.arange(800)
    for q in range(0, 800, 40):
        got, score = neighbours.scan(x, ids, x[q], q, np.inf, np.asfortranarray(x @ turn), x[q] @ turn, 10)
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert len(set(got) & set(np.lexsort((ids, d))[:10])) >= 9


@pytest.mark.parametrize("asked", [1, 3, 5])
def test_scan_finds_exact_copies(asked):
    r = np.random.default_rng(asked)
    x = r.normal(size=(4000, 64))
    x[500:3500] = x[500]
    turn = neighbours.rotation(64)
    turned, at = np.asfortranarray(x @ turn), np.arange(500, 500 + asked)
    for own, q, turned_q in zip(at, x[at], x[at] @ turn):
        copies = [k for k in range(500, 520) if k != own][:10]
        for bound in (float("inf"), 0.0):
            found, score = neighbours.scan(x[490:], np.arange(490, 4000), q, own, bound, turned[490:], turned_q, 10)
            assert found.tolist() == copies and not score.any()
