"""Encoders, shards, mixing, language ID, near-duplicates and vectors against libraries and brute force."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioforge.llm import bpe, langid, mixing, simhash, sstable, vectors
from folioforge.llm.common import among, connected_components
from folioforge.llm.queries import QUERIES

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
POOLS = [
    "abcdefghijklmnopqrstuvwxyz", "aaaaabbbbb", "thethethe inging", "àéîõüßÀÉΣσςİıǅ", "\x1c\x1d\x1e\x1f\x85\xa0   \t\n\x0b\x0c", "0123456789²½Ⅷ", "'s't're've'm'll'd'S",
    "日本語漢字かな한국어", "😀👍🏽é å", "!?.,;:-_/\\@#$%^&*()<|>", "<|endoftext|><|startoftext|>", "İẞﬁ­​﻿\x00\x01",
]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(rng.choice(POOLS) + "   ") for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [t + rng.choice(["", "", "<|endoftext|>", " <|startoftext|>x"]) for t in texts]


@pytest.fixture(scope="module")
def words():
    return bpe.WordTokenizer(WORD)


def test_encoder_equals_the_library(words):
    library, table = Tokenizer.from_file(WORD), bpe.OffsetTable(WORD)
    rng = random.Random(2)
    parts = ["th", "in", "er", "an", "re", "ed", "on", "es", "st", "en", "at", "to", "nt", "ha", "a", "e", "s", "z"]
    texts = [*odd_texts(4000), *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)), "a" * 5000, "ab" * 3000 + " ", ""]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert words.encode(t) == ids, t
        assert table.decode(np.array(ids)).decode() == library.decode(ids, skip_special_tokens=False)
    assert words.encode(None) == []


def test_encoder_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    coder, library = bpe.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    text = " ".join(f"w{i}, {i % 7}" for i in range(300))
    assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(coder.young) <= 10 and len(coder.old) <= 10


def test_encode_and_decode_columns(spark):
    rows = [(1, "Hello  World's end", 5), (2, None, 6), (3, "", 7), (1, "Hello  World's end", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = bpe.encode(docs, WORD, with_decoded=True)
    assert bpe.decode(encoded.withColumnRenamed("decoded", "was"), WORD).where("decoded <> was").count() == 0
    got = encoded.collect()
    library = Tokenizer.from_file(WORD)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(nulls, WORD).collect()] == ["", ""]
    assert len(got) == 4 and bpe.encode(docs.limit(0), WORD).collect() == []


def test_piece_encoder_equals_the_library(monkeypatch):
    library = Tokenizer.from_file(BYTE)
    texts = odd_texts(4000, 3) + ["a  b", " a", "a ", "a \n b", "\n\n a b", " ", "x" * 3000, "".join(map(chr, range(1, 0x260))), " \u0250a b", "été\x85 ²b"]
    for memory in (sstable.MEMORY_BYTES, 2000):
        monkeypatch.setattr(sstable, "MEMORY_BYTES", memory)
        coder = sstable.PieceEncoder(BYTE)
        for t in texts + texts[:500]:
            assert np.frombuffer(coder.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert coder.encode(None) == coder.encode("") == b"" and coder.pieces.held < 3000 and len(coder.pieces) < 30


def test_piece_encoder_leaves_other_vocabularies_to_the_library(tmp_path):
    with open(BYTE, encoding="utf-8") as f:
        made = json.load(f)
    made["normalizer"] = {"type": "Lowercase"}
    changed = tmp_path / "lower.json"
    changed.write_text(json.dumps(made), encoding="utf-8")
    for path in (str(changed), WORD):
        coder, library = sstable.PieceEncoder(path), Tokenizer.from_file(path)
        for t in ["Hello World's END", *odd_texts(200, 5)]:
            assert np.frombuffer(coder.encode(t), coder.kind).tolist() == library.encode(t, add_special_tokens=False).ids


def test_shards(spark):
    library = Tokenizer.from_file(BYTE)
    rng = random.Random(4)
    texts = {i: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 60))) for i in range(-20, 400)}
    rows = [*texts.items(), (7, texts[7]), (7, texts[8]), (1000, None), (1001, ""), (None, "no id"), (None, "none"), (2000, "long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    shards = sstable.write(docs.repartition(3), BYTE, 2, shard_bytes=4000)
    assert shards.manifest.count() > 4
    got = sorted(sstable.read(shards, spark).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    start, digest = 0, lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = sorted((str(doc), digest([*library.encode(text or "", add_special_tokens=False).ids, 2])) for doc, text in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == start
        start += r.n_tokens
    wanted = spark.createDataFrame([(x,) for x in (-20, 7, 399, 2000, 12345, None, 7)], "doc_id long")
    found = defaultdict(list)
    for r in sstable.lookup(shards, wanted).collect():
        found[r.doc_id].append(r.ids)
    assert {k: len(v) for k, v in found.items()} == {-20: 1, 7: 3, 399: 1, 2000: 1}
    assert found[399][0] == [*library.encode(texts[399], add_special_tokens=False).ids, 2]
    everything = {r.doc_id for r in sstable.lookup(shards, docs.select("doc_id")).collect()}
    assert everything == {d for d, _ in rows if d is not None}
    empty = sstable.write(docs.limit(0), BYTE, 2)
    assert sstable.read(empty, spark).collect() == sstable.lookup(empty, wanted).collect() == []


def test_an_id_of_many_rows_is_spread_over_ranges(spark):
    docs = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = sstable.write(docs, BYTE, 2).manifest
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in manifest.groupBy("range").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2500


def mixing_docs(spark):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 4 else f"s{i % 3}") for i in range(3000)] + [(5000, None, "empty"), (5001, "a b", None), (5001, "a b", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("pass", F.lit("clash")), rows


def test_mixing_by_passes(spark):
    docs, rows = mixing_docs(spark)
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    share = {s: n / sum(tokens.values()) for s, n in tokens.items() if n}
    limit = 3.0
    a = 1 - math.log(limit) / math.log(max(share.values()) / min(share.values()))
    weight = {s: p**a for s, p in share.items()}
    weight = {s: w / sum(weight.values()) for s, w in weight.items()}
    got = mixing.mix(docs, mixing.Target(most_passes=limit)).collect()
    assert {(r.doc_id, r.source) for r in got} == {(d, s) for d, _, s in rows}  # every document occurs
    drawn = defaultdict(int)
    for r in got:
        drawn[r.source] += len((r.text or "").split())
        if r.source in weight:
            assert r.weight == pytest.approx(weight[r.source], rel=1e-3)
    for s, w in weight.items():
        assert drawn[s] / sum(drawn.values()) == pytest.approx(w, rel=0.06)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_exponent_and_budget(spark):
    docs, rows = mixing_docs(spark)
    sources = docs.groupBy("source").agg(F.sum(mixing.count_words(F.col("text"))).alias("tokens"))
    p = np.array([r.tokens for r in sources.collect() if r.tokens], float)
    p /= p.sum()

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum() / math.log(len(w))

    a = mixing.find_exponent(sources, mixing.Target(least_entropy=0.7, most_passes=None))
    assert entropy(a) == pytest.approx(0.7, abs=1e-3) and 0 < a < 1
    assert mixing.find_exponent(sources, mixing.Target(least_entropy=None, most_passes=1.0)) == pytest.approx(1.0)
    got = mixing.mix(docs, mixing.Target(least_entropy=0.7, most_passes=None, budget=2000)).collect()
    assert sum(len((r.text or "").split()) for r in got) == pytest.approx(2000, rel=0.1)


def test_language_id(spark):
    rng = random.Random(8)
    pieces = {"aa": ["tho", "ing", "and", "er"], "bb": ["que", "ção", "não", "os"], "cc": ["жен", "щи", "на", "ый"]}
    make = lambda p, n: " ".join("".join(rng.choice(p) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make(pieces[x], rng.choice([3, 30, 200])), x, 1) for i, x in enumerate(rng.choice(["aa", "bb", "cc"]) for _ in range(600))]
    odd = [(9000, None, "aa", 1), (9001, "", "bb", 1), (9002, "12 34 -- \n", "cc", 1), (9003, make(pieces["aa"], 40_000), None, 1), (None, make(pieces["bb"], 50), "aa", 1)]
    docs = spark.createDataFrame(rows + odd + rows[:2], "doc_id long, text string, lang string, score int")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd) + 2
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3
    assert by_id[9003].lang_pred == "aa" and by_id[None].lang_pred == "bb"
    out = [r for r in got if r.held_out and r.doc_id < 9000]
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.99
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).collect() == []


def test_no_label_is_lost(spark):
    rows = [(1, "aaa bab aba", "twice")] * 60 + [(i, "123 456" if i % 50 else "xyz zyx", "rare") for i in range(100, 160)] + [(i, "ooo uou", "same") for i in range(200, 290)]
    docs = spark.createDataFrame([*rows, (999, "12", "none")], "doc_id long, text string, lang string")
    for seed in range(4):
        languages, prototypes = langid.train(docs.withColumn("doc_id", F.col("doc_id") + 1000 * seed), langid.Profile(train_docs=2))
        assert languages == ["rare", "same", "twice"] and prototypes.shape == (3, 512)


def test_language_query_on_held_out_documents(spark):
    got = QUERIES["op6_language_id"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    out = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len(out) > 40 and sum(r.lang_pred == docs[r.doc_id].lang for r in out) / len(out) > 0.9


def test_token_queries_equal_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library, sha = Tokenizer.from_file(WORD), lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = QUERIES["op3_bpe_round_trip"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    library, start = Tokenizer.from_file(BYTE), 0
    got = sorted(QUERIES["op10_token_shards"](spark, SF).collect(), key=lambda r: r.doc_id)
    for r, doc in zip(got, sorted(docs), strict=True):
        ids = [*library.encode(docs[doc], add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_simhash_query_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = np.array([naive_print(docs[i]) for i in ids], np.uint64)
    label = naive_components(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    got = sorted(map(tuple, QUERIES["op8_simhash_near_dedup"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == [(d, f"{p:016x}", ids[x]) for d, p, x in zip(ids, prints, label, strict=True)]


def test_mixing_query_draws_the_weights(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_mix_sources"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs) and len({(r.doc_id, r["pass"]) for r in got}) == len(got)
    words, tokens, drawn = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in docs.items()}, defaultdict(int), defaultdict(int)
    for d, r in docs.items():
        tokens[r.source] += words[d]
    for r in got:
        assert r.source == docs[r.doc_id].source and 0 <= r.block < 200
        drawn[r.source] += words[r.doc_id]
    weight = {r.source: r.weight for r in got}
    assert sum(weight.values()) == pytest.approx(1, abs=1e-6)
    largest = {s: max(words[d] for d, r in docs.items() if r.source == s) for s in tokens}
    for s, w in weight.items():
        assert abs(drawn[s] - w * sum(drawn.values())) <= 0.1 * w * sum(drawn.values()) + 4 * largest[s]
    assert max(drawn[s] / tokens[s] for s in tokens) < 1.5 * 1.2


def test_bound_vectors_are_products_of_permuted_letters():
    profile = langid.Profile(dim=64)
    letters = langid._letters(profile)
    got = langid.document_vectors(["ab", "1", None], profile)
    base = letters[-1]
    codes = [0, 1, 2, 0]
    want = sum(np.roll(base[x], 2) * np.roll(base[y], 1) * base[z] for x, y, z in zip(codes, codes[1:], codes[2:], strict=False))
    assert (got[0] == want).all() and not got[1:].any()


def naive_print(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def naive_components(links):
    label = list(range(len(links)))
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(links[i]))]) for i in range(len(label))]
        if new == label:
            return label
        label = new


def test_simhash(spark, monkeypatch):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(rng.choice([2, 30, 120, 400]))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base[:40]:
        copy = list(w)
        copy[rng.randrange(len(copy))] = "X"
        texts += [" ".join(copy), "\t".join(w).upper()]
    rows = [*enumerate(texts), (900, None), (901, " "), (3, texts[3]), (None, texts[5]), (902, "z " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0))
    prints = np.array([naive_print(t) for _, t in rows], np.uint64)
    links = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = naive_components(links)
    groups = defaultdict(list)
    for i, x in enumerate(label):
        groups[x].append(rows[i][0])
    want = sorted((str(rows[i][0]), f"{prints[i]:016x}", min(d for d in groups[x] if d is not None)) for i, x in enumerate(label))
    for cell in (4096, 3):  # also with every bucket cut into pairs of chunks
        monkeypatch.setattr(simhash, "CELL", cell)
        got = simhash.near_duplicates(docs).collect()
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({x[2] for x in want})
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_tables_miss_no_pair():
    rng = random.Random(10)
    for n in (10, 1 << 30, 1 << 42):
        masks = simhash.tables_for(n, 4)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & (m & (1 << 64) - 1) == 0 for m in masks)


def test_bit_planes_equal_popcounts():
    rng = np.random.default_rng(11)
    center = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    x = np.array([center ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in rng.integers(0, 6, 200)], np.uint64)
    for radius in (0, 1, 3, 4, 7):
        want = {(i, j) for i in range(200) for j in range(i + 1, 200) if int(x[i] ^ x[j]).bit_count() <= radius}
        assert {(i, int(j)) for i, js in simhash.close_pairs(x, radius, 64) for j in js} == want


def test_among_keeps_all_that_match(spark):
    rows = spark.range(40_000).select(F.xxhash64("id").alias("h"), F.lit("x").alias("text"), "id")
    for n, most_bits, others in ((0, 1 << 27, 0), (1, 1 << 27, 100), (5000, 1 << 27, 35_000 // 12), (5000, 1 << 15, 35_000)):
        kept = among(rows, "h", rows.where(F.col("id") < n).select("h"), most_bits)
        assert kept.columns == rows.columns
        ids = {r.id for r in kept.select("id").collect()}
        assert ids >= set(range(n)) and len(ids) <= n + others


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(-5, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == -5 for i in [*range(100, 160), -5])


def test_vectors(spark):
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(60, 16))
    x = np.concatenate([c + 0.12 * rng.normal(size=(rng.integers(1, 25), 16)) for c in centers])
    rows = [(i, [float(y) for y in v], 0) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n + k, rows[k][1], 0) for k in range(9)]  # exact copies
    rows += [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [1.0, None] * 8, 0), (9005, rows[0][1][:8], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    usable = n + 9
    m = np.array([r[1] for r in rows[:usable]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = m @ m.T >= 0.9
    np.fill_diagonal(links, False)
    label = naive_components(links)
    # also with shards cut into pairs of chunks, and with several coarse cells, dealt in portions
    for graph in (vectors.Graph(shard=200), vectors.Graph(shard=200, cell=60), vectors.Graph(shard=60, fine=3, dealt=100, sample=400)):
        answer = vectors.near_duplicates(table, graph)
        got = {r.vec_id: r for r in answer.collect()}
        assert len(got) == len(rows)
        assert all(got[i].n_links <= links[i].sum() for i in range(usable))
        assert sum(got[i].n_links for i in range(usable)) >= 0.97 * links.sum()
        assert np.mean([got[i].component_id == label[i] for i in range(usable)]) > 0.97
        for odd in (9000, 9001, 9002, 9003, 9004, 9005):
            assert (got[odd].n_links, got[odd].component_id, got[odd].kept) == (0, odd, True)
        assert got[None].n_links == 0 and got[None].kept
    assert vectors.audit_recall(table, answer, every=5) >= 0.95
    assert vectors.near_duplicates(table.limit(0)).collect() == []


def test_pruned_lists_keep_the_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    x[100:400] = x[0] + 0.05 * x[100:400]  # one dense group, so that lists outgrow the degree by reverse edges
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.Graph(candidates=20, degree=4)
    lists, top = vectors.shard_graph(x, graph)
    cosines = x @ x.T
    np.fill_diagonal(cosines, -3)
    assert np.allclose(top, cosines.max(axis=1), atol=1e-6)
    assert all(np.isclose(cosines[i, near].max(), top[i], atol=1e-6) and i not in near and len(near) <= 8 for i, near in enumerate(lists))
    alone, top = vectors.shard_graph(x[:1], graph)
    assert [len(near) for near in alone] == [0] and top[0] < -1


def test_groups_larger_than_the_candidates_of_a_vertex(spark):
    rng = np.random.default_rng(13)
    centers = np.linalg.qr(rng.normal(size=(16, 16)))[0][:6]
    centers = np.concatenate([centers, 0.93 * centers + math.sqrt(1 - 0.93**2) * np.roll(centers, 1, axis=0)[:, ::-1]])
    x = np.concatenate([c / np.linalg.norm(c) + 0.005 * rng.normal(size=(80, 16)) for c in centers])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    assert links.sum(axis=1).min() >= 79
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_duplicates(table).collect()}
    assert [got[i].n_links for i in range(len(x))] == links.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == naive_components(links)


def test_pairs_at_the_threshold_share_a_shard_of_many(spark):
    rng = np.random.default_rng(14)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    u, w = unit(rng.normal(size=(3000, 64))), rng.normal(size=(3000, 64))
    v = 0.902 * u + math.sqrt(1 - 0.902**2) * unit(w - (w * u).sum(axis=1, keepdims=True) * u)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([u, v]))], "vec_id long, embedding array<double>")
    links = sum(r.n_links for r in vectors.near_duplicates(table, vectors.Graph(shard=30, sample=1000)).collect())
    assert 0.97 * 6000 <= links <= 6000


def test_links_of_several_coarse_cells_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(15)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    alone = unit(rng.normal(size=(900, 128)))
    groups = np.concatenate([c + 0.02 * rng.normal(size=(k, 128)) for c, k in zip(unit(rng.normal(size=(60, 128))), rng.integers(2, 14, 60), strict=True)])
    x = np.concatenate([alone, groups])[rng.permutation(900 + len(groups))]
    links = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(links, False)
    assert links.sum() > 1000
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    graph = vectors.Graph(shard=100, fine=3, sample=600, dealt=200)
    assert len(vectors.coarse_centres(vectors.classes(table), graph)[128][0]) > 2
    answer = vectors.near_duplicates(table, graph)
    got = {r.vec_id: r for r in answer.collect()}
    assert [got[i].n_links for i in range(len(x))] == links.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == naive_components(links)
    monkeypatch.setattr(vectors, "AUDIT_BYTES", 1 << 14)
    assert vectors.audit_recall(table, answer, every=7) == 1.0
    tight = vectors.coarse_centres(vectors.classes(table), vectors.Graph(shard=100, fine=3, sample_bytes=1 << 17))[128]
    assert len(tight[0]) <= (1 << 17) // (32 * 128)
