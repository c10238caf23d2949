"""The registered operator queries: those with SQL against it, the pipeline's stages against brute force."""

from __future__ import annotations

import glob
import hashlib
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioforge.llm import simhash
from folioforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    made = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        made.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def rows(found):
    return sorted(tuple("null" if v is None else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    df, want = QUERIES[name](spark, SF), sql.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert rows(df.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def shingle_set(text, size=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} or ({b" ".join(words)} if words else set())


def naive_representatives(texts, similarity=0.8):
    """The smallest id of each group of texts whose sets of shingles are linked by their similarity, by comparing all."""
    ids = sorted(texts)
    sets = [shingle_set(texts[i]) for i in ids]
    label = list(range(len(ids)))
    for j in range(len(ids)):
        for i in range(j):
            if label[i] != label[j] and (sets[i] == sets[j] or (sets[i] & sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]))):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sorted({ids[x] for x in label})


def test_pipeline_run(spark, sql):
    """The rows of the whole pipeline against each stage's brute force on what the stage before kept."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lettered = {d for d, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    clean = corpus_pipeline.line_dedup_stage(spark, spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(sorted(lettered))), SF)
    kept = {r.doc_id: r.text for r in clean.collect()}
    want = naive_representatives(kept)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert r.source == docs[r.doc_id].source and list(r.ids) == library.encode(kept[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_pipeline(spark, sql):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == columns
    want = {d for d, t in sql.sql("SELECT doc_id, text FROM documents").fetchall() if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in kept.collect()} == want

    clean = corpus_pipeline.line_dedup_stage(spark, docs, SF)
    assert clean.columns == columns
    digests = dict(sql.sql(f"SELECT doc_id, text_sha256 FROM ({ORACLES['op5_line_dedup']}) WHERE n_removed < n_lines OR n_removed = 0").fetchall())
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in clean.collect()} == digests

    one = corpus_pipeline.near_dedup(spark, docs, SF)
    assert one.columns == columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    assert sorted(r.doc_id for r in one.collect()) == naive_representatives({i: texts[i] for i in ids})

    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == columns and {r.doc_id for r in mixed.select("doc_id").collect()} == set(ids)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.encode(spark, docs, SF).collect():
        ids_ = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids_ and r.decoded_sha256 == hashlib.sha256(library.decode(ids_, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "Some words of a text that is long enough to be kept by every stage of it."
    odd = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "12 34", "en", "a", 5), (4, text, "en", "a", 70), (4, text, "en", "a", 70), (None, text, "en", "b", 70)], schema)
    for docs, want in ((odd, {4, None}), (odd.limit(0), set())):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF), "stage")
            assert docs.columns == odd.columns
        out = corpus_pipeline.encode(spark, docs, SF).collect()
        assert {r.doc_id for r in out} == want
        assert all(r.n_tokens == len(r.ids) > 10 for r in out)
        assert {r.doc_id for r in docs.where("text IS NULL").collect()} == set()


def test_pipeline_near_dedup_finds_similarity_of_four_fifths(spark):
    rng = random.Random(21)
    rows = []
    for i in range(40):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
        copy = list(words)
        for k in range(8 if i < 20 else 10):  # each takes 5 of 396 shingles: similarity 0.816, below 0.8 with 10
            copy[20 + 38 * k] = "X"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs, simhash.similar(docs)).collect()} == {d for d, _ in rows if d % 2 == 0 or d >= 40}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()}
    assert {d for d in kept if d < 40} == set(range(0, 40, 2))


def test_similar_texts_against_all_pairs(spark, monkeypatch):
    rng = random.Random(22)
    base = [[f"w{rng.randint(0, 30)}" for _ in range(rng.choice([1, 4, 6, 9, 30, 90]))] for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for w in base * 2:
        copy = list(w)
        for _ in range(rng.choice([0, 1, 1, 2])):
            copy[rng.randrange(len(copy))] = "X"
        texts.append(" ".join(copy))
    rows = [*enumerate(texts), (900, None), (901, " \t"), (3, texts[3]), (902, "z " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0))
    for cell, size, turns in ((256, 1 << 24, 2), (3, 1 << 24, 1), (256, 2000, 1), (5, 100, 0)):
        monkeypatch.setattr(simhash, "SMALL_CELL", cell)
        monkeypatch.setattr(simhash, "SET_BYTES", size)
        monkeypatch.setattr(simhash, "TURNS", turns)
        found = simhash.similar(docs)
        assert found.count() == len(rows)
        assert sorted(r.doc_id for r in simhash.keep_one(docs, found).collect()) == naive_representatives(dict(rows))
    assert simhash.similar(docs.limit(0)).collect() == []


def test_language_stage_without_labels(spark):
    rows = [(1, None, None), (2, "12 34", None), (3, "Some words", None), (None, "été", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == {3, None}


def test_texts_that_share_an_id_are_told_apart(spark):
    rows = [(3, "a text of some words that is found twice"), (5, "a text of some words that is found twice"), (5, "another one of which there is only this copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"text_key": F.lit("clash"), "first": F.lit(1)})
    found = simhash.keep_one(docs, simhash.similar(docs))
    assert found.columns == docs.columns and sorted((r.doc_id, r.text) for r in found.collect()) == [rows[0], rows[2]]
    again = docs.unionByName(docs)
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(again, simhash.similar(again)).collect()) == [rows[0], rows[2]]


def test_a_group_of_copies_costs_its_size(spark, monkeypatch):
    """Whole texts compared for a template's copies: each about once, at any size of the group."""
    rng = random.Random(5)
    template = [f"w{k}" for k in range(120)]
    pairs = []
    real = simhash.spanning_candidates
    sizes = {}
    for n in (150, 300, 600):
        rows = []
        for i in range(n):
            copy = list(template)
            copy[rng.randrange(120)] = f"x{i}"
            rows.append((i, " ".join(copy)))
        keys = {t: simhash.shingles(t.encode(), 5) for _, t in rows}
        one = [np.array(x, np.int64) for x in ([*range(n)], [simhash.set_print(h) for h in keys.values()], [len(h) for h in keys.values()], [*range(n)])]
        pairs = real(*one, 0.8, 0)
        sizes[n] = len(pairs)
        assert len(simhash.apart(*one[:3], np.zeros(n, np.int64), 0.8)) == 0
    assert sizes == {150: 149, 300: 299, 600: 599}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "SMALL_CELL", 100)
    assert [r.doc_id for r in simhash.keep_one(docs, simhash.similar(docs)).collect()] == [0]


def test_near_dedup_moves_only_candidates_texts(spark, monkeypatch):
    """Tables of texts without near copies are neither written again nor shuffled to find a few that have some."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(1500))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " and some more words") for i in range(5)]
    size = sum(len(t) for _, t in rows)
    written = {}

    def spy(df, name, real=simhash.materialise):
        out = real(df, name)
        written[name] = sum(os.path.getsize(f) for path in {os.path.dirname(f.removeprefix("file:")) for f in out.inputFiles()} for f in glob.glob(f"{path}/*.parquet"))
        if name == "sets":
            written["rows of sets"] = out.count()
        return out

    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    monkeypatch.setattr(simhash, "materialise", spy)
    docs = simhash.materialise(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        found = simhash.similar(docs)
        moved = shuffled() - before
        assert sorted(r.doc_id for r in found.where("first").collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert written.pop("rows of sets") == 10
    assert written.pop("docs") > 0.4 * size
    assert sum(written.values()) < 0.2 * size
    assert moved < 0.3 * size
