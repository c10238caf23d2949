"""Whitening, fill-in-the-middle and decontamination against plain numpy and plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import decontaminate as dc
from folioforge.llm import fill_middle, whitening
from folioforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_whitening(vectors, components=4):
    x = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1))
    e, u = e[::-1], u[:, ::-1]
    return n, [int(d) for d in ((n * x.astype(object) - sums) ** 2).sum(axis=1)], ((x - sums / n) @ u[:, :components]) / np.sqrt(e[:components]), e[:components] / e.sum()


def check_whitening(rows, vectors, ids):
    n, far, white, share = plain_whitening(vectors)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(set(ids)) * white.shape[1]
    signs = [math.copysign(1, by[ids[0], c + 1].whitened * white[0, c]) for c in range(white.shape[1])]
    for i, w, d in zip(ids, white, far, strict=True):
        for c in range(len(w)):
            r = by[i, c + 1]
            assert (r.n, r.deviation) == (n, d) and abs(r.whitened - signs[c] * w[c]) < 1e-9 and abs(r.explained / share[c] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    check_whitening(QUERIES["op11_whitening"](spark, SF).collect(), np.stack(table["embedding"]), table["vec_id"].tolist())


def test_whitening_merges_factors_and_takes_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 6)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.1])).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    good = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    monkeypatch.setattr(whitening, "MERGE_BYTES", 1)  # two factors a task
    check_whitening(whitening.whiten(good).collect(), x, list(range(300)))
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] * 6), (904, [math.inf] * 6), (0, rows[0][1]), (None, rows[1][1]), (905, [1.0, 2.0])]
    both = good.unionByName(spark.createDataFrame(odd, good.schema)).withColumn("n", F.lit("clash"))
    found = whitening.whiten(both).collect()
    assert len(found) == 302 * 4 + 2  # a repeated row, a null id; (905) is the only vector of its length
    check_whitening([r for r in found if r.vec_id is not None and r.vec_id < 900], x, list(range(300)))
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained) for r in found if r.vec_id == 905} == {(1, 1, 0, None, None), (2, 1, 0, None, None)}
    assert whitening.whiten(good.limit(0)).collect() == [] and whitening.whiten(good.where("vec_id > 400")).columns == whitening.whiten(good).columns


def test_whitening_without_variance_and_of_large_entries(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(20)], "vec_id long, embedding array<double>")
    found = whitening.whiten(flat).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in found)
    assert abs(sum(r.explained for r in found if r.vec_id == 0) - 1) < 1e-12
    large = spark.createDataFrame([(1, [1e12, 5.0]), (2, [-1e12, 5.0]), (3, [3e12, 6.0]), (4, [1e300, 0.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(large).collect()} == {None}
    exact = whitening.whiten(spark.createDataFrame([(1, [1e6, 5.0]), (2, [-1e6, 5.0]), (3, [1.5e6, 6.0])], "vec_id long, embedding array<double>")).collect()
    x = [(256 * 10**6, 1280), (-256 * 10**6, 1280), (384 * 10**6, 1536)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: r.deviation for r in exact} == {i + 1: sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}


def plain_cut(doc_id, text, rate=100, spm=50):
    text, h = text or "", hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_fill_in_middle(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "é", "😀", "\n", "\r", "<", "<S", ">", " b\n"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "\n"), (903, "x<M>y\nz"), (904, "line\n" * 30_000), (905, "y" * 300_000), (3, texts[3]), (3, texts[4]), (None, "a\nb\n"), (None, "a\nb\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit("clash"), "unit": F.lit(1), "tk": F.lit(2)}).repartition(5)
    for rules in (fill_middle.Middle(), fill_middle.Middle(rate=40, spm=10)):
        found = fill_middle.fill_in_middle(docs, rules).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), rules)).collect()
        assert sorted((str(r.doc_id), r.text or "") for r in found) == sorted((str(i), t or "") for i, t in rows)
        for r in found:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(r.doc_id, r.text, rules.rate, rules.spm)
            assert r.back == (r.text or "") and (r.unit, r.tk) == (1, 2)
    assert fill_middle.fill_in_middle(docs.limit(0)).collect() == []


def plain_hits(items, words, limits):
    hit, names = set(), set()
    for name, own in items:
        k = min(limits.words, max(1, math.ceil(limits.share * len(own))))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                names.add(name)
    return hit, names


def test_automaton_against_all_windows():
    for seed in range(400):
        rng = random.Random(seed)
        letters = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3, 5]))]
        items = [(str(i % 6), [rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 14]))]) for i in range(rng.randint(0, 8))]
        limits = dc.Limits(words=rng.choice([1, 2, 3, 4, 6]), share=rng.choice([1.0, 0.5, 0.8]))
        words = [rng.choice([*letters, b"zz"]) for _ in range(rng.randint(0, 40))]
        automaton = dc.build(items, limits)
        spans, found = automaton.scan(words)
        hit, names = plain_hits(items, words, limits)
        assert {i for a, b in spans for i in range(a, b)} == hit and {automaton.names[i] for i in found} == names
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert len(automaton.longest) <= 2 * sum(len(w) for _, w in items) + 1  # states


@pytest.mark.parametrize("portion", [1_000_000, 40])
def test_decontaminate(spark, monkeypatch, portion):
    monkeypatch.setattr(dc, "PORTION_WORDS", portion)
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(60)] + ["É", "日本", "x9"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(100, None), (101, " .,"), (102, "Short One!"), (103, items[0][1].upper() + " more"), (5, "another text under a known name, of more than ten words in all"), (None, "nameless item of three")]
    texts = [None, "", "short ONE", "a short\n-one- here, and Short oNe", items[5][1], f"before it {items[2][1]} after it", "word " * 20_000, "well: nameless, item of; three. ok"]
    for _ in range(60):
        parts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        own = (rng.choice(items)[1] or "").split(" ")
        cut = rng.randint(0, len(own))
        texts.append(f"{parts[0]}, {'; '.join(own[cut:]).upper()}!\n{parts[1]} {' '.join(own)} {parts[2]}.")
    rows = [*enumerate(texts), (4, texts[4]), (None, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"items": F.lit("clash"), "n": F.lit(1)})
    table = spark.createDataFrame(items, "item_id long, text string")
    listed = [(None if i is None else str(i), [w.encode() for w in WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))]) for i, t in items]
    found = dc.decontaminate(docs, table).collect()
    assert len(found) == len(rows)
    for r in found:
        raw = "".join(c.lower() if c.isascii() else c for c in r.text or "")
        places = [m.span() for m in WORDS.finditer(raw)]
        hit, names = plain_hits(listed, [raw[a:b].encode() for a, b in places], dc.Limits())
        clean, at = "", 0
        for a, b in r.spans:
            clean, at = clean + r.text[at:a], b
        assert (r.n_words, r.n_hit, r.items) == (len(places), len(hit), sorted(n for n in names if n)), r.text
        assert {i for i, (a, b) in enumerate(places) if any(s.first <= a and b <= s.last for s in r.spans)} == hit
        assert r.clean_text == (None if r.text is None else clean + r.text[at:]) and r.kept == (len(hit) <= 0.5 * len(places)) and r.n == 1
    assert dc.decontaminate(docs.limit(0), table).collect() == []
    assert {(r.n_hit, r.clean_text == r.text) for r in dc.decontaminate(docs.where("text IS NOT NULL"), table.limit(0)).collect()} == {(0, True)}
