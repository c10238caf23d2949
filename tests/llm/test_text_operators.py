"""Quality rules, license scan, line dedup and personal data against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioforge.llm import license_scan, line_dedup, line_quality, pii
from folioforge.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"
SEED_LINES = 14


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def naive_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if x.strip(BLANKS)]
    seen: dict = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(5)
    words = ["a", "b", "cc", "#x", "*", "<p>", "é", "\x1c", "\xa0"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 9, 20, 40]))) for _ in range(rng.randint(0, 4))) for _ in range(200)]
    rows = [(i, "s", t) for i, t in enumerate([*texts, None, "", " \n\t", "x " * 30_000])] + [(0, "s", texts[0]), (None, None, texts[1])]
    docs = frame(spark, rows, "doc_id long, source string, text string").withColumn("kept", F.lit("clash"))
    got = line_quality.apply_rules(docs).withColumn("same", F.col("text")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = naive_counts(r.same)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert line_quality.apply_rules(docs.limit(0)).collect() == []


def test_frequent_lines_are_removed(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, "h", f"Visit our SHOP, {i}!\n{own('abcdefghijklmnopqrstuvwxyz'[i])}") for i in range(26)]
    rows += [(100, "h", "visit our shop 5\n" * 12), (101, "other", "Visit our shop 7\n" + own("q"))]
    got = {r.doc_id: r for r in line_quality.apply_rules(frame(spark, rows, "doc_id long, source string, text string")).collect()}
    assert got[3].kept and got[3].removed_words == 4 and got[3].clean_text == own("d")
    assert not got[100].kept
    assert got[101].removed_words == 0 and got[101].clean_text == rows[-1][2]


def test_repeated_rows_are_one_document(spark):
    own = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + k)}" for k in range(25))
    rows = [(1, "h", own(0))] * 20 + [(2, "h", own(1)), (3, "h", own(2))]
    shared = [(10 + i, "g", f"The same line\n{own(3 + i)}") for i in range(10)]
    tables = {10: shared, 11: [*shared, (30, "g", f"the same LINE\n{own(14)}")]}  # 10 documents are not over the limit, 11 are
    for n, some in tables.items():
        table = frame(spark, rows + some + some[:1] * 9, "doc_id long, source string, text string")
        got = line_quality.apply_rules(table).collect()
        assert len(got) == len(rows) + n + 9
        assert all(r.kept and r.removed_words == 0 and r.clean_text == r.text for r in got if r.source == "h")
        for r in got:
            if r.source == "g":
                assert r.removed_words == (3 if n == 11 else 0) and ("same" in r.clean_text.lower()) == (n == 10)


def naive_runs(rows, keys, least=50):
    """Positions of lines in runs of ``least`` words or more that stand earlier, by trying all runs."""
    order = sorted(set(zip(rows, keys, strict=True)), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    first, gone = {}, {}
    for (doc, text), _ in order:
        lines = [x.strip(BLANKS) for x in (text or "").split("\n") if x.strip(BLANKS)]
        drop = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[i:j]) >= least:
                    at = first.setdefault(tuple(lines[i:j]), (doc, text, i))
                    if at != (doc, text, i):
                        drop |= set(range(i, j))
        gone[doc, text] = (len(lines), drop)
    return gone


def test_line_dedup(spark):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([1, 3, 10, 30, 60]))) for _ in range(SEED_LINES)]
    lines += ["\x0b" + lines[3] + " \t", "  ".join(f"d{k}" for k in range(49)), "\t".join(f"t{k}" for k in range(51)), "\r" + "é\x85 " * 50]
    whole = "\n".join(lines)
    rows = [(i, "\n".join(rng.choice([*lines, "", " "]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, whole), (1003, whole), (1003, whole), (None, whole), (1002, "x\n" + whole)]
    docs = frame(spark, rows).withColumn("runs", F.lit(1)).withColumn("before", F.col("text"))
    keys = [r.k for r in frame(spark, rows).select(F.xxhash64("text").alias("k")).collect()]
    want = naive_runs(rows, keys)
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, drop = want[r.doc_id, r.before]
        assert (r.n_lines, r.n_removed) == (n, len(drop))
        if not drop:
            assert r.text == r.before
        else:
            left = [x.strip(BLANKS) for x in r.before.split("\n") if x.strip(BLANKS)]
            assert [x.strip(BLANKS) for x in r.text.split("\n") if x.strip(BLANKS)] == [x for i, x in enumerate(left) if i not in drop]
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_ranks_name_the_intervals_of_a_suffix_array(spark):
    rng = random.Random(16)
    docs = [[rng.choice("abc") for _ in range(rng.randint(1, 14))] for _ in range(25)]
    docs += [docs[0] * 3, docs[1] + docs[2]]
    lines = frame(spark, [(d, 0, i, ord(x), 0) for d, doc in enumerate(docs) for i, x in enumerate(doc)], "doc_id long, tk long, pos int, h1 long, h2 long")
    levels = [{(r.doc_id, r.pos): r["rank"] for r in level.collect()} for level in line_dedup.suffix_ranks(lines, 8)]
    assert len(levels) == 4
    array_ = sorted((doc[i:], d, i) for d, doc in enumerate(docs) for i in range(len(doc)))
    common = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for (a, _, _), (b, _, _) in zip(array_, array_[1:], strict=False)]
    for depth in range(1, 16):
        intervals, k = [], depth.bit_length() - 1
        for (suffix, d, i), lcp in zip(array_, common, strict=True):
            if len(suffix) >= depth:
                intervals = intervals if lcp >= depth else [*intervals, set()]
                intervals[-1].add((d, i))
        named = {}
        for _, d, i in array_:
            name = levels[k].get((d, i)), levels[k].get((d, i + depth - (1 << k)))
            if None not in name:
                named.setdefault(name, set()).add((d, i))
        large = lambda sets: sorted(sorted(x) for x in sets if len(x) > 1)
        assert large(named.values()) == large(intervals)


def naive_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hits = [(i, label) for i in range(len(w)) for label, p in license_scan.PHRASES if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(spark):
    rng = random.Random(7)
    parts = ["mit license", "Apache License", "GNU General Public License", "foo", "MIT", "license", "apache", "general", "public", "é", "5"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "mit license"), (902, "mit license"), (None, "mit license mit license"), (903, "mit-license " * 4000)]
    docs = frame(spark, rows).withColumn("spans", F.lit(1))
    text = dict(rows)
    got = license_scan.scan_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == naive_license(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    mit = dict(license_scan.TEMPLATES)["mit"].split()
    missing = " ".join(mit[:9] + ["really"] + mit[9:])
    r = license_scan.scan_documents(frame(spark, [(1, "see: " + missing), (2, " ".join(mit[:6])), (3, "is free of charge to any")])).collect()
    found = {x.doc_id: x for x in r}
    assert found[1].labels == "mit" and found[1].base_labels == "" and 0.8 < found[1].score <= 1 and found[1].spans[0].first == 1
    assert found[2].labels == found[3].labels == "" and found[2].score == 0.0
    assert license_scan.scan_documents(docs.limit(0)).collect() == []


def test_license_templates_of_the_caller(spark, monkeypatch):
    docs = frame(spark, [(1, "As we said: Share And Enjoy, my friends, for all of your days."), (2, "share and enjoy the days"), (3, "mit license")])
    own = spark.createDataFrame([("a", "enjoy", "share and enjoy my friends for all of your days", False), ("b", "short", "share and enjoy", None), ("c", "cry", "Share-and enjoy", True)], "name string, label string, text string, phrase boolean")
    want = {1: ("cry", "cry,enjoy", 2), 2: ("cry", "cry", 1), 3: ("", "", 0)}
    for few in (2048, 1):  # also with all grams joined
        monkeypatch.setattr(license_scan, "FEW_GRAMS", few)
        got = {r.doc_id: r for r in license_scan.scan_documents(docs, templates=own).collect()}
        assert {d: (r.base_labels, r.labels) for d, r in got.items()} == {d: w[:2] for d, w in want.items()}
        assert got[1].score == 1.0 and got[1].n_base == 1 and got[1].first_word == 3


def test_license_votes_compare_the_words(spark, monkeypatch):
    """With hashes that all collide, only equal words vote."""
    monkeypatch.setattr(license_scan, "_grams", lambda words, k: F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.lit(5).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    got = {r.doc_id: r.labels for r in license_scan.scan_documents(frame(spark, [(1, "the mit license of old"), (2, "some other words of six")])).collect()}
    assert got == {1: "mit", 2: ""}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


NAIVE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def naive_pii(t):
    found = [[(m.start(), k, m.end()) for m in re.finditer(p, t or "") if ok(m[0])] for k, (_, p, ok) in enumerate(NAIVE)]
    listed = ",".join(f"{NAIVE[k][0]}:{a}:{b}" for a, k, b in sorted(x for f in found for x in f))
    return *map(len, found), hashlib.sha256(listed.encode()).hexdigest()


def test_pii(spark):
    rng = random.Random(3)
    pool = ["a@b.c", "x.y@", "@", "..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1 (017) 555-7713", "+12", "é", "😀", "0001.02.3.255", "_", "\n", "12345678901234", "5", "("]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "a" * 50_000 + "@"), (5003, "1" * 50_000), (5004, "a." * 20_000 + "@b" + ".c" * 20_000), (5005, "1 " * 30_000), (5006, "1.2.3.4 " * 2000), (0, rows[0][1])]
    docs = frame(spark, rows).withColumn("pii", F.lit(0))
    text = dict(rows)
    got = pii.digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == naive_pii(text[r.doc_id]), text[r.doc_id]


def test_pii_query_against_patterns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op7_pii"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == naive_pii(docs[r.doc_id])
        assert r.n_spans == len(list(filter(None, r.spans.split(",")))) == len(list(filter(None, r.scores.split(","))))
        listed = [s for s in r.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert hashlib.sha256(",".join(listed).encode()).hexdigest() == r.base_sha256
    assert pii.digest(frame(spark, [(1, "x")]).limit(0)).collect() == []


def test_pii_in_a_text_of_many_matches(spark):
    text = "".join(f"user{i}@mail.example.com or " for i in range(16_000))
    began = time.time()
    r = pii.digest(frame(spark, [(1, text)])).first()
    assert r.n_email == r.n_spans == 16_000 and r.base_sha256 == naive_pii(text)[-1] and time.time() - began < 30
    clean = pii.redact(frame(spark, [(1, text[: 27 * 300])])).first().text
    assert clean == re.sub(NAIVE[0][1], "[email]", text[: 27 * 300])


def test_pii_context_on_both_sides(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, "write to a@b.cd"), (2, "a@b.cd is my mail"), (3, "a@b.cd"), (4, f'"{secret}" is the password'), (5, f'"{secret}" is not'), (6, "a@b.cd, e@f.gh mail")]
    got = {r.doc_id: (r.n_spans, r.scores) for r in pii.digest(frame(spark, rows)).collect()}
    assert got == {1: (1, "1.0"), 2: (1, "1.0"), 3: (1, "0.8"), 4: (1, "0.6"), 5: (0, ""), 6: (2, "0.8,1.0")}


def test_pii_own_kinds_and_redaction(spark):
    iban = "GB82 WEST 1234 5698 7654 32"
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f"my iban {iban}."), (2, f"my iban {iban[:-1]}3."), (3, f'token = "{secret}"'), (4, f'commit "{secret}"'), (5, "mail a@b.cd now")]
    got = {r.doc_id: r.spans for r in pii.digest(frame(spark, rows)).collect()}
    assert got == {1: "iban:8:35", 2: "", 3: "secret:9:49", 4: "", 5: "email:5:11"}
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, [*rows, (6, None)])).collect()}
    assert clean[1] == "my iban [iban]." and clean[5] == "mail [email] now" and clean[4] == rows[3][1] and clean[6] is None


@pytest.mark.parametrize("number,ok", [("79927398713", True), ("79927398710", False)])
def test_luhn(spark, number, ok):
    assert frame(spark, [(1, number)]).select(pii.luhn(F.col("text"))).first()[0] == ok
