"""Golden examples and randomised models of the document operators."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import lexicon
from folioforge.functions.text import to_lines
from folioforge.operators import cleaning, imaging, json_text, report, retrieval, retrieval_index, search, search_index, structure, topics, validation
from folioforge.plans import app
from folioforge.sources import documents as sources
from folioforge.sources import reports, uploads

GOLDEN = "PAGE 1\nOverview of the mining year\nTable 1.1 Output by company\nCompany Target Actual\nNLC 125.50\nNLC 125.50\n17\nSource: X\nPAGE 2\n2. Safety review\nCAPITAL EXPENDITURE\nPAGE 3"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_lexicon_sizes():
    sizes = [len(set(x)) for x in (lexicon.KNOWN_TITLES, lexicon.HEADER_WORDS, lexicon.CONTINUATION_WORDS, lexicon.TOPIC_STOP_WORDS, lexicon.CLOUD_STOP_WORDS, lexicon.GENERIC_TOPICS, lexicon.KEY_INFORMATION_WORDS, lexicon.ROW_WORDS, lexicon.COMPANY_CODES)]
    assert sizes == [57, 42, 30, 142, 53, 13, 13, 9, 9]


def test_lines_split_as_python_does(spark):
    texts = [None, "", "a", "a\n", "\n", "a\r\nb\rc", "x\x1cy\x85z w", "\n\na\n\n", " \t"]
    got = {}
    for r in to_lines(docs(spark, *texts)).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.raw))
    for i, t in enumerate(texts):
        assert [x for _, x in sorted(got.get(i, []))] == (t or "").splitlines()


def test_structure_golden(spark):
    pages = structure.pages(to_lines(docs(spark, GOLDEN))).orderBy("page_ord").collect()
    assert [p.page for p in pages] == [1, 2, 3]
    assert pages[0].text == "Overview of the mining year\nTable 1.1 Output by company\nCompany Target Actual\nNLC 125.50\nSource: X"
    assert [t.asDict() for t in pages[0].tables] == [{"title": "Table 1.1 Output by company", "header": ["Company Target Actual"], "rows": ["NLC 125.50"], "source": "Source: X"}]
    assert (pages[1].text, pages[1].tables) == ("2. Safety review\nCAPITAL EXPENDITURE", [])
    assert (pages[2].text, pages[2].tables) == ("", [])
    d = docs(spark, GOLDEN)
    info = structure.document_info(d, structure.pages(to_lines(d))).first()
    assert (info.pages, info.pages_with_text, info.tables, info.rows) == (3, 2, 1, 1)


def test_nested_round_trip(spark, tmp_path):
    d = docs(spark, GOLDEN, "no marker")
    nested = structure.to_documents(structure.pages(to_lines(d)), d.select("doc_id", F.lit("f.txt").alias("file")))
    row = {r.doc_id: r for r in nested.collect()}
    assert row[0].document.asDict() == {"file": "f.txt", "pages_processed": 3, "tables_detected": 1, "rows_extracted": 1}
    assert row[1].pages == []
    sources.write_structured(nested, str(tmp_path / "out"))
    back = sources.read_structured(spark, str(tmp_path / "out"), whole_files=False)
    assert sorted((r.doc_id, r.document.pages_processed) for r in back.collect()) == [("0", 3), ("1", 0)]
    assert structure.from_documents(nested).count() == 3


def test_validation_golden(spark):
    d = docs(spark, "A1 12.5 13.2 FY25 1,2,3 123456.78", "plain", None)
    said = [r.issue for r in validation.issues(to_lines(d)).orderBy("line_no", "ord").collect()]
    assert said == ["Attached letters/numbers: 'A1'", "Suspicious numeric commas: '1,2,3'", "Possible merged number: '123456.78'", "Possible OCR character substitution: 'A1'"]
    m = {r.doc_id: r for r in validation.metrics(d, to_lines(d)).collect()}
    assert (m[0].table_rows, m[0].rows_with_issues, m[0].total_issues, m[0].validation_quality) == (1, 1, 4, 0.0)
    assert m[1].validation_quality == m[2].validation_quality == 100.0
    carried = validation.check_lines(to_lines(docs(spark, "a\nsee page 12 now\nTable 3 x\nb\nPAGE 4"))).orderBy("line_no").collect()
    assert [(r.page, r.table) for r in carried] == [("Unknown", "Unknown"), ("12", "Unknown"), ("12", "Table 3 x"), ("12", "Table 3 x"), ("4", "Table 3 x")]
    text = validation.render_issues(validation.check_lines(to_lines(d))).first().text
    assert text.startswith("Line 1 | Page Unknown\nTable: Unknown\nOriginal: A1") and text.endswith("-" * 70)


def test_table_line_cleaning_golden(spark):
    before = ["1o.20", "o.oo", "1o5abc", "12_34", "1 & 2", "A 17.67", "x Vv 9.11 V 6 A 7", "a | 1 | 2", "£5 [6] {7}", "~8"]
    want = ["10.20", "o.oo", "1o5abc", "1234", "1 2", "A 17.67", "x 9.11 6 7", "a 1 2", "5 6 7", "8"]
    assert one(spark, cleaning.clean_table_line, *before) == want


def naive_table_line(line):
    line = re.sub("[¥£€©®™]", "", line.replace("|", " "))

    def fix(m):
        t = m.group(0)
        for p in (r"(?<=\d)[oO](?=\d)", r"(?<=\.)[oO](?=\d)", r"(?<=\d)[oO](?=\.)"):
            t = re.sub(p, "0", t)
        return t

    line = re.sub(r"\b[\dOo.,-]+\b", fix, line)
    for pattern, by in cleaning.TABLE_REWRITES:
        line = re.sub(pattern.replace("(?U)", ""), by, line)
    return line.strip()


def test_table_line_cleaning_random(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice(list("0123oO.,-_^~&[]{} AVWv|abx") + ["  ", "\t", "12.5", "Vv "]) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    assert one(spark, cleaning.clean_table_line, *lines) == [naive_table_line(x) for x in lines]


def test_table_mode_random(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["", "", "Table 2 x", "PAGE 3", "word", "Source: a", "1 2 3"]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    got = {}
    for r in cleaning.classify(to_lines(docs(spark, *texts))).collect():
        got[r.doc_id, r.line_no] = r.in_table
    for i, t in enumerate(texts):
        mode, gap = False, 0
        for n, line in enumerate(t.splitlines(), 1):
            assert got[i, n] == mode, (t, n)
            if not line:
                gap += mode
                mode = mode and gap < 3
            else:
                gap = 0
                mode = {"T": True, "P": False}.get(line[0], mode)


def test_cleaning_stage(spark):
    text = "\n\nTitle  here\n\n\n\n%%%%\nab\nTable 1 x\n1o.2 3\n\nNote: Inpt  y\nPAGE   2\n"
    cleaned, audit = cleaning.clean(to_lines(docs(spark, text)))
    assert [r.text for r in cleaned.orderBy("line_no").collect()] == ["Title here", "", "Table 1 x", "10.2 3", "", "Note: Input y", "PAGE 2"]
    said = sorted((r.kind, r.message) for r in audit.collect())
    assert said == [("cleaned", "Cleaned: 1o.2 3 -> 10.2 3"), ("numeric", "OCR numeric correction: 1o.2 -> 10.2"), ("removed", "%%%%"), ("removed", "ab")]


def test_search_golden(spark):
    pages = structure.pages(to_lines(docs(spark, GOLDEN)))
    hits = [(h.page, h.title, h.rows, h.title_match) for h in search.search(pages, " NLC ").collect()]
    assert hits == [(1, "Page Text", ["NLC 125.50"], False), (1, "Table 1.1 Output by company", ["NLC 125.50"], False)]
    hits = [(h.page, h.title, h.rows, h.title_match) for h in search.search(pages, "table 1.1").collect()]
    assert hits == [(1, "Page Text", ["Table 1.1 Output by company"], False), (1, "Table 1.1 Output by company", [], True)]
    assert search.search(pages, " ").collect() == []


def test_scores_golden(spark):
    row = spark.createDataFrame([("Output in 2024-25 rose", "FY 2024-25 output")], "t string, q string").select(retrieval.keyword_score(F.col("t"), F.col("q")), retrieval.token_bonus(F.col("t"), F.col("q"))).first()
    assert row[0] == 0.75 and row[1] == pytest.approx(2 / 3)


def test_chunks(spark):
    rng = random.Random(3)
    texts = ["\n".join("w" * rng.randint(1, 900) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "  \n "]

    def after(t):
        out, cur = [], []
        for p in filter(None, (t or "").split("\n")):
            if p.strip():
                cur.append(p)
            if len(" ".join(cur)) > 1200:
                out.append("\n".join(cur))
                cur = []
        return out + (["\n".join(cur)] if cur else [])

    def before(t):
        if len(t) <= 1800:
            return [t]
        out, cur, size = [], [], 0
        for p in t.split("\n"):
            if cur and size + len(p) > 1800:
                out.append("\n".join(cur))
                cur, size = [], 0
            cur.append(p)
            size += len(p)
        return out + ["\n".join(cur)]

    first = retrieval.fallback_chunks(docs(spark, *texts))
    got = {}
    for r in first.orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {i: after(t) for i, t in enumerate(texts) if after(t)}
    parts = {}
    for r in retrieval.split_long(first).orderBy("doc_id", "ord").collect():
        parts.setdefault(r.doc_id, []).append(r.text)
    assert parts == {i: [y for x in v for y in before(x)] for i, v in got.items()}


def test_ask(spark):
    pages = structure.pages(to_lines(docs(spark, "PAGE 1\ncoal output rose\nPAGE 2\nsafety review")))
    chunks = retrieval.page_chunks(pages).withColumn("vector", F.when(F.col("page") == 1, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    said = retrieval.ask(chunks, "coal output", lambda q: [1.0, 0.0], lambda p: "It rose." if "coal output rose" in p else "?")
    assert said == "It rose.\n\nSources:\n• Page 1\n• Page 2"
    assert retrieval.ask(chunks, " ", lambda q: [1.0, 0.0], None) == retrieval.NO_QUESTION
    assert retrieval.ask(chunks.where("false"), "x", lambda q: [1.0, 0.0], None) == retrieval.NO_CONTENT
    assert app.respond(None, "x", None, None, None) == app.PROCESS_FIRST


def test_topic_redundancy_random(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["coal", "output", "growth", "mine", "plan", "safety", "the"]) for _ in range(rng.randint(3, 12))) for _ in range(12)]
    none = F.array().cast("array<struct<title:string,header:array<string>,rows:array<string>,source:string>>")
    pages = docs(spark, *texts).select("doc_id", F.lit(1).alias("page_ord"), "text", none.alias("tables"))
    scored = sorted(((r.term, r.score) for r in topics.weights(topics.corpus(pages)).where(topics.is_meaningful(F.col("term"))).withColumn("score", F.round("score", 12)).collect()), key=lambda r: (-r[1], r[0]))
    top = scored[0][1]
    kept = []
    for term, score in scored:
        if score >= 0.2 * top and not any(set(term.split()) <= set(k.split()) for k in kept):
            kept.append(term)
    assert [r.term for r in topics.topics(topics.corpus(pages)).orderBy("rank").collect()] == kept
    assert topics.topics(topics.corpus(pages.limit(1))).collect() == []


def test_report(spark):
    lines = to_lines(docs(spark, GOLDEN))
    d = docs(spark, GOLDEN)
    made = structure.pages(lines)
    out = report.report_lines(structure.document_info(d, made), report.document_text(made), report.titles(made), None, d.select("doc_id", F.lit("n").alias("name")), "t").first().lines
    assert "Document: n" in out and "1. Table 1.1 Output by company" in out and "Matching OCR validation report was not found." in out
    assert "Tables detected             : 1" in out
    s = "Coal output rose a lot in this long and winding year. Short. " * 2 + "Another sentence that is quite a bit longer than forty characters."
    row = docs(spark, s, None, "x" * 1200).select("doc_id", report.summary(F.col("text")).alias("s")).orderBy("doc_id").collect()
    assert row[0].s == "Coal output rose a lot in this long and winding year. Another sentence that is quite a bit longer than forty characters."
    assert row[1].s.startswith("No page text") and row[2].s == "x" * 1200


def test_sources(spark, tmp_path):
    assert one(spark, sources.file_extension, "a.PDF", "x", "b.c.docx") == ["pdf", None, "docx"]
    assert one(spark, sources.upload_message, "a.pdf", "", None, "x.exe") == [None, sources.NO_FILE, sources.NO_FILE, sources.UNSUPPORTED]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.pdf").write_bytes(b"one|two")
    (tmp_path / "in" / "bad.pdf").write_bytes(b"!")
    (tmp_path / "in" / "skip.txt").write_text("x")

    def reader(data):
        if data == b"!":
            raise ValueError("empty")
        return list(enumerate(data.decode().split("|"), 1))

    def pagewise(data):
        def recognise(text):
            if text == "two":
                raise ValueError("blurred")
            return text

        yield from ((n, lambda t=t: recognise(t)) for n, t in enumerate(data.decode().split("|"), 1))
        if data == b"!":
            raise ValueError("cut off")

    pages = sources.extract_pages(sources.scan_files(spark, str(tmp_path / "in")), pagewise)
    assert sorted((r.page_number, r.text, r.error) for r in pages.collect()) == [(0, "[OCR ERROR: cut off]", "cut off"), (1, "!", None), (1, "one", None), (2, "[OCR ERROR: blurred]", "blurred")]
    assert app.process_files(spark, str(tmp_path / "in"), pagewise).pages.where("page = 2").first().text.endswith("[OCR ERROR: blurred]")
    pages = sources.extract_pages(sources.scan_files(spark, str(tmp_path / "in")), reader)
    assert sorted((r.page_number, r.text, r.error) for r in pages.collect()) == [(0, "[OCR ERROR: empty]", "empty"), (1, "one", None), (2, "two", None)]
    done = app.process_files(spark, str(tmp_path / "in"), reader)
    assert {r.doc_id: r.pages for r in app.dashboard(done).collect()} == {"good.pdf": 2, "bad.pdf": 1}
    (tmp_path / "in" / "b c.txt").write_text("two\nlines")
    (tmp_path / "in" / "cleaned_b.txt").write_text("x")
    assert sorted(map(tuple, sources.scan_text(spark, str(tmp_path / "in")).collect())) == [("b c.txt", "two\nlines"), ("skip.txt", "x")]
    figures = one(spark, sources.parse_validation_report, "Table-like rows inspected : 4\nRows requiring review : 1\nPossible OCR issues : 2\nValidation Quality : 75.00%")[0]
    assert (figures.table_rows, figures.rows_with_issues, figures.rows_without_issues, figures.total_issues, figures.validation_quality) == (4, 1, None, 2, 75.0)
    names = spark.createDataFrame([(1, "structured_cleaned_A.json"), (2, "structured_cleaned_zz.json")], "doc_id int, name string")
    reports = spark.createDataFrame([("ocr_validation_report_cleaned_A.txt", 1), ("ocr_validation_report_cleaned_A_2.txt", 9)], "report string, modified int")
    assert [tuple(r) for r in sources.match_reports(names, reports).collect()] == [(1, "ocr_validation_report_cleaned_A.txt")]
    names = spark.createDataFrame([(1, "structured_cleaned_Annual Report 2024 of the mines.json"), (2, "report.json"), (3, "--.json"), (4, "zz.json")], "doc_id int, name string")
    reports = spark.createDataFrame([("annual-report-2024.txt", 1), ("REPORT_2024.txt", 5), ("--.txt", 9), ("my-old-report.txt", 3)], "report string, modified int")
    assert sorted(map(tuple, sources.match_reports(names, reports).collect())) == [(1, "REPORT_2024.txt"), (2, "REPORT_2024.txt")]


def test_imaging(spark):
    df = spark.createDataFrame([(1, [0.0, 10.0]), (2, [])], "i int, p array<double>")
    got = {r.i: r.q for r in df.select("i", imaging.image_quality(F.col("p")).alias("q")).collect()}
    assert (got[1].brightness, got[1].contrast) == (5.0, 5.0)
    words = spark.createDataFrame([(1, "90"), (1, "-1"), (1, "x"), (2, "-1")], "page int, confidence string")
    assert {r.page: r.confidence for r in imaging.page_confidence(words, ["page"]).collect()} == {1: 90.0, 2: 0.0}
    angles = spark.createDataFrame([(-60.0, 500), (-10.0, 500), (30.0, 5)], "a double, n int").select(imaging.skew_angle(F.col("a"), F.col("n"))).collect()
    assert [r[0] for r in angles] == [-30.0, 10.0, 0.0]


def test_streaming(spark, tmp_path):
    from folioforge.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("A1 1 2 3")
    ingest.stream_metrics(ingest.stream_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.doc_id, r.table_rows) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a.txt", 1)]


def test_json_chunks(spark):
    rows = [
        (1, '{"pages": [{"page": 3, "title": "T", "text": "a\\n b", "rows": [{"x": 1, "y": null}, ["p", "q"], "a b"]}, {"page_number": 4}, "loose"]}'),
        (2, '{"meta": {"heading": "H", "deep": [{"rows": [[1, 2]]}]}}'),
        (3, "not json"), (4, None), (5, "[]"), (6, '[{"section": "S", "content": "c"}]'),
    ]
    found = json_text.json_chunks(spark.createDataFrame(rows, "doc_id long, json string")).orderBy("doc_id", "ord").collect()
    assert [tuple(r) for r in found] == [
        (1, 0, "0", "3", "T", "a b\n1\np | q"), (1, 2, "2", None, "", "loose"), (2, 0, "0", None, "", "H\n1 | 2"), (6, 0, "0", None, "S", "c"),
    ]


def test_reports_are_written_and_replaced(spark, tmp_path):
    made = lambda *rows: spark.createDataFrame(list(rows), "doc_id int, lines array<string>")
    read = lambda files=False, **k: sorted((r.doc_id, r.text.rstrip("\n")) for r in reports.read_reports(spark, str(tmp_path / f"r{files}"), files, **k).collect())
    for files in (False, True):
        for _ in range(2):
            sources.write_reports(made((1, ["a", "b"]), (2, ["c"])), str(tmp_path / f"r{files}"), files)
        assert read(files) == [(1, "a\nb"), (2, "c")]
        sources.write_reports(made((2, ["d"])), str(tmp_path / f"r{files}"), files)
        assert read(files) == [(1, "a\nb"), (2, "d")]


def test_stage_outcomes(spark):
    def reader(data):
        if data.startswith(b"!"):
            raise ValueError("no such page tree")
        yield from enumerate(data.decode().split("|"), 1) if data else ()

    files = [("in/good.pdf", b"Table 1 Output\nCompany Target\nNLC 1 2 3|more text of a page"), ("in/bad.pdf", b"!"), ("in/none.pdf", b""), ("in/empty.pdf", b" "), ("in/other.pdf", b"Some prose of one page.")]
    found = app.process_recorded(spark.createDataFrame(files, "path string, content binary"), reader)
    rows = {(r.doc_id, r.stage): (r.rows, r.error) for r in found.outcomes.collect()}
    assert rows["bad.pdf", "ocr"] == (0, "OCR failed: no such page tree") and rows["none.pdf", "ocr"] == (0, "OCR failed: OCR did not create an output file.")
    assert {s for d, s in rows if d in ("bad.pdf", "none.pdf")} == {"ocr"}
    assert {s for d, s in rows if d == "good.pdf"} == set(app.STAGES) and rows["good.pdf", "ocr"] == (2, None) and rows["good.pdf", "structure"] == (2, None)
    assert rows["good.pdf", "cleaning"] == rows["good.pdf", "validation"] and all(e is None for (d, _), (_, e) in rows.items() if d in ("good.pdf", "other.pdf", "empty.pdf"))
    assert [s for s, _, _ in found.stages] == list(app.STAGES) and all(t > 0 for *_, t in found.stages)
    assert {s: n for s, n, _ in found.stages}["cleaning"] == found.done.cleaned.count()
    assert {r.doc_id for r in app.dashboard(found.done).collect()} == {"good.pdf", "other.pdf", "empty.pdf"}
    with pytest.raises(app.StageFailed, match="OCR failed"):
        app.process_recorded(spark.createDataFrame(files, "path string, content binary").withColumn("content", F.raise_error(F.lit("disk"))), reader)


def test_report_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    made = lambda *rows: spark.createDataFrame(list(rows), "doc_id int, lines array<string>")
    read = lambda **k: sorted((r.doc_id, r.language, r.text) for r in reports.read_reports(spark, folder, **k).collect())
    assert read() == []
    reports.write_reports(made(*[(i, [f"first {i}"]) for i in range(200)]), folder, version=1)
    reports.write_reports(made((7, ["seven"]), (8, [])), folder, language=" Hindi ", version=1)
    for _ in range(2):  # run twice: the same
        reports.write_reports(made((7, ["new"])), folder, language="latin", version=2)
        reports.remove_reports(spark.createDataFrame([(9,), (9,), (999,)], "doc_id int"), folder, version=2)
    want = sorted([(i, "english", "new" if i == 7 else f"first {i}") for i in range(200) if i != 9] + [(7, "hindi", "seven"), (8, "hindi", "")])
    assert read() == want and read(language="hindi") == want[8:9] + want[10:11] and read(doc_id=7) == want[7:9] and read(doc_id=9) == []
    assert reports.read_reports(spark, folder, doc_id=7)._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(bucket") == 1
    before = spark.read.parquet(folder).count()
    assert 0 < reports.compact_reports(spark, folder) <= 3 and spark.read.parquet(folder).count() < before and read() == want
    assert reports.compact_reports(spark, folder) == 0
    reports.remove_reports(spark.createDataFrame([(i,) for i in range(200)], "doc_id int"), folder, version=3)
    reports.compact_reports(spark, folder)
    assert read() == [x for x in want if x[1] == "hindi"] and spark.read.parquet(folder).count() == 2
    reports.write_reports(made((9, ["back"])), folder, version=2)
    assert read(doc_id=9) == [(9, "english", "back")]


def test_validation_report_is_read_back(spark):
    done = app.process_texts(docs(spark, GOLDEN, "1 2 3 4x4 5,5,5\n1 2 3", ""))
    text = {r.doc_id: r.text for r in app.run_validation_reports(done).collect()}
    figures = {r.doc_id: r for r in done.metrics.collect()}
    assert set(text) == set(figures) == {0, 1, 2}
    for doc, t in text.items():
        read = one(spark, sources.parse_validation_report, t)[0]
        for name in sources.REPORT_FIGURES:
            assert read[name] == pytest.approx(figures[doc][name], abs=0.005)
    assert "Attached letters/numbers: '4x4'" not in text[0] and "  - " in text[1] and text[2].endswith("No issues were found.")


def test_topics_of_groups_are_those_of_each_alone(spark):
    rng = random.Random(31)
    words = ["coal", "mine", "output", "power", "rail", "port", "x1", "the"]
    rows = [(g, f"{g}.{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for g in range(3) for i in range(g * 4)]
    parts = spark.createDataFrame(rows, "doc_id int, part string, text string")
    together = sorted((r.g, r["rank"], r.term, round(r.score, 9)) for r in topics.topics(parts, "doc_id").collect())
    alone = [(g, r["rank"], r.term, round(r.score, 9)) for g in range(3) for r in topics.topics(parts.where(F.col("doc_id") == g)).orderBy("rank").collect()]
    assert together == alone and {g for g, *_ in together} == {1, 2}


def test_small_tables_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert sources.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    assert sources.spread(spark.range(0, 100, 1, cores)).rdd.getNumPartitions() == cores


def test_indexed_search_equals_search(spark, tmp_path):
    rng = random.Random(9)
    none = "array<struct<title:string,header:array<string>,rows:array<string>,source:string>>"
    word = lambda: "".join(rng.choice("abcdeÉ1.") for _ in range(rng.randint(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows = [(d, p, p, "\n".join(line(6) for _ in range(4)), [(line(2), [], [line(3), "  " + line(2)], None)] if p % 2 else []) for d in range(60) for p in range(3)]
    rows += [(900, 1, 1, None, None), (901, 1, 1, "", []), (902, 1, None, "needle in\nthe hay", [(None, [], ["NEEDLE\u0130x"], None)]), (902, 1, None, "needle in\nthe hay", [])]
    pages = spark.createDataFrame(rows, f"doc_id long, page_ord int, page int, text string, tables {none}")
    index = search_index.build_index(pages, str(tmp_path / "index"), block_pages=10)
    plain = lambda df: sorted(map(str, df.collect()))
    queries = ["needle", " NEEDLE in ", "in\nthe", "a", "e.", "", "abc", "zzz", "\u00c9", line(1) + " " + line(1), *[r[3].split("\n")[1][3:12] for r in rows[:30:6]]]
    for q in queries:
        assert plain(search_index.indexed_search(index, q)) == plain(search.search(pages, q)), q
    assert search_index.candidates(index, "needle in").count() == 2 and search_index.candidates(index, "ab") is None
    share = sum(search_index.candidates(index, q).count() for q in queries[-5:]) / 5 / len(rows)
    assert share < 0.05  # of the pages, for queries of nine characters
    plan = search_index.indexed_search(index, "needle")
    plan.collect()
    assert "dynamicpruning" in plan._jdf.queryExecution().executedPlan().toString()
    assert search_index.indexed_search(search_index.build_index(pages.limit(0), str(tmp_path / "none")), "needle").collect() == []


def test_many_questions_equal_one_by_one(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    pool = ["coal", "steel", "output", "of", "the", "mine", "2024-25", "an"]
    text = lambda: " ".join(rng.choice(pool, rng.integers(1, 4)))
    centres = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    made = [(int(i), 0, f"{text()} w{i}", (centres[i % 24] + 0.01 * rng.normal(size=24)).tolist()) for i in range(480)]
    made += [(900, 0, "the steel of the mine", [0.0] * 24), (901, 0, "no vector", None), (902, 1, "", made[0][3]), (3, 1, made[3][2], made[3][3])]
    chunks = spark.createDataFrame(made, "doc_id long, ord int, text string, vector array<double>")
    asked = [(i, f"what is the {text()} of w{i * 7}", (centres[i] + 0.02 * rng.normal(size=24)).tolist()) for i in range(12)]
    asked += [(50, "", made[5][3]), (51, "coal", [0.0] * 24), (52, None, made[9][3]), (53, "no vector", None), (None, "coal", made[0][3])]
    index = retrieval_index.build_chunk_index(chunks, str(tmp_path / "index"), list_chunks=20)
    sizes = {}
    real = retrieval_index.materialise
    monkeypatch.setattr(retrieval_index, "materialise", lambda df, name: sizes.setdefault(name, real(df, name)))
    got = {}
    for r in retrieval_index.rank_many(index, spark.createDataFrame(asked, "qid long, question string, vector array<double>")).collect():
        got.setdefault(r.qid, {})[r.place] = (r.doc_id, r.ord, round(r.score, 9))
    usable = chunks.where("vector IS NOT NULL")
    assert set(got) == {q for q, _, v in asked if q is not None and v is not None}
    for qid in (0, 3, 11, 50, 51, 52):
        _, question, vector = next(a for a in asked if a[0] == qid)
        want = [(r.doc_id, r.ord, round(r.score, 9)) for r in retrieval.rank(usable, question or "", vector).collect()]
        assert [got[qid][k] for k in sorted(got[qid])] == want, qid
    assert sizes["late-lists"].where(F.col("qid") < 12).count() < 12 * 25 * 0.5  # vectors in tight groups: a question looks into part of the lists
    empty = retrieval_index.build_chunk_index(chunks.limit(0), str(tmp_path / "none"))
    sizes.clear()
    assert retrieval_index.rank_many(empty, spark.createDataFrame(asked, "qid long, question string, vector array<double>")).collect() == []


def test_many_questions_in_portions_with_ties_and_odd_tokens(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    pool = ["coal-fired", "coal", "2024\u201325", "2024", "steel", "\u00c9steel", "a-b-c", "mine's", "\u0130x", "under_score", "x" * 90 + "coal"]
    text = lambda n: " ".join(rng.choice(pool, n))
    vectors = rng.normal(size=(30, 8))
    made = [(f"d{rng.integers(0, 500)}", i, text(6), vectors[i % 30].tolist()) for i in range(300)]
    made += [(f"same{i}", 0, "Coal-Fired STEEL", vectors[0].tolist()) for i in range(40)] + [("no", 0, "", [0.0] * 8)]
    chunks = spark.createDataFrame(made, "doc_id string, ord int, text string, vector array<double>").repartition(7)
    asked = [(f"q{i}", text(3) + rng.choice(["", " coal coal", "-", " a-b"]), (vectors[i % 30] * (i % 9)).tolist()) for i in range(25)]
    index = retrieval_index.build_chunk_index(chunks, str(tmp_path / "index"), list_chunks=8)
    assert index.table("lists").count() > 16
    assert len(list((tmp_path / "index/chunks/rows").glob("*=*"))) <= 16  # not a folder for each list
    monkeypatch.setattr(retrieval_index, "QUESTIONS", 6, raising=False)
    got = {}
    for r in retrieval_index.rank_many(index, spark.createDataFrame(asked, "qid string, question string, vector array<double>")).collect():
        got.setdefault(r.qid, {})[r.place] = (r.doc_id, r.ord, r.score, r.text)
    assert len(got) == len(asked)
    for qid, question, vector in asked:
        want = [(r.doc_id, r.ord, r.score, r.text) for r in retrieval.rank(chunks, question, vector).collect()]
        assert [got[qid][k] for k in sorted(got[qid])] == want, qid


def test_many_questions_do_not_each_read_every_text(spark, tmp_path):
    rng = np.random.default_rng(9)
    pool = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(pool, n))
    chunks = spark.createDataFrame([(i, 0, text(15_000), rng.normal(size=4).tolist()) for i in range(100)], "doc_id long, ord int, text string, vector array<double>")
    asked = spark.createDataFrame([(i, text(60), rng.normal(size=4).tolist()) for i in range(60)], "qid long, question string, vector array<double>")
    index = retrieval_index.build_chunk_index(chunks, str(tmp_path / "index"), list_chunks=20)
    took = []
    for questions in (asked.limit(1), asked.limit(1), asked):
        began = time.perf_counter()
        n = retrieval_index.rank_many(index, questions).count()
        took.append(time.perf_counter() - began)
    assert n == 60 * 5
    assert took[2] < 5 * took[1] + 5, took  # 60 times the questions


def plain_cloud(texts, threshold=2.0):
    """Counts of one cloud: words, plurals folded, pairs beyond chance."""
    words = [[w for t in pages for w in re.findall("[a-zA-Z]+", (t or "").lower()) if len(w) >= 3 and w not in lexicon.CLOUD_STOP_WORDS] for pages in texts]

    def folded(found):
        std = {w: w[:-1] if w.endswith("s") and not w.endswith("ss") and w[:-1] in found else w for w in found}
        out = {}
        for w, n in found.items():
            out[std[w]] = out.get(std[w], 0) + n
        return out, std

    def tally(items):
        found = {}
        for x in items:
            found[x] = found.get(x, 0) + 1
        return found

    counts, std = folded(tally(w for ws in words for w in ws))
    pairs, _ = folded(tally(f"{a} {b}" for ws in words for a, b in zip(ws, ws[1:], strict=False)))
    n, left = sum(counts.values()), dict(counts)
    like = lambda k, m, x: math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (m - k)
    for pair, c in pairs.items():
        a, b = (std[w] for w in pair.split())
        c1, c2 = counts[a], counts[b]
        if n > c1 and n > c2 and -2 * (like(c, c1, c2 / n) + like(c2 - c, n - c1, c2 / n) - like(c, c1, c / c1) - like(c2 - c, n - c1, (c2 - c) / (n - c1))) > threshold:
            left[a] -= c
            left[b] -= c
            left[pair] = c
    return {t: k for t, k in left.items() if k > 0}


def test_cloud_terms_against_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(topics, "COLLOCATION", 2.0)
    rng = random.Random(17)
    pool = ["coal", "coals", "mine", "mines", "class", "steel", "dispatch", "the", "up", "output", "glass", "bus"]
    docs_ = []
    for d in range(12):
        pages = []
        for _ in range(rng.randint(1, 4)):
            ws = [rng.choice(pool) for _ in range(rng.randint(0, 30))]
            pages.append(rng.choice([None, "", " ".join(ws) + rng.choice(["", " Coal Dispatches coal dispatch 12 coal dispatch"]), "Mine, mines!"]))
        docs_.append(pages)
    rows = [(d, p, t, "even" if d % 2 == 0 else "odd") for d, pages in enumerate(docs_) for p, t in enumerate(pages)]
    table = spark.createDataFrame(rows, "doc_id long, page_ord int, text string, side string")
    got = {r.term: r.n for r in topics.cloud_terms(table, top=None).collect()}
    assert got == plain_cloud(docs_) and any(" " in t for t in got)
    sides = {}
    for r in topics.cloud_terms(table, "side", top=6).collect():
        sides.setdefault(r.g, {})[r.term] = r.n
    for k, side in enumerate(("even", "odd")):
        want = plain_cloud(docs_[k::2])
        assert sides[side] == dict(sorted(want.items(), key=lambda x: (-x[1], x[0]))[:6])
    assert topics.cloud_terms(table.limit(0)).collect() == []


def test_first_cloud_terms_are_those_of_all(spark, monkeypatch):
    """However few words are counted first, and where pairs have to be counted again, for more words or for all."""
    monkeypatch.setattr(topics, "COLLOCATION", 2.0)
    rng = random.Random(5)
    pool = ["".join(rng.choice("abel") for _ in range(rng.randint(3, 5))) + rng.choice(["", "", "s"]) for _ in range(60)]
    docs_ = [[" ".join(rng.choices(pool, k=rng.randint(0, 40))) + " alpha betas" * rng.randint(0, 9) for _ in range(rng.randint(1, 3))] for _ in range(20)]
    table = spark.createDataFrame([(d, p, t, d % 2) for d, pages in enumerate(docs_) for p, t in enumerate(pages)], "doc_id long, page_ord int, text string, side int")
    reads = spark.sparkContext.accumulator(0)

    def seen(text):
        reads.add(1)
        return text

    table = table.cache()
    table.count()
    watched = table.withColumn("text", F.udf(seen, "string")("text"))
    want = [dict(sorted(plain_cloud(docs_[k::2]).items(), key=lambda x: (-x[1], x[0]))) for k in (0, 1)]
    real, passes = topics.materialise, []
    monkeypatch.setattr(topics, "materialise", lambda df, name: (passes.append(name), real(df, name))[1])
    ways = set()
    for top, known, frequent in ((1, 40_000, 20_000), (8, 40_000, 20_000), (8, 40_000, 4), (30, 40_000, 20_000), (3, 30, 20_000), (20, 20, 20_000)):
        monkeypatch.setattr(topics, "KNOWN", known, raising=False)
        monkeypatch.setattr(topics, "FREQUENT", frequent)
        passes.clear()
        reads.value = 0
        got = [{}, {}]
        for r in topics.cloud_terms(watched, "side", top=top).collect():
            got[r.g][r.term] = r.n
        assert got == [dict(list(w.items())[:top]) for w in want], (top, known, frequent)
        assert reads.value == table.count()  # each text is split into words once
        ways.add((passes.count("collocations"), "cloud-shown" in passes))
    assert {(2, True), (1, False)} <= ways
    table.unpersist()


def test_binarisation_and_gray(spark):
    rng = np.random.default_rng(6)
    flat = rng.integers(104, 106, (40, 50)).astype(np.uint8)
    flat[5:8, 10:20] = 70
    text = np.full((60, 40), 230, np.uint8)
    text[::4, 3:30] = 20
    images = [(0, 50, 40, flat.tobytes()), (1, 40, 60, text.tobytes()), (2, 3, 3, b"\x05" * 9), (3, 2, 2, b"\x05"), (4, 0, 0, b""), (5, 1, 1, None)]
    table = spark.createDataFrame([(i, (w, h, b)) for i, w, h, b in images], f"i int, image {imaging.IMAGE}")
    got = {r.i: r.b for r in table.select("i", imaging.binarised(F.col("image")).alias("b")).collect()}
    assert got[1].method == "otsu" and got[1].threshold == 20 and np.array_equal(np.frombuffer(got[1].binary, np.uint8).reshape(60, 40), np.where(text > 20, 255, 0))
    sigma, taps = 5.0, range(-15, 16)
    weight = [math.exp(-k * k / (2 * sigma**2)) for k in taps]
    at = lambda y, x: float(flat[min(max(y, 0), 39), min(max(x, 0), 49)])
    for y, x in ((0, 0), (7, 15), (20, 49), (39, 3)):
        mean = sum(a * b * at(y + dy, x + dx) for a, dy in zip(weight, taps, strict=True) for b, dx in zip(weight, taps, strict=True)) / sum(weight) ** 2
        assert imaging.local_means(flat)[y, x] == round(mean)
    assert got[0].method == "adaptive" and set(np.unique(np.frombuffer(got[0].binary, np.uint8).reshape(40, 50)[5:8, 10:20])) == {0}
    assert (got[2].method, got[2].white_ratio) == ("adaptive", 1.0) and all(got[i].method is None for i in (3, 4, 5))
    rgb = spark.createDataFrame([(0, bytes([255, 255, 255, 255, 0, 0, 0, 255, 0, 0, 0, 255, 10, 20, 30])), (1, b"ab"), (2, None)], "i int, rgb binary")
    gray = {r.i: r.g for r in rgb.select("i", imaging.gray_of_rgb(F.col("rgb")).alias("g")).collect()}
    assert list(gray[0]) == [255, 76, 150, 29, 18] and gray[1] is None and gray[2] is None


def test_smallest_rectangle_against_all_edges(spark):
    rng = np.random.default_rng(2)
    for _ in range(60):
        points = rng.integers(0, rng.choice([3, 12, 60]), (rng.integers(3, 40), 2))
        best = []
        for a in points:
            for b in points:
                d = b - a
                side = (points - a) @ np.array([-d[1], d[0]])
                if d.any() and ((side >= 0).all() or (side <= 0).all()):
                    t = math.atan2(d[1], d[0]) % (math.pi / 2)
                    u, v = points @ [math.cos(t), math.sin(t)], points @ [-math.sin(t), math.cos(t)]
                    best.append((np.ptp(u) * np.ptp(v), math.degrees(t) or 90.0))
        if best:
            least = min(a for a, _ in best)
            got = imaging.rectangle_angle(points)
            assert any(abs(got - t) % 90 < 1e-6 or abs(abs(got - t) - 90) < 1e-6 for a, t in best if a <= least * (1 + 1e-9) + 1e-9)
    page = np.full((80, 120), 255, np.uint8)
    for y in range(10, 60):
        x0 = 20 + round((y - 10) * math.tan(math.radians(12)))
        page[y, x0 : x0 + 60 : 2] = 0
    table = spark.createDataFrame([(0, (120, 80, page.tobytes())), (1, (120, 80, np.full((80, 120), 255, np.uint8).tobytes())), (2, (5, 5, b"\x00" + b"\xff" * 24)), (3, None)], f"i int, image {imaging.IMAGE}")
    got = {r.i: (r.t.foreground if r.t else None, r.skew) for r in table.select("i", imaging.text_rectangle(F.col("image")).alias("t"), imaging.page_skew(F.col("image")).alias("skew")).collect()}
    assert got[0][0] == 50 * 30 and -90 <= got[0][1] < 0 and got[2] == (1, 0.0) and got[3][1] == 0.0


def test_framed_text_round_trip(spark, tmp_path):
    folder = str(tmp_path / "framed")
    rows = [(f"d{d}.pdf", p, f"text {d} of page {p}\n\nwith lines\n==== and PAGE 9 in it") for d in range(4) for p in (0, 1, 2, 11)] + [("e f.pdf", 1, ""), ("e f.pdf", 2, "last")]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    read = lambda df: sorted((r.doc_id, r.page_number, r.text) for r in df.collect())
    for _ in range(2):
        sources.write_framed(pages, folder)
        assert read(sources.read_framed(spark, folder)) == sorted(rows)
    sources.write_framed(spark.createDataFrame([("d1.pdf", 7, "new")], pages.schema), folder)
    assert read(sources.read_framed(spark, folder)) == sorted([r for r in rows if r[0] != "d1.pdf"] + [("d1.pdf", 7, "new")])
    (tmp_path / "plain").mkdir()
    long = "\n".join(f"{sources.FRAME}{p}{sources.FRAME_END}" + f"line {p}\n" * 2000 for p in range(1, 200))
    (tmp_path / "plain" / "cleaned_a.txt").write_text("a note before\n" + long)
    (tmp_path / "plain" / "validated_cleaned_a.txt").write_text(f"{sources.FRAME}1{sources.FRAME_END}checked")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        cleaned = sources.read_framed(spark, str(tmp_path / "plain"), "cleaned_")
        assert cleaned.rdd.getNumPartitions() > 10  # a long file is cut
        got = read(cleaned.where("page_number IS NOT NULL"))
        assert [p for _, p, _ in got] == list(range(1, 200)) and all(t == (f"line {p}\n" * 2000).rstrip() for _, p, t in got)
        assert [r.text for r in cleaned.where("page_number = 57").collect()] == [("line 57\n" * 2000).rstrip()] and [r.text for r in cleaned.where("page_number IS NULL").collect()] == ["a note before"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    only = sources.read_framed(spark, str(tmp_path / "plain")).where("file = 'validated_cleaned_a.txt'")
    assert read(only) == [("validated_cleaned_a.txt", 1, "checked")]


def test_uploads_land(spark, tmp_path):
    folder = str(tmp_path / "landing")
    send = lambda rows, v: sorted(map(tuple, uploads.land(spark.createDataFrame(rows, "name string, content binary"), folder, v).collect()), key=str)
    assert uploads.landed(spark, folder).collect() == []
    first = [("a/report.PDF", b"one"), ("C:\\scans\\x.png", b"two"), ("", b"3"), (None, b"4"), ("notes.txt", b"5"), ("pdf", b"6"), ("b/", b"7")]
    for _ in range(2):
        assert send(first, 1) == sorted([("", sources.NO_FILE), (None, sources.NO_FILE), ("b/", sources.NO_FILE), ("notes.txt", sources.UNSUPPORTED), ("pdf", sources.UNSUPPORTED)], key=str)
    assert send([("other/report.PDF", b"newer"), ("report.PDF", b"longest"), ("y.csv", None)], 2) == []
    got = {r.path: (r.type, r.content and bytes(r.content), r.version) for r in uploads.landed(spark, folder).collect()}
    assert got == {"report.PDF": ("pdf", b"longest", 2), "x.png": ("png", b"two", 1), "y.csv": ("csv", None, 2)}
    assert {r.path: r.version for r in uploads.landed(spark, folder, 1).collect()} == {"report.PDF": 1, "x.png": 1}


def test_lines_in_ranges_give_the_same(spark):
    rng = random.Random(23)
    pieces = ["", "", "", "PAGE 3", "page 4", "Table 1.2 Output", "see Table 7", "Source: x", "12 13 14", "A1 2 3 4", "some words", "---", " \t"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 7, 40, 200]))) for _ in range(25)]
    lines = to_lines(docs(spark, *texts)).cache()
    plain = lambda df: sorted(map(str, df.collect()))
    for stage in (cleaning.classify, validation.check_lines, structure.paged, lambda x, span=None: cleaning.clean(x, span)[0]):
        want = plain(stage(lines))
        for span in (1, 3, 50, 1000):
            assert plain(stage(lines, span)) == want
    plan = cleaning.clean(lines, 50)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\[doc_id#\d+L?\], \[line_no", plan)  # no window over a document's lines
    lines.unpersist()
