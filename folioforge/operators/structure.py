"""Pages and tables out of cleaned lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import lexicon
from folioforge.functions.carry import carried
from folioforge.functions.text import count_of, count_tokens, has_any, joined_lines, let, strip

#: The alternatives of a number in their order, and a year or span of years.
NUMBER = r"\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?|\d+(?:\.\d+)?%|-\d+(?:\.\d+)?"
YEAR = r"\b20\d{2}(?:[-/]\d{2,4})?\b"
PAGE_SCHEMA = (
    "struct<text:array<string>,tables:array<struct<title:string,header:array<string>,rows:array<string>,source:string>>>"
)


def is_source(line: Column) -> Column:
    return line.rlike(r"(?i)^\s*Source\s*:")


def is_number_only(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*\d+\s*$")


def is_explicit_title(line: Column) -> Column:
    return line.rlike(r"(?i)^Table\s+[\dIVX]+")


def is_known_title(line: Column) -> Column:
    return has_any(F.upper(line), lexicon.KNOWN_TITLES)


def is_section(line: Column) -> Column:
    return line.rlike(r"^\d{1,2}\.\s+[A-Za-z]")


def is_title(line: Column) -> Column:
    return (line != "") & (is_explicit_title(line) | is_known_title(line))


def count_numbers(line: Column) -> Column:
    return F.regexp_count(line, F.lit(NUMBER))


def has_year(line: Column) -> Column:
    return line.rlike(YEAR)


def word_count(line: Column) -> Column:
    return count_tokens(line)


def _row(x: Column, title: Column) -> Column:
    """The extractor's rule for rows, from a line and its figures; one number can do."""
    return (
        F.when((x["line"] == "") | title | x["source"] | x["number_only"], False)
        .when((x["words"] > 35) & (x["n"] < 2), False)
        .when(x["n"] >= 2, True)
        .otherwise((x["n"] == 1) & ((x["words"] <= 20) | has_year(x["line"]) | F.contains(x["line"], F.lit("%"))))
    )


def _header(x: Column) -> Column:
    return let(count_of(F.lower(x["line"]), lexicon.HEADER_WORDS), lambda hits: (hits >= 2) | ((hits == 1) & (x["words"] <= 6)))


def judged(line: Column) -> Column:
    """STRUCT of all that one line may be, each figure made once: line, number_only, source, explicit, known, title, section, header, row, continuation, words."""
    first = F.struct(
        line.alias("line"), is_number_only(line).alias("number_only"), is_source(line).alias("source"), is_explicit_title(line).alias("explicit"), is_known_title(line).alias("known"),
        count_numbers(line).alias("n"), word_count(line).alias("words"),
    )

    def told(x: Column) -> Column:
        title = (x["line"] != "") & (x["explicit"] | x["known"])
        return F.struct(
            x["line"].alias("line"), x["number_only"].alias("number_only"), x["source"].alias("source"), x["explicit"].alias("explicit"), x["known"].alias("known"), title.alias("title"),
            is_section(x["line"]).alias("section"), _header(x).alias("header"), _row(x, title).alias("row"), is_continuation(x["line"]).alias("continuation"), x["words"].alias("words"),
        )

    return let(first, told)


def looks_like_row(line: Column) -> Column:
    return judged(line)["row"]


def looks_like_header(line: Column) -> Column:
    return judged(line)["header"]


def is_continuation(line: Column) -> Column:
    return has_any(F.lower(line), lexicon.CONTINUATION_WORDS)


def paged(lines: DataFrame, span: int | None = None) -> DataFrame:
    """(doc_id, page_ord, page, line_no, line): non-blank lines after the first page marker.

    page_ord counts the markers of a document, since two pages may bear one number; a marker
    is one line. A page without lines has one row with a null line. Documents without a
    marker have no pages. ``span``: see ``carried``.
    """
    stripped = lines.withColumn("line", strip(F.col("raw")))
    number = F.when(F.col("line").rlike(r"(?i)^PAGE\s+\d+$"), F.regexp_extract("line", r"(?i)^PAGE\s+(\d+)$", 1))
    marked = stripped.withColumn("marker", number)
    counted = carried(marked.select("doc_id", "line_no", "line", "marker"), {"page": F.col("marker")}, span, counts={"page_ord": F.col("marker")})
    placed = counted.select(
        "doc_id", "line_no", F.col("page_ord").cast("int").alias("page_ord"), F.col("page").try_cast("int").alias("page"),
        F.when(F.col("marker").isNull() & (F.col("line") != ""), F.col("line")).alias("line"), F.col("marker").isNotNull().alias("opens"),
    )
    return placed.where((F.col("page_ord") > 0) & (F.col("line").isNotNull() | F.col("opens"))).drop("opens")


class _Page:
    """The running state of one page: its text and the table that is open."""

    def __init__(self):
        self.text, self.tables, self.table, self.started = [], [], None, False

    def close(self, source: str | None = None) -> None:
        table, self.table, self.started = self.table, None, False
        if table is not None:
            table["source"] = source
            for part in ("header", "rows"):
                lines = table[part]
                table[part] = [x for i, x in enumerate(lines) if i == 0 or x != lines[i - 1]]
            if table["header"] or table["rows"]:
                self.tables.append(table)

    def open(self, title: str) -> None:
        self.close()
        self.table = {"title": title, "header": [], "rows": [], "source": None}

    def take(self, x: dict) -> None:
        """One line with what the columns say of it."""
        line = x["line"]
        if x["number_only"]:
            return
        self.text.append(line)
        if x["source"]:
            self.close(line)
        elif self._opens(x):
            self.open(line)
        elif self.table is None:
            return
        elif x["section"] and not x["title"]:
            self.close()
        elif not self.started:
            if not x["header"] and x["row"]:
                self.started = True
                self.table["rows"].append(line)
            elif x["header"] or x["continuation"] or x["words"] <= 15:
                self.table["header"].append(line)
        elif x["explicit"]:
            self.open(line)
        elif x["row"] or x["continuation"] or x["words"] <= 8:
            self.table["rows"].append(line)

    def _opens(self, x: dict) -> bool:
        if self.table is None:
            return x["title"]
        title = self.table["title"].lower()
        if x["explicit"]:
            return x["line"].lower() != title
        if x["known"]:
            line = x["line"].lower()
            return not any(p in line and p in title for p in lexicon.SAME_TABLE)
        return False


def _read_pages(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        rows = []
        for lines in batch:
            page = _Page()
            for x in sorted(lines, key=lambda y: y["line_no"]):
                if x["line"] is not None:
                    page.take(x)
            page.close()
            text = [x for i, x in enumerate(page.text) if i == 0 or x != page.text[i - 1]]
            rows.append((text, page.tables))
        yield pd.DataFrame(rows, columns=["text", "tables"])


def pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page_ord, page, text, tables) of ``lines(doc_id, line_no, raw)``.

    What a line may be is told by column functions. Only the running state of a page, which
    one line at a time changes, is a Python function over the page's lines; pages are
    independent, and no task holds more than a batch of them.
    """
    told = paged(lines).select("doc_id", "page_ord", "page", F.struct("line_no", judged(F.col("line")).alias("j")).alias("x"))
    told = told.select("doc_id", "page_ord", "page", F.struct("x.line_no", "x.j.*").alias("x"))
    whole = told.groupBy("doc_id", "page_ord", "page").agg(F.collect_list("x").alias("lines"))
    read = whole.withColumn("p", F.pandas_udf(_read_pages, PAGE_SCHEMA)("lines"))
    return read.select("doc_id", "page_ord", "page", F.array_join("p.text", "\n").alias("text"), F.col("p.tables").alias("tables"))


def tables(structured: DataFrame) -> DataFrame:
    """(doc_id, page_ord, page, table_ord, title, header, rows, source): one row for each table, from 1 within its page."""
    out = structured.select("doc_id", "page_ord", "page", F.posexplode("tables").alias("pos", "t"))
    return out.select("doc_id", "page_ord", "page", (F.col("pos") + 1).alias("table_ord"), "t.*")


def document_info(docs: DataFrame, structured: DataFrame) -> DataFrame:
    """Per document of ``docs``: pages, pages_with_text, tables, rows."""
    rows = F.aggregate("tables", F.lit(0).cast("long"), lambda a, t: a + F.size(t["rows"]))
    per_doc = structured.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(strip(F.col("text")) != "").alias("pages_with_text"), F.sum(F.size("tables")).cast("long").alias("tables"), F.sum(rows).alias("rows")
    )
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("pages", "pages_with_text", "tables", "rows")]
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select("doc_id", *zero)


def to_documents(structured: DataFrame, names: DataFrame) -> DataFrame:
    """The nested interchange form: doc_id, document (file and counts), pages; ``names(doc_id, file)`` gives the files."""
    page = F.struct("page_ord", "page", "text", "tables")
    per_doc = structured.groupBy("doc_id").agg(F.sort_array(F.collect_list(page.alias("p"))).alias("all"))
    nested = F.transform("all", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"), p["tables"].alias("tables")))
    none = F.array().cast("array<struct<page:int,text:string,tables:array<struct<title:string,header:array<string>,rows:array<string>,source:string>>>>")
    made = names.join(per_doc, "doc_id", "left").withColumn("pages", F.coalesce(nested, none))
    n_tables = F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(p["tables"]))
    n_rows = F.aggregate("pages", F.lit(0), lambda a, p: a + F.aggregate(p["tables"], F.lit(0), lambda b, t: b + F.size(t["rows"])))
    document = F.struct(F.col("file"), F.size("pages").alias("pages_processed"), n_tables.alias("tables_detected"), n_rows.alias("rows_extracted"))
    return made.select("doc_id", document.alias("document"), "pages")


def from_documents(nested: DataFrame) -> DataFrame:
    """Pages back out of the nested form."""
    out = nested.select("doc_id", F.posexplode("pages").alias("pos", "p"))
    return out.select("doc_id", (F.col("pos") + 1).alias("page_ord"), "p.page", "p.text", "p.tables")


def page_lines(structured: DataFrame) -> DataFrame:
    """The text of each document again, joined."""
    return structured.groupBy("doc_id").agg(joined_lines(F.col("page_ord"), F.col("text")).alias("text"))
