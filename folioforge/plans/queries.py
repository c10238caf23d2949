"""Named queries over the tables of a scale-factor folder, with the SQL that checks them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import lexicon, text
from folioforge.functions.storage import materialise, new_path
from folioforge.operators import cleaning, imaging, report, retrieval, retrieval_index, search, search_index, structure, topics, validation
from folioforge.plans import app
from folioforge.sources import documents as sources
from folioforge.sources import reports, uploads

QUERIES: dict = {}
ORACLES: dict = {}

SEARCHED = "the an"
QUESTION = "what is the output of 2024-25 for the mine"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sources.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.to_lines(table(spark, sf_dir, "documents"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one page without tables."""
    none = F.array().cast("array<struct<title:string,header:array<string>,rows:array<string>,source:string>>")
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_ord"), F.lit(1).alias("page"), "text", none.alias("tables"))


#: Customers of a ledger page at most, so that pages stay pages however many customers there are.
PAGE_CUSTOMERS = 5000
#: What stands on each ledger page beside the customers: place, copies, line ({p} is the page's number, {seg} its segment).
LEDGER_LINES = (
    (0, 1, "PAGE {p}"), (1, 1, "Table {p}.1 Balances of {seg}"), (2, 2, "Company Target Actual"), (4, 1, "Source: ledger"), (5, 1, "The production of the year went on as planned."),
    (6, 1, "Table {p}.2 Notes"), (7, 1, "Year Month"), (8, 1, "1. General remarks"), (9, 1, "Remarks without a table"), (10, 1, "Table {p}.3 Coal dispatch"),
    (11, 1, "Company Target Actual"), (12, 1, "CIL 10 20"), (13, 1, "Table {p}.3 Coal dispatch"), (14, 2, "ECL 30 40"), (15, 1, "Source: ledger"),
)


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, raw): a scanned ledger for each nation, pages by market segment and range of customers, a row for each customer.

    A page has repeated lines, a table that a section ends, a title without rows, and a title
    that starts a second table.
    """
    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_mktsegment").alias("seg"), F.floor(F.col("c_custkey") / PAGE_CUSTOMERS).alias("band"), F.col("c_custkey").cast("long").alias("n"),
        F.concat_ws(" ", "c_name", F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("row"),
    )
    key = ["doc_id", "seg", "band"]
    pages = c.groupBy(*key).agg(F.max_by("row", "n").alias("last"), F.max("n").alias("n")).withColumn("p", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg", "band")))
    said = lambda line: F.replace(F.replace(F.lit(line), F.lit("{p}"), F.col("p").cast("string")), F.lit("{seg}"), F.col("seg"))
    fixed = [F.struct(F.lit(k).alias("k"), F.lit(i).cast("long").alias("n"), said(line).alias("raw")) for k, copies, line in LEDGER_LINES for i in range(copies)]
    again = F.struct(F.lit(3).alias("k"), (F.col("n") + 1).alias("n"), F.col("last").alias("raw"))  # the last customer's row twice
    head = pages.select("doc_id", "p", F.explode(F.array(*fixed, again)).alias("x")).select("doc_id", "p", "x.*")
    rows = c.join(pages.select(*key, "p"), key).select("doc_id", "p", F.lit(3).alias("k"), "n", F.col("row").alias("raw"))
    ordered = Window.partitionBy("doc_id").orderBy("p", "k", "n")
    return head.union(rows).select("doc_id", F.row_number().over(ordered).alias("line_no"), "raw")


def ledger_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pages(ledger_lines(spark, sf_dir))


#: Lines of documents in SQL, with letters beyond ASCII as underscores in ``a``: both are word characters.
LINES = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
trimmed AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS p FROM parts),
lines AS (SELECT doc_id, unnest(p) AS raw, CAST(generate_subscripts(p, 1) AS INTEGER) AS line_no FROM trimmed),
marked AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS s, regexp_replace(trim(raw, ' ' || chr(9) || chr(13)), '[^\x00-\x7F]', '_', 'g') AS a FROM lines)
"""

LEDGER = f"""
WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_mktsegment AS seg, c_custkey // {PAGE_CUSTOMERS} AS band, c_custkey, c_name || ' ' || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS r FROM customer),
pages AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg, band) AS INTEGER) AS p FROM (SELECT DISTINCT doc_id, seg, band FROM c)),
body AS (SELECT doc_id, p, seg, count(*) AS n_rows, string_agg(r, chr(10) ORDER BY c_custkey) AS body FROM c JOIN pages USING (doc_id, seg, band) GROUP BY ALL),
tabs AS (SELECT doc_id, p, 1 AS ord, 'Table ' || p || '.1 Balances of ' || seg AS title, 'Company Target Actual' AS header, n_rows, body, 'Source: ledger' AS source FROM body
UNION ALL SELECT doc_id, p, 2, 'Table ' || p || '.2 Notes', 'Year Month', 0, '', NULL FROM body
UNION ALL SELECT doc_id, p, 3, 'Table ' || p || '.3 Coal dispatch', 'Company Target Actual', 1, 'CIL 10 20', NULL FROM body
UNION ALL SELECT doc_id, p, 4, 'Table ' || p || '.3 Coal dispatch', '', 1, 'ECL 30 40', 'Source: ledger' FROM body),
said AS (SELECT doc_id, p, concat_ws(chr(10), 'Table ' || p || '.1 Balances of ' || seg, 'Company Target Actual', body, 'Source: ledger', 'The production of the year went on as planned.', 'Table ' || p || '.2 Notes', 'Year Month',
'1. General remarks', 'Remarks without a table', 'Table ' || p || '.3 Coal dispatch', 'Company Target Actual', 'CIL 10 20', 'Table ' || p || '.3 Coal dispatch', 'ECL 30 40', 'Source: ledger') AS text FROM body)
"""


#: What a scan of the item {q} x {d} of part {n} reads as, by turns: lines of each kind, and the faults of recognition.
SCAN_BLOCKS = (
    ("PAGE {n}",), ("  page  12 ",), ("Table {q}.1 Receipts of goods", "{q} {d} 7"), ("see Table 4 of the last  report", "Dispatch 1o.20 3O4 5.o6"), ("Source:  register",), ("note : revised  twice", "Inpt of   goods"),
    ("", "", "", "after three blank lines"), ("", "", "{q} 12 13"), ("", "{mode}", "", "", "", "", "{mode} 5"), ("Total 12o.5 8O 4o7", "CIL 1O0 2.o5 3"), ("Row V 6 7.5 and A 12 W 3", "x Vv 9 VV 10"), ("Stock 12_34 56 ~ 78 & 9 _^5",),
    ("Grades [12] {{34 56] |7.8| {{9}",), ("Sum ¥9 £{q} €1 ©2", "{mode}|{q}|{d}"), ("Ash 123456.78 4 5", "Coal 1234.56 78 9 345.678"), ("A1 2b 33 44 55", "B-7 4x4 12kg 3 4 5 6"), ("FY24 10 20 30 FY25 8", "MT 5 6 7 t8"),
    ("12,34,567 1,00,000 3", "5,5,5 (1,2,3) 7"), ("1.2.3 4 5 6", "v.1.2. 3 4 5 6"), ("{n}",), ("2024-25 {q} 20.5", "in 2023/24 the output was {q}"), ("---", "ab", "x"), ("~~~~~~~ab", "CIL", "mt"), ("1. General remarks", "12. Further {mode} remarks"),
    ("Company Target Actual", "Month"), ("Coal dispatch",), ("Government of the day {q}", "SCCL"), ("{mode} 50% {q}", "-25.5 and {d}"), ("TABLE II of the year",), ("{mode} {q} {d}",), ("{q} {d} {n}",), ("Grand total of {mode} {d}", "all {mode}"),
)
_MARKS = ("{q}", "{d}", "{n}", "{mode}")


def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, raw): for each supplier a scan of its items, in which every kind of line and fault of recognition occurs."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("doc_id"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.pmod(F.col("l_orderkey") * 5 + F.col("l_linenumber") * 3, F.lit(len(SCAN_BLOCKS))).cast("int").alias("kind"),
        F.col("l_quantity").cast("int").cast("string").alias("q"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("d"), F.col("l_partkey").cast("string").alias("n"), F.col("l_returnflag").alias("mode"),
    )
    lines = items.select("*", F.posexplode(F.get(F.array(*[F.array(*map(F.lit, b)) for b in SCAN_BLOCKS]), F.col("kind"))).alias("piece", "raw"))
    raw = F.col("raw")
    for mark in _MARKS:
        raw = F.replace(raw, F.lit(mark), F.col(mark[1:-1]))
    return lines.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "l", "n", "q", "d", "mode", "piece")).alias("line_no"), raw.alias("raw"))


_SCAN_ROWS = ", ".join(f"({k}, {i}, '{line.replace(chr(39), chr(39) * 2)}')" for k, block in enumerate(SCAN_BLOCKS) for i, line in enumerate(block))
#: The same lines in SQL, under the names of LINES; what lies beyond ASCII are signs here, no letters.
SCAN = rf"""
WITH b(kind, piece, line) AS (VALUES {_SCAN_ROWS}),
i AS (SELECT CAST(l_suppkey AS BIGINT) AS doc_id, l_orderkey AS o, l_linenumber AS l, (l_orderkey * 5 + l_linenumber * 3) % {len(SCAN_BLOCKS)} AS kind, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS d, CAST(l_partkey AS VARCHAR) AS n, l_returnflag AS mode FROM lineitem),
lines AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, l, n, q, d, mode, piece) AS INTEGER) AS line_no, replace(replace(replace(replace(line, '{{q}}', q), '{{d}}', d), '{{n}}', n), '{{mode}}', mode) AS raw FROM i JOIN b USING (kind)),
marked AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS s, regexp_replace(trim(raw, ' ' || chr(9) || chr(13)), '[^\x00-\x7F]', '#', 'g') AS a FROM lines)
"""


@query(LINES + "SELECT doc_id, line_no, CAST(length(raw) AS INTEGER) AS n_chars, md5(raw) AS digest FROM lines")
def line_scan(spark, sf_dir):
    return document_lines(spark, sf_dir).select("doc_id", "line_no", F.length("raw").alias("n_chars"), F.md5("raw").alias("digest"))


_N = r"len(regexp_extract_all({}, '\d{{1,3}}(?:,\d{{2,3}})+(?:\.\d+)?|\d+(?:\.\d+)?|\d+(?:\.\d+)?%|-\d+(?:\.\d+)?'))"


@query(
    LINES
    + rf"""SELECT doc_id, CAST(sum({_N.format("a")}) AS BIGINT) AS numbers, CAST(count_if(len(regexp_extract_all(a, '\b\d+(?:[.,]\d+)*\b')) >= 3) AS BIGINT) AS row_like,
CAST(count_if(regexp_matches(a, '\b20\d{{2}}(?:[-/]\d{{2,4}})?\b')) AS BIGINT) AS with_year, CAST(count_if(contains(a, '%')) AS BIGINT) AS with_percent FROM marked GROUP BY doc_id"""
)
def numeric_line_profile(spark, sf_dir):
    return numeric_profile(document_lines(spark, sf_dir))


def numeric_profile(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.select("doc_id", text.strip(F.col("raw")).alias("line")).groupBy("doc_id").agg(
        F.sum(structure.count_numbers(line)).cast("long").alias("numbers"), F.count_if(validation.looks_like_row(line)).alias("row_like"),
        F.count_if(structure.has_year(line)).alias("with_year"), F.count_if(F.contains(line, F.lit("%"))).alias("with_percent"),
    )


_NOISE = rf"""CASE WHEN regexp_matches(a, '(?i)^PAGE\s+\d+$') OR regexp_matches(a, '(?i)\bTable\s+\d+') OR regexp_matches(a, '(?i)^(Source|Note)\s*:') OR regexp_matches(a, '^(Government|Ministry|CIL|SCCL|NLCIL)') THEN FALSE
WHEN regexp_matches(s, '^[\x00-\x7F]+$') AND regexp_matches(s, '^[\W_]+$') THEN TRUE
WHEN length(s) <= 3 AND NOT regexp_matches(s, '\d') AND upper(s) NOT IN {lexicon.COMPANY_CODES} THEN TRUE
WHEN length(s) > 5 AND len(regexp_extract_all(s, '[A-Za-z0-9]')) / length(s) < 0.20 THEN TRUE
ELSE regexp_matches(s, '(?i)^(?:{"|".join(lexicon.CHART_FRAGMENTS)})$') END"""


_CLASSED = rf"""{LINES}, q AS (SELECT doc_id, line_no, s, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(a, '(?i)^PAGE\s+\d+$') THEN 'page' WHEN regexp_matches(a, '(?i)\bTable\s+\d+') THEN 'heading'
WHEN regexp_matches(a, '(?i)^(Source|Note)\s*:') THEN 'source' WHEN NOT in_table AND ({_NOISE}) THEN 'noise'
WHEN in_table OR len(regexp_extract_all(a, '\b\d+(?:[.,]\d+)?\b')) >= 2 OR len(list_filter({list(lexicon.ROW_WORDS)}, lambda k: contains(lower(s), k))) > 0 THEN 'table' ELSE 'text' END AS cls, in_table
FROM (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS in_table
FROM (SELECT *, CASE WHEN s = '' AND gap = 3 THEN FALSE WHEN s <> '' AND regexp_matches(a, '(?i)^PAGE\s+\d+$') THEN FALSE WHEN s <> '' AND regexp_matches(a, '(?i)\bTable\s+\d+') THEN TRUE END AS event
FROM (SELECT *, sum(CASE WHEN s = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, stretch ORDER BY line_no) AS gap
FROM (SELECT *, sum(CASE WHEN s = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS stretch FROM marked)))))"""


@query(_CLASSED + "SELECT doc_id, line_no, cls, in_table FROM q")
def line_class(spark, sf_dir):
    return cleaning.classify(document_lines(spark, sf_dir)).select("doc_id", "line_no", "cls", "in_table")


#: A table line in SQL, whose patterns look neither ahead nor behind: what stands beside a match is captured, and where matches share it, replaced twice.
_FIXED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([0-9])[oO]([0-9])', '\\10\\2', 'g'), '([0-9])[oO]([0-9])', '\\10\\2', 'g'), '([.])[oO]([0-9])', '\\10\\2', 'g'), '([0-9])[oO]([.])', '\\10\\2', 'g')"
_TOKEN = r"'\b[0-9Oo.,-]+\b'"
_PLAIN = "regexp_replace(replace(s, '|', ' '), '[¥£€©®™]', '', 'g')"
_REWRITTEN = f"CASE WHEN regexp_matches({_PLAIN}, '[0-9.][oO][0-9.]') THEN array_to_string(list_transform(list_zip(string_split_regex({_PLAIN}, {_TOKEN}), regexp_extract_all({_PLAIN}, {_TOKEN})), lambda z: z[1] || coalesce(list_transform([z[2]], lambda t: {_FIXED})[1], '')), '') ELSE {_PLAIN} END"
_TABLE_LINE = _REWRITTEN
for _pattern, _by in (
    (r"(\s)[AVW]\s+([0-9])", r"\1\2"), (r"(\s)V[vV]\s+([0-9])", r"\1\2"), (r"(^|[^A-Za-z])[_^~]+\s*([0-9])", r"\1\2"), (r"(^|[^A-Za-z])[_^~]+\s*([0-9])", r"\1\2"), (r"([0-9])[\[\]}]+", r"\1"), (r"[\[{]+([0-9])", r"\1"),
    (r"([0-9])_([0-9])", r"\1 \2"), (r"([0-9])_([0-9])", r"\1 \2"), (r"([0-9])\s+[&^~]+\s+([0-9])", r"\1 \2"), (r"([0-9])\s+[&^~]+\s+([0-9])", r"\1 \2"), (r"[ \t]+", " "),
):
    _TABLE_LINE = f"regexp_replace({_TABLE_LINE}, '{_pattern}', '{_by}', 'g')"
_CLEANED = (
    _CLASSED
    + f""", t AS (SELECT *, CASE cls WHEN 'page' THEN regexp_replace(s, '\\s+', ' ', 'g') WHEN 'heading' THEN s WHEN 'table' THEN trim({_TABLE_LINE}) WHEN 'blank' THEN '' WHEN 'noise' THEN NULL
ELSE trim(replace(regexp_replace(s, '[ \\t]{{2,}}', ' ', 'g'), 'Inpt', 'Input')) END AS text FROM q)"""
)


@query(
    _CLEANED
    + """, k AS (SELECT *, lead(cls) OVER w AS next, max(CAST(cls <> 'blank' AS INTEGER)) OVER w AS opened FROM t WHERE cls <> 'noise' AND (cls = 'blank' OR text <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS line_no, cls, in_table, text FROM k WHERE cls <> 'blank' OR (next <> 'blank' AND opened = 1)"""
)
def cleaned_lines(spark, sf_dir):
    return cleaning.clean(document_lines(spark, sf_dir))[0]


@query(
    _CLEANED
    + f"""SELECT doc_id, line_no, 'removed' AS kind, s AS message FROM t WHERE cls = 'noise'
UNION ALL SELECT doc_id, line_no, 'cleaned', 'Cleaned: ' || s || ' -> ' || text FROM t WHERE cls = 'table' AND s <> text
UNION ALL SELECT doc_id, line_no, 'numeric', 'OCR numeric correction: ' || t || ' -> ' || {_FIXED} FROM (SELECT doc_id, line_no, unnest(regexp_extract_all({_PLAIN}, {_TOKEN})) AS t FROM t WHERE cls = 'table') WHERE t <> {_FIXED}
UNION ALL SELECT doc_id, line_no, 'merged', 'REVIEW merged/suspicious number: ' || v || ' | ' || text
FROM (SELECT doc_id, line_no, text, unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '\\b[0-9]{{2,4}}[.][0-9]{{2,}}\\b')) AS v FROM t WHERE cls = 'table') WHERE strpos(v, '.') > 3"""
)
def cleaning_audit(spark, sf_dir):
    return cleaning.clean(document_lines(spark, sf_dir))[1]


@query(LINES + r"SELECT doc_id, line_no, trim(replace(regexp_replace(s, '[ \t]{2,}', ' ', 'g'), 'Inpt', 'Input')) AS line FROM marked")
def normal_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).select("doc_id", "line_no", cleaning.clean_normal_line(F.col("raw")).alias("line"))


_ISSUES = r"""list_concat(
list_transform(list_filter(list_concat(regexp_extract_all(a, '\b[A-Za-z]+[-_]?\d+(?:\.\d+)?\b'), regexp_extract_all(a, '\b\d+(?:\.\d+)?[A-Za-z]+\b')), lambda v: upper(v) NOT IN ('FY24','FY25','FY26') AND NOT regexp_matches(upper(v), '^(TABLE|PAGE)\d*$')), lambda v: 'Attached letters/numbers: ''' || v || ''''),
list_transform(list_filter(string_split_regex(s, '\s+'), lambda t: length(trim(t, ',;:()[]{}')) - length(replace(trim(t, ',;:()[]{}'), '.', '')) > 1 AND regexp_matches(t, '\d')), lambda t: 'Multiple decimal points: ''' || t || ''''),
list_transform(list_filter(string_split_regex(s, '\s+'), lambda t: length(trim(t, ',;:()[]{}')) - length(replace(trim(t, ',;:()[]{}'), ',', '')) > 1 AND regexp_matches(trim(t, ',;:()[]{}'), '^[\d,]+$')), lambda t: 'Suspicious numeric commas: ''' || t || ''''),
list_transform(list_filter(string_split_regex(s, '\s+'), lambda t: regexp_matches(trim(t, ',;:()[]{}'), '^\d{5,}\.\d+$')), lambda t: 'Possible merged number: ''' || t || ''''),
list_transform(list_filter(regexp_extract_all(a, '\b(?:[A-Za-z][0-9]+|[0-9]+[A-Za-z])\b'), lambda v: upper(v) NOT IN ('FY24','FY25','FY26','MT')), lambda v: 'Possible OCR character substitution: ''' || v || ''''))"""
_ROWS = rf"""every AS (SELECT *, len(regexp_extract_all(a, '\b\d+(?:[.,]\d+)*\b')) >= 3 AS is_row, {_ISSUES} AS said FROM marked),
checked AS (SELECT *, list_filter(said, lambda x, i: list_position(said, x) = i) AS issues FROM every)"""


_CARRIED = f"""{LINES}, {_ROWS}, carried AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(s, '(?i)PAGE\\s+\\d+') THEN regexp_extract(s, '(?i)PAGE\\s+(\\d+)', 1) END IGNORE NULLS) OVER w, 'Unknown') AS page,
coalesce(last_value(CASE WHEN regexp_matches(a, '(?i)\\bTABLE\\s+\\d') THEN s END IGNORE NULLS) OVER w, 'Unknown') AS table_title FROM checked
WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(_CARRIED + "SELECT doc_id, line_no, page, table_title, is_row FROM carried")
def page_carry(spark, sf_dir):
    return validation.check_lines(document_lines(spark, sf_dir)).select("doc_id", "line_no", "page", F.col("table").alias("table_title"), "is_row")


@query(LINES + "," + _ROWS + "SELECT doc_id, line_no, unnest(issues) AS issue FROM checked WHERE is_row")
def line_issues(spark, sf_dir):
    return validation.issues(document_lines(spark, sf_dir)).select("doc_id", "line_no", "issue")


@query(
    LINES
    + ","
    + _ROWS
    + """SELECT d.doc_id, CAST(coalesce(r, 0) AS BIGINT) AS table_rows, CAST(coalesce(b, 0) AS BIGINT) AS rows_with_issues, CAST(coalesce(r - b, 0) AS BIGINT) AS rows_without_issues,
CAST(coalesce(n, 0) AS BIGINT) AS total_issues, round(CASE WHEN coalesce(r, 0) > 0 THEN (r - b) / r * 100 ELSE 100.0 END, 6) AS validation_quality
FROM documents d LEFT JOIN (SELECT doc_id, count_if(is_row) AS r, count_if(is_row AND len(issues) > 0) AS b, sum(CASE WHEN is_row THEN len(issues) ELSE 0 END) AS n FROM checked GROUP BY doc_id) USING (doc_id)"""
)
def validation_metrics(spark, sf_dir):
    found = validation.metrics(table(spark, sf_dir, "documents"), document_lines(spark, sf_dir))
    return found.withColumn("validation_quality", F.round("validation_quality", 6))


@query(
    _CARRIED
    + """SELECT doc_id, string_agg('Line ' || line_no || ' | Page ' || page || chr(10) || 'Table: ' || table_title || chr(10) || 'Original: ' || s || chr(10) || 'Issues:' || chr(10)
|| array_to_string(list_transform(issues, lambda i: '  - ' || i), chr(10)) || chr(10) || repeat('-', 70), chr(10) ORDER BY line_no) AS text FROM carried WHERE is_row AND len(issues) > 0 GROUP BY doc_id"""
)
def validation_review(spark, sf_dir):
    return validation.render_issues(validation.check_lines(document_lines(spark, sf_dir)))


_WORDS = r"len(list_filter(string_split_regex(s, '\s+'), lambda t: t <> ''))"
_TITLE = f"(s <> '' AND (regexp_matches(s, '(?i)^Table\\s+[\\dIVX]+') OR len(list_filter({list(lexicon.KNOWN_TITLES)}, lambda k: contains(upper(s), k))) > 0))"
_HEADER = f"len(list_filter({list(lexicon.HEADER_WORDS)}, lambda k: contains(lower(s), k)))".replace('"jan\'"', "'jan'''")
_CONTINUES = "len(list_filter([" + ", ".join("'" + k.replace("'", "''") + "'" for k in lexicon.CONTINUATION_WORDS) + "], lambda k: contains(lower(s), k))) > 0"


@query(
    LINES
    + rf"""SELECT doc_id, CAST(count_if({_TITLE}) AS BIGINT) AS titles, CAST(count_if({_HEADER} >= 2 OR ({_HEADER} = 1 AND {_WORDS} <= 6)) AS BIGINT) AS headers, CAST(count_if({_CONTINUES}) AS BIGINT) AS continuations,
CAST(count_if(regexp_matches(s, '^\d{{1,2}}\.\s+[A-Za-z]')) AS BIGINT) AS sections,
CAST(count_if(CASE WHEN s = '' OR {_TITLE} OR regexp_matches(s, '(?i)^Source\s*:') OR regexp_matches(s, '^\d+$') THEN FALSE WHEN {_WORDS} > 35 AND {_N.format("a")} < 2 THEN FALSE WHEN {_N.format("a")} >= 2 THEN TRUE
ELSE {_N.format("a")} = 1 AND ({_WORDS} <= 20 OR regexp_matches(a, '\b20\d{{2}}(?:[-/]\d{{2,4}})?\b') OR contains(s, '%')) END) AS BIGINT) AS row_like FROM marked GROUP BY doc_id"""
)
def structure_line_profile(spark, sf_dir):
    return structure_profile(document_lines(spark, sf_dir))


def structure_profile(lines: DataFrame) -> DataFrame:
    judged = lines.select("doc_id", structure.judged(text.strip(F.col("raw"))).alias("j"))
    count = lambda c, name: F.count_if(f"j.{c}").alias(name)
    return judged.groupBy("doc_id").agg(count("title", "titles"), count("header", "headers"), count("continuation", "continuations"), count("section", "sections"), count("row", "row_like"))


@query(LEDGER + "SELECT doc_id, p AS page, ord AS table_ord, title, header, CAST(n_rows AS INTEGER) AS n_rows, md5(body) AS rows_digest, source, md5(text) AS text_digest FROM tabs JOIN said USING (doc_id, p)")
def structured_tables(spark, sf_dir):
    made = ledger_pages(spark, sf_dir).select("*", F.posexplode("tables").alias("pos", "t"))
    return made.select(
        "doc_id", "page", (F.col("pos") + 1).alias("table_ord"), "t.title", F.array_join("t.header", "|").alias("header"), F.size("t.rows").alias("n_rows"),
        F.md5(F.array_join("t.rows", "\n")).alias("rows_digest"), "t.source", F.md5("text").alias("text_digest"),
    )


@query(LEDGER + "SELECT doc_id, count(DISTINCT p) AS pages, count(DISTINCT p) AS pages_with_text, count(*) AS tables, CAST(sum(n_rows) AS BIGINT) AS rows FROM tabs GROUP BY doc_id")
def document_info(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id")).distinct()
    return structure.document_info(docs, ledger_pages(spark, sf_dir))


@query(LEDGER + "SELECT doc_id, title, min(p) AS first_page FROM tabs GROUP BY ALL")
def title_first_seen(spark, sf_dir):
    return report.titles(ledger_pages(spark, sf_dir)).select("doc_id", "title", F.col("place.page_ord").cast("int").alias("first_page"))


def _hits(spark: SparkSession, sf_dir: str, wanted: str) -> DataFrame:
    hits = search.search(ledger_pages(spark, sf_dir), wanted)
    return hits.select("doc_id", "page", "kind", "table_ord", "title", F.size("rows").alias("n_rows"), F.md5(F.array_join("rows", "\n")).alias("rows_digest"), "title_match")


@query(
    LEDGER
    + """, hit AS (SELECT doc_id, p, seg, string_agg(r, chr(10) ORDER BY c_custkey) AS body, count(*) AS n FROM c JOIN pages USING (doc_id, seg, band) WHERE contains(lower(r), '#00000001') GROUP BY ALL)
SELECT doc_id, p AS page, kind, kind AS table_ord, CASE kind WHEN 0 THEN 'Page Text' ELSE 'Table ' || p || '.1 Balances of ' || seg END AS title, CAST(n AS INTEGER) AS n_rows, md5(body) AS rows_digest, FALSE AS title_match
FROM hit, (VALUES (0), (1)) AS k(kind)"""
)
def search_union(spark, sf_dir):
    return _hits(spark, sf_dir, "#00000001")


@query(
    LEDGER
    + """SELECT doc_id, p AS page, 0 AS kind, 0 AS table_ord, 'Page Text' AS title, 2 AS n_rows, md5('Table ' || p || '.3 Coal dispatch' || chr(10) || 'Table ' || p || '.3 Coal dispatch') AS rows_digest, FALSE AS title_match FROM said
UNION ALL SELECT doc_id, p, 1, ord, title, 0, md5(''), TRUE FROM tabs WHERE ord > 2"""
)
def search_titles(spark, sf_dir):
    return _hits(spark, sf_dir, " Coal DISPATCH")


@query(LINES + f"SELECT doc_id, CAST(count(*) AS INTEGER) AS n_rows, md5(string_agg(s, chr(10) ORDER BY line_no)) AS rows_digest FROM marked WHERE s <> '' AND contains(lower(s), '{SEARCHED}') GROUP BY doc_id")
def search_page_text(spark, sf_dir):
    hits = search.search(document_pages(spark, sf_dir), SEARCHED)
    return hits.select("doc_id", F.size("rows").alias("n_rows"), F.md5(F.array_join("rows", "\n")).alias("rows_digest"))


_FLAT = r"trim(regexp_replace(replace(coalesce(text, ''), '\n', ' '), '\s+', ' ', 'g'))"


@query(rf"SELECT doc_id, '0' AS chunk_id, 1 AS page, md5({_FLAT}) AS digest FROM documents WHERE {_FLAT} <> ''")
def chunk_pages(spark, sf_dir):
    return retrieval.page_chunks(document_pages(spark, sf_dir)).select("doc_id", "chunk_id", "page", F.md5("text").alias("digest"))


@query(
    rf"SELECT doc_id, CASE WHEN length({_FLAT}) > 1800 THEN '0_' || CAST(0 AS VARCHAR) ELSE '0' END AS chunk_id, CAST(length({_FLAT}) AS INTEGER) AS n_chars FROM documents WHERE {_FLAT} <> ''"
)
def chunk_split(spark, sf_dir):
    return retrieval.split_long(retrieval.page_chunks(document_pages(spark, sf_dir))).select("doc_id", "chunk_id", F.length("text").alias("n_chars"))


#: Paragraphs of a text, and the groups into which they are gathered until a group's blank-joined length exceeds 1200.
_GATHERED = r"""
WITH RECURSIVE split AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\n+')) AS x, generate_subscripts(string_split_regex(coalesce(text, ''), '\n+'), 1) AS i FROM documents),
clean AS (SELECT doc_id, i, trim(regexp_replace(replace(x, '\n', ' '), '\s+', ' ', 'g')) AS x FROM split),
para AS (SELECT doc_id, x, length(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM clean WHERE x <> ''),
gathered AS (SELECT doc_id, pos, x, n, 0 AS grp, n AS size FROM para WHERE pos = 1
UNION ALL SELECT p.doc_id, p.pos, p.x, p.n, CASE WHEN g.size > 1200 THEN g.grp + 1 ELSE g.grp END, CASE WHEN g.size > 1200 THEN p.n ELSE g.size + 1 + p.n END FROM gathered g JOIN para p ON p.doc_id = g.doc_id AND p.pos = g.pos + 1)
"""


@query(_GATHERED + "SELECT doc_id, grp AS ord, CAST(grp AS VARCHAR) AS chunk_id, CAST(NULL AS INTEGER) AS page, '' AS title, string_agg(x, chr(10) ORDER BY pos) AS text FROM gathered GROUP BY doc_id, grp")
def chunk_fallback(spark, sf_dir):
    return retrieval.fallback_chunks(table(spark, sf_dir, "documents"))


@query(
    _GATHERED
    + """, chunk AS (SELECT doc_id, grp, string_agg(x, chr(10) ORDER BY pos) AS text, min(pos) AS first FROM gathered GROUP BY doc_id, grp),
parted AS (SELECT g.doc_id, g.grp, g.pos, g.x, g.n, 0 AS part, g.n AS size FROM gathered g JOIN chunk c USING (doc_id, grp) WHERE g.pos = c.first AND length(c.text) > 1800
UNION ALL SELECT g.doc_id, g.grp, g.pos, g.x, g.n, CASE WHEN p.size + g.n > 1800 THEN p.part + 1 ELSE p.part END, CASE WHEN p.size + g.n > 1800 THEN g.n ELSE p.size + g.n END FROM parted p JOIN gathered g ON g.doc_id = p.doc_id AND g.grp = p.grp AND g.pos = p.pos + 1),
parts AS (SELECT doc_id, grp, part, TRUE AS long, string_agg(x, chr(10) ORDER BY pos) AS text FROM parted GROUP BY doc_id, grp, part UNION ALL SELECT doc_id, grp, 0, FALSE, text FROM chunk WHERE length(text) <= 1800),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp, part) - 1 AS place FROM parts)
SELECT doc_id, CAST(place AS INTEGER) AS ord, CASE WHEN long THEN grp || '_' || place ELSE CAST(grp AS VARCHAR) END AS chunk_id, md5(text) AS digest FROM placed"""
)
def chunk_fallback_split(spark, sf_dir):
    return retrieval.split_long(retrieval.fallback_chunks(table(spark, sf_dir, "documents"))).select("doc_id", "ord", "chunk_id", F.md5("text").alias("digest"))


_KEYWORD = f"len(list_intersect(list_distinct(regexp_extract_all('{QUESTION}', '[a-zA-Z0-9]+')), list_distinct(regexp_extract_all(regexp_replace(lower(text), '[^\\x00-\\x7F]', '_', 'g'), '\\b[a-zA-Z0-9]+\\b')))) / len(list_distinct(regexp_extract_all('{QUESTION}', '[a-zA-Z0-9]+')))"
_BONUS = f"len(list_filter(regexp_extract_all('{QUESTION}', '[a-zA-Z0-9]+(?:-[a-zA-Z0-9]+)*'), lambda t: contains(lower(text), t))) / len(regexp_extract_all('{QUESTION}', '[a-zA-Z0-9]+(?:-[a-zA-Z0-9]+)*'))"


@query(f"SELECT doc_id, round({_KEYWORD}, 6) AS keyword, round({_BONUS}, 6) AS bonus FROM documents")
def keyword_scores(spark, sf_dir):
    q = F.lit(QUESTION)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(retrieval.keyword_score(F.col("text"), q), 6).alias("keyword"), F.round(retrieval.token_bonus(F.col("text"), q), 6).alias("bonus"))


_VECTOR = [round(((i * 37) % 64 - 31.5) / 64, 6) for i in range(64)]


@query(
    f"""WITH q AS (SELECT {_VECTOR}::DOUBLE[] AS q), e AS (SELECT d.doc_id, text, embedding::DOUBLE[] AS v FROM documents d JOIN embeddings ON vec_id = d.doc_id),
s AS (SELECT doc_id, list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)) AS semantic, {_KEYWORD} AS keyword, {_BONUS} AS bonus FROM e, q)
SELECT doc_id, round(0.60 * semantic + 0.25 * keyword + 0.15 * bonus, 6) AS score, round(semantic, 6) AS semantic FROM s ORDER BY 0.60 * semantic + 0.25 * keyword + 0.15 * bonus DESC, doc_id LIMIT 5"""
)
def hybrid_topk(spark, sf_dir):
    chunks = retrieval.page_chunks(document_pages(spark, sf_dir))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    best = retrieval.rank(chunks.join(vectors, "doc_id"), QUESTION, _VECTOR)
    return best.select("doc_id", F.round("score", 6).alias("score"), F.round("semantic", 6).alias("semantic"))


@query("SELECT 'Page ' || turn || CASE WHEN trim(role) <> '' THEN ' — ' || trim(role) ELSE '' END AS source, count(*) AS n FROM conversations GROUP BY 1")
def source_labels(spark, sf_dir):
    label = retrieval.source_label(F.col("turn"), F.col("role"))
    return table(spark, sf_dir, "conversations").groupBy(label.alias("source")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) AS w FROM documents) WHERE length(w) >= 3 AND w NOT IN {lexicon.CLOUD_STOP_WORDS}
GROUP BY w ORDER BY n DESC, w LIMIT 100"""
)
def word_frequency_top100(spark, sf_dir):
    return topics.word_frequencies(table(spark, sf_dir, "documents"))


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '---\s*page\s*\d+\s*---', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '\S+@\S+', ' ', 'g'), '\b\d+(?:\.\d+)?\b', ' ', 'g'), '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g'))"""
_TFIDF = rf"""
WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents), u AS (SELECT * FROM c WHERE t <> ''),
w AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda x: length(x) >= 2 AND x NOT IN {lexicon.TOPIC_STOP_WORDS}) AS w FROM u),
g AS (SELECT doc_id, unnest(list_concat(w, list_concat(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) ELSE [] END, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) ELSE [] END))) AS term FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
n AS (SELECT count(*) AS n FROM u),
v AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 1000),
x AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN v USING (term)),
y AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id),
score AS (SELECT term, sum(w / norm) / (SELECT n FROM n) AS score FROM x JOIN y USING (doc_id) GROUP BY term)
"""


@query(_TFIDF + "SELECT term, round(score, 6) AS score FROM score")
def topic_tfidf(spark, sf_dir):
    parts = topics.corpus(document_pages(spark, sf_dir))
    return topics.weights(parts).select("term", F.round("score", 6).alias("score"))


@query(
    _TFIDF
    + f""", good AS (SELECT term, round(score, 12) AS score, string_split(term, ' ') AS words FROM score), m AS (SELECT *, list_filter(words, lambda w: w NOT IN {lexicon.TOPIC_STOP_WORDS}) AS f FROM good),
k AS (SELECT term, score, words FROM m WHERE len(list_filter(words, lambda w: length(w) < 3)) = 0 AND len(f) > 0 AND (len(words) < 2 OR len(f) >= 2) AND len(list_distinct(words)) = len(words) AND term NOT IN {lexicon.GENERIC_TOPICS}),
b AS (SELECT * FROM k WHERE score >= 0.2 * (SELECT max(score) FROM k))
SELECT term, round(score, 6) AS score FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE (o.score > b.score OR (o.score = b.score AND o.term < b.term)) AND len(list_filter(b.words, lambda w: NOT list_contains(o.words, w))) = 0)"""
)
def topic_final(spark, sf_dir):
    parts = topics.corpus(document_pages(spark, sf_dir))
    return topics.topics(parts).select("term", F.round("score", 6).alias("score"))


_SENTENCES = r"""WITH f AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
s AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS pos FROM f)"""


@query(
    _SENTENCES
    + r""", g AS (SELECT doc_id, sentence, min(pos) AS pos FROM s WHERE length(sentence) >= 40 AND NOT regexp_matches(sentence, '(?i)^PAGE\s+\d+') GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS place, sentence FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 5"""
)
def summary_sentences(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(report.summary_sentences(F.col("text"))).alias("pos", "sentence"))
    return found.select("doc_id", (F.col("pos") + 1).alias("place"), "sentence")


@query(
    _SENTENCES
    + f""", g AS (SELECT doc_id, sentence, min(pos) AS pos FROM s WHERE length(sentence) >= 30 AND len(list_filter({list(lexicon.KEY_INFORMATION_WORDS)}, lambda k: contains(lower(sentence), k))) > 0 GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS place, sentence FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 10"""
)
def key_sentences(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(report.key_sentences(F.col("text"))).alias("pos", "sentence"))
    return found.select("doc_id", (F.col("pos") + 1).alias("place"), "sentence")


_RULE, _DASHES = "=" * 70, "-" * 70
_HEAD = lambda t: f"'', '{_DASHES}', '{t}', '{_DASHES}'"
_ENTRY = lambda label, c: f"'{label:<28}: ' || {c}"


@query(
    LEDGER
    + rf""", whole AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY p) AS text, count(*) AS pages FROM said GROUP BY doc_id),
f AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM whole),
s AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS pos FROM f),
sums AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM (SELECT doc_id, sentence, min(pos) AS pos FROM s WHERE length(sentence) >= 40 AND NOT regexp_matches(sentence, '(?i)^PAGE\s+\d+') GROUP BY doc_id, sentence QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) <= 5) GROUP BY doc_id),
keys AS (SELECT doc_id, string_agg(k || '. ' || sentence, chr(10) ORDER BY k) AS keys FROM (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS k FROM s WHERE length(sentence) >= 30 AND len(list_filter({list(lexicon.KEY_INFORMATION_WORDS)}, lambda k: contains(lower(sentence), k))) > 0 GROUP BY doc_id, sentence) WHERE k <= 10 GROUP BY doc_id),
names AS (SELECT doc_id, string_agg(k || '. ' || title, chr(10) ORDER BY k) AS titles FROM (SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY min(p * 10 + ord)) AS k FROM tabs GROUP BY doc_id, title) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS tables, sum(n_rows) AS n FROM tabs GROUP BY doc_id),
shown AS (SELECT doc_id, r AS a FROM c UNION ALL SELECT c.doc_id, r FROM c JOIN (SELECT doc_id, seg, band, max(c_custkey) AS c_custkey FROM c GROUP BY ALL) USING (doc_id, seg, band, c_custkey)),
rows_ AS (SELECT doc_id, count(*) AS n FROM shown WHERE len(regexp_extract_all(a, '\b\d+(?:[.,]\d+)*\b')) >= 3 GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10), '{_RULE}', 'AUTOMATED REPORT', '{_RULE}', {_HEAD("DOCUMENT DETAILS")}, 'Document: structured_cleaned_' || doc_id, 'Generated on: 01-01-2025 00:00:00', 'Pages: ' || pages, {_HEAD("DOCUMENT SUMMARY")}, summary,
{_HEAD("DOCUMENT PERFORMANCE METRICS")}, {_ENTRY("Total pages processed", "pages")}, {_ENTRY("Pages containing text", "pages")}, {_ENTRY("Tables detected", "tables")}, {_ENTRY("Rows extracted", "CAST(counts.n AS BIGINT)")},
{_HEAD("OCR PERFORMANCE METRICS")}, {_ENTRY("Table-like rows inspected", "coalesce(rows_.n, 0)")}, {_ENTRY("Rows requiring review", "0")}, {_ENTRY("Rows without detected issues", "coalesce(rows_.n, 0)")}, {_ENTRY("Possible OCR issues", "0")},
{_ENTRY("Validation Quality", "'100.00%'")}, {_HEAD("IDENTIFIED TABLES / SECTIONS")}, titles, {_HEAD("KEY EXTRACTED INFORMATION")}, keys, '', '{_RULE}', 'END OF REPORT', '{_RULE}') AS text
FROM whole JOIN sums USING (doc_id) JOIN keys USING (doc_id) JOIN names USING (doc_id) JOIN counts USING (doc_id) LEFT JOIN rows_ USING (doc_id)"""
)
def report_texts(spark, sf_dir):
    lines = ledger_lines(spark, sf_dir)
    docs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id")).distinct()
    made = materialise(structure.pages(lines), "pages")  # read three times
    names = docs.select("doc_id", F.concat(F.lit("structured_cleaned_"), F.col("doc_id").cast("string")).alias("name"))
    return report.report_lines(structure.document_info(docs, made), report.document_text(made), report.titles(made), validation.metrics(docs, lines), names, "01-01-2025 00:00:00").select("doc_id", F.array_join("lines", "\n").alias("text"))


@query(
    "SELECT page_id, CASE WHEN contains(url, '.') THEN lower(list_last(string_split(url, '.'))) END AS extension, coalesce(lower(list_last(string_split(url, '.'))) IN ('pdf','docx','xlsx','xls','csv','png','jpg','jpeg') AND contains(url, '.'), FALSE) AS allowed FROM pages"
)
def file_extension_filter(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", sources.file_extension(url).alias("extension"), sources.is_allowed(url).alias("allowed"))


@query(
    "SELECT p_partkey, 'cleaned_' || n || '.txt' AS cleaned, 'validated_cleaned_' || n || '.txt' AS validated, 'structured_cleaned_' || n || '.json' AS structured FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS n FROM part)"
)
def filename_chain(spark, sf_dir):
    names = sources.stage_names(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit(".pdf")))
    return table(spark, sf_dir, "part").select("p_partkey", names.alias("n")).select("p_partkey", "n.cleaned", "n.validated", "n.structured")


@query("SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS brightness, round(list_stddev_pop(embedding::DOUBLE[]), 6) AS contrast FROM embeddings")
def image_stats(spark, sf_dir):
    q = imaging.image_quality(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", q.alias("q")).select("vec_id", F.round("q.brightness", 6).alias("brightness"), F.round("q.contrast", 6).alias("contrast"))


@query("SELECT user_id, round(coalesce(avg(value) FILTER (WHERE value >= 0), 0.0), 6) AS confidence FROM events GROUP BY user_id")
def ocr_confidence(spark, sf_dir):
    words = table(spark, sf_dir, "events").select("user_id", F.col("value").cast("string").alias("confidence"))
    return imaging.page_confidence(words, ["user_id"]).select("user_id", F.round("confidence", 6).alias("confidence"))


@query(
    """WITH h AS (SELECT label, CAST(floor((x + 1) * 127) AS INTEGER) AS gray, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
s AS (SELECT *, sum(n) OVER w AS n0, sum(n * gray) OVER w AS s0, sum(n) OVER (PARTITION BY label) AS t, sum(n * gray) OVER (PARTITION BY label) AS s FROM h WINDOW w AS (PARTITION BY label ORDER BY gray)),
j AS (SELECT *, coalesce(n0 * (t - n0) * pow(s0 / n0 - (s - s0) / nullif(t - n0, 0), 2), 0) AS spread FROM s)
SELECT label, gray AS threshold, round((t - n0) / t, 6) AS white_ratio FROM j QUALIFY row_number() OVER (PARTITION BY label ORDER BY spread DESC, gray) = 1"""
)
def otsu_thresholds(spark, sf_dir):
    pixels = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x")).select("label", F.floor((F.col("x").cast("double") + 1) * 127).cast("int").alias("gray"))
    return imaging.otsu_threshold(pixels, ["label"]).select("label", "threshold", F.round("white_ratio", 6).alias("white_ratio"))


@query(
    """WITH d AS (SELECT doc_id, n_chars, doc_id % 3 = 0 AS again, doc_id % 7 = 0 AS gone FROM documents),
r AS (SELECT doc_id, 'english' AS language, CASE WHEN again THEN 'Second report' || chr(10) || source ELSE 'First report' || chr(10) || n_chars END AS text, CASE WHEN again THEN 3 ELSE 1 END AS version FROM d JOIN documents USING (doc_id, n_chars) WHERE NOT gone OR (again AND gone)
UNION ALL SELECT doc_id, 'hindi', 'First report' || chr(10) || n_chars, 1 FROM d WHERE again)
SELECT doc_id, language, text, CAST(version AS BIGINT) AS version FROM r"""
)
def report_lifecycle(spark, sf_dir):
    """Reports of all documents; every seventh removed; every third written again, twice, and in another language too."""
    folder, docs = new_path(spark, "report-store"), table(spark, sf_dir, "documents")
    third = docs.where("doc_id % 3 = 0")
    first = F.array(F.lit("First report"), F.col("n_chars").cast("string"))
    reports.write_reports(docs.select("doc_id", first.alias("lines")), folder, version=1)
    reports.write_reports(third.select("doc_id", first.alias("lines")), folder, language="hindi", version=1)
    reports.remove_reports(docs.where("doc_id % 7 = 0"), folder, version=2)
    for _ in range(2):
        reports.write_reports(third.select("doc_id", F.array(F.lit("Second report"), F.col("source")).alias("lines")), folder, version=3)
    reports.compact_reports(spark, folder)
    return reports.read_reports(spark, folder)


def _ocr_text(content: bytes):
    """The page of a file that is its text; a file that begins with a mark cannot be read."""
    if content.startswith(b"\x00"):
        raise ValueError("damaged file")
    yield 1, content.decode()


@query(
    """WITH d AS (SELECT doc_id, doc_id % 10 = 3 AS bad FROM documents), s AS (SELECT * FROM (VALUES ('ocr', 1), ('cleaning', 2), ('validation', 3), ('structure', 4)) AS v(stage, k))
SELECT doc_id || '.pdf' AS doc_id, stage, CASE WHEN bad THEN 'OCR failed: damaged file' END AS error, CAST(CASE WHEN bad THEN 0 ELSE 1 END AS BIGINT) AS pages FROM d JOIN s ON k = 1 OR NOT bad"""
)
def stage_outcomes(spark, sf_dir):
    """A file for each document, every tenth damaged: what came of each in every stage that it reached."""
    marked = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("\x00"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), F.col("doc_id"), F.lit(".pdf")).alias("path"), marked.cast("binary").alias("content"))
    found = app.process_recorded(files, _ocr_text).outcomes
    pages = F.when(F.col("stage").isin("ocr", "structure"), F.col("rows")).otherwise((F.col("rows") > 0).cast("long"))
    return found.select("doc_id", "stage", "error", pages.alias("pages"))


def scanned(sql: str, make) -> None:
    """Registers a query over the scanned items beside the one over the documents, with the same SQL over their lines."""
    assert LINES in sql
    make.__name__ = f"scan_{make.__name__}"
    query(sql.replace(LINES, SCAN))(make)


def _scanned() -> None:
    def line_class(spark, sf_dir):
        return cleaning.classify(scanned_lines(spark, sf_dir)).select("doc_id", "line_no", "cls", "in_table")

    def cleaned_lines(spark, sf_dir):
        return cleaning.clean(scanned_lines(spark, sf_dir))[0]

    def cleaning_audit(spark, sf_dir):
        return cleaning.clean(scanned_lines(spark, sf_dir))[1]

    def page_carry(spark, sf_dir):
        return validation.check_lines(scanned_lines(spark, sf_dir)).select("doc_id", "line_no", "page", F.col("table").alias("table_title"), "is_row")

    def line_issues(spark, sf_dir):
        return validation.issues(scanned_lines(spark, sf_dir)).select("doc_id", "line_no", "issue")

    def validation_review(spark, sf_dir):
        return validation.render_issues(validation.check_lines(scanned_lines(spark, sf_dir)))

    def numeric_line_profile(spark, sf_dir):
        return numeric_profile(scanned_lines(spark, sf_dir))

    def structure_line_profile(spark, sf_dir):
        return structure_profile(scanned_lines(spark, sf_dir))

    for make in (line_class, cleaned_lines, cleaning_audit, page_carry, line_issues, validation_review, numeric_line_profile, structure_line_profile):
        scanned(ORACLES[make.__name__], make)


_scanned()


#: What the index is asked for: two words of licenses, a run of letters and a sign, one that is too short for a gram, one that nothing has.
INDEXED = ("MIT License", "ion. T", "q.", "no such words at all")


@query(
    LINES
    + f"""SELECT asked, doc_id, CAST(count(*) AS INTEGER) AS n_rows, md5(string_agg(s, chr(10) ORDER BY line_no)) AS rows_digest FROM marked, (SELECT unnest({list(INDEXED)}) AS asked)
WHERE s <> '' AND contains(lower(s), lower(asked)) GROUP BY ALL"""
)
def search_indexed(spark, sf_dir):
    """Several searches of all documents by one index."""
    index = search_index.build_index(document_pages(spark, sf_dir), new_path(spark, "search-index"), block_pages=100)
    found = [search_index.indexed_search(index, q).select(F.lit(q).alias("asked"), "doc_id", F.size("rows").alias("n_rows"), F.md5(F.array_join("rows", "\n")).alias("rows_digest")) for q in INDEXED]
    return functools.reduce(DataFrame.unionByName, found)


_ASKED = r"list_distinct(regexp_extract_all(lower(regexp_replace(question, '[^\x00-\x7F]', '_', 'g')), '\b[a-zA-Z0-9]+\b'))"
_TOKENS = r"regexp_extract_all(lower(regexp_replace(question, '[^\x00-\x7F\x{2013}]', '_', 'g')), '\b[a-zA-Z0-9]+(?:[-\x{2013}][a-zA-Z0-9]+)*\b')"


@query(
    rf"""WITH q AS (SELECT item_id AS qid, {_ASKED} AS qw, {_TOKENS} AS qt, embedding::DOUBLE[] AS qv FROM (SELECT item_id, text AS question, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)),
c AS (SELECT doc_id, lower({_FLAT}) AS t, list_distinct(regexp_extract_all(regexp_replace(lower({_FLAT}), '[^\x00-\x7F]', '_', 'g'), '\b[a-zA-Z0-9]+\b')) AS w, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id WHERE {_FLAT} <> ''),
s AS (SELECT qid, doc_id, list_dot_product(v, qv) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(qv, qv)) AS semantic, CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(qw, w)) / len(qw) END AS keyword, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_filter(qt, lambda x: contains(t, x))) / len(qt) END AS bonus FROM q, c)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY 0.60 * semantic + 0.25 * keyword + 0.15 * bonus DESC, doc_id) AS INTEGER) AS place, doc_id, round(0.60 * semantic + 0.25 * keyword + 0.15 * bonus, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY 0.60 * semantic + 0.25 * keyword + 0.15 * bonus DESC, doc_id) <= 5"""
)
def hybrid_topk_many(spark, sf_dir):
    """Every benchmark item as a question to all documents with a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    chunks = retrieval.page_chunks(document_pages(spark, sf_dir)).join(vectors, "doc_id")
    index = retrieval_index.build_chunk_index(chunks, new_path(spark, "chunk-index"), list_chunks=50)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")).join(vectors.withColumnRenamed("doc_id", "qid"), "qid")
    return retrieval_index.rank_many(index, asked).select("qid", "place", "doc_id", F.round("score", 6).alias("score"))


_LIKELY = "ln(greatest({x}, 1e-10)) * ({k}) + ln(greatest(1 - ({x}), 1e-10)) * (({m}) - ({k}))"
_APART = " ".join(
    sign + "(" + _LIKELY.format(k=k, m=m, x=x) + ")"
    for sign, k, m, x in (("", "c12", "c1", "c2 / n"), ("+", "c2 - c12", "n - c1", "c2 / n"), ("-", "c12", "c1", "c12 / c1"), ("-", "c2 - c12", "n - c1", "(c2 - c12) / (n - c1)"))
)


@query(
    f"""WITH d AS (SELECT doc_id, lang AS g, list_filter(regexp_extract_all(lower(text), '[a-zA-Z]+'), lambda w: length(w) >= 3 AND w NOT IN {lexicon.CLOUD_STOP_WORDS}) AS w FROM documents WHERE lang IS NOT NULL),
u AS (SELECT g, t, count(*) AS c FROM (SELECT g, unnest(w) AS t FROM d) GROUP BY ALL),
us AS (SELECT u.g, u.t, u.c, coalesce(o.t, u.t) AS s FROM (SELECT *, CASE WHEN ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN left(t, length(t) - 1) END AS one FROM u) u LEFT JOIN u o ON o.g = u.g AND o.t = u.one),
uc AS (SELECT g, s, sum(c) AS c FROM us GROUP BY ALL), n AS (SELECT g, sum(c) AS n FROM u GROUP BY g),
p AS (SELECT g, t, count(*) AS c FROM (SELECT g, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS t FROM d) GROUP BY ALL),
ps AS (SELECT p.g, coalesce(o.t, p.t) AS s, sum(p.c) AS c12 FROM (SELECT *, CASE WHEN ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN left(t, length(t) - 1) END AS one FROM p) p LEFT JOIN p o ON o.g = p.g AND o.t = p.one GROUP BY ALL),
k AS (SELECT us.g || '/' || us.t AS word, us.s, uc.c FROM us JOIN uc ON us.g || '/' || us.s = uc.g || '/' || uc.s),
m AS (SELECT ps.g, ps.s, c12, a.s AS a, b.s AS b, a.c AS c1, b.c AS c2, n.n FROM ps JOIN n ON n.g = ps.g JOIN k a ON a.word = ps.g || '/' || split_part(ps.s, ' ', 1) JOIN k b ON b.word = ps.g || '/' || split_part(ps.s, ' ', 2)),
x AS (SELECT * FROM m WHERE n > c1 AND n > c2 AND -2 * ({_APART}) > 30),
l AS (SELECT g, s, sum(c12) AS c FROM (SELECT g, a AS s, c12 FROM x UNION ALL SELECT g, b, c12 FROM x) GROUP BY ALL),
r AS (SELECT uc.g, uc.s AS term, uc.c - coalesce(l.c, 0) AS n FROM uc LEFT JOIN l ON l.g || '/' || l.s = uc.g || '/' || uc.s WHERE uc.c - coalesce(l.c, 0) > 0 UNION ALL SELECT g, s, c12 FROM x)
SELECT g AS lang, term, CAST(n AS BIGINT) AS n FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, term) <= 100"""
)
def cloud_by_language(spark, sf_dir):
    """What a cloud of each language's documents shows: words, plurals folded, and pairs of words."""
    pages = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", F.lit(1).alias("page_ord"), "text", "lang")
    return topics.cloud_terms(pages, "lang").select(F.col("g").alias("lang"), "term", "n")


def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, image): each vector as a picture of eight rows of eight pixels, every fourth one faint."""
    faint = F.when(F.col("vec_id") % 4 == 0, 9).otherwise(127)
    bytes_ = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * faint).cast("long")), 2, "0"))
    gray = F.unhex(F.array_join(bytes_, ""))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), gray.alias("gray")).cast(imaging.IMAGE).alias("image"))


_TAPS = [round(2.718281828459045 ** (-((k - 15) ** 2) / 50.0), 17) for k in range(31)]


@query(
    f"""WITH px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(floor((embedding[i + 1]::DOUBLE + 1) * CASE WHEN vec_id % 4 = 0 THEN 9 ELSE 127 END) AS INTEGER) AS gray FROM embeddings, range(64) AS r(i)),
h AS (SELECT vec_id, gray, count(*) AS n FROM px GROUP BY ALL),
s AS (SELECT *, sum(n) OVER w AS n0, sum(n * gray) OVER w AS s0, sum(n) OVER (PARTITION BY vec_id) AS t, sum(n * gray) OVER (PARTITION BY vec_id) AS s FROM h WINDOW w AS (PARTITION BY vec_id ORDER BY gray)),
j AS (SELECT *, coalesce(n0 * (t - n0) * pow(s0 / n0 - (s - s0) / nullif(t - n0, 0), 2), 0) AS spread FROM s),
o AS (SELECT vec_id, gray AS threshold, (t - n0) / t AS white FROM j QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY spread DESC, gray) = 1),
k AS (SELECT i - 15 AS d, {_TAPS}[i + 1] / list_sum({_TAPS}) AS w FROM range(31) AS r(i)),
f AS (SELECT vec_id, c.i AS cx, sum(w * gray) AS g, y FROM px, range(8) AS c(i), k WHERE x = greatest(0, least(7, c.i + d)) GROUP BY ALL),
m AS (SELECT vec_id, cx AS x, c.i AS y, round_even(sum(w * g), 0) AS mean FROM f, range(8) AS c(i), k WHERE f.y = greatest(0, least(7, c.i + d)) GROUP BY ALL),
a AS (SELECT vec_id, count_if(gray - mean > -11) / 64 AS white FROM px JOIN m USING (vec_id, x, y) GROUP BY vec_id)
SELECT vec_id, threshold, CASE WHEN o.white BETWEEN 0.45 AND 0.98 THEN 'otsu' ELSE 'adaptive' END AS method, round(CASE WHEN o.white BETWEEN 0.45 AND 0.98 THEN o.white ELSE a.white END, 6) AS white_ratio FROM o JOIN a USING (vec_id)"""
)
def page_binarisation(spark, sf_dir):
    """Each vector as a small picture, in black and white by one threshold or by each pixel's surroundings."""
    made = vector_images(spark, sf_dir).select("vec_id", imaging.binarised(F.col("image")).alias("b"))
    return made.select("vec_id", "b.threshold", "b.method", F.round("b.white_ratio", 6).alias("white_ratio"))


_UPLOADS = """u AS (SELECT 'dir/' || list_last(string_split(url, '/')) || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.exe' WHEN 3 THEN '.pdf' ELSE '' END AS name, page_id, html FROM pages)"""


@query(
    f"""WITH {_UPLOADS}, f AS (SELECT list_last(string_split(name, '/')) AS file, page_id, html FROM u),
j AS (SELECT *, CASE WHEN trim(file) = '' THEN 'No file selected' WHEN NOT (contains(file, '.') AND lower(list_last(string_split(file, '.'))) IN ('pdf','docx','xlsx','xls','csv','png','jpg','jpeg')) THEN 'Unsupported file type' END AS message FROM f),
t AS (SELECT file, lower(list_last(string_split(file, '.'))) AS type, html, page_id % 2 AS v, octet_length(encode(html)) AS n FROM j WHERE message IS NULL)
SELECT file AS path, type, CAST(v AS BIGINT) AS version, sha256(html) AS digest, CAST(NULL AS VARCHAR) AS message FROM t QUALIFY row_number() OVER (PARTITION BY file ORDER BY v DESC, n DESC, sha256(html) DESC) = 1
UNION ALL SELECT 'dir/' || file, NULL, NULL, NULL, message FROM j WHERE message IS NOT NULL"""
)
def upload_landing(spark, sf_dir):
    """The raw pages as uploads in two calls: what has landed, newest of each name, and what was refused."""
    number = F.col("page_id") % 5
    ending = F.when(number == 0, ".PDF").when(number == 1, ".xlsx").when(number == 2, ".exe").when(number == 3, ".pdf").otherwise("")
    sent = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("dir/"), F.element_at(F.split("url", "/"), -1), ending).alias("name"), F.col("html").cast("binary").alias("content"))
    folder = new_path(spark, "landing")
    refused = [uploads.land(sent.where(F.col("page_id") % 2 == v).drop("page_id"), folder, v) for v in (0, 1)]
    have = uploads.landed(spark, folder).select("path", "type", "version", F.sha2("content", 256).alias("digest"), F.lit(None).cast("string").alias("message"))
    not_taken = refused[0].unionByName(refused[1]).select(F.col("name").alias("path"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("digest"), "message")
    return have.unionByName(not_taken)
