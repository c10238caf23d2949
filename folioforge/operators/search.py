"""Literal search over page text, table titles and table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import strip

PAGE_TEXT = "Page Text"


def search(structured: DataFrame, query: str) -> DataFrame:
    """(doc_id, page_ord, page, kind, table_ord, title, rows, title_match) of the hits for a literal, case ignored.

    A page hits with its lines that hold the query; a table hits with its rows that do, or by
    its title alone (then without rows). kind is 0 for page text and 1 for a table; ordering
    by doc_id, page_ord, kind, table_ord is left to the caller, who may need only some hits.
    A blank query hits nothing. ``structured`` is read once: both kinds of hit come from one
    array for each page.
    """
    wanted = query.strip().lower()
    holds = lambda c: F.contains(F.lower(c), F.lit(wanted))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), strip), lambda x: (x != "") & holds(x))
    page_hit = F.struct(F.lit(0).alias("kind"), F.lit(0).alias("table_ord"), F.lit(PAGE_TEXT).alias("title"), lines.alias("rows"), F.lit(False).alias("title_match"))
    table_hits = F.transform(
        F.coalesce(F.col("tables"), F.array().cast("array<struct<title:string,header:array<string>,rows:array<string>,source:string>>")),
        lambda t, i: F.struct(
            F.lit(1).alias("kind"), (i + 1).alias("table_ord"), F.coalesce(t["title"], F.lit("")).alias("title"),
            F.filter(F.transform(t["rows"], strip), holds).alias("rows"), holds(F.coalesce(t["title"], F.lit(""))).alias("title_match"),
        ),
    )
    hits = F.filter(F.concat(F.array(page_hit), table_hits), lambda h: (F.size(h["rows"]) > 0) | h["title_match"])
    found = structured.where(F.lit(bool(wanted))).select("doc_id", "page_ord", "page", F.explode(hits).alias("h"))
    return found.select("doc_id", "page_ord", "page", "h.*")
