"""Text and chunks out of JSON of any shape, for documents that were not structured here."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators import retrieval

#: Keys whose strings are text, in their order, and keys that hold the list of objects.
TEXT_KEYS = ("title", "text", "content", "page_text", "heading", "section", "source", "description")
BODY_KEYS = ("text", "content", "page_text")
CONTAINERS = ("pages", "documents", "sections", "data", "results")
CHUNKS = "struct<parts:array<struct<ord:int,page:string,title:string,text:string>>,everything:string>"


def tidy(value: Any) -> str:
    return "" if value is None else " ".join(str(value).replace("\\n", " ").split())


def _row(row: Any) -> str:
    cells = row.values() if isinstance(row, dict) else row if isinstance(row, list) else [row]
    return " | ".join(filter(None, map(tidy, cells)))


def texts(node: Any) -> Iterator[str]:
    """All text below a node: its own strings, its rows, then what its other members hold."""
    if isinstance(node, str):
        found = [tidy(node)]
    elif isinstance(node, list):
        found = [t for x in node for t in texts(x)]
    elif isinstance(node, dict):
        rows = node.get("rows")
        inner = [v for k, v in node.items() if k not in TEXT_KEYS and k != "rows" and isinstance(v, (dict, list))]
        found = [tidy(node[k]) for k in TEXT_KEYS if isinstance(node.get(k), str)]
        found += [_row(r) for r in rows] if isinstance(rows, list) else []
        found += [t for x in inner for t in texts(x)]
    else:
        found = []
    yield from filter(None, found)


def objects(root: Any) -> list:
    """The objects that become chunks: a root list, the first list under a container key, else the root itself."""
    if isinstance(root, dict):
        held = next((root[k] for k in CONTAINERS if isinstance(root.get(k), list)), None)
        return held or [root]
    return root if isinstance(root, list) else []


def chunk(ord_: int, node: Any) -> dict | None:
    """The chunk of one object, each part once; None without text."""
    page, title = None, ""
    if isinstance(node, dict):
        page, title = node.get("page", node.get("page_number")), tidy(node.get("title", node.get("section", "")))
        rows = node.get("rows", [])
        parts = [tidy(node[k]) for k in BODY_KEYS if isinstance(node.get(k), str)] + ([_row(r) for r in rows] if isinstance(rows, list) else [])
    else:
        parts = list(texts(node))
    text = "\n".join(dict.fromkeys(filter(None, parts)))
    return {"ord": ord_, "page": None if page is None else str(page), "title": title, "text": text} if text else None


def _read(column: pd.Series) -> pd.DataFrame:
    out = []
    for raw in column:
        try:
            root = json.loads(raw) if raw else None
        except ValueError:
            root = None
        found = [c for c in (chunk(i, x) for i, x in enumerate(objects(root))) if c]
        out.append((found, "" if found else "\n".join(texts(root))))
    return pd.DataFrame(out, columns=["parts", "everything"])


def json_chunks(docs: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """(doc_id, ord, chunk_id, page, title, text) of JSON documents; page is text as it may be anything.

    Where no object has text of its own, all text is gathered into chunks of paragraphs.
    Null and unreadable JSON has no chunks.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(_read, CHUNKS)(F.col(json_col)).alias("r"))
    gathered = F.transform(
        retrieval.gather_paragraphs(F.col("r.everything")),
        lambda t, i: F.struct(i.alias("ord"), F.lit(None).cast("string").alias("page"), F.lit("").alias("title"), t.alias("text")),
    )
    parts: Column = F.when(F.size("r.parts") > 0, F.col("r.parts")).otherwise(gathered)
    return read.select("doc_id", F.explode(parts).alias("c")).select("doc_id", "c.ord", F.col("c.ord").cast("string").alias("chunk_id"), "c.page", "c.title", "c.text")
