"""Chunks of a document, hybrid vector and keyword ranking, context and sources for an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import let, squeeze

TOP_K, CONTEXT_CHARS, LONGEST_CHUNK, FALLBACK_CHUNK = 5, 12_000, 1800, 1200
WEIGHTS = {"semantic": 0.60, "keyword": 0.25, "bonus": 0.15}
#: What is answered when nothing can be.
NO_DOCUMENT = "No processed document is available."
NO_QUESTION = "Please enter a question."
NO_CONTENT = "No usable content was found in the structured document."
NOTHING_FOUND = "I could not find relevant information in the uploaded document."
NO_ANSWER = "The LLM could not generate a reliable answer from the retrieved document information."
NO_PROVIDER = "The LLM is not available."

Embedder = Callable[[Column], Column]
AnswerProvider = Callable[[str], str]


def clean_text(text: Column) -> Column:
    """Null as empty, a written-out backslash-n as a blank, white space squeezed."""
    return squeeze(F.replace(F.coalesce(text, F.lit("")), F.lit("\\n"), F.lit(" ")))


def page_chunks(structured: DataFrame) -> DataFrame:
    """(doc_id, ord, chunk_id, page, title, text): one chunk for each page with text, numbered by page from 0.

    Nested tables are not read, as their lines are in the page's text.
    """
    out = structured.select("doc_id", (F.col("page_ord") - 1).alias("ord"), (F.col("page_ord") - 1).cast("string").alias("chunk_id"), "page", F.lit("").alias("title"), clean_text(F.col("text")).alias("text"))
    return out.where(F.col("text") != "")


def _fold(parts: Column, flush_after: int | None, limit: int) -> Column:
    """Paragraphs gathered into groups; ARRAY<STRING>, paragraphs of a group joined by line ends.

    With ``flush_after`` a group is closed once its blank-joined length exceeds it; otherwise
    before its summed length would exceed ``limit``.
    """
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("size"))

    def step(acc: Column, p: Column) -> Column:
        grown = F.concat(acc["open"], F.array(p))
        if flush_after is not None:
            full = F.length(F.array_join(grown, " ")) > flush_after
            closed = F.struct(F.concat(acc["done"], F.array(F.array_join(grown, "\n"))).alias("done"), empty.alias("open"), F.lit(0).alias("size"))
            return F.when(full, closed).otherwise(F.struct(acc["done"].alias("done"), grown.alias("open"), F.lit(0).alias("size")))
        over = (F.size(acc["open"]) > 0) & (acc["size"] + F.length(p) > limit)
        closed = F.struct(F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n"))).alias("done"), F.array(p).alias("open"), F.length(p).alias("size"))
        return F.when(over, closed).otherwise(F.struct(acc["done"].alias("done"), grown.alias("open"), (acc["size"] + F.length(p)).alias("size")))

    return F.aggregate(parts, zero, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n")))).otherwise(acc["done"]))


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+"), clean_text), lambda p: p != "")


def gather_paragraphs(text: Column) -> Column:
    """ARRAY<STRING>: paragraphs until over FALLBACK_CHUNK characters."""
    return _fold(_paragraphs(F.coalesce(text, F.lit(""))), FALLBACK_CHUNK, 0)


def fallback_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of plain texts: paragraphs until over FALLBACK_CHUNK characters."""
    groups = gather_paragraphs(F.col(text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(groups).alias("ord", "text"))
    return out.select("doc_id", "ord", F.col("ord").cast("string").alias("chunk_id"), F.lit(None).cast("int").alias("page"), F.lit("").alias("title"), "text")


def split_long(chunks: DataFrame) -> DataFrame:
    """Chunks over LONGEST_CHUNK characters cut between paragraphs; a part's id is ``id_n``, n its place among all chunks of the document."""
    parts = F.when(F.length("text") <= LONGEST_CHUNK, F.array(F.col("text"))).otherwise(_fold(_paragraphs(F.col("text")), None, LONGEST_CHUNK))
    long = F.length("text") > LONGEST_CHUNK
    out = chunks.select("doc_id", F.col("ord").alias("from"), "chunk_id", "page", "title", long.alias("long"), F.posexplode(parts).alias("part", "text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("from", "part")) - 1
    placed = out.withColumn("ord", place)
    return placed.select("doc_id", "ord", F.when(F.col("long"), F.concat_ws("_", "chunk_id", "ord")).otherwise(F.col("chunk_id")).alias("chunk_id"), "page", "title", "text")


def normalise(v: Column) -> Column:
    """A vector at unit length in double precision; a zero vector as it is."""
    doubled = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubled, F.lit(0.0), lambda a, x: a + x * x))
    return let(F.struct(doubled.alias("v"), norm.alias("n")), lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-zA-Z0-9]+\b"), F.lit(0)))


def keyword_score(text: Column, query: Column) -> Column:
    """Share of the query's different words that the text has."""
    q = words(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, words(text))) / F.size(q))


def query_tokens(query: Column) -> Column:
    """The tokens of a question, inner hyphens kept, as often as they occur."""
    return F.regexp_extract_all(F.lower(query), F.lit("\\b[a-zA-Z0-9]+(?:[-\u2013][a-zA-Z0-9]+)*\\b"), F.lit(0))


def token_bonus(text: Column, query: Column) -> Column:
    """Share of the query's tokens (inner hyphens kept) that are substrings of the text."""
    q = query_tokens(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.filter(q, lambda t: F.contains(F.lower(text), t))) / F.size(q))


def rank(chunks: DataFrame, query: str, query_vector: list[float], vector_col: str = "vector", k: int = TOP_K) -> DataFrame:
    """The k best of ``chunks`` (with a vector each) by score, ties by document and order: score, semantic, keyword, bonus added.

    The top k are kept in each partition before they meet, so the sort never shuffles the chunks.
    """
    q, v = F.lit(query), F.array(*[F.lit(float(x)) for x in query_vector])
    scored = chunks.withColumn("semantic", dot(normalise(F.col(vector_col)), normalise(v))).withColumn("keyword", keyword_score(F.col("text"), q)).withColumn("bonus", token_bonus(F.col("text"), q))
    score = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("score", score).orderBy(F.desc("score"), "doc_id", "ord").limit(k)


def source_label(page: Column, title: Column) -> Column:
    named = F.when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string")))
    title = F.nullif(clean_text(title), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" \u2014 ", named, title), F.lit("")), F.lit("Document"))


def sources(ranked: DataFrame) -> DataFrame:
    """(source, place): the different labels in order of first mention."""
    w = Window.orderBy(F.desc("score"), "doc_id", "ord")  # k rows
    labelled = ranked.select(source_label(F.col("page"), F.col("title")).alias("source"), F.row_number().over(w).alias("place"))
    return labelled.groupBy("source").agg(F.min("place").alias("place")).orderBy("place")


def context(ranked: DataFrame) -> DataFrame:
    """One row: the ranked chunks as one text for a prompt, cut to CONTEXT_CHARS."""
    w = Window.orderBy(F.desc("score"), "doc_id", "ord")  # k rows
    part = ranked.withColumn("place", F.row_number().over(w))
    block = F.concat(F.lit("--- Retrieved Source "), F.col("place"), F.lit(" ---\nSource: "), source_label(F.col("page"), F.col("title")), F.lit("\nContent:\n"), clean_text(F.col("text")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", block.alias("b")))), lambda s: s["b"]), "\n\n")
    return part.agg(F.substring(joined, 1, CONTEXT_CHARS).alias("context"))


def prompt(question: str, found: str) -> str:
    return f"Answer the question from the sources only. Say so if they do not hold the answer.\n\n{found}\n\nQuestion: {question.strip()}\nAnswer:"


def ask(chunks: DataFrame, question: str, embed_query: Callable[[str], list[float]], answer: AnswerProvider | None, vector_col: str = "vector") -> str:
    """An answer with its sources; of the corpus only the k best chunks reach the driver."""
    if not question.strip():
        return NO_QUESTION
    ranked = rank(chunks, question, embed_query(question), vector_col).cache()
    try:
        if ranked.isEmpty():
            return NO_CONTENT
        names = [r.source for r in sources(ranked).collect()]
        said = NO_PROVIDER
        if answer is not None:
            said = " ".join((answer(prompt(question, context(ranked).first().context)) or "").split()) or NO_ANSWER
    finally:
        ranked.unpersist()
    return "\n".join([said, "", "Sources:", *[f"\u2022 {n}" for n in names]])
