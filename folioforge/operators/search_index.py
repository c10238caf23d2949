"""Indexed literal search: a trigram index over blocks of pages, which prunes what the literal check reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions.storage import load, save
from folioforge.functions.text import let
from folioforge.operators.search import search

#: Pages of a block about, and folders that the grams are dealt to.
BLOCK_PAGES, GRAM_BUCKETS = 2000, 64
#: Characters of a gram; shorter queries read all pages.
GRAM = 3


@dataclass(frozen=True)
class SearchIndex:
    """Where the pages, in blocks, and the grams' lists of pages are."""

    spark: SparkSession
    folder: str

    @property
    def pages(self) -> DataFrame:
        """The pages, with place in the block and block (a folder each)."""
        return load(self.spark, f"{self.folder}/pages")

    @property
    def grams(self) -> DataFrame:
        """(gram, block, places, bucket): the places, ascending, of a block's pages that have a gram; a folder for each bucket of grams."""
        return load(self.spark, f"{self.folder}/grams")


def searched_text(structured: DataFrame) -> Column:
    """All that a search looks into: the page's text, titles and rows, a line each."""
    tables = F.transform("tables", lambda t: F.concat_ws("\n", t["title"], F.array_join(t["rows"], "\n")))
    return F.concat_ws("\n", F.col("text"), F.array_join(tables, "\n"))


def grams_of(text: Column) -> Column:
    """The different runs of GRAM characters of the lower-cased text."""
    joined = lambda c: lambda i: F.concat(*[F.get(c, i + k) for k in range(GRAM)])
    runs = lambda c: F.when(F.size(c) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), joined(c)))).otherwise(F.array().cast("array<string>"))
    return let(F.filter(F.split(F.lower(text), ""), lambda x: x != ""), runs)


def gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def build_index(structured: DataFrame, folder: str, block_pages: int = BLOCK_PAGES) -> SearchIndex:
    """Writes the index of pages ``structured(doc_id, page_ord, page, text, tables)`` below ``folder``.

    Documents are dealt to blocks by a hash. Pages and lists are made where a block's pages
    are, so the grams, far more than the pages, are not shuffled before they are lists.
    Repeated pages each have a place; null texts and tables have no grams.
    """
    spark = structured.sparkSession
    blocks = max(1, -(-structured.count() // block_pages))
    place = F.row_number().over(Window.partitionBy("block").orderBy("doc_id", "page_ord")) - 1
    dealt = structured.withColumn("block", F.pmod(F.xxhash64("doc_id", "page_ord"), F.lit(blocks)).cast("int"))
    save(dealt.withColumn("place", place), f"{folder}/pages", "block")
    made = SearchIndex(spark, folder)
    each = made.pages.repartition("block").select("block", "place", F.explode(grams_of(searched_text(structured))).alias("gram"))
    lists = each.groupBy("block", "gram").agg(F.sort_array(F.collect_list("place")).alias("places"))
    by_bucket = lists.withColumn("bucket", gram_bucket(F.col("gram"))).hint("rebalance", F.col("bucket"))
    save(by_bucket.sortWithinPartitions("bucket", "gram"), f"{folder}/grams", "bucket")
    return made


def needed_grams(query: str) -> list[str]:
    """The grams that every text with the query has; none for a query that is too short."""
    wanted = query.strip().lower()
    return sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})


def candidates(index: SearchIndex, query: str) -> DataFrame | None:
    """(block, place) of the pages that have all grams of the query, which all that it hits are; None if all pages may be hit.

    Only the folders of the query's grams are read.
    """
    grams = needed_grams(query)
    if not grams:
        return None
    spark = index.spark
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").select(gram_bucket(F.col("gram")).alias("bucket")).distinct().collect()
    found = index.grams.where(F.col("bucket").isin([r.bucket for r in asked]) & F.col("gram").isin(grams))
    have = found.select("block", F.explode("places").alias("place")).groupBy("block", "place").agg(F.count("*").alias("n"))
    return have.where(F.col("n") == len(grams)).drop("n")


def indexed_search(index: SearchIndex, query: str) -> DataFrame:
    """What ``search`` finds in the indexed pages, after a look only into those that have all grams of the query.

    Where few pages are left, Spark broadcasts their places and reads the folders of their
    blocks alone. A query of under GRAM characters reads all pages.
    """
    left = candidates(index, query)
    pages = index.pages
    if left is not None:
        pages = pages.join(left, ["block", "place"], "left_semi")
    return search(pages.drop("block", "place"), query)
