"""Fill-in-the-middle transformation: texts cut at unit borders that relational operations find."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import filled, join_on, materialise, text_key

#: A unit is a line with its end; every character of a text is in one.
LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Middle:
    """``rate`` of 100 texts are transformed, ``spm`` of 100 of these with the suffix first.

    ``unit`` must match every character of any text. ``markers`` stand before prefix, suffix
    and middle; none may begin as another or itself ends. ``salt`` draws other cuts.
    """

    rate: int = 100
    spm: int = 50
    unit: str = LINES
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    salt: str = "7:"


def draws(doc_id: Column, salt: str) -> list[Column]:
    """Four numbers from 0 to 2**32 - 1 that depend on the id alone; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_lengths(docs: DataFrame, rules: Middle, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tk, lengths): code points of each document's units; rows equal in id and text are one, put together before the shuffle."""
    lengths = F.transform(F.regexp_extract_all(filled(F.col(text_col)), F.lit(rules.unit), F.lit(0)), lambda u: F.length(u))
    each = docs.select(F.col(id_col).alias("doc_id"), text_key(filled(F.col(text_col))).alias("tk"), lengths.alias("lengths"))
    return materialise(each.groupBy("doc_id", "tk").agg(F.first("lengths").alias("lengths")), "unit-lengths")


def cut_offsets(lengths: DataFrame, rules: Middle) -> DataFrame:
    """(doc_id, tk, n, prefix_chars, middle_chars) of each document.

    The lengths are exploded to a row for each unit, whose running sum in the document is
    where the unit ends. Two cut requests for each document, by unit ordinal, meet these rows
    in a join, and the offsets found are gathered for the document. No text is moved.
    """
    upto = Window.partitionBy("doc_id", "tk").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    units = lengths.select("doc_id", "tk", F.posexplode("lengths").alias("at", "chars")).select("doc_id", "tk", (F.col("at") + 1).cast("long").alias("unit"), "chars")
    ends = units.select("doc_id", "tk", "unit", F.sum("chars").over(upto).alias("ends"))
    h1, h2, *_ = draws(F.col("doc_id"), rules.salt)
    n = F.size("lengths").cast("long")
    asked = lengths.select("doc_id", "tk", n.alias("n"), F.posexplode(F.array(F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1)))).alias("cut", "unit"))
    met = join_on(asked, ends, ["doc_id", "tk", "unit"], "left").withColumn("ends", F.coalesce("ends", F.lit(0)))  # before the first unit: 0
    first, last = (F.max(F.when(F.col("cut") == k, F.col("ends"))) for k in (0, 1))
    return met.groupBy("doc_id", "tk").agg(F.first("n").alias("n"), first.alias("prefix_chars"), (last - first).alias("middle_chars"))


def restored(output: Column, form: Column, rules: Middle = Middle()) -> Column:
    """The text that ``output`` was made from."""
    p, s, m = rules.markers
    body = F.substring(output, F.length(F.when(form == "psm", p).otherwise(s)) + 1, F.length(output))
    outer = F.split_part(body, F.lit(m), F.lit(1))
    part = lambda marker, k: F.split_part(outer, F.lit(marker), F.lit(k))
    middle = F.split_part(body, F.lit(m), F.lit(2))
    return F.when(form == "psm", F.concat(part(s, 1), middle, part(s, 2))).when(form == "spm", F.concat(part(p, 2), middle, part(p, 1))).otherwise(output)


def fill_in_middle(docs: DataFrame, rules: Middle = Middle(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output.

    The prefix ends after one number of units, the middle after another, both drawn by the
    id. form is ``plain``, with the text as output and null lengths, where the text is empty,
    holds a marker or is not drawn for transformation; else ``psm`` or ``spm``. A null text
    counts as empty, a null id draws as an empty one, rows with one id and different texts
    are cut by their own units, repeated rows each have a row. Columns of these names are
    replaced; other columns are passed through.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    offsets = cut_offsets(unit_lengths(docs, rules, id_col, text_col), rules)
    found = offsets.select(*[F.col(c).alias(f"__{c}") for c in offsets.columns])
    keyed = docs.withColumns({"__text": filled(F.col(text_col)), "__row_id": F.col(id_col)})
    joined = keyed.join(found, F.col("__row_id").eqNullSafe(F.col("__doc_id")) & (text_key(F.col("__text")) == F.col("__tk")))
    text, before, inside = F.col("__text"), F.col("__prefix_chars"), F.col("__middle_chars")
    *_, h3, h4 = draws(F.col("__row_id"), rules.salt)
    marked = F.lit(False)
    for marker in rules.markers:
        marked = marked | F.contains(text, F.lit(marker))
    form = F.when((text == "") | marked | (h3 % 100 >= rules.rate), "plain").when(h4 % 100 < rules.spm, "spm").otherwise("psm")
    formed = joined.withColumn("__form", form)
    prefix = F.substring(text, F.lit(1), before.cast("int"))
    middle = F.substring(text, (before + 1).cast("int"), inside.cast("int"))
    suffix = F.substring(text, (before + inside + 1).cast("int"), F.length(text))
    p, s, m = map(F.lit, rules.markers)
    form = F.col("__form")
    output = F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    length = lambda c: F.when(form != "plain", c)
    return formed.select(
        *[F.col(c) for c in docs.columns if c not in new], F.col("__n").alias("n"), form.alias("form"), length(before).alias("prefix_chars"), length(inside).alias("middle_chars"), output.alias("output")
    )
