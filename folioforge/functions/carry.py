"""What earlier lines of a document carry to later ones, also where a document has more lines than a task should hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a line: its document and its number in it, from 1.
DOC, LINE = "doc_id", "line_no"


def carried(lines: DataFrame, values: dict[str, Column], span: int | None = None, inclusive: bool = True, counts: dict[str, Column] | None = None) -> DataFrame:
    """``lines`` with, for each name of ``values``, its last value that is not null up to the line, and for each of ``counts`` how many are not null.

    With ``inclusive`` the line itself takes part, else only those before it. Without ``span``
    the lines of a document are one window. With it they are cut into ranges of so many lines:
    what each range ends with and counts is aggregated, a window over the ranges (a row each)
    says what a range begins with, and each range is a window of its own. Both give the same.
    """
    counts = counts or {}
    last = 0 if inclusive else -1
    if span is None:
        upto = Window.partitionBy(DOC).orderBy(LINE).rowsBetween(Window.unboundedPreceding, last)
        made = {n: F.last(v, ignorenulls=True).over(upto) for n, v in values.items()} | {n: F.count(v).over(upto) for n, v in counts.items()}
        return lines.select(*lines.columns, *[c.alias(n) for n, c in made.items()])
    names = [*values, *counts]
    cut = lines.withColumns({f"__{n}": v for n, v in (values | counts).items()}).withColumn("__range", F.floor((F.col(LINE) - 1) / span))
    ends = cut.groupBy(DOC, "__range").agg(
        *[F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col(LINE))).alias(n) for n in values], *[F.count(f"__{n}").alias(n) for n in counts]
    )
    before = Window.partitionBy(DOC).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(
        F.col(DOC).alias("__doc"), F.col("__range").alias("__part"),
        *[F.last(n, ignorenulls=True).over(before).alias(f"__begin_{n}") for n in values], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__begin_{n}") for n in counts],
    )
    inside = Window.partitionBy(DOC, "__range").orderBy(LINE).rowsBetween(Window.unboundedPreceding, last)
    own = cut.withColumns({f"__own_{n}": F.last(f"__{n}", ignorenulls=True).over(inside) for n in values} | {f"__own_{n}": F.count(f"__{n}").over(inside) for n in counts})
    met = own.join(begins, F.col(DOC).eqNullSafe(F.col("__doc")) & (F.col("__range") == F.col("__part")))
    whole = [F.coalesce(f"__own_{n}", f"__begin_{n}").alias(n) if n in values else (F.col(f"__own_{n}") + F.col(f"__begin_{n}")).alias(n) for n in names]
    return met.select(*lines.columns, *whole)
