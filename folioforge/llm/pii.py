"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import filled, let, running

LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"

#: Fixed values. The base kinds in their order. Runs are possessive and a match starts where
#: its run starts (or where the last match ended): the same matches as the plain patterns,
#: in time linear in the text.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The method's own kinds.
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
SECRET = r"(?<=[\"'=:\x20])[0-9a-f]{40}(?![0-9A-Za-z])"

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """How one kind is found: a cheap sign that a text may hold it, the pattern, the check, context words, scores."""

    name: str
    sign: str
    pattern: str
    base: bool
    score: float
    context: str


KINDS = (
    Kind("email", "@", EMAIL, True, 0.8, r"(?i)\b(?:e-?mail|mail|contact|write)\b"),
    Kind("ip", ".", IP, True, 0.6, r"(?i)\b(?:ip|host|server|address)\b"),
    Kind("card", "", CARD, True, 0.7, r"(?i)\b(?:card|visa|credit|debit|payment)\b"),
    Kind("phone", "+", PHONE, True, 0.7, r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
    Kind("iban", "", IBAN, False, 0.7, r"(?i)\b(?:iban|account|bank|transfer)\b"),
    Kind("secret", "", SECRET, False, 0.3, r"(?i)\b(?:token|key|secret|password)\b"),
)
NAMES = [k.name for k in KINDS]
#: Characters on either side of a match in which context words are sought.
NEAR = 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "(?<=.)(?=.)")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks passes the mod-97 check; letters count 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.try_to_number(c, F.lit("9")).cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)
    return F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(text), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    if kind == "iban":
        return let(F.replace(text, F.lit(" "), F.lit("")), lambda x: F.when(F.length(x).between(15, 34), mod97(x)).otherwise(False))
    return F.lit(True)


FOUND = "struct<start:int,end:int,text:string,before:string,after:string>"


def _proposed(kind: Kind, text: Column) -> Column:
    """ARRAY<FOUND> of the matches; before and after are what stands between a match and its neighbours, 40 characters at most.

    The text splits at just the places where the pattern matches, so lengths of the pieces
    and matches, added up, are the offsets in code points.
    """

    def placed(hits: Column, gaps: Column) -> Column:
        sizes = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))

        def one(at: Column, h: Column, gap: Column, after: Column) -> Column:
            start = at + F.length(gap)
            return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("text"), F.right(gap, F.lit(NEAR)).alias("before"), F.left(after, F.lit(NEAR)).alias("after"))

        return let(running(sizes, F.lit(0), lambda a, n: a + n), lambda at: F.transform(hits, lambda h, i: one(F.get(at, i), h, F.get(gaps, i), F.get(gaps, i + 1))))

    none = F.array().cast(f"array<{FOUND}>")
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    made = let(hits, lambda m: F.when(F.size(m) > 0, let(F.split(text, kind.pattern), lambda gaps: placed(m, gaps))).otherwise(none))
    return F.when(F.contains(text, F.lit(kind.sign)), made).otherwise(none) if kind.sign else made


def _scored(number: int, kind: Kind, text: Column) -> Column:
    """The confirmed matches of one kind with their scores."""

    def scored(x: Column) -> Column:
        near = F.when(x["before"].rlike(kind.context) | x["after"].rlike(kind.context), 0.3).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"), F.lit(number).alias("kind_no"), x["end"].alias("end"), F.lit(kind.name).alias("kind"),
            F.round(F.least(F.lit(1.0), F.lit(kind.score) + near), 2).alias("score"), x["text"].alias("text"),
        )

    return F.transform(F.filter(_proposed(kind, text), lambda x: _valid(kind.name, x["text"])), scored)


def spans(text: Column, least_score: float = 0.5) -> Column:
    """ARRAY<STRUCT<start, kind_no, end, kind, score, text>> of one text, by start and kind; row-local, without a shuffle.

    A word of the kind's context within 40 characters on either side, up to the neighbouring
    match of the kind, raises a match's score by 0.3. Base kinds keep every match that passes
    its check, whatever its score. The method's kinds (account numbers that pass mod 97,
    hexadecimal secrets) need ``least_score``.
    """
    parts = [_scored(number, kind, text) for number, kind in enumerate(KINDS)]
    kept = [x if kind.base else F.filter(x, lambda s: s["score"] >= least_score) for kind, x in zip(KINDS, parts, strict=True)]
    return F.sort_array(F.concat(*kept))


def find(docs: DataFrame, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with pii, the spans of its text (none for null or empty texts); a column of that name is replaced."""
    return docs.withColumn("pii", spans(filled(F.col(text_col)), least_score))


def redact(docs: DataFrame, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; overlapping spans go together, by the first one's kind."""
    text = filled(F.col(text_col))

    def cleaned(upto: Column) -> Column:
        """``upto`` is where the spans before each span end."""
        put = lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        pieces = F.transform(F.col("pii"), lambda s, i: put(s, F.get(upto, i)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(F.transform("pii", lambda s: s["end"])) + 1, F.length(text)))

    ends = running(F.transform("pii", lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    return find(docs, least_score, text_col).withColumn(text_col, F.when(F.size("pii") > 0, let(ends, cleaned)).otherwise(F.col(text_col)))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the spans as text (kind:start:end by start, then kind, comma-joined), their number and, in the same order, their scores.

    Null and empty texts have none. Repeated rows and null ids are rows like any other.
    """
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(F.col("pii"), lambda s: s["kind_no"] < 4)
    count = lambda k: F.size(F.filter(F.col("pii"), lambda s: s["kind_no"] == k)).cast("long").alias(f"n_{NAMES[k]}")
    found = docs.select(F.col(id_col).alias("doc_id"), spans(filled(F.col(text_col))).alias("pii"))
    return found.select(
        "doc_id", *[count(k) for k in range(4)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
