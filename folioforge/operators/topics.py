"""Topics by TF-IDF over word 1- to 3-grams, and word frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import lexicon
from folioforge.functions.storage import materialise
from folioforge.functions.text import BLANKS, let

MAX_FEATURES, MIN_DF, LEAST_SHARE = 1000, 2, 0.2


def corpus(structured: DataFrame) -> DataFrame:
    """(doc_id, part, text): each page's text, and each table's title and rows as a document of their own."""
    parts = F.concat(
        F.array(F.col("text")),
        F.transform("tables", lambda t: F.concat_ws("\n", F.coalesce(t["title"], F.lit("")), F.array_join(t["rows"], "\n"))),
    )
    out = structured.select("doc_id", "page_ord", F.posexplode(parts).alias("pos", "text"))
    return out.where(F.trim("text") != "").select("doc_id", F.concat_ws(".", "page_ord", "pos").alias("part"), "text")


#: The sign without which a text cannot hold a match, and what is taken out of it.
REMOVED = (("---", r"---\s*page\s*\d+\s*---"), ("http", f"https?://[^{BLANKS}]+"), ("www.", f"www\\.[^{BLANKS}]+"), ("@", f"[^{BLANKS}]+@[^{BLANKS}]+"))


def clean_for_topics(text: Column) -> Column:
    """Lower-cased ASCII letters and single blanks; page marks, links and addresses are gone, numbers as all that are no letters."""

    def without(sign: str, pattern: str):
        return lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, " ")).otherwise(t)

    out = F.lower(text)
    for sign, pattern in REMOVED:
        out = let(out, without(sign, pattern))
    return F.trim(F.regexp_replace(out, "[^a-zA-Z]+", " "))


def topic_words(text: Column) -> Column:
    """The words of two letters or more that are no stop words, in order; null where nothing is left of the text."""
    return let(clean_for_topics(text), lambda t: F.when(t != "", F.filter(F.split(t, " "), lambda w: (F.length(w) >= 2) & ~w.isin(*lexicon.TOPIC_STOP_WORDS))))


def grams(words: Column, longest: int = 3) -> Column:
    """All 1- to ``longest``-grams of an array of words; those with a null word are left out."""

    def of(w: Column, n: int) -> Column:
        joined = lambda i: F.concat(*[x for k in range(n) for x in (F.lit(" "), F.get(w, i + k))][1:])  # noqa: E731  null with any null
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), joined)).otherwise(F.array().cast("array<string>"))

    return let(words, lambda w: F.array_compact(F.concat(w, *[of(w, n) for n in range(2, longest + 1)])))


def counted(terms: Column) -> Column:
    """ARRAY<STRUCT<term, tf>>: the different terms of an array and how often each is in it."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).cast("long").alias("tf"))))

    return let(F.sort_array(terms), runs)


#: Words that are looked up as a set of constants; were more as frequent as the rest, no word would be passed over.
FREQUENT = 20_000


def _frequent_words(words: DataFrame) -> list[str] | None:
    """The words that can be in one of the MAX_FEATURES most frequent terms, or None for all.

    A term is no more frequent than any word of it. So once MAX_FEATURES words are frequent
    enough by themselves, no term with a rarer word than these can be among the kept.
    """
    each = words.select(F.explode(counted(F.col("words"))).alias("x")).select("x.term", "x.tf")
    counts = materialise(each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "word-counts")
    best = counts.where(F.col("df") >= MIN_DF).orderBy(F.desc("cf")).limit(MAX_FEATURES)
    n, least = best.agg(F.count("*"), F.min("cf")).first()
    found = counts.where(F.col("cf") >= F.lit(least if n == MAX_FEATURES else 0)).select("term").limit(FREQUENT + 1).collect()
    return None if n < MAX_FEATURES or len(found) > FREQUENT else [r.term for r in found]


def weights(parts: DataFrame, group: str | None = None) -> DataFrame:
    """(g, term, score): mean TF-IDF weight of the kept terms over the parts of a group.

    Kept are terms in MIN_DF parts or more, of those the MAX_FEATURES most frequent, ties by
    term. Weights are (1 + ln tf)(ln((1 + N)/(1 + df)) + 1), at unit length in each part.
    Groups with fewer than two parts have no topics. Without ``group`` all parts are one, and
    g is 0.

    The parts are read for the words, for the terms that can be kept and for the weights of
    those that are; each time they are counted within the row and added up before anything
    is shuffled, and only what is kept goes on.
    """
    key = ["g"] if group else []
    words = parts.select(*([F.col(group).alias("g")] if group else []), F.concat_ws("/", "doc_id", "part").alias("part"), topic_words(F.col("text")).alias("words"))
    words = words.where(F.col("words").isNotNull())
    frequent = None if group else _frequent_words(words)
    usable = F.col("words") if frequent is None else F.transform("words", lambda w: F.when(w.isin(frequent), w))

    def terms(kept: list[str] | None = None) -> DataFrame:
        listed = grams(usable) if kept is None else F.filter(grams(usable), lambda t: t.isin(kept))
        return words.select(*key, "part", F.explode(counted(listed)).alias("x")).select(*key, "part", "x.term", "x.tf")

    df = terms().groupBy(*key, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= MIN_DF)
    n = words.groupBy(*key).agg(F.count("*").alias("n")).where("n >= 2")
    if group:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("cf"), "term"))).where(F.col("rank") <= MAX_FEATURES).join(n, "g")
    else:
        total = n.first()  # one figure
        ranked = df.orderBy(F.desc("cf"), "term").limit(MAX_FEATURES).withColumn("n", F.lit(total.n if total else 0)).where("n >= 2")
    vocabulary = materialise(ranked.select(*key, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "n"), "vocabulary")
    kept = None if group else [r.term for r in vocabulary.select("term").collect()]  # MAX_FEATURES at most
    w = terms(kept).join(vocabulary, [*key, "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    lengths = w.groupBy(*key, "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.collect_list(F.struct("term", "w", "n")).alias("all"))
    unit = lengths.select(*key, "length", F.explode("all").alias("x")).select(*key, "x.term", "x.n", (F.col("x.w") / F.col("length")).alias("u"))
    scored = unit.groupBy(*key, "term", "n").agg(F.sum("u").alias("total"))
    return scored.select(F.col("g") if group else F.lit(0).alias("g"), "term", (F.col("total") / F.col("n")).alias("score"))


def is_meaningful(term: Column) -> Column:
    words = F.split(term, " ")
    good = F.filter(words, lambda w: ~w.isin(*lexicon.TOPIC_STOP_WORDS))
    many = F.size(words) >= 2
    return (
        F.forall(words, lambda w: F.length(w) >= 3) & (F.size(good) > 0) & (~many | (F.size(good) >= 2))
        & (F.size(F.array_distinct(words)) == F.size(words)) & ~term.isin(*lexicon.GENERIC_TOPICS)
    )


def topics(parts: DataFrame, group: str | None = None) -> DataFrame:
    """(g, rank, term, score): meaningful terms of a fifth of the best score or more, without redundant ones.

    A term is redundant if a better-ranked one has all its words. A group has MAX_FEATURES
    terms at most, so they are put side by side in one row and compared there.
    """
    good = weights(parts, group).where(is_meaningful(F.col("term"))).withColumn("score", F.round("score", 12))
    one = F.struct((-F.col("score")).alias("minus"), "term", "score", F.split("term", " ").alias("words"))
    ranked = good.groupBy("g").agg(F.sort_array(F.collect_list(one)).alias("all"))
    cut = F.filter("all", lambda x: x["score"] >= LEAST_SHARE * F.col("all")[0]["score"])
    placed = F.transform(cut, lambda x, i: F.struct(i.alias("place"), x["term"].alias("term"), x["score"].alias("score"), x["words"].alias("words")))

    def left(every: Column) -> Column:
        covers = lambda x, y: (y["place"] < x["place"]) & (F.size(y["words"]) >= F.size(x["words"])) & (F.size(F.array_except(x["words"], y["words"])) == 0)
        return F.filter(every, lambda x: ~F.exists(every, lambda y: covers(x, y)))

    return ranked.select("g", F.posexplode(let(placed, left)).alias("pos", "t")).select("g", (F.col("pos") + 1).alias("rank"), "t.term", "t.score")


def word_frequencies(texts: DataFrame, text_col: str = "text", top: int | None = 100) -> DataFrame:
    """(word, n): counts of words of three ASCII letters or more that are no stop words, most frequent first, ties by word."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-zA-Z]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*lexicon.CLOUD_STOP_WORDS))
    counted = texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word")
    return counted.limit(top) if top else counted


#: Score above which two neighbours are shown as one term.
COLLOCATION = 30.0


def _cloud_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z]{3,}"), F.lit(0)), lambda w: ~w.isin(*lexicon.CLOUD_STOP_WORDS))


def _stem(word: Column) -> Column:
    """The word without a last s that may make it a plural. A stem is that of itself and of its plural, and of no other word."""
    return F.when(word.endswith("s") & ~word.endswith("ss"), F.left(word, F.length(word) - 1)).otherwise(word)


def _folded(said: DataFrame, key: list[str], word: str) -> DataFrame:
    """(key, stem, std, n): how often each word of ``said(key, word)`` occurs with its plural; std is the word that stands for both, the plural where it is alone."""
    plain = F.col(word) == F.col("stem")
    counted = said.withColumn("stem", _stem(F.col(word))).groupBy(*key, "stem").agg(F.count_if(plain).alias("plain"), F.count("*").alias("n"))
    return counted.select(*key, "stem", F.when(F.col("plain") > 0, F.col("stem")).otherwise(F.concat("stem", F.lit("s"))).alias("std"), "n")


def _log_likelihood(both: Column, first: Column, second: Column, n: Column) -> Column:
    """Twice the log of how much likelier the counts are if the second word depends on the first; 0 where a word is all there is."""

    def of(k: Column, m: Column, x: Column) -> Column:
        least = F.lit(1e-10)
        return F.log(F.greatest(x, least)) * k + F.log(F.greatest(1 - x, least)) * (m - k)

    p, p1, p2 = second / n, both / first, (second - both) / (n - first)
    apart = of(both, first, p) + of(second - both, n - first, p) - of(both, first, p1) - of(second - both, n - first, p2)
    return F.when((n <= first) | (n <= second), 0.0).otherwise(-2 * apart)


def _at_most(both: Column, first: Column, second: Column, n: Column) -> Column:
    """No less than the log-likelihood of two different words, with one logarithm: of k where e are awaited, the others add k ln(k / e) <= k (k - e) / e each."""
    of = lambda x, y: F.greatest(x, F.lit(1)).cast("double") * F.greatest(y, F.lit(1)) / n
    awaited = of(first, second)
    more = both - awaited
    return 2 * (both * F.log(both / awaited) - more + more * more * (1 / of(first, n - second) + 1 / of(n - first, second) + 1 / of(n - first, n - second)))


#: Most frequent words whose counts travel to the pairs, of all groups together.
KNOWN = 40_000


def _frequent(counts: DataFrame, total: DataFrame) -> DataFrame | None:
    """(g, stem, std, n, rank): the most frequent words of each group, KNOWN at most in all; None for too many groups."""
    each = KNOWN // max(1, total.count()) - 1
    if each < 1:
        return None
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "std"))
    return materialise(counts.withColumn("rank", place).where(F.col("rank") <= each + 1).withColumn("last", F.col("rank") > each), "cloud-frequent")


def _together(said: DataFrame, counts: DataFrame, total: DataFrame, frequent: DataFrame | None, of: list[str] | None) -> DataFrame:
    """(g, pair, both, a_std, b_std): words that follow each other beyond chance; with ``of`` only pairs of which a word is in it.

    Most pairs are rare, and what is known of the frequent words shows that they cannot be
    beyond chance: with the first word's count given, the likelihood is least where the
    second is as frequent as chance wants it, and grows to both sides. The second has the
    pair's count at least, and if it is not among the frequent, at most that of the next word
    after them. Only the other pairs meet the table of all words.
    """
    before = F.lag("last").over(Window.partitionBy("g", "doc_id").orderBy("page_ord"))
    ends = said.select("g", "doc_id", "page_ord", F.get("w", F.lit(0)).alias("first"), F.get("w", F.size("w") - 1).alias("last"))
    over = ends.select("g", before.alias("a"), F.col("first").alias("b")).where("a IS NOT NULL")
    rest = F.size("w") - 1
    inside = said.where(F.size("w") > 1).select("g", F.inline(F.arrays_zip(F.slice("w", 1, rest).alias("a"), F.slice("w", 2, rest).alias("b"))).alias("a", "b"))
    met = inside.unionByName(over)
    if of is not None:
        named = ", ".join(f"'{w}'" for w in of) or "NULL"  # a to z only
        met = met.where(f"a IN ({named}) OR b IN ({named})")
    bi = _folded(met, ["g", "a"], "b").select("g", _stem(F.col("a")).alias("a_stem"), F.col("stem").alias("b_stem"), F.concat_ws(" ", "a", "std").alias("pair"), F.col("n").alias("both"))
    if frequent is not None:
        least = total.join(frequent.where("last").select("g", F.col("n").alias("next")), "g", "left")
        bi = bi.join(F.broadcast(least), "g")
        for side in ("a", "b"):
            bi = bi.join(F.broadcast(frequent.where("NOT last").select("g", F.col("stem").alias(f"{side}_stem"), F.col("n").alias(f"{side}_n"))), ["g", f"{side}_stem"], "left")
        known, n, both = F.coalesce("a_n", "b_n"), F.col("total"), F.col("both")
        other = F.when(F.col("a_n").isNotNull(), F.col("b_n"))
        # in a lambda, as the code generated for the joins with this in them would be too long to be compiled
        reaches = F.exists(F.array("both", F.greatest("both", "next")), lambda x: _at_most(both, known, F.coalesce(other, x), n) > COLLOCATION - 1)
        # pairs of two rare words, of a word with itself; beyond 10^10 words the least share bends the figure
        can = known.isNull() | (F.col("a_stem") == F.col("b_stem")) | (n >= 10**10) | reaches
        bi = bi.where(can).select("g", "a_stem", "b_stem", "pair", "both")
    for side in ("a", "b"):
        bi = bi.join(counts.select("g", F.col("stem").alias(f"{side}_stem"), F.col("std").alias(f"{side}_std"), F.col("n").alias(f"{side}_n")), ["g", f"{side}_stem"])
    found = bi.join(total, "g").where(_log_likelihood(F.col("both"), F.col("a_n"), F.col("b_n"), F.col("total")) > COLLOCATION)
    return materialise(found.select("g", "pair", "both", "a_std", "b_std"), "collocations")


def _shown(counts: DataFrame, together: DataFrame) -> DataFrame:
    """(g, term, n): the words less what their pairs take, and the pairs."""
    less = together.select("g", F.explode(F.array("a_std", "b_std")).alias("std"), "both").groupBy("g", "std").agg(F.sum("both").alias("less"))
    left = counts.join(less, ["g", "std"], "left").select("g", F.col("std").alias("term"), (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")).where("n > 0")
    return left.unionByName(together.select("g", F.col("pair").alias("term"), F.col("both").alias("n")))


def _first(shown: DataFrame, top: int) -> DataFrame:
    return shown.withColumn("__place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "term"))).where(F.col("__place") <= top).drop("__place")


def cloud_terms(pages: DataFrame, group: str | None = None, top: int | None = 100) -> DataFrame:
    """(g, term, n): what a word cloud shows of ``pages(doc_id, page_ord, text)``, most frequent first, ties by term; g is 0 without ``group``.

    Plurals count with their singular where both occur. Two words that follow each other in
    a document, over page ends too, are a term of their own where they do so beyond chance
    (log-likelihood over COLLOCATION), and then count less by themselves; a word of which
    nothing is left is not shown. The words of the texts are written once; words are counted
    from there, and pairs. Null texts have no words.

    With ``top`` pairs are first counted only for the 2 * top most frequent words, whose
    figures are then final, as are those of their pairs. No other word or pair can be shown
    with more than the next word's count. Where that does not settle what is shown, pairs are
    counted once more, for all words that reach the least final count of the ``top`` found so
    far; then nothing left out can be shown. Were these words too many, all pairs are counted.
    """
    said = pages.select((F.col(group) if group else F.lit(0)).alias("g"), "doc_id", "page_ord", _cloud_words(F.col("text")).alias("w"))
    said = materialise(said, "cloud-pages").where(F.size("w") > 0)  # a filter before would split the texts twice
    counts = materialise(_folded(said.select("g", F.explode("w").alias("term")), ["g"], "term"), "cloud-words")
    total = counts.groupBy("g").agg(F.sum("n").alias("total"))
    frequent = _frequent(counts, total)
    shown = None if top is None else _settled(said, counts, total, frequent, top)
    if shown is None:
        shown = _shown(counts, _together(said, counts, total, frequent, None))
        if top is None:
            return shown
    return shown.orderBy(F.desc("n"), "term").limit(top) if group is None else _first(shown, top)


def _settled(said: DataFrame, counts: DataFrame, total: DataFrame, frequent: DataFrame | None, top: int) -> DataFrame | None:
    """Figures among which the ``top`` terms of each group are, or None where that takes all pairs."""
    if frequent is None or frequent.where("last").select(F.min("rank")).first()[0] in range(2 * top + 1):
        return None

    def figures(kept: DataFrame) -> DataFrame:
        of = [x for r in kept.select("stem").distinct().collect() for x in (r.stem, r.stem + "s")]
        return _shown(kept.select("g", "std", "n"), _together(said, counts, total, frequent, of))

    kept = frequent.where(F.col("rank") <= 2 * top)
    shown = materialise(figures(kept), "cloud-shown")
    least = _first(shown, top).groupBy("g").agg(F.when(F.count("*") == top, F.min("n")).alias("least"))
    following = frequent.where(F.col("rank") == 2 * top + 1).select("g", F.col("n").alias("next"))
    least = materialise(kept.select("g").distinct().join(following, "g", "left").join(least, "g", "left"), "cloud-least")
    if least.where("next >= coalesce(least, 0)").isEmpty():
        return shown
    kept = counts.join(F.broadcast(least), "g").where("n >= coalesce(least, 0)").select("g", "stem", "std", "n")
    return None if kept.limit(FREQUENT + 1).count() > FREQUENT else figures(kept)
