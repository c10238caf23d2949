"""License scans: rolling word k-grams voted onto template diagonals, then verified word by word."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import filled, join_on, let, lower_ascii, materialise, text_key, words_of

#: All but digits, a-z and what lies beyond ASCII separates words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Label and words of each base phrase, then of each longer template.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)


@dataclass(frozen=True)
class ScanRules:
    """Words of a k-gram for templates, drift of neighbouring diagonals merged, share of template words that verifies a span."""

    k: int = 4
    drift: int = 3
    least_share: float = 0.6


#: Template grams for which a table of so many slots holds which hash remainders occur; beyond, all grams are joined.
FEW_GRAMS, SLOTS = 2048, 1 << 15
#: Template grams that are broadcast at most, a few hundred bytes each.
BROADCAST_GRAMS = 100_000


def _grams(words: Column, k: int) -> Column:
    """The hash of the k words from each position on."""
    hashed = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), hashed)).otherwise(F.array().cast("array<bigint>"))


def base_templates(spark: SparkSession) -> DataFrame:
    """(name, label, text, phrase) of the phrases and templates of this module."""
    rows = [(f"{n:03d}", label, text, n < len(PHRASES)) for n, (label, text) in enumerate((*PHRASES, *TEMPLATES))]
    return spark.createDataFrame(rows, "name string, label string, text string, phrase boolean")


def template_grams(templates: DataFrame, rules: ScanRules) -> DataFrame:
    """(template, label, phrase, length, k, tpos, gram, gwords): one row for each position of each template ``(name, label, text, phrase)``.

    Phrases have grams of two words, others of ``rules.k``; templates of fewer words have none.
    """
    words = words_of(lower_ascii(filled(F.col("text"))), SEPARATOR)
    listed = templates.select(F.col("name").alias("template"), "label", F.coalesce("phrase", F.lit(False)).alias("phrase"), words.alias("words"))
    listed = listed.withColumn("k", F.when(F.col("phrase"), 2).otherwise(rules.k)).withColumn("length", F.size("words"))
    grams = F.when(F.col("phrase"), _grams(F.col("words"), 2)).otherwise(_grams(F.col("words"), rules.k))
    spread = listed.select("*", F.posexplode(grams).alias("tpos", "gram"))
    return spread.select("template", "label", "phrase", "length", "k", "tpos", "gram", F.slice("words", F.col("tpos") + 1, F.col("k")).alias("gwords"))


def _candidates(docs: DataFrame, grams: DataFrame, rules: ScanRules, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tk, k, pos, gram, gwords): the rolling grams of the texts that may be a template's.

    Where the templates are few, only grams whose hash has the remainder of a template's are
    made into rows; this loses none.
    """
    few = grams.select("gram").distinct().limit(FEW_GRAMS + 1).collect()
    slots = ["0"] * SLOTS
    for r in few:
        slots[r.gram % SLOTS] = "1"
    marked = F.split(F.lit(",".join(slots)), ",").cast("array<tinyint>")  # folded to one constant
    seen = (lambda g: F.get(marked, F.pmod(g, F.lit(SLOTS)).cast("int")) == 1) if len(few) <= FEW_GRAMS else (lambda g: F.lit(True))

    def found(w: Column, k: int) -> Column:
        placed = F.transform(_grams(w, k), lambda g, i: F.when(seen(g), F.struct(i.alias("pos"), g.alias("gram"))))
        return F.transform(F.array_compact(placed), lambda x: F.struct(F.lit(k).alias("k"), x["pos"].alias("pos"), x["gram"].alias("gram"), F.slice(w, x["pos"] + 1, k).alias("gwords")))

    words = words_of(lower_ascii(filled(F.col(text_col))), SEPARATOR)
    every = let(words, lambda w: F.concat(found(w, 2), found(w, rules.k)) if rules.k != 2 else found(w, 2))
    return docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tk"), F.explode(every).alias("x")).select("doc_id", "tk", "x.*")


def scan(docs: DataFrame, rules: ScanRules = ScanRules(), templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans: (doc_id, tk, template, label, phrase, first, last, share) with word positions from 0.

    The hashes of the rolling k-grams of every text meet those of the templates in a join,
    which also compares the words themselves: every vote is verified word by word. Votes are
    counted by diagonal (text position minus template position), as sets, so rows equal in id
    and text give each span once. A phrase is found where all its grams vote for one
    diagonal. For a longer template, diagonals within ``drift`` of each other are merged and
    a span stands if it covers ``least_share`` of the template's words.

    ``templates(name, label, text, phrase)`` are the caller's; without, this module's. Their
    grams are broadcast up to BROADCAST_GRAMS and joined by a shuffle beyond.
    """
    spark = docs.sparkSession
    grams = materialise(template_grams(base_templates(spark) if templates is None else templates, rules), "template-grams")
    rolled = _candidates(docs, grams, rules, id_col, text_col)
    hits = rolled.join(F.broadcast(grams) if grams.count() <= BROADCAST_GRAMS else grams, ["k", "gram", "gwords"])
    diagonal = (F.col("pos") - F.col("tpos")).alias("diagonal")
    votes = hits.groupBy("doc_id", "tk", "template", "label", "phrase", "length", "k", diagonal).agg(F.collect_set("tpos").alias("tposes"))
    votes = materialise(votes, "votes")  # read twice below, and far fewer rows than words
    exact = votes.where(F.col("phrase") & (F.size("tposes") == F.col("length") - F.col("k") + 1))
    exact = exact.select("doc_id", "tk", "template", "label", F.lit(True).alias("phrase"), F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("length") - 1).alias("last"), F.lit(1.0).alias("share"))
    long = votes.where(~F.col("phrase")).groupBy("doc_id", "tk", "template", "label", "length", "k")
    long = long.agg(F.sort_array(F.collect_list(F.struct("diagonal", "tposes"))).alias("all"))
    lead = F.transform(F.col("all"), lambda d, i: F.when((i == 0) | (d["diagonal"] - F.get(F.col("all"), i - 1)["diagonal"] > rules.drift), i))
    starts = let(F.filter(lead, lambda i: i.isNotNull()), lambda at: F.transform(at, lambda i, j: F.slice(F.col("all"), i + 1, F.coalesce(F.get(at, j + 1), F.size("all")) - i)))
    merged = long.select("*", F.explode(starts).alias("band"))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(F.col("band"), lambda d: d["tposes"])), lambda p: F.sequence(p, p + F.col("k") - 1))))
    seen = F.flatten(F.transform(F.col("band"), lambda d: F.transform(d["tposes"], lambda p: p + d["diagonal"])))
    verified = merged.select(
        "doc_id", "tk", "template", "label", F.lit(False).alias("phrase"), F.array_min(seen).alias("first"), (F.array_max(seen) + F.col("k") - 1).alias("last"), (F.size(covered) / F.col("length")).alias("share")
    ).where(F.col("share") >= rules.least_share)
    return exact.union(verified)


def scan_documents(docs: DataFrame, rules: ScanRules = ScanRules(), templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of base phrases, first_word and last_word are the smallest and
    largest start among them (null without). score is the largest verified share of a
    template, 0.0 without any. Null and empty texts have no words and no labels ("").
    """
    found = scan(docs, rules, templates, id_col, text_col)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("phrase")
    per_doc = found.groupBy("doc_id", "tk").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"), F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "share"))).alias("spans"),
    )
    words = words_of(lower_ascii(filled(F.col(text_col))), SEPARATOR)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tk"), F.size(words).cast("long").alias("n_words"))
    joined = join_on(rows, per_doc, ["doc_id", "tk"], "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
