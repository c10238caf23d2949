"""Language ID by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import text_slices

#: Letters kept apart; the others share the codes above by their code point.
CODES = 96
UNKNOWN = "und"
#: Characters bundled at a time.
BATCH_CHARS = 1 << 20


@dataclass(frozen=True)
class Profile:
    """The vector space. Equal settings give equal vectors on every machine."""

    dim: int = 512
    n: int = 3
    seed: int = 20_011
    #: Documents of each language that the prototypes are bundled from, about; a hash picks them.
    train_docs: int = 4000


@cache
def _code_table() -> np.ndarray:
    """Code of each code point: 0 for what is no letter, 1 to 26 for a-z, then the rest by remainder."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            table[point] = point - 96 if 97 <= point <= 122 else 27 + point % (CODES - 27)
    return table


@cache
def _letters(profile: Profile) -> np.ndarray:
    """(n, CODES, dim): the random +-1 vector of each letter, permuted once more for each step from the n-gram's end."""
    base = np.random.default_rng(profile.seed).choice(np.array([-1, 1], np.int8), (CODES, profile.dim))
    return np.stack([np.roll(base, profile.n - 1 - k, axis=1) for k in range(profile.n)])


def _codes(text: str | None) -> np.ndarray:
    """The letter codes of one text, runs of other characters as one 0, with a 0 at both ends; empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.concatenate([[0], _code_table()[points], [0]]).astype(np.int64)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    return codes if codes.any() else codes[:0]


def document_vectors(texts: list, profile: Profile) -> np.ndarray:
    """One row for each text: the sum of its n-gram vectors; zero without a letter.

    An n-gram's vector is the product of its letters' permuted vectors. The n-grams of a
    batch are bound once each and bundled by their counts in each text.
    """
    n, size = profile.n, CODES**profile.n
    power = CODES ** np.arange(n - 1, -1, -1)
    grams = []
    for text in texts:
        codes = _codes(text)
        m = max(0, len(codes) - n + 1)
        grams.append(sum((codes[k : k + m] * power[k] for k in range(n)), np.zeros(m, np.int64)))
    every = np.concatenate(grams) if grams else np.zeros(0, np.int64)
    seen = np.zeros(size, bool)
    seen[every] = True
    used = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    letters = _letters(profile)
    bound = np.ones((len(used), profile.dim), np.int8)
    for k in range(n):
        bound *= letters[k][used // power[k] % CODES]
    bound = bound.astype(np.float32)
    out = np.zeros((len(texts), profile.dim), np.float32)
    for row, g in enumerate(grams):
        if len(g):
            found, counts = np.unique(place[g], return_counts=True)
            out[row] = counts.astype(np.float32) @ bound[found]
    return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id, which is never learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, profile: Profile = Profile(), lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes): a row for each non-null label of ``docs`` that has a text with a letter.

    About ``train_docs`` documents of each label, picked by a hash of id and text, are
    bundled: each partition sums unit document vectors by label and the sums are added.
    Repeated rows are picked or passed over together and count each. A label of which no
    picked text has a letter is learned from its text with letters of the least hash. Labels
    are languages: one figure and one vector for each come to the driver.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), key.alias("key"))
    # One figure for each label, as few as the prototypes; as a literal it needs no join, which would deal texts by language.
    shares = {r.lang: min(1.0, profile.train_docs / r.n) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return [], np.zeros((0, profile.dim))
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    picked = labelled.where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, texts in text_slices(batch.column(1), BATCH_CHARS, 128):
                vectors = document_vectors(texts, profile)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                for lang, v in zip(batch.column(0).slice(at, len(texts)).to_pylist(), vectors / np.maximum(norms, 1e-9), strict=True):
                    total[lang] = total.get(lang, 0) + v
        langs = list(total)
        vectors = [total[x].astype(float).tolist() for x in langs]
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], ["lang", "v"])

    def bundled(texts: DataFrame) -> dict[str, np.ndarray]:
        part = texts.mapInArrow(bundle, "lang string, v array<double>")
        summed = part.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
        rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.transform("v", lambda s: s["x"]).alias("v")).collect()
        return {r.lang: np.array(r.v) for r in rows if np.any(r.v)}

    kept = bundled(picked)
    missing = [x for x in shares if x not in kept]
    if missing:
        lettered = labelled.where(F.col("lang").isin(missing) & F.col("text").rlike(r"\p{L}"))
        kept |= bundled(lettered.groupBy("lang").agg(F.min_by("text", "key").alias("text")))
    if not kept:
        return [], np.zeros((0, profile.dim))
    languages = sorted(kept)
    return languages, np.stack([kept[x] / np.linalg.norm(kept[x]) for x in languages])


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, profile: Profile = Profile(), text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the cosine with the best prototype (0 to 1).

    A text that is null or has no letter, and every text where there is no prototype, is
    ``und`` with score 0. Ties go to the first language by name. The prototypes, one vector
    for each language, travel with the tasks. Texts are read whole, a very long one by itself,
    and repeated rows get the same result. Columns of these names are replaced.
    """
    new = ["lang_pred", "score"]
    kept = docs.drop(*new)
    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    where = kept.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, texts in text_slices(batch.column(where), BATCH_CHARS, 128):
                vectors = document_vectors(texts, profile)
                norms = np.linalg.norm(vectors, axis=1)
                if not languages:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                cosines = (vectors / np.maximum(norms, 1e-9)[:, None]) @ prototypes.T
                for best, row, norm in zip(cosines.argmax(axis=1), cosines, norms, strict=True):
                    names.append(languages[best] if norm else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, row[best]))) if norm else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *new])

    return kept.mapInArrow(label, schema)


def identify(docs: DataFrame, profile: Profile = Profile(), id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, lang_pred and score, learned from the rows that are not held out.

    Rows with a null id or label are never learned from.
    """
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    languages, prototypes = train(known, profile, lang_col, text_col, id_col)
    return predict(docs.withColumn("held_out", held_out(F.col(id_col))), languages, prototypes, profile, text_col)
