"""Benchmark decontamination: texts streamed through a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import filled, lower_ascii, materialise, words_of

#: All but digits, a-z and what lies beyond ASCII separates words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same by bytes of UTF-8: letters lower-cased, separators as blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Item words of one automaton at most about; a larger benchmark is taken in portions, each a pass over the texts.
PORTION_WORDS = 1_000_000
#: Steps that a task remembers.
MEMORY = 1 << 20


@dataclass(frozen=True)
class Limits:
    """A match is a span to be removed from ``words`` words on, or where it covers ``share`` of an item's words.

    A document of which over ``most_hit`` of the words are in such spans is not kept.
    """

    words: int = 10
    share: float = 1.0
    most_hit: float = 0.5


def words_in(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_TABLE).split()


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences, as arrays.

    State 0 is the root. ``keys`` are the sorted transitions (state << 32 | word) and ``to``
    where they lead; ``longest`` and ``link`` are each state's longest string and suffix
    link. ``marks[s]`` are the windows that are strings of state s, as (words, item numbers),
    and ``marked[s]`` is the nearest state with marks from s on along the links, or -1.
    """

    vocabulary: dict[bytes, int]
    keys: np.ndarray
    to: np.ndarray
    longest: np.ndarray
    link: np.ndarray
    marked: np.ndarray
    marks: dict[int, list[tuple[int, tuple[int, ...]]]]
    names: list[str | None]
    pairs: np.ndarray
    shortest: int
    memory: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, word: int) -> int:
        """The state after one more word, or -1."""
        key = state << 32 | word
        found = self.memory.get(key)
        if found is None:
            at = int(np.searchsorted(self.keys, key))
            found = int(self.to[at]) if at < len(self.keys) and self.keys[at] == key else -1
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[key] = found
        return found

    def windows_ending(self, state: int, length: int) -> list[tuple[int, tuple[int, ...]]]:
        """(words, item numbers) of the windows that end a match of ``length`` words in ``state``, longest first."""
        out = []
        state = int(self.marked[state])
        while state >= 0:
            out += [m for m in self.marks[state] if m[0] <= length]
            state = int(self.marked[self.link[state]]) if state else -1
        return out

    def stretches(self, ids: np.ndarray) -> Iterable[tuple[int, int]]:
        """(first, end) of the runs of words in which a window may lie.

        A word that no item has, and a pair of words that does not follow each other in any,
        lead from every state back to a match of one word at most; such runs are cut there.
        """
        known = ids >= 0
        if len(ids) < self.shortest or not known.any():
            return []
        pair = np.flatnonzero(known[1:] & known[:-1])
        value = ids[pair].astype(np.int64) << 32 | ids[pair + 1]
        at = np.searchsorted(self.pairs, value)
        linked = np.zeros(len(ids) + 1, bool)  # linked[i]: word i goes on from word i - 1
        if len(self.pairs):
            linked[pair[self.pairs[np.minimum(at, len(self.pairs) - 1)] == value] + 1] = True
        starts = np.flatnonzero(known & ~linked[:-1])
        ends = np.flatnonzero(known & ~linked[1:]) + 1
        long = ends - starts >= self.shortest
        return zip(starts[long].tolist(), ends[long].tolist(), strict=True)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """([first, end) of the hit words, united and ascending; numbers of the items with an occurring window)."""
        ids = np.fromiter(map(self.vocabulary.get, words, (-1 for _ in words)), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for first, end in self.stretches(ids):
            state = length = 0
            for i in range(first, end):
                word = int(ids[i])
                after = self.step(state, word)
                while after < 0 and state:
                    state = int(self.link[state])
                    length = int(self.longest[state])
                    after = self.step(state, word)
                state, length = (after, length + 1) if after >= 0 else (0, 0)
                if length < self.shortest:
                    continue
                ending = self.windows_ending(state, length)
                if ending:
                    for _, numbers in ending:
                        items.update(numbers)
                    begin = i + 1 - max(k for k, _ in ending)
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i + 1))
        return spans, items


def build(items: list[tuple[str | None, list[bytes]]], limits: Limits) -> Automaton:
    """The automaton of ``items`` (name, words); equal names are one item.

    An item's windows are all its runs of ``limits.words`` words, or of as many as cover its
    share if these are fewer; each is marked at the state that has it.
    """
    vocabulary: dict[bytes, int] = {}
    texts = [(name, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for name, words in items if words]
    numbers: dict[str | None, int] = {}
    steps: list[dict[int, int]] = [{}]
    longest, link = [0], [-1]

    def extend(last: int, word: int) -> int:
        if word in steps[last]:
            target = steps[last][word]
            return target if longest[target] == longest[last] + 1 else clone(last, word, target)
        new = len(steps)
        steps.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in steps[at]:
            steps[at][word] = new
            at = link[at]
        if at >= 0:
            target = steps[at][word]
            link[new] = target if longest[target] == longest[at] + 1 else clone(at, word, target)
        return new

    def clone(at: int, word: int, target: int) -> int:
        """Splits off the strings of ``target`` that are no longer than one word after ``at``."""
        copy = len(steps)
        steps.append(dict(steps[target]))
        longest.append(longest[at] + 1)
        link.append(link[target])
        link[target] = copy
        while at >= 0 and steps[at].get(word) == target:
            steps[at][word] = copy
            at = link[at]
        return copy

    for _, ids in texts:
        last = 0
        for word in ids:
            last = extend(last, word)
    found: dict[tuple[int, int], set[int]] = {}
    shortest = limits.words
    for name, ids in texts:
        k = min(limits.words, max(1, -int(-limits.share * len(ids) // 1)))
        shortest = min(shortest, k)
        state = 0
        for i, word in enumerate(ids):
            state = steps[state][word]
            if i + 1 >= k:
                at = state
                while longest[link[at]] >= k:
                    at = link[at]
                found.setdefault((at, k), set()).add(numbers.setdefault(name, len(numbers)))
                state = at  # which goes on with the item's next word too
    marks: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for (at, k), some in sorted(found.items(), key=lambda x: -x[0][1]):
        marks.setdefault(at, []).append((k, tuple(sorted(some))))
    marked = np.full(len(steps), -1, np.int64)
    for s in sorted(range(len(steps)), key=longest.__getitem__):
        marked[s] = s if s in marks else marked[link[s]] if s else -1
    keys = np.fromiter((s << 32 | w for s, out in enumerate(steps) for w in out), np.int64)
    to = np.fromiter((t for out in steps for t in out.values()), np.int64)
    order = np.argsort(keys)
    pairs = np.unique(np.array([a << 32 | b for _, ids in texts for a, b in zip(ids, ids[1:], strict=False)], np.int64))
    return Automaton(vocabulary, keys[order], to[order], np.array(longest), np.maximum(np.array(link), 0), marked, marks, list(numbers), pairs, shortest)


def portions(items: DataFrame, limits: Limits, item_col: str, text_col: str) -> Iterable[Automaton]:
    """Automata of the items, each of about PORTION_WORDS words, one after another; none without words.

    The words are counted first; items are dealt by a hash, and the driver holds those of one
    portion.
    """
    words = F.size(words_of(lower_ascii(filled(F.col(text_col))), SEPARATOR))
    listed = materialise(items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"), words.alias("n")).where("n > 0").distinct(), "items")
    total = listed.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // PORTION_WORDS)
    for part in range(parts):
        some = listed.where(F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(parts)) == part).collect()
        yield build(sorted(((r.item, words_in(r.text.encode())) for r in some), key=lambda x: (x[0] is None, x)), limits)


def _places(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as [first, end) code points of the text."""
    ends = [m.span() for m in _WORD.finditer(data)]
    cut = [(ends[a][0], ends[b - 1][1]) for a, b in spans]
    out, at, chars = [], 0, 0
    for a, b in cut:
        chars += len(data[at:a].decode())
        out.append((chars, chars + len(data[a:b].decode())))
        at, chars = b, out[-1][1]
    return out


def matches(text: Column, automaton: Automaton, docs: DataFrame) -> Column:
    """STRUCT<n_words, words, chars, items> of a text: hit spans by words and by code points, and the items' names."""
    sent = docs.sparkSession.sparkContext.broadcast(automaton)

    @F.pandas_udf("struct<n_words: long, words: array<struct<first: long, last: long>>, chars: array<struct<first: long, last: long>>, items: array<string>>")
    def of(data: pd.Series) -> pd.DataFrame:
        a, rows = sent.value, []
        for x in data:
            words = words_in(x)
            spans, items = a.scan(words)
            rows.append((len(words), spans, _places(x, spans) if spans else [], [a.names[i] for i in items]))
        pairs = lambda some: [{"first": p, "last": q} for p, q in some]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "words": [pairs(r[1]) for r in rows], "chars": [pairs(r[2]) for r in rows], "items": [r[3] for r in rows]})

    return of(text.cast("binary"))


def _united(spans: Column) -> Column:
    """Spans [first, last), sorted and those that touch or overlap put together."""
    empty = F.array().cast("array<struct<first: bigint, last: bigint>>")

    def step(done: Column, x: Column) -> Column:
        top = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= x["first"]), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(spans), empty, step)


def scan(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with __found: STRUCT<n_words, words, chars, items> over all items, spans united, items different."""
    found = None
    for automaton in portions(items, limits, item_col, item_text_col):
        if found is not None:  # one automaton at a time in a task's memory
            docs = materialise(docs, "portion")
        now = docs.withColumn("__now", matches(F.col(text_col), automaton, docs))
        if found is None:
            docs = now.withColumnRenamed("__now", "__found")
        else:
            both = lambda c: _united(F.concat(f"__found.{c}", f"__now.{c}"))
            whole = F.struct(F.col("__found.n_words"), both("words").alias("words"), both("chars").alias("chars"), F.array_union("__found.items", "__now.items").alias("items"))
            docs = now.withColumn("__found", whole).drop("__now")
        found = docs
    if found is not None:
        return found
    spans = F.array().cast("array<struct<first: bigint, last: bigint>>")
    words = F.size(words_of(lower_ascii(filled(F.col(text_col))), SEPARATOR)).cast("long")
    return docs.withColumn("__found", F.struct(words.alias("n_words"), spans.alias("words"), spans.alias("chars"), F.array().cast("array<string>").alias("items")))


def decontaminate(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, items, spans, clean_text and kept.

    A word is hit inside any occurrence of an item's window (see ``Limits``); spans are the
    hit stretches as [first, last) code points, clean_text is the text without them, items
    the names, sorted, of those with an occurring window. kept is false where over
    ``most_hit`` of the words are hit. Null and empty texts, also of items, have no words and
    are kept; without items all texts stay as they are. Hits of an item with a null name
    count, its name is not listed. Repeated rows each have a row; no row is moved. Columns
    of these names are replaced.
    """
    new = ["n_words", "n_hit", "items", "spans", "clean_text", "kept"]
    found = scan(docs, items, limits, text_col, item_col, item_text_col)
    f = F.col("__found")
    n_hit = F.aggregate(f["words"], F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    text, spans = F.col(text_col), f["chars"]
    gap = lambda s, i: F.substring(text, (s["last"] + 1).cast("int"), (F.coalesce(F.get(spans, i + 1)["first"], F.length(text).cast("long")) - s["last"]).cast("int"))
    rest = F.concat(F.substring(text, F.lit(1), F.get(spans, F.lit(0))["first"].cast("int")), F.array_join(F.transform(spans, gap), ""))
    names = F.sort_array(F.array_compact(f["items"]))
    return found.select(
        *[F.col(c) for c in docs.columns if c not in new], f["n_words"].alias("n_words"), n_hit.alias("n_hit"), names.alias("items"), spans.alias("spans"),
        F.when(F.size(spans) > 0, rest).otherwise(text).alias("clean_text"), (n_hit <= limits.most_hit * f["n_words"]).alias("kept"),
    )
