"""Byte-pair encoding by backtracking over longest matches, decoding by an offset table."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioforge.llm.common import text_slices

#: Words remembered in each of two generations; about 150 bytes each.
REMEMBERED = 100_000
#: Longer pieces are not remembered.
LONGEST = 64
#: Characters encoded before a batch of rows is handed on.
BATCH_CHARS = 2 << 20
#: Pairs whose compatibility is remembered.
PAIRS = 1 << 17


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeTable:
    """Tokens of a vocabulary of merges, as strings of symbols.

    A symbol is one character. Where the vocabulary marks the ends of words, the last
    character of a word is another symbol than the same character elsewhere: its code point
    is raised by ``END``.
    """

    END = 0x10000

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.suffix = suffix
        self.ids = {self._symbols(t): i for t, i in vocab.items()}
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for r, (a, b) in enumerate(pairs):
            left, right = self._symbols(a), self._symbols(b)
            self.rank.setdefault((left, right), r)
            self.parts.setdefault(left + right, (left, right, r))
        self.compatible: dict[tuple[str, str], bool] = {}
        self.matcher = ahocorasick.Automaton()
        self.whole: dict[str, bool] = {}
        for token in sorted(self.ids, key=len):
            if self._stands(token):
                self.matcher.add_word(token, token)
        self.shorter = {t: self._longest_prefix(t) for t in self.matcher.keys()}
        self.matcher.make_automaton()

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + self.END)
        return token

    def _stands(self, token: str) -> bool:
        """Whether the merges of a token's own symbols end in the token."""
        if len(token) > 1 and token in self.parts:
            left, right, _ = self.parts[token]
            ok = self.whole.get(left, False) and self.whole.get(right, False) and self.fits(left, right, self.rank[left, right])
        else:
            ok = len(token) == 1
        self.whole[token] = ok
        return ok

    def _longest_prefix(self, token: str) -> str | None:
        for end in range(len(token) - 1, 0, -1):
            if self.whole.get(token[:end]):
                return token[:end]
        return None

    def fits(self, left: str, right: str, below: int | None = None) -> bool:
        """Whether no merge across the border comes before those that make the two tokens (nor before ``below``).

        The two tokens are taken apart again, last merge first. Whenever the parts at the
        border can merge, that merge must come after the one just undone. Ties between
        equal merges go to the left, as encoding goes from left to right.
        """
        limit = float("inf") if below is None else below
        while True:
            joined = self.rank.get((left, right))
            if joined is not None and joined < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                limit, left = min(limit, a[2]), a[1]
            else:
                limit, right = min(limit, b[2] + 0.5), b[0]

    def pair(self, left: str, right: str) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self.fits(left, right)
        return known

    def encode(self, symbols: str) -> list[int]:
        """The ids that the merges give a word. Every symbol must be in the vocabulary."""
        longest: list[str | None] = [None] * len(symbols)
        for end, token in self.matcher.iter(symbols):  # ends grow, so the longest from a place comes last
            longest[end - len(token) + 1] = token
        tokens: list[str] = []
        dead = set()
        at, candidate = 0, longest[0] if symbols else None
        while at < len(symbols) or candidate is not None:
            if candidate is None:
                if not tokens:
                    raise ValueError("a symbol is not in the vocabulary")
                dead.add(at)
                candidate = tokens.pop()
                at -= len(candidate)
                candidate = self.shorter[candidate]
                continue
            end = at + len(candidate)
            if end not in dead and (not tokens or self.pair(tokens[-1], candidate)):
                tokens.append(candidate)
                at = end
                candidate = longest[at] if at < len(symbols) else None
                if at == len(symbols):
                    break
            else:
                candidate = self.shorter[candidate]
        return [self.ids[t] for t in tokens]


class WordTokenizer:
    """Encodes texts with a vocabulary file of lower-cased words.

    Reads the file's settings and refuses those it does not know, so that a file of another
    kind is an error and not another result.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        kinds = [n["type"] for n in made["normalizer"]["normalizers"]]
        split, bytes_ = made["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] is None or split["type"] != "Split" or bytes_["use_regex"] or made["decoder"]:
            raise ValueError(f"{path} is no vocabulary of lower-cased words")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.merges = MergeTable(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.letters = byte_letters()
        self.young: dict[str, array] = {}
        self.old: dict[str, array] = {}

    def _piece(self, piece: str) -> array:
        """Ids of one piece of the pattern."""
        letters = "".join([self.letters[b] for b in piece.encode()])
        return array("i", self.merges.encode(letters[:-1] + chr(ord(letters[-1]) + MergeTable.END)))

    def _remembered(self, key: str, make: Callable[[str], array]) -> array:
        ids = self.young.get(key)
        if ids is None:
            ids = self.old.get(key)
            if ids is None:
                ids = make(key)
            if len(key) < LONGEST:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[key] = ids
        return ids

    def _chunk(self, chunk: str) -> array:
        """Ids of what stands between two blanks: no piece of the pattern holds a blank."""
        pieces = self.pattern.findall(chunk)
        if pieces == [chunk]:
            return self._piece(chunk)
        ids = array("i")
        for piece in pieces:
            ids += self._remembered(piece, self._piece)
        return ids

    def encode_into(self, text: str | None, out: array) -> None:
        """Appends the ids of one text, as the tokenizers library gives them without special tokens added; null has none."""
        for part in self.cut.split(text) if text and "<|" in text else (text or "",):
            if part in self.special:
                out.append(self.special[part])
                continue
            for chunk in blank_split(lowered(part)):
                out += self.young.get(chunk) or self._remembered(chunk, self._chunk)

    def encode(self, text: str | None) -> list[int]:
        self.encode_into(text, out := array("i"))
        return out.tolist()


class OffsetTable:
    """Decodes ids: the bytes of all tokens in one table, each id's by its offsets. Holds no merges, so it is small."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        if made["decoder"]:
            raise ValueError(f"{path} joins tokens in another way than by blanks")
        names = {i: t for t, i in made["model"]["vocab"].items()} | {t["id"]: t["content"] for t in made["added_tokens"]}
        raw = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.table = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.cumsum([0, *map(len, raw)])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens joined by blanks, gathered from one table by offsets."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.table[index].tobytes()[:-1]


#: Python splits at these too, the vocabulary's pattern does not.
_NO_BLANKS = re.compile("[\x1c-\x1f]")
_BLANKS = regex.compile(r"\p{White_Space}+")


def blank_split(text: str) -> list[str]:
    return [x for x in _BLANKS.split(text) if x] if _NO_BLANKS.search(text) else text.split()


def lowered(text: str) -> str:
    """NFC, then each character lower-cased by itself (a final sigma is no exception)."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if text.isascii() or "Σ" not in text else "".join(c.lower() for c in text)


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@cache
def offset_table(path: str) -> OffsetTable:
    return OffsetTable(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """``docs`` with ids (ARRAY<INT>), the tokens of the whole text; null and empty texts have none.

    ``with_decoded`` adds decoded, the text that the ids decode to, in the same task: a second
    pass of the ids through other workers would double their number. ``path`` is the
    vocabulary file, at the same place on every executor. Columns of these names are replaced.
    """
    new = ["ids", "decoded"] if with_decoded else ["ids"]
    kept = docs.drop(*new)
    where = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            for at, some in text_slices(batch.column(where), BATCH_CHARS):
                flat, offsets = array("i"), [0]
                for text in some:
                    coder.encode_into(text, flat)
                    offsets.append(len(flat))
                ids = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))]
                if with_decoded:
                    made.append(_decoded(offset_table(path), ids, offsets))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(some)).columns, *made], [*batch.schema.names, *new])

    return kept.mapInArrow(run, ", ".join([_ddl(kept), "ids array<int>", *["decoded string"] * with_decoded]))


def _decoded(table: OffsetTable, ids: np.ndarray, offsets: Iterable[int]) -> pa.Array:
    offsets = list(offsets)
    return pa.array([table.decode(ids[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary()).cast(pa.string())


def decode(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with decoded, the text of their ids; null ids give an empty text. A column named decoded is replaced."""
    kept = docs.drop("decoded")
    where = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = offset_table(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(where)
                texts = _decoded(coder, ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, f"{_ddl(kept)}, decoded string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
