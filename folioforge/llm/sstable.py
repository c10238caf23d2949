"""Token ids in sorted-string-table shards: written in key order, read back by scan or by binary search."""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.bpe import byte_letters
from folioforge.llm.common import materialise, new_path, text_key

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAGIC = b"FFSST001"
#: Offsets and lengths of index and Bloom filter, documents, ids, bytes of an id, Bloom hashes, magic.
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Bytes of each of two generations of remembered pieces, about, what a dict takes for an entry, and the longest piece kept.
MEMORY_BYTES, ENTRY, LONGEST = 40 << 20, 100, 64
#: Code points up to here are letters, digits or neither in every Unicode version.
SETTLED = 0x24F
#: Fixed value: the pieces that byte-level merges never cross.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes in the order of the ids, nulls first."""
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, (h >> 64) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """One shard: blocks of entries (shared key length, rest of the key, ids), then block index, Bloom filter, footer.

    A block's keys are stored as their difference to the key before; the block is compressed.
    The index has one entry for each block: first key, offset, length, ids before it.
    """

    def __init__(self, out, id_bytes: int):
        self.out, self.kind = out, np.dtype(f"<u{id_bytes}")
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self.at = self.n_docs = self.n_ids = 0
        self.block, self.index, self.keys = bytearray(), [], []
        self.last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.index.append([key, self.at, 0, self.n_ids])
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids.astype(self.kind).tobytes()
        self.last = key
        self.keys.append(xxhash.xxh3_128_intdigest(key))
        self.n_docs += 1
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.squeeze.compress(bytes(self.block))
            self.out.write(data)
            self.index[-1][2] = len(data)
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQQ", o, n, i) for k, o, n, i in self.index)
        bits = max(64, self.n_docs * BLOOM_BITS)
        filled = np.zeros(-(-bits // 8) * 8, bool)
        for h in self.keys:
            a, b = h & (1 << 64) - 1, (h >> 64) | 1
            for i in range(BLOOM_HASHES):
                filled[(a + i * b) % bits] = True
        bloom = struct.pack("<Q", bits) + np.packbits(filled).tobytes()
        index_at = self.at
        self.out.write(index + bloom + FOOTER.pack(index_at, len(index), index_at + len(index), len(bloom), self.n_docs, self.n_ids, self.kind.itemsize, BLOOM_HASHES, MAGIC))
        self.out.close()


class ShardReader:
    """Reads a shard by parts: footer and index at once, the Bloom filter and blocks when asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.index_at, index_len, self.bloom_at, self.bloom_len, self.n_docs, self.n_ids, width, self.hashes, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.kind = np.dtype(f"<u{width}")
        self.first, self.blocks = [], []
        data, at = self._read(self.index_at, index_len), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            self.first.append(data[at : at + n])
            self.blocks.append(struct.unpack_from("<QQQ", data, at + n))
            at += n + 24

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def may_hold(self, key: bytes) -> bool:
        data = self._read(self.bloom_at, self.bloom_len)
        (bits,) = struct.unpack_from("<Q", data)
        return all(data[8 + p // 8] >> (7 - p % 8) & 1 for p in _bloom_places(key, bits, self.hashes))

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, n, _ = self.blocks[k]
        data, pos, key = zstandard.ZstdDecompressor().decompress(self._read(at, n)), 0, b""
        while pos < len(data):
            shared, pos = _read_varint(data, pos)
            rest, pos = _read_varint(data, pos)
            n_ids, pos = _read_varint(data, pos)
            key = key[:shared] + data[pos : pos + rest]
            pos += rest
            yield key, np.frombuffer(data, self.kind, n_ids, pos)
            pos += n_ids * self.kind.itemsize

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def find(self, key: bytes) -> list[np.ndarray]:
        """The id arrays of all entries with this key, by binary search in the index."""
        if not self.may_hold(key):
            return []
        found, k = [], max(0, bisect.bisect_left(self.first, key) - 1)
        while k < len(self.blocks) and self.first[k] <= key:
            found += [ids for have, ids in self.block(k) if have == key]
            k += 1
        return found


class Memory(dict):
    """What ``make`` gives for recent short keys, in two generations of about ``MEMORY_BYTES`` each."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            if self.held >= MEMORY_BYTES:
                self.old, self.held = self.copy(), 0
                self.clear()
            self[key] = found
            self.held += getsizeof(key) + getsizeof(found) + ENTRY
        return found


def _piece_pattern() -> re.Pattern:
    """PIECES with the classes of code points up to ``SETTLED`` written out; a piece of letters, the most frequent one, is tried first."""

    def members(kind: str) -> str:
        runs: list[list[int]] = []
        for point in range(SETTLED + 1):
            if regex.match(kind, chr(point)):
                if runs and runs[-1][1] == point - 1:
                    runs[-1][1] = point
                else:
                    runs.append([point, point])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\p{White_Space}")
    return re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class PieceEncoder:
    """Ids from the tokenizers library, whose model is asked once for each recent piece of text.

    Texts are cut into the pieces that merges never cross, by the classes of letters up to
    U+024F, which no Unicode version changes. Of a text with others, the chunks between
    single blanks that hold them go to the library whole: the pattern never joins a blank to
    what stands before it. So does a text that holds an added token of the vocabulary, and
    every text where the vocabulary file is of another kind than byte-level merges with this
    pattern and no normaliser.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.id_bytes = 2 if self.coder.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.id_bytes}")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, split = made["model"], made["pre_tokenizer"] or {}
        self.known = (
            made["normalizer"] is None and model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        )
        self.added = [t["content"] for t in made["added_tokens"]]
        self.model, self.letters = self.coder.model, dict(enumerate(byte_letters()))
        self.find = _piece_pattern().findall
        self.unsettled = re.compile(f"[^\0-{chr(SETTLED)}]").search
        self.cut = re.compile(r"(?<=\S)(?= \S)").split
        self.pieces, self.chunks = Memory(self._piece), Memory(self._library)

    def _library(self, text: str) -> bytes:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], self.kind).tobytes()

    def _settled(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian integers of ``id_bytes``; null has none."""
        if not text:
            return b""
        if not self.known or any(t in text for t in self.added):
            return self._library(text)
        if text.isascii() or not self.unsettled(text):
            return self._settled(text)
        return b"".join([self.chunks[c] if self.unsettled(c) else self._settled(c) for c in self.cut(text)])


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@dataclass(frozen=True)
class Shards:
    """Where shards lie and which ones count: folder, and a table (shard, path, first_id, last_id, n_docs, n_ids, start)."""

    folder: str
    manifest: DataFrame


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Shards:
    """Encode every text, add ``end_id`` to each, and write the ids in shards of ascending id.

    Rows are range-partitioned and sorted by id, nulls first, and by a hash of the text, so
    that an id which many rows share is spread over tasks too; each task writes its range as
    shards of about ``shard_bytes``. A task's files carry its attempt number and only those of
    attempts that came to their end are in the manifest, so a task may be run again at any
    time. Null and empty texts hold only the end id. Repeated rows are all written.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("tk"))
    ranged = narrow.repartitionByRange("doc_id", "tk").sortWithinPartitions("doc_id", "tk").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        kind = np.dtype(f"<u{coder.id_bytes}")
        end = np.array([end_id], kind).tobytes()
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, writer, name, first, last, part = [], None, "", None, None, 0

        def close() -> None:
            writer.close()
            done.append((task.partitionId(), part, name, first, last, writer.n_docs, writer.n_ids))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is not None and writer.at + len(writer.block) >= shard_bytes:
                    close()
                    writer, part = None, part + 1
                if writer is None:
                    name = f"{task.partitionId():06d}-{part:05d}-{task.taskAttemptId()}.sst"
                    writer, first = ShardWriter(store.open_output_stream(f"{root}/{name}"), coder.id_bytes), doc
                writer.add(key_of(doc), np.frombuffer(coder.encode(text.as_py()) + end, kind))
                first, last = doc if first is None else first, doc  # the range of lookups leaves null ids out
        if writer is not None:
            close()
        columns = list(zip(*done, strict=True)) if done else [()] * 7
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["range", "part", "name", "first_id", "last_id", "n_docs", "n_ids"])

    manifest = materialise(ranged.mapInArrow(run, "range int, part int, name string, first_id long, last_id long, n_docs long, n_ids long"), "manifest")
    order = Window.orderBy("range", "part")  # one row for each shard, not for each document
    before = F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return Shards(folder, manifest.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))))


def read(shards: Shards, spark: SparkSession) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts the ids before it."""
    folder = shards.folder
    listed = shards.manifest.select("name", "start")
    listed = listed.repartition(max(1, listed.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with store.open_input_file(f"{root}/{name}") as source:
                    for key, ids in ShardReader(source):
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: Shards, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted ids that are stored; ids in no shard give no row.

    Each wanted id meets the shards whose range holds it; there the Bloom filter, the block
    index and one block are read. Quantiles of the shards' first ids cut the ids into about
    as many sections as each has shards, so that ids and shards are joined by section.
    Shards follow each other, so few are in more than one. Null ids are not looked up.
    """
    folder = shards.folder
    held = shards.manifest.where("first_id IS NOT NULL").select("name", "first_id", "last_id")
    sections = min(1000, int(held.count() ** 0.5))
    cuts = sorted({int(x) for x in held.stat.approxQuantile("first_id", [k / sections for k in range(1, sections)], 0.001)}) if sections > 1 else []
    section = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= c)) if cuts else F.lit(0)
    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct().withColumn("section", section(F.col("doc_id")))
    spread = held.withColumn("section", F.explode(F.sequence(section(F.col("first_id")), section(F.col("last_id")))))
    met = ids.join(spread, "section").where(F.col("doc_id").between(F.col("first_id"), F.col("last_id")))
    grouped = met.groupBy("name").agg(F.collect_list("doc_id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = ShardReader(source)
                    for doc in ids:
                        found = [x.astype(np.int64) for x in reader.find(key_of(doc))]
                        if found:
                            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return grouped.mapInArrow(run, "doc_id long, ids array<long>")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
