"""Token ids in directly addressable codes: byte levels with continuation bitmaps and rank directories.

An id is cut into bytes, lowest first. Level 0 holds the lowest byte of every id; a bit per id says whether more
bytes follow, and those ids, in order, have their next byte in level 1, and so on. The ones before each 512 bits
are kept beside the bitmap, so any token is read by one byte, one bit and one short count per level: no block
of tokens is decoded.

The file is a Parquet folder. A row is a segment: consecutive documents of one shard, about ``segment_tokens`` ids
(or one long document), with its levels, bitmaps, directories, and the ids and lengths of its documents. Shards
are ranges of doc_id in ascending order.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.llm.stage import folder
from rankfield.llm.text import mix, prefix, raw, release, slices, span_hashes

BITS = 512
END = 2
SEGMENT_TOKENS = 1 << 20
#: What a task keeps of the chunks it has encoded: some 40 MB.
CACHE_CHUNKS = 600_000
CACHE_IDS = 6_000_000
#: Bytes of new chunks that are encoded as one text.
PART_BYTES = 1 << 16


@dataclass(frozen=True)
class Codes:
    """The encoded ids of a segment."""

    levels: list[bytes]
    bitmaps: list[bytes]
    ranks: list[bytes]

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        ids = ids.astype(np.uint32)
        levels, bitmaps, ranks = [], [], []
        while True:
            more = ids > 0xFF
            levels.append((ids & 0xFF).astype(np.uint8).tobytes())
            bits = np.packbits(more, bitorder="little")
            padded = np.zeros(-(-len(more) // BITS) * BITS, bool)
            padded[: len(more)] = more
            ones = padded.reshape(-1, BITS).sum(1, dtype=np.uint32)
            bitmaps.append(bits.tobytes())
            ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
            if not more.any():
                return cls(levels, bitmaps, ranks)
            ids = ids[more] >> 8

    def get(self, position: int) -> int:
        """The id at one position."""
        out, shift = 0, 0
        for level, bitmap, rank in zip(self.levels, self.bitmaps, self.ranks, strict=True):
            out |= level[position] << shift
            if not bitmap[position >> 3] >> (position & 7) & 1:
                break
            block = position // BITS
            before = int.from_bytes(bitmap[block * BITS // 8 : position // 8 + 1], "little") & ((1 << (position - block * BITS)) - 1)
            position = int.from_bytes(rank[4 * block : 4 * block + 4], "little") + before.bit_count()
            shift += 8
        return out

    def all(self) -> np.ndarray:
        """All ids, from the last level up."""
        out = np.frombuffer(self.levels[-1], np.uint8).astype("<u4")
        for level, bitmap in zip(self.levels[-2::-1], self.bitmaps[-2::-1], strict=True):
            low = np.frombuffer(level, np.uint8).astype("<u4")
            more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(low), bitorder="little").astype(bool)
            low[more] |= out << 8
            out = low
        return out


@dataclass(frozen=True)
class Layout:
    """What the driver reads of a tokenizer's file once: whether texts may be cut into chunks, and the bytes of every id."""

    chunked: bool
    bytes_of: np.ndarray

    @classmethod
    def of(cls, path: str) -> Layout:
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before, added = parts.get("pre_tokenizer") or {}, parts.get("added_tokens") or []
        chunked = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and parts.get("normalizer") is None
        chunked = bool(chunked) and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        if not chunked:
            return cls(False, np.empty(0, np.uint16))
        vocabulary = parts["model"]["vocab"]  # a character of a byte-level token stands for a byte
        size = {i: len(t) for t, i in vocabulary.items()} | {t["id"]: len(t["content"].encode()) for t in added}
        bytes_of = np.zeros(max(size) + 1, np.uint16)
        bytes_of[list(size)] = list(size.values())
        return cls(True, bytes_of)


class Encoder:
    """Ids of whole texts, encoding each distinct chunk once.

    A byte-level pre-tokenizer never joins a space to the visible character before it, so a text may be cut before
    such spaces and the chunks' ids put one after another. For the same reason new chunks are encoded as long
    texts, whose ids are parted by the bytes that each stands for. Chunks are told apart by two 64-bit hashes; what is
    kept of them is dropped at ``cache`` entries or CACHE_IDS ids. Other tokenizers encode texts as they are.
    """

    def __init__(self, path: str, cache: int = CACHE_CHUNKS, layout: Layout | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.layout = layout or Layout.of(path)
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.begin, self.length = np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool, self.used = np.empty(1 << 18, np.uint32), 0

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and how many each has. ``inner``: begins with a space and ends where a text may be cut."""
        whole, size = data.tobytes(), np.zeros(len(low), np.int64)
        lists: list[np.ndarray] = []
        order = np.concatenate((np.flatnonzero(inner), np.flatnonzero(~inner)))
        n = int(inner.sum())
        ends = np.cumsum(high[inner] - low[inner])
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
            own = order[at:to]
            ids = np.array(self._plain([b"".join([whole[a:b] for a, b in zip(low[own].tolist(), high[own].tolist(), strict=True)]).decode()])[0], np.uint32)
            after = np.searchsorted(np.cumsum(self.layout.bytes_of[ids], dtype=np.int64), np.cumsum(high[own] - low[own])) + 1
            size[own] = np.diff(after, prepend=0)
            lists.append(ids)
            at = to
        rest = order[n:]
        for k, ids in zip(rest.tolist(), self._plain([whole[a:b].decode() for a, b in zip(low[rest].tolist(), high[rest].tolist(), strict=True)]), strict=True):
            size[k] = len(ids)
            lists.append(np.array(ids, np.uint32))
        every = np.concatenate(lists) if lists else np.empty(0, np.uint32)
        begin = np.empty(len(low), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return every[_spread(begin, size)], size

    def _learn(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        to = self.used + len(ids)
        if to > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.empty(to, np.uint32)))
        self.pool[self.used : to] = ids
        at = np.searchsorted(self.first, first)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(size) - size)
        self.length = np.insert(self.length, at, size)
        self.first, self.second = np.insert(self.first, at, first), np.insert(self.second, at, second)
        self.used = to

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts, one after another, and the n + 1 places where the texts begin and end."""
        data, offsets = raw(column)
        starts = chunk_starts(data, offsets)
        if not self.layout.chunked:
            return self._whole(column)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        first, second = (span_hashes(prefix(x), starts, ends) for x in (data, SHUFFLED[data]))
        _, one, which = np.unique(first, return_index=True, return_inverse=True)
        a, b = first[one], second[one]
        if len(self.first) + len(one) > self.cache or self.used > CACHE_IDS:
            self._clear()
        at = np.minimum(np.searchsorted(self.first, a), max(0, len(self.first) - 1))
        known = self.first[at] == a if len(self.first) else np.zeros(len(a), bool)
        if (second != b[which]).any() or (self.second[at[known]] != b[known]).any():
            return self._whole(column)  # two chunks of one hash
        new = ~known
        if new.any():
            low, high = starts[one][new], ends[one][new]
            outer = np.zeros(len(data) + 1, bool)
            outer[offsets] = True
            self._learn(a[new], b[new], *self._fresh(data, low, high, (data[low] == 0x20) & ~outer[low] & ~outer[high]))
        number = np.searchsorted(self.first, a)[which]
        length = self.length[number].astype(np.int64)
        return self.pool[_spread(self.begin[number], length)], np.concatenate(([0], np.cumsum(length)))[np.searchsorted(starts, offsets)]

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self._plain(column.fill_null("").to_pylist())
        return np.array([i for ids in lists for i in ids], np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one range after another."""
    after = np.cumsum(size)
    return np.arange(after[-1] if len(after) else 0) - np.repeat(after - size, size) + np.repeat(begin, size)


#: A second, unrelated order of byte values.
SHUFFLED = np.argsort(mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5EED))).astype(np.uint8)
#: First bytes of characters among which are Unicode's spaces.
SPACE_LEADS = np.zeros(256, bool)
SPACE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut: at their beginnings, and before a space that follows a visible character."""
    cut = np.zeros(len(data), bool)
    if len(data):
        visible = (data > 0x20) & (data != 0x7F)
        cut[1:] = (data[1:] == 0x20) & visible[:-1]
        for back in (2, 3):  # the character before may be a space of two or three bytes
            cut[back:] &= ~(SPACE_LEADS[data[:-back]] & (data[back - 1 : -1] >= 0x80))
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


_encoders: dict[str, Encoder] = {}


def encoder(path: str, layout: Layout) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, layout=layout)
    return _encoders[path]


SEGMENT = "shard int, segment int, begin long, n_tokens long, doc_ids array<{id}>, lengths array<long>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


def _encode(docs: DataFrame, path: str, segment_tokens: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    layout = Layout.of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what earlier tasks of this worker have freed
        segment, begin, held = 0, 0, 0
        ids: list[np.ndarray] = []
        names: list = []

        def row(shard: int) -> pa.RecordBatch:
            codes = Codes.of(np.concatenate(ids))
            values = [[shard], [segment], [begin], [held], [names], [[len(x) for x in ids]], [codes.levels], [codes.bitmaps], [codes.ranks]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_arrow), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["shard", "segment", "begin", "n_tokens", "doc_ids", "lengths", "levels", "bitmaps", "ranks"])

        shard = 0
        for part in slices(batches, "text"):
            id_arrow, shard = part["doc_id"].type, part["shard"][0].as_py()
            every, at = encoder(path, layout).encode(part["text"])
            for name, low, high in zip(part["doc_id"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids.append(np.append(every[low:high], np.uint32(END)))
                names.append(name)
                held += len(ids[-1])
                if held >= segment_tokens:
                    yield row(shard)
                    segment, begin, held, ids, names = segment + 1, begin + held, 0, [], []
                    release()
        if names:
            yield row(shard)

    return docs.mapInArrow(run, SEGMENT.format(id=id_type))


def write(docs: DataFrame, out: str, *, tokenizer_path: str, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every whole text (null: empty), end each document with id 2, and write the documents in ascending doc_id order.

    Null ids come first; rows of one id are ordered by a hash of their texts. ``tokenizer_path`` names a file that
    every executor has.
    """
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    ordered = docs.select("doc_id", "text").withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    numbered = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    _encode(numbered, tokenizer_path, segment_tokens).write.parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    segments = spark.read.parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # one row per shard
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = {n: batch[n][i] for n in batch.schema.names}
                ids = Codes(*(value[n].as_py() for n in ("levels", "bitmaps", "ranks"))).all()
                lengths = np.array(value["lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[b:e]) for b, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                doc_ids = value["doc_ids"].values
                start = pa.array(ends - lengths + value["begin"].as_py())
                shard = pa.array(np.full(len(ends), value["shard"].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([shard, doc_ids, start, pa.array(lengths), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = segments.drop("segment", "n_tokens").mapInArrow(run, f"shard int, doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(bases), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token(spark: SparkSession, path: str, position: int) -> int:
    """The id at one position of all files, from one segment."""
    segments = spark.read.parquet(path)
    for shard, n in sorted((r["shard"], r["n"]) for r in segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()):
        if position < n:
            row = segments.where((F.col("shard") == shard) & (F.col("begin") <= position) & (F.col("begin") + F.col("n_tokens") > position)).first()
            return Codes(*([bytes(x) for x in row[n]] for n in ("levels", "bitmaps", "ranks"))).get(position - row["begin"])
        position -= n
    raise IndexError(position)


def encoded(docs: DataFrame, *, tokenizer_path: str, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Write the documents to a new folder beside the checkpoints and read the files back. An empty table gives an empty result."""
    path = folder(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path=tokenizer_path, segment_tokens=segment_tokens)
    return read(docs.sparkSession, path)
