"""Byte-level BPE of whole texts by one shuffle of their distinct words, and decoding by the table of token bytes.

A word is a match of the tokenizer's pattern. Texts are taken in slices; a slice keeps its texts as positions in a list
of its own distinct words, so what is exploded is (slice, position, word) with repeats already combined. The words
of all slices are dealt to buckets by hash, where each distinct word is encoded once; the ids go back to the slices
that asked, and a slice puts its texts together again by position. A frequent word costs one entry per slice, never
one per occurrence, so no bucket grows with a word's count.

Decoding looks up each id in the table of token bytes, whose size is that of the vocabulary.

Null texts are empty and give no ids; rows of equal or null ``doc_id`` are encoded each; an empty table gives an empty
result; very long texts are a slice of their own, split in pieces. Only ``doc_id`` and ``text`` are read, so
other columns may have any names. Bytes that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.stage import bucketed
from rankfield.llm.text import prefix, raw, release, slices, span_hashes

SLICE_BYTES = 16 << 20
#: Words or ids that are put together at once.
RUN = 1 << 18
BUCKET_BYTES = 4 << 20
PIECE = 1 << 20
HASHED_BYTES = 1 << 20
#: A space that follows a visible character always begins a word.
SAFE_CUT = re.compile(r"(?<=\S)(?= )")
ODD_SPACE = re.compile(r"\s ")


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id in a file of ranks."""
    with open(path, "rb") as lines:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: i for i, b in token_bytes(path).items()}, special_tokens={})


@lru_cache(maxsize=2)
def _compiled(pattern: str):  # noqa: ANN202
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes, one after another, and where each id's begin and end."""
    held = token_bytes(path)
    size = np.zeros(max(held, default=-1) + 2, np.int64)
    size[np.array([i + 1 for i in held], np.int64)] = [len(b) for b in held.values()]
    return np.frombuffer(b"".join(held[i] for i in sorted(held)), np.uint8), np.cumsum(size)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one range after another."""
    after = np.cumsum(size)
    return np.arange(after[-1] if len(after) else 0) - np.repeat(after - size, size) + np.repeat(begin, size)


def gathered(pool: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ranges of ``pool`` that are asked for, one after another, made in short runs."""
    parts = [pool[:0]]
    for low in range(0, len(which), RUN):
        own = which[low : low + RUN]
        parts.append(pool[spread(begin[own], size[own])])
    return np.concatenate(parts)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by planes of equal significance, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, parted where words begin in any case."""
    at = 0
    while len(text) - at > PIECE:
        cut = SAFE_CUT.search(text, at + PIECE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def chunks(text: str) -> list[str]:
    """A text cut before every space that follows a visible character."""
    if ODD_SPACE.search(text):
        return SAFE_CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + p for p in rest)] if first else [" " + p for p in rest]


class Slice:
    """Texts as positions in a list of distinct words, the most frequent first."""

    def __init__(self, pattern: str) -> None:
        self.pattern = _compiled(pattern)
        self.chunk: dict[str, int] = {}
        self.ids: list[pa.Array] = []
        self.runs: list[np.ndarray] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, batch: pa.RecordBatch) -> None:
        known = self.chunk
        for value in pc.fill_null(batch["text"].cast(pa.large_binary()), b"").to_pylist():
            held = 0
            for piece in pieces(value.decode(errors="replace")):
                run = np.array([known.setdefault(c, len(known)) for c in chunks(piece)], np.uint32)
                self.runs.append(run)
                held += len(run)
            self.counts.append(held)
            self.bytes += len(value)
        self.ids.append(batch["doc_id"])

    def row(self, number: int) -> pa.RecordBatch:
        words: dict[str, int] = {}
        size = np.zeros(len(self.chunk), np.int64)
        inner: list[int] = []
        for i, chunk in enumerate(self.chunk):
            found = self.pattern.findall(chunk)
            size[i] = len(found)
            inner += [words.setdefault(w, len(words)) for w in found]
        flat, begin = np.array(inner, np.int64), np.cumsum(size) - size
        run = np.concatenate(self.runs) if self.runs else np.empty(0, np.uint32)
        first = np.concatenate(([0], np.cumsum(self.counts)))
        ends = np.concatenate(([0], np.cumsum(size[run])))
        codes = gathered(flat.astype(np.uint32), begin, size, run)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        every = [w.encode() for w in words]
        every = [every[i] for i in order.tolist()]
        data = b"".join(every)
        values = [number, pa.concat_arrays(self.ids), pa.array(np.diff(ends[first]), pa.int64()), pack(rank.astype(np.uint32)[codes]), zstandard.ZstdCompressor(level=3).compress(data), pack(np.array([len(w) for w in every], np.int64)), len(data)]
        types = [pa.int64(), pa.list_(values[1].type), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.int64()]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if isinstance(v, pa.Array) else pa.array([v], t) for v, t in zip(values, types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["slice", "doc_ids", "counts", "codes", "words", "lengths", "word_bytes"])


def _sliced(docs: DataFrame, pattern: str, slice_bytes: int) -> DataFrame:
    """One row per slice: its documents with their numbers of words, all words as codes, and the distinct words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held = Slice(pattern)
        for part in slices(batches, "text", slice_bytes):
            held.add(part)
            if held.bytes >= slice_bytes:
                yield held.row(number)
                held, number = Slice(pattern), number + 1
                release()
        if held.ids:
            yield held.row(number)

    return docs.select("doc_id", "text").mapInArrow(run, f"slice long, doc_ids array<{id_type}>, counts array<long>, codes binary, words binary, lengths binary, word_bytes long")


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words that follow each other, about HASHED_BYTES of text at a time."""
    out, low = np.empty(len(end), np.uint64), 0
    while low < len(end):
        high = max(low + 1, int(np.searchsorted(end, begin[low] + HASHED_BYTES, "right")))
        out[low:high] = span_hashes(prefix(data[begin[low] : end[high - 1]]), begin[low:high] - begin[low], end[low:high] - begin[low])
        low = high
    return out


def _dealt(dictionaries: DataFrame, buckets: int) -> DataFrame:
    """The words of every slice by buckets of their hashes, with their places in the slice's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch["words"][row].as_py()), np.uint8)
                size = unpack(batch["lengths"][row].as_py()).astype(np.int64)
                end = np.cumsum(size)
                bucket = (_hashes(data, end - size, end) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                out: list[tuple] = []
                for places in np.split(order, cut[1:]) if len(order) else []:
                    own = data[spread(end[places] - size[places], size[places])].tobytes()
                    out.append((int(bucket[places[0]]), batch["slice"][row].as_py(), pack(np.diff(places, prepend=0)), zstandard.ZstdCompressor(level=3).compress(own), pack(size[places])))
                yield _batch(out, WORDS)
            release()

    return dictionaries.mapInArrow(run, "bucket int, slice long, places binary, words binary, lengths binary")


WORDS = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("places", pa.binary()), ("words", pa.binary()), ("lengths", pa.binary())])
CODED = pa.schema([("slice", pa.int64()), ("places", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _coded(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """The ids of every slice's words: a bucket's rows come together, and each distinct word of it is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern)._encode_single_piece  # bytes of one match, no pattern
        bucket, known = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                if batch["bucket"][row].as_py() != bucket:
                    bucket, known = batch["bucket"][row].as_py(), {}
                data = zstandard.ZstdDecompressor().decompress(batch["words"][row].as_py())
                ids: list[int] = []
                sizes = unpack(batch["lengths"][row].as_py()).astype(np.int64)
                ends = np.cumsum(sizes)
                count = np.zeros(len(sizes), np.int64)
                for i, (low, high) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                    word = data[low:high]
                    own = known.get(word)
                    if own is None:
                        own = known[word] = encode(word)
                    count[i] = len(own)
                    ids += own
                yield _batch([(batch["slice"][row].as_py(), batch["places"][row].as_py(), pack(count), pack(np.array(ids, np.int64)))], CODED)
        release()

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "slice long, places binary, lengths binary, ids binary")


def encode(docs: DataFrame, *, ranks_path: str, pattern: str, slice_bytes: int = SLICE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, ids): the token ids of every text of ``docs``, each match of ``pattern`` encoded by the ranks.

    ``ranks_path`` names a file of ranks that every executor has. The number of buckets follows the bytes of the
    slices' distinct words, so a bucket stays at about ``bucket_bytes`` whatever the size of the table.
    """
    held = bucketed(_sliced(docs, pattern, slice_bytes), "slice", "bpe-slices")
    total = held.agg(F.sum("word_bytes")).first()[0] or 0
    ids = _coded(_dealt(held.select("slice", "words", "lengths"), max(1, -(-total // bucket_bytes))), ranks_path, pattern)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        id_list = left["doc_ids"].type.value_type
        found, numbers = [pa.array([], id_list)], [pa.array([], pa.list_(pa.int32()))]
        places = [np.cumsum(unpack(p)).astype(np.int64) for p in right["places"].to_pylist()]
        count = [unpack(p).astype(np.int64) for p in right["lengths"].to_pylist()]
        pool = np.concatenate([np.empty(0, np.uint32), *(unpack(p) for p in right["ids"].to_pylist())]).astype(np.int32)
        at, size = (np.concatenate([np.empty(0, np.int64), *x]) for x in (places, count))
        begin = np.cumsum(size) - size
        order = np.argsort(at)
        begin, size = begin[order], size[order]
        for row in range(left.num_rows):  # one
            codes = unpack(left["codes"][row].as_py())
            names, counts = left["doc_ids"][row].values, left["counts"][row].values.to_numpy()
            texts, low = np.cumsum(counts), 0
            while low < len(counts):  # some RUN words at once, or one text
                first = int(texts[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(texts, first + RUN, "right")))
                own = codes[first : texts[high - 1]]
                ends = np.concatenate(([0], np.cumsum(size[own])))[np.concatenate(([0], texts[low:high] - first))]
                found.append(names[low:high])
                numbers.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gathered(pool, begin, size, own))))
                low = high
        release()
        return pa.table({"doc_id": pa.chunked_array(found), "ids": pa.chunked_array(numbers)})

    left = held.select("slice", "doc_ids", "counts", "codes").groupBy("slice")
    return left.cogroup(ids.groupBy("slice")).applyInArrow(assemble, f"doc_id {id_type}, ids array<int>")


def decode(tokens: DataFrame, *, ranks_path: str) -> DataFrame:
    """Add ``decoded``, the bytes that each row's ``ids`` stand for (null ids: none), to (doc_id, ids).

    An id that the table lacks is an error.
    """
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, at = _table(ranks_path)
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, low = np.cumsum(size), 0
            while low < batch.num_rows:  # some 256,000 ids at once, or one text
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 18), "right")))
                part = batch.slice(low, high - low)
                ids = part["ids"].flatten().to_numpy(zero_copy_only=False)
                if len(ids) and not (0 <= ids.min() and ids.max() < len(at) - 1):
                    raise ValueError("an id is not in the table of token bytes")
                own = at[ids + 1] - at[ids]
                after = np.concatenate(([0], np.cumsum(own)))[np.concatenate(([0], np.cumsum(size[low:high])))]
                text = data[spread(at[ids], own)]
                column = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(after.astype(np.int64)), pa.py_buffer(text)])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], column.cast(pa.binary())], ["doc_id", "ids", "decoded"])
                low = high
            release()

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded binary")


def digests(docs: DataFrame, *, ranks_path: str, pattern: str, **parameters: int) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of the decimal ids, parted by spaces), decoded_sha256."""
    both = decode(encode(docs, ranks_path=ranks_path, pattern=pattern, **parameters), ranks_path=ranks_path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
