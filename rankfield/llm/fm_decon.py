"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of documents of a few megabytes. Its words become symbols of the phrases' vocabulary; words
that occur in no phrase end a run, and runs shorter than every phrase are left out, since no phrase can lie
there. The rest is indexed: suffix order by doubling, the last column in a wavelet matrix with rank
directories, suffix positions sampled at every eighth symbol and at each start of a run. Backward search
finds the suffix range of all phrases at once, sampled positions locate their occurrences, and overlapping
ones merge into removal spans. Documents are never shuffled. Phrases are taken in blocks of bounded size,
one pass over the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfield.llm.text import ALNUM, Words, slices

WINDOW = 10
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 4 << 20
SAMPLE = 8


class Bits:
    """A bit vector with a rank directory: ones before each 64-bit word, and a population count inside."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Ranks and values of a sequence of small integers, one bit vector for each bit of its symbols."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            ones = (values >> shift) & 1 == 1
            self.levels.append((shift, Bits(ones)))
            values = np.concatenate((values[~ones], values[ones]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each position."""
        start, i = np.zeros(len(i), np.int64), i.astype(np.int64)
        for shift, level in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = level.rank(start), level.rank(i)
            start, i = np.where(one, level.zeros + a, start - a), np.where(one, level.zeros + b, i - b)
        return i - start

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for shift, level in self.levels:
            one, ones = level.get(i), level.rank(i)
            out |= one.astype(np.int64) << shift
            i = np.where(one, level.zeros + ones, i - ones)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of symbols of which 0 ends a run; the ends compare by position, so rounds follow the longest run."""
    n = len(text)
    ends = np.cumsum(text == 0)
    rank = np.where(text == 0, ends - 1, text + ends[-1])
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2 if n else 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class FmIndex:
    """Search over a sequence of runs, each ended by 0; no phrase holds a 0."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_order(text)
        last = text[order - 1]
        self.column = WaveletMatrix(last, max(1, int(symbols).bit_length()))
        self.start = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1)))).astype(np.int64)
        self.size = len(text)
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.marks, self.samples = Bits(sampled), order[sampled]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases of one length (a row each), read from their last word to the first."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        open_ = np.arange(len(phrases))
        for symbol in phrases.T[::-1]:
            s = symbol[open_]
            low[open_] = self.start[s] + self.column.rank(s, low[open_])
            high[open_] = self.start[s] + self.column.rank(s, high[open_])
            open_ = open_[low[open_] < high[open_]]
        high[low >= high] = low[low >= high]
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step to the preceding symbol until a sampled suffix is met."""
        row, steps, place = row.copy(), np.zeros(len(row), np.int64), np.arange(len(row))
        out = np.empty(len(row), np.int64)
        while len(row):
            known = self.marks.get(row)
            out[place[known]] = self.samples[self.marks.rank(row[known])] + steps[known]
            row, steps, place = row[~known], steps[~known] + 1, place[~known]
            symbol = self.column.get(row)
            row = self.start[symbol] + self.column.rank(symbol, row)
        return out


@dataclass(frozen=True)
class Phrases:
    """Distinct windows of a block of items by length, and the items that each comes from."""

    vocabulary: np.ndarray  # sorted word hashes; symbol k + 1 is word k
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # phrases, first of each one's owners, owners
    names: list[str]
    shortest: int


def _phrases(items: list[tuple[str, list[int]]], window: int) -> Phrases:
    vocabulary = np.unique(np.concatenate([np.asarray(w, np.int64).view(np.uint64) for _, w in items])) if items else np.empty(0, np.uint64)
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for number, (_, words) in enumerate(items):
        symbols = np.searchsorted(vocabulary, np.asarray(words, np.int64).view(np.uint64)) + 1
        length = min(window, len(symbols))
        rows = np.lib.stride_tricks.sliding_window_view(symbols, length)
        found.setdefault(length, []).append((rows, np.full(len(rows), number)))
    by_length = []
    for length in sorted(found):
        rows, owners = (np.concatenate(x) for x in zip(*found[length], strict=True))
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(which.reshape(-1) * len(items) + owners)
        first = np.searchsorted(pairs, np.arange(len(distinct) + 1) * len(items))
        by_length.append((distinct, first, pairs % len(items)))
    return Phrases(vocabulary, by_length, [name for name, _ in items], min(found, default=1))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the range that each comes from."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which], which


def search(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hit by a phrase?, rows, items): for each word of the shard, and each row's items without repeats."""
    hit = np.zeros(len(words.start), bool)
    nothing = np.empty(0, np.int64)
    if not len(hit) or not len(phrases.vocabulary):
        return hit, nothing, nothing
    hashes = words.hashes()
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == hashes
    new = np.ones(len(hit), bool)
    new[1:] = (words.row[1:] != words.row[:-1]) | ~known[:-1]
    run = np.cumsum(new) - 1
    kept = np.flatnonzero(known & (np.bincount(run, known)[run] >= phrases.shortest))
    if not len(kept):
        return hit, nothing, nothing
    # Symbols of the kept words, with a 0 after each run; ``origin`` leads back to the words.
    run = np.cumsum(np.concatenate(([False], np.diff(run[kept]) != 0)))
    place = np.arange(len(kept)) + run
    text = np.zeros(place[-1] + 2, np.int64)
    text[place] = at[kept] + 1
    origin = np.full(len(text), -1, np.int64)
    origin[place] = kept
    index = FmIndex(text, len(phrases.vocabulary))
    present = np.diff(index.start) > 0
    cover = np.zeros(len(hit) + 1, np.int64)
    pairs = []
    for rows, first, owners in phrases.by_length:
        likely = np.flatnonzero(present[rows].all(axis=1))
        low, high = index.find(rows[likely])
        suffix, which = _ranges(low, high)
        begin = origin[index.locate(suffix)]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + rows.shape[1], -1)
        found = np.unique(words.row[begin] * len(rows) + likely[which])
        phrase = found % len(rows)
        owner, of = _ranges(first[phrase], first[phrase + 1])
        pairs.append(np.unique((found // len(rows))[of] * len(phrases.names) + owners[owner]))
    both = np.unique(np.concatenate(pairs))
    return np.cumsum(cover[:-1]) > 0, both // len(phrases.names), both % len(phrases.names)


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("first_byte", T.LongType()), T.StructField("last_byte", T.LongType())]))


def _scan(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """Merge one block's findings into the columns n_words, spans and items."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    names = [n for n in docs.columns if n not in ("n_words", "spans", "items")]
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    again = "spans" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for part in slices(batches, "text", SHARD_BYTES):
            words = Words(part["text"], ALNUM, lower=True)
            hit, row, item = search(words, block)
            items: list[list[str]] = part["items"].to_pylist() if again else [[] for _ in range(part.num_rows)]
            for r, i in zip(row.tolist(), item.tolist(), strict=True):
                items[r].append(block.names[i])
            if again:
                for r, spans in enumerate(part["spans"].to_pylist()):
                    for s in spans:
                        hit[words.first[r] + s["first"] : words.first[r] + s["last"]] = True
            edge = hit.copy()
            edge[1:] &= ~hit[:-1] | (words.row[1:] != words.row[:-1])
            begin = np.flatnonzero(edge)
            edge = hit.copy()
            edge[:-1] &= ~hit[1:] | (words.row[1:] != words.row[:-1])
            end = np.flatnonzero(edge) + 1
            of = words.row[begin]
            base = words.offsets[of]
            structs = pa.StructArray.from_arrays(
                [pa.array(x) for x in (begin - words.first[of], end - words.first[of], words.start[begin] - base, words.end[end - 1] - base)], ["first", "last", "first_byte", "last_byte"]
            )
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)), pa.int32()), structs)
            columns = [part[n] for n in names] + [pa.array(words.count.astype(np.int64)), spans, pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "spans", "items"])

    return docs.mapInArrow(run, schema)


def _item_words(benchmark: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part["text"], ALNUM, lower=True)
            lists = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(words.hashes().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part["item"], lists], ["item", "words"])

    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return texts.mapInArrow(run, "item string, words array<long>").where(F.size("words") > 0)


def occurrences(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, ``spans`` (merged runs of hit words: first and past-the-last word and byte) and ``items``.

    A phrase is ``window`` consecutive words of an item, or the whole item if it has fewer but some. Null and
    empty texts have no words; a null item_id reads as an empty string; items of one id count once. Columns
    of these names in ``docs`` are replaced. ``block_words``: the most words of items, but for one long item,
    that are sent to the tasks at once.
    """
    words = _item_words(benchmark)
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // block_words) or 1
    found = docs.drop("n_words", "spans", "items")
    for block in range(blocks):
        rows = words.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).collect()
        found = _scan(found, _phrases([(r["item"], r["words"]) for r in rows], window))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. See ``occurrences``."""
    found = occurrences(docs.select("doc_id", "text"), benchmark, **parameters)
    items = F.array_sort(F.array_distinct("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents without any hit, with the columns of ``docs``."""
    kept = docs.columns
    renamed = docs.select(F.struct("*").alias("whole"), "text")
    return occurrences(renamed, benchmark, **parameters).where(F.size("spans") == 0).select(*(F.col("whole")[n].alias(n) for n in kept))


def cut_spans(found: DataFrame) -> DataFrame:
    """Texts of ``occurrences`` without their removal spans, bytes kept as they are."""
    kept = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("out")),
        lambda s, x: F.struct(x["last_byte"].alias("at"), F.concat(s["out"], F.substring(F.col("text").cast("binary"), s["at"].cast("int") + 1, (x["first_byte"] - s["at"]).cast("int"))).alias("out")),
        lambda s: F.concat(s["out"], F.substring(F.col("text").cast("binary"), s["at"].cast("int") + 1, F.octet_length("text"))),
    )
    return found.withColumn("text", kept.cast("string"))
