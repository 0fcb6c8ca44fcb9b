"""Bytes of strings that occur more than once, by a sparse suffix order built from sampled suffixes.

Sorting every suffix of a corpus is not needed to find the strings of ``length`` bytes that start at two places:

1. Sampled suffixes. In every window of ``length`` bytes the ``gram``-byte piece with the smallest hash (the first of
   equals) is a sample, so equal windows hold equal samples at equal offsets, in whatever document or shard.
   Samples are the names of the reduced problem, and names that occur once end there.
2. Suffix tuples. A sample carries its name, the text before it (backwards) and after it, cut at what a window can
   reach. Tuples of equal text are one tuple with a count. The external sort of Spark's shuffle, which merges
   spilled runs through a priority queue, brings the tuples of a name together, whatever their number.
3. Common prefixes. Tuples are put in the order of the text after and of the text before; each order yields the
   common prefix of neighbours. A window that begins d bytes before its sample is repeated exactly if two tuples
   have no smaller common prefix than ``length`` - d between them in one order and d in the other.
   So all other suffixes are induced from the sampled ones, right to left, without being sorted.

Names of more than ``block_rows`` different tuples are not held in one task: their windows are rows of their own,
grouped by name, offset and hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfield.llm.stage import stored
from rankfield.llm.text import prefix, raw, slices, span_hashes

LENGTH = 400
GRAM = 64
BLOCK_ROWS = 20_000


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value (the first of equals) of each window of ``width``, by two running minima per block."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    whole = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(values)] = values
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    # The first place at or after a window's start that has its least value lies in the window.
    hit = np.zeros(len(values), bool)
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ends = np.append(change[1:], n)
    out = []
    for low, high in zip(change.tolist(), ends.tolist(), strict=True):
        places = low + np.flatnonzero(values[low : high + width - 1] == least[low])
        # A place is the first of its window if it is at most width - 1 after some start and no earlier one is in that window.
        first = places[np.searchsorted(places, np.arange(low, high))] if len(places) > 1 else places
        out.append(first[:1] if len(places) == 1 else np.unique(first))
    hit[np.concatenate(out)] = True
    return np.flatnonzero(hit)


def _digest(column: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def _samples(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(name, context, key, place) of every sample; ``context`` is a hash of the text that its windows can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = raw(part["text"])
            long = np.flatnonzero(np.diff(offsets) >= length)
            if not len(long):
                continue
            running = prefix(data)
            begin = np.arange(len(data) - gram + 1)
            names = span_hashes(running, begin, begin + gram)
            places, rows = [], []
            for r in long.tolist():
                low, high = int(offsets[r]), int(offsets[r + 1])
                found = low + window_least(names[low : high - gram + 1], length - gram + 1)
                places.append(found)
                rows.append(np.full(len(found), r))
            place, row = np.concatenate(places), np.concatenate(rows)
            low, high = offsets[row], offsets[row + 1]
            before, after = np.maximum(low, place - (length - gram)), np.minimum(high, place + length)
            context = span_hashes(running, before, after) ^ (place - before).astype(np.uint64)
            columns = [pa.array(names[place].view(np.int64)), pa.array(context.view(np.int64)), part["key"].take(pa.array(row)), pa.array(place - low), pa.array(before - low), pa.array(after - low)]
            yield pa.RecordBatch.from_arrays(columns, ["name", "context", "key", "place", "before", "after"])

    return texts.mapInArrow(run, "name long, context long, key binary, place long, before long, after long")


def _tuples(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """Add the text of the samples in ``wanted`` (key, and at: a list of name, place, copies), forwards and backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for key, text, at in zip(part["key"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), part["at"].to_pylist(), strict=True):
                rows += [(a["name"], key, a["place"], a["copies"], text[max(0, a["place"] - (length - gram)) : a["place"]][::-1], text[a["place"] : a["place"] + length]) for a in at]
            for low in range(0, len(rows), 4096):
                columns = zip(*rows[low : low + 4096], strict=True)
                types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["name", "key", "place", "copies", "left", "right"])

    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("name", "place", "copies")).alias("at"))  # bounded by the text
    joined = texts.join(lists, "key").dropDuplicates(["key"])
    return joined.mapInArrow(run, "name long, key binary, place long, copies long, left binary, right binary")


def _order(name: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (name, text), the common prefix with the one before in that order (-1 at a new name), and the lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    grid = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        grid[i, : len(t)] = np.frombuffer(t, np.uint8)
    # Sizes last: numpy ignores NUL bytes at the end, and a text goes before the longer ones it begins.
    order = np.lexsort((size, grid.view(f"S{width}").reshape(-1), name)) if width else np.argsort(name, kind="stable")
    common = np.full(len(texts), -1, np.int64)
    a, b = order[:-1], order[1:]
    differs = grid[a] != grid[b]
    length = np.where(differs.any(1), differs.argmax(1), width)
    length = np.minimum(length, np.minimum(size[a], size[b]))
    common[1:] = np.where(name[a] == name[b], length, -1)
    return order, common, size


def repeated_offsets(name: np.ndarray, left: list[bytes], right: list[bytes], length: int, gram: int) -> np.ndarray:
    """For each tuple and each d: does another tuple of its name have the same window beginning d bytes before the sample?"""
    reach = length - gram
    by_left, left_common, left_size = _order(name, left, reach)
    by_right, right_common, right_size = _order(name, right, length)
    out = np.zeros((len(name), reach + 1), bool)
    left_class, right_class = np.empty(len(name), np.int64), np.empty(len(name), np.int64)
    for d in range(reach + 1):
        fits = np.flatnonzero((left_size >= d) & (right_size >= length - d))
        if len(fits) < 2:
            continue
        # Neighbours whose common prefix is long enough stay in one class; shorter texts may part a class, so they are no part of it.
        left_class[by_left] = np.cumsum(left_common < d)
        right_class[by_right] = np.cumsum(right_common < length - d)
        both = left_class[fits] * (len(name) + 1) + right_class[fits]
        order = np.argsort(both, kind="stable")
        same = np.diff(both[order]) == 0
        again = np.zeros(len(fits), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        out[fits[again], d] = True
    return out


COVER = "key binary, first long, last long"


def _covered(key: list, place: np.ndarray, found: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of repeated offsets as byte ranges."""
    padded = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    step = np.diff(padded, axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return pa.RecordBatch.from_arrays([pa.array([key[r] for r in row], pa.binary()), pa.array(place[row] - (high - 1)), pa.array(place[row] - low + length)], ["key", "first", "last"])


def _induced(tuples: DataFrame, length: int, gram: int, block_rows: int) -> DataFrame:
    """Ranges of repeated windows, from tuples sorted by name: names are worked off in runs of about ``block_rows`` tuples."""

    def work(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        name, place = table["name"].to_numpy(), table["place"].to_numpy()
        found = repeated_offsets(name, table["left"].to_pylist(), table["right"].to_pylist(), length, gram)
        found[table["copies"].to_numpy() > 1] = False  # covered as wholes
        return _covered(table["key"].to_pylist(), place, found, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch["name"].to_numpy()
            if held and rows >= block_rows // 4:
                last = held[-1]["name"][-1].as_py()
                cut = int(np.searchsorted(names != last, True)) if names[0] == last else 0
                cut = cut if cut < len(names) and names[cut] != last else (len(names) if names[0] == last else 0)
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < len(names):
                    yield work(held)
                    held, rows, batch = [], 0, batch.slice(cut)
                else:
                    rows += cut
                    continue
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield work(held)

    return tuples.repartition("name").sortWithinPartitions("name").mapInArrow(run, COVER)


def _by_window(tuples: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for names of very many tuples: one row per window, grouped in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, key, place, copies, left, right in zip(*(batch[n].to_pylist() for n in ("name", "key", "place", "copies", "left", "right")), strict=True):
                text = left[::-1] + right
                begin = np.arange(len(text) - length + 1)
                begin = begin[(len(left) - begin >= 0) & (len(left) - begin <= length - gram)]
                if not len(begin):
                    continue
                data = np.frombuffer(text, np.uint8)
                hashes = span_hashes(prefix(data), begin, begin + length)
                n = len(begin)
                columns = [pa.array([name] * n), pa.array(hashes.view(np.int64)), pa.array([key] * n, pa.binary()), pa.array(place - (len(left) - begin)), pa.array([copies] * n), pa.array(len(left) - begin)]
                yield pa.RecordBatch.from_arrays(columns, ["name", "hash", "key", "first", "copies", "offset"])

    windows = tuples.mapInArrow(run, "name long, hash long, key binary, first long, copies long, offset long")
    again = windows.groupBy("name", "offset", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(again, ["name", "offset", "hash"]).where("copies = 1").select("key", "first", (F.col("first") + length).alias("last"))


def repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, ranges): for texts with repeated strings, by digest, the byte ranges to remove (they may overlap)."""
    texts = docs.select(_digest().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    long = texts.where(F.octet_length("text") >= length)
    samples = stored(_samples(long, length, gram), "samples")
    # Copies of a text give equal rows: counted as copies of their contexts.
    contexts = samples.groupBy("name", "context").agg(F.count("*").alias("copies"), F.min(F.struct("key", "place")).alias("one"))
    names = contexts.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("copies").alias("places")).where("places > 1")
    shared = stored(contexts.join(names, "name"), "contexts")
    whole = samples.join(shared.where("copies > 1").select("name", "context"), ["name", "context"]).where(F.col("after") - F.col("before") >= length)
    whole = whole.select("key", F.col("before").alias("first"), F.col("after").alias("last")).distinct()
    wanted = shared.where("kinds > 1").select("name", "one.key", "one.place", "copies", "kinds")
    tuples = stored(_tuples(long, wanted.select("key", "name", "place", "copies"), length, gram), "tuples")
    large = wanted.where(F.col("kinds") > block_rows).select("name").distinct()
    few = tuples.join(large, "name", "left_anti")
    many = tuples.join(large, "name", "left_semi")
    covers = stored(whole.unionByName(_induced(few, length, gram, block_rows)).unionByName(_by_window(many, length, gram)), "covers")
    return covers.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))  # bounded by the text


def without_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes).

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the same document or
    another; strings are those of the input, never across documents. Null texts are empty; texts of fewer bytes
    stay whole; repeated rows are copies and go both. Columns of these names in ``docs`` are replaced. An empty
    table gives an empty result.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    found = repeats(docs, length=length, gram=gram, block_rows=block_rows)
    rows = docs.drop(*added, "ranges").withColumn("key", _digest())
    joined = rows.join(found, "key", "left").drop("key")
    names = [n for n in joined.columns if n != "ranges"]
    schema = T.StructType([joined.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in added[:3]] + [T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sizes, removed, spans, kept = [], [], [], []
            for text, ranges in zip(part["text"].cast(pa.binary()).to_pylist(), part["ranges"].to_pylist(), strict=True):
                data = np.frombuffer(text or b"", np.uint8)
                depth = np.zeros(len(data) + 1, np.int64)
                if ranges:
                    np.add.at(depth, [r["first"] for r in ranges], 1)
                    np.add.at(depth, [r["last"] for r in ranges], -1)
                gone = np.cumsum(depth)[:-1] > 0
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0)
                kept.append(data[~gone].tobytes())
            columns = [part[n] for n in names] + [pa.array(x, pa.int64()) for x in (sizes, removed, spans)] + [pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return joined.mapInArrow(run, schema)


def dedup(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. See ``without_repeats``."""
    return without_repeats(docs.select("doc_id", "text"), **parameters).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

