"""Self-join of texts on the Jaccard similarity of their word n-grams, pruned by a posterior over MinHash values.

1. Equal texts are one row of the join (by a digest), whatever their number.
2. Each text has a sketch of MinHash values. Texts that agree on a band of values meet in a bucket. There the
   values of a pair are compared a few at a time; the pair is dropped as soon as the posterior probability of a
   similarity of ``threshold`` or more, given the agreements so far and a uniform prior, is below ``tolerance``.
   What stays joins texts into candidate groups, as star edges: never one row per pair.
3. Inside a candidate group every pair is compared in the same way and what stays is verified exactly on whole
   sets of n-grams. Links are counted per text; groups follow from verified links alone.

Buckets and groups that are large are cut into blocks by a hash, and each pair of blocks is a task of its own;
small ones share tasks. The bands miss a pair of similarity 0.8 with probability (1 - 0.8^4)^24 = 3e-6, and only
if no chain of other candidates joins the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.components import components
from rankfield.llm.stage import row_key, stored
from rankfield.llm.text import Words, grams, mix, raw, release, slices

BANDS, BAND_ROWS = 24, 4
VALUES = BANDS * BAND_ROWS
STEP = 16
BLOCK_ROWS = 1024
BLOCK_BYTES = 4 << 20
SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text and their rows, with repeats. A text of fewer words has them all as its one gram."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    found, at = grams(hashes, words.row, tuple(range(1, n)))
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if not len(short):
        return found, words.row[at]
    whole = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        there = np.flatnonzero(words.count[short] > k)
        whole[there] = mix(whole[there] * np.uint64(31) + hashes[words.first[short[there]] + k])
    both, row = np.concatenate((found, whole)), np.concatenate((words.row[at], short))
    order = np.argsort(row, kind="stable")
    return both[order], row[order]


def sketches(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """MinHash values of each row's hashes (sorted by row); rows without hashes are all ones."""
    out = np.full((rows, VALUES), 0xFFFFFFFF, np.uint32)
    if len(hashes):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        for k, seed in enumerate(SEEDS):
            out[row[first], k] = np.minimum.reduceat(((hashes ^ seed) * (seed | np.uint64(1))) >> np.uint64(32), first)
    return out


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For n = STEP, 2 STEP, ... values compared: the fewest agreements that keep a pair.

    With a uniform prior the posterior of a similarity s after m agreements of n is Beta(m + 1, n - m + 1), and
    P(s >= t) is the probability of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def alive(sketch: np.ndarray, one: int, others: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Those of ``others`` that stay candidates of ``one`` after all its values are compared."""
    matches = np.zeros(len(others), np.int64)
    for k, needed in enumerate(least):
        columns = slice(k * STEP, (k + 1) * STEP)
        matches += (sketch[others, columns] == sketch[one, columns]).sum(1)
        keep = matches >= needed
        others, matches = others[keep], matches[keep]
        if not len(others):
            break
    return others


def local_groups(size: int, near: Callable[[int], np.ndarray]) -> np.ndarray:
    """Smallest member of each one's component, asking for neighbours only while components may still meet.

    Once all members but those of one component were asked, no edge between components is left unseen. In a
    bucket of copies of one text, that is after a few rows.
    """
    label = np.arange(size)
    asked = np.zeros(size, bool)
    while True:
        waiting = np.bincount(label[~asked], minlength=size)
        if (waiting > 0).sum() <= 1:
            return label
        one = int(np.flatnonzero(~asked & (label != waiting.argmax()))[0]) if asked.any() else 0
        asked[one] = True
        joined = np.unique(label[np.append(near(one), one)])
        label[np.isin(label, joined)] = joined[0]


def _groups_of(keys: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1
    yield from np.split(order, edges)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a digest of the text (``key``) and of id and text (``row_key``). Null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text)
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"), F.unhex(F.md5(row.cast("binary"))).alias("row_key"))


def _texts(docs: DataFrame, n: int) -> DataFrame:
    """(key, row_key, doc_id, bytes, sketch) of every row; the sketch is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, row = shingles(part["text"], n)
            values = sketches(hashes, row, part.num_rows)
            any_ = np.bincount(row, minlength=part.num_rows) > 0
            sketch = pa.array([v.tobytes() if a else None for v, a in zip(values, any_, strict=True)], pa.binary())
            size = pa.array(np.diff(raw(part["text"])[1]))
            yield pa.RecordBatch.from_arrays([part["key"], part["row_key"], part["doc_id"], size, sketch], ["key", "row_key", "doc_id", "bytes", "sketch"])

    return _keyed(docs).mapInArrow(run, f"key binary, row_key binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, bytes long, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            values = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.uint32).reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
            bucket = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(values), 0)
            for k in range(BAND_ROWS):
                bucket = mix(bucket * np.uint64(1000003) + values[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1).view(np.int64)), part["key"].take(pa.array(np.repeat(np.arange(len(values)), BANDS)))], ["bucket", "key"])

    return classes.mapInArrow(run, "bucket long, key binary")


def _paired(rows: DataFrame, group: str, blocks: str, packs: int) -> DataFrame:
    """Give each row its tasks (``pack``, with ``part`` the pair of blocks) and its ``side`` in them.

    A group of one block goes to one of ``packs`` shared tasks; of several, each pair of blocks is a task.
    """
    block = F.pmod(F.xxhash64("key", F.lit(11)), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    split = rows.where(F.col(blocks) > 1).withColumn("block", block).withColumn("other", other)
    part = F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other"))
    split = split.select(*rows.columns, part.alias("part"), (F.col("block") > F.col("other")).alias("side"), (F.col("block") == F.col("other")).alias("same"))
    small = rows.where(F.col(blocks) == 1).select(*rows.columns, F.lit("").alias("part"), F.lit(False).alias("side"), F.lit(True).alias("same"))
    pack = F.when(F.col("part") == "", F.pmod(F.xxhash64(group), F.lit(packs))).otherwise(F.xxhash64(group, "part"))
    return small.unionByName(split).withColumn("pack", pack)


def _candidates(classes: DataFrame, least: np.ndarray, block_rows: int) -> DataFrame:
    """Star edges (node, hub) between texts that stay candidates in some bucket."""
    bands = stored(_bands(classes.select("key", "sketch")), "bands")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    met = bands.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("size") / block_rows))
    met = stored(met.select("bucket", "key", "blocks"), "buckets")
    packs = 1 + met.count() // (4 * block_rows)
    rows = _paired(met.join(classes.select("key", "sketch"), "key"), "bucket", "blocks", packs)

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"].to_numpy()
        keys = np.array(table["key"].to_pylist(), object)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint32).reshape(-1, VALUES)
        nodes, hubs = [], []
        for at in _groups_of(bucket):
            at = at[np.argsort(keys[at], kind="stable")]
            own, everyone = sketch[at], np.arange(len(at))
            label = local_groups(len(at), lambda one: alive(own, one, everyone, least))
            several = np.flatnonzero(np.bincount(label, minlength=len(at))[label] > 1)
            nodes.append(keys[at[several]])
            hubs.append(keys[at[label[several]]])
        release()
        both = sorted(set(zip(np.concatenate(nodes).tolist(), np.concatenate(hubs).tolist(), strict=True))) if nodes else []
        return pa.table({"node": pa.array([a for a, _ in both], pa.binary()), "hub": pa.array([b for _, b in both], pa.binary())})

    return rows.select("pack", "bucket", "key", "sketch").groupBy("pack").applyInArrow(run, "node binary, hub binary")


def _verify(members: DataFrame, n: int, threshold: float, least: np.ndarray, packs: int) -> DataFrame:
    """(node, hub, links, split) of texts in candidate groups: verified links, and the smallest text of the local group."""
    share = Fraction(threshold).limit_denominator(10_000)
    rows = _paired(members, "label", "blocks", packs)

    def run(table: pa.Table) -> pa.Table:
        _, label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)
        keys = np.array(table["key"].to_pylist(), object)
        text, side, same = table["text"].combine_chunks(), table["side"].to_numpy(), table["same"].to_numpy()
        part = np.array(table["part"].to_pylist(), object)
        out: list[tuple] = []
        for at in _groups_of(label):
            at = at[np.argsort(keys[at], kind="stable")]
            hashes, row = shingles(text.take(pa.array(at)), n)
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            hashes, row = hashes[new], row[new]
            sketch, size = sketches(hashes, row, len(at)), np.bincount(row, minlength=len(at))
            # Postings: for each gram that several texts have, those texts.
            _, gram, often = np.unique(hashes, return_inverse=True, return_counts=True)
            shared = often[gram] > 1
            gram, holder = gram[shared], row[shared]
            by_gram = np.argsort(gram, kind="stable")
            posting, first = holder[by_gram], np.concatenate(([0], np.cumsum(np.bincount(gram, minlength=len(often)))))
            of_row = np.searchsorted(holder, np.arange(len(at) + 1))
            sides, everyone = side[at], np.arange(len(at))
            links = np.zeros(len(at), np.int64)
            label_of = np.arange(len(at))
            for one in range(len(at)):
                others = everyone[one + 1 :] if same[at[one]] else everyone[sides & ~sides[one]]
                others = alive(sketch, one, others, least)
                if not len(others):
                    continue
                mine = gram[of_row[one] : of_row[one + 1]]
                length = first[mine + 1] - first[mine]
                where = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[mine], length)
                common = np.bincount(posting[where], minlength=len(at))[others]
                union = size[one] + size[others] - common
                others = others[(common * share.denominator >= union * share.numerator) & (union > 0)]
                if len(others):
                    links[one] += len(others)
                    links[others] += 1
                    joined = np.unique(label_of[np.append(others, one)])
                    label_of[np.isin(label_of, joined)] = joined[0]
            out += zip(keys[at], keys[at[label_of]], links.tolist(), (part[at] != "").tolist(), strict=True)
        release()
        node, hub, links, split = zip(*out, strict=True)
        return pa.table({"node": pa.array(node, pa.binary()), "hub": pa.array(hub, pa.binary()), "links": pa.array(links, pa.int64()), "split": pa.array(split)})

    return rows.groupBy("pack").applyInArrow(run, "node binary, hub binary, links long, split boolean")


def _joined(docs: DataFrame, n: int, threshold: float, tolerance: float, block_rows: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): each row's key, row_key and doc_id; each distinct text's key, label, text_id, copies and links."""
    least = least_matches(threshold, tolerance)
    rows = stored(_texts(docs, n), "texts")
    classes = rows.groupBy("key").agg(
        F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"), F.max("bytes").alias("bytes"), F.min("row_key").alias("row_key"), F.max("sketch").alias("sketch")
    )
    classes = stored(classes, "classes")
    groups = components(_candidates(classes.where(F.col("sketch").isNotNull()), least, block_rows)).withColumnRenamed("node", "key")
    members = stored(groups.join(classes.select("key", "bytes", "row_key"), "key"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("bytes") / block_bytes))
    sizes = members.groupBy("label").agg(blocks.alias("blocks"))
    packs = 1 + (members.agg(F.sum("bytes")).first()[0] or 0) // block_bytes
    # One row per candidate text, whatever its copies.
    held = _keyed(docs).select("row_key", "text").join(members.select("row_key", "key", "label"), "row_key").dropDuplicates(["row_key"])
    verified = stored(_verify(held.join(sizes, "label").select("label", "blocks", "key", "text"), n, threshold, least, packs), "verified")
    links = verified.groupBy(F.col("node").alias("key")).agg(F.sum("links").alias("n_links"))
    chained = components(verified.where("split").select("node", "hub"))
    label = verified.where(~F.col("split")).select("node", F.col("hub").alias("label")).unionByName(chained).withColumnRenamed("node", "key")
    found = classes.drop("bytes", "sketch").join(links, "key", "left").join(label, "key", "left")
    return rows, stored(found.withColumn("label", F.coalesce("label", "key")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))), "joined")


def ngram_join(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, class_id, text_id, n_copies, n_links.

    class_id: smallest doc_id of the documents joined to it by a chain of links; text_id: smallest doc_id with
    the same text; n_copies: documents with that text; n_links: other texts of a similarity of ``threshold`` or
    more. Words are lower-cased (ASCII) runs without white space; a text of fewer than ``n`` words has one gram,
    a null text is empty, a text without words has no links. Repeated rows are copies; a null doc_id names a
    class only where there is no other. An empty table gives an empty result; other columns are not read.
    """
    rows, texts = _joined(docs, n, threshold, tolerance, block_rows, block_bytes)
    named = texts.join(texts.groupBy("label").agg(F.min("text_id").alias("class_id")), "label")
    return rows.select("key", "doc_id").join(named.drop("row_key"), "key").select("doc_id", "class_id", "text_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of each class of near duplicates one row, that of the smallest doc_id (nulls last), with the columns of ``docs``.

    Rows equal in id and text but not in other columns: the one whose whole row has the smallest digest. Null and empty
    texts are copies of each other and one of them stays, as one of any texts without words that are equal does. An
    empty table gives an empty result; texts count whole, whatever their length; extra columns of any name stay.
    """
    rows, texts = _joined(docs, n, threshold, tolerance, block_rows, block_bytes)
    named = rows.select("key", "row_key", "doc_id").join(texts.select("key", "label"), "key")
    chosen = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first"))
    kept = docs.select(F.struct("*").alias("whole"), "doc_id", "text", row_key(docs).alias("digest"))
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    kept = kept.select("whole", "digest", F.unhex(F.md5(row.cast("binary"))).alias("row_key")).join(chosen.select("first.row_key"), "row_key")
    kept = kept.groupBy("row_key").agg(F.min_by("whole", "digest").alias("whole"))
    return kept.select(*(F.col("whole")[c].alias(c) for c in docs.columns))
