"""Mixing sources to target weights by exact quotas and a multivariate-hypergeometric splitting tree.

The documents of a source, in the order of a keyed digest, are a stream of words, repeated as often as the
source's target asks for. The stream is cut into blocks of ``block_words``; a source's quota is a whole number
of blocks (the last one shorter; larger blocks where there would be over MOST_BLOCKS). A binary tree over the output shards splits the quotas: at each node the left
half's share of every source is one draw of the multivariate hypergeometric distribution, seeded by the node, so
a shard finds its own quotas, and where they begin, by walking down from the root. Blocks are permuted within
their source by a keyed Feistel network and dealt by those ranges, hence disjoint; inside a shard they are shuffled
by a hash.

The driver holds one row per source (counts and targets), never per document; more than MOST_SOURCES are refused.
Null texts have no words; rows without words are placed but never taken. Texts of any length are counted whole. Equal rows
are documents of their own and spread over tasks. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.llm.ordered import numbered
from rankfield.llm.stage import row_key, stored
from rankfield.llm.text import mix as scrambled

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 4096
SHARD_BLOCKS = 1024
#: numpy draws from fewer than 1e9 blocks.
MOST_BLOCKS = 1 << 29
MOST_SOURCES = 100_000
ROUNDS = 4
HOT_SHARE = 1000


@dataclass(frozen=True)
class Source:
    name: str | None
    rows: int
    size: int
    target: float

    @property
    def quota(self) -> int:
        """Words to take: the target, rounded."""
        return int(self.target + 0.5)


def targets(sizes: list[int], weights: list[int], limit: int) -> list[float]:
    """Share all words by weight; none above ``limit`` times its size, the excess shared again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > limit * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(limit * sizes[i])
            left -= out[i]
        free -= over
    return out


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, turn, key): words of each text, its place in the order of its source, and a digest of the whole row."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(text.cast("binary"))
    turn = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), digest).cast("binary"))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), turn.alias("turn"), row_key(docs).alias("key"))


def source_table(rows: DataFrame, weights: tuple[int, ...], limit: int) -> list[Source]:
    """Sources by code point, null last, with their targets."""
    found = rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], limit)
    return [Source(r["source"], r["rows"], r["size"], t) for r, t in zip(found, wanted, strict=True)]


def _numbered(spark: SparkSession, sources: list[Source]) -> DataFrame:
    rows = [(i, s.name, s.size, s.target, s.quota) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "number int, source string, source_size long, target double, quota long")


def placed(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """Add each row's source columns and ``begin``, its first word's place in one pass over its source.

    Rows are dealt by ranges of (source, turn), so neither a large source nor many equal rows meet in one task.
    """
    table = F.broadcast(_numbered(rows.sparkSession, sources)).alias("s")  # one row per source, at most MOST_SOURCES
    rows = rows.alias("r").join(table, F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.number", "s.source_size", "s.target", "s.quota")
    return numbered(rows, "number", ["turn", "key"], weight="size").drop("pos")


def leaf(shard: int, shards: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of every source in a shard, by walking the splitting tree."""
    total, low, high = int(quotas.sum()), 0, shards
    begin = np.zeros(len(quotas), np.int64)
    until = lambda k: total * k // shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(quotas, until(middle) - until(low), method="marginals") if len(quotas) else quotas
        if shard < middle:
            quotas, high = left, middle
        else:
            begin, quotas, low = begin + left, quotas - left, middle
    return begin, quotas


def dealt(spark: SparkSession, sources: list[Source], *, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """(number, block, shard, slot): the shard of every block of every source, and a random place in it."""
    quotas = np.array([-(-s.quota // block_words) for s in sources], np.int64)
    shards = max(1, -(-int(quotas.sum()) // shard_blocks))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                begin, blocks = leaf(int(shard), shards, quotas, seed)
                for i in np.flatnonzero(blocks).tolist():
                    turns = np.arange(begin[i], begin[i] + blocks[i])
                    yield pd.DataFrame({"number": np.int32(i), "block": permuted(turns, int(quotas[i]), seed * MOST_SOURCES + i), "shard": shard})

    return spark.range(shards).mapInPandas(run, "number int, block long, shard long").withColumn("slot", F.xxhash64(F.lit(seed), "number", "block"))


def permuted(places: np.ndarray, total: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0 .. total - 1 sends each place: a Feistel network on the next even number of bits.

    A value beyond the total is sent on until it falls below, which keeps the map one to one.
    """
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = scrambled(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(ROUNDS * key))
    out = np.asarray(places, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (scrambled(right + k) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def repeats(rows: DataFrame) -> DataFrame:
    """One row per pass over a placed document that the mix takes (a part of): ``at``, its place in the endless stream, and ``words``."""
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("source_size")) - 1))
    taken = rows.where((F.col("size") > 0) & (F.col("quota") > 0)).withColumn("pass", passes)
    taken = taken.withColumn("at", F.col("pass") * F.col("source_size") + F.col("begin"))
    return taken.withColumn("words", F.least("size", F.col("quota") - F.col("at"))).where("words > 0")


def pieces(rows: DataFrame, blocks: DataFrame, block_words: int) -> DataFrame:
    """What each shard holds: number, begin (together the document), pass, first and past-the-last word, shard, slot."""
    size = F.lit(block_words)
    cut = repeats(rows).select("number", "begin", "pass", "at", "words")
    cut = cut.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("words") - 1) / size))))
    low, high = F.greatest("at", F.col("block") * size), F.least(F.col("at") + F.col("words"), (F.col("block") + 1) * size)
    return cut.withColumn("first", low - F.col("at")).withColumn("last", high - F.col("at")).join(blocks, ["number", "block"]).select("number", "begin", "pass", "first", "last", "shard", "slot")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): placed documents with their sources' sizes and targets, and what each shard takes of them.

    ``weights`` repeat over the sources by code point, null last. A null text has no words; rows without
    words are placed but never taken. Repeated rows are documents of their own. Equal input gives an equal mix.
    """
    rows = stored(sized(docs, seed), "sized")
    sources = source_table(rows, weights, limit)
    rows = stored(placed(rows, sources), "placed")
    block_words = max(block_words, -(-sum(s.quota for s in sources) // MOST_BLOCKS))
    blocks = dealt(docs.sparkSession, sources, block_words=block_words, shard_blocks=shard_blocks, seed=seed)
    return rows, pieces(rows, blocks, block_words)


def shares(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words in all shards)."""
    rows, held = mix(docs, **parameters)
    taken = held.groupBy("number", "begin").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = rows.join(taken, ["number", "begin"], "left")
    none: Column = F.lit(0).cast("long")
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", none)).otherwise(none).alias("taken"))


def mixed(docs: DataFrame, *, seed: int = 17, **parameters) -> DataFrame:
    """The mix as rows with the columns of ``docs``, whatever their names: a document comes once for each pass that takes it.

    Texts stay whole: the document in which a source's quota ends is kept if most of its words are within, else
    left out, so a source has its share of words to within half a document. Rows come by shard, shuffled inside; a
    document goes to the shard of its first block.
    """
    rows, held = mix(docs, seed=seed, **parameters)
    whole = held.groupBy("number", "begin", "pass").agg(F.sum(F.col("last") - F.col("first")).alias("words"), F.min_by(F.struct("shard", "slot"), "first").alias("home"))
    # Only rows without words share ``begin``, and those are never taken.
    named = whole.join(rows.where("size > 0").select("number", "begin", "key", "size"), ["number", "begin"]).where(2 * F.col("words") >= F.col("size"))
    named = stored(named.select("key", "home.*"), "homes")
    uses = named.groupBy("key").agg(F.count("*").alias("n"))
    least = F.lit((named.count() or 1) / HOT_SHARE)
    hot = F.broadcast(uses.where(F.col("n") > least).select("key", F.ceil(F.col("n") / least).cast("int").alias("parts")))  # fewer than HOT_SHARE keys
    parts = F.coalesce("parts", F.lit(1))
    turn = F.pmod(F.xxhash64("shard", "slot"), parts).alias("part")
    named = named.join(hot, "key", "left").select("key", "shard", "slot", turn)
    # One row per key, as rows of one key are equal; those taken very often once per part.
    source = docs.select(F.struct("*").alias("whole"), row_key(docs).alias("key")).dropDuplicates(["key"]).join(hot, "key", "left")
    source = source.select("whole", "key", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"))
    joined = source.join(named, ["key", "part"]).select("whole", "shard", "slot")
    return joined.repartition("shard").sortWithinPartitions("shard", "slot").select(*(F.col("whole")[c].alias(c) for c in docs.columns))
