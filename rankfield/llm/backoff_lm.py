"""Language-model scores by a weighted backoff automaton over whole texts.

States are contexts of up to ``order`` - 1 tokens that training texts hold. An arc on a token has the smoothed
weight of the n-gram; a state without an arc for the token has a failure arc, which costs its backoff weight and
leads to the state of the context without its first token. With c for counts,

    P(w | h) = (c(hw) + mass * P(w | h')) / (c(h) + mass),    P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

so a failure arc of h weighs mass / (c(h) + mass).

The automaton of a corpus fits no task. Texts are dealt into slices of about ``slice_bytes``; a slice asks for the
counts of its distinct n-grams by packed arrays of hashes, one per range of hashes. The ranges add up the training
counts of all slices and answer in the order asked, and each slice builds its part of the automaton and is
traversed once. What is shuffled are arrays of distinct n-grams per slice, so a frequent word costs no more than
one entry of each slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.llm.stage import stored
from rankfield.llm.text import BASE, Words, mix, release, slices

SLICE_BYTES = 8 << 20
RANGE_BYTES = 12 << 20
END = np.uint64(0xE0D0_7E17_0000_0001)
#: Additive constant of the unigram base.
ADDED = 0.1


class Grams:
    """Hashes of the n-grams that end at each token of the texts of a slice; a text's tokens are its words, then END."""

    def __init__(self, column: pa.Array, order: int) -> None:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        parts = [(w.hashes(), w.count) for w in (Words(p["text"], lower=True) for p in slices(iter([batch]), "text"))]
        hashes, count = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64) for i in (0, 1))
        count = count.astype(np.int64)
        rows, n = len(count), len(hashes) + len(count)
        self.row = np.repeat(np.arange(rows), count + 1)
        self.last = np.cumsum(count + 1) - 1
        token = np.full(n, END, np.uint64)
        inner = np.ones(n, bool)
        inner[self.last] = False
        token[inner] = hashes
        self.first = np.zeros(n, bool)
        self.first[self.last - count] = True
        place = np.arange(n) - (self.last - count)[self.row]
        #: By length k: the hash of the last k tokens, and whether there are so many (one END may stand before a text).
        self.hash, self.there = [token], [np.ones(n, bool)]
        for k in range(2, order + 1):
            before = np.empty(n, np.uint64)
            before[1:] = self.hash[-1][:-1]
            if k == 2:
                before[self.first] = END
            self.hash.append(mix(before * BASE + token + np.uint64(k)))
            self.there.append(place >= k - 2)

    def distinct(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sorted distinct hashes of all lengths, and for each length the entry of every token (-1: too short)."""
        every, entry = np.unique(np.concatenate([h[t] for h, t in zip(self.hash, self.there, strict=True)]), return_inverse=True)
        out, at = [], 0
        for there in self.there:
            own = np.full(len(there), -1, np.int64)
            size = int(there.sum())
            own[there] = entry[at : at + size]
            at += size
            out.append(own)
        return every, out


def _edges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of 64-bit values begins in sorted hashes."""
    inner = [(r << 64) // ranges for r in range(1, ranges)]
    return np.concatenate(([0], np.searchsorted(hashes, np.array(inner, np.uint64)), [len(hashes)])).astype(np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or counts.max() < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _asked(texts: DataFrame, order: int, ranges: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        column = table["text"].combine_chunks()
        grams = Grams(column, order)
        every, entries = grams.distinct()
        learnt = ~table["held_out"].to_numpy(zero_copy_only=False)[grams.row]
        times = table["times"].to_numpy()[grams.row]
        counts, single = np.zeros(len(every), np.int64), np.zeros(len(every), bool)
        for k, entry in enumerate(entries):
            used = learnt & (entry >= 0)
            counts += np.bincount(entry[used], times[used], len(every)).astype(np.int64)
            if k == 0:
                single[entry[entry >= 0]] = True
        edges = _edges(every, ranges)
        rows = [(table["slice"][0].as_py(), r, every[a:b].tobytes(), _narrow(counts[a:b]), np.packbits(single[a:b]).tobytes()) for r, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["slice", "range", "hashes", "counts", "single"])

    return texts.groupBy("slice").applyInArrow(run, "slice long, range int, hashes binary, counts binary, single binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(slice, range, counts) for every question, and a row of slice null with the range's tokens and distinct words."""

    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        counts = np.concatenate([_wide(x) for x in table["counts"].to_pylist()])
        every, entry = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(entry, counts, len(every)).astype(np.int64)
        single = np.zeros(len(every), bool)
        single[entry[np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) for x, h in zip(table["single"].to_pylist(), lists, strict=True)]).astype(bool)]] = True
        ends = np.cumsum([len(h) for h in lists])
        answers = [_narrow(total[e]) for e in np.split(entry, ends[:-1])]
        number = table["range"][0].as_py()
        words = total[single]
        return pa.table({
            "slice": pa.array([*table["slice"].to_pylist(), None], pa.int64()), "range": pa.array([number] * (len(lists) + 1), pa.int32()), "counts": pa.array([*answers, None], pa.binary()),
            "tokens": pa.array([None] * len(lists) + [int(words.sum())], pa.int64()), "kinds": pa.array([None] * len(lists) + [int((words > 0).sum())], pa.int64()),
        })

    return asked.groupBy("range").applyInArrow(run, "slice long, range int, counts binary, tokens long, kinds long")


class Automaton:
    """The part of the automaton that a slice meets: arc weights by n-gram and failure weights by context."""

    def __init__(self, counts: np.ndarray, tokens: int, kinds: int, mass: float) -> None:
        self.counts, self.mass = counts, mass
        self.log_base = lambda c: np.log10((c + ADDED) / (tokens + ADDED * (kinds + 1)))

    def traverse(self, grams: Grams, entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every token: log10 of its probability, of its base probability, and its training count.

        The state before a token is the longest known context. A token without an arc there takes failure arcs,
        adding their weights, down to a state that has one; each state's arcs hold the weights of all lower ones.
        """
        count = self.counts[entries[0]]
        base = self.log_base(count)
        # Arc weights from the shortest context up; ``found``: the context is a state.
        weight = [base]
        state, context = [np.ones(len(base), bool)], [np.zeros(len(base), np.int64)]
        for k in range(1, len(entries)):
            before = np.full(len(base), -1, np.int64)
            before[1:] = entries[k - 1][:-1]
            if k == 1:
                before[grams.first] = entries[0][grams.last[grams.row[grams.first]]]
            known = (entries[k] >= 0) & (before >= 0)
            c = np.where(known, self.counts[before], 0)
            full = np.where(known, self.counts[entries[k]], 0)
            weight.append(np.log10((full + self.mass * 10.0 ** weight[-1]) / (c + self.mass)))
            state.append(c > 0)
            context.append(c)
        out = np.zeros(len(base))
        level = np.zeros(len(base), np.int64)
        for k in range(1, len(entries)):
            level[state[k]] = k
        waiting = np.ones(len(base), bool)
        for k in range(len(entries) - 1, -1, -1):
            here = waiting & (level == k)
            arc = here if k == 0 else here & (entries[k] >= 0) & (self.counts[entries[k]] > 0)
            out[arc] += weight[k][arc]
            failed = here & ~arc
            out[failed] += np.log10(self.mass / (context[k][failed] + self.mass))
            level[failed] = k - 1
            waiting &= ~arc
        return out, base, count


def _scored(texts: DataFrame, answers: DataFrame, tokens: int, kinds: int, order: int, mass: float) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = Grams(left["text"].combine_chunks(), order)
        _, entries = grams.distinct()
        by_range = np.argsort(right["range"].to_numpy())
        parts = right["counts"].to_pylist()
        counts = np.concatenate([_wide(parts[i]) for i in by_range])
        score, base, count = Automaton(counts, tokens, kinds, mass).traverse(grams, entries)
        release()
        rows = left.num_rows
        total = lambda x: pa.array(np.bincount(grams.row, x, rows))
        whole = lambda x: pa.array(np.bincount(grams.row, x, rows).astype(np.int64))
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "times": left["times"], "n_tokens": whole(np.ones(len(base))), "n_known": whole(count > 0), "train_tokens": pa.array(np.full(rows, tokens)), "base_score": total(base), "score": total(score)})

    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, held_out boolean, times long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, schema)


def held_out() -> Column:
    """crc32 of the id as text, modulo 10, is 0. A null id is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def _dealt(texts: DataFrame, slices: int, slice_bytes: int) -> tuple[DataFrame, bool]:
    """``texts`` with ``slice`` and ``times``, and whether a row may stand for several.

    Equal rows hash alike. Where they have more than a quarter of a slice together, one row with their number stands
    for them; they are combined before the shuffle, and all other rows stay where they are.
    """
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    sums = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text") + 16).alias("size"))
    heavy = stored(sums.where((F.col("rows") > 1) & (F.col("size") > slice_bytes // 4)).select("key"), "repeated")
    repeated = not heavy.isEmpty()
    out = keyed.withColumn("times", F.lit(1).cast("long"))
    if repeated:
        once = keyed.join(F.broadcast(heavy), "key", "left_semi").groupBy("doc_id", "text", "held_out", "key").agg(F.count("*").alias("times"))
        out = out.join(F.broadcast(heavy), "key", "left_anti").unionByName(once)
    return out.withColumn("slice", F.pmod("key", F.lit(slices))).drop("key"), repeated


def lm_scores(docs: DataFrame, *, order: int = 2, mass: float = 20.0, held: Column | None = None, slice_bytes: int = SLICE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased (ASCII) runs without white space, then one end. Counts come from all whole texts that
    aren't ``held``. A null or empty text has the end alone. Repeated rows count, and are scored, each. Without
    training tokens every token has the base of a count of 0. An empty table gives an empty result; extra columns
    are not read. ``mass``: how many tokens the shorter context's distribution counts for.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (held_out() if held is None else held).alias("held_out"))
    size = texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    slices = 1 + size // slice_bytes
    texts, repeated = _dealt(texts, slices, slice_bytes)
    answers = stored(_answered(_asked(texts, order, 1 + size // range_bytes)), "answers")
    tokens, kinds = answers.agg(F.sum("tokens"), F.sum("kinds")).first()
    out = _scored(texts, answers.where(F.col("slice").isNotNull()).select("slice", "range", "counts"), tokens or 0, kinds or 0, order, mass)
    if repeated:  # one row for each time again, in steps that bound the arrays
        out = out.withColumn("step", F.explode(F.expr("sequence(0L, (times - 1) div 65536)")))
        out = out.withColumn("step", F.explode(F.expr("sequence(1L, least(65536L, times - step * 65536))"))).drop("step")
    return out.drop("times")
