"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its lower-cased words, of neighbouring pairs, and of pairs with
one word left out. Per-coordinate learning rates and an L1 penalty leave few weights other than zero; they are
collected (at most ``dims`` of them) and sent to every task. Scoring reads every whole text, without a shuffle.

Training reads every labelled row. Rows are dealt by ranges of their hashed ids into blocks of about ``block_bytes`` of
text, stored as packed features. A run of ``RUN_BLOCKS`` blocks is one task's work; it hands the state, z and n of
``dims`` coordinates, to the next run by a file in the checkpoint folder. So the fit is that of one pass over all rows in the order of
their hashed ids, whatever the blocks, while a task holds the state and one run at most. Runs follow one another: more
machines do not shorten them, but a row costs little, as few coordinates are beyond the penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfield.llm.stage import folder
from rankfield.llm.text import Words, grams, release, slices

BLOCK_BYTES = 2 << 20
RUN_BLOCKS = 16
#: Labels up to this number are broadcast to the documents.
BROADCAST_LABELS = 1_000_000
DIMS = 1 << 20
GAPS = ((), (1,), (2,))


@dataclass(frozen=True)
class Model:
    """Coordinates other than zero and the intercept; ``dims`` is the number of hash buckets."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    dims: int

    def table(self) -> np.ndarray:
        out = np.zeros(self.dims, np.float32)
        out[self.index] = self.weight
        return out


def _buckets(words: Words, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets and their rows; a feature may come several times."""
    hashes = words.hashes()
    parts = [grams(hashes, words.row, gaps) for gaps in GAPS]
    index = np.concatenate([((h ^ np.uint64(k * 0x51ED27)) >> np.uint64(11)) % np.uint64(dims) for k, (h, _) in enumerate(parts)])
    return index.astype(np.int64), np.concatenate([words.row[at] for _, at in parts])


def features(docs: DataFrame, dims: int) -> DataFrame:
    """The columns of ``docs`` but the text, and ``features``: its distinct buckets, sorted."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField("features", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            index, row = _buckets(Words(part["text"], lower=True), dims)
            both = np.unique(row * dims + index)
            ends = np.searchsorted(both, np.arange(part.num_rows + 1) * dims)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(both % dims, pa.int32()))
            yield pa.RecordBatch.from_arrays([part[n] for n in part.schema.names if n != "text"] + [lists], [*(n for n in part.schema.names if n != "text"), "features"])

    return docs.mapInArrow(run, schema)


def _packed(values: np.ndarray, ends: np.ndarray) -> bytes:
    """Sorted lists of buckets, one after the other, as their first differences by byte planes (high ones are mostly 0)."""
    steps = np.diff(values, prepend=0)
    first = ends[:-1][ends[:-1] < ends[1:]]
    steps[first] = values[first]
    return steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes, ends: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    total = np.cumsum(steps, dtype=np.int64)
    before = np.concatenate(([0], total))[ends[:-1]]
    return total - np.repeat(before, np.diff(ends))


def blocks(texts: DataFrame, dims: int, count: int) -> DataFrame:
    """``texts`` (doc_id, label, turn, text) as one row per block: its run, number, rows, rows of label 1, labels, list lengths, buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def done() -> pa.RecordBatch:
            label, length, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            ends = np.concatenate(([0], np.cumsum(length)))
            row = (at, len(label), int(label.sum()), label.astype(np.uint8).tobytes(), length.astype("<i4").tobytes(), _packed(values, ends))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "rows", "ones", "label", "length", "values"])

        for part in slices(batches, "text"):
            index, row = _buckets(Words(part["text"], lower=True), dims)
            both = np.unique(row * dims + index)
            ends = np.searchsorted(both, np.arange(part.num_rows + 1) * dims)
            block, label, values = part["block"].to_numpy(), part["label"].to_numpy(), (both % dims).astype(np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if parts and block[a] != at:
                    yield done()
                    parts = []
                at = int(block[a])
                parts.append((label[a:b], np.diff(ends[a : b + 1]), values[ends[a] : ends[b]]))
        if parts:
            yield done()

    place = F.floor((F.col("turn").cast("double") / 2.0**64 + 0.5) * count)  # rises with turn
    dealt = texts.withColumn("block", F.least(place, F.lit(count - 1)).cast("long")).repartition(count, "block").sortWithinPartitions("block", "turn", "doc_id")
    packed = dealt.select("block", "label", "text").mapInArrow(run, "block long, rows long, ones long, label binary, length binary, values binary")
    return packed.withColumn("run", F.floor(F.col("block") / RUN_BLOCKS))


@dataclass
class State:
    """FTRL-proximal: z, n, the intercept (without penalty) and the sum of squares of its gradients."""

    z: np.ndarray
    n: np.ndarray
    bias: float
    bias_n: float
    dims: int
    alpha: float
    beta: float
    l1: float
    l2: float

    def active(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates among ``x`` whose weights are not zero, and these."""
        at = x[np.abs(self.z[x]) > self.l1]
        z = self.z[at]
        return at, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def walk(self, values: np.ndarray, ends: np.ndarray, y: np.ndarray) -> None:
        """Learn the rows in the given order, once."""
        for a, b, label in zip(ends[:-1].tolist(), ends[1:].tolist(), y.tolist(), strict=True):
            x = values[a:b]
            at, w = self.active(x)
            g = 1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -30, 30))) - label
            n = self.n[at]
            self.z[x] += g
            self.z[at] -= (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
            self.n[x] += g * g
            self.bias_n += g * g
            self.bias -= 0.1 * g / np.sqrt(self.bias_n)


STATE = "z binary, n binary, bias double, bias_n double"


def _learn(run: DataFrame, before: DataFrame, start: State) -> DataFrame:
    """The one row of the state after the blocks of a run, in their order. ``start`` has the sizes and parameters."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = start
        for batch in batches:
            for row in range(batch.num_rows):
                at = {n: batch[n][row] for n in batch.schema.names}
                if at["block"].as_py() < 0:  # the state comes first
                    z, n = (np.frombuffer(at[k].as_buffer()).copy() for k in ("z", "n"))
                    own = replace(start, z=z, n=n, bias=at["bias"].as_py(), bias_n=at["bias_n"].as_py())
                    continue
                if not len(own.z):
                    own = replace(start, z=np.zeros(start.dims), n=np.zeros(start.dims))
                ends = np.concatenate(([0], np.cumsum(np.frombuffer(at["length"].as_buffer(), "<i4"), dtype=np.int64)))
                own.walk(_unpacked(at["values"].as_buffer(), ends), ends, np.frombuffer(at["label"].as_buffer(), np.uint8))
        release()
        yield pa.RecordBatch.from_arrays([pa.array([own.z.tobytes()]), pa.array([own.n.tobytes()]), pa.array([float(own.bias)]), pa.array([float(own.bias_n)])], ["z", "n", "bias", "bias_n"])

    rows = run.select("block", "label", "length", "values").unionByName(before.withColumn("block", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.coalesce(1).sortWithinPartitions("block").mapInArrow(walk, STATE)


def _weights(state: DataFrame, start: State) -> tuple[np.ndarray, np.ndarray, float]:
    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, n = (np.frombuffer(batch[k][0].as_buffer()) for k in ("z", "n"))
            index, weight = replace(start, z=z, n=n).active(np.arange(len(z)))
            yield pa.RecordBatch.from_arrays([pa.array([index.tobytes()]), pa.array([weight.tobytes()]), batch["bias"]], ["index", "weight", "bias"])

    row = state.mapInArrow(active, "index binary, weight binary, bias double").first()
    return np.frombuffer(row["index"], np.int64), np.frombuffer(row["weight"]).astype(np.float32), float(row["bias"])


def train(
    docs: DataFrame, labels: DataFrame, *, dims: int = DIMS, epochs: int = 5, block_bytes: int = BLOCK_BYTES,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0,
) -> Model:
    """Fit on ``labels`` (doc_id, label 0 or 1; of several labels of a document the largest; nulls are left out).

    Of several rows of a document the one with the smallest digest of its text is learnt. Without any labelled row
    the model has no weights and scores one half. The driver receives the weights
    other than zero, at most ``dims``.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    few = labels.count() <= BROADCAST_LABELS
    learnt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen) if few else chosen, "doc_id")
    size = learnt.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).agg(F.sum("size")).first()[0]
    if size is None:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), 0.0, dims)
    count = 1 + size // block_bytes
    # Combined before the shuffle: a document that holds many rows sends one from each task.
    once = learnt.groupBy("doc_id", "label").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("digest"), "text")).alias("row"))
    path = folder(docs.sparkSession, "toxicity-blocks")
    packed = blocks(once.select("doc_id", "label", F.xxhash64(F.lit(7), "doc_id").alias("turn"), "row.text"), dims, count)
    packed.write.partitionBy("run").parquet(path)
    read = docs.sparkSession.read.schema(packed.drop("run").schema)
    runs = docs.sparkSession.read.schema(packed.schema).parquet(path).groupBy("run").agg(F.sum("rows").alias("rows"), F.sum("ones").alias("ones")).orderBy("run").collect()
    prior = np.clip(sum(r["ones"] for r in runs) / sum(r["rows"] for r in runs), 1e-3, 1 - 1e-3)
    start = State(np.empty(0), np.empty(0), float(np.log(prior / (1 - prior))), 1.0, dims, alpha, beta, l1, l2)
    states = [folder(docs.sparkSession, f"toxicity-state-{k}") for k in range(2)]  # written in turn
    state = docs.sparkSession.createDataFrame([], STATE)
    for k, r in enumerate([r for _ in range(epochs) for r in runs]):
        _learn(read.parquet(f"{path}/run={r['run']}"), state, start).write.mode("overwrite").parquet(states[k % 2])
        state = docs.sparkSession.read.schema(STATE).parquet(states[k % 2])
    return Model(*_weights(state, start), dims)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text. A null or empty text has the intercept's."""
    sent = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias, model.dims))
    kept = [f for f in docs.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, dims = Model(*sent.value).table(), sent.value[3]
        for part in slices(batches, "text"):
            index, row = _buckets(Words(part["text"], lower=True), dims)
            hit = table[index] != 0
            both = np.unique(row[hit] * dims + index[hit])
            total = np.bincount(both // dims, table[both % dims], part.num_rows) + sent.value[2]
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([part[f.name] for f in kept] + [pa.array(p)], [*(f.name for f in kept), column])

    return docs.mapInArrow(run, schema)


def held_out() -> F.Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **parameters) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Only text is an input of a score. Repeated rows are scored alike, a null doc_id is kept and not held out,
    an empty table gives an empty result, extra columns are not read.
    """
    model = train(docs, labelled(labels), **parameters)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **parameters) -> DataFrame:
    """The rows of ``docs`` whose texts score below ``threshold``, with the same columns."""
    model = train(docs, labelled(labels), **parameters)
    return score(docs, model, "_toxicity").where(F.col("_toxicity") < threshold).drop("_toxicity")
