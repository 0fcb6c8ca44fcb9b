"""Quality of documents: a document classifier's evidence combined with empirical-Bayes rates of hosts and paths.

1. Evidence. Shape features of the whole text (length, distinct words, capitals, symbols, digits, word length, line
   length) are cut into fixed bins; naive Bayes on grouped counts of labelled rows gives a log-likelihood ratio, and
   the share of good labels among rows of about equal ratio turns it into a calibrated probability.
2. Sites. Hosts, and paths within hosts, have rates of good documents: sums of those probabilities, added up by
   grouping. The spread of rates between hosts beyond what chance explains (method of moments) says how many
   documents the global rate is worth to a host, and the host's rate to a path; sparse sites shrink most.
3. Posterior. log-odds of the path's posterior rate without the document itself, plus the document's evidence.

Only grouped sums reach the driver: bins of features and ratios, and two variances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfield.llm.stage import stored
from rankfield.llm.text import Words, slices

#: Upper ends of the bins of each feature.
BINS = {
    "words": [0, 4, 8, 16, 32, 64, 128, 256, 1024, 4096],
    "distinct": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "capitals": [0.0, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64],
    "symbols": [0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32],
    "stops": [0.0, 0.01, 0.02, 0.04, 0.08, 0.16],
    "digits": [0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "word_bytes": [2, 3, 4, 5, 6, 7, 8, 10, 14],
    "line_words": [2, 4, 8, 16, 32, 64, 128, 256],
}
RATIO_STEP = 1.0
RATIO_LIMIT = 40.0

_KIND = np.zeros(256, np.int64)  # 1 capital, 2 other symbol, 3 full stop or comma, 4 digit, 5 line end
for _b in range(33, 127):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.isupper() else 4 if _c.isdigit() else 3 if _c in ".,;:'" else 2 if not _c.isalpha() else 0
_KIND[10] = 5


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """Bin numbers of every feature of every text."""
    words = Words(column, lower=True)
    raw = Words(column).data
    row = np.repeat(np.arange(words.rows), np.diff(words.offsets))
    kinds = np.bincount(row * 6 + _KIND[raw], minlength=words.rows * 6).reshape(-1, 6)
    size = np.maximum(np.diff(words.offsets), 1)
    n = words.count
    hashes = words.hashes()
    order = np.lexsort((hashes, words.row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (words.row[order][1:] != words.row[order][:-1])
    distinct = np.bincount(words.row[order][new], minlength=words.rows)
    letters = np.bincount(words.row, words.end - words.start, words.rows)
    values = {
        "words": n, "distinct": distinct / np.maximum(n, 1), "capitals": kinds[:, 1] / size, "symbols": kinds[:, 2] / size, "stops": kinds[:, 3] / size,
        "digits": kinds[:, 4] / size, "word_bytes": letters / np.maximum(n, 1), "line_words": n / (kinds[:, 5] + 1),
    }
    return {name: np.searchsorted(BINS[name], values[name]) for name in BINS}


def _binned(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but the text, and ``bins``."""
    names = [n for n in docs.columns if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bins = np.stack(list(features(part["text"]).values()), axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1) * len(BINS), pa.int32()), pa.array(bins.reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([part[n] for n in names] + [lists], [*names, "bins"])

    return docs.mapInArrow(run, T.StructType([docs.schema[n] for n in names] + [T.StructField("bins", T.ArrayType(T.IntegerType()))]))


def _ratio(labelled: DataFrame) -> Column:
    """Naive Bayes on counts per feature and bin, each with one added; a column over ``bins``."""
    counts = labelled.select("label", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()
    good, bad = (max(1, sum(r[x] for r in counts if r["feature"] == 0)) for x in ("good", "bad"))
    total = F.lit(0.0)
    for number, edges in enumerate(BINS.values()):
        table = {r["bin"]: r for r in counts if r["feature"] == number}
        bins = len(edges) + 1
        logs = [float(np.log(((table[b]["good"] if b in table else 0) + 1) / (good + bins)) - np.log(((table[b]["bad"] if b in table else 0) + 1) / (bad + bins))) for b in range(bins)]
        total = total + F.element_at(F.array(*map(F.lit, logs)), F.element_at("bins", number + 1) + 1)
    return F.greatest(F.lit(-RATIO_LIMIT), F.least(F.lit(RATIO_LIMIT), total))


def _calibrated(labelled: DataFrame, prior: float, ratio: Column) -> Column:
    """P(good | ratio): shares of good labels in steps of the ratio, made to rise with it by pooling neighbours."""
    step = F.floor(ratio / RATIO_STEP).cast("int")
    rows = labelled.groupBy(step.alias("step")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("step").collect()
    if not rows:
        return F.lit(prior)
    pools: list[list[float]] = []
    for r in rows:
        pools.append([r["good"] + prior, r["n"] + 1.0, r["step"]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            good, n, _ = pools.pop()
            pools[-1][0] += good
            pools[-1][1] += n
    out = F.lit(pools[0][0] / pools[0][1])
    for good, n, first in pools[1:]:
        out = F.when(step >= int(first), F.lit(good / n)).otherwise(out)
    return out


def _worth(sites: DataFrame, rate: Column, centre: Column) -> float:
    """How many documents the centre is worth: p (1 - p) over the variance between sites, by moments; at most a million."""
    chance = centre * (1 - centre) / F.col("n")
    row = sites.agg(F.sum(F.col("n") * ((rate - centre) ** 2 - chance)).alias("extra"), F.sum("n").alias("n"), F.sum(F.col("n") * centre * (1 - centre)).alias("spread")).first()
    if not row["n"] or row["extra"] <= 0:
        return 1e6
    return float(min(1e6, max(1.0, row["spread"] / row["extra"] - 1)))


def site_quality(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, host, path, evidence (log-odds), host_rate, path_rate, score, keep.

    ``labels``: doc_id and label (1 good, 0 bad; of several the largest; nulls are left out). A null text is empty, a
    null host or path is a site of its own, repeated rows count each. Without labels every probability is one half.
    An empty table gives an empty result; other columns are not read.
    """
    rows = stored(_binned(docs.select("doc_id", host.alias("host"), path.alias("path"), "text")), "shapes")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("long").alias("label"))
    labelled = stored(rows.join(known, "doc_id").select("label", "bins"), "labelled")
    shares = labelled.agg(F.sum("label"), F.count("*")).first()
    prior = ((shares[0] or 0) + 1) / (shares[1] + 2)
    ratio = _ratio(labelled)
    scored = stored(rows.withColumn("p", _calibrated(labelled, prior, ratio)).drop("bins"), "evidence")
    odds = lambda c: F.log(c / (1 - c))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    all_ = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    centre = F.lit(float(all_ if all_ is not None else 0.5))
    host_worth = _worth(hosts, F.col("s") / F.col("n"), centre)
    hosts = hosts.withColumn("host_rate", (F.col("s") + host_worth * centre) / (F.col("n") + host_worth)).select(F.col("host").alias("h"), "host_rate")
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    path_worth = _worth(paths, F.col("s") / F.col("n"), F.col("host_rate"))
    sites = paths.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_rate")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    path_rate = (F.col("s") - F.col("p") + path_worth * F.col("host_rate")) / (F.col("n") - 1 + path_worth)
    logit = F.col("evidence") + odds(F.col("path_rate"))
    out = joined.withColumn("path_rate", path_rate).withColumn("evidence", odds(F.col("p")) - odds(F.lit(prior)))
    out = out.withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("keep"))
