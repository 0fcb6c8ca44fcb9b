"""A Merkle manifest of documents: a tree of digests per source, and one over the sources.

A level is one row per node with its place in the tree. Lag and lead columns of one and two rows, masked by the
node's slot in its run of three and by the run's length, are its siblings; the first child of a run hashes the parent,
which is a row of the next level. Windows are cut at multiples of SPAN places, which no run crosses, so a source of any
size spreads over tasks. From the roots down, each node's siblings are put before those of its parent, so a
document ends with its whole way to the root.

Digests are SHA-256 in lower-case hex, over the concatenation of texts. Null columns count as ``-``, empty texts as
``0:``; a null source is a branch of its own and the first; null ids come first within a source; rows of equal id follow by
their leaves, so repeated rows are leaves of their own. An empty table gives an empty result. Texts of any
length are hashed once, by Spark, and don't move. Columns beside the five are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.ordered import numbered
from rankfield.llm.stage import stored

ARITY = 3
SPAN = ARITY**6


def sha(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def framed(column: Column) -> Column:
    """A value with its length in bytes before it, so that no two lists of values read alike."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The digest of a document that has this text."""
    return sha(*(framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), framed(text))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees of (branch, pos, size, digest, ...), leaves first.

    A level has ``before`` and ``after``, the digests of a node's siblings on either side, one after another. A node alone on
    its level (``size`` 1) is its tree's root and has no parent.
    """
    out, nodes = [], leaves
    while True:
        run = Window.partitionBy("branch", "chunk").orderBy("pos")
        nodes = nodes.withColumn("chunk", F.expr(f"pos div {SPAN}")).withColumn("slot", F.col("pos") % ARITY)
        length = F.least(F.lit(ARITY), F.col("size") - F.col("pos") + F.col("slot"))
        left = [F.when(F.col("slot") >= k, F.lag("digest", k).over(run)) for k in range(ARITY - 1, 0, -1)]
        right = [F.when(F.col("slot") + k < length, F.lead("digest", k).over(run)) for k in range(1, ARITY)]
        level = stored(nodes.withColumns({"before": F.concat_ws("", *left), "after": F.concat_ws("", *right)}).drop("chunk"), "level")
        out.append(level)
        if (level.agg(F.max("size")).first()[0] or 1) == 1:
            return out
        parents = level.where("slot = 0 AND size > 1")
        nodes = parents.select("branch", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"), sha(F.col("digest"), F.col("after")).alias("digest"))


def roots(tree: list[DataFrame]) -> DataFrame:
    """(branch, digest) of every tree."""
    return reduce(DataFrame.unionByName, (level.where("size = 1").select("branch", "digest") for level in tree))


def ways(tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``path``, the siblings (before, after) of every node from the leaf to the root.

    ``above`` has one row per branch: its ``path`` beyond the root, and columns that all leaves of it get.
    """
    gets = [c for c in above.columns if c != "branch"]
    found: DataFrame | None = None
    for level in reversed(tree):
        own = level.columns
        tops = level.where("size = 1").join(above, "branch").select(*own, *gets)
        if found is not None:
            parents = found.select("branch", F.col("pos").alias("up"), *gets)
            below = level.where("size > 1").withColumn("up", F.expr(f"pos div {ARITY}")).join(parents, ["branch", "up"])
            step = F.array(F.struct("before", "after"))
            tops = tops.unionByName(below.select(*own, *(F.concat(step, "path").alias("path") if c == "path" else F.col(c) for c in gets)))
        found = tops
    return found


def manifest(docs: DataFrame, text_now: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, presented, subroot (its source's), root, path.

    ``presented`` is the leaf of the document with ``text_now`` for its text (by default its own).
    """
    text = F.col("text")
    branch = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    leaves = docs.select("doc_id", branch.alias("branch"), leaf(text).alias("digest"), leaf(text if text_now is None else text_now).alias("presented"))
    by_source = levels(numbered(leaves, "branch", ["doc_id", "digest"]))
    subroots = roots(by_source).withColumnRenamed("branch", "name").withColumn("branch", F.lit(0))
    over = levels(numbered(subroots, "branch", ["name"]))
    none = F.array().cast("array<struct<before: string, after: string>>")
    top = ways(over, roots(over).select("branch", F.col("digest").alias("root"), none.alias("path")))
    above = stored(top.select(F.col("name").alias("branch"), F.col("digest").alias("subroot"), "root", "path"), "subroots")
    return ways(by_source, above).select("doc_id", F.col("digest").alias("leaf"), "presented", "subroot", "root", "path")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, digest, lambda found, step: sha(step["before"], found, step["after"]))


def proofs(docs: DataFrame, text_now: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the presented leaf), verified."""
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    found = manifest(docs, text_now).withColumn("folded_root", folded(F.col("presented"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
