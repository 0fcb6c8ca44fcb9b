"""The prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns. Its key is the exclusive or of 128 bits per turn, hashed from the turn's
place, role and text, so prefixes of a conversation are running values that chunks of turns carry on by one value each,
and a conversation of any length spreads over tasks.

Totals: in each round all leaves are raked (their totals go to their parents) and, in chains of nodes with one child,
an independent set chosen by coins is compressed (the child takes its parent's place and carries what the parent adds).
The rounds follow the logarithm of the number of nodes, also for a single long chain. Then the rounds are gone
through backwards: a compressed node's total is that of the child that took its place and what was carried.

Null roles and texts are empty; turns of equal number follow by role and text, a null number comes first; rows without a
conversation id take no part. Repeated rows are turns of their own. Empty tables give an empty result. A text of any length is
hashed once. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.ordered import lookup, numbered
from rankfield.llm.stage import stored

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_TURNS = 1024
RANGE_BITS = 16
#: Rounds whose lineage is kept before a table is written on the way back.
KEPT_ROUNDS = 4


def turns(conversations: DataFrame, more=None) -> DataFrame:  # noqa: ANN001
    """(conv_id, pos, size, mark, words): every turn's place, a digest of its role and text, and its words.

    ``more`` may add columns per conversation, as in ``numbered``.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    mark = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    return numbered(rows, "conv_id", ["turn", "role", "text"], more).withColumns({"mark": mark, "words": words}).drop("turn", "role", "text")


def rebuilt(conversations: DataFrame, base: Column, borrowed: Column) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each conversation with its first ``borrowed`` turns taken from that of id ``base``.

    Of a base without as many turns all are taken, of an absent one none; a conversation's own first ``borrowed`` turns go
    in any case. ``base`` and ``borrowed`` are expressions on conv_id; few conversations may share a base, few turns be borrowed.
    """
    def with_base(spans: DataFrame) -> DataFrame:
        one = spans.dropDuplicates(["conv_id"]).select("conv_id", "size")
        named = one.select("conv_id", base.alias("base"), borrowed.cast("long").alias("h"))
        found = named.join(one.select(F.col("conv_id").alias("base"), F.col("size").alias("there")), "base", "left")
        found = found.withColumn("taken", F.when(F.col("base") == F.col("conv_id"), F.col("h")).otherwise(F.least("h", F.coalesce("there", F.lit(0)))))
        return spans.join(found.drop("there"), "conv_id")

    all_turns = stored(turns(conversations, with_base), "turns")
    kept = F.greatest(F.lit(0).cast("long"), F.col("size") - F.col("h"))
    heads = all_turns.where("pos = 0").withColumn("length", F.when(F.col("base") == F.col("conv_id"), F.col("size")).otherwise(F.col("taken") + kept))
    heads = stored(heads.select("conv_id", "base", "taken", "length"), "conversations")
    same = F.col("base") == F.col("conv_id")
    length = F.when(same, F.col("size")).otherwise(F.col("taken") + kept)
    own = all_turns.where(same | (F.col("pos") >= F.col("h")))
    own = own.select("conv_id", F.when(same, F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), length.alias("length"), "mark", "words")
    most = heads.agg(F.max("taken")).first()[0] or 0
    first = all_turns.where((F.col("pos") < most) & same).select(F.col("conv_id").alias("base"), "pos", "mark", "words")
    lent = heads.where((F.col("base") != F.col("conv_id")) & (F.col("taken") > 0)).join(first, "base").where("pos < taken")
    return heads.select("conv_id", "length"), own.unionByName(lent.select("conv_id", "pos", "length", "mark", "words"))


def key(a: str, b: str) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def prefixes(conversations: DataFrame, marked: DataFrame) -> DataFrame:
    """(conv_id, depth, id, parent, words, ends) of every prefix of every conversation, the empty one included.

    Takes (conv_id, length) and (conv_id, pos, length, mark, words).
    """
    rows = marked.withColumns({"a": F.xxhash64("pos", "mark"), "b": F.xxhash64("mark", "pos"), "chunk": F.expr(f"pos div {CHUNK_TURNS}")})
    rows = stored(rows.drop("mark"), "marks")
    whole = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("a").alias("all_a"), F.bit_xor("b").alias("all_b"))
    so_far = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = whole.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(f"all_{x}").over(so_far), F.lit(0)).alias(f"from_{x}") for x in "ab"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"to_{x}": F.bit_xor(x).over(inside) for x in "ab"}).join(begun, ["conv_id", "chunk"])
    run = run.withColumns({f"to_{x}": F.col(f"to_{x}").bitwiseXOR(F.col(f"from_{x}")) for x in "ab"})
    run = run.withColumns({f"up_{x}": F.col(f"to_{x}").bitwiseXOR(F.col(x)) for x in "ab"})
    nodes = run.select("conv_id", (F.col("pos") + 1).alias("depth"), key("to_a", "to_b").alias("id"), key("up_a", "up_b").alias("parent"), "words", (F.col("pos") + 1 == F.col("length")).alias("ends"))
    zero = F.lit(0).cast("long")
    top = conversations.select("conv_id", zero.alias("depth"), F.lit("0" * 32).alias("id"), F.lit(None).cast("string").alias("parent"), zero.alias("words"), (F.col("length") == 0).alias("ends"))
    return nodes.unionByName(top)


def _coin() -> Column:
    """Drawn anew in each round. The round is a column, so all rounds have one plan and are compiled once."""
    return F.xxhash64("id", "turn").bitwiseAND(F.lit(1)) == 1


def contracted(tree: DataFrame, values: list[str]) -> list[tuple[DataFrame, DataFrame]]:
    """The rounds of a contraction of (id, parent, values...): (raked, compressed) each.

    Raked nodes come with their subtrees' sums; a compressed one (``gone``) with the child in its place (id) and what to
    add to the child's sums.
    """
    zero = F.lit(0).cast("long")
    state = tree.select("id", "parent", zero.alias("turn"), *values, *(zero.alias(f"up_{v}") for v in values))
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while True:
        kids = state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"), F.max("id").alias("only"))
        known = state.join(kids, "id", "left").withColumn("willing", F.coalesce((F.col("kids") == 1) & F.col("parent").isNotNull() & _coin(), F.lit(False)))
        offers = known.where("willing").select(F.col("only").alias("id"), F.col("id").alias("gone"), F.col("parent").alias("above"), *(F.col(c).alias(f"gone_{c}") for v in values for c in (v, f"up_{v}")))
        known = known.join(offers, "id", "left").withColumn("takes", F.col("gone").isNotNull() & F.col("kids").isNotNull() & ~F.col("willing"))
        known = stored(known.drop("only", "willing"), "round")
        raked = known.where("kids IS NULL").select("id", *values)
        taken = known.where("takes")
        rounds.append((raked, taken.select("id", "gone", *((F.col(f"gone_{v}") + F.col(f"up_{v}")).alias(v) for v in values))))
        gains = known.where("kids IS NULL AND parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(*(F.sum(F.col(v) + F.col(f"up_{v}")).alias(f"gain_{v}") for v in values))
        gains = gains.withColumn("left", F.lit(False)).unionByName(taken.select(F.col("gone").alias("id"), *(zero.alias(f"gain_{v}") for v in values), F.lit(True).alias("left")))
        if not known.where("kids IS NOT NULL").limit(1).count():
            return rounds
        rest = known.where("kids IS NOT NULL").join(gains, "id", "left").where("left IS NULL OR NOT left")
        ups = [(F.col(f"up_{v}") + F.when(F.col("takes"), F.col(f"gone_{v}") + F.col(f"gone_up_{v}")).otherwise(zero)).alias(f"up_{v}") for v in values]
        state = rest.select("id", F.when(F.col("takes"), F.col("above")).otherwise(F.col("parent")).alias("parent"), (F.col("turn") + 1).alias("turn"), *((F.col(v) + F.coalesce(f"gain_{v}", zero)).alias(v) for v in values), *ups)


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, values...) of (id, parent, values...): sums over every node's subtree, itself included. ``tree`` is read more than once.

    The parent of a root is null; there may be several. Values are longs without nulls.
    """
    rounds = contracted(tree, values)
    found = rounds[-1][0]
    for i, (raked, compressed) in enumerate(reversed(rounds[:-1]), 1):
        back = found.join(compressed.select("id", "gone", *(F.col(v).alias(f"add_{v}") for v in values)), "id", "left")
        both = F.array(F.struct("id", *values), F.struct(F.col("gone").alias("id"), *((F.col(v) + F.col(f"add_{v}")).alias(v) for v in values)))
        found = back.select(F.explode(both).alias("one")).select("one.*").where("id IS NOT NULL").unionByName(raked)
        if i % KEPT_ROUNDS == 0:
            found = stored(found, "sums")
    return found


def end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of (id, conv_id): the SHA-256 of a node's ids in ascending order, joined by commas.

    Ids of one range are joined first; a task then reads a node's ranges in order and keeps only the state of one digest.
    """
    ranged = ends.groupBy("id", F.shiftright("conv_id", RANGE_BITS).alias("range")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))
    texts = ranged.select("id", "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            ids, digests = [], []
            for other, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if other == node:
                    state.update(b",")
                else:
                    if node is not None:
                        ids.append(node)
                        digests.append(state.hexdigest())
                    node, state = other, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(digests, pa.string())], ["id", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    return texts.repartition("id").sortWithinPartitions("id", "range").mapInArrow(run, "id string, ends_sha256 string")


def trie(conversations: DataFrame, marked: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Takes (conv_id, length), one row per conversation, and (conv_id, pos, length, mark, words), its turns from ``pos`` 0.
    """
    every = stored(prefixes(conversations, marked), "prefixes")
    grouped = every.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = stored(grouped, "nodes")
    uses = stored(nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n")), "children")
    children = uses.select(F.col("parent").alias("id"), F.col("n").alias("n_children"))
    tree = stored(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "tree")
    own = tree.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"])
    named = lookup(tree, "parent", nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), uses)
    ends = end_digests(every.where("ends").select("id", "conv_id"))
    out = named.join(sums, "id").join(ends, "id", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
