import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankfield.llm import fm_decon, maxscore, mixing, ngram_join, queries, toxicity
from rankfield.llm.components import components


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- near duplicates ---------------------------------------------------------------------------
def joined(local):
    """(doc_id, class, text, copies, links) by comparing all pairs of different texts."""
    ids = {}
    for r in local:
        ids.setdefault(r["text"] or "", []).append(r["doc_id"])
    grams = {}
    for t in ids:
        w = words(lower(t))
        grams[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = lambda values: min((v for v in values if v is not None), default=None)
    links, parent = Counter(), {t: t for t in ids}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    texts = list(ids)
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both = len(grams[a] & grams[b])
            if both and both * 5 >= 4 * len(grams[a] | grams[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    names = {}
    for t in texts:
        names.setdefault(root(t), []).extend(ids[t])
    return [(r["doc_id"], least(names[root(r["text"] or "")]), least(ids[r["text"] or ""]), len(ids[r["text"] or ""]), links[r["text"] or ""]) for r in local]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 4, "block_bytes": 4000}])
def test_join_matches_all_pairs(docs, local, sizes):
    got = ngram_join.ngram_join(docs, **sizes)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(joined(local), key=repr)


def test_one_document_of_each_group_stays(docs, local, empty):
    want = joined(local)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    named = {w[1] for w in want if w[1] is not None}
    unnamed = len({r["text"] for r, w in zip(local, want) if w[1] is None})
    got = [r["doc_id"] for r in kept.collect()]
    assert {g for g in got if g is not None} == named and len(got) == len(named) + unnamed
    assert ngram_join.one_of_each(empty).count() == 0 and ngram_join.ngram_join(empty).count() == 0


def test_posterior_keeps_pairs_at_the_threshold():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert (np.diff(least) > 0).all() and least[-1] < 0.8 * ngram_join.VALUES
    draws = np.random.default_rng(1).random((200_000, ngram_join.VALUES)) < 0.8
    seen = np.cumsum(draws, 1)[:, ngram_join.STEP - 1 :: ngram_join.STEP]
    assert (seen < least).any(1).mean() < 1e-4


def test_local_groups_stop_early():
    asked = []

    def near(one):
        asked.append(one)
        return np.arange(50) if one < 50 else np.array([one])

    assert np.bincount(ngram_join.local_groups(52, near)).tolist()[:1] == [50] and len(asked) <= 3


def test_components_of_a_chain(session):
    edges = [(f"{i:03d}", f"{i:03d}") for i in range(60)] + [(f"{i + 1:03d}", f"{i:03d}") for i in range(59)] + [("z", "z")]
    got = {r["node"]: r["label"] for r in components(session.createDataFrame(edges, "node string, hub string")).collect()}
    assert len(got) == 61 and {v for k, v in got.items() if k != "z"} == {"000"} and got["z"] == "z"


# -- mixing --------------------------------------------------------------------------------------
def test_targets_stop_at_the_limit_and_share_the_rest():
    got = mixing.targets([10, 100, 1000, 0], [1, 2, 3, 1], 3)
    assert got == [30, 300, pytest.approx(780), 0] and mixing.targets([], [], 3) == []
    assert mixing.targets([600, 600, 600], [1, 2, 3], 3) == [pytest.approx(300), pytest.approx(600), pytest.approx(900)]


def test_leaves_split_quotas_exactly():
    quotas = np.array([5, 0, 37, 1000])
    leaves = [mixing.leaf(k, 7, quotas, 3) for k in range(7)]
    for source, quota in enumerate(quotas):
        spans = sorted((int(b[source]), int(b[source] + n[source])) for b, n in leaves if n[source])
        assert sum(b - a for a, b in spans) == quota and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    sizes = [int(n.sum()) for _, n in leaves]
    assert max(sizes) - min(sizes) <= 1


def test_shares_come_near_their_targets(docs, local, empty):
    got = mixing.shares(docs, block_words=64, shard_blocks=16)
    rows = got.collect()
    assert len(rows) == len(local) and Counter(r["size"] for r in rows) == Counter(len(words(r["text"])) for r in local)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by_source = {}
    for r in rows:
        by_source.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(taken) - target) <= 1 for (_, target), taken in by_source.items())
    again = mixing.shares(docs.repartition(3), block_words=64, shard_blocks=16).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.shares(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixed_rows_hold_what_shares_say(docs):
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = mixing.mixed(named, block_words=64, shard_blocks=16)
    assert out.columns == named.columns
    texts, taken = {r["doc_id"]: r for r in named.collect()}, Counter()
    for r in out.collect():
        assert r == texts[r["doc_id"]]  # whole texts, and all columns
        taken[r["doc_id"]] += len(words(r["text"]))
    off = {}
    for r in mixing.shares(named, block_words=64, shard_blocks=16).collect():
        if taken[r["doc_id"]] != r["taken"]:  # the document in which its source's quota ends
            off.setdefault(texts[r["doc_id"]]["source"], []).append(2 * abs(taken[r["doc_id"]] - r["taken"]) <= r["size"])
    assert all(x == [True] for x in off.values())


def test_mixed_keeps_rows_apart_that_share_id_and_text(session):
    columns = "doc_id long, text string, lang string, source string, shard string, `key` int, `a.b` int"
    rows = [(None, "w " * 50, "en", s, f"{s}{i}", i, 0) for s in "st" for i in range(8)] + [(None, "w " * 50, "en", "t", "t0", 0, 0)] * 5 + [(7, None, None, None, None, None, None), (8, "", "en", "s", "x", 1, 1)]
    frame = session.createDataFrame(rows, columns).repartition(4)
    out = mixing.mixed(frame, block_words=10, shard_blocks=4)
    assert out.columns == frame.columns
    got = Counter(tuple(r) for r in out.collect())
    by_source = Counter()
    for r, n in got.items():
        assert r in rows
        by_source[r[3]] += n * 50
    want = Counter()
    for r in mixing.shares(frame, block_words=10, shard_blocks=4).collect():
        want[r["source_size"]] += r["taken"]
    sizes = {"s": 8 * 50, "t": 13 * 50}
    assert all(abs(by_source[s] - want[n]) <= 25 for s, n in sizes.items())
    again = mixing.mixed(frame.repartition(2), block_words=10, shard_blocks=4)
    assert Counter(tuple(r) for r in again.collect()) == got


def test_blocks_are_permuted_one_to_one_and_grow_with_the_corpus():
    for total in (1, 2, 3, 10, 1000, 4097):
        got = mixing.permuted(np.arange(total), total, 5)
        assert sorted(got.tolist()) == list(range(total))
    got = mixing.permuted(np.arange(1000), 1000, 5)
    assert len(set(np.diff(got).tolist())) > 500 and (got != mixing.permuted(np.arange(1000), 1000, 6)).any()
    huge = -(-10**13 // max(4096, -(-(10**13) // mixing.MOST_BLOCKS)))
    begin, blocks = mixing.leaf(1, 1000, np.array([huge, 5]), 3)
    assert huge <= mixing.MOST_BLOCKS and blocks.sum() > 0


def test_one_of_each_chooses_by_the_whole_row(session):
    rows = [(1, "some words to keep here now", "en", s, i) for i, s in enumerate(["b", "a", None, "c"] * 6)] + [(5, None, "x", None, 0), (4, None, "y", None, 0), (9, "other words", None, "b", 1)]
    frame = session.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest int")
    got = {frozenset(ngram_join.one_of_each(frame.repartition(n)).collect()) for n in (1, 5, 3)}
    assert len(got) == 1 and sorted(r["doc_id"] for r in next(iter(got))) == [1, 4, 9]


# -- top-k search ----------------------------------------------------------------------------------
def test_top_k_matches_all_products(session):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 306)] + [(50, rows[3][1]), (310, [1.0, float("nan")] * 3), (320, None), (330, [1.0, None] * 3), (340, [1e9] * 6), (350, [1.0, 2.0]), (400, [2.0, -1.0]), (None, rows[1][1]), (370, []), (380, [0.0] * 6)]
    frame = session.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("score", F.lit(1))
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, (i, v) in enumerate(fine):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(fine) if c != q and len(w) == len(v))[:5]
            want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores)]
    for size in (1 << 24, 2000):
        got = maxscore.top_k(frame, F.col("vec_id") % 50 == 0, chunk_bytes=size)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert maxscore.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# -- pipeline and registration -------------------------------------------------------------------------
def test_pipeline_stages(session, small):
    docs = session.read.parquet(f"{small}/documents.parquet")
    labels, bench = (session.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, every = docs.columns, dict(corpus_pipeline.STAGES)
    clean = every["toxicity"](session, docs, small)
    bad = toxicity.toxicity(docs, labels).where("predicted = 1")
    assert clean.columns == columns and clean.count() == docs.count() - bad.count()
    single = every["ngram_jaccard_join"](session, clean, small)
    assert single.columns == columns and single.count() == ngram_join.ngram_join(clean).select("class_id").distinct().count()
    apart = every["benchmark_decontamination"](session, single, small)
    hit = fm_decon.decontaminate(single, bench).where("contaminated")
    assert apart.columns == columns and apart.count() == single.count() - hit.count()
    mix = every["source_mixing"](session, apart, small)
    assert mix.columns == columns and mix.select("doc_id").distinct().join(apart, "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.run(session, small).count() == mix.count()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
