import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rankfield.llm import byte_bpe, conversation_trie, merkle
from rankfield.llm.ordered import lookup, numbered

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def rows(frame, *columns):
    return sorted([tuple(r[c] for c in columns or frame.columns) for r in frame.collect()], key=repr)


# -- places ------------------------------------------------------------------------------------
def test_places_in_groups_with_equal_rows_and_nulls(session):
    draw = random.Random(1)
    data = [("big", draw.choice([None, 1, 2, 3]), draw.choice("ab")) for _ in range(600)] + [("one", None, None), ("two", 5, "x"), ("two", 4, "x")]
    got = numbered(session.createDataFrame(data, "g string, a int, b string").repartition(7), "g", ["a", "b"]).collect()
    for group in ("big", "one", "two"):
        own = sorted((r for r in got if r["g"] == group), key=lambda r: r["pos"])
        assert [r["pos"] for r in own] == list(range(len(own))) and {r["size"] for r in own} == {len(own)}
        order = [(r["a"] is not None, r["a"] or 0, r["b"] or "") for r in own]
        assert order == sorted(order)


def test_lookup_of_frequent_keys_keeps_every_row(session):
    left = session.createDataFrame([("hot", i) for i in range(50)] + [("cold", 50), ("absent", 51), (None, 52)], "k string, i int")
    table = session.createDataFrame([("hot", 1.0), ("cold", 2.0)], "k string, v double")
    uses = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = rows(lookup(left, "k", table, uses, share=3), "i", "v")
    assert got == sorted([(i, 1.0) for i in range(50)] + [(50, 2.0), (51, None), (52, None)], key=repr)


# -- conversation trie -------------------------------------------------------------------------
def rebuilt(turns):
    found = {}
    for c, turn, role, text in turns:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in found.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def trie(conversations):
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for node in nodes:
        if node:
            kids[node[:-1]] += 1
    for node, members in nodes.items():
        cost = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += cost
    out = []
    for node, members in nodes.items():
        ends = sorted(c for c in members if len(conversations[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), kids[node], leaves[node], saved[node], sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def by_spark(session, turns, partitions=5):
    frame = session.createDataFrame(turns, TURNS).withColumn("pos", F.lit("clash")).withColumn("id", F.lit(1)).repartition(partitions)
    c = F.col("conv_id")
    return rows(conversation_trie.trie(*conversation_trie.rebuilt(frame, c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4)))


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(3)
    out = []
    for c in [*range(70), 100, 101, 141, 2**40, 2**40 + 7]:
        for t in range(draw.randint(1, 7)):
            out.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a b", "c", "", "d  e\nf", "é"])))
    for c in range(200, 260):  # many copies, some longer than others
        out += [(c, t, "user", f"same {t} words") for t in range(3 + c % 2)]
    out += [(None, 0, "user", "no id"), (300, None, None, None), (300, 1, None, "x"), (300, 1, "", "x"), (301, 0, "user", "only"), (3, 2, "user", "twice"), (3, 2, "user", "twice")]
    return out


def test_trie_equals_brute_force(session, talks):
    assert by_spark(session, talks) == trie(rebuilt(talks))


def test_trie_of_one_long_chain_takes_few_rounds(session, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK_TURNS", 16)
    chain = [(20, t, "user", f"turn {t}") for t in range(150)] + [(40, t, "user", f"turn {t}") for t in range(120)] + [(60, 0, "user", "x" * 2_000_000)]
    seen = []
    whole = conversation_trie.contracted
    monkeypatch.setattr(conversation_trie, "contracted", lambda *a: seen.append(whole(*a)) or seen[-1])
    assert by_spark(session, chain, 3) == trie(rebuilt(chain))
    assert len(seen[0]) < 40


def test_trie_without_rows(session):
    assert by_spark(session, [], 1) == [] and by_spark(session, [(None, 1, "a", "b")], 1) == []


def test_end_digest_over_many_ranges(session):
    ids = [2**20 * k + j for k in range(30) for j in range(3)] + [-5, 7]
    frame = session.createDataFrame([("n", i) for i in ids] + [("m", 1)], "id string, conv_id long").repartition(4)
    assert rows(conversation_trie.end_digests(frame)) == [("m", sha("1")), ("n", sha(",".join(map(str, sorted(ids)))))]


# -- Merkle manifest ---------------------------------------------------------------------------
def framed(value):
    if value is None:
        return "-"
    return f"{len(str(value).encode())}:{value}"


def leaf(r, text):
    return sha("".join(framed(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def ascend(nodes):
    """The root of a list of digests, and for each the (before, after) of all levels."""
    level, place, ways = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for k, at in enumerate(place):
            run = at // 3 * 3
            ways[k].append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
            place[k] = at // 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0] if level else None, ways


def manifest(docs, now=lambda r: r["text"]):
    by_source = {}
    for r in docs:
        by_source.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, now(r)), r["doc_id"]))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: ascend([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    root, tops = ascend([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for x, way in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            folded = x[3]
            for before, after in way + top:
                folded = sha(before + folded + after)
            out.append((x[4], x[2], trees[s][0], root, sha("".join(b + a for b, a in way + top)), folded, folded == root))
    return sorted(out, key=repr)


def test_manifest_equals_brute_force(session, docs, local, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 9)
    frame = docs.withColumnRenamed("label", "n_chars").withColumn("digest", F.lit(1)).withColumn("pos", F.lit("clash")).withColumn("branch", F.lit(2))
    data = [{**r, "n_chars": r["label"]} for r in local]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.proofs(frame, F.when(even, F.translate("text", "e", "")).otherwise(F.col("text")))
    now = lambda r: r["text"].replace("e", "") if r["text"] and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 else r["text"]
    want = manifest(data, now)
    assert rows(got) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 28])
def test_manifest_of_small_trees(session, n):
    data = [{"doc_id": i, "text": "t" * i, "lang": None, "source": "only", "n_chars": i} for i in range(n)]
    frame = session.createDataFrame([tuple(r.values()) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = rows(merkle.proofs(frame))
    assert got == manifest(data) and all(r[-1] for r in got)


def test_manifest_of_repeated_rows_and_very_long_texts(session):
    data = [{"doc_id": 1, "text": "same", "lang": "en", "source": None, "n_chars": 4}] * 40
    data += [{"doc_id": 2, "text": "line\n" * 500_000, "lang": "en", "source": f"s{i}", "n_chars": i} for i in range(5)]
    frame = session.createDataFrame([tuple(r.values()) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert rows(merkle.proofs(frame)) == manifest(data)


# -- byte-level BPE ----------------------------------------------------------------------------
def reference(text):
    ids = byte_bpe._encoding(RANKS, PATTERN).encode_ordinary(text or "")
    return len(ids), sha(" ".join(map(str, ids))), sha(text or "")


ODD = ["a  b", " lead", "trail ", "x \n y", "don't 'll's  ''s", "　a  b\x85 c\x1c d", "I'm\t we've\r\n", "12 345", "​   q", "日本語 テスト", "é é", "   ", "\x00 \x00", "<|endoftext|>"]


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 3000, "bucket_bytes": 500}])
def test_bpe_equals_the_whole_text_encoder(session, docs, local, sizes):
    extra = session.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    frame = docs.unionByName(extra, allowMissingColumns=True).withColumn("ids", F.lit("clash")).withColumn("slice", F.lit(0))
    texts = [(r["doc_id"], r["text"]) for r in local] + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = rows(byte_bpe.digests(frame, ranks_path=RANKS, pattern=PATTERN, **sizes))
    assert got == sorted([(i, *reference(t)) for i, t in texts], key=repr)


def test_bpe_of_very_long_texts_in_pieces(session, monkeypatch):
    monkeypatch.setattr(byte_bpe, "RUN", 1000)
    long = ["word  and\n more, " * 200_000, "x" * 300_000, "ab " * 700_000 + "end", " " * 3000]
    frame = session.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = rows(byte_bpe.digests(frame, ranks_path=RANKS, pattern=PATTERN))
    assert got == [(i, *reference(t)) for i, t in enumerate(long)]


def test_pieces_and_chunks_part_texts_where_words_begin(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE", 10)
    match = byte_bpe._compiled(PATTERN).findall
    for text in [*ODD, "some words, 's here  and\tthere " * 9]:
        parts = [c for piece in byte_bpe.pieces(text) for c in byte_bpe.chunks(piece)]
        assert "".join(parts) == text and [w for p in parts for w in match(p)] == match(text)


def test_bpe_without_rows_and_decoding_of_unknown_ids(session, empty):
    assert rows(byte_bpe.digests(empty, ranks_path=RANKS, pattern=PATTERN)) == []
    some = session.createDataFrame([(1, [0, 1, 50255]), (2, []), (3, None)], "doc_id long, ids array<int>")
    table = byte_bpe.token_bytes(RANKS)
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(some, ranks_path=RANKS).orderBy("doc_id").collect()] == [table[0] + table[1] + table[50255], b"", b""]
    bad = session.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="table of token bytes"):
        byte_bpe.decode(bad, ranks_path=RANKS).collect()
