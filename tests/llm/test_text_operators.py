import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankfield.llm import backoff_lm, fm_decon, license_scan, site_quality, suffix_dedup, token_codes, toxicity
from rankfield.llm.stage import folder

BPE = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_row(frame, *columns):
    return sorted([tuple(r[c] for c in columns) for r in frame.collect()], key=repr)


# -- token codes -------------------------------------------------------------------------------
def test_codes_round_trip_and_random_access():
    ids = np.concatenate((np.random.default_rng(1).integers(0, 50257, 3000), [0, 255, 256, 65535, 65536, 2**32 - 1]))
    codes = token_codes.Codes.of(ids)
    assert (codes.all() == ids).all() and [codes.get(i) for i in range(len(ids))] == ids.tolist()
    assert len(token_codes.Codes.of(np.array([3, 2])).levels) == 1


def test_chunked_encoding_equals_whole_texts(local):
    encoder = token_codes.Encoder(BPE, cache=50)
    import pyarrow as pa

    texts = [r["text"] for r in local] + ["a　 b \x85 c", " lead", "trail ", "don't  stop\r\n now"]
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts))
        want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_token_files_hold_every_document_in_order(session, docs, local):
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    path = folder(session, "test-tokens")
    token_codes.write(named, path, tokenizer_path=BPE, segment_tokens=500)
    tokenizer, start, every = Tokenizer.from_file(BPE), 0, []
    texts = {r["doc_id"]: r["text"] or "" for r in local if r["doc_id"] is not None}
    got = {r["doc_id"]: r for r in token_codes.read(session, path).collect()}
    for doc_id in sorted(texts):
        ids = tokenizer.encode(texts[doc_id], add_special_tokens=False).ids + [2]
        assert tuple(got[doc_id][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        every += ids
    for position in (0, 499, 500, len(every) - 1):
        assert token_codes.token(session, path, position) == every[position]
    with pytest.raises(IndexError):
        token_codes.token(session, path, len(every))


# -- benchmark decontamination -----------------------------------------------------------------
def test_decontamination_matches_a_scan(session, docs, local):
    long = [r["text"].split() for r in local if r["text"] and len(r["text"].split()) > 40]
    items = [(1, " ".join(long[0][5:25])), (2, "One"), (3, " ".join(long[1][10:17])), (3, "zwei-DREI"), (4, None), (5, "nowhere to be found in any of these texts at all"), (None, " ".join(long[2][:12]).upper()), (6, "")]
    bench = session.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        words = pattern.findall(lower(text))
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add("" if item is None else str(item))
    want = []
    for r in local:
        words = pattern.findall(lower(r["text"]))
        hit, found = [0] * len(words), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[k : k + size])):
                    found |= owners
                    hit[k : k + size] = [1] * size
        want.append((r["doc_id"], len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for block in (10, 2_000_000):
        assert by_row(fm_decon.decontaminate(docs, bench, block_words=block), *columns) == sorted(want, key=repr)
    kept = fm_decon.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    cut = fm_decon.cut_spans(fm_decon.occurrences(docs, bench))
    assert fm_decon.decontaminate(cut.select("doc_id", "text"), bench.where("item_id = 1")).where("contaminated").count() == 0


def test_fm_index_finds_every_occurrence():
    draw = np.random.default_rng(3)
    text = draw.integers(0, 4, 500)
    text[-1] = 0
    index = fm_decon.FmIndex(text, 3)
    phrases = np.unique(draw.integers(1, 4, (60, 3)), axis=0)
    low, high = index.find(phrases)
    for phrase, a, b in zip(phrases, low, high):
        want = [i for i in range(498) if (text[i : i + 3] == phrase).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# -- suffix deduplication ------------------------------------------------------------------------
@pytest.mark.parametrize("block_rows", [20_000, 3, 0])
def test_dedup_matches_every_window(docs, local, block_rows):
    texts = [(r["text"] or "").encode() for r in local]
    count = Counter(t[k : k + 80] for t in texts for k in range(len(t) - 79))
    want = []
    for r, t in zip(local, texts):
        depth = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 79):
            if count[t[k : k + 80]] > 1:
                depth[k] += 1
                depth[k + 80] -= 1
        gone = np.cumsum(depth)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((r["doc_id"], len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffix_dedup.dedup(docs, length=80, gram=16, block_rows=block_rows)
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_a_text_that_ends_in_nul_bytes_parts_no_repeats():
    short, long = b"abc\0", b"abc\0\0\0"
    for right in ([long, short, long], [short, long, long], [long, long, short]):
        found = suffix_dedup.repeated_offsets(np.zeros(3, int), [b"x", b"y", b"z"], right, 6, 3)
        assert found[:, 0].tolist() == [r == long for r in right] and not found[:, 1:].any()


def test_dedup_of_texts_with_nul_bytes_matches_every_window(session):
    draw, rows = random.Random(3), []
    for _ in range(12):
        body = "".join(draw.choice("abcdefgh") for _ in range(120))
        ends = ["\0" * 30, "\0" * 30, "\0" * 10, "\0" * 50, ""]
        draw.shuffle(ends)
        rows += [(len(rows) + i, draw.choice("xyz") * (1 + i) + body + end) for i, end in enumerate(ends)]
        rows += [(len(rows) + i, end + body + draw.choice("xyz") * (1 + i)) for i, end in enumerate(ends)]
    count = Counter(t[k : k + 80] for _, t in rows for k in range(len(t) - 79))
    want = [(i, sum(any(count[t[k : k + 80]] > 1 for k in range(max(0, j - 79), min(j, len(t) - 80) + 1)) for j in range(len(t)))) for i, t in rows]
    got = suffix_dedup.dedup(session.createDataFrame(rows, "doc_id long, text string").repartition(3), length=80, gram=16)
    assert by_row(got, "doc_id", "n_removed") == sorted(want, key=repr)


# -- language model ------------------------------------------------------------------------------
@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_the_formula(docs, local, order):
    counts = [Counter() for _ in range(order + 1)]
    rows = []
    for r in local:
        tokens = ["<end>", *re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"])), "<end>"]
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0
        rows.append((r["doc_id"], held, tokens))
        for k in range(1, order + 1):
            for j in range(1, len(tokens)):
                if not held and j - k + 1 >= (1 if k == 1 else 0):
                    counts[k][tuple(tokens[j - k + 1 : j + 1])] += 1
    n, kinds = sum(counts[1].values()), len(counts[1])

    def p(tokens, j, k):
        if k == 1:
            return (counts[1][(tokens[j],)] + 0.1) / (n + 0.1 * (kinds + 1))
        if j - k + 1 < 0:
            return p(tokens, j, k - 1)
        context = tuple(tokens[j - k + 1 : j])
        return (counts[k][(*context, tokens[j])] + 20 * p(tokens, j, k - 1)) / (counts[k - 1][context] + 20)

    want = []
    for doc_id, held, tokens in rows:
        places = range(1, len(tokens))
        known = sum(counts[1][(tokens[j],)] > 0 for j in places)
        want.append((doc_id, held, len(places), known, n, round(sum(math.log10(p(tokens, j, 1)) for j in places), 6), round(sum(math.log10(p(tokens, j, order)) for j in places), 6)))
    got = backoff_lm.lm_scores(docs, order=order, slice_bytes=20_000, range_bytes=30_000)
    got = got.withColumns({"base_score": F.round("base_score", 6), "score": F.round("score", 6)})
    assert by_row(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score") == sorted(want, key=repr)


def test_repeated_rows_share_one_slice_row(session):
    """Copies of a row with more bytes than a slice are one row of it, and count and are scored each."""
    rows = [(None, "b a c " * 20)] * 300 + [(i, f"a b w{i}") for i in range(50)]
    docs = session.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = docs.withColumn("held_out", F.lit(False))
    dealt, repeated = backoff_lm._dealt(texts, 20, 4_000)
    assert repeated and dealt.count() == 51 and dealt.agg(F.sum("times")).first()[0] == 350
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    rounded = lambda size: by_row(backoff_lm.lm_scores(docs, slice_bytes=size).withColumns({c: F.round(c, 6) for c in columns[-2:]}), *columns)
    got = rounded(4_000)
    assert len(got) == 350 and got == rounded(1 << 30)


# -- licenses --------------------------------------------------------------------------------------
def test_license_spans_and_edits(session):
    notice = license_scan.TEMPLATES["mit"]
    edited = notice.replace("free of charge", "free of all charge").replace("publish, ", "").replace("sublicense", "sub license")
    rows = [(1, f"head {notice} tail"), (2, f"a b {edited} c"), (3, notice[: len(notice) // 3]), (4, None), (5, ""), (6, f"{notice}\n{notice}"), (7, "Licensed under CC BY-NC 4.0. And so on"), (1, f"head {notice} tail")]
    docs = session.createDataFrame(rows, "doc_id long, text string").withColumn("template_id", F.lit("clash"))
    got = license_scan.license_scan(docs, license_scan.default_templates(session)).where("template_id in ('mit', 'cc-by-nc-4.0-line')").collect()
    found = Counter((r["doc_id"], r["template_id"]) for r in got)
    assert found == {(1, "mit"): 2, (2, "mit"): 1, (6, "mit"): 2, (7, "cc-by-nc-4.0-line"): 1}
    whole = next(r for r in got if r["doc_id"] == 1)
    assert whole["coverage"] == 1.0 and rows[0][1].encode()[whole["first_byte"] : whole["last_byte"]].decode() == notice.rstrip(".")
    assert 0.9 < next(r for r in got if r["doc_id"] == 2)["coverage"] < 1
    small = license_scan.license_scan(docs, license_scan.default_templates(session), block_words=60)
    assert small.where("template_id in ('mit', 'cc-by-nc-4.0-line')").count() == len(got)


# -- classifiers -------------------------------------------------------------------------------------
def _labelled(session, n=600):
    import random

    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    rows = []
    for i in range(n):
        own = [draw.choice(words) for _ in range(60)]
        if i % 5 == 0:
            own[draw.randrange(60)] = draw.choice(["vile", "awful"])
        rows.append((i, " ".join(own) if i % 7 else " ".join(own).upper() + "!!!" * 40, f"h{i % 9}", i % 5 == 0, i % 7 != 0))
    return session.createDataFrame(rows, "doc_id long, text string, source string, toxic boolean, quality boolean")


def test_toxic_words_are_learnt(session, empty):
    rows = _labelled(session)
    labels = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    docs = rows.select("doc_id", "text", F.lit("x").alias("score")).unionByName(session.createDataFrame([(None, None, "x"), (5, None, "x")], "doc_id long, text string, score string"))
    got = toxicity.toxicity(docs, labels)
    held = got.where("held_out and score is not null").join(labels, "doc_id")
    assert held.count() > 100 and held.where("predicted <> toxic").count() <= 0.05 * held.count()
    assert got.count() == 602 and got.where("score between 0 and 1").count() == 602
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("predicted = 0").count()
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0.5").count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 30, 3_000])
def test_every_label_is_learnt_once_in_order(session, block_bytes):
    """Plain FTRL over all labelled rows, one per document, gives the weights; a hot document and its copies count once."""
    rows = _labelled(session, 300).select("doc_id", "text", F.col("toxic").cast("int").alias("label"))
    hot = session.range(200).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("awful copy "), F.col("id") % 3).alias("text"))
    docs = rows.select("doc_id", "text").unionByName(hot).unionByName(session.createDataFrame([(8, None)], "doc_id long, text string"))
    model = toxicity.train(docs, rows.select("doc_id", "label"), dims=1 << 16, block_bytes=block_bytes)
    turns = {r["doc_id"]: (r["turn"], r["label"]) for r in rows.select("doc_id", "label", F.xxhash64(F.lit(7), "doc_id").alias("turn")).collect()}
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    frame = session.createDataFrame([(i, min(t, key=lambda v: hashlib.md5(v.encode()).hexdigest())) for i, t in texts.items()], "doc_id long, text string")
    lists = {r["doc_id"]: np.array(r["features"], int) for r in toxicity.features(frame, 1 << 16).collect()}
    z, n = np.zeros(1 << 16), np.zeros(1 << 16)
    prior = np.mean([label for _, label in turns.values()])
    bias, bias_n = math.log(prior / (1 - prior)), 1.0
    weights = lambda z, n: np.where(np.abs(z) <= 3, 0, -(z - np.sign(z) * 3) / ((1 + np.sqrt(n)) / 0.5 + 1))
    for _ in range(5):
        for i in sorted(turns, key=lambda i: turns[i][0]):
            x = lists[i]
            w = weights(z[x], n[x])
            g = 1 / (1 + math.exp(-bias - w.sum())) - turns[i][1]
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / 0.5 * w
            n[x] += g * g
            bias_n += g * g
            bias -= 0.1 * g / math.sqrt(bias_n)
    want = weights(z, n)
    assert model.index.tolist() == np.flatnonzero(want).tolist() and len(model.index) > 2
    assert np.allclose(model.weight, want[model.index], rtol=1e-5) and abs(model.bias - bias) < 1e-9


def test_labels_beyond_the_former_bound_are_learnt(session):
    """Toxic labels of ids whose hashes come after 16,000 others."""
    rows = session.range(16_300).select(F.col("id").alias("doc_id"), F.xxhash64(F.lit(7), "id").alias("turn"))
    late = [r["doc_id"] for r in rows.orderBy("turn").tail(200)]
    bad = F.col("doc_id").isin(late)
    docs = rows.select("doc_id", F.concat(F.when(bad, "vile").otherwise("kind"), F.lit(" word")).alias("text"))
    model = toxicity.train(docs, rows.select("doc_id", bad.cast("int").alias("label")), dims=1 << 12)
    got = {r["text"]: r["score"] for r in toxicity.score(docs.select("text").distinct(), model).collect()}
    assert got["vile word"] > 0.5 > 0.1 > got["kind word"]


def test_quality_shrinks_sparse_sites(session, empty):
    rows = _labelled(session)
    labels = rows.select("doc_id", F.col("quality").cast("int").alias("label"))
    learnt = labels.where("doc_id % 3 <> 0")
    got = site_quality.site_quality(rows, learnt, host=F.col("source"), path=F.lit(None).cast("string"))
    held = got.join(labels, "doc_id").where("doc_id % 3 = 0")
    assert got.count() == 600 and held.where("keep <> (label = 1)").count() <= 0.03 * held.count()
    bad = session.createDataFrame([(i, "WORD!!! " * 50, "bad") for i in range(1000, 1060)] + [(2000, "WORD!!! " * 50, "rare")], "doc_id long, text string, source string")
    both = site_quality.site_quality(rows.select("doc_id", "text", "source").unionByName(bad), learnt, host=F.col("source"), path=F.col("source"))
    rate = {r["host"]: r["host_rate"] for r in both.select("host", "host_rate").distinct().collect()}
    assert rate["bad"] < rate["rare"] < rate["h0"]
    assert site_quality.site_quality(empty, labels, host=F.col("source"), path=F.col("lang")).count() == 0
    assert site_quality.site_quality(rows, labels.limit(0), host=F.col("source"), path=F.col("source")).where("abs(score - 0.5) > 1e-9").count() == 0


def test_empty_tables(session, empty):
    bench = session.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert fm_decon.decontaminate(empty, bench).count() == 0
    assert fm_decon.decontaminate(session.createDataFrame([(1, "a b c")], "doc_id long, text string"), bench.limit(0)).where("contaminated").count() == 0
    assert suffix_dedup.dedup(empty).count() == 0
    assert backoff_lm.lm_scores(empty).count() == 0
    assert license_scan.license_scan(empty, license_scan.default_templates(session)).count() == 0
    assert token_codes.encoded(empty, tokenizer_path=BPE).count() == 0
