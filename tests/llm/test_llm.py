"""The training-data operators against brute force, the tokenizers library and odd inputs."""

import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recframe.llm import bpe, bpe_codec, common, graph, jaccard, line_dedup, packing, quality_classifier, quality_rules, queries, repair, topk, toxicity, training, warc
from recframe.llm.bpe import BYTE_BPE, WORD_BPE, default_path, encoder

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "\n\n", "Hello<|endoftext|>wörld", "a\x0bb\x0cc", " x  y\n z ", "½² don't I'LL", "ÉCOLE İstanbul ẞ 北京 é", "a \n b", "tab\tq  \t z", "x" * 5000, "naïve ﬁ ǆ ​　q", "the same text", "the same text", "\x01 a\x00b", "word " * 3000, "a1b2,c(d)e 12345 3.14 x's1 'rest don't) \"'s (I'll) a<|b <|endoftext|>c1 d<|endoftext|> é1a,b 1é", "MIXED Case99 9th u.s.a. <| |> <|x1,y"]
SCHEMA = "doc_id bigint, text string, lang string, kept int, toxic string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, ["en", None, "xx"][k % 3], 1, "x", "y") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, (None, "no id here", "en", 1, "x", "y"), (3, "a", "en", 1, "x", "y")], SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path(name))


@pytest.mark.parametrize(("kind", "name"), [("word", WORD_BPE), ("byte", BYTE_BPE)])
def test_encoder_is_the_library(kind, name, documents):
    rows = [t or "" for t in ODD] + [r["text"] for r in documents.limit(60).collect()]
    want = [np.array(e.ids, "<u4").tobytes() for e in library(name).encode_batch(rows, add_special_tokens=False)]
    assert encoder(kind).encode([t.encode() for t in rows]) == want
    assert [encoder(kind).encode([t.encode()])[0] for t in rows] == want  # however texts are grouped


@pytest.mark.parametrize(("kind", "name"), [("word", WORD_BPE), ("byte", BYTE_BPE)])
def test_encoder_compares_bytes(kind, name, documents, monkeypatch):
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate({97: "b", 98: "a"})
    rows = [thue, thue.translate({97: "b", 98: "a"}), *[r["text"] for r in documents.limit(30).collect()], "x" * 300_000, "ab " * 100_000]
    want = [np.array(e.ids, "<u4").tobytes() for e in library(name).encode_batch(rows, add_special_tokens=False)]
    assert encoder(kind).encode([t.encode() for t in rows]) == want
    # sixteen hashes for all units: all but the first of each are found by their bytes
    monkeypatch.setattr(bpe, "span_hashes", lambda *x: common.span_hashes(*x) & np.uint64(0xF0))
    fresh = bpe._KINDS[kind][0](default_path(name))
    assert [fresh.encode([t.encode()])[0] for t in rows] == want and fresh.encode([t.encode() for t in rows]) == want


def test_byte_units_end_at_white_space_and_latin_letters():
    text = "un.\nÇa était, vrai!\r×é\xa0\nxyz  y\n"
    data = np.frombuffer(text.encode(), np.uint8)
    begin, end = encoder("byte").units_of(data, np.array([len(data)]))
    units = [data[i:j].tobytes().decode() for i, j in zip(begin, end, strict=True)]
    assert units == ["un", ".", "\n", "Ça", " était", ",", " vrai", "!", "\r", "×é\xa0\nxyz", "  y\n"]


def test_byte_units_asked_for_again_are_kept(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 200)
    fresh = bpe.ByteEncoder(default_path(BYTE_BPE))
    remember, learned, tok = fresh._remember, [], library(BYTE_BPE)
    monkeypatch.setattr(fresh, "_remember", lambda data, begin, end, *x: (learned.append(len(begin)), remember(data, begin, end, *x))[1])
    for k in range(15):
        rows = [" ".join(f"common{'abcdefgh'[j % 8]}{'stuvwxyz'[j // 8]}" for j in range(50)), " ".join(f"new{chr(97 + k)}{chr(97 + j // 8)}{chr(97 + j % 8)}" for j in range(60))]
        assert fresh.encode([t.encode() for t in rows]) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(rows, add_special_tokens=False)]
    assert sum(learned) <= 50 + 15 * 60 + 16 and fresh.keys.n <= 400  # 16: the first words of texts have no space before them


def test_word_encoder_keeps_to_a_text_after_another_ones_mark():
    rows = ["a <|", ",a1", "9. x", "<|", "|A"]  # "<|" may begin a special token's text, in its own text only
    assert encoder("word").encode([t.encode() for t in rows]) == [np.array(e.ids, "<u4").tobytes() for e in library(WORD_BPE).encode_batch(rows, add_special_tokens=False)]


def test_span_hashes_of_patterned_words():
    rng = np.random.default_rng(0)
    words = {bytes(rng.choice([97, 98], n).astype(np.uint8)) for n in (7, 8, 9, 16, 64, 1024, 1030, 5000) for _ in range(300)}
    words |= {b"ab" * k for k in range(700)} | {b"a" * k for k in range(1, 700)}
    words = sorted(words)
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    h = common.span_hashes(np.frombuffer(data, np.uint8), ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(words)
    alone = [common.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words]
    assert alone == h.tolist()


def check_pieces(pieces, ids):
    at = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        x = ids[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(x)
        assert p["ids_crc32"] == zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        at[p["doc_id"]] += p["length"]
    assert all(at[k] == len(x) for k, x in ids.items())
    lengths = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == lengths[p["sequence_id"]]
        lengths[p["sequence_id"]] += p["length"]
    assert max(lengths.values()) <= 2048
    return sum(2048 - n for n in lengths.values() if n & (n - 1))


def test_packing_places_every_id_once(spark, documents):
    tok = library(WORD_BPE)
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in documents.collect()}
    assert check_pieces(queries.op1_packing(spark, DATA).collect(), ids) == 0


def test_packing_odd(spark, odd, empty):
    out = packing.pack_documents(odd).collect()
    assert sum(p["length"] for p in out) == sum(p["doc_tokens"] for p in out if p["start"] == 0)
    assert {p["doc_id"] for p in out} == {*range(len(ODD)), None}
    assert packing.pack_documents(empty).count() == 0


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(1)
    p = packing.VectorPacker(tokens=100, segments=5, loss=40, cut=False, pool=50)
    items = [(k, int(n), int(min(n, 40) * u)) for k, (n, u) in enumerate(zip(rng.integers(1, 90, 300), rng.random(300), strict=True))]
    done = [s for i in items for s in p.offer(*i)] + list(p.finish())
    for _, pieces in done:
        assert sum(x[2] for x in pieces) <= 100 and len(pieces) <= 5 and sum(x[3] for x in pieces) <= 40
    assert sorted(x[0] for _, pieces in done for x in pieces) == list(range(300))
    with pytest.raises(ValueError):
        list(p.offer(0, 101, 0))


def test_bpe_round_trip(spark, documents, odd, empty):
    tok = library(WORD_BPE)
    for df in (documents, odd):
        got = sorted(map(tuple, bpe_codec.round_trip(df).collect()), key=str)
        want = []
        for r in df.collect():
            ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want, key=str)
    back = {r["doc_id"]: r["text"] for r in bpe_codec.decode(bpe_codec.encode(documents)).collect()}
    assert len(back) == documents.count()
    assert bpe_codec.round_trip(empty).count() == 0


def test_grammar_files(spark, documents):
    tok = library(BYTE_BPE)
    at = 0
    got = {r["doc_id"]: r for r in queries.op3_repair(spark, DATA).collect()}
    for r in documents.orderBy("doc_id").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_grammar_odd(spark, odd, empty, tmp_path):
    repair.write_ids(odd, f"{tmp_path}/ids")
    out = repair.documents_of(repair.read_ids(spark, f"{tmp_path}/ids")).collect()
    assert len(out) == odd.count()
    for shard in repair.read_ids(spark, f"{tmp_path}/ids").collect():
        whole = list(repair.decode_shard(shard.asDict()))
        assert all((repair.decode_one(shard.asDict(), k) == ids).all() for k, (_, ids) in enumerate(whole))
    repair.write_ids(empty, f"{tmp_path}/none")
    assert repair.documents_of(repair.read_ids(spark, f"{tmp_path}/none")).count() == 0


def test_grammar_repeated_ids(spark, tmp_path):
    rows = [(k % 3, f"text {k} " * (k + 1)) for k in range(30)] + [(-(1 << 63), "least"), (None, "none"), (None, None)]
    got = []
    for k in (1, 5):
        repair.write_ids(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(k), f"{tmp_path}/{k}")
        got.append(sorted(map(tuple, repair.documents_of(repair.read_ids(spark, f"{tmp_path}/{k}")).collect()), key=lambda r: r[1]))
    assert got[0] == got[1] and [r[0] for r in got[0]] == [None, None, -(1 << 63), *[0] * 10, *[1] * 10, *[2] * 10]


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_grammar_random_access(n):
    rng = np.random.default_rng(n)
    ids = np.repeat(rng.integers(0, 6, n), 1 + n % 2).astype(np.uint32)
    doc = np.sort(rng.integers(0, 5, len(ids)))
    g, where = repair.compress(ids, doc, 10, least=3, rounds=9)
    table = g.expansions()
    assert (g.expand(g.symbols, table) == ids).all() and (n < 100 or len(g.symbols) < len(ids))
    for d in set(doc.tolist()):
        assert (g.expand(g.symbols[where == d], table) == ids[doc == d]).all()
    assert g.sizes(g.symbols).sum() == len(ids)


def test_grammar_goes_on_to_the_last_frequent_pair():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 60_000, 512)
    parts = [np.concatenate((rng.integers(0, 60_000, 50), passage)) for _ in range(8)]
    parts += [rng.permutation(np.repeat(np.arange(800), 60)) for _ in range(12)]  # more pairs than 16 bits have room for
    parts += [np.full(1000, 7)]
    ids, doc = np.concatenate(parts).astype(np.uint32), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    g, where = repair.compress(ids, doc, 65_000)
    pairs = Counter(zip(g.symbols[:-1][where[1:] == where[:-1]].tolist(), g.symbols[1:][where[1:] == where[:-1]].tolist(), strict=True))
    assert max(pairs.values()) < 6 and g.lengths.max() >= 256 and 65_000 + len(g.rules) > 1 << 16
    assert (g.expand(g.symbols, g.expansions()) == ids).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    cursor = duck.execute(queries.ORACLE_SQL[name])
    order = sorted(c[0] for c in cursor.description)
    columns = [c[0] for c in cursor.description]
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in cursor.fetchall()), key=repr)
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == order
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == want


def test_topk_ties_repeats_and_gaps(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (7, [0.0, 0.0]), (50, [1.0]), (None, [9.0, 9.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["query_id"]: [] for r in topk.search(df, F.col("vec_id") % 50 == 0, 3).collect()}
    for r in topk.search(df, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 256 * 256 + 128 * 128), (2, 256 * 256 + 128 * 128), (50, 65536)], 50: [(0, 65536), (1, 65536), (2, 65536)]}
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_large_repeated_and_empty(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 7)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "SLICE", 2)
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=rng.integers(0, 6)) * 10.0 ** rng.integers(0, 7)).tolist()) for k in range(0, 400, 5)]
    rows += [(3, [2.0]), (4, [300_000.0]), (4, [300_000.0]), (6, []), (50, [7.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = {}
    for q in {i for i, _ in rows if i % 50 == 0}:
        scores = [(-sum(a * b for a, b in zip(v, w)), i) for p, v in whole if p == q for i, w in whole if i != q]  # noqa: B905
        want[q] = [(i, -s) for s, i in sorted(scores)[:5]]
    got = defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == want
    big = spark.createDataFrame([(0, [2.0**26, 1.0]), (1, [2.0**26 - 1, 3.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.search(big, F.col("vec_id") == 0).collect()
    near = spark.createDataFrame([(0, [2.0**22, 1.0]), (1, [2.0**22 - 1, 3.0]), (2, [2.0**22, 1.5]), (3, [2.0**22, 1.25])], "vec_id bigint, embedding array<double>")
    assert {r["vec_id"]: (r["rank"], r["score"]) for r in topk.search(near, F.col("vec_id") == 0).collect()} == {2: (1, 2**60 + 256 * 384), 3: (2, 2**60 + 256 * 320), 1: (3, 2**30 * (2**30 - 256) + 256 * 768)}
    with pytest.raises(Exception, match="too large"):
        topk.search(spark.createDataFrame([(0, [1e30])], "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_topk_stops_by_proof():
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (4000, 32)).astype(np.int64)
    x[:50] = x[0] + rng.integers(-3, 3, (50, 32))
    index = topk.Shard(np.arange(4000), x)
    want = x.astype(np.int64) @ x[0].astype(np.int64)
    order = [int(i) for i in np.lexsort((np.arange(4000), -want)) if i]
    assert index.search(x[0], 0, 5) == [(int(want[i]), i) for i in order[:5]]
    assert index.visited < index.postings


def test_warc_odd(spark):
    base = [("http://WWW.Host.com:80/a/?b=1&utm_x=2&a=3#f", "response", 10, "t1"), ("https://host.com/a?a=3&b=1", "revisit", 11, "W/t1"), ("https://host.com/a?a=3&b=1", "revisit", 12, "t2"), ("https://host.com/z", "revisit", 12, "t"), (None, "revisit", 1, "t"), ("https://host.com/a?a=3&b=1", "revisit", 9, "t1"), ("https://host.com/a?a=3&b=1", "metadata", 11, "t1")]
    rows = [(k, u, t, kind, e, None, "d", {"ETag": e, "Date": str(t), "Content-Type": "text/html" if kind == "response" else "x"}) for k, (u, kind, t, e) in enumerate(base)]
    schema = "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "resolved", 2: "mismatch", 3: "unknown", 5: "unknown"}
    assert got[1]["headers"] == {"etag": "W/t1", "date": "11", "content-type": "text/html"} and got[1]["response_id"] == 0
    assert warc.resolve(spark.createDataFrame([], schema)).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_rules(spark, documents, odd, empty):
    for df in (documents.select("doc_id", "text", "lang"), odd):
        for r in quality_rules.assess(df).collect():
            t = r["text"] or ""
            w = WORD.findall(t)
            c = Counter(zip(w, w[1:], w[2:], strict=False))
            marked = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))
            assert r["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.assess(empty).count() == 0


def test_quality_rules_follow_labels(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.assess(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) / len(good) > 0.97
    assert not any(r["kept"] for r in rows if r["quality"] == 0 and r["n_words"] > 100)


@pytest.mark.parametrize("column", quality_rules.METRICS)
def test_quality_rules_filter_on_a_result(spark, documents, column):
    began = time.time()
    out = quality_rules.assess(documents)
    rows = out.collect()
    flag = out.schema[column].dataType.typeName() == "boolean"
    got = out.filter(F.col(column) if flag else F.col(column) > 0).count()
    assert got == sum(bool(r[column]) if flag else (r[column] or 0) > 0 for r in rows)
    assert time.time() - began < 60


def test_quality_rules_clashing_names_and_long_texts(spark, documents):
    names = ["row", "words", "lines", "_lines", "starts", "classes", "n_words", "kept", "a.b"]
    clash = documents.withColumns({c: F.lit(7) for c in names})
    assert quality_rules.assess(clash).columns == [*documents.columns, *[c for c in names if c not in quality_rules.METRICS], *quality_rules.METRICS]
    back = quality_rules.keep(clash)
    assert back.columns == clash.columns and {tuple(r)[-len(names) :] for r in back.collect()} == {(7,) * len(names)}
    assert sorted(map(tuple, back.select("doc_id", "text").collect())) == sorted(map(tuple, quality_rules.keep(documents).select("doc_id", "text").collect()))
    long = " ".join(f"w{k % 60_000}" for k in range(150_000))
    r = quality_rules.assess(spark.createDataFrame([(1, long, "en"), (1, long, "en")], "doc_id bigint, text string, lang string")).collect()
    assert [(x["n_words"], x["n_repeat_words"]) for x in r] == [(150_000, 150_000)] * 2


@pytest.mark.parametrize(("name", "column"), [("op7_quality_classifier", "quality"), ("op9_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, column):
    d = "/root/testdata/sf0.1"
    out = queries.QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r[column] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_classifiers_odd(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)] + [(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    for classify in (quality_classifier.classify, toxicity.classify):
        assert classify(odd, labels).count() == odd.count()
        assert classify(odd, labels.limit(0)).count() == odd.count()
        assert classify(empty, labels).count() == 0
        blank = {r["score"] for r in classify(odd, labels).collect() if r["doc_id"] in (0, 1)}
        assert len(blank) == 1 and 0 <= blank.pop() <= 1  # null and empty texts
    clash = odd.withColumn("a.b", F.lit(1))
    assert toxicity.keep_clean(clash, toxicity.Model()).columns == clash.columns and toxicity.keep_clean(clash, toxicity.Model()).count() == odd.count()
    assert toxicity.learn(odd, None) == toxicity.Model()


def test_label_samples_are_bounded(spark):
    docs = spark.createDataFrame([(k % 50, f"{k:05d}" * 20) for k in range(500)] + [(7, None)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] * 2, "doc_id bigint, quality int")
    rows = training.labelled_sample(docs, labels, "quality", 4, 2, 20)
    assert len(rows) == 20 and rows == training.labelled_sample(docs.repartition(5), labels, "quality", 4, 2, 20)
    few = training.labelled_sample(docs, labels, "quality", 4, 2, 20, 450)
    assert few == rows[: len(few)] and len(few) >= 4 and sum(len(t) for t, _ in few) <= 450


def test_quality_scores_by_force(spark, documents):
    """The same features and updates written out one weight at a time."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    sample = training.labelled_sample(documents, labels, "quality", 4, 2, quality_classifier.SAMPLE)
    token = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")

    def features(text):
        words, forms = [], []
        for t in token.findall(text):
            w = zlib.crc32(("w" + t.lower()).encode())
            f = ("U" if t.isupper() and len(t) > 1 else "T" if t[0].isupper() else "l" if t.islower() else "m") if t[0].isalpha() else "9" if t[0].isdigit() else t[:8]
            f = zlib.crc32(("f" + f).encode()) ^ (0x5BD1E995 if words and words[-1] == w else 0)
            words.append(w)
            forms.append(f)
        found = Counter()
        for k, codes in enumerate((words, forms)):
            for i, c in enumerate(codes):
                found[c % (1 << 18)] += 1
                if i >= 1:
                    found[(((codes[i - 1] * 31 + c + 1 + 2 * k) * 0x9E3779B1) >> 7) % (1 << 18)] += 1
                if i >= 2:
                    found[((((codes[i - 2] * 31 + codes[i - 1]) * 31 + c + 2 + 2 * k) * 0x9E3779B1) >> 7) % (1 << 18)] += 1
        return {i: math.sqrt(n / len(words)) for i, n in found.items()} | {1 << 18: 1.0}

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.02 else (math.copysign(0.02, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / 0.3 + 0.1)

    def chance(x):
        return 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))

    rows = [(features(t), y) for t, y in sample]
    for turn in range(3):
        for k in np.random.Generator(np.random.PCG64(turn)).permutation(len(rows)).tolist():
            x, y = rows[k]
            p = chance(x)
            for i, w, g in [(i, weight(i), (p - y) * v) for i, v in x.items()]:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * w
                n[i] += g * g
    got = {r["doc_id"]: r for r in queries.op7_quality_classifier(spark, DATA).collect()}
    for r in documents.collect():
        want = chance(features(r["text"] or ""))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-9
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and got[r["doc_id"]]["predicted"] == int(want >= 0.7)


def slow_segments(s, lo, hi):
    best, span = 0.0, None
    for i in range(lo, hi):
        t = 0.0
        for j in range(i, hi):
            t += s[j]
            if t > best + 1e-9:
                best, span = t, (i, j + 1)
    return slow_segments(s, lo, span[0]) + [(*span, best)] + slow_segments(s, span[1], hi) if span else []


def test_toxicity_scores_by_force(spark):
    """Log-odds, segments, extreme-value law and scores of the query, written out anew."""
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    sample = list(dict.fromkeys(training.labelled_sample(docs, labels, "toxic", 5, 0, toxicity.SAMPLE)))
    model = toxicity.learn(docs, labels)
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    forms = lambda w: [w[:k] + "-" for k in (4, 5, 6) if len(w) >= k] + [w]
    n = Counter(y for _, y in sample)
    df = {y: Counter(f for t, z in sample if z == y for f in {f for w in words(t) for f in forms(w)}) for y in (0, 1)}

    def odds(f):
        a, b = (df[y][f] + 500 * (df[0][f] + df[1][f]) / (n[0] + n[1]) for y in (1, 0))
        if not a:
            return 0.0
        d = math.log(a / (n[1] + 500 - a)) - math.log(b / (n[0] + 500 - b))
        return max(abs(d) - 2 * math.sqrt(1 / a + 1 / b), 0) * (1 if d > 0 else -1)

    known = {}

    def token(w):
        if w not in known:
            known[w] = max((odds(f) for f in forms(w)), key=abs) - 0.2
        return known[w]

    best = []
    for t, y in sample:
        if not y and (w := words(t)):
            found = toxicity.segments([token(x) for x in w])
            best.append((max((x[2] for x in found), default=0.0), len(w)))
    rate = min(4.0, max(0.5, math.pi / math.sqrt(6) / np.std([x for x, _ in best])))
    chance = math.exp(rate * (np.mean([x for x, _ in best]) - 0.5772 / rate)) / np.mean([k for _, k in best])
    assert math.isclose(model.rate, rate, rel_tol=1e-6) and math.isclose(model.chance, max(chance, 1e-4), rel_tol=1e-6)
    evidence = lambda t, cut: sum(e for *_, x in cut([token(w) for w in words(t)]) if (e := rate * x - math.log(model.chance * max(len(words(t)), 1))) > 0)
    fast = lambda s: toxicity.segments(s)
    x = np.array([math.log1p(evidence(t, fast)) for t, _ in sample])
    p = 1 / (1 + np.exp(-(model.slope * x + model.bias)))
    y = np.array([y for _, y in sample])
    assert abs((y - p).sum()) < 0.01 and abs(((y - p) * x).sum() - 0.5 * model.slope) < 0.01  # the logistic curve's optimum
    got = {r["doc_id"]: r["score"] for r in queries.op9_toxicity(spark, data).collect()}
    short = 0
    for r in docs.collect():
        t = r["text"] or ""
        by_force = len(words(t)) <= 60
        short += by_force
        e = evidence(t, (lambda s: slow_segments(s, 0, len(s))) if by_force else fast)
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-(model.slope * math.log1p(e) + model.bias)))) < 1e-6
    assert short > 20


def test_segments_in_linear_time():
    def took(n):
        began = time.perf_counter()
        toxicity.segments([1, -2] * n)
        toxicity.segments([-1, 2] * n)
        toxicity.segments([2, -1] * n)
        return time.perf_counter() - began

    took(10_000)
    assert took(500_000) < 25  # a million scores each
    assert took(200_000) < 6 * took(100_000)
    assert toxicity.segments([1, -2] * 5) == [(2 * k, 2 * k + 1, 1) for k in range(5)]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(5)
    for _ in range(300):
        s = rng.normal(rng.normal(-0.1, 0.3), 1, rng.integers(0, 60)).tolist()
        assert [(a, b, round(x, 6)) for a, b, x in toxicity.segments(s)] == [(a, b, round(x, 6)) for a, b, x in slow_segments(s, 0, len(s))]


def components_by_force(rows, percent, words):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        for k, n in Counter(k for x in sets[i] for k in index[x]).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[k]) - n):
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
        for x in sets[i]:
            index[x].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("percent", "words"), [(90, 3), (80, 5)])
def test_jaccard(spark, documents, percent, words):
    rng = np.random.default_rng(percent)
    base = [f"w{k}" for k in range(120)]
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    for k in range(60):  # a group of near copies whose members aren't all similar to each other
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 7)):
            w[j] = f"x{rng.integers(0, 40)}"
        rows.append((10_000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, percent, words).collect()}
    assert got == components_by_force(rows, percent, words)


def test_jaccard_counts_all_links(spark):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(200):  # more different texts than one block holds
        w = [f"w{k}" for k in range(100)]
        for j in rng.integers(0, 100, rng.integers(0, 4)):
            w[j] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    texts += [*texts[:20], *texts[:5], *[f"v{k} " + " ".join(f"u{j}" for j in range(60)) for k in range(3)], "alone here now", "", None]
    sets = {i: set(zip(*[(t or "").split()[k:] for k in range(3)], strict=False)) for i, t in enumerate(texts)}
    want = {i: sum(10 * len(a & b) >= 9 * len(a | b) for k, b in sets.items() if k != i) if a else 0 for i, a in sets.items()}
    # a document that stands there twice is one
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[0])], "doc_id bigint, text string").repartition(3)
    got = jaccard.near_duplicates(df).collect()
    assert {r["doc_id"]: r["n_links"] for r in got if r["doc_id"] is not None} == want and len(got) == len(texts) + 2
    assert [r["n_links"] for r in got if r["doc_id"] is None] == [0]


def test_jaccard_large_groups_and_versions(spark):
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([f"own{k}", *base])) for k in range(3000)]  # one large group of near copies
    rows += [(10_000 + k, "an exact copy of these nine words here now") for k in range(3000)]
    rows += [(20_000, "one version of a document here"), (20_000, "an exact copy of these nine words here now"), (20_001, "one version of a document here")]
    got = defaultdict(set)
    for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect():
        got[r["doc_id"]].add((r["component_id"], r["n_links"]))
    assert {got[k].pop() for k in range(3000)} == {(0, 2999)}
    both = {x for k in range(10_000, 13_000) for x in got[k]}
    version = got[20_000]
    assert len(version) == 1 and version in ({(20_000, 1)}, {(10_000, 3000)})  # the text of the smaller hash links
    assert both == ({(10_000, 3000)} if version == {(10_000, 3000)} else {(10_000, 2999)})


def test_jaccard_odd(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    want = components_by_force(rows, 90, 3)
    out = jaccard.near_duplicates(odd).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None} == want and len(out) == odd.count()
    assert jaccard.near_duplicates(empty).count() == 0


def without_copies(rows, min_words=20):
    """Lines that go from each document: in a run of equal lines, blank ones left out, with any earlier document. All pairs."""
    lines = {i: [(k, x.strip(" \t\n\r\x0b\x0c")) for k, x in enumerate((t or "").split("\n"))] for i, t in rows}
    lines = {i: [(k, x, len(WORD.findall(x))) for k, x in s if x] for i, s in lines.items()}
    gone = {i: set() for i in lines}
    for d, b in lines.items():
        for e, a in lines.items():
            if e >= d:
                continue
            where = defaultdict(list)
            for i, x in enumerate(a):
                where[x[1]].append(i)
            for j in range(len(b)):
                for i in where[b[j][1]]:
                    if i and j and a[i - 1][1] == b[j - 1][1]:
                        continue  # not where a run begins
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                        n += 1
                    if sum(x[2] for x in b[j : j + n]) >= min_words:
                        gone[d].update(x[0] for x in b[j : j + n])
    return gone


def check_lines(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    gone = without_copies(rows)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    texts = dict(rows)
    assert {i: r["n_removed"] for i, r in out.items()} == {i: len(g) for i, g in gone.items()}
    for i, r in out.items():
        assert (r["text"] or "") == "\n".join(x for k, x in enumerate((texts[i] or "").split("\n")) if k not in gone[i])
    # every line stays somewhere
    assert {x.strip() for t in texts.values() for x in (t or "").split("\n")} - {""} <= {x.strip() for r in out.values() for x in (r["text"] or "").split("\n")}
    return gone


def test_line_dedup(spark, documents):
    check_lines(spark, [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_line_dedup_of_short_lines_and_moved_passages(spark):
    a, b, c, d, e = ([f"{x}{k} {x} {x} {x} {x} {x}" for k in range(4)] for x in "abcde")
    A, B, C, D = (f"{x} six words in this line" for x in "ABCD")
    rows = [(1, [A, B]), (2, [B, C]), (3, [C, D]), (10, [A, B, C, D]), (11, [A, "", B, C, "  ", D]), (12, a + b + c), (13, c + ["x"] + a + ["y"] + b), (14, ["z", *d, *d, "q", *e]), (15, [*e, *d, *d, *d]), (16, [*d[:2], "w", *d[2:]]), (17, a[2:] + b[:2] + ["r"]), (18, None), (19, ""), (20, ["one word"] * 50), (21, ["one word"] * 60), (22, ["19 " + "w " * 18, "x", "y"]), (23, ["19 " + "w " * 18, "x", "y"])]
    gone = check_lines(spark, [(i, t if t is None or t == "" else "\n".join(t)) for i, t in rows])
    assert len(gone[11]) == 4 and len(gone[13]) == 12 and not gone[16] and len(gone[21]) == 60 and len(gone[23]) == 3
    rng = np.random.default_rng(6)
    lines = [" ".join(f"l{k}" for _ in range(rng.integers(1, 24))) for k in range(12)]
    check_lines(spark, [(i, "\n".join(lines[k] for k in rng.integers(0, 12, rng.integers(0, 14)))) for i in range(60)])


def test_line_dedup_hot_passage_and_repeated_rows(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(k, f"own line {k}\n{passage}", k % 3) for k in range(4000)] + [(7, f"own line 7\n{passage}", 0)] * 5 + [(None, passage, 0), (3, passage, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, gone int").withColumns({"copy": F.lit(1), "row": F.lit(2), "a.b": F.lit(3)})
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"] and out.count() == len(rows)
    assert out.filter("n_removed = 1").count() == 3999 + 5 + 1  # of doc 0's passage all later ones; null ids are left alone
    rest = line_dedup.keep_rest(df)
    assert rest.columns == df.columns and rest.count() == len(rows) - 1 and rest.filter("gone = 9").count() == 0


def test_toxicity_is_fitted_outside_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"words of text {k} " + "vile " * (k % 2)) for k in range(600)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic")
    want = toxicity.fit(training.labelled_sample(docs, labels, "toxic", 5, 0, toxicity.SAMPLE))
    fit, driver = toxicity.fit, os.getpid()
    monkeypatch.setattr(toxicity, "fit", lambda sample: None if os.getpid() == driver else fit(sample))
    model = toxicity.learn(docs, labels)
    want.memory.clear()
    assert model == want and model.weights and not model.memory
    assert toxicity.learn(docs, labels.filter("false")) == toxicity.Model()


def test_components_of_few_and_many_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    edges = spark.createDataFrame(rows, "a bigint, b bigint")
    least = {x: x for e in rows for x in e}
    while any(least[a] != least[b] for a, b in rows):
        for a, b in rows:
            least[a] = least[b] = min(least[a], least[b])
    want = {x: y for x, y in least.items() if any(x in e for e in rows if e[0] != e[1])}
    jobs = []
    for few in (common.SMALL, 0):
        spark.sparkContext.setJobGroup(f"components {few}", "")
        assert dict(map(tuple, graph.components(edges, few).collect())) == want
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {few}")))
    assert 4 * jobs[0] < jobs[1]  # a few edges don't cost the driver a plan for each step
    assert graph.components(edges.filter("false")).collect() == []


def test_line_dedup_of_many_lines_in_linear_time(spark):
    body = "\n".join(f"line {k} " + "word " * 20 for k in range(4000))
    docs = spark.createDataFrame([(1, body), (2, f"{body}\nown line"), (3, f"kept\n{body}"), (4, f"{body}\nmiddle\n\n{body}")], "doc_id bigint, text string")
    began = time.time()
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 60  # minutes, if all lines are split again for each deleted one
    assert [out[k]["text"] for k in (1, 2, 3, 4)] == [body, "own line", "kept", "middle\n"]
    assert [out[k]["n_removed"] for k in (1, 2, 3, 4)] == [0, 4000, 4000, 8000]


def test_line_dedup_odd(spark, odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "n_lines", "n_removed"]
    assert out.filter("text IS NULL").count() == 1
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.keep_rest(empty).columns == empty.columns


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert line_dedup.patience([5, 1, 2, 6], [1, 2, 5, 6]) == [(1, 0), (2, 1), (3, 3)]
    assert line_dedup.patience([0, 0], [0, 0]) == []
    assert line_dedup.blocks([(0, 0), (1, 1), (3, 2)], [15, 10, 20], 20) == [(0, 0, 2), (3, 2, 1)]
    # the diff takes the longest order, what crosses it is aligned by itself
    found = line_dedup.align([7, 8, 9], [20, 20, 20], [{"early": 1, "first": 1, "at": [0], "n": 1}, {"early": 1, "first": 2, "at": [1], "n": 1}, {"early": 1, "first": 0, "at": [2], "n": 1}], 20)
    assert sorted(found) == [(1, 0, 2, 1), (1, 1, 0, 2)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.learn(docs, labels)
    for name, stage in corpus_pipeline.STAGES:
        rows = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == before and out.dtypes == docs.dtypes
        out = spark.createDataFrame(out.collect(), out.schema)
        left = {r["doc_id"]: r for r in out.collect()}
        if name == "quality rules":
            assert set(left) == {r["doc_id"] for r in quality_rules.assess(docs).collect() if r["kept"]}
        if name == "toxicity":
            assert set(left) == {i for i, r in rows.items() if model.score(r["text"] or "") < 0.5}
        if name == "n-gram Jaccard join":
            want = components_by_force([(i, r["text"]) for i, r in rows.items()], 80, 5)
            assert set(left) == {i for i, (_, c) in want.items() if i == c}
        if name == "line dedup":
            gone = without_copies([(i, r["text"]) for i, r in rows.items()])
            rest = {i: "\n".join(x for k, x in enumerate((r["text"] or "").split("\n")) if k not in gone[i]) for i, r in rows.items()}
            assert {i: r["text"] for i, r in left.items()} == {i: t for i, t in rest.items() if not gone[i] or WORD.search(t)}
            assert all(r["n_chars"] == (len(r["text"]) if gone[i] else rows[i]["n_chars"]) for i, r in left.items())
        if name == "packing":
            tok = library(WORD_BPE)
            assert check_pieces(out.collect(), {i: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for i, r in rows.items()}) == 0
        docs = out
    assert docs.count() > 0
    final = corpus_pipeline.run(spark, DATA)
    assert sorted(final.select("doc_id", "start", "length", "ids_crc32").collect())[:1] and final.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()


def test_pipeline_odd(spark, odd, empty, tmp_path):
    """Nulls, repeated rows, clashing names, a folder without labels, and no rows at all."""
    import corpus_pipeline

    many = odd.unionByName(odd).withColumns({c: F.lit(5) for c in ("row", "copy", "left", "score", "n_words", "n_removed", "n_chars", "component_id", "a.b")})
    for k, docs in enumerate((many, empty)):
        folder = f"{tmp_path}/{k}"
        docs.write.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert out.columns == docs.columns and (out.count() > 0 or name == "quality rules" or not k == 0)
        corpus_pipeline.run(spark, folder).count()


def test_pipeline_stages_return_small_row_groups(spark, tmp_path):
    """Of 40 MB that don't compress: what tasks hold while they read one stage's result and write the next is bounded."""
    import corpus_pipeline
    import pyarrow.parquet as pq

    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(k, rng.bytes(1 << 14).hex(), "en") for k in range(1250)], "doc_id long, text string, lang string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1)
    try:
        for name, stage in corpus_pipeline.STAGES[1:3]:
            stage(spark, docs, str(tmp_path)).coalesce(1).write.parquet(f"{tmp_path}/{name}")
            files = [pq.ParquetFile(p).metadata for p in (tmp_path / name).glob("*.parquet")]
            sizes = [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]
            assert sum(m.num_rows for m in files) == 1250 and max(sizes) < 2.5 * corpus_pipeline.ROW_GROUP
    finally:
        spark.conf.unset(corpus_pipeline.GROUPS)
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert spark.conf.get(corpus_pipeline.GROUPS, None) is None  # and run leaves the session as it was


def test_pipeline_stages_send_small_batches(spark, tmp_path):
    """Of 12 MB in one partition: what stands in Arrow's memory, and in a worker, at once is bounded by bytes, not by rows."""
    import corpus_pipeline
    import pyarrow as pa

    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.expr("repeat(hex(xxhash64(id)), 512)").alias("text"), F.lit("en").alias("lang")).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    for key in corpus_pipeline.BOUNDS:
        spark.conf.unset(key)
    try:
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path))
            got = docs.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r["n"] for r in got) == 1500 and max(r["size"] for r in got) < 1.5 * corpus_pipeline.BATCH
            spark.conf.unset(corpus_pipeline.BATCHES)
        spark.conf.set(corpus_pipeline.BATCHES, "12345")
        corpus_pipeline.run(spark, str(tmp_path)).count()
        assert spark.conf.get(corpus_pipeline.BATCHES) == "12345"  # what the caller has set holds
    finally:
        for key in corpus_pipeline.BOUNDS:
            spark.conf.unset(key)
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert spark.conf.get(corpus_pipeline.BATCHES, None) is None


def test_shingles_of_fewer_words_than_one_shingle():
    """A slice may hold fewer words, all its texts together, than a shingle has; its texts get the shingles they get elsewhere."""
    words = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (3, 5):
        for counts in ([0], [1], [2], [3], [4], [1, 1], [0, 3], [1, 0, 2]):
            counts = np.array(counts)
            few = common.ngram_hashes(words[: counts.sum()], counts, n)
            many = common.ngram_hashes(words, np.append(counts, 8 - counts.sum()), n)
            assert few[0].tolist() == many[0][: len(few[0])].tolist() and few[1].tolist() == many[1][:-1].tolist() == [max(min(c, 1), c - n + 1) for c in counts.tolist()]


def test_rows_of_the_driver_start_no_workers(spark, documents):
    """Tables that the driver has made are plain rows for Spark, not an RDD that Python workers of its own read again."""
    left = spark.range(40).select((F.col("id") % 4).alias("k"), "id")
    right = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    joined = common.skewed_join(left, right, "k", "id", [(1, 3)])
    for df in (quality_rules.references(documents), joined, quality_rules.keep(documents), graph.components(left.select(F.col("id").alias("a"), F.col("k").alias("b")))):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect())) == sorted((i % 4, i, 10 * (i % 4)) for i in range(40))
    none = common.rows_of(spark, [], quality_rules.pa.schema({"a": quality_rules.pa.int64()}))
    assert none.dtypes == [("a", "bigint")] and none.collect() == []
    assert {r["lang"] for r in quality_rules.references(documents).collect()} == {"", "en", "de", "fr", "es"}


def test_byte_encoder_merges_new_units_at_once(monkeypatch):
    """A proposal is wrong for most new words of syllables; they aren't proposed, checked and merged, but merged."""
    rng = np.random.default_rng(9)
    syllables = ["er", "th", "on", "the", "re", "an", "ou", "ing", "ed", "é", "ß", "ñ", "99", ".", "'s"]
    rows = [" ".join("".join(rng.choice(syllables, rng.integers(1, 7))) for _ in range(300)) for _ in range(40)]
    rows += ["a" * 3000 + " " + "ab" * 2000, "a" * 3000 + " " + "ab" * 2000 + "c"]
    own = bpe.ByteEncoder(default_path(BYTE_BPE))
    monkeypatch.setattr(bpe.SpeculativeBpe, "_propose", None)
    for _ in range(2):  # learned, then remembered
        got = own.encode([r.encode() for r in rows])
        want = own.library.encode_batch_fast(rows, add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in want]


def test_bytes_are_compared_to_the_last():
    """Units of equal size that differ in one byte only, at any place, are told apart, short and long ones."""
    own = bpe.ByteEncoder(default_path(BYTE_BPE))
    for n in (1, 7, 8, 9, 16, 17, 1024, 1025, 5000):
        unit = np.full(n, 97, np.uint8)
        first = own._remember(unit, np.array([0]), np.array([n]))[0]
        places = np.unique([0, n // 2, n - 1])
        rows = [unit] + [np.where(np.arange(n) == k, 98, unit).astype(np.uint8) for k in places]
        begin = np.arange(len(rows)) * n
        same = own._equal(np.concatenate(rows), begin, begin + n, np.full(len(rows), first))
        assert same.tolist() == [True] + [False] * len(places)
