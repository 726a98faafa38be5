import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.llm import jump_shards as js
from corvane.llm import rule_ledger as rl

TEXTS = [None, "", " \n\t ", "a b c a b c a b", "x\nx\n\n\n y\x0bz", "# ## #a *|<>", "one two three " * 40, "ÉÀ héé 🙂 " * 30, "A B C", "same line here\n" * 30, "UPPER CASE!! WORDS!! " * 40, " ".join(f"w{i}abc" for i in range(3000)), "\x1c \xa0  x"]


def words(t):
    for x in "\t\n\x0b\x0c\r":
        t = t.replace(x, " ")
    return [w for w in t.split(" ") if w]


def plain(t):
    t = t or ""
    w = words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})


def test_measurements(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, __failed int, n_words int")
    rows = rl.ledger(df.select("doc_id", "text")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"]) == plain(TEXTS[r.doc_id]), TEXTS[r.doc_id]
    kept = rl.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [11] and kept.collect()[0]["__failed"] == 1
    assert rl.ledger(df.limit(0).select("doc_id", "text")).count() == 0
    full = {r.rule: r for r in rl.ablations(rl.ledger(df.select("doc_id", "text")), rl.POLICIES[rl.CURRENT]).collect()}
    assert full[None].n_docs == len(TEXTS) and full[None].n_kept == 1 and full[None].n_regained == 0
    assert full["duplicate_lines"].n_regained == full["duplicate_lines"].n_kept - 1


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    return con


def test_sql_says_the_same(spark, sf_dir, duck):
    got = sorted(map(tuple, rl.op2(spark, sf_dir).collect()))
    assert got == sorted(duck.sql(rl.OP2_SQL).fetchall())
    assert 0 < sum(r[7] for r in got) < len(got)


def test_labelled_good_documents_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    by = {(r.quality, r.kept): r["count"] for r in rl.op2(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) <= 0.01 * by[(1, True)], by
    assert by.get((0, True), 0) <= 0.15 * by[(0, False)], by


def lamping_veach(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shard_is_the_published_one(spark):
    keys = [0, 1, 2, 10863919174838991, -1, -(2**63), 2**63 - 1, *range(100, 200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 1000):
        assert [r[0] for r in df.select(js.jump_shard(df.k, n)).collect()] == [lamping_veach(k, n) for k in keys]


def test_sharding(spark, sf_dir, tmp_path):
    rows = [(7, "a", 1), (7, "a", 1), (7, None, 2), (None, "b", 3), (None, "", 4)] + [(i, "é" * (i % 50), 0) for i in range(1000, 1300)]
    rows += [(None, f"text {i}", 5) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").withColumn("__shard", F.col("slot"))
    out, (size, crc, shard, slot, grown) = js.shard_documents(df)
    assert out.columns[:4] == df.columns and slot == "slot_" and shard == "shard"
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        b = (r.text or "").encode()
        assert (r[size], r[crc]) == (len(b) + 1, zlib.crc32(b))
        assert r[shard] == lamping_veach(r.doc_id or 0, 8) and r[grown] in (r[shard], 8) and r[grown] == lamping_veach(r.doc_id or 0, 9)
    for s in range(8):
        mine = sorted(r[slot] for r in got if r[shard] == s)
        assert mine == list(range(len(mine)))
    js.write_shards(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert js.shard_documents(df.limit(0))[0].count() == 0


def test_shard_query(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = js.op3(spark, sf_dir)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        b = texts[r.doc_id]
        assert tuple(r)[1:5] == (len(b) + 1, zlib.crc32(b), "key", lamping_veach(r.doc_id, 8)) and r.grown_shard == lamping_veach(r.doc_id, 9)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(8))
