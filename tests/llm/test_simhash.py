import random

import xxhash

from corvane.llm import simhash_planes as sp
from corvane.llm.components import components


def brute(text):
    words = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(rows):
    ids = list(range(len(rows)))
    fps = [brute(t) for _, t in rows]
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    ids[i] = ids[j] = min(ids[i], ids[j])
    return fps, ids


def test_fingerprint():
    for t in ("", "   ", "One", "one TWO", "É x y ÉZ\x0bq", "a b c d " * 50):
        assert sp.fingerprint(t.encode()) == brute(t)


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    values = {0}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            v = base
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    low = rng.getrandbits(64)
    values |= {low ^ rng.getrandbits(16) for _ in range(700)}  # one bucket that holds them all
    values = sorted(values)
    want = {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2}
    sp_lanes, sp.LANES = sp.LANES, 64
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = [(r.a % 2**64, r.b % 2**64) for r in sp.links(spark.createDataFrame([(v,) for v in signed], "__fp long")).collect()]
    sp.LANES = sp_lanes
    assert len(got) == len(want) and {frozenset(x) for x in got} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(-5, 7), (100, 101), (101, 100), (9, 9), (None, 3), (-9, 200), (300, -9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(51), -5), -5: -5, 100: 100, 101: 100, -9: -9, 200: -9, 300: -9}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_and_stage(spark, sf_dir):
    base = " ".join(f"word{i} thing{i * 7 % 31}" for i in range(400))
    rows = [(4, base), (2, base + " tail"), (9, base), (9, base), (None, base), (7, ""), (6, None), (8, "one two"), (5, "ONE two"), (None, "lonely text here indeed")]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, __fp int")
    fps, ids = groups(rows)
    least = {g: min((rows[k][0] for k in range(len(rows)) if ids[k] == g and rows[k][0] is not None), default=None) for g in ids}
    got = sp.simhash_groups(df.select("doc_id", "text")).collect()
    assert sorted(str((r.doc_id, r["__fp"] % 2**64, r["__component"])) for r in got) == sorted(str((i, f, least[g])) for (i, _), f, g in zip(rows, fps, ids))
    kept = sp.keep_one_of_each(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(least[g]) for g in set(ids))
    assert kept[0].asDict().keys() == {"doc_id", "text", "__fp"}
    assert sp.simhash_groups(df.select("doc_id", "text").limit(0)).count() == 0
