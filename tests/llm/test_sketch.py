import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import paragraph_sketch as ps


def parts(t):
    return Counter(p for p in re.split(r"\n|(?<=[.!?])[ \t-\r]+", t) if re.search(r"[^ \t-\r]", p))


def dice(a, b):
    n = a.total() + b.total()
    return 1.0 if not n else 2 * (a & b).total() / n


def peeled(print_, other=None):
    """Digests on either side that only one fingerprint holds, from the strings alone."""
    sketches = []
    for s in (print_, other) if other else (print_,):
        w, _, rest = s.partition(":")
        sketches.append((int(w, 16), {int(q[0], 16): [int(v, 16) for v in q[1:]] for q in (c.split(",") for c in rest.split(";") if c)}))
    places = lambda g, w: [3 * (g >> 21 * j & w - 1) + j for j in range(3)]

    def drain(cells, w):
        cells, out = {k: list(v) for k, v in cells.items()}, {}
        todo = list(cells)
        while todo:
            x, g, n = cells.get(todo.pop(), (0, 0, 0))
            if abs(n) == 1 and g == xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42):
                out[x] = g, n
                for k in places(g, w):
                    cells[k] = [cells[k][0] ^ x, cells[k][1] ^ g, cells[k][2] - n]
                    todo.append(k)
        return out if not any(map(any, cells.values())) else None

    if not other:
        return drain(sketches[0][1], sketches[0][0])
    alone = [drain(c, w) for w, c in sketches]
    w = max(w for w, _ in sketches)
    for w in (w << i for i in range(12)):
        sides = []
        for (own, cells), got in zip(sketches, alone):
            if own != w:
                cells = {}
                for x, (g, _) in got.items():
                    for k in places(g, w):
                        a, b, n = cells.get(k, (0, 0, 0))
                        cells[k] = [a ^ x, b ^ g, n + 1]
            sides.append(cells)
        less = {k: [p ^ q for p, q in zip(sides[0].get(k, (0, 0))[:2], sides[1].get(k, (0, 0))[:2])] + [sides[0].get(k, (0, 0, 0))[2] - sides[1].get(k, (0, 0, 0))[2]] for k in {*sides[0], *sides[1]}}
        got = drain(less, w)
        if got is not None:
            return got
    raise AssertionError("not peeled")


@pytest.fixture(scope="module")
def queried(spark, sf_dir, tmp_path_factory):
    rows = [(i, "".join(f"Line {j * (i % 7 + 1)} of it. And more {j}!\n" for j in range(i % 40))) for i in range(1, 60)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "é🙂 no end"), (104, "same"), (105, "same"), (106, "".join(f"p{j}\n" for j in range(9000)))]
    rows += [(107, "again\n" * 3000 + "once"), (108, "again\n" * 40), (109, "again\n" * 41)]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    path = str(tmp_path_factory.mktemp("sketch"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows, {r.doc_id: r for r in ps.op8(spark, path).collect()}


def test_equals_brute_force(queried):
    rows, got = queried
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        h, r = len(t) // 2, got[i]
        edited = t[: len(t) - h] + nxt[:h]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - dice(parts(t), parts(edited))) < 1e-9 and abs(r.near_next - dice(parts(t), parts(nxt))) < 1e-9
    assert got[104].fingerprint == got[105].fingerprint != got[103].fingerprint
    assert got[108].fingerprint != got[109].fingerprint and 0.98 < got[109].near_next < 1
    assert len({r.fingerprint for r in got.values()}) == len({frozenset(parts(t or "").items()) for _, t in rows})


def test_likeness_can_be_had_from_the_strings(queried):
    rows, got = queried
    order = sorted(got, reverse=True)
    for i, after in zip(order, order[1:] + order[:1]):
        own = got[i].fingerprint
        for other, near in ((got[i].edited_fingerprint, got[i].near_edited), (got[after].fingerprint, got[i].near_next)):
            n = len(peeled(own)) + len(peeled(other))
            assert abs(near - (1 - len(peeled(own, other)) / n if n else 1.0)) < 1e-9


def test_difference_recovers_the_digests(spark):
    df = spark.createDataFrame([("a\nb\nb\nc", "b\nd\nc"), ("", "x"), ("x", "x")], "s string, t string")
    sketched = lambda x: F.explode(F.array(ps.sketch(ps.digests(F.col(x)))))
    df = df.withColumn("a", sketched("s")).withColumn("b", sketched("t"))
    got = df.select(ps.difference(F.col("a"), F.col("b")).alias("d"), ps.digests(F.col("s")).alias("a"), ps.digests(F.col("t")).alias("b")).collect()
    for r in got:
        assert set(r.d.a) == set(r.a) - set(r.b) and set(r.d.b) == set(r.b) - set(r.a)


def test_edges(spark):
    ties = spark.createDataFrame([(None, "b"), (None, None), (3, "x"), (3, "x"), (3, "y")], "doc_id long, text string")
    assert ps.with_next(ties).filter("next_text is null").count() == 0 and ps.with_next(ties).count() == 5
    one = ps.with_next(ties.limit(1)).collect()
    assert len(one) == 1 and one[0].next_text == one[0].text
    assert ps.with_next(ties.limit(0)).count() == 0
