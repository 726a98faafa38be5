import random

import corpus_pipeline as cp
from corvane.llm import near_copies as nc


def brute(text):
    words = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows):
    sets, ids = [brute(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                ids[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def test_stage_equals_brute_force(spark, sf_dir):
    rng = random.Random(5)
    rows = []
    for k in range(12):  # copies with 1 to 12 of 200 words changed: on both sides of 0.8
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for j in range(8):
            words = list(base)
            for at in rng.sample(range(200), rng.randrange(1, 13)):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((100 * k + j, " ".join(words)))
    passage = " ".join(f"common{i}" for i in range(60))
    rows += [(5000 + i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(20 + i % 9))) for i in range(60)]
    rows += [(6000 + i, f"{passage} {' '.join(f'tail{j}' for j in range(i))}") for i in range(25)]  # a chain
    rows += [(7000, ""), (7001, None), (7002, " \n"), (7003, "one two"), (7004, "ONE  two"), (None, "one two"), (None, "alone without number"), (7005, "b c d e f g"), (7006, "b c d e f g b c d e f g")]
    rows += [(r.doc_id + 10000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, __row int")
    got = cp.near_dedup(spark, df, sf_dir)
    assert got.columns == df.columns
    least = {}
    for (i, _), g in zip(rows, groups(rows)):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(map(str, least.values()))
    assert nc.keep_one_of_each(df.limit(0)).count() == 0
