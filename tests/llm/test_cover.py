import hashlib
import random

from corvane.llm import cover_dedup as cd


def brute(rows):
    starts, out = {}, []
    key = lambda i: (i is None, i or 0)
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - 49):
            g = tuple(w[p : p + 50])
            starts[g] = min(starts.get(g, key(i)), key(i))
    for i, w in split:
        gone = set()
        for p in range(len(w) - 49):
            if starts[tuple(w[p : p + 50])] < key(i):
                gone.update(range(p, p + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def test_cover_meets_every_difference():
    assert {(a - b) % cd.PERIOD for a in cd.COVER for b in cd.COVER} == set(range(cd.PERIOD))


def test_equals_brute_force(spark, sf_dir):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 300)]
    rows = [(i, None if i == 3 else "") for i in range(3, 5)]
    for i in range(60):
        w = [word() for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((rng.choice([None, *range(100, 140)]), rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [rows[10], rows[20], (5000, rows[11][1]), (1, " " + rows[12][1]), (7, "same " * 500), (8, "same " * 70), (9, "same " * 49), (10, "to and " * 90), (11, "x " + "and to " * 60 + "y " + "to and " * 40), (12, "one two three " * 70)]
    rows += [(r.doc_id + 6000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, th int, n_words int")
    got = sorted((tuple(r) for r in cd.remove_repeats(df, with_text=True).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 20
    assert cd.remove_repeats(df.limit(0)).count() == 0


def test_many_copies_and_repeated_words(spark):
    rng = random.Random(8)
    text = " ".join(f"c{rng.randrange(50)}" for _ in range(130))
    rows = [(i, text) for i in range(3000)] + [(None, text), (5000, text + " more"), (5001, "so on " * 400), (5002, "on so " * 300)]
    got = sorted((tuple(r) for r in cd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()), key=str)
    assert got == brute(rows)
    assert cd._windows(spark.createDataFrame([(1, 2, "so on " * 400, [])], "d long, th long, text string, anchors array<long>")).count() == 0
