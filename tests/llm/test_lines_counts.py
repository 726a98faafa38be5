import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

from corvane.llm import _common as c
from corvane.llm import count_rollup as cr
from corvane.llm import line_templates as lt


def masked(line):
    return [re.sub(r"^.*[0-9].*$", "<*>", w, flags=re.S) for w in re.split("[ \t-\r]+", line) if w]


def greedy(lines):
    """The template of each line of a leaf, by the rule as it is written: the first of the templates that agree most, if at 80 % of the places or more."""
    found, of = [], []
    for m in lines:
        same = [sum(x == y for x, y in zip(g, m)) for g in found]
        k = same.index(max(same)) if same and 5 * max(same) >= 4 * len(m) else len(found)
        found[k:] = [tuple(x if x == y else "<*>" for x, y in zip(found[k], m))] + found[k + 1 :] if k < len(found) else [m]
        of.append(k)
    return [found[k] for k in of]


def brute(rows):
    """Places to drop of each row."""
    lines, n, by = [], Counter(), defaultdict(set)
    for _, t in rows:
        for p, m in enumerate(map(tuple, map(masked, (t or "").split("\n")))):
            if m:
                lines.append((t, p, m))
                n[m] += 1
                by[(len(m), *m[:3])].add(m)
    template = {}
    for some in by.values():
        order = sorted(some, key=lambda m: (-n[m], " ".join(m).encode()))
        if sum(n[m] for m in some) >= 5:
            template.update(zip(order, greedy(order)))
    texts, gone = defaultdict(set), defaultdict(set)
    for t, _, m in lines:
        if m in template:
            texts[len(m), m[:3], template[m]].add(t)
    for t, p, m in lines:
        if m in template and len(texts[len(m), m[:3], template[m]]) >= 5:
            gone[t].add(p)
    return [(i, t, gone[t]) for i, t in rows]


def test_templates():
    a = lt.templates([x.split() for x in ("user alice signed in from home today", "user bob signed in from home today", "user carol went out for a walk", "user dave signed in from work today")])
    assert a[0] == a[1] == tuple("user <*> signed in from home today".split())
    assert a[2] == tuple("user carol went out for a walk".split()) and a[3] != a[2]


def test_line_dedup_equals_brute_force(spark, sf_dir):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(3, 20)))
    rows = []
    for i in range(60):
        parts = [prose() for _ in range(rng.randrange(1, 6))]
        parts.insert(rng.randrange(len(parts)), f"Page {i} of {i * 7} printed for reader{i} on this day")
        parts.insert(0, rng.choice(["Contact our press team at North office for all details", "Contact our press team at South office for all details", f"Read  more:\t{i}", ""]))
        rows.append((i, "\n".join(parts)))
    rows += [(200 + i, "One copied line of prose here\nanother copied line of prose\nand the last one") for i in range(30)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, rows[7][1]), (90, None), (91, ""), (92, "\n\n")]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, len(t or ""), 1) for i, t in rows], "doc_id long, text string, n_chars long, places int")
    got = lt.drop_repeated_lines(df)
    assert got.columns == df.columns
    want = []
    for i, t, gone in brute(rows):
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        want.append((i, kept, len(kept or "")))
    assert sorted((str((r.doc_id, r.text, r.n_chars)) for r in got.collect())) == sorted(str(w) for w in want)
    texts = [w[1] or "" for w in want]
    assert not any(re.search(r"Page \d+ of|Contact our press", t) for t in texts) and sum("One copied line" in t for t in texts) == 30
    assert lt.drop_repeated_lines(df.limit(0)).count() == 0


def test_line_query(spark, sf_dir):
    got = {r.doc_id: r for r in lt.op7(spark, sf_dir).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for i, t, gone in brute(rows):
        kept = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        assert tuple(got[i]) == (i, len(t.split("\n")), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_rollup(spark, tmp_path):
    r = cr.Rollup(spark, f"file://{tmp_path}/rollup")
    change = lambda rows: spark.createDataFrame(rows, "doc_id long, version string, source string, lang string, n_tokens long")
    state = lambda: sorted((tuple(x) for x in r.totals().collect()), key=str)
    assert state() == []
    first = change([(1, "v", "a", "en", 5), (2, "v", "a", "en", 7), (None, "v", None, "en", 1), (1, "w", "a", "en", 50), (1, "v", "a", "en", 4)])
    assert r.commit(0, first) and not r.commit(0, first)
    assert state() == sorted([("a", "en", "v", 2, 12), (None, "en", "v", 1, 1), ("a", "en", "w", 1, 50)], key=str)
    assert r.commit(1, change([(1, "v", "b", "fr", 6), (2, "v", None, None, None), (9, "v", "a", "en", None), (None, "v", None, "en", 2)]))
    assert state() == sorted([("b", "fr", "v", 1, 6), (None, "en", "v", 1, 2), ("a", "en", "w", 1, 50)], key=str)
    assert not r.commit(1, first) and r.commit(2, change([])) and r.commit(3, change([(2, "v", "a", "en", 3)]))
    assert ("a", "en", "v", 1, 3) in state() and r.batches() == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="comes after"):
        r2 = cr.Rollup(spark, f"file://{tmp_path}/late")
        r2.commit(1, first)
        r2.commit(0, first)
    docs = spark.createDataFrame([(1, "a", "en", "Hello, there"), (2, "a", "en", None)], "doc_id long, source string, lang string, text string")
    assert [x.n for x in cr.with_bpe_counts(docs, c.public_vocabulary(), "n").orderBy("doc_id").collect()] == [3, 0]


def test_compaction_changes_no_totals(spark, tmp_path):
    change = lambda rows: spark.createDataFrame(rows, "doc_id long, version string, source string, lang string, n_tokens long")
    plain, small = cr.Rollup(spark, f"file://{tmp_path}/plain"), cr.Rollup(spark, f"file://{tmp_path}/small")
    rng = random.Random(3)
    for k in range(5):
        rows = change([(rng.randrange(6), "v", rng.choice("ab"), "en", rng.choice([None, 1, 2, 3])) for _ in range(4)])
        assert plain.commit(k, rows) and small.commit(k, rows)
        small.compact()
        assert not small.commit(k, rows)
        assert sorted(map(str, plain.totals().collect())) == sorted(map(str, small.totals().collect()))
    assert small._whole("base", "upto") == [4] and small._whole("ledger", "batch") == []


def test_rollup_query(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(cr.WORDS_BYTES_SQL).fetchall()
    assert sorted(map(tuple, cr.rollup_words_bytes(spark, sf_dir).collect())) == sorted(want)
    tokenizer, first = Tokenizer.from_file(c.public_vocabulary()), {}
    docs = con.sql("select doc_id, source, lang, coalesce(text, '') from documents order by doc_id").fetchall()
    for d in docs:
        first.setdefault(d[3], d[0])
    n = defaultdict(lambda: [0, 0])
    for i, source, lang, t in docs:
        if first[t] == i:
            n[source, lang][0] += 1
            n[source, lang][1] += len(tokenizer.encode(t, add_special_tokens=False).ids)
    want += [(s, g, "word_bpe_49k", *k) for (s, g), k in n.items()]
    assert sorted(map(tuple, cr.op5(spark, sf_dir).collect())) == sorted(want)
