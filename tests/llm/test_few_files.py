import pytest

from corvane.llm import _common as c
from corvane.llm import curve_packing, line_templates, near_copies


@pytest.fixture
def many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_small_tables_are_staged_in_few_files(many_partitions, sf_dir, monkeypatch):
    spark, files, real = many_partitions, {}, c.staged

    def staged(df, what):
        out = real(df, what)
        files[what] = max(files.get(what, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(c, "staged", staged)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near_copies.links(docs)
    line_templates.repeated_lines(docs)
    c.staged(curve_packing.pack_documents(docs, c.public_vocabulary()), "packed")
    assert {"shingle-buckets", "line-merges", "packed"} <= set(files)
    assert max(files[x] for x in ("shingle-buckets", "line-merges", "packed")) <= 8, files


def test_packing_holds_no_vocabulary(spark, monkeypatch):
    seen, real = [], c.without_vocabularies
    monkeypatch.setattr(c, "without_vocabularies", lambda run: seen.append(run.__name__) or real(run))
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    rows = curve_packing.pack_documents(docs, c.public_vocabulary()).collect()
    assert seen == ["pack"]
    assert sorted((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == [(1, 4), (2, 1)]
