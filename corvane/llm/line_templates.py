"""Line dedup by a log-template tree.

A line's path in the tree has a fixed depth: its number of tokens, then its leading tokens, where a token with a digit
is a variable field (``<*>``). In a leaf, lines whose tokens agree at enough places are of one template, whose other
places become ``<*>``; lines are taken in the order of how often they occur, each held against every template of its
leaf that can agree. A
template that recurs in enough different texts is boilerplate, and its lines are dropped. Exact copies are one text, so
lines that only copied documents share are left to document dedup.
"""

from __future__ import annotations

from contextlib import contextmanager
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

DEPTH, SIMILAR, MIN_DOCS, SALTS = 3, 0.8, 5, 16


def templates(lines: list[list[str]], similar: float = SIMILAR) -> list[tuple[str, ...]]:
    """The template of each of one leaf's lines (token lists of one length), most frequent line first."""
    groups: list[list[str]] = []
    mine = []
    for tokens in lines:
        best, most = None, -1
        for k, g in enumerate(groups):
            same = sum(a == b for a, b in zip(g, tokens))
            if same > most:
                best, most = k, same
        if best is not None and most >= similar * len(tokens):
            groups[best] = [a if a == b else "<*>" for a, b in zip(groups[best], tokens)]
            mine.append(best)
        else:
            groups.append(list(tokens))
            mine.append(len(groups) - 1)
    return [tuple(groups[k]) for k in mine]


def indexed_templates(lines: list[list[str]], similar: float = SIMILAR, depth: int = DEPTH) -> list[tuple[str, ...]]:
    """What ``templates`` gives, for lines that agree in their first ``depth`` tokens, without a look at every template.

    A template may differ from a line at ``off`` places at most, so of ``off + 1`` parts of the other places one is equal.
    """
    size = len(lines[0]) if lines else 0
    off = size - next((k for k in range(size + 1) if k >= similar * size), size + 1)
    parts = [slice(depth + k, None, off + 1) for k in range(off + 1)]
    groups: list[list[str]] = []
    index: list[dict[tuple, set[int]]] = [{} for _ in parts]
    mine = []
    for tokens in lines:
        best, most = None, size - off - 1
        for k in sorted(set().union(*(found.get(tuple(tokens[p]), ()) for found, p in zip(index, parts)))):
            same = sum(map(eq, groups[k], tokens))
            if same > most:
                best, most = k, same
        if best is None:
            best, old, new = len(groups), None, list(tokens)
            groups.append(new)
        else:
            old, new = groups[best], [a if a == b else "<*>" for a, b in zip(groups[best], tokens)]
            groups[best] = new
        mine.append(best)
        for found, p in zip(index, parts) if old != new else ():
            if old is not None and old[p] != new[p]:
                found[tuple(old[p])].discard(best)
            found.setdefault(tuple(new[p]), set()).add(best)
    return [tuple(groups[k]) for k in mine]


@contextmanager
def _filtered_joins(spark):
    """Lets joins with a small filtered table drop rows before their shuffle by a Bloom filter of fixed largest size; results are the same without."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def _rows(docs: DataFrame) -> DataFrame:
    t = c.text_or_empty()
    return docs.select(F.coalesce(c.col("doc_id").cast("long"), F.lit(c.LAST)).alias("d"), F.xxhash64(t).alias("h"), t.alias("text"))


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """d, h, p (place), leaf, line (hash), masked of every line with a word."""
    fields = lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>")).otherwise(x)
    single = lambda x: F.when(x.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")).otherwise(x)
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("p"), F.trim(single(fields(x))).alias("masked")))
    d = _rows(docs).select("d", "h", F.filter(parts, lambda x: x["masked"] != "").alias("parts"))
    # a path is the number of tokens (of the spaces between them) and the text of the first ones
    d = d.withColumn("paths", F.transform("parts", lambda x: F.xxhash64(F.length(x["masked"]) - F.length(F.replace(x["masked"], F.lit(" "), F.lit(""))), F.substring_index(x["masked"], " ", depth))))
    whole = F.transform("parts", lambda x, i: F.struct(x["p"].alias("p"), F.get(F.col("paths"), i).alias("leaf"), F.xxhash64(x["masked"]).alias("line"), x["masked"].alias("masked")))
    return d.select("d", "h", F.explode(whole).alias("x")).select("d", "h", "x.*")


def _merged(distinct: DataFrame, similar: float, depth: int) -> DataFrame:
    """(leaf, line, template) of distinct lines (leaf, line, masked, n) whose template isn't the line itself. A task holds one leaf at a time."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        def done(block):
            if len(block) < 2:
                return
            got = indexed_templates([m.split(" ") for _, _, m in block], similar, depth)
            signed = lambda t: (x := xxhash.xxh64_intdigest(" ".join(t), 42)) - (x >> 63 << 64)  # noqa: E731  the hash that lines have
            out = [(leaf, line, signed(t)) for (leaf, line, m), t in zip(block, got) if " ".join(t) != m]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, "int64") for x in zip(*out)], ["leaf", "line", "template"])

        block, at = [], None
        for batch in batches:
            for leaf, line, masked in zip(*(batch.column(x).to_pylist() for x in ("leaf", "line", "masked"))):
                if leaf != at:
                    yield from done(block)
                    block, at = [], leaf
                block.append((leaf, line, masked))
        yield from done(block)

    sizes = distinct.groupBy("leaf").agg(F.count("*").alias("lines")).filter("lines > 1").select("leaf")
    # no number of partitions, so that adaptive execution puts small ones together
    return distinct.join(sizes, "leaf").repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "masked").select("leaf", "line", "masked").mapInArrow(c.without_vocabularies(run), "leaf long, line long, template long")


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similar: float = SIMILAR) -> DataFrame:
    """(d, h, places): the places of lines to drop, of each distinct (doc_id or the largest long, hash of the text) that has some.

    Lines are parsed once. Leaves of fewer than ``min_docs`` lines can't have a recurring template and are left out by a
    join on leaf and a salt, so the lines of one leaf, or one very common line, are dealt to many tasks; equal lines are
    put together before a leaf's different lines meet. Rows of a common template are split by adaptive execution.
    """
    spark = docs.sparkSession
    lines = c.staged(_lines(docs, depth), "line-places").withColumn("salt", F.pmod(F.xxhash64("d", "h"), F.lit(SALTS)).cast("int"))
    leaves = c.staged(lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf"), "line-leaves")
    leaves = leaves.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))).hint("merge")  # one plan at every size
    with _filtered_joins(spark):
        distinct = lines.select("leaf", "salt", "line", "masked").join(leaves, ["leaf", "salt"]).groupBy("leaf", "line", "masked").agg(F.count("*").alias("n"))
        merged = c.staged(_merged(c.staged(distinct, "line-texts"), similar, depth), "line-merges")
        narrow = lines.select("d", "h", "p", "leaf", "salt", "line").join(leaves, ["leaf", "salt"]).join(merged, ["leaf", "line"], "left")
        narrow = c.staged(narrow.select("d", "h", "p", "leaf", F.coalesce("template", "line").alias("template")), "line-templates")
    texts = narrow.groupBy("leaf", "template", "h").agg(F.lit(1).alias("one"))
    drop = texts.groupBy("leaf", "template").agg(F.count("*").alias("n_texts")).filter(F.col("n_texts") >= min_docs).select("leaf", "template")
    drop = c.staged(drop, "line-drops")  # so that the join reads both sides from plain shuffles, which can be split where one template has very many lines
    return narrow.join(drop, ["leaf", "template"]).groupBy("d", "h").agg(F.collect_set("p").alias("places"))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """Stage: ``docs`` without the lines of recurring templates; ``n_chars``, where there is such a column, follows the text.

    Rows stay, even if all their lines go (the text is then empty). Null texts stay null, blank lines stay. Each row is
    treated by its text, so repeated rows lose the same lines; a null doc_id counts as one document per text.
    """
    d, h, places = c.fresh(docs, "__d", "__h", "__places")
    drop = repeated_lines(docs, **options).toDF(d, h, places)
    own = docs.withColumns({d: F.coalesce(c.col("doc_id").cast("long"), F.lit(c.LAST)), h: F.xxhash64(c.text_or_empty())}).join(drop, [d, h], "left")
    left = F.array_join(F.filter(F.split(c.col("text"), "\n"), lambda x, i: ~F.array_contains(c.col(places), i)), "\n")
    own = own.withColumn("text", F.when(c.col(places).isNull(), c.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        own = own.withColumn("n_chars", F.when(c.col(places).isNull(), c.col("n_chars")).otherwise(F.length(c.col("text"))).cast(docs.schema["n_chars"].dataType))
    return own.select(*c.cols(docs))


def op7(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the text that is left) of every document; a null text is empty, which is one blank line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", c.text_or_empty().alias("text"))
    rows = _rows(docs).select(F.when(F.col("d") != c.LAST, F.col("d")).alias("doc_id"), "d", "h", "text").join(repeated_lines(docs), ["d", "h"], "left")
    n, lines = F.coalesce(F.size("places"), F.lit(0)), F.split("text", "\n")
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("places", i)), "\n"))
    return rows.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.greatest(n, F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))
