import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import _common as c
from corvane.llm import curve_packing as cp
from corvane.llm import token_blocks as tb

TEXTS = [
    (5, "Hello, World.  it's 42 §§ naïve café"), (3, None), (9, ""), (1, "a\x0bb\x85c\xa0d é ΑΣ ς"), (1, "a\x0bb\x85c\xa0d é ΑΣ ς"),
    (None, "null id"), (7, "The the THE the, the. don't <|endoftext|> x" * 400), (8, "İstanbul ſt ß ﬁ 你好，世界 🙂 \x1cq")
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(c.public_vocabulary())


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, part string, ids_crc32 int")


def plain(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_word_ids_equal_whole_text_encoding(tokenizer, monkeypatch):
    import pyarrow as pa

    w = c.WordIds(c.public_vocabulary())
    texts = pa.array([t for _, t in TEXTS])
    want = [plain(tokenizer, t)[:-1] for _, t in TEXTS]
    for _ in range(2):
        assert [x.tolist() for x in w.documents(texts)] == want
    monkeypatch.setattr(c.WordIds, "WORDS", 3)  # emptied all the time
    monkeypatch.setattr(c.WordIds, "CHUNK", 30)
    assert [x.tolist() for x in w.documents(texts.slice(1))] == want[1:]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=900), st.sampled_from([0, 7, 12, 32]))
def test_segments_round_trip(ids, bits):
    ids = np.array(ids, "u4") & np.uint32((1 << bits) - 1 if bits < 32 else 2**32 - 1)
    data = tb.encode_segment(ids)
    assert (tb.decode_segment(data) == ids).all()
    assert (tb.decode_segment(data, 1, 3) == ids[256:768]).all()


def test_token_blocks(spark, tokenizer):
    got = tb.read_token_blocks(tb.write_token_blocks(docs(spark), c.public_vocabulary())).collect()
    at, want = 0, []
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0])):
        ids = plain(tokenizer, t)
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tb.read_token_blocks(tb.write_token_blocks(docs(spark, []), c.public_vocabulary())).count() == 0


def test_hilbert_keys_walk_the_whole_grid_by_single_steps():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = cp.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing_places_every_token_once(spark, tokenizer, sf_dir):
    sets = [docs(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), docs(spark, [])]
    for df in sets:
        got = cp.pack_documents(df, c.public_vocabulary(), with_ids=True).collect()
        want = sorted(str((r.doc_id, plain(tokenizer, r.text))) for r in df.collect())
        if df is sets[1]:
            whole = {}
            for r in sorted(got, key=lambda r: r.start):
                whole.setdefault(r.doc_id, []).extend(r.ids)
                assert r.start + r.length == len(whole[r.doc_id]) and r.length == len(r.ids)
            assert sorted(str(x) for x in whole.items()) == want
        assert sum(r.length for r in got) == sum(len(plain(tokenizer, r.text)) for r in df.collect())
        fill = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == fill.get(r.sequence_id, 0)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
            fill[r.sequence_id] = r.offset + r.length
        assert all(x <= 4096 and x & (x - 1) == 0 for x in fill.values())


def test_a_vocabulary_of_another_kind_gets_whole_texts():
    path = c.public_vocabulary("byte_bpe_50k.json")
    ids, plain = c.WordIds(path), Tokenizer.from_file(path)
    assert not ids.by_words and c.WordIds(c.public_vocabulary()).by_words
    texts = ["Hello World  HELLO", "", None, " tab\tand\n\nlines ", "É é 🙂 don't"]
    got = [x.tolist() for x in ids.documents(pa.array(texts, "string"))]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts] and got[0] != plain.encode("hello world hello").ids


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *_: None)

    context = type("Context", (), {"getConf": lambda self: Conf, "master": "spark://host:7077"})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        c.shared_dir(type("Session", (), {"sparkContext": context, "conf": Conf})())
