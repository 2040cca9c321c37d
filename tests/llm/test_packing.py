import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quadloom.llm import packing, tokens
from quadloom.llm.packing import Limits, Piece

DATA = "/root/testdata/sf0.01"


def check_pieces(rows, ids_of, limit):
    """Every id in exactly one piece; sequences gapless from 0 and no longer than the limit. Returns the padding's share."""
    for r in rows:
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert docs.keys() == ids_of.keys()
    for d, parts in docs.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == len(ids_of[d])
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
        total += at
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding / max(1, total)


def test_ids_are_those_of_the_tokenizers_library(spark):
    own = Tokenizer.from_file(tokens.BYTE_BPE)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += ["", "a<|endoftext|> b <|endoftext|>", "l'été  \n\n x's 've 12345  　日本", "!" * 3000, "a" * 3000]
    for text, found in zip(texts, own.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.encode(text).tolist() == found.ids


def test_documents_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = packing.pack_texts(docs.repartition(3)).collect()
    ids_of = {r.doc_id: [*tokens.encode(r.text).tolist(), 1] for r in docs.collect()}
    assert check_pieces(rows, ids_of, 2048) == 0


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "word " * 9000, 7), (4, "a", 8), (5, " " * 1_100_000, 9), (6, "x" + "\n\t \u3000" * 300_000 + "<|endoftext|> y", 9), (None, "no id", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    assert check_pieces(packing.pack_texts(df).collect(), {d: [*tokens.encode(t or "").tolist(), 1] for d, t, _ in rows}, 2048) == 0
    assert packing.pack_texts(df.limit(0)).collect() == []
    same = spark.createDataFrame([(None, "x y"), (7, "x y"), (7, "x y")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.length) for r in packing.pack_texts(same.coalesce(1)).collect()), key=repr)


def test_examples_keep_all_limits(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(n), int(rng.integers(0, n + 1))) for i, n in enumerate(rng.integers(1, 900, 900))]
    limits = Limits(1024, 8, 512)
    rows = [(i, n, min(x, 512)) for i, n, x in rows]
    out = packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long"), limits).collect()
    assert sorted((r.example_id, r.tokens, r.loss_tokens) for r in out) == rows
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        assert sum(r.tokens for r in parts) <= 1024 and len(parts) <= 8 and sum(r.loss_tokens for r in parts) <= 512
    least = max(sum(r[1] for r in rows) / 1024, len(rows) / 8, sum(r[2] for r in rows) / 512)
    assert len(by) <= 1.25 * least + 8


def test_example_beyond_a_limit_raises():
    with pytest.raises(ValueError):
        packing.Sequences(Limits(10, 2, 5)).place(Piece(0, 0, 6, 6))
