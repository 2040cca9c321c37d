import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadloom.llm import token_counts as T
from quadloom.llm.tokens import BYTE_BPE, encode

DATA = "/root/testdata/sf0.01"
WORDS = st.lists(st.sampled_from(["a", "word", "it's", "'", "'re", "'l", "l", " ", "  ", "\n", "\n\n", "\t", "12", "!", "...", "é", "\x1c", "　", "\xa0", "日本", "<|endoftext|>", "<|endof", "text|>"]), max_size=60).map("".join)


def count(text):
    return len(encode(text))


@settings(max_examples=400, deadline=None)
@given(WORDS, st.lists(st.tuples(st.integers(-2, 80), st.integers(-1, 30), WORDS), max_size=6), st.integers(1, 12))
def test_edited_trees_count_as_whole_texts_do(text, edits, leaf):
    t = T.SegmentTree(text, leaf=leaf)
    assert t.total == count(text)
    for place, removed, inserted in edits:
        a = min(max(place, 0), len(text))
        text = text[:a] + inserted + text[min(a + max(removed, 0), len(text)) :]
        t.edit(place, removed, inserted)
        assert t.text == text and t.total == count(text) and t.chars[0] == len(text)
        t = T.SegmentTree(text, leaf=leaf, tree=(t.chars, t.tokens))


def test_a_table(spark):
    own = Tokenizer.from_file(BYTE_BPE)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in T.recounts(docs).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == len(own.encode(text, add_special_tokens=False).ids)
        for place, removed, inserted in T.standard_edits(len(text)):
            a = min(place, len(text))
            text = text[:a] + inserted + text[min(a + removed, len(text)) :]
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.edited_tokens == len(own.encode(text, add_special_tokens=False).ids)
        assert r.encoded_chars <= 8 * T.LEAF


def test_stored_trees_and_odd_rows(spark):
    long = "some words " * 30_000
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "<|endoftext|> x", 1), (4, long, 1), (5, "same", 1), (5, "same", 1), (None, "y", 1), (6, " " * 1_100_000, 1), (7, "a" + "\n \t" * 400_000 + "b", 1)], "doc_id long, text string, n_tokens int")
    counted = T.count_tokens(df)
    edits = spark.createDataFrame([(4, 2, 100, 3, "zz"), (4, 1, 0, 0, "yy "), (1, 1, 5, 5, "new"), (5, None, None, None, None), (9, 1, 1, 1, "?")], "doc_id long, seq long, place long, removed long, inserted string")
    out = T.apply_edits(counted, edits).collect()
    assert len(out) == 9
    assert all(r.n_tokens == count(r.text) for r in out)
    got = next(r for r in out if r.doc_id == 4)
    once = "yy " + long
    assert got.text == once[:100] + "zz" + once[103:] and got.encoded_chars < 10_000
    assert T.recounts(df.limit(0)).collect() == [] and len(T.recounts(df).collect()) == 9
