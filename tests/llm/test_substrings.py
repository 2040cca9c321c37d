import hashlib
import random

import pytest

from quadloom.llm import substrings

SCHEMA = "doc_id long, text string, places string, row int"


def brute(rows, window):
    """(doc_id, words, removed, digest, kept words) of each row; equal rows are one document."""
    seen, out = {}, {}
    known = sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=lambda r: (r[0], r[1]))
    for d, t in known:
        words = t.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.setdefault(key, (d, i))
        out[d, t] = [w for w, g in zip(words, gone, strict=True) if not g], len(words)
    rows = [(d, t, *out.get((d, t), ((t or "").encode().split(), len((t or "").encode().split())))) for d, t in rows]
    return sorted(((d, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for d, t, kept, n in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "p", 7) for d, t in rows], SCHEMA)


def run(spark, rows, window, prefix):
    return sorted((tuple(r) for r in substrings.repeat_digests(frame(spark, rows), window, prefix).collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    passages = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([8, 15, 40]))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(5)}" for _ in range(rng.randrange(30))))
        texts.append(rng.choice(["\n", "  ", "\t"]).join(parts))
    texts += ["a " * 90, "a b " * 50, "a " * 3]
    return list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))


@pytest.mark.parametrize("window,prefix", [(20, 6), (6, 2), (5, 5)])
def test_against_brute_force(spark, window, prefix):
    rows = corpus(window, 120)
    assert run(spark, rows, window, prefix) == brute(rows, window)


def test_odd_rows(spark):
    long = " ".join(f"v{i % 7919}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\x0b"), (4, "q r"), (None, long), (5, long), (5, long), (6, long + " x"), (7, "y " + long)]
    assert run(spark, rows, 20, 6) == brute(rows, 20)
    assert run(spark, [], 20, 6) == []


def test_batches_of_any_size_give_the_same(spark):
    rows = corpus(9, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert run(spark, rows, 6, 2) == brute(rows, 6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cleaned_texts_keep_columns_and_untouched_texts(spark):
    rows = [(1, "a  b\nc d e f"), (2, "x a b c d e f  y"), (3, None), (None, "a b c d e f")]
    out = substrings.remove_repeats(frame(spark, rows), 5, 2)
    assert out.columns == ["doc_id", "text", "places", "row"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(1, "a  b\nc d e f", "p", 7), (2, "x y", "p", 7), (3, None, "p", 7), (None, "a b c d e f", "p", 7)], key=repr)
