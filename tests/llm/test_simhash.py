import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quadloom.llm import simhash

DATA = "/root/testdata/sf0.001"


def edited(rows):
    """(n_chars, digest) of each document's edited text, in plain Python; rows sorted by id, ids distinct."""
    out = {}
    for i, (d, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + following[:k]
        out[d] = len(t), hashlib.sha256(e.encode()).hexdigest(), e, following
    return out


def votes(hashes):
    """A fingerprint by counting each bit's votes one by one."""
    counts = [0] * 64
    for bits, weight in hashes:
        for b in range(64):
            counts[b] += weight if bits >> b & 1 else -weight
    return sum(1 << b for b in range(64) if counts[b] > 0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_edited_texts_and_order(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = edited(rows)
    got = {r.doc_id: r for r in simhash.edited_fingerprints(docs.repartition(5)).collect()}
    assert got.keys() == want.keys()
    texts = {d: t for d, t in rows} | {("e", d): w[2] for d, w in want.items()}
    frame = spark.createDataFrame([(str(k), t) for k, t in texts.items()], "k string, text string")
    own = {r.k: r.fingerprint for r in simhash.fingerprints(frame, ["k"]).collect()}
    mask = (1 << 64) - 1
    for (d, _), (after, _) in zip(rows, [*rows[1:], rows[0]], strict=True):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == want[d][:2]
        a, e, g = (own[str(k)] & mask for k in (d, ("e", d), after))
        assert r.fingerprint == f"{a:016x}" and r.edited_fingerprint == f"{e:016x}"
        assert r.near_edited == 1 - (a ^ e).bit_count() / 64 and r.near_next == 1 - (a ^ g).bit_count() / 64
    long = [r for r in got.values() if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.7 > 0.6 > sum(r.near_next for r in long) / len(long)


def test_fingerprints_against_counting(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "bb", "ccc", "dédé", "x" * 30]) for _ in range(rng.randrange(60)))) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r.k: r.fingerprint for r in simhash.fingerprints(df, ["k"]).collect()}
    found = df.select("k", F.explode_outer(simhash.terms(F.col("text"))).alias("t")).select("k", "t", F.xxhash64("t").alias("h")).collect()
    for k, text in rows:
        own = [(r.h & (2**64 - 1), r.t & 63) for r in found if r.k == k and r.t is not None]
        words = text.split()
        assert [w for _, w in own] == [sum(min(15, len(x)) for x in words[i : i + 3]) for i in range(len(words))]
        assert got[k] & (2**64 - 1) == votes(own)


def test_search_against_all_pairs(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = {0, 2**64 - 1, *seeds}
    for s in seeds:
        for _ in range(10):
            prints.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed] * 2 + [(None,)], "fingerprint long")
    for radius in (0, 3, 5):
        want = {(a, b, (a ^ b & (2**64 - 1)).bit_count()) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
        got = [tuple(r) for r in simhash.within_radius(df, df, radius).collect()]
        assert len(got) == len(set(got)) and {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}
        assert all(((a ^ b) & (2**64 - 1)).bit_count() == d for a, b, d in got)


def test_odd_rows(spark):
    rows = [(None, "n", 1), (1, None, 1), (2, "", 2), (3, "a b c d e f g h", 3), (3, "a b c d e f g h", 3), (4, " \n", 4), (5, "w " * 50_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    out = {r.doc_id: r for r in simhash.edited_fingerprints(df).collect()}
    assert len(out) == 6
    assert out[1].fingerprint == out[2].fingerprint == out[4].fingerprint == "0" * 16
    assert out[5].n_chars == 100_000 and out[3].n_chars == 15
    assert simhash.edited_fingerprints(df.limit(0)).collect() == []
    one = simhash.edited_fingerprints(df.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_neighbours(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here " * 5
    df = spark.createDataFrame([(7, text), (20, text), (40, "other words entirely " * 9), (9, None), (None, text)], "doc_id long, text string")
    assert [tuple(r) for r in simhash.neighbours(df).collect()] == [(20, 7, 0)]


def test_neighbours_in_classes(spark, monkeypatch):
    # Fingerprints by hand: 20 with a copy of larger id, 40 in reach of a class of three, 60 alone.
    prints = {20: 5, 33: 5, 40: (1 << 40) - 1, 7: (1 << 40) - 4, 34: (1 << 40) - 4, 80: (1 << 40) - 4, 60: 0x5555 << 44}
    rows = [(d, str(p), p) for d, p in prints.items()] + [(None, "5", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p long")
    monkeypatch.setattr(simhash, "fingerprints", lambda base, keys, text="text": base.select(*keys, F.col("text").cast("long").alias("fingerprint")).distinct())
    least = {d: min(e for e in prints if prints[e] == prints[d]) for d in prints}
    apart = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    want = {(d, e, apart(d, e)) for d in prints if d % 20 == 0 for e in prints if e != d and apart(d, e) <= 3}
    assert {(20, 33, 0), (40, 7, 2), (40, 34, 2), (40, 80, 2), (80, 7, 0), (80, 34, 0), (80, 40, 2)} <= want
    got = [tuple(r) for r in simhash.neighbours(df).collect()]
    assert sorted(got) == sorted(want)
    reach = [tuple(r) for r in simhash.classes_in_reach(df).collect()]
    assert sorted(reach) == sorted({(d, least[d], least[d], 0) for d in prints} | {(d, least[d], least[e], k) for d, e, k in want if k})


def test_query_returns_the_class_of_every_document(spark, docs):
    from quadloom.llm.queries import simhash_neighbours

    prints = {r.doc_id: r.fingerprint for r in simhash.fingerprints(docs, ["doc_id"]).collect()}
    least = {}
    for d, p in sorted(prints.items()):
        least.setdefault(p, d)
    mask = (1 << 64) - 1
    want = {(d, least[p], least[p], 0) for d, p in prints.items()}
    want |= {(d, least[p], least[q], ((p ^ q) & mask).bit_count()) for d, p in prints.items() if d % 20 == 0 for q in least if q != p and ((p ^ q) & mask).bit_count() <= simhash.RADIUS}
    assert sorted(tuple(r) for r in simhash_neighbours(spark, DATA).collect()) == sorted(want)


def test_edited_fingerprints_name_the_nearest_class(spark, docs):
    reach = {}
    for r in simhash.classes_in_reach(docs).collect():
        reach.setdefault(r.doc_id, []).append((r.distance, r.near_id))
    for r in simhash.edited_fingerprints(docs).collect():
        (own,) = [c for d, c in reach[r.doc_id] if not d]
        others = sorted(x for x in reach[r.doc_id] if x[0])
        assert r.class_id == own
        assert (r.near_distance, r.near_class_id, r.n_near) == ((*(others[0] if others else (None, None)), len(others)) if r.doc_id % 20 == 0 else (None, None, None))
