import random

import pytest

from quadloom.llm import minhash

SCHEMA = "doc_id long, text string, bands string, k1 int"


def brute(rows, words, percent):
    """(doc_id, n, component, kept) of each row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or both and 100 * both >= percent * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least[root(i)] if d is not None else None, d is not None and least[root(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def run(spark, rows, words, percent):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in minhash.near_duplicates(df, words, percent).collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            old = rng.choice(texts[-6:]).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                old[rng.randrange(len(old))] = word()
            texts.append(" ".join(old))
        else:
            texts.append(" ".join(word() for _ in range(rng.choice([1, 2, 3, 30, 60, 120]))))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, words, percent):
    rows = corpus(words, 150)
    assert run(spark, rows, words, percent) == brute(rows, words, percent)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a b"), (6, "b a"), (None, "a b"), (7, long), (8, long + " end"), (9, "q r s t u v w"), (9, "a b"), (9, "a b")]
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_empty(spark):
    assert run(spark, [], 3, 85) == []


def test_chain_of_copies_that_do_not_all_link(spark):
    base = [f"x{i}" for i in range(200)]
    rows = []
    for i in range(40):
        t = list(base)
        for j in range(i):
            t[j * 5] = f"y{j}"
        rows.append((i, " ".join(t)))
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)


def pairs_of(crowds):
    """How many pairs of classes the tasks compare."""
    sizes = {}
    for r in crowds.collect():
        sizes.setdefault((r.kind, r.id, r.p, r.q), {}).setdefault(r.block, set()).add((r.rep, r.k1))
    return sum(len(x[p]) * len(x[q]) if p != q else len(x[p]) * (len(x[p]) - 1) // 2 for (_, _, p, q), x in sizes.items())


@pytest.fixture
def compared(monkeypatch):
    """Pairs that the search among what stars leave compared, call by call."""
    found, own = [], minhash._crowds

    def counted(nodes, keys, crowd=minhash.CROWD):
        out = own(nodes, keys, crowd)
        found.append(pairs_of(out))
        return out

    monkeypatch.setattr(minhash, "_crowds", counted)
    return found


def test_classes_that_share_most_but_not_enough_are_not_compared(spark, compared):
    common = " ".join(f"c{i}" for i in range(100))
    texts = [common + " " + " ".join(f"u{n}_{i}" for i in range(21)) for n in range(1500)]  # similarity 0.69
    got = run(spark, list(enumerate(texts)), 3, 85)
    assert got == sorted([(i, 119, i, True) for i in range(1500)], key=repr)
    assert compared == [0]


def test_chains_of_classes_are_compared_by_bucket(spark, monkeypatch):
    """Neighbours in a chain share much, so all are one cluster; where blocks are small its buckets take fewer copies than the whole."""
    own, kinds = minhash._crowds, set()

    def small(nodes, keys):
        out = own(nodes, keys, 2)
        kinds.update(r.kind for r in out.select("kind").distinct().collect())
        return out

    monkeypatch.setattr(minhash, "_crowds", small)
    words = [f"w{i}" for i in range(1000)]
    rows = [(n, " ".join(words[n * 8 : n * 8 + 60])) for n in range(90)]
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)
    assert 1 in kinds


def test_large_clusters_against_brute_force(spark, monkeypatch):
    """Crowds of four: clusters are split by key and into blocks."""
    own = minhash._crowds
    monkeypatch.setattr(minhash, "_crowds", lambda nodes, keys: own(nodes, keys, 4))
    rng = random.Random(1)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            t[rng.randrange(80)] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(t)))
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_two_texts_under_one_id_in_a_cluster(spark):
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(30):
        t = list(base)
        t[i] = f"x{i}"
        t[(i * 7) % 60] = f"y{i}"
        rows.append((i // 2, " ".join(t)))
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)
