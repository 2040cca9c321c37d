import hashlib
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import assert_same  # noqa: E402
from test_packing import check_pieces  # noqa: E402

import corpus_pipeline  # noqa: E402
from quadloom.llm import tokens  # noqa: E402
from quadloom.llm.oracles import ORACLES  # noqa: E402
from quadloom.llm.queries import QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_oracle(spark, name):
    assert_same(spark, DATA, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys() - {"embedding_recall"}))
def test_other_queries_return_each_document(spark, name):
    out = QUERIES[name](spark, DATA)
    docs = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    got = {r.doc_id for r in out.where("doc_id IS NOT NULL").select("doc_id").collect()}
    assert got == docs if name != "simhash_neighbours" else got <= docs


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it made."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, DATA).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["language ID", "MinHash near-dedup", "substring dedup", "packing"]
    first = stages[0][1]
    for _, _, made in stages[:-1]:
        assert made.columns == first.columns and [t for _, t in made.dtypes] == [t for _, t in first.dtypes]


def test_language_stage_keeps_clean_documents(stages):
    _, given, made = stages[0]
    assert made.count() >= 0.99 * given.count()
    assert {tuple(r) for r in made.collect()} <= {tuple(r) for r in given.collect()}


def test_near_duplicate_stage_against_all_pairs(stages):
    _, given, made = stages[1]
    sets = {}
    for r in given.collect():
        w = r.text.encode().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = defaultdict(set)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    kept, seen = [], set()
    for a in ids:
        if a not in seen:
            kept.append(a)
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += links[x]
    assert sorted(r.doc_id for r in made.collect()) == kept


def test_substring_stage_against_all_windows(stages):
    _, given, made = stages[2]
    seen, want = set(), {}
    for r in sorted(given.collect(), key=lambda r: r.doc_id):
        w = r.text.split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        want[r.doc_id] = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else r.text
    got = {r.doc_id: r.text for r in made.collect()}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in made.collect())


def test_packing_stage(stages):
    _, given, made = stages[3]
    assert check_pieces(made.collect(), {r.doc_id: [*tokens.encode(r.text).tolist(), 1] for r in given.collect()}, 2048) == 0


def test_run_is_its_stages(spark, stages):
    digest = lambda df: hashlib.sha256(repr(sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())).encode()).hexdigest()
    pieces = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in stages[3][2].collect()}
    assert digest(pieces.groupBy("doc_id").agg({"length": "sum"}).selectExpr("doc_id", "0 AS start", "`sum(length)` AS length", "0 AS ids_crc32")) == digest(stages[3][2].groupBy("doc_id").agg({"length": "sum"}).selectExpr("doc_id", "0 AS start", "`sum(length)` AS length", "0 AS ids_crc32"))


def test_near_duplicate_stage_keeps_rows_without_id_and_with_repeated_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    a, b, c, d, e, f = map(text, "abcdef")
    kept = [(None, a, "x"), (None, b, "x"), (3, c, "x"), (5, d, "x"), (5, e, "x"), (7, f, "x"), (8, "", "x"), (None, None, "x")]
    near = [(None, c + " end", "x"), (None, a + " end", "y"), (5, c, "x"), (9, d + " end", "x"), (7, f, "x")]
    docs = spark.createDataFrame(kept + near, "doc_id long, text string, source string")
    for parts in (1, 5):
        out = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), DATA).collect()]
        named = sorted(r for r in out if r[0] is not None)
        assert named == sorted(r for r in kept if r[0] is not None)
        unnamed = [t for i, t, _ in out if i is None]
        assert len(unnamed) == 3 and b in unnamed and None in unnamed and (a in unnamed) != (a + " end" in unnamed)
    # Rows equal in id and text: the same one every time.
    twins = spark.createDataFrame([(1, a, s) for s in "stuvw"], "doc_id long, text string, source string")
    found = {tuple(map(tuple, corpus_pipeline.drop_near_duplicates(spark, twins.repartition(n), DATA).collect())) for n in (1, 2, 4)}
    assert len(found) == 1 and len(next(iter(found))) == 1
