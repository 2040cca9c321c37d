import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import chat

DATA = "/root/testdata/sf0.001"
PARTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "s>", "[", "INST]", "/", "\n", "é", "a"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_template_is_reversible(turns):
    formatted = chat.format_conversation(turns)
    assert chat.parse_conversation(formatted) == turns
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
        assert chat.unescape(chat.escape(text)) == text


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        context = chat.format_conversation(turns[:-1]) if len(turns) > 1 else ""
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(chat.format_conversation(turns)), sha(context), True))
    return sorted(out, key=repr)


def run(df):
    named = chat.named_turns(df)
    forest = chat.prefix_forest(named)
    return named, forest, sorted((tuple(r) for r in chat.read_back(named, forest).collect()), key=repr)


def check_forest(named, forest):
    """Shared tokens once, depth-first, positions and intervals as a conversation alone would have them."""
    nodes = {r.node: r for r in forest.collect()}
    assert len(nodes) == forest.count()
    sequences = defaultdict(list)
    for r in nodes.values():
        sequences[r.tree].append(r)
    for parts in sequences.values():
        at, stack = 0, []
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += len(r.tokens)
            del stack[r.depth :]
            assert (stack[-1] if stack else None) == r.parent  # depth-first
            stack.append(r.node)
    paths = defaultdict(list)
    for r in named.collect():
        paths[r.conv].append((r.depth, r.node))
    assert {n for p in paths.values() for _, n in p} == nodes.keys()
    for p in paths.values():
        position, before = 0, []
        for _, name in sorted(p):
            r = nodes[name]
            assert r.position_ids == list(range(position, position + len(r.tokens)))
            assert [i for s in r.intervals for i in range(s["from"], s["to"])] == before
            assert all(x["to"] < y["from"] for x, y in zip(r.intervals, r.intervals[1:], strict=False))
            before += range(r.start, r.start + len(r.tokens))
            position += len(r.tokens)


def test_a_table(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    named, forest, got = run(df.repartition(3))
    assert got == brute([tuple(r) for r in df.collect()])
    check_forest(named, forest)


def test_shared_turns_and_odd_rows(spark):
    rows = []
    for c in range(40):
        turns = [("system", "same"), ("user", f"q{c % 5}"), ("assistant", f"a{c % 10}"), ("user", f"x{c % 20}")][: c % 4 + 1]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (50, None, None, None), (50, 0, "assistant", ""), (50, 0, "assistant", ""), (None, 3, "user", "no id"), (None, 1, "assistant", "\\<s>")]
    rows += [(60, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)] + [(61, 0, "assistant", "long " * 30_000), (62, 0, "user", " " * 1_100_000), (62, 1, "assistant", "a" + "\n" * 1_100_000 + "b")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, node string")
    named, forest, got = run(df)
    assert got == brute(rows)
    check_forest(named, forest)
    assert forest.where("depth = 0").count() == 7


def test_empty(spark):
    _, forest, got = run(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert got == [] and forest.collect() == []
