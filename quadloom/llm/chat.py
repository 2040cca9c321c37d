"""Chat formatting over a prefix tree of conversations.

Template. A conversation is <s>, then [INST]role[/INST]text</s> for each turn. Control strings inside roles and texts are broken up
by a backslash after their first character, and backslashes are doubled, so the formatted text parses back to exactly
what went in. Control strings are ids of their own after the tokenizer's; everything between is the ids of the escaped string.
Assistants' texts bear loss.

Tree. A node is a turn after a given run of turns; conversations that begin alike share its nodes, and each node's tokens are made and kept
once. A tree is all conversations that share a first turn; its sequence is its nodes depth-first. A node has its start in
that sequence, position ids that run on from its parent's as if its conversation stood alone, and the intervals of the sequence that its
ancestors' tokens fill (neighbouring ones are merged): a token attends to those and to the tokens before it in its own node.

How it is computed. Turns stream through one sort by conversation; a running digest names each node. The distinct paths of node names
are sorted by ranges, which is the depth-first order; a node belongs to the first path through it. Starts are sums over that
order: within a path, within a range, then over ranges. Texts stream and are never gathered; a path is one row with the names of its
nodes, so a conversation's turns should number some millions at most. A first turn that a third of all conversations share is one
partial aggregate, and what is joined to it is a plain join that adaptive execution can split.

Reading back goes by the sequence alone: a conversation is the place of its last turn, whose intervals say which stretches of the tree's
sequence it attends to, and position ids say in which order those are. Stretches find their nodes by blocks of BLOCK tokens.

Defined results: a null role or text is empty. Rows of a conversation are ordered by turn (nulls first), then role, then text;
repeated rows are turns of their own. Rows with a null conv_id are one conversation without an id. Other columns are ignored. An empty table gives
empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, mapped, slices
from .tokens import BYTE_BPE, audit, byte_bpe, ordinary

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
#: What a text must not contain unbroken; the first four are the template's own.
CONTROL = (BEGIN, END, OPEN, CLOSE, "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
_TO_ESCAPE = re.compile("|".join([r"\\", *(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)]))
_ESCAPED = re.compile(r"\\(.)", re.S)
LOSS_ROLE = "assistant"
#: Stands for a null conv_id among the keys.
NO_CONVERSATION = -(1 << 63)
#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33
#: Tokens of a tree's sequence in a block, by which stretches find the nodes that start in them.
BLOCK = 256


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{CLOSE}{escape(text)}{END}"


def format_conversation(turns: list[tuple[str, str]]) -> str:
    return BEGIN + "".join(format_turn(*t) for t in turns)


def parse_conversation(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    if not formatted.startswith(BEGIN):
        raise ValueError("a conversation begins with " + BEGIN)
    turns, rest = [], formatted[len(BEGIN) :]
    while rest:
        turn, end, rest = rest.partition(END)
        role, close, text = turn.partition(CLOSE)
        if not (end and close and role.startswith(OPEN)):
            raise ValueError("not a turn: " + turn[:80])
        turns.append((unescape(role[len(OPEN) :]), unescape(text)))
    return turns


@dataclass(frozen=True)
class Codec:
    """Token ids of turns and back."""

    path: str = BYTE_BPE

    @property
    def first_control(self) -> int:
        return byte_bpe(self.path).n_vocab

    def control(self, mark: str) -> int:
        return self.first_control + CONTROL.index(mark)

    def encode_turn(self, role: str, text: str, first: bool) -> tuple[list[int], int, int, int]:
        """Ids, the loss span in them, and the code points formatted."""
        plain = lambda t: ordinary(t, self.path).tolist()
        role_, text_ = escape(role), escape(text)
        head = [self.control(BEGIN)] * first + [self.control(OPEN), *plain(role_), self.control(CLOSE)]
        body = plain(text_)
        loss = len(body) if role == LOSS_ROLE else 0
        chars = len(BEGIN) * first + len(OPEN) + len(role_) + len(CLOSE) + len(text_) + len(END)
        return [*head, *body, self.control(END)], len(head), len(head) + loss, chars

    def decode(self, ids: list[int]) -> str:
        """The formatted text of ids."""
        out, held, first = [], [], self.first_control
        raw = byte_bpe(self.path).decode_bytes
        for i in ids:
            if i < first:
                held.append(i)
            else:
                out += [raw(held), CONTROL[i - first].encode()]
                held = []
        return b"".join([*out, raw(held)]).decode()


def _name_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over turns sorted by conversation: a node's name digests its parent's name, its role and its text."""
    conversation, depth, parent = object(), 0, b""
    for batch in batches:
        convs, _, roles, texts = (c.to_pylist() for c in batch.columns)
        depths, names, parents = [], [], []
        for c, role, text in zip(convs, roles, texts, strict=True):
            if c != conversation:
                conversation, depth, parent = c, 0, b""
            raw = role.encode()
            name = hashlib.blake2b(parent + len(raw).to_bytes(8, "little") + raw + text.encode(), digest_size=16).digest()
            depths.append(depth)
            names.append(name.hex())
            parents.append(parent.hex() if depth else None)
            depth, parent = depth + 1, name
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depths, pa.int64()), pa.array(names, pa.string()), pa.array(parents, pa.string()), batch.column(2), batch.column(3)], names=["conv", "depth", "node", "parent", "role", "text"])


def _encoder(codec: Codec):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            depths, roles, texts = (batch.column(i).to_pylist() for i in (2, 3, 4))
            audit([escape(t) for t in texts], codec.path, special=False)
            found = [codec.encode_turn(r, t, d == 0) for d, r, t in zip(depths, roles, texts, strict=True)]
            lists = pa.array([f[0] for f in found], pa.list_(pa.int32()))
            rest = [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists, *rest], names=["node", "parent", "depth", "tokens", "loss_from", "loss_to", "n_chars"])

    return encode


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the nodes of all paths, sorted by path and depth: position and ancestors' intervals of the nodes that a path owns."""
    path, position, intervals = None, 0, []
    for batch in batches:
        out = []
        for rank, depth, owner, node, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rank != path:
                path, position, intervals = rank, 0, []
            if owner == rank:
                out.append((node, position, [*intervals]))
            position += n
            if intervals and intervals[-1][1] == start:
                intervals = [*intervals[:-1], (intervals[-1][0], start + n)]
            else:
                intervals = [*intervals, (start, start + n)]
        spans = pa.array([[{"from": a, "to": b} for a, b in x[2]] for x in out], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), spans], names=["node", "position", "intervals"])


def _running_starts(blocks: DataFrame) -> DataFrame:
    """(owner, block_start): the tokens before each owner's block, over all owners in order."""
    part = F.shiftright("owner", ROW_BITS)
    blocks = blocks.withColumn("part", part)
    own = W.partitionBy("part").orderBy("owner")
    within = blocks.withColumn("before", F.sum("n").over(own) - F.col("n"))
    # One row for each range, so this order is over no more rows than there are partitions.
    totals = blocks.groupBy("part").agg(F.sum("n").alias("all"))
    ranges = totals.agg(F.array_sort(F.collect_list(F.struct("part", "all"))).alias("t"))
    earlier = ranges.select(F.explode(F.transform("t", lambda x: F.struct(x["part"].alias("part"), F.aggregate(F.filter("t", lambda y: y["part"] < x["part"]), F.lit(0).cast("long"), lambda a, y: a + y["all"]).alias("base")))).alias("r")).select("r.*")
    return within.join(F.broadcast(earlier), "part").select("owner", (F.col("before") + F.col("base")).alias("block_start"))


def named_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, depth, node, parent, role, text) of every row."""
    col = lambda c: F.col(f"`{c}`")
    turns = conversations.select(F.coalesce(col(conv_id).cast("long"), F.lit(NO_CONVERSATION)).alias("conv"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text"))
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return cut(mapped(ordered, _name_nodes, "conv long, depth long, node string, parent string, role string, text string"))


def prefix_forest(named: DataFrame, codec: Codec = Codec()) -> DataFrame:
    """The nodes of named turns: (tree, start, node, parent, depth, tokens, position_ids, intervals, loss_from, loss_to, n_chars).

    tree is the name of its first turn; start orders a tree's nodes depth-first and counts tokens; loss_from and loss_to are offsets in tokens.
    """
    paths = named.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("p")).select(F.col("p")["node"].alias("path")).distinct()
    ranked = cut(paths.repartitionByRange("path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id()))
    steps = ranked.select("rank", F.element_at("path", 1).alias("tree"), F.posexplode("path").alias("depth", "node"))
    owners = steps.groupBy("node").agg(F.min("rank").alias("owner"), F.first("tree").alias("tree"))
    texts = named.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"))
    nodes = mapped(texts, _encoder(codec), "node string, parent string, depth long, tokens array<int>, loss_from long, loss_to long, n_chars long")
    nodes = cut(nodes.join(owners, "node"))
    size = F.size("tokens").cast("long")
    sizes = nodes.select("node", "tree", "owner", "depth", size.alias("n"))
    starts = _running_starts(sizes.groupBy("owner").agg(F.sum("n").alias("n")))
    inside = F.sum("n").over(W.partitionBy("owner").orderBy("depth")) - F.col("n")
    placed = sizes.withColumn("inside", inside).join(starts, "owner").select("node", "tree", "owner", "depth", "n", (F.col("block_start") + F.col("inside")).alias("at"))
    roots = placed.where("depth = 0").select("tree", F.col("at").alias("root"))
    placed = cut(placed.join(roots, "tree").select("node", "owner", "n", (F.col("at") - F.col("root")).alias("start")))
    along = steps.join(placed, "node").select("rank", "depth", "owner", "node", "start", "n").repartition("rank").sortWithinPartitions("rank", "depth")
    located = mapped(along, _locate, "node string, position long, intervals array<struct<from: bigint, to: bigint>>")
    out = cut(nodes.join(placed.select("node", "start"), "node").join(located, "node"))
    ids = F.transform("tokens", lambda x, i: (F.col("position") + i).cast("int"))
    return out.select("tree", "start", "node", "parent", "depth", "tokens", ids.alias("position_ids"), "intervals", "loss_from", "loss_to", "n_chars")


def _reader(codec: Codec):
    """Over the nodes that conversations attend to, sorted by conversation and position: a row for each conversation."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_())
        names = [x.split()[0] for x in READ.split(", ")]
        conversation = None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            done = []
            for conv, positions, tokens, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conversation is None or conversation.conv != conv:
                    if conversation is not None:
                        done.append(conversation.row())
                    conversation = _Conversation(conv)
                conversation.add(codec, positions, tokens, a, b)
            yield batch_of(done)
        if conversation is not None:
            yield batch_of([conversation.row()])

    return read


READ = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, context_sha256 string, positions_run_on boolean"


class _Conversation:
    """What one conversation's nodes, in the order of their positions, are read back to."""

    def __init__(self, conv: int):
        self.conv, self.turns, self.chars, self.learnt, self.next, self.run_on = conv, 0, 0, 0, 0, True
        self.all, self.loss, self.formatted, self.context = (hashlib.sha256() for _ in range(4))

    def add(self, codec: Codec, positions: list[int], tokens: list[int], loss_from: int, loss_to: int) -> None:
        formatted = codec.decode(tokens)
        [(role, text)] = parse_conversation(formatted if self.turns == 0 else BEGIN + formatted)
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode())
        learnt = unescape(codec.decode(tokens[loss_from:loss_to]))
        self.loss.update(learnt.encode())
        self.learnt += len(learnt)
        self.chars += len(formatted)
        self.context = self.formatted.copy()  # what the last turn attends to before itself
        self.formatted.update(formatted.encode())
        self.run_on &= positions == list(range(self.next, self.next + len(tokens)))
        self.next += len(tokens)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.learnt, self.loss.hexdigest(), self.chars, self.context.hexdigest(), self.run_on


def read_back(named: DataFrame, forest: DataFrame, codec: Codec = Codec()) -> DataFrame:
    """A row for each conversation, all of it decoded from the stretches of its tree's sequence that its last turn attends to.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, context_sha256, positions_run_on): context is the formatted text that
    the last turn's ancestor intervals hold; positions run on if the position ids are 0, 1, 2 ... through all turns.
    """
    ends = named.groupBy("conv").agg(F.max_by("node", "depth").alias("node"))
    own = F.struct(F.col("start").alias("from"), (F.col("start") + F.size("tokens")).alias("to"))
    spans = ends.join(forest.select("node", "tree", F.concat("intervals", F.array(own)).alias("spans")), "node")
    block = lambda place: F.floor(place / BLOCK)
    spans = spans.select("conv", "tree", F.explode("spans").alias("s")).select("conv", "tree", "s.from", "s.to")
    blocks = spans.select("*", F.explode(F.sequence(block(F.col("from")), block(F.col("to") - 1))).alias("block"))
    nodes = forest.select("tree", block(F.col("start")).alias("block"), "start", "position_ids", "tokens", "loss_from", "loss_to")
    along = blocks.join(nodes, ["tree", "block"]).where("start >= `from` AND start < `to`").select("conv", "position_ids", "tokens", "loss_from", "loss_to")
    along = along.repartition("conv").sortWithinPartitions("conv", F.col("position_ids")[0])
    out = mapped(along, _reader(codec), READ)
    return out.select(F.when(F.col("conv") != NO_CONVERSATION, F.col("conv")).alias("conv_id"), *out.columns[1:])
