"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius by permuted block tables.

Terms are runs of three neighbouring words (shorter at the end of a text), weighted by their letters, so that a run of short,
common words says less than one of long words. Each term's 64-bit hash votes with its weight for its one bits and against its
zero bits; a fingerprint bit is set where the votes for it prevail. Votes are counted in 32 sums that hold two bits' counters each,
so a text is one pass of a hash aggregate over its terms: built-in functions alone, and no text ever goes to Python.

Search: a fingerprint is cut into `radius` + 3 blocks. Two that differ in at most `radius` bits agree in three blocks at least, so
one table for each choice of three blocks, keyed by those (the permutation's leading bits), puts every pair in reach into
one bucket of some table. Equal fingerprints are one entry, and each pair is compared by its bits.

Defined results: null and empty texts have no terms and the fingerprint 0, as do texts of white space. Equal rows (same doc_id, same
text) are one document with one result; rows that share a doc_id but not the text follow each other in the order of their texts' hashes.
Rows with a null doc_id come first. A text's votes stay exact below 95 million words. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, cut

BITS = 64
#: One counter of two neighbouring lanes of a sum each.
LANES = 0x0000000100000001
#: Distance between fingerprints that the search finds by default.
RADIUS = 3
KEY_BLOCKS = 3


def terms(text: Column) -> Column:
    """The term hashes of a text, one for each word; the low six bits are the term's weight."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    coded = F.transform(words, lambda w: F.shiftleft(F.xxhash64(w), 4).bitwiseOR(F.least(F.length(w), F.lit(15)).cast("long")))
    nibble = lambda x: F.coalesce(x.bitwiseAND(15), F.lit(0))
    packed = lambda x, weight: F.shiftleft(x, 6).bitwiseOR(weight)
    pairs = F.zip_with(coded, F.slice(coded, F.lit(2), F.greatest(F.size(coded) - 1, F.lit(0))), lambda a, b: packed(F.xxhash64(a, b), nibble(a) + nibble(b)))
    return F.zip_with(pairs, F.slice(coded, F.lit(3), F.greatest(F.size(coded) - 2, F.lit(0))), lambda ab, c: packed(F.xxhash64(ab, c), ab.bitwiseAND(63) + nibble(c)))


def _votes(term: Column) -> list[Column]:
    """The aggregates that count a group's votes: all weight, then the sums of two lanes."""
    weight, bits = term.bitwiseAND(63), F.xxhash64(term)
    lanes = [F.sum(F.shiftrightunsigned(bits, i).bitwiseAND(F.lit(LANES)) * weight).alias(f"v{i}") for i in range(BITS // 2)]
    return [F.sum(weight).alias("all"), *lanes]


def _fingerprint() -> Column:
    """The fingerprint of counted votes."""
    out = F.lit(0).cast("long")
    for i in range(BITS // 2):
        both = F.coalesce(f"v{i}", F.lit(0).cast("long"))
        low, high = both.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(both, 32)
        for bit, count in ((i, low), (i + 32, high)):
            out = out.bitwiseOR(F.when(count * 2 > F.col("all"), F.lit((1 << bit) - (1 << 64) * (bit == 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., fingerprint bigint) of every distinct key; a key's terms are those of all its texts."""
    spread = texts.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("_term"))
    return spread.groupBy(*keys).agg(*_votes(F.col("_term"))).select(*keys, _fingerprint().alias("fingerprint"))


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """The share of bits that agree."""
    return (F.lit(BITS) - F.bit_count(a.bitwiseXOR(b))) / F.lit(float(BITS))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    n = radius + KEY_BLOCKS
    if not 0 <= radius <= 8:
        raise ValueError("a radius is 0 to 8 bits")
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _tables(fingerprint: Column, radius: int) -> Column:
    """The fingerprint's key in every table, as one array."""
    tables = []
    for number, chosen in enumerate(combinations(_blocks(radius), KEY_BLOCKS)):
        key = F.lit(number).cast("long")
        for first, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(fingerprint, first).bitwiseAND((1 << bits) - 1))
        tables.append(F.xxhash64(F.lit(number), key))
    return F.array(*tables)


def within_radius(queries: DataFrame, entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, entry, distance) for each distinct query and each other distinct fingerprint of entries within the radius.

    Both have a column fingerprint. Copies are one row here; join the fingerprints back for the documents.
    """
    spread = lambda df, name: df.where("fingerprint IS NOT NULL").select(F.col("fingerprint").alias(name)).distinct().select(name, F.explode(_tables(F.col(name), radius)).alias("_key"))
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("entry")))
    met = spread(queries, "query").join(spread(entries, "entry"), "_key").where((F.col("query") != F.col("entry")) & (distance <= radius))
    return met.select("query", "entry", distance.cast("int").alias("distance")).distinct()


#: Stands for a null doc_id among the keys; it comes first.
NO_DOC = -(1 << 63)


def successors(keys: DataFrame) -> DataFrame:
    """(doc, print, next_doc, next_print) in ascending order; the last is followed by the first.

    Rows are dealt out by ranges, each range is linked by itself, and its last row to the first of the next range that has rows: the
    only global order is that of one row for each range.
    """
    ranged = cut(keys.distinct().repartitionByRange("doc", "print").withColumn("part", F.spark_partition_id()))
    own = W.partitionBy("part").orderBy("doc", "print")
    linked = ranged.withColumn("next", F.lead(F.struct("doc", "print")).over(own))
    heads = ranged.groupBy("part").agg(F.min(F.struct("doc", "print")).alias("head"))
    order = F.array_sort(F.collect_list(F.struct("part", "head")))
    chain = heads.agg(order.alias("h")).select(F.explode(F.zip_with("h", F.concat(F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))), F.slice("h", 1, 1)), lambda a, b: F.struct(a["part"].alias("part"), b["head"].alias("after")))).alias("c")).select("c.*")
    follower = F.coalesce("next", "after")
    return linked.join(F.broadcast(chain), "part").select("doc", "print", follower["doc"].alias("next_doc"), follower["print"].alias("next_print"))


def _reach(found: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, fingerprint): (fingerprint, class_id, asked) of the distinct fingerprints, and (fingerprint, near_id, distance) of those asked for.

    Documents of equal fingerprints are a class, named by its smallest id; asked for are those with an id divisible by 20.
    """
    classes = cut(found.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.bool_or(F.col("doc_id") % 20 == 0).alias("asked")))
    pairs = within_radius(classes.where("asked"), classes, radius)
    return classes, pairs.join(classes.select(F.col("fingerprint").alias("entry"), F.col("class_id").alias("near_id")), "entry").select(F.col("query").alias("fingerprint"), "near_id", "distance")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Every document against an edited text (its last quarter from the next document's beginning) and against the next document.

    class_id names the documents of an equal fingerprint (null without an id); a document whose id is divisible by 20 has, of the other classes
    that the block tables find within the radius, the nearest (near_class_id, near_distance; of equally near ones the smallest id) and their number
    (n_near); others have null there.
    """
    base = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_DOC)).alias("doc"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("print"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = cut(successors(base.select("doc", "print")))
    # The next document's beginning goes to the document that it is to end; sizes are needed first to cut it.
    sizes = base.select("doc", "print", F.floor(F.length("text") / 4).cast("int").alias("k")).distinct()
    wanted = order.join(sizes, ["doc", "print"]).select(F.col("next_doc").alias("doc"), F.col("next_print").alias("print"), F.col("doc").alias("to_doc"), F.col("print").alias("to_print"), "k")
    heads = base.join(wanted, ["doc", "print"]).select(F.col("to_doc").alias("doc"), F.col("to_print").alias("print"), F.expr("left(text, k)").alias("head"))
    made = base.join(heads, ["doc", "print"])
    n = F.length("text")
    made = made.select("doc", "print", n.cast("long").alias("n_chars"), "text", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), "head").alias("edited"))
    sides = F.array(F.struct(F.lit(False).alias("late"), F.lit("").alias("sha"), F.col("text").alias("t")), F.struct(F.lit(True).alias("late"), F.sha2("edited", 256).alias("sha"), F.col("edited").alias("t")))
    both = made.select("doc", "print", "n_chars", F.explode(sides).alias("s")).select("doc", "print", "n_chars", "s.late", "s.sha", "s.t")
    found = fingerprints(both, ["doc", "print", "n_chars", "late", "sha"], "t")
    side = lambda late, column: F.max(F.when(F.col("late") == late, F.col(column)))
    found = cut(found.groupBy("doc", "print").agg(F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"), side(False, "fingerprint").alias("f"), side(True, "fingerprint").alias("e")))
    following = found.select(F.col("doc").alias("next_doc"), F.col("print").alias("next_print"), F.col("f").alias("g"))
    classes, near = _reach(found.where(F.col("doc") != NO_DOC).select(F.col("doc").alias("doc_id"), F.col("f").alias("fingerprint")), radius)
    nearest = near.groupBy("fingerprint").agg(F.min(F.struct("distance", "near_id")).alias("near"), F.count("*").alias("n_near")).withColumnRenamed("fingerprint", "f")
    classes = classes.select(F.col("fingerprint").alias("f"), "class_id").join(apart(nearest, "f"), "f", "left")
    named = F.col("doc") != NO_DOC
    asked = lambda c: F.when(named & (F.col("doc") % 20 == 0), c)
    out = found.join(order, ["doc", "print"]).join(following, ["next_doc", "next_print"]).join(apart(classes, "f"), "f", "left")
    searched = [F.when(named, F.col("class_id")).alias("class_id"), asked(F.col("near.near_id")).alias("near_class_id"), asked(F.col("near.distance")).alias("near_distance"), asked(F.coalesce("n_near", F.lit(0).cast("long"))).alias("n_near")]
    return out.select(F.when(F.col("doc") != NO_DOC, F.col("doc")).alias("doc_id"), "n_chars", "edited_sha256", hexadecimal(F.col("f")).alias("fingerprint"), hexadecimal(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("g")).alias("near_next"), *searched)


def classes_in_reach(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, near_id, distance): queries are the documents whose id is divisible by 20, against all documents.

    Documents of equal fingerprints are a class, named by its smallest id. Every document with an id has one row of distance 0 whose
    class_id and near_id are its own class; a query has one more for each other class in reach. The documents in reach of a query are
    thus those whose class_id is one of its near_ids: all that the search found, without listing pairs within a class.
    """
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL")
    found = cut(fingerprints(base, ["doc_id"]))
    classes, near = _reach(found, radius)
    members = found.join(classes.select("fingerprint", "class_id"), "fingerprint")
    own = members.select("doc_id", "class_id", F.col("class_id").alias("near_id"), F.lit(0).alias("distance"))
    return own.union(members.where("doc_id % 20 = 0").join(near, "fingerprint").select("doc_id", "class_id", "near_id", "distance"))


def neighbours(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, near_id, distance) of each query and each other document in reach: the classes of classes_in_reach, member by member.

    The rows of a class grow with its queries times its members.
    """
    reach = cut(classes_in_reach(docs, radius, doc_id, text))
    members = reach.where("distance = 0").select(F.col("class_id").alias("near_class"), F.col("doc_id").alias("near_id"))
    asked = reach.where("doc_id % 20 = 0").select("doc_id", F.col("near_id").alias("near_class"), "distance")
    return asked.join(members, "near_class").where("doc_id != near_id").select("doc_id", "near_id", "distance")
