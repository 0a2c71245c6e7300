"""Prefix trie of conversations, built by halving depths: named cuts, forests in parallel, totals grafted upward.

Sequences of turns are cut into blocks of ``BLOCK`` depths, which are folded in place, and the blocks halved in turn, as in a van
Emde Boas layout. Going up, the halves of every cut get names: digests of what they hold. Going down, each cut passes to its lower
half the name of the prefix above it, so all forests of one height are built at once, and a conversation of d turns takes log2(d / BLOCK)
rounds, not d. A node is the name of its prefix; conversations with equal prefixes meet there.

Totals take the same way. Every node gives its own values to one conversation, its smallest member, at its depth. The cuts add up the values
of lower halves and graft them onto the depths above; a member's sum from a depth downward then holds each node below exactly once,
and a node's subtree total is the sum over its members. Nothing is collected per node: sums are combined before the shuffle.

``rebuild`` makes conversations share openings: conversation c takes the first h turns of conversation c - c % 100, h = crc32(c) % 6, then
its own turns after its first h.

Defined results: turns are ordered by number (null first), equal numbers by the digest of role and text; null role or text counts as
empty; rows without conv_id form no conversation; repeated rows are turns of their own; a conversation without turns ends at the root; texts of
any length are hashed whole; extra columns are ignored; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.llm.common import table, written
from tallyveil.llm.merkle_manifest import crc32_sql
from tallyveil.operators.ordering import positions
from tallyveil.session import cut_lineage

#: Depths folded in one row before halving begins.
BLOCK = 16
#: Turns of one conversation that meet in a join key, and conversation ids joined into one string.
STRETCH, LIST_PIECE = 1024, 1 << 16
#: Parents that get their children by broadcast: at most so many rows.
LARGE_PARENTS = 10_000
SHARED, STEP = 6, 100


def _hex(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, n, token, size): each conversation's turns in order, as digests, with the text's code points."""
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    token = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)
    slim = conversations.select(F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("_turn"), token.alias("token"), F.length(said).cast("bigint").alias("size"))
    # A conversation with a large share of all rows is ordered over many tasks.
    placed = positions(written(slim.filter("conv IS NOT NULL"), "trie-turns"), ["conv"], [F.col("_turn").asc_nulls_first(), F.col("token")])
    return written(placed.select("conv", F.col("position").alias("place"), F.col("group_rows").alias("n"), "token", "size"), "trie-places")


def rebuild(placed: DataFrame) -> DataFrame:
    """(conv, n, depth, token, size) of rebuilt conversations, with a row of depth 0 for each."""
    lengths = placed.filter("place = 1").select("conv", "n")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    bases = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    shares = lengths.withColumn("h", taken).withColumn("base", F.expr(f"conv - conv % {STEP}")).join(bases, "base", "left")
    shares = shares.select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("shared"), "n")
    shares = written(shares.withColumn("length", F.expr("shared + greatest(n - h, 0)")), "trie-shares")
    top = shares.select("conv", F.col("length").alias("n"), F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("token"), F.lit(0).cast("bigint").alias("size"))
    # At most STEP conversations take the same opening, and at most SHARED - 1 turns of it.
    heads = placed.filter(F.col("place") < SHARED).select(F.col("conv").alias("base"), "place", "token", "size")
    head = shares.join(heads, "base").filter("place <= shared").select("conv", F.col("length").alias("n"), F.col("place").alias("depth"), "token", "size")
    stretches = shares.withColumn("stretch", F.explode(F.expr(f"sequence(0L, n div {STRETCH})"))).drop("n", "base")
    own = placed.withColumn("stretch", F.expr(f"place div {STRETCH}")).join(stretches, ["conv", "stretch"]).filter("place > h")
    own = own.select("conv", F.col("length").alias("n"), F.expr("shared + place - h").alias("depth"), "token", "size")
    return top.unionByName(head).unionByName(own)


def _halved(blocks: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Pairs of neighbouring blocks as one: (conv, block, left_..., right_..., paired)."""
    half = F.col("block") % 2
    sides = [F.max(F.when(half == i, F.col(v))).alias(f"{side}_{v}") for i, side in ((0, "left"), (1, "right")) for v in values]
    paired = (F.max(half) == 1).alias("paired")
    return blocks.groupBy("conv", F.expr("block div 2").alias("block")).agg(*sides, paired).select("*", *[c.alias(v) for v, c in values.items()])


def _rounds(blocks: DataFrame, values: dict[str, Column], label: str) -> list[DataFrame]:
    """Levels of halving, lowest first, until every conversation is one block."""
    found = []
    while (blocks.agg(F.max("block")).first()[0] or 0) > 0:
        blocks = written(_halved(blocks, values), f"{label}-{len(found)}")
        found.append(blocks)
    return found


def _passed_down(levels: list[DataFrame], start: dict[str, Column], left: dict[str, Column], right: dict[str, Column]) -> DataFrame | None:
    """(conv, block, ...) of the lowest blocks with what the cuts above hand to each half."""
    given = None
    for level in reversed(levels):
        known = level.select("*", *[c.alias(n) for n, c in start.items()]) if given is None else level.join(given, ["conv", "block"])
        halves = [F.struct((F.col("block") * 2 + i).alias("block"), *[c.alias(n) for n, c in side.items()]) for i, side in ((0, left), (1, right))]
        both = F.when(F.col("paired"), F.array(*halves)).otherwise(F.array(halves[0]))
        given = known.select("conv", F.explode(both).alias("half")).select("conv", "half.*")
    return given


def named(slots: DataFrame) -> DataFrame:
    """Blocks (conv, block, n, items) whose items (depth, size, id, parent) know their node and its parent; parent of the root is null."""
    item = F.struct("depth", "token", "size")
    blocks = slots.groupBy("conv", F.expr(f"depth div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    chain = F.aggregate(
        "items", F.expr("named_struct('last', '', 'all', cast(array() AS array<string>))"),
        lambda s, i: F.struct(_hex(s["last"], i["token"]).alias("last"), F.array_append(s["all"], _hex(s["last"], i["token"])).alias("all")), lambda s: s["all"],
    )
    blocks = written(blocks.withColumn("chain", chain).withColumn("name", F.element_at("chain", -1)), "trie-blocks")
    # Conversations of one block need no cut.
    longer = blocks.filter(F.col("n") >= BLOCK).select("conv", "block", "name")
    levels = _rounds(longer, {"name": _hex(F.col("left_name"), F.coalesce("right_name", F.lit("")))}, "trie-names")
    above = _passed_down(levels, {"above": F.lit("")}, {"above": F.col("above")}, {"above": _hex(F.col("above"), F.col("left_name"))})
    # The place of a block's first node below its parent: the last node of the block before.
    full = blocks.join(above, ["conv", "block"], "left") if above is not None else blocks.withColumn("above", F.lit(""))
    ids = F.transform("chain", lambda c: _hex(F.coalesce("above", F.lit("")), F.lit("/"), c))
    full = full.select("conv", "block", "n", "items", ids.alias("ids"))
    if above is not None:
        full = written(full, "trie-ids")
        last = full.filter(F.col("n") >= BLOCK).select("conv", (F.col("block") + 1).alias("block"), F.element_at("ids", -1).alias("before"))
        full = full.join(last, ["conv", "block"], "left")
    else:
        full = full.withColumn("before", F.lit(None).cast("string"))

    def entry(i: Column, k: Column) -> Column:
        parent = F.when(k > 0, F.get("ids", k - 1)).otherwise(F.col("before"))
        return F.struct(i["depth"].alias("depth"), i["size"].alias("size"), F.get("ids", k).alias("id"), parent.alias("parent"))

    return written(full.select("conv", "block", "n", F.transform("items", entry).alias("items")), "trie-named")


def _own_values(blocks: DataFrame) -> DataFrame:
    """Nodes (id, conv_id, depth, size, parent, n_convs) of all members."""
    members = blocks.select("conv", F.explode("items").alias("i")).select("conv", "i.*")
    same = [F.first(c).alias(c) for c in ("depth", "size", "parent")]
    return written(members.groupBy("id").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *same), "trie-nodes")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with parent_conv_id and n_children; parents of very many children are few and reach them by broadcast."""
    children = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    known = written(nodes.join(children.withColumnRenamed("parent", "id"), "id", "left").fillna({"n_children": 0}), "trie-children")
    # More than the LARGE_PARENTS-th part of all nodes: fewer than LARGE_PARENTS parents can have so many.
    bound = max(BLOCK, known.count() // LARGE_PARENTS)
    parents = known.filter("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    large = F.broadcast(parents.filter(F.col("n_children") > bound).drop("n_children").withColumnRenamed("parent_conv_id", "_large"))
    first = known.join(large, "parent", "left")
    easy = first.filter("_large IS NOT NULL OR parent IS NULL").withColumn("parent_conv_id", F.col("_large"))
    rest = first.filter("_large IS NULL AND parent IS NOT NULL").join(parents.filter(F.col("n_children") <= bound).drop("n_children"), "parent", "left")
    return easy.drop("_large").unionByName(rest.drop("_large"))


def _totals(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n_leaves, saved_tokens): sums over every node's subtree."""
    values = {"leaves": F.expr("if(n_children = 0, 1L, 0L)"), "saved": F.expr("(n_convs - 1) * size")}
    given = nodes.select(F.col("conv_id").alias("conv"), "depth", *[c.alias(n) for n, c in values.items()])
    held = given.groupBy("conv", F.expr(f"depth div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("depth", "leaves", "saved")).alias("given"), *[F.sum(v).alias(v) for v in values])
    full = blocks.join(held, ["conv", "block"], "left").fillna(0, list(values))
    levels = []
    longer = blocks.filter(F.col("n") >= BLOCK)
    if longer.limit(1).count():
        full = written(full, "trie-values")
        sums = {v: F.col(f"left_{v}") + F.coalesce(f"right_{v}", F.lit(0)) for v in values}
        levels = _rounds(full.filter(F.col("n") >= BLOCK).select("conv", "block", *values), sums, "trie-sums")
    # What lies below the cut is grafted onto all depths above it.
    grafted = _passed_down(
        levels, {f"below_{v}": F.lit(0).cast("bigint") for v in values},
        {f"below_{v}": F.col(f"below_{v}") + F.coalesce(f"right_{v}", F.lit(0)) for v in values}, {f"below_{v}": F.col(f"below_{v}") for v in values},
    )
    full = full.join(grafted, ["conv", "block"], "left") if grafted is not None else full.select("*", *[F.lit(0).cast("bigint").alias(f"below_{v}") for v in values])

    def downward(v: str):
        def of(i: Column) -> Column:
            inside = F.aggregate(F.coalesce("given", F.array()), F.lit(0).cast("bigint"), lambda s, g: s + F.when(g["depth"] >= i["depth"], g[v]).otherwise(0))
            return inside + F.coalesce(f"below_{v}", F.lit(0))
        return of

    sums = F.transform("items", lambda i: F.struct(i["id"].alias("id"), *[downward(v)(i).alias(v) for v in values]))
    each = full.select(F.explode(sums).alias("s")).select("s.*")
    return each.groupBy("id").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _ends(blocks: DataFrame) -> DataFrame:
    """(id, ends_sha256) of nodes where conversations end: digest of their numbers, ascending, with commas between.

    The numbers of a node are sorted over many tasks and joined there in pieces; where there are several pieces, one task
    reads them in order and keeps a hash, not the list.
    """
    ends = blocks.select("conv", "n", F.explode("items").alias("i")).filter("i.depth = n").select("i.id", "conv")
    ranged = cut_lineage(ends.repartitionByRange("id", "conv").withColumn("slice", F.spark_partition_id()))
    place = F.row_number().over(W.partitionBy("slice", "id").orderBy("conv"))
    pieces = ranged.withColumn("piece", F.floor((place - 1) / LIST_PIECE)).groupBy("id", "slice", "piece")
    joined = pieces.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("list"))
    joined = written(joined, "trie-ends")
    several = joined.groupBy("id").agg(F.count("*").alias("_pieces")).filter("_pieces > 1").select("id")
    single = joined.join(several, "id", "left_anti").select("id", F.sha2(F.col("list").cast("binary"), 256).alias("ends_sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            ids, digests = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node != name:
                    if name is not None:
                        ids.append(name)
                        digests.append(state.hexdigest())
                    name, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(digests, pa.string())], names=["id", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])

    ordered = joined.join(several, "id").repartition("id").sortWithinPartitions("id", "slice", "piece").select("id", "list")
    return single.unionByName(ordered.mapInArrow(stream, "id string, ends_sha256 string"))


def prefix_trie(slots: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv, n, depth, token, size), a row of depth 0 for each conversation included."""
    blocks = named(slots)
    nodes = written(_with_parents(_own_values(blocks)), "trie-parents")
    out = nodes.join(_totals(blocks, nodes), "id", "left").join(_ends(blocks), "id", "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def op12_prefix_trie(spark, folder: str) -> DataFrame:
    return prefix_trie(rebuild(turns(table(spark, folder, "conversations"))))


ORACLES = {
    "op12_prefix_trie": f"""
WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, token) AS place, count(*) OVER (PARTITION BY conv) AS n FROM (
    SELECT conv_id AS conv, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token, length(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS (SELECT conv, n, conv - conv % {STEP} AS base, {crc32_sql('CAST(conv AS VARCHAR)')} % {SHARED} AS h FROM placed WHERE place = 1),
shares AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS shared FROM convs c LEFT JOIN (SELECT conv AS base, n FROM placed WHERE place = 1) b ON c.base = b.base),
rebuilt AS (
  SELECT conv, 0 AS depth, '' AS token, 0 AS size FROM shares
  UNION ALL SELECT s.conv, p.place, p.token, p.size FROM shares s JOIN placed p ON p.conv = s.base AND p.place <= s.shared
  UNION ALL SELECT s.conv, s.shared + p.place - s.h, p.token, p.size FROM shares s JOIN placed p ON p.conv = s.conv AND p.place > s.h
),
members AS (
  SELECT conv, depth, size, id, lag(id) OVER (PARTITION BY conv ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv) AS ends
  FROM (SELECT *, sha256(string_agg(token, '/') OVER (PARTITION BY conv ORDER BY depth)) AS id FROM rebuilt)
),
nodes AS (
  SELECT id, any_value(depth) AS depth, any_value(size) AS size, any_value(parent) AS parent, min(conv) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv, ',' ORDER BY conv) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY id
),
counted AS (SELECT n.*, coalesce(c.k, 0) AS n_children FROM nodes n LEFT JOIN (SELECT parent, count(*) AS k FROM nodes GROUP BY parent) c ON n.id = c.parent),
totals AS (
  SELECT m.id, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens
  FROM counted v JOIN members m ON m.conv = v.conv_id AND m.depth <= v.depth GROUP BY m.id
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n LEFT JOIN nodes p ON n.parent = p.id JOIN totals t ON t.id = n.id
""",
}
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
