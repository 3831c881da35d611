"""A prefix trie of conversations, merged family first.

A family is a base conversation and those that are rebuilt from its first turns. Families are cogrouped with the
heads of their bases, rebuilt, and each one's small trie is built in one call; only the combined nodes of families are
shuffled and merged. Turns travel as digests and byte counts, not as texts.

A node's key is the sum of the digests of (depth, turn) up to its depth, in two parts modulo 2**60, so it can be
summed over any cut of a conversation: those of more than LONG turns are rebuilt and summed by Spark, spread over tasks.

Sums over subtrees need no walk over the merged trie. A node belongs to the smallest of its members; what a member owns
of its path is the part below some depth to its end. So what the subtree of a node holds of each distinct node is the
owner's rest of its path, and for every other member the whole of what that owns, one number for each conversation.
"""

from __future__ import annotations

import hashlib
import zlib
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import discard, ship, spread_join, stored
from lakequill.operators.ordered import numbered

FAMILY, HEADS = 5, 9  # fixed values: conversations of a family, and the number that heads stay below
#: Turns of a conversation that a family's call takes; longer ones are rebuilt by Spark, spread over tasks.
LONG = 4096
#: Bytes of member lists that are hashed at a time.
PIECE = 1 << 20
_MASK, _MOD = (1 << 60) - 1, "1152921504606846976"
_KEY = "struct<a:bigint,b:bigint>"
_NODE = f"base long, k {_KEY}, p {_KEY}, depth long, low long, members array<long>, rest decimal(38,0), low_rest decimal(38,0), size long, ends array<long>"


def head_length(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _value(depth: int, digest: bytes) -> tuple[int, int]:
    h = hashlib.sha256(f"{depth}:{digest.hex()}".encode()).hexdigest()
    return int(h[:15], 16), int(h[15:30], 16)


def family_nodes(heads: list, own: dict[int, list]) -> list[dict]:
    """The trie of one family: heads and each conversation's own turns as (digest, bytes of the text), in order."""
    root = {"k": (0, 0), "p": (0, 0), "depth": 0, "size": 0, "members": [], "rest": 0, "low_rest": 0, "ends": [], "below": {}}
    nodes = [root]
    for c in sorted(own):
        h = head_length(c)
        turns = heads[:h] + own[c][h:]
        rest, at = sum(n for _, n in turns), root
        for d in range(len(turns) + 1):
            if d:
                digest, n = turns[d - 1]
                if digest not in at["below"]:
                    key = tuple((x + y) & _MASK for x, y in zip(at["k"], _value(d, digest)))
                    at["below"][digest] = {"k": key, "p": at["k"], "depth": d, "size": n, "members": [], "rest": 0, "low_rest": 0, "ends": [], "below": {}}
                    nodes.append(at["below"][digest])
                at = at["below"][digest]
            if not at["members"]:
                at["low_rest"] = rest
            at["members"].append(c)
            at["rest"] += rest
            rest -= at["size"]
        at["ends"].append(c)
    return nodes


def _families(left, right):
    import pyarrow as pa

    def rows(t):
        return sorted(zip(t.column("conv_id").to_pylist(), t.column("pos").to_pylist(), t.column("digest").to_pylist(), t.column("size").to_pylist()))

    own: dict[int, list] = {}
    for c, _, g, n in rows(left):
        own.setdefault(c, []).append((g, n))
    heads = [(g, n) for _, _, g, n in rows(right)]
    base = left.column("base")[0].as_py() if len(left) else None
    nodes = family_nodes(heads, own) if own else []
    longs = lambda name: pa.array([x[name] for x in nodes], pa.int64())
    lists = lambda name: pa.array([x[name] for x in nodes], pa.list_(pa.int64()))
    big = lambda name: pa.array([Decimal(x[name]) for x in nodes], pa.decimal128(38, 0))
    keys = lambda name: pa.StructArray.from_arrays([pa.array([x[name][i] for x in nodes], pa.int64()) for i in range(2)], ["a", "b"])
    cols = [pa.array([base] * len(nodes), pa.int64()), keys("k"), keys("p"), longs("depth"), pa.array([x["members"][0] for x in nodes], pa.int64()), lists("members"), big("rest"), big("low_rest"), longs("size"), lists("ends")]
    return pa.table(cols, names=["base", "k", "p", "depth", "low", "members", "rest", "low_rest", "size", "ends"])


def _digests(turns: DataFrame, conv_id: str) -> DataFrame:
    """(conv_id, turn, role, text): nulls of role and text are empty; rows without a conv_id are in no conversation."""
    none = F.lit("")
    return turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), none).alias("role"), F.coalesce(F.col("text").cast("string"), none).alias("text")).where("conv_id is not null")


def _turn():
    """The digest of role and text, and the bytes of the text."""
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("digest"), F.octet_length("text").cast("long").alias("size")


def _placed(turns: DataFrame, conv_id: str, long: int) -> tuple[DataFrame, DataFrame | None]:
    """(conv_id, base, pos, digest, size) of the turns by their places, those of conversations of up to long turns, and those of longer ones or None."""
    rows = _digests(turns, conv_id)
    cols = ["conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), F.col("pos").cast("long").alias("pos"), "digest", "size"]
    many = stored(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select("conv_id"), "long-conversations")
    of_conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    if not many.limit(1).count():
        discard(many)
        return stored(rows.withColumn("pos", F.row_number().over(of_conv) - 1).select(*cols[:3], *_turn()), "turns"), None
    # a row for each LONG rows of the table at most
    usual = rows.join(many, "conv_id", "left_anti").withColumn("pos", F.row_number().over(of_conv) - 1)
    hot = numbered(rows.join(many, "conv_id", "left_semi"), ["turn", "role", "text"], ["conv_id"]).withColumn("pos", F.col("at"))
    return stored(usual.select(*cols[:3], *_turn()), "turns"), stored(hot.select(*cols[:3], *_turn()), "long-turns")


def _long_nodes(hot: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes of long conversations, each a family of its own: rebuilt by a join with the heads, keys and rests by running sums over tasks."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = hot.select("conv_id", "base").distinct().withColumn("h", h)
    head = convs.join(heads.select("base", "pos", "digest", "size"), "base").where("pos < h").select("conv_id", "base", (F.col("pos") + 1).alias("depth"), "digest", "size")
    sizes = convs.join(head.groupBy("conv_id").agg(F.count("*").alias("nb")), "conv_id", "left").select("conv_id", "h", F.coalesce("nb", F.lit(0)).alias("nb"))
    own = hot.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "conv_id").where("pos >= h").select("conv_id", "base", (F.col("nb") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "size")
    part = lambda x, at: F.conv(F.substring(x, at, 15), 16, 10).cast("long")
    s = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.lower(F.hex("digest"))), 256)
    rows = head.unionAll(own).withColumn("s", s).select("conv_id", "base", "depth", "size", part(F.col("s"), 1).cast("decimal(20,0)").alias("a"), part(F.col("s"), 16).cast("decimal(20,0)").alias("b"))
    # the root is a node of theirs as well
    rows = rows.unionAll(convs.selectExpr("conv_id", "base", "0L depth", "0L size", "cast(0 as decimal(20,0)) a", "cast(0 as decimal(20,0)) b"))
    run = stored(numbered(rows, ["depth"], ["conv_id"], {"a0": "a", "b0": "b", "s0": "size"}), "long-sums")
    total = run.groupBy("conv_id").agg(F.max("depth").alias("last"), F.sum(F.col("size").cast("decimal(20,0)")).alias("all"))
    key = lambda a, b: F.struct(F.expr(f"cast(({a}) % {_MOD} as bigint)").alias("a"), F.expr(f"cast(({b}) % {_MOD} as bigint)").alias("b"))
    rest = F.expr("cast(all - s0 as decimal(38,0))")
    one = F.array("conv_id")
    return run.join(F.broadcast(total) if total.count() <= 100_000 else total, "conv_id").select(
        "base", key("a0 + a", "b0 + b").alias("k"), key("a0", "b0").alias("p"), "depth", F.col("conv_id").alias("low"), one.alias("members"), rest.alias("rest"), rest.alias("low_rest"), "size",
        F.when(F.col("depth") == F.col("last"), one).otherwise(F.array().cast("array<long>")).alias("ends"),
    )


def _pieces(batches):
    """Lists of ids of one node, ascending over the partition, as strings of up to PIECE bytes."""
    import pyarrow as pa

    now, got, size, seq = None, [], 0, 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([now[2]], pa.int32()), pa.array([seq], pa.int64()), pa.array([",".join(got)], pa.string())], names=["a", "b", "part", "seq", "ids"])

    for batch in batches:
        for a, b, part, c in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "part", "c"))):
            if now != (a, b, part) or size > PIECE:
                if got:
                    yield out()
                    seq += 1
                now, got, size = (a, b, part), [], 0
            got.append(str(c))
            size += len(got[-1]) + 1
    if got:
        yield out()


def _hashes(batches):
    """One digest for each node of the partition, whose pieces come in order."""
    import pyarrow as pa

    now, sha = None, None
    for batch in batches:
        rows: list[tuple] = []
        for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ids"))):
            if now != (a, b):
                if now is not None:
                    rows.append((*now, sha.hexdigest()))
                now, sha = (a, b), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["a", "b", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["a", "b", "sha"])


def _end_digests(nodes: DataFrame) -> DataFrame:
    """(k, ends_sha256) of the nodes where conversations end: a node's list is joined to strings where it lies, range by range, and these are hashed in order."""
    ends = nodes.select("k.a", "k.b", F.explode("ends").alias("c"))
    dealt = ends.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").withColumn("part", F.spark_partition_id())
    pieces = dealt.mapInArrow(_pieces, "a long, b long, part int, seq long, ids string")
    hashed = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "part", "seq").mapInArrow(_hashes, "a long, b long, sha string")
    return hashed.select(F.struct("a", "b").alias("k"), F.col("sha").alias("ends_sha256"))


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", long_turns: int = LONG) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, the empty one included.

    turns: conv_id, turn, role, text; further columns are ignored. Turns go by turn, null first, then role, then text; null
    roles and texts are empty; repeated rows are turns of their own. Conversation c is rebuilt from the first h turns
    of conversation c - c % 5, if there is one, and its own turns after its first h; h = crc32(decimal c) % 9. Rows
    without a conv_id belong to no conversation and are left out; an empty table gives no rows.

    Columns, long but for the last: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Of conversations of any length the results are the same; those of more than
    long_turns turns take another way, which puts no conversation into one task.
    """
    ship(turns.sparkSession)
    usual, hot = _placed(turns, conv_id, long_turns)
    of_base = lambda df: df.where(f"conv_id = base and pos < {HEADS - 1}").select("base", "conv_id", "pos", "digest", "size")
    heads = of_base(usual) if hot is None else of_base(usual).unionAll(of_base(hot))
    built = usual.groupBy("base").cogroup(heads.groupBy("base")).applyInArrow(_families, _NODE)
    nodes = stored(built if hot is None else built.unionByName(_long_nodes(hot, heads)), "family-nodes")
    discard(*(x for x in (usual, hot) if x is not None))

    merged = nodes.groupBy("k").agg(
        F.first("p").alias("p"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.min("low").alias("owner"), F.sum(F.size("members")).cast("long").alias("n_convs"),
        F.sum("rest").alias("rest"), F.min_by("low_rest", "low").alias("owner_rest"),
    )
    merged = stored(merged, "merged")
    below = merged.where("depth > 0").groupBy(F.col("p").alias("k")).agg(F.count("*").alias("n_children"))
    whole = stored(merged.join(below, "k", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "with-children")

    # of each conversation that owns nodes: where they begin, their bytes, and whether its end is a leaf
    owners = whole.groupBy("owner").agg(F.min("depth").alias("top"), F.min_by("p", "depth").alias("top_parent"), F.max("owner_rest").alias("owned"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf"), F.count("*").alias("rows"))
    owners = stored(owners, "owners")
    parents = owners.where("top > 0").select("owner", F.col("top_parent").alias("k"))
    parents = spread_join(parents, whole.select("k", F.col("owner").alias("parent")), "k", below.select("k", F.col("n_children").alias("rows"))).select("owner", "parent")
    owners = stored(owners.join(parents, "owner", "left"), "owners-parents")

    # a family has few members, so what they own is a small map
    family = (F.col("owner") - F.col("owner") % FAMILY).alias("base")
    maps = owners.select(family, "owner", F.struct("owned", "leaf").alias("x")).groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("owner", "x"))).alias("of"))
    mapped = spread_join(nodes.select("base", "k", "members"), maps, "base", how="left")
    got = F.transform("members", lambda c: F.element_at("of", c))
    mapped = mapped.select("k", got.alias("x")).select("k", F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + F.coalesce(x["owned"], F.lit(0))).cast("decimal(38,0)")).alias("owned"), F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["leaf"], F.lit(0))).alias("leaves"))
    sums = mapped.groupBy("k").agg(F.sum("owned").alias("owned_all"), F.sum("leaves").alias("n_leaves"))

    out = whole.join(sums, "k").join(_end_digests(nodes), "k", "left")
    out = spread_join(out, owners.select("owner", "top", "owned", "parent"), "owner", owners.select("owner", "rows"))
    distinct = F.col("owner_rest") + F.col("owned_all") - F.col("owned")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("top"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("rest") - distinct).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
