"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every document becomes its set of distinct word shingles. Exact copies share a set and become one node. Nodes
order their shingles by a global frequency estimate, rarest first. For a similarity of p percent and a level l,
two nodes that link share at least l shingles among the first n - ceil(p n / 100) + l of the larger one and the
first m - ceil(2 p m / (100 + p)) + l of the smaller one; each node picks the level whose expected candidates
cost least, so a prefix that runs into frequent shingles is lengthened and more matches are required of it.

Links inside a group of near copies grow with the square of the group, so they are not listed. A first round
verifies one star edge for each node, to the hub that shares most of its prefix: the node of a shingle's list whose
shingles are most often frequent ones, so the likeliest centre of a group of near copies. What is left falls in two
parts, both only over pairs whose ends are still in different groups, and both whole:

* Two nodes around one hub differ from it in few shingles. With H the hub's size, and a node sharing c of its
  shingles, a link of x and y asks for overlap(x, y) + H - c(x) - c(y) shingles that both lack or both add; that is
  never below 1 unless both link to the hub. So these differences are joined, rarest first and by their prefixes,
  instead of the shingles that all copies hold.
* Nodes of different hubs are joined by their prefix shingles. In a shingle's list the commonest hub's nodes
  are compared with the others' only, never with each other.

In both joins a pair is left out at once where 256 parities of the two sets, which each node carries, differ in more
places than the members of linked sets may; a shingle or difference that many nodes hold is dealt to a square of tasks.
Candidates of both are verified on the whole sets. The components are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm import common
from lakequill.llm.common import discard, paired_join, ship, size_in_bytes, spread_join, stored, text_or_empty, trim_worker
from lakequill.llm.components import components

#: Bits of the frequency sketch's index, at least and at most: 2**bits counters of two bytes where it is used.
SKETCH_BITS = (24, 26)
#: Highest level that a node may choose: prefixes are lengthened by two shingles at most.
MAX_LEVEL = 3
#: The parities of a set's members, by which pairs of sets that differ too much are left out in the join itself.
_WORDS = ["w0", "w1", "w2", "w3"]
#: Bits of the Bloom filter of wanted sets, at least and at most.
BLOOM_BITS = (16, 30)
#: Rows of one shingle that a task looks at together; a longer list is taken in parts.
LIST = 4096
#: Sets that a task remembers to have seen, so that copies are not sent twice; others are dropped after the shuffle.
SEEN = 100_000


def _sketch_shape(docs: DataFrame) -> tuple[int, int]:
    """(bits, slices) of the sketch in step with the corpus; they change costs, never results."""
    size = size_in_bytes(docs)
    size = size if size < 1 << 57 else 0  # more than that is the optimizer's word for unknown
    return min(SKETCH_BITS[1], max(SKETCH_BITS[0], (size >> 14).bit_length())), 1 << min(12, max(6, (size >> 31).bit_length()))


def _coded(counts: np.ndarray) -> np.ndarray:
    """Counts as the upper half of 32-bit floats: exact up to 256, within a hundredth beyond, and never out of range."""
    return (counts.astype(np.float32).view(np.uint32) >> 16).astype(np.uint16)


def _decoded(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint32) << 16).view(np.float32)


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _ceil(a, b):
    return -(-a // b)


def _read(batch, width, seed):
    from lakequill.llm.shingles import buffers, shingle_sets

    return shingle_sets(*buffers(batch.column("text")), width, seed)


def _nodes(width: int, seed: int, bits: int, slices: int):
    """Pass 1: a row for each document, and this task's part of the frequency sketch."""

    def run(batches):
        import pyarrow as pa

        from lakequill.llm.shingles import parities, set_signature

        trim_worker()
        sketch = np.zeros(1 << bits, np.uint32)
        shift, any_row = np.uint64(64 - bits), False
        for batch in batches:
            ids, n, a, b, bits_of = batch.column("doc_id").to_pylist(), [], [], [], []
            for x in _read(batch, width, seed):
                np.add.at(sketch, (x >> shift).astype(np.int64), np.uint32(1))
                k, k2 = set_signature(x)
                n.append(len(x))
                a.append(k)
                b.append(k2)
                bits_of.append(parities(x))
            any_row |= bool(ids)
            none = [None] * len(ids)
            w = np.array(bits_of, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array(w[:, i]) for i in range(4)), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=["doc_id", "n", "k", "k2", *_WORDS, "slice", "counts"])
        if any_row:
            parts = [_squeeze(x.tobytes()) for x in np.split(sketch, slices)]
            none = [None] * slices
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int32()), *(pa.array(none, pa.int64()) for _ in range(6)), pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "n", "k", "k2", *_WORDS, "slice", "counts"])

    return run


def _sum_slices(batches):
    """Sums of the sketch slices of one partition."""
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, b in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            x = np.frombuffer(_expand(b), np.uint32).astype(np.int64)
            total[s] = total[s] + x if s in total else x
    if total:
        packed = [_squeeze(_coded(x).tobytes()) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])


def choose_level(n: int, df: np.ndarray, pct: int) -> int:
    """The level from 1 to MAX_LEVEL whose merge and verification costs, by the frequency estimates of the shingles in order, are least; never above the overlap that a link needs."""
    need = _ceil(pct * n, 100)
    merged = np.cumsum(np.minimum(df, 1e15))
    best, cost = 1, None
    for level in range(1, min(MAX_LEVEL, need) + 1):
        m = float(merged[min(n, n - need + level) - 1])
        c = m + n * m / level**2 / 8
        if cost is None or c < cost * 0.9:
            best, cost = level, c
    return best


def _prefixes(width: int, seed: int, pct: int, sketch):
    """Pass 2: the prefix shingles of every distinct set that a task meets, with size, position and level packed into one long."""

    def run(batches):
        import pyarrow as pa

        from lakequill.llm.shingles import set_signature

        trim_worker()
        counts = np.frombuffer(_expand(sketch.value), np.uint16)
        noise = sum(float(_decoded(x).sum(dtype=np.float64)) for x in np.split(counts, 64)) / len(counts)
        shift, seen = np.uint64(64 - len(counts).bit_length() + 1), set()
        for batch in batches:
            token, node, rest, hub, spread = [], [], [], [], []
            for x in _read(batch, width, seed):
                n = len(x)
                if not n:
                    continue
                k, _ = set_signature(x)
                if k in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(k)
                df = _decoded(counts[(x >> shift).astype(np.int64)])
                keep = min(n, max(n - _ceil(pct * n, 100), n - _ceil(2 * pct * n, 100 + pct)) + MAX_LEVEL)
                # noise of the sketch doesn't order shingles: what stands in a bucket by chance counts as rare
                rank = np.where(df > 2 * noise + 8, df, 0)
                order = np.lexsort((x, rank))[:keep]
                level = choose_level(n, np.maximum(rank[order].astype(np.float64), 1), pct)
                size = min(n, max(n - _ceil(pct * n, 100) + level, n - _ceil(2 * pct * n, 100 + pct) + MAX_LEVEL))
                order = order[:size]
                token.append(x[order])
                node.append(np.full(size, k, np.int64))
                hub.append(np.full(size, 1000 - int(1000 * (rank > 0).mean()), np.int32))
                rest.append((np.int64(n) << 33) | (np.arange(size, dtype=np.int64) << 2) | level)
                spread.append((rank[order] // LIST).astype(np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(rest)), pa.array(np.concatenate(hub)), pa.array(np.concatenate(spread))], names=["token", "k", "rest", "hub", "spread"])

    return run


def _wanted(column: str, bits: int):
    """Bits of the Bloom filter that a key sets."""
    return [F.pmod(F.xxhash64(F.lit(i), column), F.lit(1 << bits)) for i in range(2)]


def _sets(width: int, seed: int, bloom):
    """Pass 3: (k, shingles) of the documents whose doc_id may be asked for; others aren't hashed at all."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from lakequill.llm.shingles import set_signature

        trim_worker()
        bits = np.frombuffer(_expand(bloom.value), np.uint8)
        seen = set()
        for batch in batches:
            i, j = batch.column("b0").to_numpy(zero_copy_only=False), batch.column("b1").to_numpy(zero_copy_only=False)
            hit = batch.filter(pa.array(((bits[i >> 3] >> (7 - (i & 7))) & (bits[j >> 3] >> (7 - (j & 7))) & 1).astype(bool)))
            keys, sets = [], []
            for x in _read(hit, width, seed) if len(hit) else ():
                k, _ = set_signature(x)
                if len(x) and k not in seen:
                    if len(seen) < SEEN:
                        seen.add(k)
                    keys.append(k)
                    sets.append(x.view(np.int64))
            if keys:
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists.cast(pa.list_(pa.int64()))], names=["k", "shingles"])

    return run


def _bloom_slices(n_bits: int, slices: int):
    """A task's part of the Bloom filter, a byte for eight keys."""

    def run(batches):
        import pyarrow as pa

        bits, some = np.zeros(1 << (n_bits - 3), np.uint8), False
        for batch in batches:
            for c in ("b0", "b1"):
                at = batch.column(c).to_numpy(zero_copy_only=False)
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
                some |= bool(len(at))
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([_squeeze(x.tobytes()) for x in np.split(bits, slices)], pa.binary())], names=["slice", "counts"])

    return run


def _or_slices(batches):
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, b in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            x = np.frombuffer(_expand(b), np.uint8)
            total[s] = total[s] | x if s in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_squeeze(x.tobytes()) for x in total.values()], pa.binary())], names=["slice", "counts"])


def _gather(parts: DataFrame, merge, dtype, size: int, slices: int) -> bytes:
    """The whole of a sketch whose slices lie in many rows. Its size is fixed: size items of dtype."""
    merged = parts.repartition(slices, "slice").mapInArrow(merge, "slice int, counts binary")
    out = np.zeros((slices, size // slices), dtype)
    for r in merged.collect():
        out[r.slice] = np.frombuffer(_expand(bytes(r.counts)), dtype)
    return _squeeze(out.tobytes())


def _overlap(n, m, pct: int):
    """Shared shingles that sets of n and m need to link."""
    return F.ceil(pct * (n + m) / (100 + pct))


def _may_link(n, m, pct: int):
    """Whether the parities of x and y leave room for a link of sets of n and m shingles: they differ in no more members than it allows."""
    differ = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in _WORDS[1:]), F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0"))))
    return differ <= n + m - 2 * _overlap(n, m, pct)


class _Verifier:
    """Exact checks of candidate pairs against the whole shingle sets."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, seed: int, pct: int):
        self.docs, self.nodes, self.width, self.seed, self.pct = docs, nodes, width, seed, pct

    def joined(self, pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """pairs (a, b) with their sets sa and sb; tables to discard afterwards."""
        spark = pairs.sparkSession
        keys = stored(pairs.select(F.col("a").alias("k")).unionAll(pairs.select(F.col("b").alias("k"))).distinct(), "keys")
        bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], (8 * keys.count()).bit_length()))
        want = self.nodes.join(keys, "k", "left_semi").select("h")
        b0, b1 = _wanted("h", bits)
        marked = want.select(b0.alias("b0"), b1.alias("b1"))
        slices = 1 << max(0, bits - 20)
        filled = _gather(marked.mapInArrow(_bloom_slices(bits, slices), "slice int, counts binary"), _or_slices, np.uint8, 1 << (bits - 3), slices)
        bloom = spark.sparkContext.broadcast(filled)
        read = self.docs.select("text", F.xxhash64("doc_id").alias("h")).select("text", b0.alias("b0"), b1.alias("b1"))
        sets = stored(read.mapInArrow(_sets(self.width, self.seed, bloom), "k long, shingles array<long>").join(keys, "k", "left_semi").dropDuplicates(["k"]), "sets")
        bloom.unpersist()
        left = sets.select(F.col("k").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("k").alias("b"), F.col("shingles").alias("sb"))
        # one pair in memory at a time; batches of whole sets for Python are not bounded
        return spread_join(pairs, right, "b").join(left, "a"), [keys, sets]

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b) that link; stored."""
        both = F.size(F.array_intersect("sa", "sb"))
        joined, used = self.joined(pairs)
        out = stored(joined.where((100 + self.pct) * both >= self.pct * (F.size("sa") + F.size("sb"))).select("a", "b"), name)
        discard(*used)
        return out

    def stars(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with sizes n and m, c (shared shingles), linked, and the shingles that one of them lacks where they share half of the larger one; stored."""
        joined, used = self.joined(pairs)
        sized = joined.select("a", "b", "sa", "sb", F.size("sa").cast("long").alias("n"), F.size("sb").cast("long").alias("m"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("c"))
        delta = F.when(2 * F.col("c") >= F.greatest("n", "m"), F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")))
        linked = (100 + self.pct) * F.col("c") >= self.pct * (F.col("n") + F.col("m"))
        out = stored(sized.select("a", "b", "n", "m", "c", linked.alias("linked"), delta.alias("delta")), "stars-verified")
        discard(*used)
        return out


def _around_hubs(stars: DataFrame, groups: DataFrame, words: DataFrame, pct: int, used: list[DataFrame]) -> DataFrame:
    """Candidate pairs (a, b) of different groups among the nodes around each hub, by a prefix join of their differences from it.

    stars: as verified, those with a difference only. groups: (k, g) of every node in a group. words: (k, w0 to w3) of every node. used: gets the tables to discard once the pairs are stored. Of x and y at least one doesn't link to the
    hub, being in different groups; shingles that no such node's difference holds, or only one node's, can't be shared.
    """
    far_hubs = stars.where(~F.col("linked")).select("b").distinct()
    near = stars.join(far_hubs, "b", "left_semi").select("b", F.col("a").alias("k"), "n", F.col("m").alias("hub_n"), "c", "linked", "delta")
    near = near.join(groups, "k", "left").withColumn("g", F.coalesce("g", "k"))
    # what a link with any node of another group asks for at least: with all of the hub, or with one that just misses it
    lacks = F.col("hub_n") - F.col("c")
    least = F.when(F.col("linked"), F.floor((pct * (F.col("n") - F.col("hub_n")) + (100 + pct) * lacks) / (100 + pct)) + 1).otherwise(_overlap(F.col("n"), F.col("hub_n"), pct) - F.col("c"))
    rows = near.select("b", "k", "n", "hub_n", "c", "linked", "g", F.greatest(least, F.lit(1)).alias("least"), F.explode("delta").alias("t"))
    held = rows.groupBy("b", "t").agg(F.count("*").alias("df"), F.min("linked").alias("all_linked")).where("df > 1 and not all_linked").select("b", "t", "df")
    of_node = Window.partitionBy("b", "k")
    rows = rows.join(held, ["b", "t"]).withColumn("left_over", F.count("*").over(of_node) - F.row_number().over(of_node.orderBy("df", "t")) + 1)
    rows = stored(rows.where(F.col("left_over") >= F.col("least")).drop("df", "least").join(words, "k"), "differences")
    need = _overlap(F.col("x.n"), F.col("y.n"), pct) + F.col("x.hub_n") - F.col("x.c") - F.col("y.c")
    wanted = (
        (F.col("x.g") != F.col("y.g")) & (F.col("y.linked") | (F.col("x.k") < F.col("y.k")))
        & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * pct) & (F.least("x.left_over", "y.left_over") >= need) & _may_link(F.col("x.n"), F.col("y.n"), pct)
    )
    used.append(rows)
    sizes = rows.groupBy("b", "t").agg(F.count("*").alias("rows"))
    return paired_join(rows.where(~F.col("linked")), rows, ["b", "t"], sizes, wanted, "k").select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()


def _between_hubs(shared: DataFrame, groups: DataFrame, hubs: DataFrame, words: DataFrame, pct: int, used: list[DataFrame]) -> DataFrame:
    """Candidate pairs (a, b), a being the larger, of different groups and different hubs, by multi-match prefixes. used: gets the tables to discard once the pairs are stored."""
    tagged = shared.join(groups, "k", "left").join(hubs, "k", "left").select("token", "k", "n", "rest", F.coalesce("g", "k").alias("g"), F.coalesce("hub", "k").alias("hub"))
    tagged = stored(tagged.distinct(), "tagged")
    lists = tagged.groupBy("token", "hub").agg(F.count("*").alias("rows"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    lists = lists.groupBy("token").agg(F.max(F.struct("rows", "hub"))["hub"].alias("most"), F.sum("rows").alias("rows"), F.min("g0").alias("g0"), F.max("g1").alias("g1"), F.min("hub").alias("h0"), F.max("hub").alias("h1"))
    lists = lists.where("g0 <> g1 and h0 <> h1").select("token", "most", "rows")
    position = F.shiftright(F.col("rest").bitwiseAND((1 << 33) - 1), 2)
    kept = spread_join(tagged, lists.select("token", "most"), "token", lists.select("token", "rows"))
    kept = kept.select("token", "k", "n", "g", "hub", (F.col("hub") == F.col("most")).alias("usual"), position.alias("p"), F.col("rest").bitwiseAND(3).alias("l"))
    # r: prefix shingles before this one that another group holds too; no other can be shared across groups
    kept = stored(kept.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("p")) - 1).join(words, "k"), "between")
    discard(tagged)
    sizes = stored(kept.groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") > common.HOT), "hot-tokens")
    used += [kept, sizes]

    def matches(x, y):
        need_probe = F.ceil(pct * F.col("x.n") / 100)
        need_index = F.ceil(2 * pct * F.col("y.n") / (100 + pct))
        left_over = F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))
        wanted = (
            (F.col("x.g") != F.col("y.g")) & (F.col("x.hub") != F.col("y.hub"))
            & ((F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.k") > F.col("y.k"))))
            & (F.col("y.n") * 100 >= F.col("x.n") * pct)
            & (F.col("x.p") < F.col("x.n") - need_probe + F.col("x.l")) & (F.col("y.p") < F.col("y.n") - need_index + F.col("x.l"))
            & (F.least("x.r", "y.r") + left_over >= _overlap(F.col("x.n"), F.col("y.n"), pct)) & _may_link(F.col("x.n"), F.col("y.n"), pct)
        )
        found = paired_join(x, y, ["token"], sizes, wanted, "k")
        return found.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.l").alias("l"), F.col("x.n").alias("n"), F.col("y.n").alias("m"), F.col("x.p").alias("p"), F.col("y.p").alias("q"))

    others = kept.where(~F.col("usual"))
    found = matches(others, kept).unionAll(matches(kept.where("usual"), others))
    first = 1 + F.least(F.col("n") - F.col("p") - 1, F.col("m") - F.col("q") - 1)
    return (
        found.groupBy("a", "b")
        .agg(F.count("*").alias("hits"), F.max("l").alias("l"), F.max("n").alias("n"), F.max("m").alias("m"), F.min("p").alias("p"), F.min("q").alias("q"))
        .where((F.col("hits") >= F.col("l")) & (first >= _overlap(F.col("n"), F.col("m"), pct)))
        .select("a", "b")
    )


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity_pct: int = 75) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles (long), component_id (smallest doc_id reachable over links).

    Words are runs of anything but space and the characters 9 to 13, with A-Z lowered; two documents link when
    100 * shared >= similarity_pct * union of their shingle sets. Null or empty texts and texts without words
    have no shingles and link with nothing. Repeated rows, and rows of one doc_id with several texts, each count
    by their own text. A null doc_id keeps its row; its component_id is the smallest other id of its component,
    or null. Further columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    pct = similarity_pct
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    bits, slices = _sketch_shape(docs)
    seed = 0
    while True:
        found = stored(docs.mapInArrow(_nodes(width, seed, bits, slices), f"doc_id long, n int, k long, k2 long, {' long, '.join(_WORDS)} long, slice int, counts binary"), "nodes")
        rows = found.where("slice is null").select("doc_id", "n", "k", "k2", *_WORDS)
        grouped = rows.where("n > 0").groupBy("k").agg(F.max("n").alias("n"), F.min("doc_id").alias("first_id"), F.min("k2").alias("lo"), F.max("k2").alias("hi"), F.count("*").alias("rows"), *(F.first(w).alias(w) for w in _WORDS))
        classes = stored(grouped.withColumn("h", F.xxhash64("first_id")), "classes")
        if not classes.where("lo <> hi").limit(1).count():
            break
        seed += 1  # two different sets met in one key
        discard(found, classes)
    counts = _gather(found.where("slice is not null").select("slice", "counts"), _sum_slices, np.uint16, 1 << bits, slices)
    sketch = spark.sparkContext.broadcast(counts)

    prefix = docs.select("text").mapInArrow(_prefixes(width, seed, pct, sketch), "token long, k long, rest long, hub int, spread int")
    # a list that may be long is looked at in parts, whose ends are put together afterwards
    of_list = Window.partitionBy("token", "part")
    parted = prefix.withColumn("part", F.when(F.col("spread") > 0, F.pmod(F.xxhash64("k"), F.col("spread") + 1)).otherwise(F.lit(0)))
    parted = parted.withColumn("lo", F.min("k").over(of_list)).withColumn("hi", F.max("k").over(of_list)).withColumn("center", F.min(F.struct("hub", "k")).over(of_list)).where("lo <> hi or spread > 0")
    listed = stored(parted.select("token", "k", "rest", F.shiftrightunsigned("rest", 33).alias("n"), "lo", "hi", "center", (F.col("spread") > 0).alias("long")), "prefixes")
    sketch.unpersist()
    ends = listed.where("long").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("center").alias("center"), F.count("*").alias("rows"))
    long_lists = spread_join(listed.where("long").select("token", "k", "rest", "n"), ends.where("lo <> hi").select("token", "center"), "token", ends.select("token", "rows"))
    shared = listed.where("not long").select("token", "k", "rest", "n", "center").unionAll(long_lists.select("token", "k", "rest", "n", "center")).withColumn("center", F.col("center.k"))
    verify = _Verifier(docs, classes, width, seed, pct)

    near = shared.where("k <> center").groupBy("k", "center").agg(F.count("*").alias("hits"))
    star = near.groupBy("k").agg(F.max(F.struct("hits", "center")).alias("best")).select("k", F.col("best.center").alias("low"))
    sized = classes.select("k", "n")
    star = stored(star.join(sized, "k"), "stars-sized")
    near_size = spread_join(star, sized.select(F.col("k").alias("low"), F.col("n").alias("m")), "low").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * pct)
    starred = stored(near_size.select(F.col("k").alias("a"), F.col("low").alias("b")), "stars")
    stars = verify.stars(starred)
    linked = stars.where("linked").select("a", "b")
    roots = components(linked, "a", "b")

    groups = roots.select(F.col("node").alias("k"), F.col("component").alias("g"))
    around = stars.where(F.col("delta").isNotNull())
    words = classes.select("k", *_WORDS)
    used = [listed, star, starred, stars]
    pairs = _around_hubs(around, groups, words, pct, used).unionAll(_between_hubs(shared, groups, around.select(F.col("a").alias("k"), F.col("b").alias("hub")), words, pct, used))
    pairs = stored(pairs, "pairs")
    more = verify.links(pairs, "links")

    merged = stored(components(roots.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), "a", "b").withColumnRenamed("node", "k"), "merged")
    discard(*used, pairs, more)
    lowest = classes.join(merged, "k").groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("rows"))
    of_class = spread_join(merged, lowest.select("component", "component_id"), "component", lowest.select("component", "rows")).select("k", F.col("component_id").alias("lowest"), F.lit(True).alias("linked"))
    of_class = classes.join(of_class, "k", "left").select("k", F.when(F.col("linked"), F.col("lowest")).otherwise(F.col("first_id")).alias("component_id"))
    out = spread_join(rows.where("n > 0"), of_class, "k", classes.select("k", "rows")).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    out = stored(out.unionAll(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))), "components")
    discard(found, classes, merged)
    return out
