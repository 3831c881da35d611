"""Approximate nearest neighbours by multiprobe p-stable hashing.

Rows are split into bands of similar norms. Inner products become distances on a unit sphere by one more
coordinate, sqrt(M^2 - |v|^2) with M the largest norm of the band. A table hashes a row to the cells that
`projections` Gaussian directions fall into; given a query's projection p, that of a row at cosine c is normal with
mean c p and variance 1 - c^2. A sample of the queries, ranked exactly against every row, says at which cosine the
last of the k neighbours is expected; from it follow the cells' width and which of them a query probes: those
likelier for a neighbour than for any row, until they hold one with the chance `reach`. Candidates of all bands,
tables and probes are ranked by the exact measure on the original vectors. A query's own k-th score then tells how
far a missed neighbour can be at most; unless its probes would hold such a row with the chance `least`, the query is
ranked against every row.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import ship, stored


@dataclass(frozen=True)
class Hashing:
    """width: of a cell, in deviations of an expected neighbour's projection. ratio: of the norms in a band."""

    tables: int = 3
    projections: int = 4
    width: float = 1.54
    reach: float = 0.95
    least: float = 0.9
    ratio: float = 1.5
    bands: int = 16
    sample: int = 64
    seed: int = 5
    block: int = 2048

    def family(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return rng.standard_normal((self.tables, dim + 1, self.projections)), rng.uniform(0, 1, (self.tables, self.projections))

    def cell(self, c: float) -> float:
        return self.width * math.sqrt(1 - c * c)


def _phi(x):
    return 0.5 + 0.5 * np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2))


class Probes:
    """The cells of one table and band that queries with projections p (a row each) probe: of the grid around base, where mask says so, and home."""

    def __init__(self, h: Hashing, p: np.ndarray, shift: np.ndarray, c: float):
        self.p, self.shift, self.w = p, shift, h.cell(c)
        self.grid = np.array(list(itertools.product((-1, 0, 1), repeat=h.projections)))
        self.home = np.floor(p / self.w + shift)
        self.base = np.floor((1 + c) / 2 * p / self.w + shift)
        near, any_row = self._grid_chances(np.full(len(p), c)), self._grid_chances(np.zeros(len(p)))
        order = np.argsort(-near / np.maximum(any_row, 1e-12), axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(near, order, 1), 1) - np.take_along_axis(near, order, 1)
        self.mask = np.zeros(near.shape, bool)
        np.put_along_axis(self.mask, order, before < 1 - (1 - h.reach) ** (1 / h.tables), 1)
        inside = (np.abs(self.home - self.base) <= 1).all(1)
        self.mask |= inside[:, None] & ((self.home - self.base)[:, None, :] == self.grid[None]).all(2)
        self.alone = ~inside

    def _edge(self, cells: np.ndarray, c: np.ndarray) -> np.ndarray:
        return _phi(((cells - self.shift) * self.w - c[:, None] * self.p) / np.sqrt(np.maximum(1 - c * c, 1e-6))[:, None])

    def _grid_chances(self, c: np.ndarray) -> np.ndarray:
        edges = [self._edge(self.base + d, c) for d in (-1, 0, 1, 2)]
        chance = np.stack([edges[i + 1] - edges[i] for i in range(3)], 2)
        out = np.ones((len(self.p), len(self.grid)))
        for i in range(self.grid.shape[1]):
            out *= chance[:, i, :][:, self.grid[:, i] + 1]
        return out

    def chance(self, c: np.ndarray) -> np.ndarray:
        """Of each query, that a row at cosine c lies in its probed cells."""
        own = (self._edge(self.home + 1, c) - self._edge(self.home, c)).prod(1)
        return np.minimum(1, (self._grid_chances(c) * self.mask).sum(1) + self.alone * own)

    def cells(self, i: int) -> np.ndarray:
        found = self.base[i] + self.grid[self.mask[i]]
        return (np.vstack([found, self.home[i]]) if self.alone[i] else found).astype(np.int64)


def _code(band: int, cells: np.ndarray) -> list[str]:
    return [f"{band}:" + ",".join(map(str, c)) for c in cells]


def _vectors(batch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten(), np.float64).reshape(len(batch), dim)


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and norms."""
    most = np.abs(v).max(1)[:, None]
    size = np.sqrt(((v / most) ** 2).sum(1))[:, None]
    return v / most / size, (most * size)[:, 0]


def _take(batch, at, table, code):
    import pyarrow as pa

    rows = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("v").take(rows), pa.array(table, pa.int32()), pa.array(code, pa.string())], names=["id", "v", "t", "code"])


def _index(h: Hashing, dim: int, bands: dict[int, tuple[float, float]]):
    """Rows in their buckets. bands: largest norm and expected cosine of each band that is probed."""

    def run(batches):
        a, b = h.family(dim)
        for batch in batches:
            v, own = _vectors(batch, dim), np.array(batch.column("band").to_pylist())
            at, table, code = [], [], []
            for band, (norm, c) in bands.items():
                rows = np.flatnonzero(own == band)
                if not len(rows):
                    continue
                x = v[rows] / norm
                x = np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))])
                for t in range(h.tables):
                    at += rows.tolist()
                    table += [t] * len(rows)
                    code += _code(band, np.floor(x @ a[t] / h.cell(c) + b[t]).astype(np.int64))
            yield _take(batch, at, table, code)

    return run


def _probe(h: Hashing, dim: int, bands: dict[int, tuple[float, float]]):
    """Queries in the buckets they probe, few queries at a time: each has hundreds of rows."""

    def run(batches):
        a, b = h.family(dim)
        for whole in batches:
            for s in range(0, len(whole), 64):
                batch = whole.slice(s, 64)
                q, _ = _units(_vectors(batch, dim))
                at, table, code = [], [], []
                for band, (_, c) in bands.items():
                    for t in range(h.tables):
                        probes = Probes(h, q @ a[t][:-1], b[t], c)
                        for i in range(len(q)):
                            cells = probes.cells(i)
                            at += [i] * len(cells)
                            table += [t] * len(cells)
                            code += _code(band, cells)
                yield _take(batch, at, table, code)

    return run


def _incomplete(h: Hashing, dim: int, k: int, norms: dict[int, float], bands: dict[int, tuple[float, float]]):
    """(id, v) of the queries with fewer than k candidates, or whose probes hold a row as near as their k-th or nearer with less than the chance h.least."""

    def run(batches):
        import pyarrow as pa

        a, b = h.family(dim)
        for batch in batches:
            if not len(batch):
                continue
            q, size = _units(_vectors(batch, dim))
            last = np.array(batch.column("last").to_pylist(), np.float64) / size
            sure = np.array(batch.column("n").to_pylist()) >= k
            last[~sure] = 0
            for band, norm in norms.items():
                c = np.maximum(last / norm, -1)
                open_ = c <= 1 + 1e-9  # no row of the band can score more otherwise
                if band not in bands:
                    sure &= ~open_
                    continue
                tables = [Probes(h, q @ a[t][:-1], b[t], bands[band][1]) for t in range(h.tables)]
                c = np.minimum(c, 1)
                for at in (c, (1 + c) / 2):
                    miss = np.prod([1 - x.chance(at) for x in tables], axis=0)
                    sure &= ~open_ | (1 - miss >= h.least)
            yield batch.select(["id", "v"]).filter(pa.array(~sure))

    return run


def _last_scores(ids: np.ndarray, q: np.ndarray, k: int):
    """(query, score): the k best scores of each sampled query in a task's rows, its own row left out."""

    def run(batches):
        import pyarrow as pa

        top = np.full((len(q), k), -np.inf)
        for batch in batches:
            for s in range(0, len(batch), 4096):
                part = batch.slice(s, 4096)
                score = q @ _vectors(part, q.shape[1]).T
                score[ids[:, None] == np.array(part.column("id").to_pylist(), np.int64)[None]] = -np.inf
                top = np.sort(np.hstack([top, score]), 1)[:, -k:]
        at, j = np.nonzero(np.isfinite(top))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(top[at, j], pa.float64())], names=["query", "score"])

    return run


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products summed from left to right in double precision."""
    return np.cumsum(q * v, axis=1)[:, -1] if len(v) else np.zeros(0)


def best(q: np.ndarray, own, ids: np.ndarray, v: np.ndarray, k: int, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k nearest, own left out; ties go to the smaller id."""
    ok = np.flatnonzero(ids != own)
    r = rough[ok]
    if len(ok) > k:
        least = np.partition(r, len(r) - k)[len(r) - k]
        ok = ok[r >= least - 1e-9 * max(1.0, abs(least))]
    s = exact_scores(q, v[ok])
    order = np.lexsort((ids[ok], -s))[:k]
    return ids[ok][order], s[order]


def _search(dim: int, k: int):
    def run(index, queries):
        import pandas as pd

        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        ids, at = np.unique(index["id"].to_numpy(np.int64), return_index=True)
        v = np.stack(index["v"].to_numpy())[at].astype(np.float64)
        q = np.stack(queries["v"].to_numpy()).astype(np.float64)
        rough = q @ v.T
        out = [best(q[i], own, ids, v, k, rough[i]) for i, own in enumerate(queries["id"].to_numpy(np.int64))]
        n = [len(x) for x, _ in out]
        return pd.DataFrame({"query_id": np.repeat(queries["id"].to_numpy(np.int64), n), "vec_id": np.concatenate([x for x, _ in out]), "score": np.concatenate([s for _, s in out])})

    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a vector that is not null, not zero, and without null or non-finite components."""
    v = F.col(embedding).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest(vectors: DataFrame, is_query, k: int = 20, hashing: Hashing = Hashing(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by inner product, its own row left out.

    is_query: a condition on the column id. Vectors null, zero or with null or non-finite components take no part,
    nor rows without an id or of a dimension other than the commonest (the smaller at a tie). Ties go to the smaller
    vec_id; of rows that share an id one counts. A query whose probes don't reach far enough for its k-th score, or
    find fewer than k rows, is ranked against every row, in blocks. Buckets are dealt in blocks of hashing.block rows,
    so a hot one is spread over tasks. An empty table gives an empty result. Scales and spreads of norms don't matter.
    """
    spark = vectors.sparkSession
    ship(spark)
    h = hashing
    good = usable(vectors, vec_id, embedding)
    sizes = sorted(((-r["count"], r["d"]) for r in good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()))
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0][1]
    most = F.array_max(F.transform("v", F.abs))
    good = good.where(F.size("v") == dim).dropDuplicates(["id"]).withColumn("most", most)
    good = stored(good.select("id", "v", (F.col("most") * F.sqrt(F.aggregate(F.transform("v", lambda x: x / F.col("most")), F.lit(0.0), lambda a, x: a + x * x))).alias("norm")), "ann-rows")
    largest = good.agg(F.max("norm")).first()[0]
    band = F.least(F.floor(F.log(F.lit(largest) / F.col("norm")) / math.log(h.ratio) + 1e-9), F.lit(h.bands - 1)).cast("int")
    good = good.withColumn("band", band)
    norms = {r["band"]: r["norm"] for r in good.groupBy("band").agg(F.max("norm").alias("norm")).orderBy("band").collect()}
    bands = _expected(good, good.where(is_query), k, h, norms)
    hashed = "id long, v array<double>, t int, code string"
    index = stored(good.select("id", "v", "band").mapInArrow(_index(h, dim, bands), hashed), "ann-index")
    probes = stored(good.where(is_query).select("id", "v").mapInArrow(_probe(h, dim, bands), hashed), "ann-probes")
    blocks = index.groupBy("t", "code").agg(F.ceil(F.count("*") / hashing.block).cast("int").alias("ib"))
    asked = probes.groupBy("t", "code").agg(F.ceil(F.count("*") / hashing.block).cast("int").alias("qb"))
    both = stored(blocks.join(asked, ["t", "code"]), "ann-blocks")
    salt = F.xxhash64("id", F.lit(11))
    left = index.join(both, ["t", "code"]).select("id", "v", "t", "code", F.pmod(salt, F.col("ib")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb").cast("long") - 1)).alias("q"))
    right = probes.join(both, ["t", "code"]).select("id", "v", "t", "code", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ib").cast("long") - 1)).alias("i"), F.pmod(salt, F.col("qb")).alias("q"))
    keys = ["t", "code", "i", "q"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_search(dim, k), "query_id long, vec_id long, score double")
    found = stored(_top(found.distinct(), k), "ann-found")
    full = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    judged = good.where(is_query).join(full, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("last", F.lit(0.0)).alias("last"))
    short = stored(judged.mapInArrow(_incomplete(h, dim, k, norms, bands), "id long, v array<double>"), "ann-short")
    n_short = short.count()
    if n_short:
        parts = max(1, math.ceil(n_short / hashing.block))
        blocks_of = max(1, math.ceil(good.count() / hashing.block))
        deal = short.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_of - 1).cast("long"))).alias("i"), F.pmod(salt, F.lit(parts)).alias("q"))
        rows = good.select("id", "v", F.pmod(salt, F.lit(blocks_of)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("q"))
        again = rows.groupBy("i", "q").cogroup(deal.groupBy("i", "q")).applyInPandas(_search(dim, k), "query_id long, vec_id long, score double")
        kept = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
        found = kept.unionByName(_top(again, k))
    return found.select("query_id", "rank", "vec_id", "score")


def _expected(good: DataFrame, queries: DataFrame, k: int, h: Hashing, norms: dict[int, float]) -> dict[int, tuple[float, float]]:
    """Largest norm and expected cosine of a k-th neighbour for each band to probe, from a bounded sample of queries that meet every row."""
    asked = queries.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(h.sample).select("id", "v").collect()
    if not asked:
        return {}
    q, _ = _units(np.array([r["v"] for r in asked], np.float64))
    scores = good.select("id", "v").mapInArrow(_last_scores(np.array([r["id"] for r in asked], np.int64), q, k), "query int, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"))
    last = [r["score"] for r in scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).collect()]
    if not last:
        return {}
    usual, lowest = float(np.quantile(last, 0.1)), min(last)
    return {band: (norm, min(max(usual / norm, -0.9), 0.9)) for band, norm in norms.items() if lowest < norm}


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def brute_force(ids: np.ndarray, v: np.ndarray, queries: np.ndarray, k: int = 20) -> dict[int, list[int]]:
    """The true k nearest of each query, for tests and recall."""
    rows = {int(i): n for n, i in enumerate(ids)}
    return {int(i): best(v[rows[int(i)]], i, ids, v, k, v @ v[rows[int(i)]])[0].tolist() for i in queries}
