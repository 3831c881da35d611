"""Near-duplicate components against brute force where groups are large, hubs miss their members, and hot keys are dealt out."""

import random

import numpy as np
import pytest

from lakequill.llm import common, components, ngram_join


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row, by counting what every two rows share."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    held: dict[tuple, list] = {}
    for a, x in enumerate(sets):
        for s in x:
            held.setdefault(s, []).append(a)
    columns = [v for v in held.values() if len(v) > 1]
    m = np.zeros((len(rows), len(columns)), np.float32)
    for c, v in enumerate(columns):
        m[v, c] = 1
    shared, n = m @ m.T, np.array([len(x) for x in sets])
    for a, b in zip(*np.nonzero((100 * shared >= 75 * (n[:, None] + n[None] - shared)) & (shared > 0))):
        root[find(a)] = find(b)
    ids: dict[int, int] = {}
    for a, (i, _) in enumerate(rows):
        if i is not None and sets[a]:
            ids[find(a)] = min(ids.get(find(a), i), i)
    return [(i, len(sets[a]), ids.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]


def group(r, n, words, most, without=0):
    """n texts that each change 1 to `most` words of one text of `words` words; changed words are new, or of a small pool."""
    base = [f"b{r.randint(0, 10**6)}" for _ in range(words)]
    pool = [f"p{r.randint(0, 10**6)}" for _ in range(40)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(1, most)):
            w[r.randrange(words)] = r.choice(pool) if r.random() < 0.5 else f"n{r.randint(0, 10**9)}"
        if without and k % without == 0:
            del w[: r.randint(1, 12)]
        out.append(" ".join(w))
    return out


def run(spark, rows):
    return sorted(map(repr, map(tuple, ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())))


@pytest.mark.parametrize("hot", [4096, 3])
def test_groups_that_no_hub_holds_together(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(ngram_join, "LIST", hot)
    r = random.Random(hot)
    n = 2000 if hot > 3 else 80
    texts = group(r, n, 100, 6, without=7) + group(r, 60, 30, 3) + group(r, 40, 400, 30, without=3) + ["one two", "one two", "", "   "] + [f"x{i} y z" for i in range(20)]
    texts += texts[:30]
    r.shuffle(texts)
    rows = [(None if i % 97 == 5 else i // 2 if i % 31 == 0 else i, t) for i, t in enumerate(texts)]
    got, want = run(spark, rows), brute(rows)
    assert got == sorted(map(repr, want))
    sizes: dict = {}
    for row in want:
        sizes[row[2]] = sizes.get(row[2], 0) + 1
    assert max(sizes.values()) > n // 4 and len(sizes) > 60  # some in one large group, many left alone


def test_chains(spark):
    """Neighbours link, ends don't: a window that slides over one long text."""
    r = random.Random(3)
    w = [f"c{r.randint(0, 10**9)}" for _ in range(600)]
    rows = [(i, " ".join(w[3 * i : 3 * i + 60])) for i in range(40)] + [(500 + i, " ".join(w[20 * i : 20 * i + 60])) for i in range(20)]
    assert run(spark, rows) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("hot", [4096, 2])
def test_components_of_stars_and_paths(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    edges = [(5, i) for i in range(20, 60)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (1, None), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {5: 5} | {i: 5 for i in range(20, 60)} | {i: 100 for i in range(100, 131)} | {200: 200, 201: 200}


def test_key_collision_is_tried_again(spark, monkeypatch):
    """Two different sets in one key: everything is hashed again under another seed."""

    real, asked = ngram_join._nodes, []

    def nodes(width, seed, bits, slices):
        asked.append(seed)
        inner = real(width, seed, bits, slices)
        if seed:
            return inner

        def run(batches):
            import pyarrow as pa

            for b in inner(batches):
                at = b.schema.get_field_index("k")
                k = pa.array([None if x is None else 1 for x in b.column("k").to_pylist()], pa.int64())
                yield b.set_column(at, "k", k)

        return run

    monkeypatch.setattr(ngram_join, "_nodes", nodes)
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "something else")]
    assert run(spark, rows) == sorted(map(repr, brute(rows))) and asked == [0, 1]


def test_sketch_counts_keep_their_order():
    x = np.array([0, 1, 2, 200, 256, 70_000, 2**31, 2**40])
    y = ngram_join._decoded(ngram_join._coded(x))
    assert (y[:5] == x[:5]).all() and (np.abs(y - x) <= x / 100).all() and (np.diff(y) > 0).all()
