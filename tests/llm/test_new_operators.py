"""Sharding along a curve, the conversation trie and spelling variants against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakequill.llm import sharding, spelling, trie


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2), (3, 3), (4, 1)])
def test_hilbert_curve_visits_every_cell_by_single_steps(spark, n, bits):
    size = 1 << bits
    cells = spark.range(size**n).select(*(F.expr(f"cast(id div {size**i} % {size} as int)").alias(f"x{i}") for i in range(n)))
    rows = sorted(tuple(r) for r in cells.select(sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits).alias("h"), *cells.columns).collect())
    assert [r[0] for r in rows] == list(range(size**n))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(rows, rows[1:]))


def documents(spark, n=400, seed=5):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(60)]), r.choice(["de", "en", None]), "hot" if r.random() < 0.6 else f"s{r.randint(0, 9)}", r.choice([None, "", "x" * r.randint(0, 50)]), 1, 2) for _ in range(n)]
    rows += [(7, "en", "hot", "same", 1, 2)] * 100
    return rows, spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, shard int, at int")


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    rows, df = documents(spark)
    df = df.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1)
    got = sharding.shards(df, ["lang", "source", "size"], ["doc_id", "text"], 8, law, "size", bits=3).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.lang, r.source, r.text, r["at"]) for r in got), key=key) == sorted(((r[0], r[1], r[2], r[3], r[5]) for r in rows), key=key)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        sums = [sum(r.size for r in x) for x in by.values()]
        assert max(sums) - min(sums) <= 2 * max(r.size for r in got)
    assert sharding.shards(df.where("false"), ["lang", "size"], ["doc_id"]).count() == 0


def test_cells_hold_equal_shares(spark):
    df = spark.range(1000).selectExpr("id v", "case when id < 700 then 'a' else concat('b', id) end s", "cast(null as int) none")
    assert [low for low, _ in sharding.cells(df, "v", 3)] == list(range(0, 1000, 125))
    assert [c for _, c in sharding.cells(df, "s", 3)] == [0, 5, 6, 7]
    assert sharding.cells(df, "none", 3) == [(None, 0)]


def test_written_shards_are_pruned(spark, tmp_path):
    df = spark.range(4000).selectExpr("id doc_id", "id % 40 a", "id div 100 b")
    cut = sharding.shards(df, ["a", "b"], ["doc_id"], 8)
    manifest = sharding.write_shards(cut, ["a", "b"], f"file://{tmp_path}/shards", rows_per_file=100)
    files = manifest.collect()
    assert sum(f.n_rows for f in files) == 4000 and all(f.n_rows <= 100 for f in files)
    found = sharding.pruned(manifest, a=(0, 3), b=(0, 3))
    uris = [r.uri for r in found.collect()]
    kept = spark.read.parquet(*uris)
    assert kept.where("a <= 3 and b <= 3").count() == df.where("a <= 3 and b <= 3").count()
    assert len(uris) <= len(files) / 4  # a sort by one column would keep a tenth of the files, or all


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    nodes, ends = {}, {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + -c % 5
        turns = tuple(convs.get(base, [])[:h] + convs[c][h:])
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in nodes if q)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, sha))
    return sorted(out)


def conversations(seed, n=60):
    r = random.Random(seed)
    texts = ["hi", "", None, "ü?", "tell me", "more"]
    rows = []
    for c in r.sample(range(-12, 90), n):
        first = r.random() < 0.5
        for turn in range(r.randint(1, 12)):
            rows.append((c, None if r.random() < 0.05 else turn, "system" if first and not turn else r.choice(["user", "assistant", None]), "same start" if first and turn < 2 else r.choice(texts)))
    rows += [(200 + i, t, "user", f"copy {t}") for i in range(40) for t in range(10)]
    rows += [(300, t % 7, "user", f"w{t % 3}") for t in range(50)] + rows[:9] + [(None, 0, "user", "no conversation")] * 3
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("long", [trie.LONG, 9])
def test_prefix_trie(spark, long):
    rows = conversations(1)
    df = spark.createDataFrame([(*x, 1, "e") for x in rows], "conv_id long, turn int, role string, text string, depth int, ends string").repartition(3)
    got = sorted((tuple(r) for r in trie.prefix_trie(df, long_turns=long).collect()))
    assert got == brute_trie(rows)


def test_prefix_trie_of_few(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(6, 0, "user", "x" * 3000)]  # rebuilt without a base; of few turns nothing may be left
    assert [tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()] == brute_trie(rows)


def edits(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_trie_pairs_of_a_group():
    r = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(r.choice("abé") for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 40))})
        assert sorted(spelling.trie_pairs([(w, w) for w in words])) == [(a, b) for a in words for b in words if a < b and edits(a, b)]


@pytest.mark.parametrize("limit", [2, 5, 1000])
def test_near_words(spark, limit):
    r = random.Random(limit)
    words = {"".join(r.choice("abü") for _ in range(r.randint(1, 9))) for _ in range(150)} | {"constant" + "".join(r.choice("xyz") for _ in range(3)) for _ in range(30)} | {"a" * n for n in range(1, 40)}
    got = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), limit).collect()
    assert sorted(tuple(x) for x in got) == sorted((a, b) for a in words for b in words if a < b and edits(a, b))


def brute_words(rows):
    n = Counter()
    for d, t in rows:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_spelling_variants(spark):
    r = random.Random(9)
    base = ["Wonderful", "gardening", "Éclairage", "elevators", "×÷letters", "seventh", "sixths"]
    rows = [(r.choice([None, *range(500)]), " ".join(r.choice(base) if r.random() < 0.9 else r.choice(base)[:-1] + r.choice("abcs") for _ in range(r.randint(0, 40)))) for _ in range(300)]
    rows += [(i, t) for i, t in enumerate([None, "", "short", "x" * 5000, "wonderfull, wonderfull; wonderfully wonderfully"])] + [(1, "wonderfulz1wonderfulz2")] * 2
    n = brute_words(rows)
    want = []
    for w in n:
        near = [x for x in n if edits(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        want.append([w, best if best and n[best] >= 10 * n[w] else None, n[w], len(near)])
    form = {w: f for w, f, _, _ in want}

    def root(w):
        return root(form[w]) if form[w] else w

    df = spark.createDataFrame([(*x, "w", 3) for x in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = sorted(tuple(x) for x in spelling.spelling_variants(df).collect())
    assert got == sorted((w, f, root(w), k, near, n.get(f)) for w, f, k, near in want)
    assert any(x[1] for x in got)
    assert spelling.spelling_variants(df.where("false")).count() == 0


def test_roots_follow_chains(spark):
    # a chain of many steps: each form is ten times as frequent
    words = [("abcdefgh"[: 8 - i] + "z" * i, 10**i) for i in range(8)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1][0]}
