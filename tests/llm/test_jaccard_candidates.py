"""The Jaccard join's word hash and candidates: words that differ in order alone, corpora of phrases, and split hot keys."""

import random
import re

import numpy as np
import pytest

from lakequill.llm import common, decontam, ngram_join, shingles

LOW = str.maketrans(decontam.UPPER, decontam.LOWER)


def components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {rows[a][0]: (len(sets[a]), rows[find(a)][0]) for a in range(len(rows))}


def run(spark, rows):
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}


def morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_equal_letters_in_other_places(spark):
    swap = str.maketrans("ab", "ba")
    words = [f(morse(n)) for n in (8, 16, 64, 65, 1024, 4096) for f in (str, lambda x: x.translate(swap))]
    rows = list(enumerate(words))
    assert run(spark, rows) == {i: (1, i) for i, _ in rows}


def test_word_hashes_see_every_byte_and_the_seed():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abé") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    a, _ = shingles.word_hashes(data, np.array([0, len(data)]))
    b, _ = shingles.word_hashes(data, np.array([0, len(data)]), 1)
    assert len(set(a.tolist())) == len(a) == len(words) and not set(a.tolist()) & set(b.tolist())
    apart = [shingles.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0] for w in words[:200]]
    assert apart == a[:200].tolist()  # a word's hash doesn't depend on what stands around it


def phrases(n, seed=3):
    r = random.Random(seed)
    made = [" ".join(f"w{r.randint(0, 400)}" for _ in range(12)) for _ in range(20)]
    return [(i, " ".join(r.sample(made, 4))) for i in range(n)]


def test_candidates_of_phrases_grow_with_the_rows(spark, monkeypatch):
    counted = []
    links = ngram_join._Verifier.links
    monkeypatch.setattr(ngram_join._Verifier, "links", lambda self, pairs, name: counted.append(pairs.count()) or links(self, pairs, name))
    for n in (1000, 3000):
        rows = phrases(n)
        got = run(spark, rows)
        assert len(got) == n
        if n == 1000:
            assert got == components(rows)
    assert counted[1] <= 4 * max(counted[0], 100), counted


@pytest.mark.parametrize("hot", [3, 4096])
def test_split_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    r = random.Random(5)
    base = phrases(30, 8)
    rows = list(base)
    for i in range(30, 160):
        w = r.choice(base)[1].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, "the same short text here again") for i in range(40)]
    assert run(spark, rows) == components(rows)


def test_parities_bound_the_difference():
    r = np.random.default_rng(2)
    for _ in range(200):
        x, y = (np.unique(r.integers(0, 2**63, r.integers(0, 400), dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate((y[:5], x[: r.integers(0, len(x) + 1)])))
        differ = sum(bin(int(a) & (2**64 - 1)).count("1") for a in shingles.parities(x) ^ shingles.parities(y))
        assert differ <= len(np.setxor1d(x, y))
