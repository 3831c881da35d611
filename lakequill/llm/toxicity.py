"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a given and of a learned lexicon (whole words and word beginnings, weighed by log odds),
nearness of hits to the second person, capitals, punctuation and obfuscation rates. Lexicon weights that training
rows see come from the other folds, so trees don't learn to trust a row's own label.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lakequill.llm.common import discard, ship, stored, text_or_empty, trim_worker

#: Bound of the labelled rows that the model is fitted on, chosen by a hash of their ids, one row for each id.
MAX_TRAIN, FOLDS = 20_000, 3
# Common insults that the lexicon begins with, and words of the second person.
SEED = frozenset("idiot idiots moron morons stupid loser losers pathetic worthless scum trash disgusting clown dumb fool garbage imbecile jerk idiota estúpido imbécil basura idiote stupide ordure crétin dumm trottel abschaum blöd arschloch".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi vous votre vos ton ta tes tú ti usted ustedes vosotros tus su".split())
_WORD = re.compile(r"[^\W_]+")
# begins where a letter run does and never gives letters back: linear however long a run is
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[@$*!0-57]++[^\W\d_]++)+")
_LEET = str.maketrans("@$013457!", "asoleasti")
_UPPER, _PUNCT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?.,;:*#&%$@\"'()-"
NEAR = 5
NAMES = ("log_words", "seed_hits", "seed_density", "learned_max", "learned_sum", "learned_density", "learned_hits", "strong_hits", "near_second", "second_density", "capitals", "capital_words", "punctuation", "marks", "obfuscated", "runs", "distinct", "mean_length")


def terms(word: str) -> list[str]:
    """A word and its beginnings of four to six letters, marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in (4, 5, 6) if len(word) > k)]


def words_in(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Lexicon:
    """Weights of words as they are written, with bounded sets of the words seen so far."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.heads = {t.rstrip("-")[:4] for t in weights} | {w[:4] for w in SEED | SECOND}
        self.seen: set[str] = set()
        self.upper: set[str] = set()
        self.marked: dict[str, tuple[float, int, int]] = {}  # weight, is a seed, is of the second person

    def learn(self, words) -> None:
        if len(self.seen) > 300_000:
            self.seen.clear()
            self.upper.clear()
            self.marked.clear()
        for w in words:
            low = w.lower()
            if low[:4] in self.heads:
                if low in SECOND:
                    self.marked[w] = (0.0, 0, 1)
                elif (x := max(self.weights.get(t, 0.0) for t in terms(low))) or low in SEED:
                    self.marked[w] = (x, int(low in SEED), 0)
            elif not low.isalpha() and low.translate(_LEET) in SEED:
                self.marked[w] = (0.0, 1, 0)
            if w.isupper():
                self.upper.add(w)
        self.seen.update(words)


def letter_runs(data: bytes) -> int:
    """Places where an ASCII letter stands four times in a row."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < 4:
        return 0
    same = x[1:] == x[:-1]
    at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
    return int(np.isin(x[at] | 32, np.arange(97, 123)).sum()) if len(at) else 0


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The values named in NAMES, over the whole text."""
    raw = _WORD.findall(text)
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    counts = Counter(raw)
    seeds = hits = strong = second = 0
    total = top = 0.0
    if new := counts.keys() - lexicon.seen:
        lexicon.learn(counts if len(lexicon.seen) > 300_000 else new)
    marked = {w: lexicon.marked[w] for w in counts.keys() & lexicon.marked.keys()}
    for w, (x, seed, you) in marked.items():
        c = counts[w]
        second += c * you
        if not you:
            seeds += c * seed
            hits += c
            total += c * x
            strong += c * (x >= 3)
            top = max(top, x)
    caps = sum(counts[w] for w in counts.keys() & lexicon.upper)
    masked = 0
    for m in _MASKED.findall(text):
        masked += 1
        plain = m.lower().translate(_LEET)
        if plain in SEED or "*" in plain and any(len(s) == len(plain) and all(a in ("*", b) for a, b in zip(plain, s)) for s in SEED):
            own = marked.get(m)  # masked by digits alone it is a word, which may be counted above
            seeds += not (own and own[1])
            hits += not own
    near = 0
    if second and hits:
        last_second = last_hot = -NEAR - 1
        for i, w in enumerate(raw):
            if w not in marked:
                continue
            if marked[w][2]:
                near += i - last_hot <= NEAR
                last_second = i
            else:
                near += i - last_second <= NEAR
                last_hot = i
    data = text.encode("utf-8", "surrogatepass")
    size, chars = len(data), max(1, len(text))
    marks = text.count("!") + text.count("?")
    return [
        math.log1p(n), math.log1p(seeds), seeds / n, top, math.log1p(total), total / n, math.log1p(hits), math.log1p(strong), near / n, second / n,
        (size - len(data.translate(None, _UPPER))) / chars, caps / n, (size - len(data.translate(None, _PUNCT))) / chars, marks / chars, masked / n,
        letter_runs(data) / n, len(counts) / n, chars / n,
    ]


def _term_counts(batches):
    import pyarrow as pa

    trim_worker()
    out: Counter = Counter()
    docs: Counter = Counter()

    def rows():
        keys = list(out)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["term", "fold", "toxic", "n"])

    for batch in batches:
        for text, fold, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "toxic"))):
            seen = {t for w in set(words_in(text)) for t in terms(w)}
            out.update((t, fold, toxic) for t in seen)
            docs[fold, toxic] += 1
            if len(out) > 300_000:
                yield rows()
                out.clear()
    out.update({("", f, y): n for (f, y), n in docs.items()})
    yield rows()


def lexicon_weight(totals: dict, folds):
    """Column: the weight (log odds over 1.5, shrunk) of a term that stands out in toxic rows of these folds, else null. Columns cFY: rows of fold F and label Y that hold it; totals: all such rows."""
    t_all, n_all = (sum(totals[f"c{f}{y}"] or 0 for f in folds) for y in (1, 0))
    t, n = (sum(F.coalesce(F.col(f"c{f}{y}"), F.lit(0)) for f in folds) for y in (1, 0))
    x = F.log((t + 0.2) / (t_all + 0.4)) - F.log((n + 0.2) / (n_all + 0.4))
    usual = (t + n) * (t_all / max(1, t_all + n_all))
    z = (t - usual) / F.sqrt(F.greatest(F.lit(1e-9), usual))
    return F.when((t >= 2) & (x > 1.5) & (z > 3.5), F.least(x, F.lit(6.0)) * F.least(F.lit(1.0), t / 4))


def _chosen(known: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of known (_id, toxic), by a hash of the id; tasks hand on little more than that in all."""
    n = known.count()
    cut = min(1.0, (most + 6 * math.sqrt(most) + 100) / max(1, n))
    near = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < math.ceil(cut * (1 << 30)))
    return near.orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), "_id").limit(most)


class Trees:
    """Gradient-boosted trees for log loss over binned features, grown level by level."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        q = np.linspace(0, 1, self.bins)[1:-1]
        self.edges = [np.unique(np.quantile(col, q)) for col in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base, self.trees = math.log(p / (1 - p)), []
        f, (n, m), b = np.full(len(y), self.base), x.shape, self.bins
        least = max(2, min(self.least, n // 50))
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob) + 1e-6
            node, tree = np.zeros(n, np.int64), []
            for level in range(self.depth):
                k = 1 << level
                gain_best = np.zeros(k)
                feature, cut = np.full(k, -1), np.zeros(k, np.int64)
                for j in range(m):
                    at = node * b + binned[:, j]
                    gs = np.bincount(at, g, k * b).reshape(k, b).cumsum(1)
                    hs = np.bincount(at, h, k * b).reshape(k, b).cumsum(1)
                    ns = np.bincount(at, minlength=k * b).reshape(k, b).cumsum(1)
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(ns < least) | (nt - ns < least)] = 0
                    best = gain.argmax(1)
                    value = gain[np.arange(k), best]
                    better = value > gain_best + 1e-12
                    gain_best[better], feature[better], cut[better] = value[better], j, best[better]
                tree.append((feature, cut))
                go = feature[node]
                node = 2 * node + ((go >= 0) & (binned[np.arange(n), np.maximum(go, 0)] > cut[node]))
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, k) / (np.bincount(node, h, k) + self.l2)
            f += leaf[node]
            self.trees.append((tree, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                go = feature[node]
                node = 2 * node + ((go >= 0) & (binned[rows, np.maximum(go, 0)] > cut[node]))
            f += leaf[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y by x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([a, a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1][1] = last[1]
            blocks[-1][2] += last[2]
            blocks[-1][3] += last[3]
    return np.array([v for b in blocks for v in (b[0], b[1])]), np.array([v for b in blocks for v in [b[2] / b[3]] * 2])


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon, trees, knots):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.zeros(len(x))
        m = self.trees.margin(x)
        s = np.interp(m, *self.knots) if len(self.knots[0]) else 1 / (1 + np.exp(-m))
        return np.clip(0.999 * s + 0.001 / (1 + np.exp(-m)), 0, 1)


def fit(spark, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", held_out_mod: int = 3, held_out: int = 1, max_train: int = MAX_TRAIN) -> Model:
    """A model of labels.toxic, fitted on at most max_train labelled rows whose crc32(doc_id as text) mod held_out_mod is not held_out.

    Labels other than 0 and 1, null ids and ids without a row take no part. An id with several labels is toxic if one
    says so; of its texts one counts, that of the smallest hash. Without rows of both classes the model scores
    everything 0. The lexicon is limited by those rows alone.
    """
    ship(spark)
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull())
    known = known.where(F.crc32(F.col("_id").cast("string")) % held_out_mod != held_out).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = stored(_chosen(known, max_train), "toxicity-chosen")
    read = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "_id")  # max_train rows at most
    read = read.groupBy("_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = stored(read.select("text", "toxic", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-train")
    counted = rows.mapInArrow(_term_counts, "term string, fold int, toxic int, n long").groupBy("term").agg(
        *(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n"))).alias(f"c{f}{y}") for f in range(FOLDS) for y in (0, 1))
    )
    counted = stored(counted, "toxicity-terms")
    total = counted.where("term = ''").first()
    totals = total.asDict() if total else {}
    if not all(any(totals.get(f"c{f}{y}") for f in range(FOLDS)) for y in (0, 1)):
        discard(chosen, rows, counted)
        return Model({}, None, (np.zeros(0), np.zeros(0)))
    subsets = {"all": range(FOLDS)} | {f"not{f}": [g for g in range(FOLDS) if g != f] for f in range(FOLDS)}
    weighed = counted.where("term <> ''").select("term", *(lexicon_weight(totals, s).alias(k) for k, s in subsets.items()))
    weighed = weighed.where(F.coalesce(*subsets).isNotNull()).orderBy("term").collect()  # terms of the bounded sample that stand out
    lexicons = {k: {r["term"]: r[k] for r in weighed if r[k] is not None} for k in subsets}
    own = {f: lexicons[f"not{f}"] for f in range(FOLDS)}
    shipped = spark.sparkContext.broadcast(own)

    def run(batches):
        import pyarrow as pa

        trim_worker()
        lexicons = {f: Lexicon(x) for f, x in shipped.value.items()}
        for batch in batches:
            x, fold = [], batch.column("fold").to_pylist()
            for text, f in zip(batch.column("text").to_pylist(), fold):
                x.append(features(text, lexicons[f]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(fold, pa.int32()), batch.column("toxic").cast(pa.int32())], names=["x", "fold", "toxic"])

    got = rows.mapInArrow(run, "x array<double>, fold int, toxic int").toPandas()  # max_train rows of numbers
    shipped.unpersist()
    discard(chosen, rows, counted)
    x, y, fold = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(NAMES)), got["toxic"].to_numpy(np.float64), got["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    out = np.zeros(len(y))
    for f in range(FOLDS):
        a, b = fold != f, fold == f
        if b.any():
            out[b] = Trees().fit(x[a], y[a]).margin(x[b]) if a.any() else 0
    return Model(lexicons["all"], Trees().fit(x, y), isotonic(out, y))


def _scored(docs: DataFrame, model: Model, text: str, threshold: float) -> DataFrame:
    """docs, their text as _lq_text and empty where null, with _lq_score and _lq_predicted; one pass without a shuffle."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.withColumn("_lq_text", text_or_empty(text))

    def run(batches):
        import pyarrow as pa

        trim_worker()
        m = shipped.value
        lexicon = Lexicon(m.lexicon)
        for batch in batches:
            x = np.array([features(t, lexicon) for t in batch.column("_lq_text").to_pylist()], np.float64).reshape(len(batch), len(NAMES))
            s = m.score(x)
            keep = batch.drop_columns(["_lq_text"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep.schema.names, "_lq_score", "_lq_predicted"])

    schema = StructType([*docs.schema.fields, StructField("_lq_score", DoubleType()), StructField("_lq_predicted", IntegerType())])
    return read.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for each row of docs: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts are scored as texts without words. Repeated rows get equal scores; null ids stay. Further
    columns are ignored.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_lq_raw"))
    return _scored(read, model, "_lq_raw", threshold).select("doc_id", F.col("_lq_score").alias("score"), F.col("_lq_predicted").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that the model scores below threshold; each row is judged by its own text."""
    return _scored(docs, model, text, threshold).where("_lq_predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, by a model fitted on the labels that aren't held out."""
    scored = score(docs, fit(spark, docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
