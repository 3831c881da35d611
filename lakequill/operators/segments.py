"""A full-text index of immutable segments: what a change writes is in step with the change.

A segment holds the postings of the rows that one change added, dealt to folders by term, and each row's length, in folders by key. Rows that
go are named in a delete vector, which hides them in older segments only, so a row may come again under the same
key. Row and token counts are sums that changes add to and take from. Segments of like size are merged once FAN of them have
come together, so a row is rewritten a logarithm of times, and what is deleted leaves with the merge.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.runtime import ship, small_batches

TERM_BUCKETS, KEY_BUCKETS, FAN = 64, 16, 4
K1, B = 1.2, 0.75


def tokens(text):
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def query_terms(query: str) -> list[str]:
    """The distinct words of a query, in the order of their letters."""
    out, word = set(), ""
    for c in query.lower() + " ":
        if c.isalpha() or c.isnumeric():
            word += c
        elif word:
            out.add(word)
            word = ""
    return sorted(out)


def n_tokens(text):
    """How many tokens() a text has, without making them."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"))


def counted(words):
    """The distinct strings of an array with their counts, as structs (term, tf): runs of equal ones in the sorted array, from where each starts to where the next does. Lambdas bind what would otherwise be worked out anew for each element."""
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w, at: F.transform(at, lambda i, j: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(w)) - i).cast("long").alias("tf")))
    got = F.transform(F.array(F.sort_array(words)), lambda w: F.transform(F.array(starts(w)), lambda at: runs(w, at))[0])[0]
    return F.when(F.size(words) > 0, got)


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "body") -> DataFrame:
    """(key, term, tf, dl): the statistics that full-text search reads. Words are counted within their row, so nothing is shuffled; no two rows share a key."""
    words = chunks.select(key, tokens(F.col(text)).alias("w"))
    return words.select(key, F.size("w").alias("dl"), F.explode(counted(F.col("w"))).alias("x")).select(key, "x.term", "x.tf", "dl")


def _count(batches):
    """Batches (key, term, tf, dl) of batches (key, words): equal words of a row are found by sorting numbers, over a batch at once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        keys, words = batch.columns
        dl = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = words.flatten().dictionary_encode()
        n, own = max(1, len(coded.dictionary)), np.arange(len(dl))
        pairs, tf = np.unique(np.repeat(own, dl) * n + coded.indices.to_numpy(), return_counts=True)
        row = np.concatenate([pairs // n, own])
        term = pa.concat_arrays([coded.dictionary.take(pa.array(pairs % n)).cast(pa.string()), pa.nulls(len(own), pa.string())])
        tf = np.concatenate([tf, np.zeros(len(own), np.int64)])
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), term, pa.array(tf, pa.int64()), pa.array(dl[row])], [batch.schema.names[0], "term", "tf", "dl"])


def counts(rows: DataFrame, key: str = "chunk_id", text: str = "body") -> DataFrame:
    """The postings of rows, and for each row one without a term that has its length: one pass over the texts gives both."""
    ship(rows.sparkSession)
    small_batches(rows.sparkSession)
    words = rows.select(key, tokens(F.col(text)).alias("w"))
    return words.mapInArrow(_count, f"`{key}` {rows.schema[key].dataType.simpleString()}, term string, tf long, dl int")


def weight(tf, dl, df, n, avgdl):
    """What a term that stands tf times in a row of dl words gives to its score: BM25 with k1 = 1.2 and b = 0.75."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    f = tf.cast("double")
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def total(s):
    """The sum of weights, the same whatever their order: equal rows tie."""
    return F.sum(s.cast("decimal(28,15)")).cast("double")


def _bucket(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


class SegmentIndex:
    """The index under a folder of any file system that Spark reads. key, key_type: of the rows' keys, which no two rows share."""

    def __init__(self, spark: SparkSession, root: str, key: str = "chunk_id", key_type: str = "string"):
        self.spark, self.root, self.key, self.key_type = spark, root.rstrip("/"), key, key_type
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The newest published state: version, source, rows n, their words, the segments, and the versions that deleted rows."""
        p = self._path(self.root)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.getPath().getName().startswith("state-")) if self._fs.exists(p) else []
        if not names:
            return {"version": 0, "source": None, "n": 0, "words": 0, "segments": [], "deletes": []}
        stream = self._fs.open(self._path(f"{self.root}/{names[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        """A state appears whole: it is written under another name and renamed. Two writers of one version: the second fails."""
        draft, final = self._path(f"{self.root}/.draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/state-{state['version']:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {state['version']} was published by another writer")

    def _table(self, name: str, kind: str, buckets=None) -> DataFrame:
        """A written table of kind postings, lengths, or "" (what a change deleted), or some of its buckets; empty where nothing was."""
        if not kind:
            return self.spark.read.schema(f"`{self.key}` {self.key_type}, dl int").parquet(f"{self.root}/{name}")
        wanted = range(TERM_BUCKETS) if kind == "postings" else range(TERM_BUCKETS, TERM_BUCKETS + KEY_BUCKETS)
        wanted = {f"bucket={b}" for b in wanted if buckets is None or b in buckets}
        paths = sorted(s.getPath().toString() for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if s.getPath().getName() in wanted)
        columns = {self.key: self.key_type, "term": "string", "hash": "long", "tf": "long", "dl": "int"}
        if not paths:
            return self.spark.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in columns.items()))
        return self.spark.read.schema(", ".join(f"`{c}` {t}" for c, t in columns.items())).parquet(*paths)

    def _read(self, kind: str, segments: list[dict], buckets=None) -> DataFrame:
        """Rows of a kind of table of some segments, with seg, the version that made the segment."""
        got = None
        for s in segments:
            df = self._table(s["id"], kind, buckets).withColumn("seg", F.lit(s["version"]))
            got = df if got is None else got.unionByName(df)
        return got

    def _gone(self, state: dict) -> DataFrame | None:
        """(key, before): rows of segments older than before are deleted."""
        got = None
        for d in state["deletes"]:
            df = self._table(d["id"], "").select(self.key, F.lit(d["version"]).alias("before"))
            got = df if got is None else got.unionByName(df)
        return None if got is None else got.groupBy(self.key).agg(F.max("before").alias("before"))

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        gone = self._gone(state)
        if gone is None:
            return rows
        g = gone.withColumnRenamed(self.key, "_k")
        return rows.join(g, (F.col(self.key) == F.col("_k")) & (F.col("seg") < F.col("before")), "left_anti")

    def _write(self, name: str, rows: DataFrame) -> None:
        """Write what counts() gives. Rows of a bucket lie by the hash of their term, a number by which they are sorted without comparing them, and which a search skips pages by."""
        bucket = F.when(F.col("term").isNull(), TERM_BUCKETS + _bucket(self.key, KEY_BUCKETS)).otherwise(_bucket("term", TERM_BUCKETS))
        dealt = rows.select(self.key, "term", F.xxhash64("term").alias("hash"), "tf", "dl", bucket.alias("bucket"))
        dealt.repartition("bucket", _bucket(self.key, 4)).sortWithinPartitions("hash").write.partitionBy("bucket").parquet(f"{self.root}/{name}")

    def apply(self, added: DataFrame, removed: DataFrame | None = None, text: str = "body", source=None) -> dict:
        """Add rows (key, text) and delete those whose keys removed (key) holds, in one published step; the new state.

        Keys of added that the index holds are replaced. Only lengths of the touched keys' buckets are read besides what
        is added. source: what the caller takes the rows to be from now on, such as its table's version.
        """
        old = self.state()
        version, name = old["version"] + 1, f"segment-{old['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        self._write(name, counts(added, self.key, text))
        new = self._table(name, "lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        n, words, deletes = old["n"] + new["n"], old["words"] + new["words"], list(old["deletes"])
        if old["segments"]:
            keys = self._table(name, "lengths").select(self.key)
            keys = (keys if removed is None else keys.unionByName(removed.select(self.key))).distinct()
            touched = {TERM_BUCKETS + r[0] for r in keys.select(_bucket(self.key, KEY_BUCKETS)).distinct().collect()}
            held = self._live(self._read("lengths", old["segments"], touched), old).join(keys, self.key, "left_semi")
            vector = f"deletes-{version:012d}-{uuid.uuid4().hex[:8]}"
            held.select(self.key, "dl").write.parquet(f"{self.root}/{vector}")
            lost = self._table(vector, "").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
            if lost["n"]:
                n, words = n - lost["n"], words - lost["words"]
                deletes.append({"id": vector, "version": version})
            else:
                self._drop(vector)
        segments = [*old["segments"], *([{"id": name, "version": version, "n": new["n"], "words": new["words"]}] if new["n"] else [])]
        state = {"version": version, "source": source, "n": n, "words": words, "segments": segments, "deletes": deletes}
        self._publish(state)
        return self._merged(state)

    def rebuild(self, rows: DataFrame, text: str = "body", source=None) -> dict:
        """One segment of these rows in place of all; readers of the state before keep theirs until the next change."""
        old = self.state()
        name = f"segment-{old['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        self._write(name, counts(rows, self.key, text))
        new = self._table(name, "lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        segments = [{"id": name, "version": old["version"] + 1, "n": new["n"], "words": new["words"]}] if new["n"] else []
        state = {"version": old["version"] + 1, "source": source, "n": new["n"], "words": new["words"], "segments": segments, "deletes": []}
        self._publish(state)
        return state

    def _merged(self, state: dict) -> dict:
        """Merge segments of one size class while there are FAN of them; classes are powers of FAN in words. What merges leave behind goes with the merge after next."""
        while True:
            classes: dict[int, list[dict]] = {}
            for s in state["segments"]:
                classes.setdefault(int(math.log(max(1, s["words"]), FAN)), []).append(s)
            full = next((x for _, x in sorted(classes.items()) if len(x) >= FAN), None)
            if full is None:
                return state
            version = state["version"] + 1
            name = f"segment-{version:012d}-{uuid.uuid4().hex[:8]}"
            newest = max(s["version"] for s in full)  # deletes up to it have been applied, later ones still hide its rows
            self._write(name, self._live(self._read("postings", full).unionByName(self._read("lengths", full)), state))
            got = self._table(name, "lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
            rest = [s for s in state["segments"] if s not in full]
            segments = [*rest, *([{"id": name, "version": newest, "n": got["n"], "words": got["words"]}] if got["n"] else [])]
            # a vector is needed while there is an older segment that hasn't been merged since
            deletes = [d for d in state["deletes"] if any(s["version"] < d["version"] for s in rest)]
            before, state = state, state | {"version": version, "segments": segments, "deletes": deletes}
            self._publish(state)
            self._sweep(before)

    def _sweep(self, before: dict) -> None:
        """Delete what neither the state before nor the current one names, and older states."""
        now = self.state()
        held = {x["id"] for s in (before, now) for kind in ("segments", "deletes") for x in s[kind]}
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name.startswith(("segment-", "deletes-")) and name not in held:
                self._drop(name)
            elif name.startswith("state-") and int(name[6:18]) < before["version"]:
                self._drop(name)

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def search(self, query: str, limit: int) -> DataFrame:
        """(key, fts_raw) of the limit best rows, ties to the smaller key; the same as bm25 over the rows. Rows without a word count as rows."""
        terms, state = query_terms(query), self.state()
        if not terms or not state["n"]:
            return self.spark.createDataFrame([], f"`{self.key}` {self.key_type}, fts_raw double")
        asked = self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("term"))
        wanted = asked.select(_bucket("term", TERM_BUCKETS), F.xxhash64("term")).collect()  # a row for each term
        found = self._read("postings", state["segments"], {r[0] for r in wanted}).where(F.col("hash").isin([r[1] for r in wanted]) & F.col("term").isin(terms))
        own = self._live(found, state)
        held = own.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
        part = weight(F.col("tf"), F.col("dl"), F.col("df"), F.lit(state["n"]), F.lit(state["words"] / state["n"]))
        scored = own.join(F.broadcast(held), "term").select(self.key, part.alias("s"))
        return scored.groupBy(self.key).agg(total(F.col("s")).alias("fts_raw")).orderBy(F.desc("fts_raw"), self.key).limit(limit)
