"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

The sets are the windows of the benchmark items: `window` consecutive words, or the whole of a shorter item.
Containment of a window asks for all of its words, so its necessary prefix is one word: the rarest, by how often
the documents' words and the items hold it. Document words join that prefix word alone; length and position
bounds drop windows that would begin before or end behind the document; what is left is compared word by word.
The join key is lower(word), a cheap function under which all words that are equal with A-Z lowered are equal too;
lowering A-Z alone is left to the comparison, which sees candidates only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import spread_join, stored

#: Prefix rows (one for each distinct window) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits, letters and everything above ASCII, with A-Z not yet lowered.
WORD = r"[0-9a-zA-Z\x{80}-\x{10FFFF}]+"


def words_of(text) -> F.Column:
    """Array of the words of a text column as they are written; null has none."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def lowered(words) -> F.Column:
    """An array of words as one string with A-Z, and nothing else, lowered: windows are compared by it."""
    return F.translate(F.concat_ws(" ", words), UPPER, LOWER)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(win, size, item_id): each window of each item, as one string, and its number of words."""
    words = items.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    cut = words.select("item_id", "w", F.explode(starts).alias("s")).select(F.slice("w", F.col("s"), window).alias("x"), "item_id")
    return cut.select(lowered(F.col("x")).alias("win"), F.size("x").alias("size"), "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit (long), n_items (long), items_sha256, contaminated.

    A document word is hit inside any occurrence of a window; contaminated is n_hit > 0 and share * n_hit >=
    n_words. Null and empty texts have no words and no hits; rows of one doc_id are judged apart when their texts
    differ, and equal rows get equal results. Null item ids still hit but are not listed. Without items nothing is
    hit. Further columns are ignored.
    """
    spark = docs.sparkSession
    words = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).select("doc_id", F.xxhash64("_t").alias("th"), words_of(F.col("_t")).alias("w"))
    its = items.select(F.col("item_id"), F.col("text"))
    owned = stored(_windows(its, window), "windows")
    # numbers of the distinct windows' own, not hashes, so that no two windows can be taken for one
    distinct = stored(owned.select("win", "size").distinct().withColumn("win_id", F.monotonically_increasing_id()), "distinct-windows")
    owners = owned.join(distinct.select("win", "win_id"), "win").select("win_id", F.col("item_id").cast("string").alias("item"))
    rarity = _rarity(words, owned)
    ranked = (
        distinct.select("win_id", "win", "size", F.posexplode(F.split("win", " ")).alias("at", "word"))
        .withColumn("word", F.lower("word"))
        .join(rarity, "word", "left")
        .groupBy("win_id")
        .agg(F.first("win").alias("win"), F.first("size").alias("size"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "at")).alias("key"))
        .select("win_id", "win", "size", F.col("key.word").alias("word"), F.col("key.at").alias("at"), F.col("key.df").alias("df"))
    )
    prefix = stored(ranked.where(F.col("word").isNotNull()), "prefix")
    small = prefix.count() <= BROADCAST_WINDOWS
    if small:
        tokens = words.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "word"))
        joined = tokens.withColumn("word", F.lower("word")).join(F.broadcast(prefix.drop("df")), "word")
    else:
        tokens = words.select("doc_id", "th", F.posexplode("w").alias("pos", "word"))
        lists = words.dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "w")
        joined = spread_join(tokens.withColumn("word", F.lower("word")), prefix.drop("df"), "word", prefix.select("word", F.col("df").alias("rows")).distinct())
        # null ids have a key of their own, and a text of many hits is dealt to several tasks
        key = lambda a, b: F.struct(F.coalesce(F.col(a).cast("string"), F.lit("")).alias("d"), F.col(a).isNull().alias("n"), F.col(b).alias("h"))
        joined = spread_join(joined.withColumn("_key", key("doc_id", "th")), lists.select(key("_d", "_h").alias("_key"), "w"), "_key").drop("_key")
    begin = F.col("pos") - F.col("at")
    hits = joined.where((begin >= 0) & (begin + F.col("size") <= F.size("w"))).where(lowered(F.slice("w", begin + 1, F.col("size"))) == F.col("win"))
    hits = stored(hits.select("doc_id", "th", begin.alias("s"), (begin + F.col("size")).alias("e"), "win_id").distinct(), "hits")
    run = Window.partitionBy("doc_id", "th").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("doc_id", "th", "s").agg(F.max("e").alias("e"))
    seen = F.coalesce(F.max("e").over(run), F.lit(0))
    n_hit = spans.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest("s", seen))).groupBy("doc_id", "th").agg(F.sum("new").alias("n_hit"))
    found = hits.select("doc_id", "th", "win_id").distinct().join(owners, "win_id")
    found = found.groupBy("doc_id", "th").agg(F.collect_set("item").alias("items"))
    judged = n_hit.join(found, n_hit.doc_id.eqNullSafe(found.doc_id) & (n_hit.th == found.th)).select(n_hit.doc_id.alias("_d"), n_hit.th.alias("_h"), "n_hit", "items")
    sized = words.select("doc_id", "th", F.size("w").cast("long").alias("n_words"))
    out = sized.join(judged, sized.doc_id.eqNullSafe(judged._d) & (sized.th == judged._h), "left")
    none = F.array().cast("array<string>")
    items_col = F.array_sort(F.coalesce("items", none))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_col).cast("binary"), 256).alias("items_sha256"), ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def _rarity(words: DataFrame, owned: DataFrame) -> DataFrame:
    """(word, df): how often the documents hold each word of the benchmark."""
    vocabulary = stored(owned.select(F.explode(F.split("win", " ")).alias("word")).select(F.lower("word").alias("word")).distinct(), "vocabulary")
    small = vocabulary.count() <= BROADCAST_WINDOWS
    return words.select(F.explode("w").alias("word")).withColumn("word", F.lower("word")).join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").agg(F.count("*").alias("df"))
