"""Spelling variants: words at edit distance one, by a trie self-join with active-node sets over a partitioned vocabulary.

Words are dealt by what surrounds their undecided part. Of two words at distance one, the shorter of m characters, either
the first half of m is equal at their fronts or the other half at their ends, so a word joins groups (m, front) and
(m, end) for its own length and the one below. A group that is still large is halved again in the same way, until
a single character is undecided, and then no group has more words than there are letters. So every pair meets, and groups
stay small whatever words share.

Inside a group the undecided parts are a trie. The set of trie nodes within distance one of a prefix is carried
from each node to its children; where a word ends, the active nodes that end words at distance one are its partners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import discard, ship, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters, and how few characters a word has at least.
LETTERS, MIN_LENGTH, MIN_COUNT, RATIO, EVERY = r"[A-Za-z\x{C0}-\x{FF}]", 7, 2, 10, 31
#: Words of a group that are joined in one trie; larger groups are halved.
GROUP = 256


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int | None = EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the runs of letters in whole texts, with A-Z lowered.

    Where every divides h, the crc32 of doc_id, a colon and the run, one of its characters, h modulo its length, is
    taken out first; every None: no run is changed. Words of under min_length characters or met under min_count
    times are left out. Null and empty texts have no words; a null doc_id counts as an empty string.
    """
    low = min_length
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"{LETTERS}{{{low},}}"), F.lit(0))).alias("w"))
    runs = runs.select("d", F.translate("w", UPPER, LOWER).alias("w"))
    if every is not None:
        h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
        at = (F.pmod(F.col("h"), F.char_length("w").cast("long")) + 1).cast("int")
        cut = F.concat(F.expr("substring(w, 1, at - 1)"), F.expr("substring(w, at + 1)"))
        runs = runs.withColumn("h", h).withColumn("at", at).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("w")).alias("w"))
    return runs.where(F.char_length("w") >= low).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halves(words: DataFrame) -> DataFrame:
    """words (word, m, lo, hi) with the undecided part of m-character keys halved: the first half decided at the front, or the second at the end."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    return words.withColumn("mid", mid).select("word", "m", F.inline(F.array(F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi")))))


def _keyed(words: DataFrame) -> DataFrame:
    """words with their group's key and the undecided part: what stands before lo, and the last m - hi characters, are decided."""
    key = F.concat_ws("\x00", F.col("m").cast("string"), F.col("lo").cast("string"), F.col("hi").cast("string"), F.expr("substring(word, 1, lo)"), F.expr("if(m = hi, '', substring(word, hi - m))"))
    return words.withColumn("key", key).withColumn("part", F.expr("substring(word, lo + 1, char_length(word) - lo - (m - hi))"))


def groups(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """(key, word, part): groups of two words at least that hold every pair at distance one; stored.

    words: (word), distinct. The groups hold limit words at most, or one undecided character and thus a word or two for
    each letter of the vocabulary.
    """
    short = words.select("word", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("m")).where("m > 0")
    todo = _keyed(_halves(short.select("word", "m", F.lit(0).alias("lo"), F.col("m").alias("hi"))))
    done, used = None, []
    while True:
        todo = stored(todo, "groups")
        sizes = todo.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
        counted = todo.join(sizes, "key")
        final = counted.where((F.col("rows") <= limit) | (F.col("hi") - F.col("lo") <= 1)).select("key", "word", "part")
        done = final if done is None else done.unionAll(final)
        used.append(todo)
        large = counted.where((F.col("rows") > limit) & (F.col("hi") - F.col("lo") > 1)).select("word", "m", "lo", "hi")
        if not large.limit(1).count():
            break
        todo = _keyed(_halves(large))
    out = stored(done, "grouped")
    discard(*used)
    return out


class _Node:
    __slots__ = ("below", "word")

    def __init__(self):
        self.below, self.word = {}, None


def trie_pairs(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(a, b) of the words of a group whose parts, given as (part, word), are at edit distance one; each pair once.

    An active node is at the distance held for it from the prefix that has been read: 0 or 1. From a node's set and a
    character, its child's is: active nodes at distance 0 with the character dropped, their children by it at no cost and
    by others at one, and then what lies one step below a node at distance 0.
    """
    root = _Node()
    for part, word in parts:
        node = root
        for c in part:
            node = node.below.setdefault(c, _Node())
        node.word = word
    out = []

    def closed(active: dict) -> dict:
        for node, d in list(active.items()):
            if d == 0:
                for child in node.below.values():
                    active.setdefault(child, 1)
        return active

    stack = [(root, closed({root: 0}))]
    while stack:
        node, active = stack.pop()
        if node.word is not None:
            out += [(node.word, other.word) for other, d in active.items() if d == 1 and other.word is not None and node.word < other.word]
        for c, child in node.below.items():
            nxt: dict = {}
            for other, d in active.items():
                match = other.below.get(c)
                if match is not None and nxt.get(match, 2) > d:
                    nxt[match] = d
                if d == 0:
                    nxt.setdefault(other, 1)
                    for x in other.below.values():
                        if x is not match:
                            nxt.setdefault(x, 1)
            stack.append((child, closed(nxt)))
    return out


def _pairs(batches):
    """Pairs of the groups of a partition, whose rows come by key: one group is held at a time."""
    import pyarrow as pa

    now, own, found = None, [], []

    def out():
        a, b = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    for batch in batches:
        for key, word, part in zip(*(batch.column(n).to_pylist() for n in ("key", "word", "part"))):
            if key != now:
                found += trie_pairs(own) if len(own) > 1 else []
                now, own = key, []
            own.append((part, word))
        if found:
            yield out()
            found = []
    found = trie_pairs(own) if len(own) > 1 else []
    if found:
        yield out()


def near_words(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """(a, b), a < b, of every two words that differ by one inserted, deleted or replaced character. words: (word), distinct."""
    ship(words.sparkSession)
    dealt = groups(words, limit).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_pairs, "a string, b string").distinct()  # a pair may meet in several groups


def variants(counted: DataFrame, ratio: int = RATIO, limit: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of counted (word, n), whose words are distinct.

    n_near: how many words are at distance one. form: the one of them that is met most often, the smallest of equals,
    if that is at least ratio times as often as the word; else null. root: where the forms lead to, the word
    itself without one; forms get ratio times more frequent at each step, so there are few. An empty table stays empty.
    """
    words = stored(counted.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(words.select("word"), limit)
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sized = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = sized.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("o"), F.col("b").alias("form"))).alias("x"))
    joined = words.join(best, "word", "left").withColumn("m", -F.col("x.o"))
    good = F.col("m") >= ratio * F.col("n")
    out = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("x.form")).alias("form"), F.when(good, F.col("m")).alias("form_n")), "forms")
    # each round doubles the steps that a word has gone
    step = stored(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(step)
        step = new.select("word", "root")
        step._lq_path = new._lq_path
        if not new.where("moved").limit(1).count():
            break
    return out.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """variants() of vocabulary(): further columns of docs are ignored, repeated rows count each, an empty table gives no words."""
    return variants(vocabulary(docs, doc_id, text))
