"""A training corpus from documents: toxicity, near duplicates, benchmark passages, secrets, packing.

Rows are judged each by its own key, so repeated, shared and null ids are like any others. Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents. ORACLE_SQL is None: scores of a fitted model and best-fit packing aren't SQL; the tests hold
the rows that each stage keeps, the redacted texts and the packed pieces against answers found without it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.llm import decontam, ngram_join, packing, secrets, toxicity
from lakequill.llm.common import discard, stored, table
from lakequill.llm.queries import tokenizer_path

ORACLE_SQL = None


def _keyed(docs):
    """docs with a key of doc_id and text in _lq_row, never null: rows that share it have one text, so one verdict."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("_lq_row", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), text), 256))


def _without(rows, rejected):
    """rows without those whose keys are in rejected (doc_id, by which the operators call a key)."""
    bad = rejected.select(F.col("doc_id").alias("_lq_row")).distinct()
    return rows.join(bad, "_lq_row", "left_anti").drop("_lq_row")


def drop_toxic(spark, docs, sf_dir):
    """Rows that the model predicts as toxic go; fitted on the labels of sf_dir that aren't held out."""
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group that near-duplicate links hold together one row stays: that of the smallest doc_id, null being the largest."""
    # stored, so that the keys stay what they are; unlike those of other stages they differ for equal rows
    rows = stored(docs.withColumn("_lq_row", F.monotonically_increasing_id()), "near-duplicates-rows")
    groups = ngram_join.jaccard_components(rows, doc_id="_lq_row")
    ids = rows.select("_lq_row", F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"))
    first = groups.select(F.col("doc_id").alias("_lq_row"), "component_id").join(ids, "_lq_row").groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "h", "_lq_row")).alias("first"))
    kept = stored(first.select("first._lq_row"), "kept")
    discard(groups)
    return rows.join(kept, "_lq_row", "left_semi").select(*docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """Rows that hold benchmark passages by the contamination rule go."""
    rows = _keyed(docs)
    judged = decontam.contamination(rows, table(spark, sf_dir, "benchmark").select("item_id", "text"), doc_id="_lq_row")
    return _without(rows, stored(judged.where("contaminated").select("doc_id"), "contaminated"))


def redact_secrets(spark, docs, sf_dir):
    """Every finding is replaced by its kind in brackets; the document stays."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of the kept documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path()).drop("ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack_sequences)]


def run(spark, sf_dir):
    """The last stage's rows for the documents of sf_dir. A stage's table goes once the next one is stored; the last stage reads the one before it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
