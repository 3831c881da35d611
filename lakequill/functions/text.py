"""Scalar functions of the engine as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import functions as F


def _cut_bytes(text, n: int, up: bool):
    """The longest prefix of n bytes that ends between characters, or the shortest of at least n: at most three continuation bytes are stepped over."""
    data = F.encode(text, "UTF-8")
    steps = [n + k if up else n - k for k in range(4)]
    inside = lambda k: F.hex(F.substring(data, k + 1, 1)).between("80", "BF")
    k = F.when(~inside(steps[0]), steps[0]).when(~inside(steps[1]), steps[1]).when(~inside(steps[2]), steps[2]).otherwise(steps[3])
    return F.decode(F.substring(data, F.lit(1), k), "UTF-8")


def excerpt(text, n: int = 800, mark: str = "…"):
    """The first n bytes, rounded down to a character, and a mark where something was cut."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(_cut_bytes(text, n, False), F.lit(mark)))


def preview(text, n: int = 300, mark: str = "..."):
    """The first n bytes, rounded up to a character, and a mark where something was cut."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(_cut_bytes(text, n, True), F.lit(mark)))


def escape_html(text):
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def highlight(text, query: str):
    """text escaped for HTML with whole-word matches of the query's terms in <mark>, in any case. Marks are set before escaping, by control characters that the text is freed of."""
    terms = [t for t in re.split(r"[ \t\n\f\r]+", query) if t]
    if not terms:
        return escape_html(text)
    quoted = "|".join(r"\b(?:" + "".join(c if c.isalnum() or c == "_" else "\\" + c for c in t) + r")\b" for t in terms)
    clean = F.translate(text, "\x01\x02", "")
    marked = F.regexp_replace(clean, f"(?iu)(?:{quoted})", "\x01$0\x02")
    return F.replace(F.replace(escape_html(marked), F.lit("\x01"), F.lit("<mark>")), F.lit("\x02"), F.lit("</mark>"))


def json_or_empty(col):
    """The JSON text where it parses, else {}."""
    return F.when(F.is_variant_null(F.try_parse_json(col)) | F.try_parse_json(col).isNotNull(), col).otherwise(F.lit("{}"))


def sql_quote(col):
    return F.replace(col, F.lit("'"), F.lit("''"))


def image_blockquote(name, description):
    """A quoted image description: the name before its first line, a quote mark before each."""
    return F.concat(F.lit("> **[Image: "), name, F.lit("]** "), F.replace(description, F.lit("\n"), F.lit("\n> ")))


def media_type(path):
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "webp", "image/webp").when(ext == "pdf", "application/pdf").otherwise("application/octet-stream")


def cache_path(sha):
    """Where an asset's synthetic text is kept, by the hash of its bytes."""
    spread = F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2))
    return F.concat(F.lit("asset-cache/"), F.when(F.length(sha) >= 4, spread).otherwise("_/_"), F.lit("/"), sha, F.lit(".txt"))


def printable_count(text):
    """Characters that aren't control characters, or are line feed, carriage return or tab."""
    return F.length(F.regexp_replace(text, r"[\p{Cc}&&[^\n\r\t]]", ""))


def pdf_class(pages):
    """text_first where the pages' printable characters are 12 for each page at least, else needs_vision."""
    total = F.aggregate(pages, F.lit(0), lambda a, x: a + printable_count(x))
    return F.when(total >= 12 * F.greatest(F.size(pages), F.lit(1)), "text_first").otherwise("needs_vision")


def rerank_indices(answer):
    """The indices array of a reranker's answer: the whole text as JSON, else what stands from its first { to its last }."""
    inner = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    read = lambda x: F.from_json(x, "indices array<int>").getField("indices")
    return F.coalesce(read(answer), read(inner))


def round2(col):
    return F.round(col, 2)


def json_value(json, path: str, kind: str, default=None):
    """The value at a path of a JSON column as a type, by VARIANT: default where the text isn't JSON, the path is missing, or its value can't be that type."""
    got = F.try_variant_get(F.try_parse_json(json), path, kind)
    return got if default is None else F.coalesce(got, F.lit(default).cast(kind))


def json_schema(df, json: str) -> str:
    """The type that the valid JSON texts of a column have together, as schema_of_variant writes it; one aggregate."""
    return df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(json)))).first()[0]
