"""Markdown chunking: scored break points, fences, greedy cuts, headings, line numbers.

A file is one row and a greedy cut depends on the cut before it, so a file is cut in one Arrow-batched call without
a shuffle; the positions inside come from compiled patterns and numpy over the file's bytes.
"""

from __future__ import annotations

import html
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.operators.ordered import last_before
from lakequill.runtime import BATCH_BYTES, ship, small_batches
from lakequill.schema import CHUNK_BYTES, CHUNKED, DECAY, LOOK_BACK_BYTES, OVERLAP_BYTES

#: What may follow a line feed, in order of precedence: (pattern, kind, score; a heading's score falls with its level).
_FOLLOWS = re.compile(
    rb"\n(?:(?P<heading>#{1,6})(?= |\Z)|(?P<marks>#)|(?P<codeblock>```)|(?P<blank>\n)|(?P<hr>---|\*\*\*|___)(?=\n|\Z)|(?P<rule>---|\*\*\*|___)|(?P<list>[-*] )|(?P<numlist>[0-9]+\. ))?"
)
_SCORES = {"codeblock": 80.0, "blank": 20.0, "hr": 60.0, "list": 5.0, "numlist": 5.0}
_FENCE = re.compile(rb"\n```")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
#: Lines of markdown end at a line feed, a carriage return, or both; other separators are text.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
_LINK, _EMPHASIS, _MARKUP = re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), re.compile(r"(?<!\w)(__?)(?=\S)(.+?)(?<=\S)\1(?!\w)"), re.compile(r"[`*]|\s*\{[^}]*\}$")
_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)(?:^---[ \t]*$|^\.\.\.[ \t]*$)(?:\r?\n)?", re.S | re.M)


def break_points(data: bytes) -> list[tuple[int, float, str]]:
    """(byte position, score, kind) of every line feed, judged by what follows it."""
    out, at = [], 0
    while (m := _FOLLOWS.search(data, at)) is not None:
        kind = m.lastgroup
        if m.end() == len(data) and kind is None or kind in (None, "marks", "rule"):
            out.append((m.start(), 1.0, "newline"))
        elif kind == "heading":
            n = len(m["heading"])
            out.append((m.start(), 110.0 - 10 * n, f"h{n}"))
        else:
            out.append((m.start(), _SCORES[kind], kind))
        at = m.start() + 1
    return out


def fences(data: bytes) -> list[tuple[int, int]]:
    """Regions of code: line feeds before three backticks in pairs; the last runs to the end if it isn't closed. One at the very start doesn't count."""
    marks = [m.start() for m in _FENCE.finditer(data)]
    return [(a, marks[i + 1] + 4 if i + 1 < len(marks) else len(data)) for i, a in enumerate(marks) if i % 2 == 0]


def _on_char(data: bytes, at: int) -> int:
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def cuts(data: bytes, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES, window: int = LOOK_BACK_BYTES, decay: float = DECAY) -> list[tuple[int, int]]:
    """(start, end) bytes of overlapping chunks; each ends at the break point that scores best by closeness to its full size."""
    n = len(data)
    if n <= size:
        return [(0, n)]
    points = break_points(data)
    pos, score = np.array([p for p, _, _ in points], np.int64), np.array([s for _, s, _ in points])
    inside = np.zeros(len(pos), bool)
    for a, b in fences(data):
        inside |= (pos > a) & (pos < b)
    pos, score = pos[~inside], score[~inside]
    out, start = [], 0
    while True:
        full = _on_char(data, start + size)
        end = full
        if full < n:
            lo, hi = np.searchsorted(pos, [max(full - window, 0), full + 1])
            if lo < hi:
                far = (full - pos[lo:hi]) / window
                best = int(pos[lo + int(np.argmax(score[lo:hi] * (1.0 - far * far * decay)))])
                end = best if start < best else full
        out.append((start, end))
        if end >= n:
            return out
        back = _on_char(data, max(end - overlap, 0))
        start = back if back > start else end


def front_matter(text: str) -> tuple[dict | None, int]:
    """(fields, bytes that the block takes); fields None without a block. A block that doesn't parse, or whose typed keys have other types, counts as empty."""
    m = _FRONT.match(text)
    if not m:
        return None, 0
    empty = {"tags": [], "aliases": [], "title": None, "date": None}
    size = len(text[: m.end()].encode())
    rest = text[m.end() :]
    size += 1 if rest.startswith("\n") and not m[0].endswith("\n") else 0
    try:
        import yaml

        class Loader(yaml.SafeLoader):
            pass

        Loader.yaml_implicit_resolvers = {k: [x for x in v if x[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
        got = yaml.load(m[1], Loader)
    except Exception:
        return empty, size
    if got is None:
        return empty, size
    strings = lambda x: isinstance(x, list) and all(isinstance(y, str) for y in x)
    fine = isinstance(got, dict) and all(isinstance(k, str) for k in got) and all(strings(got.get(k, [])) for k in ("tags", "aliases")) and all(got.get(k) is None or isinstance(got[k], str) for k in ("title", "date"))
    if not fine:
        return empty, size
    return {k: got.get(k, empty[k]) for k in empty} | {k: got[k] for k in sorted(got) if k not in empty}, size


def front_json(fields: dict | None) -> str:
    return json.dumps(fields or {"tags": [], "aliases": [], "title": None, "date": None}, ensure_ascii=False, separators=(",", ":"), default=str)


def heading_text(title: str) -> str:
    """The text of a heading: links as their labels, without marks of emphasis and code, entities as characters."""
    title = _LINK.sub(r"\1", title)
    return html.unescape(_MARKUP.sub("", _EMPHASIS.sub(r"\2", title))).strip()


def headings(text: str, skip: int = 0) -> list[tuple[int, str, int]]:
    """(byte offset, breadcrumb, level) of each ATX or underlined heading behind the first skip bytes, outside fenced code."""
    out, stack, at, fence, before = [], [], skip, None, None
    for line in _LINE.findall(text.encode()[skip:].decode(errors="replace")):
        bare = line.rstrip("\r\n")
        mark = re.match(r" {0,3}(`{3,}|~{3,})", bare)
        found = None
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not bare.strip(" \t" + fence[0]):
                fence = None
            before = None
        elif mark:
            fence, before = mark[1], None
        elif m := _ATX.match(bare):
            found, before = (at, len(m[1]), m[2] or ""), None
        elif before and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", bare):
            found, before = (before[0], 1 if bare.strip()[0] == "=" else 2, before[1]), None
        else:
            plain = bare.strip() and not re.match(r" {0,3}([-*+>]|\d+[.)])( |$)", bare)
            before = (before[0], f"{before[1]} {bare.strip()}") if plain and before else (at, bare.strip()) if plain else None
        if found:
            offset, level, title = found
            stack = [x for x in stack if x[0] < level] + [(level, heading_text(title))]
            out.append((offset, " > ".join("#" * n + " " + t for n, t in stack), level))
        at += len(line.encode())
    return out


def chunk_file(text: str) -> list[tuple]:
    """Rows of CHUNKED without the path: the chunks of a file that aren't blank."""
    fields, skip = front_matter(text)
    data = text.encode()
    titles = headings(text, skip)
    starts = np.array([t[0] for t in titles], np.int64)
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    out = []
    for a, b in cuts(data[skip:]):
        a, b = a + skip, b + skip
        body = data[a:b].decode()
        if not body.strip():
            continue
        k = int(np.searchsorted(starts, a, side="right")) - 1
        _, crumb, level = titles[k] if k >= 0 else (0, "", 0)
        line = [1 + int(np.searchsorted(feeds, x)) for x in (a, max(b - 1, 0))]
        out.append((crumb, level, body, line[0], line[1], front_json(fields), a, b))
    return out


def chunk_files(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """Chunks of every file, in the columns of CHUNKED. Null texts have none; a file whose text isn't valid is the reader's to reject."""
    return _per_file(files.select(F.col(path).alias("file_path"), F.col(text).alias("text")), chunk_file, CHUNKED.removeprefix("file_path string, "))


def in_batches(batches, of, schema, most: int = BATCH_BYTES):
    """Record batches (file_path, *) of schema for the batches (file_path, text): the rows that of(text) gives for each text that isn't null.

    One text is taken from its batch at a time, and rows go on once their strings have `most` characters.
    """
    import pyarrow as pa

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    rows, held = [], 0
    for batch in batches:
        for p, t in zip(batch.column("file_path"), batch.column("text")):
            for r in of(t.as_py()) if t.is_valid else ():
                rows.append((p.as_py(), *r))
                held += 100 + sum(len(x) for x in r if isinstance(x, str))
                if held >= most:
                    yield made(rows)
                    rows, held = [], 0
    if rows:
        yield made(rows)


def _per_file(files: DataFrame, of, schema: str) -> DataFrame:
    """Rows (file_path, *) that of(text) lists for each file (file_path, text)."""
    import pyarrow as pa

    ship(files.sparkSession)
    small_batches(files.sparkSession)
    fields = [c.split() for c in f"file_path string, {schema}".split(", ")]
    kinds = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]) for name, kind in fields])
    return files.select(F.col("file_path").cast("string"), F.col("text").cast("string")).mapInArrow(lambda batches: in_batches(batches, of, kinds), f"file_path string, {schema}")


def fences_of(files: DataFrame) -> DataFrame:
    """(file_path, fence_start, fence_end) of every region of code."""
    return _per_file(files, lambda t: fences(t.encode()), "fence_start long, fence_end long")


def headings_of(files: DataFrame) -> DataFrame:
    """(file_path, pos, heading_breadcrumb, heading_level) of every heading behind the front matter."""
    return _per_file(files, lambda t: headings(t, front_matter(t)[1]), "pos long, heading_breadcrumb string, heading_level int")


def active_headings(chunks: DataFrame, titles: DataFrame, parts: int | None = None) -> DataFrame:
    """chunks (file_path, byte_start, ...) with heading_breadcrumb and heading_level, '' and 0 without one: the last of titles (file_path, pos, heading_breadcrumb, heading_level) at or before each start.

    An as-of join: chunks and headings are put in one order by file and place, cut into ranges, and each range takes over
    the last heading of those before it. So a file of any size is dealt to as many tasks as it needs.
    """
    own = [c for c in chunks.columns if c not in ("heading_breadcrumb", "heading_level")]
    row, title = F.struct(*own), F.struct("heading_breadcrumb", F.col("heading_level").cast("int").alias("heading_level"))
    a = chunks.select("file_path", F.col("byte_start").cast("long").alias("at_"), F.lit(1).alias("sub"), row.alias("row"))
    b = titles.select("file_path", F.col("pos").cast("long").alias("at_"), F.lit(0).alias("sub"), title.alias("title"))
    both = a.unionByName(b, allowMissingColumns=True)
    got = last_before(both, ["at_", "sub"], ["file_path"], "title", "last", parts).where("sub = 1")
    return got.select("row.*", F.coalesce("last.heading_breadcrumb", F.lit("")).alias("heading_breadcrumb"), F.coalesce("last.heading_level", F.lit(0)).alias("heading_level"))


def points_of(files: DataFrame) -> DataFrame:
    """(file_path, pos, score, kind) of every break point, in Spark functions: lines and a running sum of their bytes."""
    lines = files.select("file_path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("file_path").orderBy("n")
    ends = F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("line").over(w)
    at = lines.withColumn("pos", ends - 1).withColumn("last", after.isNull()).where("n > 0")
    h = F.regexp_extract("line", r"^(#{1,6})( |$)", 1)
    whole = ~F.col("last")
    kind = (
        F.when((F.length("line") == 0) & F.col("last"), "newline")
        .when((F.length(h) > 0) & (F.col("line").rlike("^#{1,6} ") | F.col("last")), F.concat(F.lit("h"), F.length(h)))
        .when(F.col("line").startswith("#"), "newline")
        .when(F.col("line").startswith("```"), "codeblock")
        .when((F.length("line") == 0) & whole, "blank")
        .when(F.col("line").isin("---", "***", "___"), "hr")
        .when(F.col("line").rlike(r"^(---|\*\*\*|___)"), "newline")
        .when(F.col("line").rlike("^[-*] "), "list")
        .when(F.col("line").rlike(r"^[0-9]+\. "), "numlist")
        .otherwise("newline")
    )
    score = F.when(F.col("kind").rlike("^h[1-6]$"), 110.0 - 10 * F.substring("kind", 2, 1).cast("double")).when(F.col("kind") == "codeblock", 80.0).when(F.col("kind") == "blank", 20.0).when(F.col("kind") == "hr", 60.0).when(F.col("kind").isin("list", "numlist"), 5.0).otherwise(1.0)
    return at.withColumn("kind", kind).withColumn("score", score).select("file_path", F.col("pos").cast("long").alias("pos"), "score", "kind")


def with_hash(chunks: DataFrame) -> DataFrame:
    """chunks and their content_hash: body, breadcrumb and frontmatter in a row, lines and path left out."""
    fm = F.coalesce("frontmatter_json", F.lit(""))
    return chunks.withColumn("content_hash", F.sha2(F.concat("body", "heading_breadcrumb", fm), 256))


def with_id(chunks: DataFrame) -> DataFrame:
    """chunks and a chunk_id that a repeated task gives again."""
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("\u0000", "file_path", F.col("line_start").cast("string"), F.col("line_end").cast("string"), "content_hash"), 256))
