"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where their encodings agree.

A huge text is encoded in chunks that overlap. In the overlap of two neighbours a splice point is a character
where both encodings have a token boundary, a run of tokens on either side is equal in both, and the text has a
place where the tokenizer must split whatever stands around it: a space, or a line feed, between two characters that
aren't white space. Where no such point is found the overlap is doubled, at last up to the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import ship, text_or_empty

#: Texts of more characters are cut into chunks of so many, overlapping by so many at first.
HUGE, CHUNK, OVERLAP, AGREE = 65_536, 32_768, 512, 4


class Counter:
    """Counts of one tokenizer file: .json by tokenizers, .model by sentencepiece."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.coder = None
        else:
            from lakequill.llm.coder import coder

            self.coder = coder(path)

    def count(self, text: str) -> int:
        if len(text) > HUGE and self.coder and self.coder.by_piece and not any(s in text for s in self.coder.special):
            return self.spliced(text)
        if self.coder is None:
            return len(self.pieces.encode(text, num_threads=1))
        return len(self.coder.encode(text)) // 4

    def offsets(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and where each begins, in characters."""
        got = self.coder.library.encode(text, add_special_tokens=False)
        return got.ids, [a for a, _ in got.offsets]

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of text by overlapping chunks; the same as encoding it at once."""
        ids, starts = self.offsets(text[:chunk])
        first, end, total = 0, chunk, 0  # the chunk in hand begins at first; total: tokens before its own that count
        skip = 0
        while end < len(text):
            wide = overlap
            while True:
                at = max(first, end - wide)
                if at == first and wide > end - first:  # no stable place in the whole chunk: encode it again, longer
                    end = min(len(text), end + wide)
                    ids, starts = self.offsets(text[first:end])
                    if end >= len(text):
                        return total + len(ids) - skip
                    wide = overlap
                    continue
                stop = min(len(text), at + chunk + wide)
                new_ids, new_starts = self.offsets(text[at:stop])
                place = self.splice(text, first, ids, starts, at, new_ids, new_starts, end)
                if place:
                    break
                wide *= 2
            i, j = place
            total += i - skip
            ids, starts, first, end, skip = new_ids, new_starts, at, stop, j
        return total + len(ids) - skip

    @staticmethod
    def splice(text, a0, ids, starts, b0, new_ids, new_starts, end):
        """Positions in both token lists of the first stable common boundary, or None."""
        where = {s + a0: i for i, s in reversed(list(enumerate(starts))) if s + a0 > b0}
        for j, s in enumerate(new_starts):
            p = s + b0
            if p >= end:
                return None
            i = where.get(p)
            if i is None or j < AGREE or i < AGREE or i + AGREE >= len(ids) or j + AGREE >= len(new_ids):
                continue
            if new_starts[j - 1] == s or starts[i - 1] == starts[i]:  # inside one character
                continue
            if not (text[p] in " \n" and 0 < p < len(text) - 1 and not text[p - 1].isspace() and not text[p + 1].isspace()):
                continue
            if ids[i - AGREE : i + AGREE] == new_ids[j - AGREE : j + AGREE] and starts[i + AGREE - 1] + a0 < end:
                return i, j
        return None


_COUNTERS: dict[str, Counter] = {}


def _run(path: str, limit: int):
    def run(batches):
        import pyarrow as pa

        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        count = _COUNTERS[path].count
        for batch in batches:
            texts = batch.column("_lq_text").to_pylist()
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_lq_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens (long), over_limit (n_tokens > limit).

    tokenizer: path of a .json (tokenizers) or .model (sentencepiece) file, readable on every executor. Null texts
    count as empty; null ids and repeated rows stay; further columns are ignored. One pass without a shuffle.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("_lq_id"), text_or_empty(text).alias("_lq_text")).mapInArrow(_run(tokenizer, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
