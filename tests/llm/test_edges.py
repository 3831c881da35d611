"""Edges of operators that other tests leave out: nulls, repeats, empty tables, huge texts, other templates and tokenizers."""

import random
import zlib


from lakequill.llm import chat, packing, token_counts, toxicity
from lakequill.llm.queries import tokenizer_path


def test_a_huge_text_is_spliced_and_overlaps_widen(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    r = random.Random(2)
    prose = " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 12))) for _ in range(16_000))
    solid = "x9" * 20_000  # no place where the tokenizer must split: overlaps widen up to the whole of it
    text = prose[:60_000] + " " + solid + " " + prose[60_000:]
    widths, splice = [], token_counts.Counter.splice
    monkeypatch.setattr(token_counts.Counter, "splice", staticmethod(lambda *a: widths.append(a[7] - a[4]) or splice(*a)))
    counter = token_counts.Counter(path)
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert max(widths) > 8 * token_counts.OVERLAP and min(widths) <= token_counts.OVERLAP  # it widened, and began again
    for chunk, overlap in ((700, 16), (5000, 64)):
        assert counter.spliced(prose[:20_000], chunk, overlap) == len(library.encode(prose[:20_000], add_special_tokens=False).ids)


def test_token_counts_of_models_and_edges(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(None, "one two"), (1, None), (1, ""), (2, "é <s> </s> 東京\n" * 400), (2, "é <s> </s> 東京\n" * 400), (3, "a" * 70_000)]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, path).collect())
    assert got == sorted((i or 0, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 512) for i, t in rows)
    assert token_counts.token_counts(df.where("false"), path).count() == 0


def test_packing_of_null_ids_repeats_and_large_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    monkeypatch.setattr(packing, "SALTS", 2)
    rows = [(None, "same words here")] * 40 + [(7, "same words here")] * 40 + [(i, None) for i in range(5)] + [(9, "word " * 3000), (9, "")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, piece int").repartition(3)
    got = packing.pack(df, tokenizer_path()).collect()
    assert len(got) == 40 + 40 + 5 + 1 + sum(1 for r in got if r.doc_id == 9 and r.length > 1)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 1024) + 1
    assert packing.pack(df.where("false"), tokenizer_path()).count() == 0


def test_toxicity_of_repeated_rows_and_null_ids(spark):
    r = random.Random(1)
    clean, rude = ["garden", "river", "stone", "lamp"], ["idiot", "moron", "stupid"]
    rows = [(i, " ".join([*(r.choice(clean) for _ in range(r.randint(0, 12))), *(["you", r.choice(rude)] if i % 3 == 0 else ["the", r.choice(clean)])])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows += [(None, "you idiot"), (None, "you idiot"), (None, None), (3, rows[3][1]), (3, "garden lamp")]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, score double")
    got = toxicity.toxicity(spark, docs.select("doc_id", "text"), labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    nulls = [x for x in got if x.doc_id is None]
    assert len(nulls) == 3 and not any(x.held_out for x in nulls) and len({x.score for x in nulls}) == 2
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got if x.doc_id is not None)
    assert len({x.score for x in got if x.doc_id == 3}) == 2
    assert toxicity.toxicity(spark, docs.select("doc_id", "text").where("false"), labels).count() == 0


def test_chat_of_another_template_and_very_long_texts(spark):
    template = chat.Template(open="[", after_role="|", close="]", loss_roles=("user", "tool"), final_roles=("tool",), transitions=(("start", ("user",)), ("user", ("tool",)), ("tool", ("user",))))
    long = "é<|im_end|>\\" * 20_000
    rows = [(1, 0, "user", "a"), (1, 1, "tool", long), (2, 0, "tool", "first"), (3, 0, "user", None), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*x, "s") for x in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {x.conv_id: x for x in chat.format_conversations(df, template).collect()}
    assert got[1].order_ok and got[1].formatted.startswith("[user|a][tool|") and not got[2].order_ok and got[2].first_bad_turn == 0
    loss = ["".join(s.text for s in got[c].segments if s.loss) for c in (1, 2, 3)]
    assert loss[0] == "a" + long.replace("\\", "\\\\").replace("<|", "<\\|") and loss[1:] == ["first", ""]
    back = {x.conv_id: x for x in chat.digests(chat.format_conversations(df)).collect()}
    assert back[1].n_turns == 2 and back[None].n_turns == 1
    assert chat.format_conversations(df.where("false"), template).count() == 0


