"""Chat formatting from a declarative template, in DataFrame functions only.

A template names the marks around a turn, the transitions of a finite-state machine over roles, and the roles whose
text carries loss. The operator validates turn order, emits text segments with a loss flag each, and reads
formatted conversations back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + after_role + text + close for each turn. transitions: state to the roles that may follow; a state is the last role, or start."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    final_roles: tuple[str, ...] = ("assistant",)
    transitions: tuple[tuple[str, tuple[str, ...]], ...] = (("start", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))


def escape(text):
    """Control strings begin with <|; they are broken by a backslash, and backslashes are doubled, so it can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text):
    return _undone(text, lambda x: F.replace(x, F.lit("<\\|"), F.lit("<|")))


def _undone(text, one):
    """Escapes undone from left to right: one() of what stands between doubled backslashes, which become single ones."""
    return F.array_join(F.transform(F.split(text, r"\\\\"), one), "\\")


def _role(text):
    """A role on one line: line feeds become backslash-n."""
    return F.replace(escape(text), F.lit("\n"), F.lit("\\n"))


def _unrole(text):
    """A role read back."""
    return _undone(text, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")))


def format_conversations(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, order_ok, first_bad_turn (place from 0, or null), segments (array of text, loss), formatted.

    turns: conv_id, turn, role, text; further columns are ignored. Turns go by turn, then role, then text, null turns
    first; null roles and texts are empty; repeated rows are turns of their own. Rows whose conv_id is null form
    one conversation. Turn order is validated, not repaired: a bad conversation is formatted and flagged.
    """
    t = template
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    whole = turns.select(F.col(conv_id).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("turns"))
    allowed = F.array(*(F.concat(F.lit(a), F.lit("\x00"), F.lit(b)) for a, bs in t.transitions for b in bs))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(s, x):
        good = F.array_contains(allowed, F.concat(s["state"], F.lit("\x00"), x["role"]))
        return F.struct(x["role"].alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["bad"], F.when(~good, s["at"])).cast("int").alias("bad"))

    machine = F.aggregate("turns", start, step)
    loss = lambda role: role.isin(*t.loss_roles)

    def parts(x):
        return F.array(
            F.struct(F.concat(F.lit(t.open), _role(x["role"]), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), loss(x["role"]).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    out = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), machine.alias("m"), F.flatten(F.transform("turns", parts)).alias("segments"))
    final = F.col("m.state").isin(*t.final_roles)
    return out.select(
        "conv_id", "n_turns", (F.col("m.bad").isNull() & final).alias("order_ok"), F.col("m.bad").alias("first_bad_turn"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def _by_turn(a, b):
    def first(x, y, rest):
        return F.when(x.eqNullSafe(y), rest).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)

    return first(a["turn"], b["turn"], first(a["role"], b["role"], first(a["text"], b["text"], F.lit(0))))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (array of role, text) parsed from the formatted text, and loss_texts (array) from the segments under the loss mask."""
    t = template
    pieces = F.filter(F.split("formatted", _quoted(t.open)), lambda x, i: i > 0)

    def turn(x):
        cut = F.locate(t.after_role, x)
        return F.struct(_unrole(F.substring(x, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(x, cut + len(t.after_role), F.char_length(x) - cut - len(t.after_role) + 1 - len(t.close))).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), masked.alias("loss_texts"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in s)


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what reading the output back gives."""
    back = read_back(formatted, template)
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
