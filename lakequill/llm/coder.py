"""Fast exact encoding with a byte-level BPE of the tokenizers library.

The library splits a text into pieces and merges within each piece, so a text's ids are its pieces' ids in order.
A space between two characters that aren't white space always begins a piece, whatever stands around it. Texts
are cut there, and the ids of cuts are kept in bounded memos, so that frequent ones are encoded seldom.
Tokenizers of another build, and texts that hold a special token, are encoded whole by the library.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: How a byte-level pre-tokenizer splits, used below U+0250 only, where no Unicode version disagrees on classes.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)}


_LETTERS = _byte_letters()
_STOPS = tuple(".,!?;:")
#: Entries of the two memos of a worker: words as they follow a space, and other pieces. Each has a young and an old half: what
#: is met again moves to the young one, and once that is full the old half goes and the young one takes its place.
WORDS, PIECES = 400_000, 50_000
_CODERS: dict[str, "Coder"] = {}


def coder(path: str, room: int = 1) -> "Coder":
    """This process's coder for a tokenizer file. Its memos hold room times the usual entries, by the largest room asked for."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    _CODERS[path].room = max(_CODERS[path].room, room)
    return _CODERS[path]


def forget() -> None:
    """Empty the memos of this process's coders; the tokenizers stay."""
    for c in _CODERS.values():
        c.words, c.pieces = Memo(), Memo()


class Memo:
    """Ids by text, in a young and an old half."""

    __slots__ = ("young", "old")

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def again(self, key: str, most: int) -> bytes | None:
        """The old half's ids of a key that isn't in the young half; they move there."""
        ids = self.old.get(key)
        if ids is not None:
            self.put(key, ids, most)
        return ids

    def put(self, key: str, ids: bytes, most: int) -> None:
        """Hold a key's ids, of most entries in both halves; a long key isn't held."""
        if len(key) > 64:
            return
        if len(self.young) >= most // 2:
            self.old, self.young = self.young, {}
        self.young[key] = ids


class Coder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        form = json.loads(self.library.to_str())
        self.special = [t["content"] for t in form.get("added_tokens") or []]
        pre, model = form.get("pre_tokenizer") or {}, form["model"]
        self.by_piece = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and form.get("normalizer") is None
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        self.model, self.split = self.library.model, self.library.pre_tokenizer
        self.words, self.pieces, self.room = Memo(), Memo(), 1

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece in byte letters as little-endian unsigned 32-bit integers."""
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _piece(self, raw: str) -> bytes:
        if raw[0] == " " and raw[1:].isalpha():
            return self._word(raw[1:])
        ids = self.pieces.young.get(raw)
        if ids is None:
            ids = self.pieces.again(raw, self.room * PIECES)
            if ids is None:
                ids = self._ids(raw.encode().decode("latin-1").translate(_LETTERS))
                self.pieces.put(raw, ids, self.room * PIECES)
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of letters below U+0250 as they follow a space."""
        ids = self.words.young.get(word)
        if ids is None:
            ids = self.words.again(word, self.room * WORDS)
            if ids is None:
                ids = self._ids("\u0120" + (word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)))
                self.words.put(word, ids, self.room * WORDS)
        return ids

    def _cut(self, cut: str) -> bytes:
        """Ids of a cut as it follows a space; of letters and a stop, only the letters are held."""
        if cut.isascii() or max(cut) < "\u0250":
            if cut.isalpha():
                return self._word(cut)
            if cut[-1] in _STOPS and cut[:-1].isalpha():
                return self._word(cut[:-1]) + self._piece(cut[-1])
        ids = self.words.again(cut, self.room * WORDS)
        if ids is None:
            ids = self._chunk(" " + cut)
            if not cut[-1].isspace():
                self.words.put(cut, ids, self.room * WORDS)
        return ids

    def _chunk(self, text: str) -> bytes:
        if not (text.isascii() or max(text) < "\u0250"):
            return b"".join(self._ids(p) for p, _ in self.split.pre_tokenize_str(text))
        return b"".join(map(self._piece, _SPLIT.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, without begin, end or other added ids, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_piece or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = self._cuts(text.split(" "))
        return self._cuts(_CUT.split(text), False) if out is None else out

    def _cuts(self, cuts: list[str], whole: bool = True) -> bytes | None:
        """Ids of cuts that stand a space apart; None if whole and one of them is empty or has white space at an end."""
        first = cuts[0]
        if whole and (not first or first[-1].isspace()):
            return None
        words = self.words
        get, out = words.young.get, [self._chunk(first)]
        for c in cuts[1:]:
            ids = get(c)
            if ids is None:
                if whole and (not c or c[0].isspace() or c[-1].isspace()):
                    return None
                ids = self._cut(c)
                get = words.young.get
            out.append(ids)
        return b"".join(out)
