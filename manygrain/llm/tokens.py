"""Whole texts to token ids, by the ``tokenizers`` library, for use inside Arrow batches.

The vocabularies used here drop white space and never join across it, so a text's ids are
those of its pieces between blanks and line feeds, one after another. Pieces recur, so each
Python worker remembers their ids (about ``MEMO`` pieces, and as many from before).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from pathlib import Path
from struct import Struct

import numpy as np

#: Pieces of a generation, about; parts of pieces.
MEMO, PARTS = 300_000, 100_000
#: Characters of text that are cut into pieces at a time.
STRETCH = 500_000
_CUT = re.compile("[ \n]")
#: Pieces of Latin letters, digits and ASCII signs: lower case and composition are plain there, so
#: a lower-case byte-pair vocabulary's own splitting rule can be applied without its general normalizer.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


_PACK = [Struct(f"<{n}I").pack for n in range(40)]

# Fixed value: the splitting rule of the vocabularies that the short way holds for.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class _Memo(dict):
    """Looks in ``before`` and then asks ``learn`` for what it doesn't hold."""

    __slots__ = ("learn", "before")

    def __init__(self, learn: Callable[[str], bytes], before: "_Memo | None" = None):
        self.learn, self.before = learn, {} if before is None else before
        if before is not None:
            before.before = {}  # two generations, no chain of them

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = self.learn(piece)
        self[piece] = found
        return found


class Encoder:
    """Ids of whole texts as uint32 arrays; equal to ``encode(text, add_special_tokens=False).ids``."""

    _made: dict[tuple[str, int | None], "Encoder"] = {}

    def __init__(self, path: str, most: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.memo = most, _Memo(self._learned)
        self.parts = _Memo(self._part_ids)
        self.letters, self.tokenize = _byte_letters(), self.tokenizer.model.tokenize
        # the short way only for vocabularies with the rules it states
        rules = json.loads(Path(path).read_text())
        kinds = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and splits == [RULE, None]

    @classmethod
    def of(cls, path: str, most: int | None = None) -> "Encoder":
        """The worker's encoder, with ``most`` (MEMO) pieces of a generation."""
        if (path, most) not in cls._made:
            cls._made[path, most] = cls(path, most)
        return cls._made[path, most]

    def ids(self, text: str | None) -> np.ndarray:
        out, at, text = [], 0, text or ""
        while at < len(text):
            end = at + STRETCH
            if end < len(text):  # go on to the next blank, so that no piece is cut
                found = _CUT.search(text, end)
                end = found.end() if found else len(text)
            pieces = text[at:end].replace("\n", " ").split(" ")
            at = end
            if len(self.memo) >= (self.most or MEMO):
                self.memo = _Memo(self._learned, self.memo)
            out.append(b"".join(map(self.memo.__getitem__, pieces)))
        return np.frombuffer(b"".join(out), dtype="<u4")

    def _learned(self, piece: str) -> bytes:
        if self.plain:
            if len(self.parts) >= PARTS:
                self.parts = _Memo(self._part_ids, self.parts)
            if piece.isascii() and piece.isalpha():  # one part
                return self.parts[piece.lower()]
            if _PLAIN.fullmatch(piece) and "<|" not in piece:
                return b"".join(map(self.parts.__getitem__, _SPLIT.findall(piece.lower())))
        return np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part_ids(self, part: str) -> bytes:
        word = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        ids = [t.id for t in self.tokenize(word)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
