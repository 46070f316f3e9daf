"""Token ids of texts by the tokenizers library, with the ids of pieces met before kept."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from dataclasses import dataclass

from moorage.llm.base import worker_cache

#: Pieces whose ids one worker keeps; beyond it, it starts anew. Bounds memory, not results.
KEPT_PIECES = 300_000
_LONG_PIECE = 64
_SPACE = {chr(c) for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0)}


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer as the text of its .json file, so that workers need no path of the driver's."""

    text: str

    @staticmethod
    def read(path: str) -> TokenizerFile:
        with open(path, encoding="utf-8") as file:
            return TokenizerFile(file.read())

    @property
    def digest(self) -> str:
        """Digest of the file and of the library's version: counts of another version are not reused."""
        import tokenizers

        return hashlib.sha256(f"tokenizers {tokenizers.__version__}\n{self.text}".encode()).hexdigest()

    @property
    def drops_space(self) -> bool:
        """Whether runs of white space count as one and never reach a token."""
        spec = json.loads(self.text)
        return "\\s+" in json.dumps(spec["normalizer"] or {}).replace("\\\\", "\\") and _pieces_of(spec) is not None and _split_pattern(spec) is not None


def _latin(kind: str) -> str:
    """The characters below U+0100 of a Unicode category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c)).startswith(kind))


def _steps(part: dict | None, inner: str) -> list[dict]:
    if part is None:
        return []
    return part[inner] if part["type"] == "Sequence" else [part]


def _split_pattern(spec: dict) -> str | None:
    steps = _steps(spec["pre_tokenizer"], "pretokenizers")
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    split = steps[0]
    return split["pattern"].get("Regex") if split["behavior"] == "Removed" and split["invert"] else None


def _pieces_of(spec: dict) -> tuple[re.Pattern, bool] | None:
    """How texts of characters below U+0100 split into pieces, and whether in lower case; None: not known."""
    letters, digits, spaces = _latin("L"), _latin("N"), "".join(re.escape(c) for c in sorted(_SPACE))
    normal = [s["type"] for s in _steps(spec["normalizer"], "normalizers")]
    steps = _steps(spec["pre_tokenizer"], "pretokenizers")
    if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return None
    split = _split_pattern(spec)
    if split is not None and normal == ["NFC", "Replace", "Lowercase"]:
        # The pattern of the tokenizer files, here with classes of Latin-1 characters.
        if split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+"), True
    if not normal and [s["type"] for s in steps] == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]:
        return re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
        ), False
    return None


class Encoder(dict):
    """piece -> its ids as little-endian 32-bit bytes; ``ids`` gives those of a whole text.

    Texts of characters below U+0100 without special strings are split here and their pieces handed to
    the library's model; all others go through the library whole. Both give the same ids (tested).
    """

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        spec = json.loads(text)
        self._whole = Tokenizer.from_str(text)
        self._whole.no_truncation()
        self._whole.no_padding()
        self._model = self._whole.model
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._split = _pieces_of(spec)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self._bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}

    def __missing__(self, piece: str) -> bytes:
        # ASCII letters and digits stand for themselves in the model's alphabet of bytes.
        shown = piece if piece.isascii() and piece.isalnum() else piece.translate(self._bytes)
        ids = array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()
        if len(piece) <= _LONG_PIECE:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self._split is None or not _narrow(text) or any(s in text for s in self._special):
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        pattern, lower = self._split
        return b"".join(map(self.__getitem__, pattern.findall(text.lower() if lower else text)))


def _narrow(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(text: str) -> Encoder:
    """The worker's encoder for a tokenizer file; later tasks of the worker find it again."""
    kept = worker_cache("token ids")
    if text not in kept:
        kept.clear()
        kept[text] = Encoder(text)
    return kept[text]
