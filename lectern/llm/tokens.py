"""Fast exact encodings: the library's own result for each distinct piece of text, kept and joined.

Both vocabularies never join characters across the pieces used here (runs without spaces and line ends, or the
pattern's pieces), so a document's ids are its pieces' ids in order. A worker keeps the pieces it has met, up to a
bound, and asks the library for new ones only.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Distinct pieces that a worker keeps in all (about 0.25 KB each); beyond that only those of the texts at hand stay.
KEPT = 600_000
_WORDY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
#: Stands for a line end among ids, whose upper two bytes are zero, so it is nowhere else in their bytes.
_MARK = b"\xff" * 4


def _plain(run: str) -> bool:
    """Whether lower case is the same letter by letter and composition changes nothing."""
    low = run.lower()
    nfc = unicodedata.is_normalized
    return len(low) == len(run) and "\u03a3" not in run and nfc("NFC", run) and nfc("NFC", low)


class WordBpe:
    """Ids of the word BPE vocabulary (tokenizers), little-endian 32-bit, without special tokens."""

    _open: dict[str, "WordBpe"] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.most = KEPT

    @classmethod
    def at(cls, path: str) -> "WordBpe":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.own.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _learn(self, new: list[str]) -> None:
        """New runs without spaces: plain ones through their parts in lower case, odd ones as they are."""
        odd = [c for c in new if "<|" in c or not (c.isascii() or _plain(c))]
        self.chunks.update(zip(odd, self._library(odd), strict=True))
        taken = set(odd)
        plain = [c for c in new if c not in taken]
        pieces = _WORDY.findall("\n".join(plain).lower())
        own = set(pieces)
        fresh = list(own.difference(self.parts))
        if len(self.chunks) + len(self.parts) + len(fresh) > self.most:
            self.parts = {p: self.parts[p] for p in own.intersection(self.parts)}
        self.parts.update(zip(fresh, self._library(fresh), strict=True))
        self.parts["\n"] = _MARK
        self.chunks.update(zip(plain, b"".join(map(self.parts.__getitem__, pieces)).split(_MARK), strict=bool(plain)))

    def forget(self) -> None:
        """Frees what is kept; a worker lives on after its task."""
        self.chunks, self.parts = {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        runs = [t.replace("\n", " ").split(" ") for t in texts]
        every = set().union(*runs)
        new = every.difference(self.chunks)
        if len(self.chunks) + len(self.parts) + len(new) > self.most:
            self.chunks = {c: self.chunks[c] for c in every.intersection(self.chunks)}
        if new:
            self._learn(list(new))
        get = self.chunks.__getitem__
        return [np.frombuffer(b"".join(map(get, r)), dtype="<u4") for r in runs]

    def sentence_ends(self) -> np.ndarray:
        """By id: whether a token closes a sentence."""
        vocab = self.own.get_vocab()
        out = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, k in vocab.items():
            bare = token.removesuffix("</w>").rstrip("'\")]")
            out[k] = token.endswith("</w>") and bare[-1:] in {".", "!", "?"}
        return out


class ByteBpe:
    """Lengths in bytes of the tokens of the byte BPE vocabulary (tiktoken)."""

    _open: dict[str, "ByteBpe"] = {}

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype="<u2")
        for token, k in ranks.items():
            self.sizes[k] = len(token)
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str, pattern: str) -> "ByteBpe":
        if path not in cls._open:
            cls._open[path] = cls(path, pattern)
        return cls._open[path]

    def sizes_of(self, text: str) -> np.ndarray:
        """Byte lengths of the text's tokens, in order; their sum is the text's length in UTF-8."""
        pieces = self.pattern.findall(text)
        kept = self.kept
        try:
            return np.frombuffer(b"".join(map(kept.__getitem__, pieces)), dtype="<u2")
        except KeyError:
            pass
        if len(kept) > KEPT:
            kept.clear()
        for p in set(pieces).difference(kept):
            kept[p] = self.sizes[self.own.encode_ordinary(p)].tobytes()
        return np.frombuffer(b"".join(map(kept.__getitem__, pieces)), dtype="<u2")
