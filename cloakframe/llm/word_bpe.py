"""Token ids of whole texts by a word-level BPE vocabulary of the tokenizers library.

White space never enters a token of these vocabularies, so a text's ids are
the ids of its words one after another, and words repeat: each worker keeps a
bounded table of words and their ids.  New words in plain scripts go through
the merge table directly; any other word, and any word that may hold a special
token, goes through the library itself.  Tests hold both ways against each
other.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Words that a worker remembers with their ids.
CACHE_WORDS = 400_000
#: Longer words are not remembered.
CACHE_BYTES = 48
#: A byte that UTF-8 never holds marks the end of a piece inside the merge table.
_END = b"\xff"


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordIds(dict):
    """Maps a word's bytes to its ids (little-endian unsigned 32-bit)."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        symbols = _byte_symbols()

        def raw(token: str) -> bytes:
            body, end = (token[: -len(suffix)], _END) if suffix and token.endswith(suffix) else (token, b"")
            return bytes(symbols[c] for c in body) + end

        vocab = model["vocab"]
        ranks = {bytes([b]) + _END: b for b in range(256)} | {bytes([b]): 256 + b for b in range(256)}
        id_of = {raw(t): i for t, i in vocab.items() if t not in {x["content"] for x in spec["added_tokens"]}}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(a) + raw(b), len(ranks))
        self.ids = [b""] * len(ranks)
        for token, r in ranks.items():
            if token in id_of:
                self.ids[r] = np.array([id_of[token]], "<u4").tobytes()
        self.pieces: dict[str, bytes] = {}
        self.core = tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        #: Only where both ways are known to agree: letters below the general punctuation block.
        self.plain = regex.compile(r"[!-ɏ]*")

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = b"".join([self.ids[r] for r in self.core.encode_single_piece(piece.encode() + _END)])
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            if len(piece) <= CACHE_BYTES:
                self.pieces[piece] = found
        return found

    def _ids(self, word: str) -> bytes:
        if "<|" in word or not (word.isprintable() if word.isascii() else self.plain.fullmatch(word)):
            return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        low = unicodedata.normalize("NFC", word).lower()
        # Most words are letters, with or without a mark behind them; isalpha() is the pattern's letter class.
        if low.isalpha():
            return self._piece(low)
        if low[:-1].isalpha() and not low[-1].isnumeric() and not low[-1].isspace():
            return self._piece(low[:-1]) + self._piece(low[-1])
        return b"".join(map(self._piece, self.pattern.findall(low)))

    def __missing__(self, word: bytes) -> bytes:
        ids = self._ids(word.decode())
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.pieces.clear()

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
