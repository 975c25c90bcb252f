"""Token ids of a byte-pair file with word ends (``</w>``), as the tokenizers library gives them, with less work per word.

Words recur, so the ids of a run of text between white space are kept in a bounded memory; a run not seen before is cut by the
file's own pattern and merged by tiktoken's core. There every byte is a symbol and byte 0xFF, which UTF-8 never uses, marks a
word's end: the pair (byte, 0xFF) has the lowest ranks (ids 256 to 511), so it joins first, and all other ranks are the file's.
A token of the file merges to itself alone, so joining by a token's bytes and joining by the file's pairs are the same; the
tests hold the ids against the tokenizers library. Texts with special tokens, with controls that Python alone takes for white
space, or with letters whose lower case depends on their neighbours go through the tokenizers library.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import regex

#: Runs remembered in each of two generations; the older one is dropped when the younger is full (some 60 MB a worker).
REMEMBERED = 250_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ranks = byte_letters(), {}
        for token, rank in spec["model"]["vocab"].items():
            ended = token.endswith("</w>")
            body = token[:-4] if ended else token
            if all(c in letters for c in body) and rank < len(spec["model"]["merges"]) + 512:
                ranks[bytes(letters[c] for c in body) + b"\xff" * ended] = rank
        self.merge = tiktoken.Encoding("word_bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.whole = Tokenizer.from_file(path)
        special = "|".join(regex.escape(t["content"]) for t in spec["added_tokens"])
        self.odd = regex.compile(f"[\x1c-\x1fΣİ]|{special}").search
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def run(self, word: str) -> bytes:
        """The ids of a run that the young generation doesn't hold."""
        if (ids := self.old.get(word)) is None:
            low = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
            merged = array("I")
            for piece in self.pieces(low):
                merged.extend(self.merge(piece.encode() + b"\xff"))
            ids = merged.tobytes()
        if len(word) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """A text's ids, each as four bytes, little-endian."""
        if self.odd(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        known, run = self.young.get, self.run
        return b"".join([known(word) or run(word) for word in text.split()])
