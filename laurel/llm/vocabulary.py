"""The files of byte-level BPE tokenizers, read once for each Python worker."""

from __future__ import annotations

import json
from functools import lru_cache

import regex

#: The split before the merges, with white space by its Unicode property (fixed by the file format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next free one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Vocabulary:
    """ids, merges and special strings of a byte-level BPE file in JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        if model["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is not a byte-level BPE file")
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        ids = model["vocab"]
        #: Token ids of the single bytes.
        self.bytes = [ids[letters[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        #: The bytes of every id.
        self.strings = [b""] * self.size
        for text, i in ids.items():
            self.strings[i] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
        for text, i in self.special.items():
            self.strings[i] = text.encode()
        #: (left id, right id, merged id) in order of rank.
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.pieces = regex.compile(PIECES)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def split(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """The pieces of a text outside special strings, and the ids of the special strings in it, each with its place among the pieces."""
        if self.marks is None or not self.marks.search(text):
            return self.pieces.findall(text), []
        pieces, marks, at = [], [], 0
        for found in self.marks.finditer(text):
            pieces += self.pieces.findall(text[at : found.start()])
            marks.append((len(pieces), self.special[found.group()]))
            at = found.end()
        return pieces + self.pieces.findall(text[at:]), marks


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
