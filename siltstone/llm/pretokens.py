"""The pre-tokens of a byte-level BPE tokenizer, and its vocabulary file."""

from __future__ import annotations

import json
import re

import regex

#: Unicode White_Space, as the tokenizers library understands it (fixed values).
WHITE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
_RUN = regex.compile(rf"[{WHITE}] (?:[{WHITE}]|\Z)|  ")
_MAYBE = re.compile(rf" (?:[{WHITE}]|\Z)")


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: byte strings by id, ids by byte, merges by pair of ids, special tokens."""

    def __init__(self, tokenizer_json: bytes | str):
        spec = json.loads(tokenizer_json)
        chars = byte_chars()
        to_byte = {c: b for b, c in enumerate(chars)}
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in text)
        self.special: dict[str, int] = {}
        for t in spec["added_tokens"]:
            self.special[t["content"]] = t["id"]
            self.strings[t["id"]] = t["content"].encode()
        self.of_byte = [vocab[c] for c in chars]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]


def segments(text: str, special: dict[str, int]) -> list[str | int]:
    """The text cut at special tokens, which stand as their ids."""
    found = [s for s in special if s in text]
    if not found:
        return [text]  # also where it is empty
    cut = regex.split("(" + "|".join(map(regex.escape, sorted(found, key=len, reverse=True))) + ")", text)
    return [special.get(x, x) if k % 2 else x for k, x in enumerate(cut) if x]


def has_run(text: str) -> bool:
    """Whether white space beside white space would make units depend on each other."""
    return _MAYBE.search(text) is not None and _RUN.search(text) is not None
