"""Token ids of whole texts as bytes, by a byte-level BPE in the tokenizers format.

The vocabulary never merges across the words of the published split pattern, and a single
space before a character that isn't white space always starts such a word.  So the ids of
a text are those of its space-separated chunks, one after the other, and each different
chunk is encoded once.  Texts for which that doesn't hold (a space before white space or
at the end, an added token's text) are encoded by the tokenizers library as a whole.

Chunks are encoded by tiktoken's merge loop over the same file's vocabulary where the
file's merges stand in the order of their ids (then both libraries merge alike, which the
tests hold against each other); else by the tokenizers library too.
"""

from __future__ import annotations

import array
import json
import re

LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
# Fixed value: the published split pattern of this kind of vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary by bytes if its ids may serve as merge ranks, else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    vocab, byte = model["vocab"], _byte_of()
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or made != sorted(made) or made and made[0] < 256:
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in added}


class TokenBytes:
    """encode(text): its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, keep: int = 400_000, longest: int = 64):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            ranks = merge_ranks(json.load(f))
        self._library = Tokenizer.from_file(path)
        self._added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._keep, self._longest = keep, longest
        self._known: dict[str, bytes] = {}
        self._chunk = self._ids
        if ranks:
            import tiktoken

            merge = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._chunk = lambda text: self._bytes(merge(text))

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array.array("I", ids).tobytes()

    def _ids(self, text: str) -> bytes:
        return self._bytes(self._library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if LOOSE_SPACE.search(text) or any(a in text for a in self._added):
            return self._ids(text)
        head, *rest = text.split(" ")
        known = self._known
        try:
            tail = b"".join(map(known.__getitem__, rest))
        except KeyError:
            if len(known) > self._keep:
                known.clear()
            out = []
            for c in rest:
                ids = known.get(c)
                if ids is None:
                    ids = self._chunk(" " + c)
                    if len(c) <= self._longest:  # so that what is kept has a bounded size
                        known[c] = ids
                out.append(ids)
            tail = b"".join(out)
        return self._chunk(head) + tail
