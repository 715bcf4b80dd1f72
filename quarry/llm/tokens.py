"""Token ids of whole texts, by the public byte-level BPE vocabulary.

A byte-level BPE splits a text by a fixed pattern and merges inside each
piece alone, so the ids of a text are the ids of its pieces in order. Words
repeat, so each task keeps the ids of the pieces it has seen (as packed
little-endian bytes) and asks the tokenizer only for new ones.
"""

from __future__ import annotations

import functools
import re
import struct

WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Fixed value: the pattern by which the vocabulary's pre-tokenizer splits texts.
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
           rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
# The same pieces in the standard library's classes, for texts of characters
# up to U+024F on which both agree (all but those of ODD); about twice as fast.
PLAIN = r" ?[^\W\d_]++|'(?:s|t|re|ve|m|ll|d)| ?\d++| ?(?:_|[^\s\w])++|\s+(?!\S)|\s+"
ODD = r"[^\x00-\u024f]|[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be]"

#: Pieces a task remembers; at this size the memory starts anew. Results do not depend on it.
REMEMBERED = 1_000_000


class Encoder:
    """``ids(text)``: the text's ids as packed little-endian unsigned 32-bit
    integers. The vocabulary's added tokens inside a text get their own ids, and
    the texts between them are encoded each alone; empty text has no ids."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        # the model merges one piece; its alphabet writes each byte as a character
        whole = Tokenizer.from_file(path)
        self._model = whole.model
        added = {t.content: (n, t) for n, t in whole.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("added tokens that take blanks or whole words are not supported")
        self._added = {content: struct.pack("<I", n) for content, (n, _) in added.items()}
        # of tokens that start alike the longest is taken
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self._bytes = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self._space = chr(self._bytes[32])
        self._any, self._plain, self._odd = regex.compile(PATTERN).findall, re.compile(PLAIN).findall, re.compile(ODD).search
        self._known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        for p in set(pieces):
            if p not in self._known:
                plain = p.isascii() and p.isprintable()
                merged = self._model.tokenize(p.replace(" ", self._space) if plain else
                                              p.encode("utf-8").decode("latin-1").translate(self._bytes))
                self._known[p] = struct.pack(f"<{len(merged)}I", *[m.id for m in merged])

    def ids(self, text: str) -> bytes:
        if any(content in text for content in self._added):
            return b"".join(self._added[x] if k % 2 else self._plain_ids(x) for k, x in enumerate(self._cut(text)))
        return self._plain_ids(text)

    def _plain_ids(self, text: str) -> bytes:
        pieces = self._any(text) if self._odd(text) else self._plain(text)
        try:
            return b"".join(map(self._known.__getitem__, pieces))
        except KeyError:
            if len(self._known) > REMEMBERED:
                self._known.clear()
            self._learn(pieces)
            return b"".join(map(self._known.__getitem__, pieces))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker, kept between tasks."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
