"""Token ids of the lower-casing word BPE, by a cache over words.

The tokenizer lower-cases, splits into words and encodes each word by itself, so a text's
ids follow from those of its words. Texts of letters before U+0180 are split here; for
those normalisation changes nothing but case, and ``tokenizers`` is asked once per word.
Every other text goes to ``tokenizers`` whole, and so does one that may hold a special mark
such as ``<|endoftext|>``, which has an id of its own. Tests hold both ways against each other.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

_PLAIN = [chr(i) for i in range(0x180)]


def _class(kinds: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in _PLAIN if unicodedata.category(c)[0] in kinds)


_SPACE = "".join(f"\\u{ord(c):04x}" for c in _PLAIN if c.isspace() and c not in "\x1c\x1d\x1e\x1f")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]"
                   f"|[^{_SPACE}{_class('LN')}]+")
#: Beyond the plain letters, and marks whose treatment as space differs between libraries.
_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u017f]")
#: How every special mark begins.
_MARK = "<|"
_END = b"\xff"
CACHED = 250_000


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokens(dict):
    """Maps a run of characters to its ids; a missing run is encoded and kept."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        back, suffix = _byte_of(), model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(back[c] for c in (token[:-len(suffix)] if end else token)) + _END * end

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # A word's last byte first takes up the end mark; then the merges follow in order.
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b]) + _END: 256 + b for b in range(255)}
        ranks[_END + _END] = 511
        for left, right in merges:
            ranks.setdefault(raw(left + right), len(ranks))
        self.id_of = {ranks[raw(t)]: i for t, i in model["vocab"].items()
                      if not t.startswith("<|") and raw(t) in ranks}
        self.dtype = np.dtype("<u2" if max(model["vocab"].values()) < 1 << 16 else "<u4")
        self.ranked = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks,
                                        special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        """Ids of a run without white space, as packed integers."""
        parts = _WORD.findall(chunk)
        if parts == [chunk]:
            ids = [self.id_of[r] for r in self.ranked._encode_single_piece(chunk.encode() + _END)]
            packed = np.array(ids, self.dtype).tobytes()
        else:
            packed = b"".join([self[part] for part in parts])
        if len(self) < CACHED:
            self[chunk] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """A text's ids as little-endian integers of ``dtype``."""
        if _MARK in text or _OTHER.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, self.dtype).tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
