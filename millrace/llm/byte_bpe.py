"""Byte-level BPE exactly as the tokenizers library does it, at the speed of merging by ranks.

The vocabulary and merges come from the tokenizers library's own file.  Where merges stand in the
order of the ids they make, as in byte-level vocabularies, the same merging is done by tiktoken from
those ranks, several times faster; this holds for texts of plain characters, on whose classes all
Unicode tables agree, without a special token's string.  All other texts, and all texts of other
vocabularies, are encoded by the tokenizers library itself.  In each batch some texts go both ways,
and a difference is an error.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from .common import keeps

#: Letters among the plain characters below.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įĲ-ɏ"

#: Any other character sends a text to the library.
ODD = re.compile("[^\t\n\r\x20-\x7e¡-±´-¸º»¿-įĲ-ɏ–—‘-”…€]")

#: The byte-level pre-tokenizer's pattern (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: One text in so many is encoded by the tokenizers library too.
CHECK_EVERY = 32


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        kind = json.loads(self.library.to_str())
        special = [t["content"] for t in kind["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.ranks = self._ranks(kind)

    @staticmethod
    def _ranks(kind: dict):
        """tiktoken's encoder of the same vocabulary; None if merges are not in the order of ids."""
        import tiktoken

        model, pre = kind["model"], kind["pre_tokenizer"] or {}
        if kind["normalizer"] is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(made, made[1:])):
            return None
        to_byte = byte_alphabet()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items()}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        """Ids of one text by the tokenizers library."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without begin and end, packed little-endian in self.dtype."""
        out = []
        for k, t in enumerate(texts):
            if not t:
                out.append(b"")
            elif self.ranks is None or ODD.search(t) or self.special.search(t):
                out.append(self.whole(t))
            else:
                out.append(self.ranks.encode_to_numpy(t, disallowed_special=()).astype(self.dtype).tobytes())
                if k % CHECK_EVERY == 0 and self.whole(t) != out[-1]:
                    raise ValueError(f"the tokenizers library encodes {t[:80]!r} otherwise")
        return out


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


keeps("byte_bpe", byte_bpe.cache_clear)
