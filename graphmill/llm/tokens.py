"""Token ids of texts under a public byte-level BPE vocabulary, by path."""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np


@functools.lru_cache(maxsize=4)
def _encoding(path: str, special: tuple):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str, plain: bool):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = plain
    return out


#: Longer texts are encoded in parts, cut before a space between letters: there the vocabulary's own word pattern always cuts, too.
PART = 1 << 19
_GAP = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def _parts(text: str):
    at = 0
    while len(text) - at > 2 * PART and (gap := _GAP.search(text, at + PART)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


class Encoder:
    """Encodes texts; the vocabulary file at `path` is read in each worker once.

    plain: the vocabulary's control strings are ordinary text where a text has them.  Else they have their own ids, as
    the tokenizers library gives them with add_special_tokens=False.

    A .json vocabulary that has the same vocabulary beside it as .tiktoken ranks is
    read from those: the ids are equal (a test holds one against the other) and the
    merge loop is four times as fast.
    """

    def __init__(self, path: str, plain: bool = False):
        ranks = path.removesuffix(".json") + ".tiktoken"
        special: dict[str, int] = {}
        simple = True
        self.plain = plain
        if path.endswith(".json"):
            with open(path) as f:
                vocabulary = json.load(f)
            added = vocabulary["added_tokens"]
            special = {x["content"]: x["id"] for x in added}
            simple = not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.path = ranks if os.path.exists(ranks) and simple else path
        self.fast = self.path.endswith(".tiktoken")
        self.special = tuple(sorted(special.items()))
        if self.fast:
            with open(self.path, "rb") as f:
                self.size = max(sum(1 for _ in f) + 1, *(k + 1 for k in special.values()), 0)
        else:
            self.size = len(vocabulary["model"]["vocab"])

    def encode(self, text: str) -> np.ndarray:
        if len(text) > 2 * PART:
            return np.concatenate([self._encode(x) for x in _parts(text)])
        return self._encode(text)

    def _encode(self, text: str) -> np.ndarray:
        if not self.fast:
            return np.array(_tokenizer(self.path, self.plain).encode(text, add_special_tokens=False).ids, np.uint32)
        encoding = _encoding(self.path, self.special)
        ids = encoding.encode_ordinary(text) if self.plain else encoding.encode(text, allowed_special="all")
        return np.array(ids, np.uint32)

    def pieces(self) -> list[bytes]:
        """Bytes of each id; empty for ids that stand for none."""
        out = [b""] * self.size
        if self.fast:
            for token, k in _encoding(self.path, self.special)._mergeable_ranks.items():
                out[k] = token
            return out
        tokenizer = _tokenizer(self.path, self.plain)
        return [tokenizer.decode([k]).encode() for k in range(self.size)]
