"""Recompression rounds over word sequences, as array passes.

A round replaces symbols by longer ones: the first round names every run of one
repeated word, and each pair round deals the symbols to a left and a right class
by one bit of their names and replaces each left-right pair of neighbours by one
symbol.  Names are hashes of what a symbol was made from, so equal substrings get
equal interior symbols in every document of the corpus, without a shuffle for a
dictionary of names.

Which symbol stands at a place follows from the symbol's own words and a few
words around it.  `parse` tracks that stretch for each symbol: an equal stretch
anywhere in the corpus has the same symbol at the same place.  `keys` hashes the
whole stretch, and so two documents that share a window share the key of every
symbol whose stretch the window holds.
"""

from __future__ import annotations

import numpy as np

from graphmill.llm.textarrays import mix, mix2, ranges, window_hashes

#: Pair rounds after the round that names runs; the symbols then span up to 2**ROUNDS runs.
ROUNDS = 4
FAR = 1 << 40


def parse(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after all rounds, and the stretch of words [low, high) that fixes each.

    words: word hashes of some rows one after another; first: where each row's words begin, and their end.
    A symbol at a row's edge has no finite stretch: low is below every word, or high above.
    """
    n = len(words)
    head = np.zeros(n + 1, bool)
    head[first] = True  # the last one stands for the end
    new = head[:n].copy()
    new[1:] |= words[1:] != words[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], n)
    name = np.where(end - at > 1, mix2(words[at], (end - at).astype(np.uint64)), words[at])
    opens, closes = head[at], head[end]
    low = np.where(opens, -FAR, at - 1)
    high = np.where(closes, FAR, end + 1)
    for level in range(rounds):
        right = (mix(name + np.uint64(level + 1)) >> np.uint64(63)).astype(bool)
        m = len(name)
        joins = np.zeros(m, bool)  # with the next one
        joins[:-1] = ~right[:-1] & right[1:] & ~closes[:-1]
        taken = np.zeros(m, bool)  # by the one before
        taken[1:] = joins[:-1]
        before = np.where(opens, -FAR, np.append(-FAR, low[:-1]))
        after = np.where(closes, FAR, np.append(high[1:], FAR))
        low = np.where(right & ~taken, before, low)
        high = np.where(~right, after, high)  # a joined left one takes its partner's, too
        keep = np.flatnonzero(~taken)
        pair = joins[keep]
        second = np.minimum(keep + 1, m - 1)
        name = np.where(pair, mix2(name[keep], name[second]), name[keep])
        low, high = low[keep], high[keep]
        opens, closes = opens[keep], np.where(pair, closes[second], closes[keep])
    return name, low, high


def keys(words: np.ndarray, first: np.ndarray, length: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, and [low, high), of the stretch of every symbol that fits in a window of `length` words, by low.

    The name enters the hash, too.  A window that holds no such stretch is a key of its own: that it holds none
    follows from the window's words alone, so equal windows agree.
    """
    name, low, high = parse(words, first, rounds)
    fits = np.flatnonzero((low >= 0) & (high <= len(words)) & (high - low <= length))
    name, low, high = name[fits], low[fits], high[fits]
    start = ranges(first[:-1], np.diff(first) - length + 1)
    least = np.full(len(words) + 1, FAR)  # the first end of the stretches that begin at a word or later
    np.minimum.at(least, low, high)
    least = np.minimum.accumulate(least[::-1])[::-1]
    bare = start[least[start] > start + length]
    code = np.empty(len(name), np.uint64)
    span = high - low
    for k in np.unique(span):
        own = np.flatnonzero(span == k)
        code[own] = mix2(name[own], window_hashes(words, int(k))[low[own]])
    code = np.concatenate([code, window_hashes(words, length)[bare] if len(bare) else np.zeros(0, np.uint64)])
    low, high = np.concatenate([low, bare]), np.concatenate([high, bare + length])
    order = np.argsort(low, kind="stable")
    return code[order], low[order], high[order]
