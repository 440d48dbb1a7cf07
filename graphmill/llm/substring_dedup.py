"""Removal of repeated word passages, found by recompression.

A window is WINDOW consecutive words of one document.  A word goes if some window
that covers it also starts in a document with a smaller doc_id.

1. Documents are dealt to units by a hash of their columns, so rows that share a
   doc_id, or have none, are not one unit.  Each unit runs the
   recompression rounds (`recompression.py`) over its texts and sends the key of
   every high-level symbol, once for each unit, to a bucket by its hash.
2. A bucket finds the keys that two documents share and tells their units.
3. A window is a candidate if all symbols that lie in it are shared: two equal
   windows hold the same symbols, so no other window can repeat.  Units send the
   name of each distinct candidate with its smallest doc_id to buckets.
4. A bucket tells each unit which of its windows, by their names, start in a smaller
   document elsewhere.
5. Units mark the words that such windows cover, or windows that repeat within
   the unit, and drop them.

Each exchange carries one entry for a key and unit, so a passage that a third of all
documents share is as many rows in its bucket as there are units, and a task holds
one unit (UNIT_BYTES of text, or one longer document) or one bucket.  Texts are
shuffled once; the three passes read the same exchange.

A window's name is two 64-bit hashes, `code` and `check`, made from independent hashes
of its words.  Windows are compared by name, not word by word: among 10^13 different
windows the chance that any two have one name is below 10^-12.

Defined cases
    doc_id is a column of whole numbers; another type is an error.  Words are split at ASCII white space only.  A null text has no words and stays
    null.  A document shorter than a window keeps everything.  Rows with the same
    doc_id do not remove one another's words.  A null doc_id counts as larger than
    every id.  Rows that are equal in all columns share a unit.  An empty table gives
    no rows.  Columns of any name stay as they are; only text and n_chars change.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm.recompression import keys
from graphmill.llm.textarrays import SPACE, blocks, flat, free_name, ranges, spans, tidy, window_hashes, within, word_hashes

WINDOW = 13
#: Text in a unit, and text that a bucket's keys stand for, about.
UNIT_BYTES, BUCKET_BYTES = 6 << 20, 24 << 20
_LOW48 = np.uint64((1 << 48) - 1)
_LAST = (1 << 63) - 1
_MESSAGE = "_bucket long, _unit long, keys binary, more binary, docs binary"


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the highest bits, so sorted hashes have sorted buckets."""
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()


def _texts(table: pa.Table):
    """(first row, bytes, offsets, word starts, word ends, words by row, word hashes) of blocks of the rows."""
    buffer, offsets = flat(table.column("text"))
    for i, j in blocks(offsets):
        b, o = buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, first = spans(b, o)
        yield i, b, o, start, end, first, word_hashes(b, start, end)


def _check(b: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """The second hash of every window, from other hashes of the words than the first."""
    return window_hashes(word_hashes(b, start, end, 1), window, 1)


def _grouped(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order, and where each group of equal codes begins in it."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    return order, np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])


def _grouped_names(code: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _grouped, for names of two hashes."""
    order = np.argsort(code, kind="stable")
    a, b = code[order], check[order]
    new, other = a[1:] != a[:-1], b[1:] != b[:-1]
    if (other & ~new).any():  # different names with one code
        order = np.lexsort((check, code))
        a, b = code[order], check[order]
        new, other = a[1:] != a[:-1], b[1:] != b[:-1]
    return order, np.flatnonzero(np.append(True, new | other)[: len(code)])


def _member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_set, x)
    return sorted_set[np.minimum(at, len(sorted_set) - 1)] == x


def _named(code: np.ndarray, check: np.ndarray, codes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Whether each name is among (codes, checks), which are sorted by code."""
    found = np.zeros(len(code), bool)
    at = np.searchsorted(codes, code)
    left = np.flatnonzero(at < len(codes))
    while len(left):
        left = left[codes[at[left]] == code[left]]
        hit = checks[at[left]] == check[left]
        found[left[hit]] = True
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < len(codes)]
    return found


def _messages(unit: int, bucket: np.ndarray, columns: list) -> pa.Table:
    """A row for each bucket; columns: functions that give the bytes of a slice of the sorted entries."""
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    ends = np.append(cut[1:], len(bucket))
    rows = [pa.array([f(slice(a, b)) for a, b in zip(cut, ends)], pa.binary()) for f in columns]
    rows += [pa.nulls(len(cut), pa.binary())] * (3 - len(rows))
    return pa.Table.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array(np.full(len(cut), unit, np.int64)), *rows], ["_bucket", "_unit", "keys", "more", "docs"])


def _symbol_keys(window: int, buckets: int, unit: str):
    """Unit -> its distinct symbol keys, with a bit for those that two of its documents have."""

    def run(table: pa.Table) -> pa.Table:
        ids, codes, docs = _ids(table), [], []
        for i, _, _, _, _, first, words in _texts(table):
            code, low, _ = keys(words, first, window)
            codes.append(code)
            docs.append(ids[i + np.searchsorted(first, low, side="right") - 1])
        code, doc = np.concatenate([np.zeros(0, np.uint64), *codes]), np.concatenate([np.zeros(0, np.int64), *docs])
        order, cut = _grouped(code)
        if not len(cut):
            return _messages(0, np.zeros(0, np.int64), [])
        code, doc = code[order][cut], doc[order]
        many = np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)
        return _messages(table.column(unit)[0].as_py(), _bucket(code, buckets), [lambda s: _pack48(code[s] & _LOW48), lambda s: np.packbits(many[s]).tobytes()])

    return run


def _shared_keys(table: pa.Table) -> pa.Table:
    """Bucket -> for each unit, its keys that two documents have."""
    parts = [_unpack48(x.as_py()) for x in table.column("keys")]
    many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)) for x, p in zip(table.column("more"), parts)]).astype(bool)
    code = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order, cut = _grouped(code)
    size = np.diff(np.append(cut, len(code)))
    shared = (size > 1) | np.logical_or.reduceat(many[order], cut)
    kept = order[np.repeat(shared, size)]
    return _replies(table, code, row, kept, _pack48)


def _replies(table: pa.Table, code: np.ndarray, row: np.ndarray, kept: np.ndarray, pack) -> pa.Table:
    kept = kept[np.argsort(row[kept], kind="stable")]
    rows, cut = np.unique(row[kept], return_index=True)
    ends = np.append(cut[1:], len(kept))
    units = table.column("_unit").to_numpy()[rows]
    data = pa.array([pack(code[kept[a:b]]) for a, b in zip(cut, ends)], pa.binary())
    return pa.Table.from_arrays([pa.array(units, pa.int64()), pa.array(np.full(len(rows), table.column("_bucket")[0].as_py()), pa.int64()), data], ["_unit", "_bucket", "keys"])


def _candidates(window: int, buckets: int, unit: str):
    """Unit and its shared keys -> its distinct candidate windows, each with its smallest doc_id."""

    def tagged(low48: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return (low48 << np.uint64(16)) | (bucket.astype(np.uint64) & np.uint64(0xFFFF))

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return _messages(0, np.zeros(0, np.int64), [])
        parts = [_unpack48(x.as_py()) for x in replies.column("keys")]
        shared = np.sort(tagged(np.concatenate(parts), np.repeat(replies.column("_bucket").to_numpy(), [len(p) for p in parts])))
        ids, found = _ids(table), []
        for i, b, _, start, end, first, words in _texts(table):
            code, low, high = keys(words, first, window)
            lone = ~_member(tagged(code & _LOW48, _bucket(code, buckets)), shared)
            ruled = np.zeros(len(words) + 2, np.int64)
            np.add.at(ruled, np.maximum(high[lone] - window, 0), 1)
            np.add.at(ruled, low[lone] + 1, -1)
            at = within(first, window)
            at = at[np.cumsum(ruled)[at] == 0]
            found.append((window_hashes(words, window)[at], _check(b, start, end, window)[at], ids[i + np.searchsorted(first, at, side="right") - 1]))
        code, check, doc = (np.concatenate(x) for x in zip(*found))
        order, cut = _grouped_names(code, check)
        if not len(cut):
            return _messages(0, np.zeros(0, np.int64), [])
        least = np.minimum.reduceat(doc[order], cut)
        code, check = code[order][cut], check[order][cut]
        return _messages(table.column(unit)[0].as_py(), _bucket(code, buckets), [lambda s: code[s].tobytes(), lambda s: check[s].tobytes(), lambda s: least[s].tobytes()])

    return run


def _smaller_elsewhere(table: pa.Table) -> pa.Table:
    """Bucket -> for each unit, its windows that start in a smaller document of another unit."""
    read = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    parts = read("keys", np.uint64)
    code, check, doc = np.concatenate(parts), np.concatenate(read("more", np.uint64)), np.concatenate(read("docs", np.int64))
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order, cut = _grouped_names(code, check)
    least = np.repeat(np.minimum.reduceat(doc[order], cut), np.diff(np.append(cut, len(code)))) if len(cut) else doc
    return _replies(table, np.stack([code, check], 1), row, order[doc[order] > least], lambda x: x.tobytes())


def _strip(window: int, joined: bool, columns: list[str], measures: bool):
    """Unit and its windows with a smaller start elsewhere -> its rows without the repeated words."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in replies.column("keys"))]).reshape(-1, 2)
        names = names[np.argsort(names[:, 0], kind="stable")]
        ids = _ids(table)
        parts = list(_texts(table))
        at = [within(first, window) for _, _, _, _, _, first, _ in parts]
        code = np.concatenate([np.zeros(0, np.uint64), *(window_hashes(p[6], window)[a] for p, a in zip(parts, at))])
        check = np.concatenate([np.zeros(0, np.uint64), *(_check(p[1], p[3], p[4], window)[a] for p, a in zip(parts, at))])
        doc = np.concatenate([np.zeros(0, np.int64), *(ids[p[0] + np.searchsorted(p[5], a, side="right") - 1] for p, a in zip(parts, at))])
        gone = _named(code, check, *names.T)
        order, cut = _grouped_names(code, check)
        if len(cut):
            gone[order] |= doc[order] > np.repeat(np.minimum.reduceat(doc[order], cut), np.diff(np.append(cut, len(code))))
        n_words, n_removed = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        kept, done = [], 0
        for (i, b, o, start, end, first, _), a in zip(parts, at):
            mark = np.zeros(len(start) + window + 1, np.int64)
            hit = a[gone[done : done + len(a)]]
            done += len(a)
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + window, -1)
            stays = np.cumsum(mark)[: len(start)] == 0
            rows = len(o) - 1
            total = np.concatenate([[0], np.cumsum(stays)])
            n_words[i : i + rows] = np.diff(first)
            n_removed[i : i + rows] = np.diff(first) - np.diff(total[first])
            kept.append(_kept_texts(b, o, start, end, first, stays, joined))
        text = pa.chunked_array(kept or [pa.array([], pa.large_string())]).cast(pa.string())
        text = pc.if_else(table.column("text").is_valid(), text, pa.scalar(None, pa.string()))
        if not joined:
            text = pc.if_else(pa.array(n_removed > 0), text, table.column("text"))
        out = {n: table.column(n) for n in columns} | {"text": text}
        if "n_chars" in out and not joined:
            out["n_chars"] = pc.utf8_length(text).cast(table.column("n_chars").type)
        return pa.table(out | ({"n_words": n_words, "n_removed": n_removed} if measures else {}))

    return run


def _kept_texts(b, o, start, end, first, stays, joined) -> pa.Array:
    """Texts of the rows of a block, without the words that don't stay.

    joined: the words with one space between; else a removed word takes the white space after it along.
    """
    own = np.flatnonzero(stays)
    row = np.searchsorted(first, own, side="right") - 1
    last = np.append(row[1:] != row[:-1], True)[: len(own)]
    if joined:
        at = ranges(start[own], end[own] - start[own] + ~last)
        data = np.where(SPACE, 0x20, np.arange(256)).astype(np.uint8)[b[np.minimum(at, len(b) - 1)]] if len(at) else np.zeros(0, np.uint8)
        length = np.bincount(row, (end - start)[own] + ~last, len(o) - 1).astype(np.int64)
    else:
        nxt = np.append(start[1:], len(b))  # where the next word of the row begins, or the row ends
        ends = np.minimum(nxt, o[np.searchsorted(first, np.arange(len(start)), side="right")])
        gone = np.ones(len(b) + 1, np.int64)
        gone[:] = 0
        out = np.flatnonzero(~stays)
        np.add.at(gone, start[out], 1)
        np.add.at(gone, ends[out], -1)
        keep = np.cumsum(gone)[: len(b)] == 0
        data = b[keep]
        length = np.diff(np.concatenate([[0], np.cumsum(keep)])[o])
    offsets = np.concatenate([[0], np.cumsum(length)])
    return pa.LargeStringArray.from_buffers(len(o) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes()))


def remove_repeats(docs: DataFrame, window: int = WINDOW, joined: bool = False, measures: bool = True) -> DataFrame:
    """The rows with repeated words gone from `text` (and n_chars, if there, set to the new length).

    joined: kept words have one space between, in every row; else the text's own white space stays.
    measures: adds n_words and n_removed, of the text as it came, after the table's columns and in place of columns
    of these names.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a column of whole numbers")
    if measures:
        docs = docs.drop("n_words", "n_removed")
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    units, buckets = max(1, math.ceil(total / UNIT_BYTES)), max(1, math.ceil(total / BUCKET_BYTES))
    columns, unit = docs.columns, free_name(docs, "_unit")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    by_unit = docs.withColumn(unit, F.pmod(F.xxhash64(*plain), F.lit(units))).groupBy(unit)

    def told(messages: DataFrame):
        return messages.withColumnRenamed("_unit", unit).groupBy(unit)

    symbols = by_unit.applyInArrow(tidy(_symbol_keys(window, buckets, unit)), _MESSAGE)
    shared = symbols.groupBy("_bucket").applyInArrow(tidy(_shared_keys), "_unit long, _bucket long, keys binary")
    windows = by_unit.cogroup(told(shared)).applyInArrow(tidy(_candidates(window, buckets, unit)), _MESSAGE)
    repeats = windows.groupBy("_bucket").applyInArrow(tidy(_smaller_elsewhere), "_unit long, _bucket long, keys binary")
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema]
    schema = T.StructType(fields + ([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())] if measures else []))
    return by_unit.cogroup(told(repeats)).applyInArrow(tidy(_strip(window, joined, columns, measures)), schema)
