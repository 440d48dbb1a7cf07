"""Order-preserving packing of documents into sequences by dynamic programming.

The documents of a task are one stream of ids in row order.  It is cut into windows
of at most `length` ids; a window is a sequence, padded to `length`.  A cut costs
nothing at the end of a document, SENTENCE at the end of a sentence and FORCED
elsewhere (in stretches without sentences); a window costs its padding.  The
cheapest cuts follow from

    f(j) = cost(j) + min over i with c(j) - c(i) <= length of f(i) + length - (c(j) - c(i))

over the possible cuts c(0) < c(1) < ..., where the minimum of f(i) + c(i) over the
sliding range of i comes from a monotone queue: O(1) a cut.  The stream is solved
in stretches of STRETCH ids and the ids after a stretch's best last cut go on to the
next, so memory is bounded.  What is left at the end of a task is cut into windows
of powers of two, which need no padding.

There is no shuffle: a task packs the rows it reads.  sequence_id holds the task in
its upper bits, so ids are unique without a count over tasks.

Defined cases
    Control strings of the vocabulary in a text have their own ids, as the tokenizers
    library gives them.  doc_id may have any plain type and be null or repeated.
    A null or empty text is a document of the end id alone.  A very long text is
    encoded in parts; its pieces leave as they are cut.  Equally cheap cuts: the
    earlier one.  Columns besides doc_id and text aren't read.  A document longer than a
    window is cut at sentences.  Rows with equal ids are documents of their own.  An
    empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.tokens import Encoder
from graphmill.llm.textarrays import tidy

LENGTH, END = 2048, 1
#: Cost of a cut in the unit of one padding id.
SENTENCE, FORCED = 8, 12
#: A stretch without sentence ends longer than LONG may be cut every GRID ids.
LONG, GRID = 64, 16
STRETCH = 1 << 17


def sentence_tables(encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """For each id: may end a sentence; may follow a sentence's end."""
    pieces = encoder.pieces()
    ends = np.array([p.rstrip(b"\"')]").endswith((b".", b"!", b"?", b"\n")) for p in pieces])
    opens = np.array([p[:1] in (b" ", b"\n", b"\t", b"\r") for p in pieces])
    return ends, opens


def possible_cuts(ids: np.ndarray, document_ends: np.ndarray, ends: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions from 0 to len(ids) at which the stream may be cut, and the cost of each."""
    sentence = np.flatnonzero(ends[ids[:-1]] & opens[ids[1:]]) + 1 if len(ids) > 1 else np.zeros(0, np.int64)
    at = np.union1d(np.append(document_ends, [0, len(ids)]), sentence)
    gap = np.diff(at)
    wide = np.flatnonzero(gap > LONG)
    if len(wide):
        extra = np.concatenate([np.arange(at[w] + GRID, at[w + 1], GRID) for w in wide])
        forced = np.union1d(at, extra)
    else:
        forced = at
    cost = np.full(len(forced), FORCED)
    cost[np.searchsorted(forced, sentence)] = SENTENCE
    cost[np.searchsorted(forced, document_ends)] = 0
    cost[0] = cost[-1] = 0
    return forced, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int, final: bool) -> np.ndarray:
    """The cheapest cuts, from 0.  final: to the last possible one; else to the cheapest in the last window."""
    c, price = at.tolist(), cost.tolist()
    m = len(c)
    f, back = [0] * m, [0] * m
    queue, values, head = [0], [0], 0  # possible cuts i with rising f(i) + c(i)
    for j in range(1, m):
        here = c[j]
        least = here - length
        while c[queue[head]] < least:
            head += 1
        own = price[j] + length - here + values[head]
        f[j], back[j] = own, queue[head]
        own += here
        while len(values) > head and values[-1] >= own:
            values.pop()
            queue.pop()
        values.append(own)
        queue.append(j)
    j = m - 1
    if not final:
        first = int(np.searchsorted(at, at[-1] - length, side="right"))
        j = min(range(max(1, first), m), key=f.__getitem__)
    out = []
    while j:
        out.append(c[j])
        j = back[j]
    out.append(0)
    return np.array(out[::-1])


def _powers_of_two(start: int, end: int) -> list[int]:
    """Cuts after `start`, to `end`, at windows of falling powers of two."""
    out, left = [], end - start
    while left:
        step = 1 << (left.bit_length() - 1)
        left -= step
        out.append(end - left)
    return out


class _Packer:
    """Packs a stream of documents; add() and finish() give rows of pieces."""

    def __init__(self, length: int, ends: np.ndarray, opens: np.ndarray, first_id: int):
        self.length, self.ends, self.opens, self.sequence = length, ends, opens, first_id
        self.ids, self.docs, self.waiting = [], [], 0

    def add(self, doc_id, ids: np.ndarray):
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.waiting += len(ids)
        if self.waiting >= STRETCH:
            yield self._solve(final=False)

    def finish(self):
        if self.waiting:
            yield self._solve(final=True)

    def _solve(self, final: bool) -> dict:
        ids = np.concatenate(self.ids)
        size = np.array([d[2] for d in self.docs])
        ends = np.cumsum(size)
        at, cost = possible_cuts(ids, ends, self.ends, self.opens)
        cuts = best_cuts(at, cost, self.length, final)
        if final and cuts[-1] - cuts[-2] < self.length:
            cuts = np.append(cuts[:-1], _powers_of_two(int(cuts[-2]), int(cuts[-1])))
        used = int(cuts[-1])
        edges = np.union1d(cuts, ends[ends <= used])
        start, length = edges[:-1], np.diff(edges)
        doc = np.searchsorted(ends, start, side="right")
        window = np.searchsorted(cuts, start, side="right") - 1
        begin = ends - size
        rows = {
            "doc_id": [self.docs[d][0] for d in doc],
            "start": start - begin[doc] + np.array([self.docs[d][1] for d in doc]),
            "length": length,
            "ids": [ids[a : a + n].tobytes() for a, n in zip(start, length)],
            "doc_tokens": np.array([self.docs[d][3] for d in doc]),
            "sequence_id": self.sequence + window,
            "offset": start - cuts[window],
        }
        self.sequence += len(cuts) - 1
        k = int(np.searchsorted(ends, used, side="right"))  # the first document that isn't used up
        rest = self.docs[k:]
        if rest:
            taken = used - int(begin[k])
            rest[0] = (rest[0][0], rest[0][1] + taken, rest[0][2] - taken, rest[0][3])
        self.docs, self.ids, self.waiting = rest, [ids[used:].copy()] if rest else [], len(ids) - used
        return rows


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """A row for each piece of a document in a sequence: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids: little-endian unsigned 32-bit.  start counts the document's ids before the piece, offset the sequence's.
    """
    encoder = Encoder(vocabulary)
    kind = docs.schema["doc_id"].dataType
    rest = [*((n, pa.int64()) for n in ("start", "length")), ("ids", pa.binary()), *((n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset"))]

    def run(batches):
        from pyspark import TaskContext

        ends, opens = sentence_tables(encoder)
        packer = _Packer(length, ends, opens, TaskContext.get().partitionId() << 40)
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), *rest])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end))
                for rows in packer.add(doc_id, ids):
                    yield pa.RecordBatch.from_pydict(rows, schema)
        for rows in packer.finish():
            yield pa.RecordBatch.from_pydict(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_checksums(pieces: DataFrame) -> DataFrame:
    """The pieces with crc32 of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
