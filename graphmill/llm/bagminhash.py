"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A document is the multiset of its SHINGLE-word sequences.  The similarity of two is
the weighted Jaccard index, the sum of the smaller counts over the sum of the larger.

Signatures.  Weights (counts) are discretised to whole numbers and their range is cut
into dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8), ...  Each shingle has a Poisson
process on each interval, as fast as the interval is wide, seeded by shingle and
interval only.  A point has a time, a component of the signature and a place in the
interval, and counts for a document if the place is below the shingle's weight.  A
component holds the identity of its earliest point, so two documents agree on it with
probability equal to their weighted Jaccard index.  Points come in order of time and
a process ends when it passes the latest of its document's components, so a long
document costs about one point for each shingle.

Candidates.  The COMPONENTS components make BANDS bands; two documents of similarity
0.8 share none with probability 5e-8.  In each band's bucket the documents are
compared with its smallest one only, and what is similar becomes a class.  That
leaves pairs that neither of them is.  Buckets that now hold several classes are
compared again, in blocks, by signature: members of other classes than the smallest
one's against all.  Signatures that agree on LEAST_AGREEMENT of the components (five
standard deviations below the threshold) tie documents to families, and in a family of
several classes every document outside the main class is held against every other,
word for word, in blocks: one matrix product for a pair of blocks.  From a block only
the links that join classes come out, fewer than it has documents, so rows never grow
with the square of a group.

Verification counts shingles in both texts.  Links are joined to classes by connected
components.  Equal texts are one node throughout, whatever their number and ids, and a
node is a text, not a doc_id.  Cells of documents that are compared in a task are cut
by their number and by their bytes; what says how many cells a group has is a written
table, so Spark splits a group that is joined with it (skew join).

Defined cases
    Words are split at ASCII white space, unchanged.  One to four words are a single
    shingle.  Texts without words, or null, have no near copies: equal ones that
    aren't null are a class, a null is its own.  A row with a null doc_id is in no
    class.  doc_id may have any type that can be ordered.  Rows with equal doc_id and
    different texts are documents of their own, each in the class of its text.  An
    empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.textarrays import blocks, flat, free_name, mix, mix2, ranges, spans, tidy, window_hashes, within, word_hashes
from graphmill.operators.components import connected_components
from graphmill.workspace import checkpointed

SHINGLE, SIMILARITY = 5, 0.8
COMPONENTS, BANDS = 128, 32
LEAST_AGREEMENT = 0.62
#: Members compared with one copy of a bucket's smallest document; bytes of text in such a cell and in a verifying
#: task's group; bytes and documents in a block of a family; signatures in a block.
CELL, BIN_BYTES, BLOCK_BYTES, BLOCK_ROWS, SIDE = 256, 4 << 20, 2 << 20, 768, 1024
#: Most rows of ids that are broadcast to the texts (50 bytes each); more are joined by shuffle.
BROADCAST = 200_000


def shingles(buffer: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner row, hash and count of the distinct shingles of the rows, by owner and hash."""
    start, end, first = spans(buffer, offsets)
    words, n_words = word_hashes(buffer, start, end), np.diff(first)
    at = within(first, size)
    code = [window_hashes(words, size)[at] if len(at) else np.zeros(0, np.uint64)]
    owner = [np.searchsorted(first, at, side="right") - 1]
    for k in range(1, size):
        rows = np.flatnonzero(n_words == k)
        if len(rows):
            code.append(window_hashes(words, k)[first[rows]])
            owner.append(rows)
    code, owner = np.concatenate(code), np.concatenate(owner)
    order = np.argsort(code, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    code, owner = code[order], owner[order]
    cut = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))[: len(code)])
    return owner[cut], code[cut], np.diff(np.append(cut, len(code)))


def signatures(owner: np.ndarray, code: np.ndarray, count: np.ndarray, rows: int, components: int = COMPONENTS) -> np.ndarray:
    """rows x components identities (uint64); zero for rows without shingles."""
    seeds, owners, rates, shares = [code], [owner], [np.ones(len(code))], [np.ones(len(code))]
    low, width, level = 1, 1, 1
    while (more := np.flatnonzero(count > low)).size:  # the intervals [1, 2), [2, 4), ...
        seeds.append(mix2(code[more], np.full(len(more), level, np.uint64)))
        owners.append(owner[more])
        rates.append(np.full(len(more), float(width)))
        shares.append(np.minimum((count[more] - low) / width, 1.0))
        low, width, level = low + width, width * 2, level + 1
    seed, own, rate, share = (np.concatenate(x) for x in (seeds, owners, rates, shares))
    earliest = np.full(rows * components, np.inf)
    identity = np.zeros(rows * components, np.uint64)
    time, step = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)
    unit = 2.0**-53
    while len(seed):
        many = int(np.clip(8192 // len(seed), 1, 64))
        steps = step[:, None] + np.arange(1, many + 1, dtype=np.uint64)
        a = mix(seed[:, None] + steps * np.uint64(0x9E3779B97F4A7C15))
        wait = -np.log1p(-(a >> np.uint64(11)).astype(np.float64) * unit) / rate[:, None]
        times = time[:, None] + np.cumsum(wait, axis=1)
        b = mix(a ^ np.uint64(0xC2B2AE3D27D4EB4F))
        place = own[:, None] * components + ((b >> np.uint64(32)) * np.uint64(components) >> np.uint64(32)).astype(np.int64)
        counts = (b & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < share[:, None]
        place, at, ident = place[counts], times[counts], b[counts]
        np.minimum.at(earliest, place, at)
        won = at <= earliest[place]
        identity[place[won]] = ident[won]
        latest = earliest.reshape(rows, components).max(1)
        time, step = times[:, -1], steps[:, -1]
        on = time < latest[own]
        seed, own, rate, share, time, step = (x[on] for x in (seed, own, rate, share, time, step))
    return identity.reshape(rows, components)


def bands(identity: np.ndarray, n: int = BANDS) -> np.ndarray:
    """rows x n bucket keys."""
    rows, components = identity.shape
    parts = identity.reshape(rows, n, components // n)
    out = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), (rows, n)).copy()
    for k in range(parts.shape[2]):
        out = mix2(out, parts[:, :, k])
    return out


def _sign(batches):
    for batch in batches:
        buffer, offsets = flat(batch.column("text"))
        rows = len(batch)
        keys, signs, empty = np.zeros((rows, BANDS), np.uint64), np.zeros((rows, COMPONENTS), np.uint16), np.ones(rows, bool)
        for i, j in blocks(offsets):
            owner, code, count = shingles(buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(owner):
                continue
            identity = signatures(owner, code, count, j - i)
            keys[i:j], signs[i:j] = bands(identity), (identity >> np.uint64(48)).astype(np.uint16)
            empty[i + np.unique(owner)] = False
        listed = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
        sign = pa.array([signs[k].tobytes() for k in range(rows)], pa.binary(), mask=empty)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), batch.column("mark"), pa.array(np.diff(offsets)), listed, sign], ["doc_id", "digest", "mark", "bytes", "bands", "sign"])


def _verify(similarity: float):
    """A group of (centre, cell, doc, text), the centre itself among the docs of each cell -> links."""

    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        centre, cell, doc = (table.column(c).to_numpy() for c in ("centre", "cell", "doc"))
        buffer, offsets = flat(table.column("text"))
        owner, code, count = shingles(buffer, offsets)
        first = np.searchsorted(owner, np.arange(len(doc) + 1))
        total = np.bincount(owner, count, len(doc))
        order = np.lexsort((doc != centre, cell, centre))
        cut = np.flatnonzero(np.append(True, (centre[order][1:] != centre[order][:-1]) | (cell[order][1:] != cell[order][:-1]))[: len(order)])
        out_a, out_b = [], []
        for i, j in zip(cut, np.append(cut[1:], len(order))):
            rows = order[i:j]
            heads, others = rows[doc[rows] == centre[rows[0]]], rows[doc[rows] != centre[rows[0]]]
            for head in heads:
                own, weights = code[first[head] : first[head + 1]], count[first[head] : first[head + 1]]
                if not len(own) or not len(others):
                    continue
                at = ranges(first[others], first[others + 1] - first[others])
                which = np.repeat(np.arange(len(others)), first[others + 1] - first[others])
                place = np.minimum(np.searchsorted(own, code[at]), len(own) - 1)
                shared = np.where(own[place] == code[at], np.minimum(weights[place], count[at]), 0)
                both = np.bincount(which, shared, len(others))
                near = others[both >= similarity * (total[head] + total[others] - both) - 1e-9]
                out_a.append(np.full(len(near), doc[head]))
                out_b.append(doc[near])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])}, schema)

    return run


def _with_texts(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """wanted (doc, mark, ...), so many rows, with the text that has this id and hash."""
    texts = docs.select(F.col("doc_id").alias("doc"), "text").where(F.col("doc").isNotNull())
    joined = texts.join(F.broadcast(wanted) if rows <= BROADCAST else wanted, "doc")
    return joined.where(F.xxhash64("text") == F.col("mark")).drop("doc", "mark")


def _links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose texts are similar.  pairs: checkpointed (centre, node), distinct; nodes: node, doc, mark, bytes."""
    own = checkpointed(pairs.join(nodes, "node"))
    sizes = own.groupBy("centre").agg(F.ceil(F.greatest(F.count("*") / CELL, F.sum("bytes") / BIN_BYTES)).alias("_cells"))
    cells = own.join(checkpointed(sizes), "centre").withColumn("cell", F.pmod(F.xxhash64("node"), F.greatest("_cells", F.lit(1)))).drop("_cells")
    cells = checkpointed(cells)
    heads = cells.select("centre", "cell").distinct().withColumn("node", F.col("centre")).join(nodes, "node")
    wanted = checkpointed(cells.unionByName(heads))
    total = wanted.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    bins = max(1, math.ceil((total["bytes"] or 0) / BIN_BYTES))
    rows = _with_texts(docs, wanted.withColumnRenamed("node", "_node").drop("bytes"), total["n"])
    rows = rows.select("centre", "cell", F.col("_node").alias("doc"), "text", F.pmod(F.xxhash64("centre", "cell"), F.lit(bins)).alias("_bin"))
    return rows.groupBy("_bin").applyInArrow(tidy(_verify(similarity)), "a long, b long").distinct()


class _Forest:
    """Joins items 0..n-1; keeps of all links only those that join two sets."""

    def __init__(self, label: np.ndarray):
        self.root = np.unique(label, return_inverse=True)[1] if len(label) else np.zeros(0, np.int64)
        self.links: list[tuple[int, int]] = []

    def add(self, i: int, others: np.ndarray) -> None:
        roots, at = np.unique(self.root[others], return_index=True)
        for root, k in zip(roots, others[at]):
            if root != self.root[i]:
                self.links.append((i, int(k)))
                self.root[self.root == root] = self.root[i]


def _cells(table: pa.Table, names: list[str]):
    """Row indices of each cell of a task's group."""
    keys = [table.column(c).to_numpy() for c in names]
    order = np.lexsort(keys[::-1])
    cut = np.flatnonzero(np.append(True, np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0))[: len(order)])
    for i, j in zip(cut, np.append(cut[1:], len(order))):
        yield order[i:j]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(pairs: set[tuple[int, int]]) -> pa.Table:
    pairs = sorted(pairs)
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())}, _LINKS)


def _tie(table: pa.Table) -> pa.Table:
    """Cells (bucket, i, j) of documents (outside, node, label, sign) -> links that tie near signatures of different classes."""
    outside, node, label = (table.column(c).to_numpy(zero_copy_only=False) for c in ("outside", "node", "label"))
    sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint16).reshape(len(node), -1)
    least = math.ceil(LEAST_AGREEMENT * sign.shape[1])
    out = set()
    for rows in _cells(table, ["bucket", "i", "j"]):
        left, right = np.flatnonzero(outside[rows]), np.flatnonzero(~outside[rows])
        forest = _Forest(label[rows])
        signs = sign[rows]
        for at in range(0, len(left), 16):
            some = left[at : at + 16]
            near = (signs[some][:, None] == signs[right][None]).sum(2) >= least
            for x, k in enumerate(some):
                forest.add(k, right[near[x]])
        out |= {(int(node[rows[i]]), int(node[rows[k]])) for i, k in forest.links}
    return _linked(out)


def _hold(similarity: float):
    """Cells (family, i, j) of documents (outside, node, label, text) -> links that join similar ones of different classes."""

    def run(table: pa.Table) -> pa.Table:
        outside, node, label = (table.column(c).to_numpy(zero_copy_only=False) for c in ("outside", "node", "label"))
        buffer, offsets = flat(table.column("text"))
        owner, code, count = shingles(buffer, offsets)
        # The n-th occurrence of a shingle is an element of its own, so smaller counts add up to common elements.
        nth = ranges(np.zeros(len(count), np.int64), count).astype(np.uint64)
        code, owner = mix2(np.repeat(code, count), nth), np.repeat(owner, count)
        total = np.bincount(owner, minlength=len(node))
        first = np.searchsorted(owner, np.arange(len(node) + 1))
        out = set()
        for rows in _cells(table, ["family", "i", "j"]):
            left, right = np.flatnonzero(outside[rows]), np.flatnonzero(~outside[rows])
            if not len(left) or not len(right):
                continue
            own, other = rows[left], rows[right]
            l_at = ranges(first[own], first[own + 1] - first[own])
            r_at = ranges(first[other], first[other + 1] - first[other])
            common = np.intersect1d(code[l_at], code[r_at])
            both = np.zeros((len(left), len(right)))
            l_row, r_row = np.repeat(np.arange(len(left)), first[own + 1] - first[own]), np.repeat(np.arange(len(right)), first[other + 1] - first[other])
            l_col, r_col = np.searchsorted(common, code[l_at]), np.searchsorted(common, code[r_at])
            l_in = (l_col < len(common)) & (common[np.minimum(l_col, len(common) - 1)] == code[l_at]) if len(common) else np.zeros(len(l_at), bool)
            r_in = (r_col < len(common)) & (common[np.minimum(r_col, len(common) - 1)] == code[r_at]) if len(common) else np.zeros(len(r_at), bool)
            for at in range(0, len(common), 2048):
                l_own, r_own = l_in & (l_col >= at) & (l_col < at + 2048), r_in & (r_col >= at) & (r_col < at + 2048)
                x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
                x[l_row[l_own], l_col[l_own] - at] = 1
                y[r_row[r_own], r_col[r_own] - at] = 1
                both += x @ y.T
            near = both * (1 + similarity) >= similarity * (total[own][:, None] + total[other][None]) - 1e-3
            near &= both > 0
            forest = _Forest(label[rows])
            for x, k in enumerate(left):
                forest.add(k, right[near[x]])
            out |= {(int(node[rows[i]]), int(node[rows[k]])) for i, k in forest.links}
        return _linked(out)

    return run


def _in_cells(rows: DataFrame, key: str, left: DataFrame) -> DataFrame:
    """Rows (key, node, label, main) in cells (key, i, j): i of the documents outside the main class, j of all.

    left: key, ni, nj, the numbers of blocks.  A document outside stands in its own i with every j, and as one of all
    in its own j with every i; so do the others in the latter way.
    """
    rows = rows.join(checkpointed(left), key)
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    own = rows.where(F.col("label") != F.col("main")).select(key, "node", "label", F.lit(True).alias("outside"), block("ni").alias("i"), every("nj").alias("j"))
    other = rows.select(key, "node", "label", F.lit(False).alias("outside"), every("ni").alias("i"), block("nj").alias("j"))
    return own.unionByName(other)


def _ties(shared: DataFrame, signs: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between documents of different classes that share a bucket and have near signatures.

    shared: bucket, node, centre.  A bucket's main class is that of its smallest document.
    """
    rows = shared.join(labels, "node", "left").select("bucket", "node", (F.col("node") != F.col("centre")).alias("_far"), F.coalesce("component", "node").alias("label"))
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("label", "_far").alias("main"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 and low <> high").select("bucket", "n", "main")
    rows = checkpointed(rows.drop("_far").join(checkpointed(mixed), "bucket"))
    blocks_of = rows.groupBy("bucket").agg(F.ceil(F.count_if(F.col("label") != F.col("main")) / SIDE).alias("ni"), F.ceil(F.count("*") / SIDE).alias("nj"))
    cells = checkpointed(_in_cells(rows.drop("n"), "bucket", blocks_of))
    bins = max(1, math.ceil(cells.count() / (8 * SIDE)))
    cells = cells.join(signs, "node").withColumn("_bin", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(bins)))
    return cells.groupBy("_bin").applyInArrow(tidy(_tie), "a long, b long").distinct()


def _held(docs: DataFrame, nodes: DataFrame, ties: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """True links between classes of a family.  ties: links between near signatures; nodes: node, doc, mark, bytes."""
    named = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    between = ties.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    families = checkpointed(connected_components(between, "a", "b"))  # of classes
    classes_of = labels.select("node", F.col("component").alias("label")).unionByName(families.select(F.col("node"), F.col("node").alias("label")).join(labels, "node", "left_anti"))
    rows = classes_of.join(families.select(F.col("node").alias("label"), F.col("component").alias("family")), "label").select("family", "node", "label")
    rows = checkpointed(rows.join(nodes.select("node", "bytes"), "node"))
    main = rows.groupBy("family", "label").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rows = rows.join(checkpointed(main), "family")
    outside = F.col("label") != F.col("main")
    needed = lambda n, size: F.ceil(F.greatest(n / BLOCK_ROWS, size / BLOCK_BYTES))
    blocks_of = rows.groupBy("family").agg(needed(F.count_if(outside), F.sum(F.when(outside, F.col("bytes")))).alias("ni"), needed(F.count("*"), F.sum("bytes")).alias("nj"))
    cells = checkpointed(_in_cells(rows.drop("bytes"), "family", blocks_of).join(nodes, "node"))
    total = cells.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    bins = max(1, math.ceil((total["bytes"] or 0) / BIN_BYTES))
    held = _with_texts(docs, cells.drop("bytes"), total["n"]).withColumn("_bin", F.pmod(F.xxhash64("family", "i", "j"), F.lit(bins)))
    return held.groupBy("_bin").applyInArrow(tidy(_hold(similarity)), "a long, b long").distinct()


def _digest() -> Column:
    """What tells a text from every other one; null for a null text."""
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _classified(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, digest, first of every row: first is the (doc_id, digest) that comes first in the row's class.

    Null where the row has no doc_id or no text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("doc_id", "text", _digest().alias("digest"), F.xxhash64("text").alias("mark"))
    signed = checkpointed(signed.mapInArrow(tidy(_sign), f"doc_id {kind}, digest binary, mark long, bytes long, bands array<long>, sign binary"))
    named = signed.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    # One row for each text: mark, bytes, bands and sign are functions of the text.
    texts = named.groupBy("digest").agg(F.min("doc_id").alias("doc"), *(F.any_value(c).alias(c) for c in ("mark", "bytes", "bands", "sign")))
    texts = checkpointed(texts.sortWithinPartitions("digest").withColumn("node", F.monotonically_increasing_id()))
    nodes = texts.select("node", "doc", "mark", "bytes")
    if not named.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        docs = docs.select("doc_id", "text").dropDuplicates()  # so that a row that is there many times is compared once

    buckets = texts.where(F.col("sign").isNotNull()).select("node", "doc", F.explode("bands").alias("bucket"))
    centres = buckets.groupBy("bucket").agg(F.min(F.struct("doc", "node")).alias("least"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("least.node").alias("centre"))
    buckets = buckets.drop("doc")
    shared = checkpointed(buckets.join(checkpointed(centres), "bucket"))
    pairs = checkpointed(shared.where("node <> centre").select("centre", "node").distinct())
    labels = checkpointed(connected_components(_links(docs, pairs, nodes, similarity), "a", "b"))
    ties = checkpointed(_ties(shared, texts.select("node", "sign"), labels))
    if not ties.isEmpty():
        more = checkpointed(_held(docs, nodes, ties, labels, similarity))
        if not more.isEmpty():
            labels = checkpointed(_merged(labels, more))
    own = checkpointed(texts.select("node", "doc", "digest").join(labels, "node", "left").select("doc", "digest", F.coalesce("component", "node").alias("component")))
    firsts = own.groupBy("component").agg(F.min(F.struct(F.col("doc").alias("doc_id"), "digest")).alias("first"))
    found = checkpointed(own.join(checkpointed(firsts), "component").select("digest", "first"))
    row = signed.select("doc_id", "digest").join(found, "digest", "left")
    return row.select("doc_id", "digest", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id of every row; class_id is the smallest doc_id of the row's class."""
    return _classified(docs, similarity).select("doc_id", F.coalesce(F.col("first.doc_id"), F.col("doc_id")).alias("class_id"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after links (a, b) have joined classes; a node without a label is its own."""
    named = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    between = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    moved = checkpointed(connected_components(between, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("_to")))
    known = labels.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    fresh = moved.select(F.col("component").alias("node"), F.col("_to").alias("component")).join(labels, "node", "left_anti")
    return known.unionByName(fresh)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class: that with the smallest doc_id (of texts with equal ids, the smallest digest).

    Rows equal in doc_id and text are one document; which of them stays is open.  Rows with a null doc_id or text stay.
    """
    found = checkpointed(_classified(docs, similarity).where(F.col("first").isNotNull()))
    key = [free_name(docs, "_digest"), "doc_id"]
    named = lambda rows: rows.select(F.col("digest").alias(key[0]), "doc_id")
    first = F.col("first") == F.struct("doc_id", "digest")
    gone = checkpointed(named(found.where(~first)).distinct())
    kept = docs.withColumn(key[0], _digest()).join(_small(gone), key, "left_anti")
    repeated = checkpointed(named(found.where(first)).groupBy(*key).count().where("count > 1").drop("count"))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(_small(repeated), key, "left_anti")
    return once.unionByName(kept.join(_small(repeated), key, "left_semi").dropDuplicates(key)).select(docs.columns)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids
