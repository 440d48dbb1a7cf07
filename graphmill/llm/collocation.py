"""Collocations: phrases of two and three words, counted in HAT-tries and ranked by how firmly they hold together.

A task cuts its texts to words, numbers the words it meets, and counts the three words from each place on in a trie
of each language: a container is a hash table of whole keys; one that grows over BURST entries bursts into FAN containers
by its keys' first word, and those by the second, so that rare words share a container and a common prefix gets its own.
When a task's tries hold SPILL entries, their largest subtrees leave as sorted runs.  A run is dealt to cells by a hash of language and first two words, the prefix, so that a
prefix's counts meet in one cell and a common first word is spread over many.  A cell's runs are merged to exact counts:
of three words, and by summing over the third of two.  Single words travel as runs of their own.

The counts that reach `least` are a table in the shared folder; the scores are joins over it.  A part of a phrase is
at least as frequent as the phrase, so no count that a score needs is lost.

Words: A-Z is lower-cased, the text is split into pieces at .,;:!? and 0x0A to 0x0D, pieces into words at spaces and
tabs.  A phrase stands within a piece.  Cutting a phrase of a occurrences into parts of l and r occurrences scores
floor(1000000 a a / (l r)), in decimals of 38 digits; the lowest cut counts, the earlier among equal ones.  A phrase goes
if its words stand within a longer candidate that has at least `share` per cent of its occurrences.

Defined cases
    A null text has no words; a null lang is `und`, together with rows that say so.  Repeated rows and rows with one
    doc_id count each; doc_id isn't read.  Very long texts are read whole.  Words of any length are kept as they are.
    Equal scores go by the larger count, then by the phrase in order of its UTF-8 bytes.  A language without a candidate
    has no rows.  An empty table gives no rows.  Columns besides text and lang are not read, whatever their names.
    Counts are exact as long as a language's words number under 10 ** 16.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.textarrays import blocks, flat, mix2, numbered, spans, tidy, word_hashes
from graphmill.workspace import checkpointed

#: Entries of a container before it bursts; entries of a task's tries before subtrees leave.
BURST, SPILL = 16_384, 1_000_000
#: Children of a container that has burst: a word goes to the one of its number's remainder.
FAN = 64
#: Words, and bytes of words, that a task numbers before it empties its tries and begins anew.
VOCABULARY, VOCABULARY_BYTES = 400_000, 32 << 20
#: Cells a shuffle partition: a merging task holds one cell at a time.  A task sends a row to a cell at most for each spill.
CELLS = 4
#: Bits of a word's number in a key of three.
BITS = 21
MASK = (1 << BITS) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SEPARATOR = _PIECE.copy()
_SEPARATOR[[0x20, 0x09]] = True
_RUN = pa.struct([("lang", pa.string()), ("words", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])
_RUNS = pa.schema([("cell", pa.int32()), ("runs", pa.list_(_RUN))])
_COUNTED = pa.schema([("lang", pa.string()), ("first", pa.string()), ("second", pa.string()), ("third", pa.string()), ("n", pa.int64())])


class Trie:
    """Counts of keys, three word ids each: a container until it bursts, then children that each take a share of the next ids."""

    __slots__ = ("depth", "entries", "children", "size")

    def __init__(self, depth: int = 0):
        self.depth, self.entries, self.children, self.size = depth, {}, None, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys are distinct."""
        if self.children is None:
            entries = self.entries
            for key, n in zip(keys.tolist(), counts.tolist()):
                entries[key] = entries.get(key, 0) + n
            self.size = len(entries)
            if self.size > BURST and self.depth < 2:
                self._burst()
            return
        child = (keys >> BITS * (2 - self.depth) & MASK) % FAN
        order = np.argsort(child, kind="stable")
        keys, counts, cuts = keys[order], counts[order], np.searchsorted(child[order], np.arange(FAN + 1))
        for k, node in enumerate(self.children):
            if cuts[k] < cuts[k + 1]:
                node.add(keys[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]])
        self.size = sum(node.size for node in self.children)

    def _burst(self) -> None:
        keys, counts = self.taken()
        self.children = [Trie(self.depth + 1) for _ in range(FAN)]
        self.add(keys, counts)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys and counts, in no order; the trie is empty afterwards."""
        if self.children is None:
            n = len(self.entries)
            out = np.fromiter(self.entries.keys(), np.int64, n), np.fromiter(self.entries.values(), np.int64, n)
            self.entries, self.size = {}, 0
            return out
        parts = [child.taken() for child in self.children]
        self.children, self.size = None, 0
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def spilled(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """What the largest subtrees hold, taken out whole until `most` entries are left."""
        if self.children is None:
            return self.taken()
        parts = []
        for child in sorted(self.children, key=lambda c: -c.size):
            if self.size <= most:
                break
            self.size -= child.size
            parts.append(child.taken())
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class _Counter:
    """A task's words and tries."""

    def __init__(self, cells: int):
        self.cells, self.tries = cells, {}
        self._anew()

    def _anew(self) -> None:
        self.ids, self.bytes, self.single = {}, 0, {}

    def add(self, lang: str, buffer: np.ndarray, offsets: np.ndarray):
        """Counts the texts; yields the runs that leave."""
        low = _LOWER[buffer]
        start, end, first = spans(low, offsets, _SEPARATOR)
        if not len(start):
            return
        indices, words = numbered(low, start, end, _SEPARATOR)
        if len(self.ids) + len(words) > VOCABULARY or self.bytes > VOCABULARY_BYTES:
            yield from self.rest()
        new = words.to_pylist()
        known = len(self.ids)
        ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in new], np.int64)
        self.bytes += sum(len(w) for w, i in zip(new, ids.tolist()) if i > known)
        ids = ids[indices]

        before = np.zeros(len(low) + 1, np.int32)
        np.cumsum(_PIECE[low], out=before[1:])
        joined = np.append(before[start[1:]] == before[end[:-1]], False)  # whether the next word is of the same piece
        ends = first[1:-1]
        joined[ends[(ends > 0) & (ends < len(start))] - 1] = False
        second = np.where(joined, np.append(ids[1:], 0), 0)
        third = np.where(joined, np.append(second[1:], 0), 0)
        keys, counts = np.unique(ids << 2 * BITS | second << BITS | third, return_counts=True)
        self.tries.setdefault(lang, Trie()).add(keys, counts)

        have, now = self.single.get(lang), np.bincount(ids)
        if have is not None and len(have) >= len(now):
            have[: len(now)] += now
        else:
            now[: 0 if have is None else len(have)] += 0 if have is None else have
            self.single[lang] = now
        if sum(t.size for t in self.tries.values()) > SPILL:
            yield from self._runs({name: t.spilled(0 if t.size < SPILL // 8 else t.size // 2) for name, t in self.tries.items() if t.size}, {})

    def rest(self):
        """Everything that is left, as runs."""
        yield from self._runs({name: t.taken() for name, t in self.tries.items() if t.size}, self.single)
        self._anew()

    def _runs(self, tries: dict, single: dict):
        if not tries and not single:
            return
        words = list(self.ids)  # in order of their ids, from 1
        size = np.array([0, *map(len, words)], np.int64)
        at = np.cumsum(size)
        buffer = np.frombuffer(b"".join(words), np.uint8)
        hashes = word_hashes(buffer, at - size, at)
        rank = np.zeros(len(words) + 1, np.int64)
        text = pa.array([b"", *words], pa.binary())
        rank[pc.array_sort_indices(text).to_numpy()] = np.arange(len(words) + 1)
        runs: dict[int, list[dict]] = {}
        for lang, (keys, counts) in tries.items():
            order = np.argsort(rank[keys >> 2 * BITS] << 2 * BITS | rank[keys >> BITS & MASK] << BITS | rank[keys & MASK])
            keys, counts = keys[order], counts[order]
            first, second = keys >> 2 * BITS, keys >> BITS & MASK
            phrases = pc.binary_join_element_wise(text.take(pa.array(first)), text.take(pa.array(second)), text.take(pa.array(keys & MASK)), b" ")
            self._cut(runs, lang, 3, mix2(hashes[first], hashes[second]), phrases, counts)
        for lang, counts in single.items():
            ids = np.flatnonzero(counts)
            ids = ids[np.argsort(rank[ids])]
            self._cut(runs, lang, 1, hashes[ids], text.take(pa.array(ids)), counts[ids])
        yield pa.RecordBatch.from_arrays([pa.array(runs.keys(), pa.int32()), pa.array(runs.values(), pa.list_(_RUN))], schema=_RUNS)

    def _cut(self, runs: dict, lang: str, words: int, prefix: np.ndarray, phrases: pa.Array, counts: np.ndarray) -> None:
        """Adds what each cell gets of a language's phrases, in order."""
        own = np.full(len(prefix), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
        cell = (mix2(prefix, own) % np.uint64(self.cells)).astype(np.int32)
        order = np.argsort(cell, kind="stable")
        cell, phrases, counts = cell[order], phrases.take(pa.array(order)), counts[order].astype("<i8")
        cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), phrases), b"\n")
        packed = zstandard.ZstdCompressor(level=3).compress
        for c, x, a, b in zip(cell[cuts[:-1]].tolist(), lines.to_pylist(), cuts[:-1], cuts[1:]):
            runs.setdefault(c, []).append({"lang": lang, "words": words, "phrases": packed(x), "counts": packed(counts[a:b].tobytes())})


def _count(cells: int):
    @tidy
    def run(batches):
        counter = _Counter(cells)
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                buffer, offsets = flat(batch.column("text").filter(pc.equal(langs.indices, i)))
                for a, b in blocks(offsets, 2 << 20):
                    yield from counter.add(lang, buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield from counter.rest()

    return run


def _merged(table: pa.Table, words: int) -> tuple[pa.Array, pa.Array]:
    """Distinct phrases of some runs and their counts."""
    table = table.filter(pc.equal(table["words"], words))
    unpacked = zstandard.ZstdDecompressor().decompress
    lines = [unpacked(x) for x in table["phrases"].to_pylist()]
    if not lines:
        return pa.array([], pa.large_string()), pa.array([], pa.int64())
    phrases = pc.split_pattern(pa.array([b"\n".join(lines).decode()], pa.large_string()), "\n").flatten()
    counts = pa.array(np.frombuffer(b"".join(unpacked(x) for x in table["counts"].to_pylist()), "<i8"))
    out = pa.table({"p": phrases, "n": counts}).group_by("p").aggregate([("n", "sum")]).combine_chunks()
    return out["p"].combine_chunks(), out["n_sum"].combine_chunks()


def _merge(least: int):
    @tidy
    def run(table):
        out = []
        table = pa.Table.from_struct_array(table["runs"].combine_chunks().flatten())

        def found(lang, n, *words):
            size = len(n)
            columns = [pa.array([lang] * size, pa.string()), *(w.cast(pa.string()) for w in words), *(pa.nulls(size, pa.string()) for _ in range(3 - len(words))), n]
            out.append(pa.Table.from_arrays(columns, schema=_COUNTED))

        for lang in pc.unique(table["lang"]).to_pylist():
            own = table.filter(pc.equal(table["lang"], lang))
            words, n = _merged(own, 1)
            if len(words):
                found(lang, pa.array([pc.sum(n).as_py()], pa.int64()))
                often = pc.greater_equal(n, least)
                found(lang, n.filter(often), words.filter(often))
            phrases, n = _merged(own, 3)
            if not len(phrases):
                continue
            parts = pc.split_pattern(phrases, " ").flatten()
            first, second, third = (parts.take(pa.array(np.arange(k, len(parts), 3))) for k in range(3))
            often = pc.and_(pc.greater_equal(n, least), pc.not_equal(third, ""))
            found(lang, n.filter(often), first.filter(often), second.filter(often), third.filter(often))
            pairs = pa.table({"a": first, "b": second, "n": n}).filter(pc.not_equal(second, "")).group_by(["a", "b"]).aggregate([("n", "sum")])
            pairs = pairs.filter(pc.greater_equal(pairs["n_sum"], least)).combine_chunks()
            if len(pairs):
                found(lang, *(pairs[c].combine_chunks() for c in ("n_sum", "a", "b")))
        return pa.concat_tables(out).combine_chunks() if out else _COUNTED.empty_table()

    return run


def counted(docs: DataFrame, least: int = 10) -> DataFrame:
    """lang, first, second, third, n of the words and phrases that occur `least` times, unused words null.

    Besides, with three nulls, parts of the number of all words of a language.
    """
    cells = CELLS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    runs = texts.mapInArrow(_count(cells), "cell int, runs array<struct<lang string, words int, phrases binary, counts binary>>")
    return checkpointed(runs.groupBy("cell").applyInArrow(_merge(least), "lang string, first string, second string, third string, n long"))


def _score(a: str, left: str, right: str) -> Column:
    a, left, right = (f"CAST({x} AS DECIMAL(19, 0))" for x in (a, left, right))
    return F.expr(f"(1000000 * {a} * {a}) DIV ({left} * {right})")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language."""
    found = counted(docs, least)
    total = found.where("first IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    one = found.where("first IS NOT NULL AND second IS NULL").select("lang", "first", "n")
    two = found.where("second IS NOT NULL AND third IS NULL").select("lang", "first", "second", "n")
    three = found.where("third IS NOT NULL").withColumnRenamed("n", "a")

    def with_count(rows: DataFrame, counts: DataFrame, name: str, *words: str) -> DataFrame:
        columns = zip(("first", "second"), words)
        return rows.join(counts.select("lang", *(F.col(c).alias(w) for c, w in columns), F.col("n").alias(name)), ["lang", *words])

    inside = F.explode(F.array(*(F.struct(F.col(x).alias("first"), F.col(y).alias("second")) for x, y in (("first", "second"), ("second", "third")))))
    longer = three.select("lang", "a", inside.alias("p")).groupBy("lang", "p.first", "p.second").agg(F.max("a").alias("longer"))
    pairs = two.withColumnRenamed("n", "a").join(longer, ["lang", "first", "second"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
    pairs = with_count(with_count(pairs, one, "l", "first"), one, "r", "second").withColumn("score", _score("a", "l", "r"))

    triples = with_count(with_count(three, one, "l1", "first"), two, "r1", "second", "third")
    triples = with_count(with_count(triples, two, "l2", "first", "second"), one, "r2", "third")
    triples = triples.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    triples = triples.withColumns({c: F.when(early, F.col(f"{x}1")).otherwise(F.col(f"{x}2")) for c, x in (("l", "l"), ("r", "r"), ("score", "s"))})

    rows = pairs.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", "l", "r", "score")
    rows = rows.unionByName(triples.select("lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", "l", "r", "score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The first of each of 64 parts of a language, then of these, so that a language isn't sorted by one task.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    heads = rows.withColumn("_in", F.row_number().over(part)).where(F.col("_in") <= top).drop("_in")
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
