"""Quality rules by weak supervision.

Every rule votes that a document is good or bad, or abstains; no rule decides alone.  The votes of all documents are
counted by pattern (at most 3 ** MOST_RULES of them, whatever the corpus), and expectation-maximisation over these counts
estimates the share of good documents and, for each rule, how often it votes each way on good and on bad ones: the
same estimates as over all documents one by one.  A document's posterior probability of being good is then its
pattern's; it is kept from 0.5 on.  The first guess calls a document bad if any rule does; a rule starts from what it
says of these two parts, with SMOOTHING votes of each kind added, and never gets to prefer bad documents: a rule whose
vote would turn round is left at even odds.

The measures are taken in one pass over the texts and written without them.

Defined cases
    A null text is an empty one: it has no words and fails the base.  Repeated rows are judged each; equal texts get
    equal verdicts.  Texts of any length are read whole.  doc_id may be null or of any plain type.  Measures that rules
    divide by may be zero: the rules abstain then.  An empty table gives no rows.  Columns besides doc_id and text are
    not read, whatever their names.  Equal windows are told by their words, not by hashes alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.textarrays import SPACE, blocks, flat, mix, numbered, ranges, spans, tidy, window_hashes, within
from graphmill.workspace import checkpointed

#: Words of a window that may repeat.
WINDOW = 8
#: Good and bad conditions of each rule; where neither holds, it abstains.
RULES = {
    "length": ("n_words >= 40", "n_words < 20"),
    "word_length": ("word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "8 * n_symbols > n_words"),
    "lines": ("20 * n_dup_lines <= n_lines", "3 * n_dup_lines > n_lines"),
    "repeats": ("20 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    "stutter": ("50 * n_stutter <= n_words", "5 * n_stutter > n_words"),
    "capitals": ("4 * n_upper <= n_lower", "n_upper > n_lower"),
    "exclamations": ("20 * n_exclaimed <= n_words", "3 * n_exclaimed > n_words"),
    "endings": ("50 * n_symbol_ended <= n_words", "5 * n_symbol_ended > n_words"),
    "bare_words": ("20 * n_bare <= n_words", "5 * n_bare > n_words"),
}
#: Most rules, so that the patterns of votes are bounded.
MOST_RULES = 10
ROUNDS, SMOOTHING = 100, 1.0

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter", "n_lines", "n_upper", "n_lower", "n_exclaimed", "n_symbol_ended", "n_bare"]
_TRIM = " \t\n\v\f\r"


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _bytes(b"#*$%&|<>")
_UPPER, _LOWER = _bytes(bytes(range(0x41, 0x5B))), _bytes(bytes(range(0x61, 0x7B)))
_ALNUM = _UPPER | _LOWER | _bytes(bytes(range(0x30, 0x3A))) | _bytes(bytes(range(0x80, 0x100)))


def _before(mask: np.ndarray) -> np.ndarray:
    """Number of true values before each place."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def repeated_words(ids: np.ndarray, first: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each row, its words within windows that stand twice or more in it; first: where each row's words begin."""
    at = within(first, size)
    if not len(at):
        return np.zeros(len(first) - 1, np.int64)
    row = np.searchsorted(first, at, side="right") - 1
    hashes = window_hashes(mix(ids.astype(np.uint64)), size)[at]
    order = np.lexsort((at, hashes, row))
    a, b = order[:-1], order[1:]
    same = (row[a] == row[b]) & (hashes[a] == hashes[b])
    pairs = np.flatnonzero(same)
    alike = (ids[ranges(at[a[pairs]], np.full(len(pairs), size))] == ids[ranges(at[b[pairs]], np.full(len(pairs), size))]).reshape(-1, size).all(1)
    covered = np.zeros(len(ids) + size + 1, np.int64)
    twice = np.zeros(len(at), bool)
    twice[a[pairs[alike]]] = twice[b[pairs[alike]]] = True
    for r in np.unique(row[a[pairs[~alike]]]):  # different windows have one hash: compare this row's by their words
        own = np.flatnonzero(row == r)
        seen: dict[bytes, list[int]] = {}
        for i in own:
            seen.setdefault(ids[at[i] : at[i] + size].tobytes(), []).append(i)
        twice[own] = False
        for places in seen.values():
            twice[places] = len(places) > 1
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + size, -1)
    inside = _before(np.cumsum(covered)[: len(ids)] > 0)
    return inside[first[1:]] - inside[first[:-1]]


def _duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row, its lines with a word that equal an earlier one, and its lines with a word."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    worded = pc.not_equal(pc.ascii_trim(lines.dictionary, _TRIM), "").to_numpy(zero_copy_only=False)
    ids, sizes = lines.indices.to_numpy(), np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(texts)), sizes)
    row, ids = row[worded[ids]], ids[worded[ids]].astype(np.int64)
    distinct = np.unique(row * max(1, len(worded)) + ids) // max(1, len(worded))
    total = np.bincount(row, minlength=len(texts))
    return total - np.bincount(distinct, minlength=len(texts)), total


def _measured(texts: pa.Array, buffer: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    start, end, first = spans(buffer, offsets)
    ids, _ = numbered(buffer, start, end)
    by_row = lambda mask: np.diff(_before(mask)[offsets])
    by_word = lambda mask: np.diff(_before(mask)[first])
    again = np.append(False, ids[1:] == ids[:-1])[: len(ids)]  # as the word before, in the same row
    again[first[:-1][first[:-1] < len(ids)]] = False
    dup, lines = _duplicate_lines(texts)
    alnum = _before(_ALNUM[buffer])
    return [
        np.diff(first),
        by_row(((buffer & 0xC0) != 0x80) & ~SPACE[buffer]),
        by_row(_SYMBOL[buffer]),
        dup,
        repeated_words(ids, first),
        by_word(again),
        lines,
        by_row(_UPPER[buffer]),
        by_row(_LOWER[buffer]),
        by_word(buffer[end - 1] == 0x21),
        by_word(_SYMBOL[buffer[end - 1]]),
        by_word(alnum[end] == alnum[start]),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every row."""

    @tidy
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            buffer, offsets = flat(texts)
            for a, b in blocks(offsets):
                columns = _measured(texts.slice(a, b - a), buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def votes(rules: dict[str, tuple[str, str]] = RULES) -> Column:
    """The votes of the rules as one array: 1 good, 0 bad, -1 neither."""
    return F.array(*(F.when(F.expr(bad), 0).when(F.expr(good) & (F.col("n_words") > 0), 1).otherwise(-1) for good, bad in rules.values()))


def posteriors(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that each pattern's documents are good; rates[y, rule, vote] and the share of good ones that EM found.

    patterns: a row of votes for each pattern; y and vote: 1 good, 0 bad.
    """
    said = np.stack([patterns == 0, patterns == 1], 2).astype(float)
    good = np.where((patterns == 0).any(1), 0.0, 1.0)
    for _ in range(ROUNDS):
        weight = np.stack([(1 - good) * counts, good * counts])
        rates = np.einsum("yp,pjv->yjv", weight, said) + SMOOTHING
        rates /= rates.sum(2, keepdims=True)
        turned = rates[1, :, 1] < rates[0, :, 1]
        rates[:, turned] = rates[:, turned].mean(0, keepdims=True)
        share = np.clip((weight[1].sum() + SMOOTHING) / (weight.sum() + 2 * SMOOTHING), 1e-6, 1 - 1e-6)
        odds = np.log(share / (1 - share)) + np.einsum("pjv,jv->p", said, np.log(rates[1]) - np.log(rates[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved, good = np.abs(new - good).max(initial=0), new
        if moved < 1e-9:
            break
    return good, rates, float(share)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """doc_id, MEASURES, votes, posterior, base_failed, kept of every row."""
    if not 0 < len(rules) <= MOST_RULES:
        raise ValueError(f"between 1 and {MOST_RULES} rules")
    rows = checkpointed(measured(docs).withColumn("votes", votes(rules)))
    seen = rows.groupBy("votes").count().orderBy("votes").collect()  # at most 3 ** MOST_RULES rows
    patterns = np.array([r["votes"] for r in seen], np.int64).reshape(len(seen), len(rules))
    good, _, _ = posteriors(patterns, np.array([r["count"] for r in seen], float))
    table = rows.sparkSession.createDataFrame([(p.tolist(), float(g)) for p, g in zip(patterns, good)], "votes array<int>, posterior double")
    out = rows.join(F.broadcast(table), "votes").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
