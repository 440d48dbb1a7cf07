"""Rule votes and measures by definition, EM over patterns against EM over documents, labels that the method never saw."""

from __future__ import annotations

import random
import re

import numpy as np

from graphmill.llm import weak_rules as W
from graphmill.llm.queries import op11_weak_supervision
from tests.llm.common import SCHEMA, awkward, documents


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeat = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeat),
        "n_stutter": sum(a == b for a, b in zip(words, words[1:])),
        "n_lines": len(lines),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_lower": len(re.findall("[a-z]", text)),
        "n_exclaimed": sum(w[-1] == "!" for w in words),
        "n_symbol_ended": sum(w[-1] in "#*$%&|<>" for w in words),
        "n_bare": sum(not re.search(r"[A-Za-z0-9\x80-\U0010ffff]", w) for w in words),
    }


def test_measures_of_awkward_and_random_texts(spark):
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "Ü!", "|", "X#", "　", "c d"]) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    texts += ["a b c d e f g h " * 3, "x y\x0bz\x0c\n x y\x0bz\x0c\r\n", "a\na", "w " * 30_000, "a\n\na\n"]
    rows = awkward() + [(100 + i, t, "en", "s", 1, 0.0, 0, 0, 0, 0) for i, t in enumerate(texts)]
    want = sorted((r[0] if r[0] is not None else -1, *measures(r[1]).values()) for r in rows)
    got = W.measured(documents(spark, rows)).collect()
    assert list(measures("")) == W.MEASURES
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[m] for m in W.MEASURES)) for r in got) == want


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(W, "window_hashes", lambda ids, size: np.zeros(max(0, len(ids) - size + 1), np.uint64))
    words = "a b c d e f g h i j a b c d e f g h z".split()
    ids = np.unique(words, return_inverse=True)[1]
    assert W.repeated_words(ids, np.array([0, 10, 19])).tolist() == [0, 0]
    assert W.repeated_words(ids, np.array([0, 19])).tolist() == [measures(" ".join(words))["n_repeat_words"]] == [16]


def test_em_over_patterns_is_em_over_documents():
    rng = np.random.default_rng(2)
    good = rng.random(900) < 0.7
    votes = np.stack([np.where(rng.random(900) < 0.3, -1, np.where(rng.random(900) < acc, good, ~good)) for acc in (0.9, 0.8, 0.85, 0.75)], 1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    by_pattern, rates, share = W.posteriors(patterns, counts.astype(float))
    by_document, rates2, share2 = W.posteriors(votes, np.ones(900))
    assert np.allclose(rates, rates2) and abs(share - share2) < 1e-9
    place = {tuple(p): g for p, g in zip(patterns.tolist(), by_pattern)}
    assert np.allclose([place[tuple(v)] for v in votes.tolist()], by_document)
    assert ((by_document >= 0.5) == good).mean() > 0.9  # better than the best rule
    assert (rates[1, :, 1] >= rates[0, :, 1]).all()


def test_a_rule_that_abstains_or_lies_decides_nothing():
    patterns = np.array([[1, 1, -1], [0, 0, -1], [1, 1, 0], [0, 0, 1]])
    good, rates, _ = W.posteriors(patterns, np.array([50.0, 40, 3, 3]))
    assert good[0] > 0.5 > good[1]
    assert rates[1, 2, 1] >= rates[0, 2, 1]


def test_labels_agree_and_clean_documents_stay(spark, sf_dir):
    rows = op11_weak_supervision(spark, sf_dir).toPandas().merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    judged = rows[~rows.base_failed]
    assert (judged.kept == (judged.quality == 1)).mean() >= 0.95
    assert judged[judged.quality == 1].kept.mean() >= 0.98
    assert not rows[rows.base_failed].kept.any()


def test_empty_table_and_too_many_rules(spark):
    assert W.judged(spark.createDataFrame([], SCHEMA)).collect() == []
    out = W.judged(documents(spark))
    assert out.count() == len(awkward()) and not [r for r in out.collect() if r["base_failed"] and r["kept"]]
    try:
        W.judged(documents(spark), {str(i): ("true", "false") for i in range(11)})
        raise AssertionError
    except ValueError:
        pass
