from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from graphmill.llm import substring_dedup as S
from tests.llm.common import SCHEMA, WORDS, awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    """(doc_id, kept words, n_words, n_removed) by the definition."""
    key = lambda d: (1 << 63) - 1 if d is None else d
    words = [(key(r[0]), WORD.findall(r[1] or "")) for r in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return sorted(out)


@pytest.mark.parametrize("unit", [1 << 30, 2000, 300])
def test_against_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(S, "UNIT_BYTES", unit)
    monkeypatch.setattr(S, "BUCKET_BYTES", 2 * unit)
    rows = awkward() + [(100 + i, r[1], *r[2:]) for i, r in enumerate(awkward(1)[5:12])] + [(200 + i, r[1], *r[2:]) for i, r in enumerate(awkward(2))]
    got = S.remove_repeats(documents(spark, rows).select("doc_id", "text"), joined=True).collect()
    assert sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.text or "", r.n_words, r.n_removed) for r in got) == brute(rows)


def test_many_random_documents(spark, monkeypatch):
    """Few different words, so that windows repeat by chance, too."""
    import random

    monkeypatch.setattr(S, "UNIT_BYTES", 1500)
    monkeypatch.setattr(S, "BUCKET_BYTES", 4000)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))), None, None, None, None, None, None, None, None) for i in range(120)]
    got = S.remove_repeats(documents(spark, rows).select("doc_id", "text"), joined=True).collect()
    assert sorted((r.doc_id, r.text or "", r.n_words, r.n_removed) for r in got) == brute(rows)


def thue_morse(n: int) -> str:
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


@pytest.mark.parametrize("n", [1024, 2048])
def test_long_words_that_polynomials_confuse(spark, duck, n):
    """A word and its complement, equal under polynomial hashes modulo 2**64, and very long words."""
    from graphmill.llm.queries import OP4_SQL
    from tests.compare import same

    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([word] * 13)), (2, " ".join([other] * 13)), (3, " ".join([word] * 12 + [other])), (4, " ".join([word] * 13)), (5, " ".join(["y" * 100_000 + str(i) for i in range(14)])), (6, " ".join(["y" * 100_000 + str(i) for i in range(1, 15)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.remove_repeats(docs, joined=True).collect()
    assert sorted((r.doc_id, r.text or "", r.n_words, r.n_removed) for r in got) == brute(rows)
    out = S.remove_repeats(docs, joined=True).selectExpr("doc_id", "n_words", "n_removed", "sha2(CAST(text AS BINARY), 256) AS kept_sha256")
    duck.register("long_words", docs.toPandas())
    assert same(out, duck.sql(OP4_SQL.replace("FROM documents", "FROM long_words"))) == ""


def test_null_and_repeated_ids_are_dealt_to_units(spark, monkeypatch):
    """Many rows under one id, and under none: not one unit, and right."""
    import random

    monkeypatch.setattr(S, "UNIT_BYTES", 2000)
    monkeypatch.setattr(S, "BUCKET_BYTES", 4000)
    rng = random.Random(3)
    passage = " ".join(rng.choice(WORDS) for _ in range(20))
    rows = [(None if i % 3 else 7, f"{i} {passage} " + " ".join(rng.choice(WORDS) for _ in range(20))) for i in range(60)] + [(7, passage), (3, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_unit": F.lit(111), "_bucket": F.lit("b"), "keys": F.lit(1)})
    got = S.remove_repeats(docs, joined=True)
    assert got.columns == [*docs.columns, "n_words", "n_removed"] and {(r["_unit"], r["_bucket"]) for r in got.collect()} == {(111, "b")}
    assert sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.text or "", r.n_words, r.n_removed) for r in got.collect()) == brute(rows)
    with pytest.raises(TypeError):
        S.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_stage_keeps_columns_and_white_space(spark):
    docs = documents(spark)
    out = S.remove_repeats(docs, measures=False)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text is None and rows[2].text == "   \n\t " and rows[6].text == ""
    assert rows[9].text.endswith(".\n") and rows[9].n_chars == len(rows[9].text)
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
