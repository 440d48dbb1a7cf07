"""Registered text queries read whole texts and all rows."""

from __future__ import annotations

import re

import pytest

from graphmill.plans import QUERIES

LONG = "small words begin this text and \n\n" + "filler " * 40 + "extraordinarily abcxyz unbelievable late"

PAGES = [0, 3, 4, 5, 5000, 5001, 10000, 10001, 64101, 100000, 1234567]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")

    write("documents", [(1, LONG, "en", "s"), (2, "\nsecond line only", "en", "s"), (3, None, "en", "s")], "doc_id long, text string, lang string, source string")
    write("benchmark", [(1, LONG), (2, "two words"), (3, "one"), (4, "")], "item_id long, text string")
    write("pages", [(i, f"u{i}", "h") for i in PAGES], "page_id long, url string, html string")
    write("labels", [(3,), (4,)], "doc_id long")
    write("part", [(k, k, "Brand#1") for k in range(1, 51)] + [(51, None, "Brand#1")], "p_partkey long, p_size int, p_brand string")
    return str(path)


def keywords(text, least):
    return sorted(dict.fromkeys(re.findall(f"[a-z]{{{least},}}", text.lower())), key=lambda w: -len(w))[:8]


def grams(w):
    return ["".join(w[i : i + n]) for n in (2, 3) for i in range(min(5, len(w) - n + 1))]


def test_half_width_folds_the_whole_text(spark, folder):
    got = {r.doc_id: r.folded for r in QUERIES["half_width"](spark, folder).collect()}
    assert got == {1: LONG.translate(str.maketrans("abcxyz", "ABCXYZ")), 2: "\nseCond line onlY", 3: None}


def test_ngrams_and_expansion_of_eight_keywords(spark, folder):
    texts = {1: LONG, 2: "two words", 3: "one", 4: ""}
    got = {r.item_id: r.grams for r in QUERIES["ngrams"](spark, folder).collect()}
    assert got == {i: " ".join(grams(keywords(t, 3))) for i, t in texts.items()} and "unbelievable" in got[1]
    got = {r.item_id: r.terms for r in QUERIES["query_expand"](spark, folder).collect()}
    assert got == {i: " ".join(dict.fromkeys([*keywords(t, 5), *grams(keywords(t, 5)), "extra"])) for i, t in texts.items()}


def test_entities_of_every_chunk(spark, folder):
    got = {(r.doc_id, r.sequence): r.entities for r in QUERIES["chunk_entities"](spark, folder).collect()}
    assert got == {(1, 1): "begin,small,text,this,words", (1, 3): "abcxyz,extraordinarily,filler,late,unbelievable", (2, 2): "line,only,second"}


def test_hints_of_every_page(spark, folder):
    got = {r.page_id: (r.title, r.pages, r.must) for r in QUERIES["query_hints"](spark, folder).collect()}
    assert got == {i: (f"page{i}.pdf", "4" if i == 4 or not 1 <= i <= 10000 else f"{i},4", "alpha,beta") for i in PAGES}


def test_numbers_of_every_part(spark, folder):
    got = {r.partkey: r.plain for r in QUERIES["normalize_numbers"](spark, folder).collect()}
    assert got == {**{k: f"{k}level{k % 10}Brand#1" for k in range(1, 51)}, 51: None}


def test_the_whole_manifest_is_skipped(spark, folder):
    assert {r.page_id for r in QUERIES["manifest_skip"](spark, folder).collect()} == set(PAGES) - {3, 4}
