"""Chunks with pages and boxes against a character-by-character version."""

from __future__ import annotations

import random

import pytest

from graphmill.operators import chunking as C
from graphmill.operators.page_chunks import chunks_with_pages

SCHEMA = "doc_id {}, pos long, kind string, level int, text string, page int, box array<double>, url string, caption string, sequence int, section string"


def _brute(items, most, overlap):
    """Each character is (char, page, box); a separator has neither."""
    out, chars, meta, section, last = [], None, None, None, None

    def done(carry):
        nonlocal chars, meta, last
        if chars is not None:
            kept = list(chars)
            while kept and kept[0][0].isspace():
                kept.pop(0)
            while kept and kept[-1][0].isspace():
                kept.pop()
            if kept:
                out.append(("text", section or "正文", kept, *meta, None))
                last = len(out)
                if carry:
                    chars, meta = kept[-overlap:], (meta[0], meta[2], meta[2])
                    return
        chars = None

    for kind, level, text, page, box, url, caption in items:
        text, level, page, box = (text or "").strip(), -1 if level is None else level, page or 1, box
        add = [(x, page, box) for x in text] + [("\n", None, None)] * 2
        if level >= 0 and text:
            done(False)
            section, chars, meta = text, add, (level, page, page)
        elif kind == "paragraph" and text:
            if chars is None:
                chars, meta = [], (-1, page, page)
            chars = chars + add
            meta = (meta[0], min(meta[1], page), max(meta[2], page))
            if len(chars) > most:
                done(True)
        elif kind == "table" and (text or caption):
            done(False)
            out.append(("table", section or "表格", [(x, page, box) for x in f"[表格] {caption or ''}\n{text}".strip()], -1, page, page, None))
        elif kind == "image" and (url or "").endswith(".png"):
            done(False)
            out.append(("image", section or "图片", [(x, page, box) for x in f"[图片: {text or caption or section or '无标题'}]"], -1, page, page, last))
    done(False)
    return out


def _items(rng, n):
    out = []
    for _ in range(n):
        kind = rng.choice(["paragraph"] * 6 + ["table", "image", "other", None])
        text = rng.choice([None, "", " x ", *(" ".join(rng.choice(["alpha", "be", "ga", "ö"]) for _ in range(rng.randrange(1, 14))) for _ in range(6))])
        box = None if rng.random() < 0.2 else [rng.random() for _ in range(4)]
        out.append((kind, rng.choice([None, -1, -1, -1, 0, 2]) if kind == "paragraph" else None, text, rng.choice([None, *range(1, 9)]), box, rng.choice([None, "a.png", "dir/b"]), rng.choice([None, "cap"])))
    return out


@pytest.mark.parametrize("kind", ["string", "long"])
def test_against_characters(spark, kind):
    rng = random.Random(11)
    docs = {(f"d{i}" if kind == "string" else i): _items(rng, rng.randrange(0, 40)) for i in range(25)}
    rows = [(d, p, *item, -5, "clash") for d, items in docs.items() for p, item in enumerate(items)]
    got = {}
    for r in chunks_with_pages(spark.createDataFrame(rows, SCHEMA.format(kind)), 60, 17).orderBy("doc_id", "sequence").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc, items in docs.items():
        want = _brute(items, 60, 17)
        assert [r["sequence"] for r in got.get(doc, [])] == list(range(1, len(want) + 1))
        for r, (content_type, section, chars, level, first, last, parent) in zip(got.get(doc, []), want):
            assert (r["content_type"], r["section"], r["content"]) == (content_type, section, "".join(c for c, _, _ in chars))
            assert (r["level"], r["first_page"], r["last_page"], r["parent"]) == (level, first, last, parent)
            mapped = [(None, None)] * len(chars)
            for p in r["places"]:
                for i in range(p["start"], p["end"]):
                    mapped[i] = (p["page"], p["box"])
            alone = content_type != "text"
            assert mapped == [((page, box) if page and (box or not alone) else (None, None)) for _, page, box in chars]


def test_empty_and_null_documents(spark):
    assert chunks_with_pages(spark.createDataFrame([], SCHEMA.format("long"))).collect() == []
    row = ("paragraph", None, "text", None, None, None, None, 1, "")
    got = chunks_with_pages(spark.createDataFrame([(None, 1, *row), (3, 1, *row)], SCHEMA.format("long"))).collect()
    assert sorted((r["doc_id"] or 0, r["content"]) for r in got) == [(0, "text"), (3, "text")]


def test_hierarchical_chunks_take_any_id(spark):
    rows = spark.createDataFrame([("a", 0, "title", "T"), ("a", 1, "text", "body"), ("b", 0, "text", "x")], "doc_id string, pos long, kind string, text string")
    assert sorted((r["doc_id"], r["content"]) for r in C.hierarchical_chunks(rows).collect()) == [("a", "T\nbody"), ("b", "x")]
