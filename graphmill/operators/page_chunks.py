"""Chunks of laid-out documents, with the pages and boxes of every character.

Items come in reading order: headings, paragraphs, tables and images with their page and box.  A heading begins a chunk,
paragraphs gather until the chunk is longer than `most`, then the next one begins with its last `overlap` characters;
tables and images stand alone.  The fold's state maps ranges of the open chunk's characters to (page, box), so the
overlap takes its own places along and a chunk knows where on the page each stretch of its text stands.

An item's effect depends on all before it in its document, so a document is folded by one task, as a stream over rows
sorted by document and position: only the open chunk is in memory, however long the document is.

Defined cases
    A null text is empty; an empty heading or paragraph is skipped.  A null level is none (-1), a null page is page 1, a
    null box leaves a range without one.  A table without text and caption and an image without a picture's file name
    give no chunk.  Items of one position go by kind and text.  doc_id and pos have any plain type; a null doc_id is a
    document of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels of sections without a heading, and how tables and images are written.
SECTION = {"text": "正文", "table": "表格", "image": "图片"}
TABLE, IMAGE, UNTITLED = "[表格] ", "[图片: {}]", "无标题"
PICTURES = (".jpg", ".jpeg", ".png", ".webp")

PLACE = "struct<start:int, end:int, page:int, box:array<double>>"
SCHEMA = f"sequence int, section string, content_type string, content string, level int, first_page int, last_page int, parent int, places array<{PLACE}>"
_ARROW = [
    ("sequence", pa.int32()),
    ("section", pa.string()),
    ("content_type", pa.string()),
    ("content", pa.string()),
    ("level", pa.int32()),
    ("first_page", pa.int32()),
    ("last_page", pa.int32()),
    ("parent", pa.int32()),
    ("places", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("page", pa.int32()), ("box", pa.list_(pa.float64()))]))),
]


@dataclass
class _Open:
    """The chunk that gathers text: its parts, and places as (start, end, page, box)."""

    level: int
    first: int
    last: int
    text: list[str] = field(default_factory=list)
    size: int = 0
    places: list[tuple] = field(default_factory=list)

    def add(self, text: str, page: int, box) -> None:
        self.places.append((self.size, self.size + len(text), page, box))
        self.text += [text, "\n\n"]
        self.size += len(text) + 2


def _clipped(places: list[tuple], start: int, end: int) -> list[tuple]:
    """The places within start and end, counted from start."""
    return [(max(a, start) - start, min(b, end) - start, page, box) for a, b, page, box in places if max(a, start) < min(b, end)]


class Fold:
    """One document's items to chunks; each call returns the chunks that are finished."""

    def __init__(self, most: int, overlap: int):
        self.most, self.overlap = most, overlap
        self.open: _Open | None = None
        self.section: str | None = None
        self.sequence, self.last_text = 0, None

    def _chunk(self, kind: str, content: str, level: int, first: int, last: int, parent, places: list[tuple]) -> tuple:
        self.sequence += 1
        named = [{"start": a, "end": b, "page": p, "box": box} for a, b, p, box in places]
        return self.sequence, self.section or SECTION[kind], kind, content, level, first, last, parent, named

    def flush(self, carry: bool = False) -> list[tuple]:
        now, self.open = self.open, None
        if now is None:
            return []
        whole = "".join(now.text)
        content = whole.strip()
        if not content:
            return []
        start = whole.index(content[0])
        places = _clipped(now.places, start, start + len(content))
        out = self._chunk("text", content, now.level, now.first, now.last, None, places)
        self.last_text = self.sequence
        if carry and self.overlap:
            seed = content[-self.overlap :]
            self.open = _Open(now.level, now.last, now.last, [seed], len(seed), _clipped(places, len(content) - len(seed), len(content)))
        return [out]

    def item(self, kind: str, level: int, text: str, page: int, box, url: str, caption: str) -> list[tuple]:
        text = text.strip()
        if level >= 0 and text:
            out = self.flush()
            self.section = text
            self.open = _Open(level, page, page)
            self.open.add(text, page, box)
            return out
        if kind == "paragraph" and text:
            if self.open is None:
                self.open = _Open(-1, page, page)
            now = self.open
            now.add(text, page, box)
            now.first, now.last = min(now.first, page), max(now.last, page)
            return self.flush(carry=True) if now.size > self.most else []
        place = [] if box is None else [(page, box)]
        if kind == "table":
            words = " ".join(re.sub(r"<[^>]+>", " ", text).split())
            if not (words or caption):
                return []
            content = f"{TABLE}{caption}\n{words}".strip()
            out = self.flush()
            return [*out, self._chunk("table", content, -1, page, page, None, [(0, len(content), *p) for p in place])]
        if kind == "image" and re.split(r"[?#]", url)[0].lower().endswith(PICTURES):
            out = self.flush()
            content = IMAGE.format(text or caption or self.section or UNTITLED)
            return [*out, self._chunk("image", content, -1, page, page, self.last_text, [(0, len(content), *p) for p in place])]
        return []


def chunks_with_pages(items: DataFrame, most: int = 1200, overlap: int = 100) -> DataFrame:
    """doc_id and SCHEMA from items (doc_id, pos, kind, level, text, page, box, url, caption).

    kind: paragraph, table or image; a level of 0 or more makes an item a heading.  box: [x0, y0, x1, y1].  parent: of an
    image the sequence of the last text chunk before it.  places: ranges of content's characters with page and box.
    """
    empty = F.lit("")
    rows = items.select(
        "doc_id",
        "pos",
        F.coalesce("kind", empty).alias("kind"),
        F.coalesce(F.col("level").cast("int"), F.lit(-1)).alias("level"),
        *(F.coalesce(c, empty).alias(c) for c in ("text", "url", "caption")),
        F.coalesce(F.col("page").cast("int"), F.lit(1)).alias("page"),
        F.col("box").cast("array<double>").alias("box"),
    )
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "kind", "text")

    def run(batches):
        doc, fold, began, kind = None, Fold(most, overlap), False, None

        def batch_of(done):
            columns = [pa.array([d for d, _ in done], kind), *(pa.array([c[i] for _, c in done], t) for i, (_, t) in enumerate(_ARROW))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *(n for n, _ in _ARROW)])

        for batch in batches:
            kind, done = batch.schema.field("doc_id").type, []
            for own, *item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "kind", "level", "text", "page", "box", "url", "caption"))):
                if not began or own != doc:
                    done += [(doc, c) for c in fold.flush()]
                    doc, fold, began = own, Fold(most, overlap), True
                done += [(doc, c) for c in fold.item(*item)]
            if done:
                yield batch_of(done)
        if rest := fold.flush():
            yield batch_of([(doc, c) for c in rest])

    return rows.mapInArrow(run, f"doc_id {items.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
