"""Cutting documents into chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Texts of a batch that a task has as Python strings at a time, with their chunks.
SLICE = 256


def simple_cuts(text: str, most: int, overlap: int, separator: str) -> list[str]:
    """Chunks of a text: parts, each with the separator after it, while they fit; the next begins with the last
    `overlap` characters of a chunk that was full.  Chunks are stripped, empty ones go.  A part is never cut."""
    out, parts, size = [], [], 0
    for part in text.split(separator) if text else []:
        if size and size + len(part) + len(separator) > most:
            chunk = "".join(parts).strip()
            seed = ""
            if chunk:
                out.append(chunk)
                seed = chunk[-overlap:] if overlap else ""
            parts, size = [seed], len(seed)
        parts += [part, separator]
        size += len(part) + len(separator)
    chunk = "".join(parts).strip()
    return [*out, chunk] if chunk else out


def simple_chunks(docs: DataFrame, most: int = 1200, overlap: int = 100, separator: str = "\n\n") -> DataFrame:
    """doc_id, sequence, content: documents of text alone, cut at blank lines.  A null text has no chunks."""

    def run(batches):
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            cuts = [simple_cuts(text or "", most, overlap, separator) for text in batch.column("text").to_pylist()]
            rows = pa.array([i for i, own in enumerate(cuts) for _ in own], pa.int64())
            columns = [batch.column("doc_id").take(rows), pa.array([k + 1 for own in cuts for k in range(len(own))], pa.int32()), pa.array([c for own in cuts for c in own], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sequence", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sequence int, content string")


def hierarchical_chunks(items: DataFrame, most: int = 1200, overlap: int = 100) -> DataFrame:
    """doc_id, sequence, section, content_type, content, first_item, last_item from items (doc_id, pos, kind, text).

    A heading begins a chunk, paragraphs gather until the chunk is full, tables and images stand alone.  The overlap
    makes a cut depend on all before it, so documents are folded one after another over rows sorted by document: only
    the open chunk is in memory, however long a document is.
    """
    rows = items.select("doc_id", "pos", "kind", F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    rest = [("sequence", pa.int32()), ("section", pa.string()), ("content_type", pa.string()), ("content", pa.string()), ("first_item", pa.int64()), ("last_item", pa.int64())]

    def run(batches):
        schema = None
        doc, sequence, section, text, first, last = None, 0, None, "", None, None
        out = []

        def flush():
            nonlocal sequence, text
            if text:
                sequence += 1
                out.append((doc, sequence, section, "text", text, first, last))
            text = ""

        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), *rest])
            for own, pos, kind, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "kind", "text"))):
                if own != doc:
                    flush()
                    doc, sequence, section, first, last = own, 0, None, None, None
                if kind == "title":
                    flush()
                    section, text, first, last = part, part, pos, pos
                elif kind in ("table", "image"):
                    flush()
                    sequence += 1
                    out.append((doc, sequence, section, kind, part, pos, pos))
                elif text and len(text) + 1 + len(part) > most:
                    seed = text[-overlap:] if overlap else ""
                    flush()
                    text, first, last = (seed + "\n" + part) if seed else part, pos, pos
                else:
                    first = pos if not text else first
                    text, last = (text + "\n" + part) if text else part, pos
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, f"doc_id {items.schema['doc_id'].dataType.simpleString()}, sequence int, section string, content_type string, content string, first_item long, last_item long")


def merged_small(chunks: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, sequence, content, content_type, first_page, last_page, n: runs of chunks shorter than `least` become one.

    chunks: doc_id, sequence, content, content_type, first_page, last_page.  Images break runs and stay; a run has the
    type of its first chunk and all pages of its chunks; contents are joined by a blank line and stripped.
    """
    own = Window.partitionBy("doc_id").orderBy("sequence")
    small = (F.length("content") < least) & (F.col("content_type") != "image")
    starts = F.when(small & F.coalesce(F.lag("_small").over(own), F.lit(False)), 0).otherwise(1)
    rows = chunks.withColumn("_small", small).withColumn("_starts", starts)
    rows = rows.withColumn("_run", F.sum("_starts").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("sequence", "content")))
    text = F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n")
    stripped = F.when(F.max("_small"), F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(text)
    return rows.groupBy("doc_id", F.col("_run").cast("int").alias("sequence")).agg(stripped.alias("content"), F.min_by("content_type", "sequence").alias("content_type"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.count("*").alias("n"))


def windows(text: Column, size: int = 800, overlap: int = 120) -> Column:
    """Array of fixed windows of a text."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(step))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))


def rescaled(positions: Column, scale: Column) -> Column:
    """Boxes [page, x0, y0, x1, y1] divided by the scale, clamped to 0..1 and in order."""
    part = lambda p, i: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p[i] / scale)), 4)
    return F.transform(positions, lambda p: F.array(p[0], F.least(part(p, 1), part(p, 3)), F.least(part(p, 2), part(p, 4)), F.greatest(part(p, 1), part(p, 3)), F.greatest(part(p, 2), part(p, 4))))


