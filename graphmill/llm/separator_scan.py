"""Token counts of the documents in flat token files, by a separator scan.

A flat token file is nothing but token ids one after another, each document ended
by the end-of-document id; there is no index of where documents begin.  It is held
as rows (file, block, data): `data` has BLOCK ids, little-endian unsigned 16-bit
(32-bit for a vocabulary over 65,536), the last block of a file fewer.

`scan` looks for the separator in each block with one vectorised comparison, and
reduces the block to four numbers: its length, its separators, the ids before the
first and after the last.  A prefix scan of these over the blocks of a file, in two
levels so that no task holds all blocks of a file, gives each block the number of
separators before it and the length of the document that is open at its start.

Defined cases
    A document without tokens counts 0.  Ids after a file's last separator are a
    document with complete = false.  A file without blocks, or with empty blocks
    only, has no documents.  A null text is written as an empty document.
    A file with an odd byte at its end is an error.  Equal separators in a row are
    empty documents.  Columns besides file, block and data aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm.tokens import Encoder
from graphmill.workspace import checkpointed
from graphmill.llm.textarrays import tidy

#: Ids in a block, and blocks that the first level of the prefix scan takes together.
BLOCK, GROUP = 1 << 16, 1 << 12
BLOCKS = "file long, block long, data binary"


def read_flat(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Blocks (file, block, data) and the `name` of each, of the flat token files under a path that Spark can read.

    The files' number is a hash of their names.  A file is read by one task, a block at a time goes on, and Spark's
    own limit of 2 GB for a binary row holds for a file: longer ones are written as several.
    """
    step = BLOCK * (4 if wide else 2)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.xxhash64("path").alias("file"), F.col("path").alias("name"), F.col("content"))

    def run(batches):
        for batch in batches:
            for file, name, content in zip(batch.column("file"), batch.column("name"), batch.column("content")):
                data = content.as_buffer()
                if data.size % (step // BLOCK):
                    raise ValueError(f"{name} does not end with a whole id")
                for at in range(0, data.size, step):
                    part = data.slice(at, min(step, data.size - at)).to_pybytes()
                    yield pa.RecordBatch.from_pydict({"file": [file.as_py()], "block": [at // step], "data": pa.array([part], pa.binary()), "name": [name.as_py()]})

    return files.mapInArrow(tidy(run), f"{BLOCKS}, name string")


def write_flat(docs: DataFrame, vocabulary: str, separator: int, path: str) -> None:
    """Tokenises every text and writes flat token files, one for each task, as a table at `path`.

    Rows of kind `ids` are the blocks.  Rows of kind `names` say which doc_id each document of a file has, in
    order, for callers that want names; the scan doesn't read them.  doc_id is a column of whole numbers; another type
    is an error.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a column of whole numbers")
    encoder = Encoder(vocabulary, plain=True)  # the separator stands nowhere but at ends

    def run(batches):
        from pyspark import TaskContext

        file, block, pending, waiting, names = TaskContext.get().partitionId(), 0, [], 0, 0
        width = np.uint16 if encoder.size <= 1 << 16 else np.uint32

        def rows(kind, block, data):
            return pa.RecordBatch.from_pydict({"kind": [kind], "file": [file], "block": [block], "data": pa.array([data], pa.binary())})

        for batch in batches:
            ids = []
            for text in batch.column("text"):
                pending.append(encoder.encode(text.as_py() or "").astype(width))
                pending.append(np.array([separator], width))
                waiting += len(pending[-2]) + 1
                if waiting >= BLOCK:
                    flat = np.concatenate(pending)
                    full = len(flat) // BLOCK * BLOCK
                    for at in range(0, full, BLOCK):
                        yield rows("ids", block, flat[at : at + BLOCK].tobytes())
                        block += 1
                    pending, waiting = [flat[full:]], len(flat) - full
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()
            if len(ids):
                yield rows("names", names, ids.tobytes())
                names += len(ids)
        if waiting:
            yield rows("ids", block, np.concatenate(pending).tobytes())

    docs.select("doc_id", "text").mapInArrow(tidy(run), f"kind string, {BLOCKS}").write.mode("overwrite").option("compression", "zstd").parquet(path)


def _summaries(separator: int, width: type):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_ids", "n_separators", "head", "tail", "inner")}
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", width)
                at = np.flatnonzero(ids == separator)
                out["n_ids"].append(len(ids))
                out["n_separators"].append(len(at))
                out["head"].append(int(at[0]) if len(at) else len(ids))
                out["tail"].append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                out["inner"].append(np.diff(at) - 1)
            columns = [batch.column("file"), batch.column("block"), *(pa.array(out[k], pa.int64()) for k in ("n_ids", "n_separators", "head", "tail")), pa.array(out["inner"], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "block", *out])

    return run


def scan(blocks: DataFrame, separator: int, wide: bool = False) -> DataFrame:
    """file, ordinal, n_tokens, complete of every document in the files (file, block, data)."""
    one = blocks.select("file", "block", "data").mapInArrow(tidy(_summaries(separator, np.uint32 if wide else np.uint16)), "file long, block long, n_ids long, n_separators long, head long, tail long, inner array<long>")
    one = checkpointed(one).withColumn("_group", F.floor(F.col("block") / GROUP))  # the files are read once
    inside = Window.partitionBy("file", "_group").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("n_separators") > 0

    def reset(window):
        """Ids up to and with the block's, and those up to its last separator: the difference is what is open."""
        return F.coalesce(F.sum("n_ids").over(window), F.lit(0)), F.max(F.when(has, F.col("_sum") - F.col("tail"))).over(window)

    one = one.withColumn("_sum", F.sum("n_ids").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ids, at = reset(before)
    one = one.withColumns({"_open": ids - F.coalesce(at, F.lit(0)), "_fresh": at.isNull(), "_seps": F.coalesce(F.sum("n_separators").over(before), F.lit(0))})

    groups = one.groupBy("file", "_group").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_separators").alias("n_separators"), F.max(F.when(has, F.col("_sum") - F.col("tail"))).alias("_last"))
    groups = groups.withColumn("tail", F.col("n_ids") - F.coalesce("_last", F.lit(0)))
    files = Window.partitionBy("file").orderBy("_group")
    groups = groups.withColumn("_sum", F.sum("n_ids").over(files.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    ids, at = reset(earlier)
    groups = groups.withColumns({"_carry": ids - F.coalesce(at, F.lit(0)), "_base": F.coalesce(F.sum("n_separators").over(earlier), F.lit(0)), "_final": F.lead("_group").over(files).isNull()})
    one = one.join(groups.select("file", "_group", "_carry", "_base", "_final"), ["file", "_group"])

    opened = F.col("_open") + F.when(F.col("_fresh"), F.col("_carry")).otherwise(0)
    one = one.withColumns({"_opened": opened, "_first": F.col("_base") + F.col("_seps"), "_end": F.col("_final") & F.lead("block").over(inside).isNull()})
    closed = F.when(has, F.concat(F.array(F.col("_opened") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    rest = F.when(has, F.col("tail")).otherwise(F.col("_opened") + F.col("n_ids"))
    done = one.select("file", "_first", F.posexplode(closed).alias("_k", "n_tokens")).select("file", (F.col("_first") + F.col("_k")).alias("ordinal"), "n_tokens", F.lit(True).alias("complete"))
    cut = one.where(F.col("_end") & (rest > 0)).select("file", (F.col("_first") + F.col("n_separators")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("complete"))
    return done.unionByName(cut)


def names(rows: DataFrame) -> DataFrame:
    """file, ordinal, doc_id from the rows of kind `names`."""

    def run(batches):
        for batch in batches:
            for file, start, data in zip(batch.column("file"), batch.column("block"), batch.column("data")):
                ids = np.frombuffer(data.as_buffer(), np.int64)
                none = ids == -(1 << 63)
                yield pa.RecordBatch.from_pydict({"file": np.full(len(ids), file.as_py()), "ordinal": start.as_py() + np.arange(len(ids)), "doc_id": pa.array(ids, mask=none)})

    return rows.where("kind = 'names'").select("file", "block", "data").mapInArrow(tidy(run), "file long, ordinal long, doc_id long")


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, separator: int, path: str) -> DataFrame:
    """doc_id, n_tokens of every row: writes the texts as flat token files at `path`, then scans these."""
    write_flat(docs, vocabulary, separator, path)
    rows = spark.read.schema(f"kind string, {BLOCKS}").parquet(path)
    found = scan(rows.where("kind = 'ids'"), separator, wide=Encoder(vocabulary).size > 1 << 16)
    return names(rows).join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
