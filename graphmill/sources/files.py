"""Sources and sinks over files: scans, manifests, OCR artefacts, CSV, ontologies, upserts.

Readers take an explicit schema wherever one is known, so nothing is inferred by a
second pass, and return plain DataFrames whose filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.functions.text import canonical, html_text, normalize_numbers
from graphmill.functions.vectors import fitted, normalized

SUPPORTED = ("txt", "md", "html", "json", "csv", "pdf")

OCR_ITEM = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_level", T.IntegerType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("page_idx", T.IntegerType()),
        T.StructField("img_path", T.StringType()),
        T.StructField("image_caption", T.ArrayType(T.StringType())),
        T.StructField("table_caption", T.ArrayType(T.StringType())),
        T.StructField("table_body", T.StringType()),
    ]
)


def file_scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """path, modified, length, content of the supported files below a folder; content is read only if it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(kind.isin(*extensions)).select("path", F.col("modificationTime").alias("modified"), "length", "content", kind.alias("kind"))


def inventory(files: DataFrame, progress: DataFrame) -> DataFrame:
    """Files left-joined to progress rows (name, status, images) by file name, with counts by category folder."""
    name, category = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rows = files.select(name.alias("name"), category.alias("category"), "length").join(progress, "name", "left")
    return rows.groupBy("category").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("status") == "completed").alias("completed"), F.sum(F.coalesce("images", F.lit(0))).alias("images"))


def unchanged(files: DataFrame, manifest: DataFrame, config: str) -> DataFrame:
    """Files (path, content) that the manifest (path, signature) doesn't have as they are now, with their signature."""
    signature = F.md5(F.concat(F.md5("content"), F.lit(config)).cast("binary"))
    return files.withColumn("signature", signature).join(manifest.select("path", "signature"), ["path", "signature"], "left_anti")


def ocr_details(items: DataFrame) -> DataFrame:
    """Uniform rows from OCR items (doc_id, items array): page from 1, kind, outline level, text, box."""
    rows = items.select("doc_id", F.posexplode("items").alias("pos", "i")).select("doc_id", "pos", "i.*")
    kind = F.when(F.col("type").isin("image", "table"), F.col("type")).when(F.coalesce("text_level", F.lit(0)) > 0, "heading").otherwise("paragraph")
    caption = F.when(F.col("type") == "table", F.array_join("table_caption", " ")).otherwise(F.array_join("image_caption", " "))
    body = F.when(F.col("type") == "table", html_text(F.coalesce("table_body", F.lit("")), caption)).when(F.col("type") == "image", caption).otherwise(F.col("text"))
    return rows.select("doc_id", "pos", (F.col("page_idx") + 1).alias("page"), kind.alias("kind"), F.coalesce("text_level", F.lit(0)).alias("outline_level"), F.trim(F.coalesce(body, F.lit(""))).alias("text"), "bbox", "img_path")


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """OCR artefacts: JSON files each holding a list of items; the file name is the document."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("doc_id"), "value")
    return ocr_details(raw.select("doc_id", F.from_json("value", T.ArrayType(OCR_ITEM)).alias("items")))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """type, key, name from JSON files {type: {alias: name}}, both sides normalised; of one key the least name."""
    maps = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    rows = maps.select(F.explode("m").alias("type", "names")).select("type", F.explode("names").alias("key", "name"))
    plain = lambda c: F.lower(normalize_numbers(F.col(c)))
    return rows.select("type", plain("key").alias("key"), plain("name").alias("name")).groupBy("type", "key").agg(F.min("name").alias("name"))


def canonicalized(entities: DataFrame, aliases: DataFrame, name: str = "name", kind: str = "type") -> DataFrame:
    """Entities with a column `canonical`: the alias table's name for the type and the normalised name, else that name."""
    own = entities.withColumn("_key", canonical(F.col(name)))
    table = aliases.select(F.col("type").alias(kind), F.col("key").alias("_key"), F.col("name").alias("_name"))
    return own.join(table, [kind, "_key"], "left").withColumn("canonical", F.coalesce("_name", "_key")).drop("_name", "_key")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def ontology_from_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, name, level) and edges (src, rel, dst) of a seed ontology.

    The file is a list of {name, label, children: [{name, label, children: [...]}]}, read to three levels.
    """
    leaf = "struct<name:string,label:string>"
    mid = f"struct<name:string,label:string,children:array<{leaf}>>"
    roots = spark.read.schema(f"name string, label string, children array<{mid}>").json(path, multiLine=True)
    key = lambda label, name: F.concat(F.lower(label), F.lit(":"), F.lower(name))
    one = roots.select(key(F.col("label"), F.col("name")).alias("id"), "label", "name", "children")
    two = one.select(F.col("id").alias("parent"), F.explode("children").alias("c")).select("parent", key(F.col("c.label"), F.col("c.name")).alias("id"), "c.label", "c.name", "c.children")
    three = two.select(F.col("id").alias("parent"), F.explode("children").alias("c")).select("parent", key(F.col("c.label"), F.col("c.name")).alias("id"), "c.label", "c.name")
    nodes = None
    for level, part in enumerate((one, two, three), 1):
        rows = part.select("id", "label", "name", F.lit(level).alias("level"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    edges = two.select(F.col("parent").alias("src"), F.lit("CONTAINS").alias("rel"), F.col("id").alias("dst")).unionByName(three.select(F.col("parent").alias("src"), F.lit("CONTAINS").alias("rel"), F.col("id").alias("dst")))
    return nodes.dropDuplicates(["id"]), edges.distinct()


def ontology_from_markdown(lines: DataFrame, indent: int = 2) -> DataFrame:
    """doc_id, pos, level, name, parent from lines (doc_id, pos, line) of nested bullets.

    The parent of a line is the last line before it at a lower level: of each level the last position up to the line,
    by one window, and the greatest of the lower ones.
    """
    level = F.floor(F.length(F.regexp_extract("line", r"^(\s*)", 1)) / indent).cast("int")
    rows = lines.where(F.col("line").rlike(r"^\s*[-*+]\s+\S")).select("doc_id", "pos", level.alias("level"), F.trim(F.regexp_replace("line", r"^\s*[-*+]\s+", "")).alias("name"))
    own = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.array(*(F.last(F.when(F.col("level") == n, F.struct("pos", "name")), True).over(own) for n in range(8)))
    lower = F.filter("_last", lambda s, i: s.isNotNull() & (i < F.col("level")))
    return rows.withColumn("_last", last).select("doc_id", "pos", "level", "name", F.array_max(lower)["name"].alias("parent"))


def vector_rows(chunks: DataFrame, dim: int, most: int = 7800) -> DataFrame:
    """What the vector table keeps: rows with a vector, fitted and normalised; content cut; defaults filled."""
    rows = chunks.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    return rows.select("doc_id", "chunk_id", normalized(fitted(F.col("vector"), dim)).alias("vector"), F.substring(F.coalesce("content", F.lit("")), 1, most).alias("content"), F.coalesce("content_type", F.lit("text")).alias("content_type"))


def inserted(target: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and counts (inserted, skipped): insert-if-absent on a unique key."""
    fresh = new.dropDuplicates([key]).join(target.select(key), key, "left_anti")
    counts = new.agg(F.count("*").alias("_n")).join(F.broadcast(fresh.agg(F.count("*").alias("inserted")))).select("inserted", (F.col("_n") - F.col("inserted")).alias("skipped"))
    return fresh, counts


def deleted(target: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return target.join(keys.select(*on).distinct(), list(on), "left_anti")


def kv_state(log: DataFrame) -> DataFrame:
    """namespace, key, value, created_at, updated_at from a log of puts (a null value deletes)."""
    last = F.max_by(F.struct("value", F.col("at").alias("updated_at")), F.struct("at", "value")).alias("s")
    return log.groupBy("namespace", "key").agg(last, F.min("at").alias("created_at")).where("s.value IS NOT NULL").select("namespace", "key", "s.value", "created_at", "s.updated_at")


def kv_search(state: DataFrame, prefix: list[str], filters: dict[str, str] | None = None, text: str | None = None, offset: int = 0, limit: int = 10) -> DataFrame:
    """Keys below a namespace prefix (namespace is an array), by exact JSON fields and substring."""
    cond: Column = F.slice("namespace", 1, len(prefix)) == F.array(*map(F.lit, prefix)) if prefix else F.lit(True)
    for k, v in (filters or {}).items():
        cond &= F.get_json_object("value", f"$.{k}") == v
    if text:
        cond &= F.lower("value").contains(text.lower())
    return state.where(cond).orderBy("namespace", "key").offset(offset).limit(limit)


def cache_hits(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows with what the cache has for them; only a success, or a row without a status, is a hit."""
    hits = cache.where(F.col("status").isNull() | (F.col("status") == "success")).select(*keys, "result")
    return wanted.join(hits, keys, "left").withColumn("hit", F.col("result").isNotNull())
