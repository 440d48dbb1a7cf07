from __future__ import annotations

import json

from pyspark.sql import functions as F

from graphmill.sources import files as S
from graphmill.streaming import progress as P


def test_ocr_items_become_uniform_rows(spark, tmp_path):
    items = [
        {"type": "text", "text": "Wards", "text_level": 1, "bbox": [1, 2, 3, 4], "page_idx": 0},
        {"type": "text", "text": "Body text.", "page_idx": 0},
        {"type": "image", "img_path": "a.png", "image_caption": ["Fig 1"], "page_idx": 0},
        {"type": "table", "table_caption": ["Tab 1"], "table_body": "<tr><td>x</td> <td>y</td></tr>", "page_idx": 1},
    ]
    (tmp_path / "doc9.json").write_text(json.dumps(items))
    rows = S.read_ocr(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.doc_id, r.page, r.kind, r.outline_level, r.text) for r in rows] == [("doc9", 1, "heading", 1, "Wards"), ("doc9", 1, "paragraph", 0, "Body text."), ("doc9", 1, "image", 0, "Fig 1"), ("doc9", 2, "table", 0, "Tab 1 x y")]


def test_file_scan_inventory_and_manifest(spark, tmp_path):
    (tmp_path / "books").mkdir()
    for name, text in (("books/a.txt", "one"), ("books/b.md", "two"), ("books/c.exe", "no")):
        (tmp_path / name).write_text(text)
    files = S.file_scan(spark, str(tmp_path))
    assert files.count() == 2
    progress = spark.createDataFrame([("a.txt", "completed", 3)], "name string, status string, images int")
    (row,) = S.inventory(files, progress).collect()
    assert (row.category, row.files, row.bytes, row.completed, row.images) == ("books", 2, 6, 1, 3)
    none = spark.createDataFrame([], "path string, signature string")
    manifest = S.unchanged(files, none, "v1").select("path", "signature").limit(1)
    assert S.unchanged(files, manifest, "v1").count() == 1 and S.unchanged(files, manifest, "v2").count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, "ü")], "id long, text string")
    S.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path / "t"), "id long, text string").collect())) == [(1, 'a "quoted", text'), (2, "ü")]


def test_ontologies(spark, tmp_path):
    tree = [{"name": "Hospital", "label": "Root", "children": [{"name": "ICU", "label": "Zone", "children": [{"name": "Bed", "label": "Space"}]}, {"name": "Lab", "label": "Zone", "children": []}]}]
    (tmp_path / "o.json").write_text(json.dumps(tree))
    nodes, edges = S.ontology_from_json(spark, str(tmp_path / "o.json"))
    assert sorted((r.id, r.level) for r in nodes.collect()) == [("root:hospital", 1), ("space:bed", 3), ("zone:icu", 2), ("zone:lab", 2)]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("root:hospital", "zone:icu"), ("root:hospital", "zone:lab"), ("zone:icu", "space:bed")]
    lines = ["- A", "  - B", "    - C", "  - D", "text", "- E", "  - F"]
    rows = S.ontology_from_markdown(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos long, line string")).collect()
    assert sorted((r.name, r.parent) for r in rows if r.parent) == [("B", "A"), ("C", "B"), ("D", "A"), ("F", "E")]


def test_sinks(spark):
    chunks = spark.createDataFrame([(1, "c1", [3.0, 4.0], "x" * 9000, None), (1, "c2", None, "y", "text"), (1, "c3", [], "z", "text")], "doc_id long, chunk_id string, vector array<double>, content string, content_type string")
    (row,) = S.vector_rows(chunks, 3).collect()
    assert row.vector == [0.6, 0.8, 0.0] and len(row.content) == 7800 and row.content_type == "text"
    target = spark.createDataFrame([("c1", 1)], "chunk_id string, v int")
    fresh, counts = S.inserted(target, spark.createDataFrame([("c1", 5), ("c2", 6), ("c2", 6)], "chunk_id string, v int"), "chunk_id")
    assert [tuple(r) for r in fresh.collect()] == [("c2", 6)] and tuple(counts.first()) == (1, 2)
    assert S.deleted(target, target, "chunk_id").count() == 0


def test_kv_store_and_caches(spark):
    log = [(["a", "b"], "k1", '{"t":"x"}', 1), (["a", "b"], "k1", '{"t":"y"}', 2), (["a"], "k2", '{"t":"x"}', 1), (["a"], "k2", None, 3), (["z"], "k3", '{"t":"x"}', 1)]
    state = S.kv_state(spark.createDataFrame(log, "namespace array<string>, key string, value string, at long"))
    assert sorted((r.key, r.value, r.created_at, r.updated_at) for r in state.collect()) == [("k1", '{"t":"y"}', 1, 2), ("k3", '{"t":"x"}', 1, 1)]
    assert [r.key for r in S.kv_search(state, ["a"], {"t": "y"}, "Y").collect()] == ["k1"]
    cache = spark.createDataFrame([(1, "v", "r", "success"), (2, "v", "r", "failed"), (3, "v", "r", None)], "chunk_id long, version string, result string, status string")
    hits = S.cache_hits(cache.select("chunk_id", "version"), cache, ["chunk_id", "version"])
    assert {r.chunk_id for r in hits.where("hit").collect()} == {1, 3}


def test_streams_in_several_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [(i, f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", i % 2, t, 1.0, None) for i, t in enumerate(["view", "click", "error", "click", "error", "view", "view", "error"])]
    for k in range(2):
        part = spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in rows[k * 4 : k * 4 + 4]], "event_id long, ts string, user_id long, event_type string, value double, props string")
        part.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*[c.split()[0] for c in schema.split(", ")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = P.progress_source(spark, str(tmp_path / "in"), files_per_trigger=1)
    found = P.drained(P.transitions(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert found.count() == sum(1 for u in (0, 1) for a, b in zip([r for r in rows if r[2] == u], [r for r in rows if r[2] == u][1:]) if a[3] != b[3])
    sink = P.embed_as_you_go(P.progress_source(spark, str(tmp_path / "in"), 1), lambda b: b.select("event_id", F.array(F.col("value")).alias("vector")), str(tmp_path / "vectors"), str(tmp_path / "state2"))
    sink.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 8
