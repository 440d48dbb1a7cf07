"""Queries of fusion, chunking and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.catalog import Catalog
from graphmill.functions import text as X
from graphmill.operators import chunking as C
from graphmill.operators import page_chunks as PC
from graphmill.operators import fusion as M
from graphmill.plans.oracle import CHUNKS, EDGES, GRAPH, ITEMS
from graphmill.plans.registry import query


@query(f"""WITH {ITEMS}, b AS (SELECT entity_id, source, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN source = 'text' THEN 0 ELSE 1 END, pos, page, doc_id, source) AS r FROM items),
s AS (SELECT entity_id, snippet, row_number() OVER (PARTITION BY entity_id ORDER BY length(snippet) DESC, snippet) AS r FROM items),
g AS (SELECT entity_id, coalesce(max(score) FILTER (source = 'vector'), max(score)) AS score, max(coverage) AS coverage, count(DISTINCT (doc_id, page)) AS citations, count(*) AS merged FROM items GROUP BY entity_id)
SELECT g.entity_id, b.source AS base_source, g.score, g.coverage, s.snippet, g.citations, g.merged FROM g JOIN b ON b.entity_id = g.entity_id AND b.r = 1 JOIN s ON s.entity_id = g.entity_id AND s.r = 1""")
def merge_items(c: Catalog) -> DataFrame:
    return M.merged_items(c.items())


@query(f"""WITH {ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos, page, doc_id, source, snippet) AS i FROM items), l AS (SELECT entity_id, min(i) FILTER (source = 'text') AS lead FROM o GROUP BY entity_id),
p AS (SELECT o.*, row_number() OVER (PARTITION BY o.entity_id ORDER BY CASE WHEN i = lead THEN 0 ELSE 1 END, i) AS k FROM o JOIN l USING (entity_id))
SELECT entity_id, arg_min(snippet, (-length(snippet), k)) AS snippet, 'page=' || arg_min(page, k) || coalesce(',text=' || (arg_min(doc_id, k) FILTER (source = 'text')), '') AS attrs,
string_agg(DISTINCT pos::VARCHAR, ',' ORDER BY pos::VARCHAR) AS targets, count(DISTINCT (source, doc_id, page)) AS n_citations FROM p GROUP BY entity_id""")
def merge_item_details(c: Catalog) -> DataFrame:
    """Attributes, edges to orders and citations of a part's items; a blank attribute gives way to a later one."""
    none = F.lit(None).cast("string")
    attrs = F.create_map(F.lit("page"), F.col("page").cast("string"), F.lit("text"), F.when(F.col("source") == "text", F.col("doc_id").cast("string")).otherwise(" "))
    edge = F.array(F.struct(F.lit("IN").alias("type"), F.col("pos").cast("string").alias("target")))
    cite = F.struct("source", F.col("doc_id").cast("string").alias("chunk_id"), none.alias("location"), F.col("page").alias("page_number"), none.alias("section"), none.alias("image_url"))
    rows = c.items().withColumns({"attrs": attrs, "edges": edge, "citations": F.array(cite, cite)})
    out = M.merged_details(rows, ["pos", "page", "doc_id", "source", "snippet"])
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("entity_id", "snippet", shown.alias("attrs"), F.array_join(F.sort_array(F.transform("edges", lambda e: e["target"])), ",").alias("targets"), F.size("citations").cast("long").alias("n_citations"))


@query(f"""WITH {ITEMS}, a AS (SELECT 'entities' AS hint, v::VARCHAR AS v, rank FROM (SELECT v, row_number() OVER (ORDER BY v) AS rank FROM (SELECT DISTINCT entity_id AS v FROM items)) UNION ALL SELECT 'documents', v::VARCHAR, rank FROM (SELECT v, row_number() OVER (ORDER BY v) AS rank FROM (SELECT DISTINCT doc_id AS v FROM items))
UNION ALL SELECT 'pages', v::VARCHAR, rank FROM (SELECT v, row_number() OVER (ORDER BY v) AS rank FROM (SELECT DISTINCT page AS v FROM items)) UNION ALL SELECT 'sources', v, rank FROM (SELECT v, row_number() OVER (ORDER BY v) AS rank FROM (SELECT DISTINCT source AS v FROM items)))
SELECT hint, string_agg(v, ',' ORDER BY rank) AS values FROM a WHERE rank <= 20 GROUP BY hint""")
def unified_hints(c: Catalog) -> DataFrame:
    return M.unified_hints(c.items())


@query(f"""WITH {ITEMS}, t AS (SELECT doc_id, snippet, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, page) AS r FROM items), h AS (SELECT doc_id, string_agg(snippet, ' | ' ORDER BY r) AS highlights FROM t WHERE r <= 6 GROUP BY doc_id)
SELECT doc_id, count(*) AS n, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, any_value(h.highlights) AS highlights FROM items JOIN h USING (doc_id) GROUP BY doc_id""")
def doc_views(c: Catalog) -> DataFrame:
    return M.document_views(c.items())


@query(f"""WITH {ITEMS}, a AS (SELECT *, CASE WHEN source = 'graph' THEN 0 ELSE 1 END AS image FROM items), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY image, score DESC, pos, page) AS k FROM a), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY image, score DESC, pos, page) AS d FROM k WHERE k <= 3)
SELECT doc_id, entity_id, source, score FROM d WHERE d = 1 ORDER BY image, score DESC, doc_id LIMIT 30""")
def api_citations(c: Catalog) -> DataFrame:
    return M.api_citations(c.items())


@query(f"""WITH {GRAPH}, l AS (SELECT DISTINCT dst AS id, src AS source FROM edges WHERE rel = 'PROVIDES'), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source) AS k FROM l), s AS (SELECT id, string_agg(source, ',' ORDER BY source) AS s FROM r WHERE k <= 3 GROUP BY id)
SELECT n.id, coalesce(s.s, 'spec') AS citations FROM nodes n LEFT JOIN s USING (id) WHERE n.label = 'Part'""")
def node_citations(c: Catalog) -> DataFrame:
    links = c.edges().where("rel = 'PROVIDES'").select(F.col("dst").alias("id"), F.col("src").alias("source"))
    return M.node_citations(c.nodes().where("label = 'Part'"), links, "spec")


@query(f"""WITH {ITEMS} SELECT doc_id, CASE WHEN count(*) >= 3 AND count(DISTINCT page) >= 2 THEN 'answer' WHEN count(*) > 0 THEN 'thin' ELSE 'none' END AS verdict, count(*) AS n FROM items GROUP BY doc_id""")
def rule_answer(c: Catalog) -> DataFrame:
    """Whether there is enough for an answer: three items and two citations."""
    g = c.items().groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))
    return g.select("doc_id", F.when((F.col("n") >= 3) & (F.col("pages") >= 2), "answer").when(F.col("n") > 0, "thin").otherwise("none").alias("verdict"), "n")


@query("""SELECT doc_id, '[a=' || lang || ', b=2]' AS diagnostics FROM documents""")
def diagnostics_merge(c: Catalog) -> DataFrame:
    """Maps merged, the right one wins."""
    left = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    right = F.create_map(F.lit("a"), F.col("lang"))
    merged = F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)
    shown = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return c.table("documents").select("doc_id", F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")).alias("diagnostics"))


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, sequence, unnest(regexp_extract_all(lower(content), '[a-z]{{4,}}')) AS w FROM chunks), d AS (SELECT DISTINCT doc_id, sequence, w FROM t WHERE w NOT IN ('that', 'with')), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sequence ORDER BY w) AS k FROM d) SELECT doc_id, sequence, string_agg(w, ',' ORDER BY w) AS entities FROM r WHERE k <= 20 GROUP BY doc_id, sequence""")
def chunk_entities(c: Catalog) -> DataFrame:
    words = F.slice(F.array_sort(X.tokens(F.col("content"), "[a-z]{4,}", ("that", "with"))), 1, 20)
    return c.chunks().select("doc_id", "sequence", F.array_join(words, ",").alias("entities")).where("entities <> ''")


#: Words of supplying nations stand in for those of document names.
_NATION_ROLES = (("guide", ("united", "china")), ("detail_atlas", ("france", "germany", "india")), ("code_spec", ("japan", "brazil", "kenya", "iran")), ("macro_atlas", ("peru", "egypt", "iraq")))


@query(f"""WITH {ITEMS}, d AS (SELECT page AS answer, doc_id, n_name AS name, count(*) AS n FROM items JOIN supplier ON s_suppkey = doc_id JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
r AS (SELECT *, CASE WHEN regexp_matches(lower(name), 'united|china') THEN 0 WHEN regexp_matches(lower(name), 'france|germany|india') THEN 1 WHEN regexp_matches(lower(name), 'japan|brazil|kenya|iran') THEN 2 WHEN regexp_matches(lower(name), 'peru|egypt|iraq') THEN 3 ELSE 4 END AS priority FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY answer, priority ORDER BY n DESC, doc_id) - 1 AS i, count(*) OVER (PARTITION BY answer, priority) AS m FROM r),
t AS (SELECT *, CASE WHEN m <= 3 OR i < m // 3 THEN 0 WHEN i < m * 2 // 3 THEN 1 ELSE 2 END AS third FROM i),
a AS (SELECT *, row_number() OVER (PARTITION BY answer, priority ORDER BY i - CASE WHEN m <= 3 THEN 0 ELSE [0, m // 3, m * 2 // 3][third + 1] END, third) AS spot FROM t)
SELECT answer, doc_id, ['guide', 'detail_atlas', 'code_spec', 'macro_atlas', 'other'][priority + 1] AS role, row_number() OVER (PARTITION BY answer ORDER BY spot, priority)::INT AS place FROM a""")
def document_view_roles(c: Catalog) -> DataFrame:
    """Documents of each answer in order: thirds by count take turns within a role, then the roles do."""
    names = c.table("supplier").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("doc_id"), F.col("n_name").alias("name"))
    docs = c.items().groupBy(F.col("page").alias("answer"), "doc_id").agg(F.count("*").alias("n")).join(names, "doc_id")
    return M.view_order(M.with_roles(docs, roles=_NATION_ROLES), ["answer"]).select("answer", "doc_id", "role", "place")


# -- chunking and ingestion -----------------------------------------------------------------------------------------


@query()
def chunk_by_hierarchy(c: Catalog) -> DataFrame:
    """Sections, paragraphs and tables of every document; the overlap makes this a fold that SQL lacks."""
    items = c.chunks().select("doc_id", F.col("sequence").alias("pos"), F.col("content_type").alias("kind"), F.col("content").alias("text"))
    return C.hierarchical_chunks(items)


@query()
def chunk_pages(c: Catalog) -> DataFrame:
    """Chunks with the page and box of every stretch of text.  Forty lines are a page, a line is a strip of it."""
    line = (F.col("sequence") - 1) % 40
    strip = F.array(F.lit(0.0), F.round(line / 40, 4), F.lit(1.0), F.round((line + 1) / 40, 4))
    kind = F.when(F.col("content_type") == "table", "table").otherwise("paragraph")
    level = F.when(F.col("content_type") == "title", 0).otherwise(-1)
    none = F.lit(None).cast("string")
    items = c.chunks().select("doc_id", F.col("sequence").alias("pos"), kind.alias("kind"), level.alias("level"), F.col("content").alias("text"), (F.floor((F.col("sequence") - 1) / 40) + 1).alias("page"), strip.alias("box"), none.alias("url"), none.alias("caption"))
    return PC.chunks_with_pages(items)


@query()
def chunk_simple(c: Catalog) -> DataFrame:
    return C.simple_chunks(c.table("documents"))


@query(f"""WITH {CHUNKS}, s AS (SELECT *, length(content) < 100 AND content_type <> 'image' AS small, sequence // 40 + 1 AS page FROM (SELECT doc_id, sequence, content, CASE WHEN content_type = 'table' THEN 'image' ELSE content_type END AS content_type FROM chunks)), o AS (SELECT *, CASE WHEN small AND coalesce(lag(small) OVER (PARTITION BY doc_id ORDER BY sequence), false) THEN 0 ELSE 1 END AS st FROM s), r AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)::INT AS run FROM o)
SELECT doc_id, run AS sequence, CASE WHEN bool_or(small) THEN regexp_replace(string_agg(content, chr(10) || chr(10) ORDER BY r.sequence), '^\\s+|\\s+$', '', 'g') ELSE min(content) END AS content, arg_min(content_type, r.sequence) AS content_type, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM r GROUP BY doc_id, run""")
def chunk_merge_small(c: Catalog) -> DataFrame:
    """Lines with a bar stand for images here, and forty lines are a page."""
    page = F.floor(F.col("sequence") / 40).cast("int") + 1
    kind = F.when(F.col("content_type") == "table", "image").otherwise(F.col("content_type"))
    return C.merged_small(c.chunks().select("doc_id", "sequence", "content", kind.alias("content_type"), page.alias("first_page"), page.alias("last_page")))


@query("""SELECT doc_id, s // 680 + 1 AS sequence, substr(text, s + 1, 800) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 120, 1), 680)) AS s FROM documents)""")
def chunk_windows(c: Catalog) -> DataFrame:
    rows = c.table("documents").select("doc_id", F.posexplode(C.windows(F.col("text"))).alias("_i", "content"))
    return rows.select("doc_id", (F.col("_i") + 1).cast("long").alias("sequence"), "content")


@query(f"""WITH {CHUNKS}, d AS (SELECT md5(content) AS key, count(*) AS uses, min(doc_id) AS first_doc FROM chunks GROUP BY 1), p AS (SELECT key, length(key) + uses % 7 AS vector FROM d) SELECT c.doc_id, c.sequence, d.uses FROM chunks c JOIN d ON d.key = md5(c.content)""")
def content_dedup_backfill(c: Catalog) -> DataFrame:
    """Each distinct content is embedded once and given back to all its chunks."""
    chunks = c.chunks().select("doc_id", "sequence", F.md5(F.col("content").cast("binary")).alias("key"))
    distinct = chunks.groupBy("key").agg(F.count("*").alias("uses"))
    return chunks.join(distinct, "key").select("doc_id", "sequence", "uses")


@query("""WITH v AS (SELECT l_suppkey AS doc_id, l_orderkey AS k, l_linenumber AS n, l_extendedprice AS x0, l_extendedprice / 2 AS y0, l_extendedprice / 3 AS x1, l_extendedprice AS y1 FROM lineitem), s AS (SELECT doc_id, max(x0) AS scale FROM v GROUP BY doc_id)
SELECT k, n, round(least(x0, x1) / scale, 4) AS x0, round(greatest(y0, y1) / scale, 4) AS y1 FROM v JOIN s USING (doc_id)""")
def position_backfill(c: Catalog) -> DataFrame:
    """Boxes rescaled by their document's scale."""
    p = F.col("l_extendedprice")
    rows = c.table("lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.array(F.array(F.lit(1.0), p, p / 2, p / 3, p)).alias("positions"), p.alias("_x"))
    scale = rows.groupBy("doc_id").agg(F.max("_x").alias("scale"))
    boxes = rows.join(scale, "doc_id").select("k", "n", C.rescaled(F.col("positions"), F.col("scale")).alias("b"))
    return boxes.select("k", "n", F.col("b")[0][1].alias("x0"), F.col("b")[0][4].alias("y1"))


@query(f"""WITH {CHUNKS}, n AS (SELECT doc_id, sequence, content FROM chunks), o AS (SELECT DISTINCT ON (doc_id, content) doc_id, content FROM n WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id, content FROM n) WHERE (doc_id, content) NOT IN (SELECT (doc_id, content) FROM o)) AS inserted, (SELECT count(*) FROM n) - (SELECT count(*) FROM (SELECT DISTINCT doc_id, content FROM n) WHERE (doc_id, content) NOT IN (SELECT (doc_id, content) FROM o)) AS skipped""")
def insert_if_absent(c: Catalog) -> DataFrame:
    """Unordered insert: duplicates within the batch and in the target are skipped and counted."""
    rows = c.chunks().select("doc_id", "content")
    target = rows.join(c.table("labels").select("doc_id"), "doc_id", "left_semi").distinct()
    new = rows.distinct().join(target, ["doc_id", "content"], "left_anti").agg(F.count("*").alias("inserted"))
    return rows.agg(F.count("*").alias("_n")).join(F.broadcast(new)).select("inserted", (F.col("_n") - F.col("inserted")).alias("skipped"))


@query("""SELECT page_id, md5(url || md5(html)) AS signature FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""")
def manifest_skip(c: Catalog) -> DataFrame:
    """Files whose signature the manifest has are skipped."""
    signature = F.md5(F.concat("url", F.md5(F.col("html").cast("binary"))).cast("binary"))
    pages = c.table("pages").select("page_id", signature.alias("signature"))
    manifest = pages.join(c.table("labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").select("signature", "page_id")
    return pages.join(manifest, ["signature", "page_id"], "left_anti")


@query("""SELECT user_id AS k, max(ts) AS updated_at, min(ts) AS created_at, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'""")
def kv_prefix_search(c: Catalog) -> DataFrame:
    """A key-value log as its last state: created_at survives updates, an error deletes the key."""
    e = c.table("events")
    g = e.groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("updated_at"), F.min("ts").alias("created_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("value"))
    return g.where("value <> 'error'")


@query("SELECT DISTINCT split_part(url, '/', 3) AS namespace FROM pages")
def kv_namespaces(c: Catalog) -> DataFrame:
    """Namespaces to a depth."""
    return c.table("pages").select(F.get(F.split("url", "/"), F.lit(2)).alias("namespace")).distinct()


@query(f"""WITH {CHUNKS} SELECT d.doc_id, d.source, d.lang, substr(d.text, 1, 10000) AS content, count(c.doc_id) AS total, count(*) FILTER (c.content_type = 'text') AS n_text, count(*) FILTER (c.content_type = 'table') AS n_table FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY ALL""")
def document_sink(c: Catalog) -> DataFrame:
    """What the document store keeps: statistics by type, content cut."""
    stats = c.chunks().groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("content_type") == "text").alias("n_text"), F.count_if(F.col("content_type") == "table").alias("n_table"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    return c.table("documents").join(stats, "doc_id", "left").select("doc_id", "source", "lang", F.substring("text", 1, 10000).alias("content"), zero("total"), zero("n_text"), zero("n_table"))


@query(f"""WITH {CHUNKS}, n AS (SELECT * FROM chunks WHERE content_type IN ('text', 'table') AND doc_id NOT IN (SELECT doc_id FROM labels)) SELECT content_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM n GROUP BY content_type""")
def unprocessed_scan(c: Catalog) -> DataFrame:
    """The scan of chunks without a cached extraction, by type."""
    rows = c.chunks().where(F.col("content_type").isin("text", "table")).join(c.table("labels").select("doc_id"), "doc_id", "left_anti")
    return rows.groupBy("content_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"""WITH {CHUNKS} SELECT c.doc_id, c.sequence, d.source || '/' || d.lang || '.txt' AS path FROM chunks c JOIN documents d USING (doc_id) JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)""")
def chunk_lookup(c: Catalog) -> DataFrame:
    """Chunks of the wanted documents, with their documents' paths."""
    wanted = c.table("labels").where("toxic = 1").select("doc_id").distinct()
    paths = c.table("documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("path"))
    return c.chunks().select("doc_id", "sequence").join(wanted, "doc_id", "left_semi").join(paths, "doc_id").select("doc_id", "sequence", "path")


@query(f"""WITH {CHUNKS}, r AS (SELECT doc_id, sequence, content, row_number() OVER (PARTITION BY doc_id ORDER BY sequence) AS k FROM chunks) SELECT doc_id, count(*) AS n, string_agg(content, chr(10) ORDER BY k) AS body FROM r WHERE k > 1 AND k <= 4 GROUP BY doc_id""")
def document_fetch(c: Catalog) -> DataFrame:
    """A document with its chunks in order, after a skip and to a limit."""
    own = Window.partitionBy("doc_id").orderBy("sequence")
    rows = c.chunks().select("doc_id", "sequence", "content").withColumn("_k", F.row_number().over(own)).where("_k <= 4").where("_k > 1")
    parts = F.sort_array(F.collect_list(F.struct("_k", "content")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("body"))


@query(f"""WITH {EDGES}, {GRAPH.split(chr(10) + 'edges AS')[0].rstrip(', ')}, k AS (SELECT id FROM nodes WHERE label <> 'Part') SELECT (SELECT count(*) FROM k) AS kept_nodes, (SELECT count(*) FROM nodes) - (SELECT count(*) FROM k) AS removed_nodes, count(*) FILTER (src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)) AS kept_edges, count(*) FILTER (NOT (src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))) AS removed_edges FROM edges""")
def clear_keep_skeleton(c: Catalog) -> DataFrame:
    """Nodes outside the skeleton go, and with them their edges.

    One pass over the edges: they meet the nodes by one end, and then only their numbers by the other end, in which those
    that are lost already are one row of a task.
    """
    nodes, edges = c.nodes(), c.edges()
    keep = nodes.where("label <> 'Part'").select("id").distinct()
    into = edges.select("src", "dst").join(keep.select(F.col("id").alias("dst"), F.lit(True).alias("_in")), "dst", "left")
    out = into.groupBy(F.when(F.col("_in"), F.col("src")).alias("src")).agg(F.count("*").alias("_n"))
    both = out.join(keep.select(F.col("id").alias("src"), F.lit(True).alias("_out")), "src", "left")
    kept = F.coalesce(F.sum(F.when(F.col("_out"), F.col("_n"))), F.lit(0))
    left = both.agg(kept.alias("kept_edges"), (F.coalesce(F.sum("_n"), F.lit(0)) - kept).alias("removed_edges"))
    n = nodes.agg(F.count_if(F.col("label") != "Part").alias("kept_nodes"), F.count_if(F.col("label") == "Part").alias("removed_nodes"))
    return n.join(F.broadcast(left)).select("kept_nodes", "removed_nodes", "kept_edges", "removed_edges")
