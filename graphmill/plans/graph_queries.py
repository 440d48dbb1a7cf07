"""Queries of graph search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.catalog import Catalog
from graphmill.operators import graph as G
from graphmill.operators import joins as J
from graphmill.plans.oracle import DOC_TERMS, EDGES, GRAPH, NODES, TRIPLETS
from graphmill.plans.registry import query

_BOTH = "both_ways AS (SELECT src AS a, dst AS b, src, rel, dst FROM edges UNION ALL SELECT dst, src, src, rel, dst FROM edges)"


@query(f"""WITH {NODES}, h AS (SELECT *, round(least(length(name), 6) / greatest(length(name), 6), 4) AS share FROM nodes WHERE contains(lower(name), 'united') OR contains('united', lower(name)))
SELECT id, label, name, CASE WHEN share >= 0.2 THEN share ELSE 0 END::DOUBLE AS score FROM h ORDER BY score DESC, CASE label WHEN 'Nation' THEN 0 WHEN 'Region' THEN 1 ELSE 2 END, name, id LIMIT 8""")
def node_search(c: Catalog) -> DataFrame:
    return G.search_nodes(c.nodes(), "UNITED", 8, ("Nation", "Region"))


@query(f"""WITH {GRAPH}, {_BOTH}, s AS (SELECT 'region:1' AS id), d1 AS (SELECT b AS id FROM both_ways JOIN s ON a = s.id), n AS (SELECT id FROM s UNION SELECT id FROM d1)
SELECT DISTINCT src, rel, dst FROM edges WHERE src IN (SELECT id FROM n) OR dst IN (SELECT id FROM n)""")
def k_hop_edges(c: Catalog) -> DataFrame:
    seeds = c.nodes().where("id = 'region:1'").select("id")
    return G.neighbourhood(c.edges(), seeds, 2)


@query(f"""WITH {EDGES}, {_BOTH}, m AS (SELECT min(x.b) AS mid FROM both_ways x JOIN both_ways y ON x.b = y.b WHERE x.a = 'part:1' AND y.a = 'part:2'),
far AS (SELECT 0 AS step, 'part:1' AS id UNION ALL SELECT 1, mid FROM m WHERE mid IS NOT NULL UNION ALL SELECT 2, 'part:2' FROM m WHERE mid IS NOT NULL),
l1 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a = 'part:1'), l2 AS (SELECT b AS id, min(a) AS parent FROM both_ways WHERE a IN (SELECT id FROM l1) AND b <> 'part:1' AND b NOT IN (SELECT id FROM l1) GROUP BY b),
l3 AS (SELECT b AS id, min(a) AS parent FROM both_ways WHERE a IN (SELECT id FROM l2) AND b NOT IN (SELECT id FROM l2) AND b NOT IN (SELECT id FROM l1) GROUP BY b),
l4 AS (SELECT b AS id, min(a) AS parent FROM both_ways WHERE a IN (SELECT id FROM l3) AND b NOT IN (SELECT id FROM l3) AND b NOT IN (SELECT id FROM l2) AND b NOT IN (SELECT id FROM l1) GROUP BY b),
p4 AS (SELECT l4.id AS n4, l3.id AS n3, l2.id AS n2, l2.parent AS n1 FROM l4 JOIN l3 ON l3.id = l4.parent JOIN l2 ON l2.id = l3.parent WHERE l4.id = 'part:2')
SELECT step, id FROM far WHERE (SELECT mid FROM m) IS NOT NULL
UNION ALL SELECT * FROM (SELECT 0, 'part:1' FROM p4 UNION ALL SELECT 1, n1 FROM p4 UNION ALL SELECT 2, n2 FROM p4 UNION ALL SELECT 3, n3 FROM p4 UNION ALL SELECT 4, n4 FROM p4) WHERE (SELECT mid FROM m) IS NULL""")
def shortest_path(c: Catalog) -> DataFrame:
    return G.shortest_path(c.edges(), "part:1", "part:2", 6)


@query(f"""WITH {EDGES}, {_BOTH}, e AS (SELECT a, b, src || '|' || rel || '|' || dst AS e FROM both_ways), t2 AS (SELECT x.a || ' - ' || x.b || ' - ' || y.b AS path, x.e AS e1, y.e AS e2, y.b AS tip FROM e x JOIN e y ON x.b = y.a AND x.e <> y.e WHERE x.a IN ('region:0', 'region:1')),
t3 AS (SELECT path || ' - ' || z.b AS path, z.b AS tip FROM t2 JOIN e z ON t2.tip = z.a AND z.e NOT IN (e1, e2))
SELECT 2 AS hops, path FROM t2 WHERE tip IN ('supplier:7', 'supplier:8') UNION ALL SELECT 3, path FROM t3 WHERE tip IN ('supplier:7', 'supplier:8') ORDER BY hops, path LIMIT 10""")
def trails_2_3(c: Catalog) -> DataFrame:
    return G.trails(c.edges(), ["region:0", "region:1"], ["supplier:7", "supplier:8"], 2, 3, 10)


@query(f"""WITH {EDGES}, {_BOTH}, u AS (SELECT DISTINCT a, b FROM both_ways) SELECT y.b AS related, count(DISTINCT x.b) AS common FROM u x JOIN u y ON x.b = y.a WHERE x.a = 'supplier:1' AND y.b <> 'supplier:1' GROUP BY y.b HAVING count(DISTINCT x.b) >= 2 ORDER BY common DESC, related LIMIT 20""")
def common_neighbors(c: Catalog) -> DataFrame:
    ids = c.nodes().where("id = 'supplier:1'").select(F.col("id").alias("a"))
    return J.common_neighbours(c.edges(), ids, 2).select(F.col("b").alias("related"), "common").orderBy(F.desc("common"), "related").limit(20)


@query(f"""WITH {GRAPH}, {_BOTH} SELECT n.id, rel, CASE WHEN e.src = n.id THEN 'out' ELSE 'in' END AS direction, m.id AS other, m.label, m.name FROM nodes n JOIN both_ways e ON e.a = n.id JOIN nodes m ON m.id = e.b WHERE n.label = 'Nation'""")
def neighbors_dir(c: Catalog) -> DataFrame:
    return G.neighbours(c.edges(), c.nodes(), F.col("label") == "Nation")


@query(f"""WITH {GRAPH} SELECT DISTINCT p.id, p.name FROM edges e JOIN nodes p ON p.id = e.dst AND p.label = 'Part' WHERE e.src IN ('supplier:1', 'supplier:2') AND e.rel = 'PROVIDES'""")
def related_specs(c: Catalog) -> DataFrame:
    """Nodes of a wanted label next to the seeds."""
    near = c.edges().where(F.col("src").isin("supplier:1", "supplier:2") & (F.col("rel") == "PROVIDES")).select(F.col("dst").alias("id")).distinct()
    return c.nodes().where("label = 'Part'").join(near, "id").select("id", "name")


@query(f"""WITH {GRAPH}, near AS (SELECT 'seeds' AS found, n.id, n.name FROM nodes n WHERE n.label = 'Part' AND n.id IN (SELECT dst FROM edges WHERE src IN ('supplier:1', 'supplier:2') UNION SELECT src FROM edges WHERE dst IN ('supplier:1', 'supplier:2')) ORDER BY n.id LIMIT 5),
named AS (SELECT 'text' AS found, id, name FROM nodes WHERE label = 'Part' AND contains(lower(name), 'widget') ORDER BY id LIMIT 5) SELECT * FROM near UNION ALL SELECT * FROM named""")
def related_or_named(c: Catalog) -> DataFrame:
    """Parts next to the seeds; where a seed has none, those that the question names."""
    nodes, edges = c.nodes(), c.edges()
    near = G.related(nodes, edges, ["supplier:1", "supplier:2"], ("Part",), "widget").withColumn("found", F.lit("seeds"))
    named = G.related(nodes, edges, ["no such seed"], ("Part",), "Widget").withColumn("found", F.lit("text"))
    return near.unionByName(named).select("found", "id", "name")


@query(f"""WITH {GRAPH}, t AS (SELECT * FROM (VALUES (0, 'no such name'), (1, 'FRANCE'), (2, 'ASIA')) v(tier, term)), h AS (SELECT t.tier, t.term, n.id FROM t JOIN nodes n ON contains(lower(n.name), lower(t.term))), m AS (SELECT min(tier) AS tier FROM h),
s AS (SELECT id FROM h JOIN m USING (tier) ORDER BY id LIMIT 3) SELECT DISTINCT e.src, e.rel, e.dst FROM edges e WHERE e.src IN (SELECT id FROM s) OR e.dst IN (SELECT id FROM s)""")
def graph_search(c: Catalog) -> DataFrame:
    """The query, then further terms until one has nodes; its first three are the seeds of an expansion."""
    nodes = c.nodes()
    terms = ["no such name", "FRANCE", "ASIA"]
    tier = F.coalesce(*(F.when(F.lower("name").contains(t.lower()), i) for i, t in enumerate(terms)))
    hits = nodes.select("id", tier.alias("tier")).where("tier IS NOT NULL")
    seeds = hits.orderBy("tier", "id").limit(3)  # the first tier that has any comes first
    best = seeds.agg(F.min("tier").alias("_t"))
    return G.neighbourhood(c.edges(), seeds.join(F.broadcast(best)).where("tier = _t").select("id"), 1)


@query(f"""WITH {GRAPH} SELECT a.name || ' -' || e.rel || '-> ' || b.name AS path FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.label = 'Region'""")
def path_rendering(c: Catalog) -> DataFrame:
    nodes = c.nodes()
    a, b = nodes.where("label = 'Region'").select(F.col("id").alias("src"), F.col("name").alias("x")), nodes.select(F.col("id").alias("dst"), F.col("name").alias("y"))
    return c.edges().join(a, "src").join(b, "dst").select(F.concat("x", F.lit(" -"), "rel", F.lit("-> "), "y").alias("path"))


@query(f"""WITH {GRAPH}, h AS (SELECT e.src AS key, n.label, n.name, n.id FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.rel = 'CONTAINS'), r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY key, label) AS size FROM h WINDOW w AS (PARTITION BY key, label ORDER BY name, id))
SELECT key, label, size, string_agg(name, ',' ORDER BY r) AS members FROM r WHERE size >= 3 AND r <= 8 GROUP BY ALL""")
def community_by_label(c: Catalog) -> DataFrame:
    hits = c.edges().where("rel = 'CONTAINS'").select(F.col("src").alias("key"), F.col("dst").alias("id"))
    return G.communities(hits, c.nodes(), "key")


@query(f"""WITH {GRAPH}, d AS (SELECT src, dst FROM edges WHERE rel = 'CONTAINS') SELECT a.src AS root, a.dst AS id, 1 AS level FROM d a WHERE a.src LIKE 'region:%' UNION ALL SELECT a.src, b.dst, 2 FROM d a JOIN d b ON a.dst = b.src WHERE a.src LIKE 'region:%'""")
def skeleton_3level(c: Catalog) -> DataFrame:
    return G.skeleton(c.edges(), c.nodes(), "CONTAINS", F.col("label") == "Region", 3)


@query(f"""WITH {GRAPH}, a AS (SELECT p.id AS part, s.src AS supplier, n.src AS nation, r.src AS region FROM nodes p JOIN edges s ON s.dst = p.id AND s.rel = 'PROVIDES' JOIN edges n ON n.dst = s.src AND n.rel = 'CONTAINS' JOIN edges r ON r.dst = n.src AND r.rel = 'CONTAINS' WHERE p.label = 'Part')
SELECT part, count(DISTINCT supplier) AS suppliers, string_agg(DISTINCT nation, ',' ORDER BY nation) AS nations, string_agg(DISTINCT region, ',' ORDER BY region) AS regions FROM a GROUP BY part""")
def space_subgraph(c: Catalog) -> DataFrame:
    """A part with its suppliers and their ancestors, one row a part."""
    edges = c.edges()
    provides = edges.where("rel = 'PROVIDES'").select(F.col("dst").alias("part"), F.col("src").alias("supplier"))
    up = edges.where("rel = 'CONTAINS'").select("src", "dst")
    nation = up.select(F.col("dst").alias("supplier"), F.col("src").alias("nation"))
    region = up.select(F.col("dst").alias("nation"), F.col("src").alias("region"))
    ancestors = nation.join(region, "nation")
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    return provides.join(ancestors, "supplier").groupBy("part").agg(F.countDistinct("supplier").alias("suppliers"), joined("nation").alias("nations"), joined("region").alias("regions"))


@query(f"""WITH {GRAPH}, {_BOTH} SELECT n.id, rel || CASE WHEN e.src = n.id THEN '_out' ELSE '_in' END AS grp, count(*) AS n, min(m.name) AS first_name FROM nodes n JOIN both_ways e ON e.a = n.id JOIN nodes m ON m.id = e.b WHERE n.label = 'Supplier' GROUP BY ALL""")
def node_detail_groups(c: Catalog) -> DataFrame:
    near = G.neighbours(c.edges(), c.nodes(), F.col("label") == "Supplier")
    return near.groupBy("id", F.concat("rel", F.lit("_"), "direction").alias("grp")).agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query(f"""WITH {GRAPH}, e AS (SELECT * FROM edges WHERE rel = 'CONTAINS'), i AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)) SELECT (SELECT count(*) FROM i) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, count(*) FILTER (label = 'Customer') AS customers, count(*) FILTER (label = 'Supplier') AS suppliers FROM i JOIN nodes USING (id)""")
def subgraph_stats(c: Catalog) -> DataFrame:
    e = c.edges().where("rel = 'CONTAINS'")
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(c.nodes(), "id")
    out = ids.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("label") == "Customer").alias("customers"), F.count_if(F.col("label") == "Supplier").alias("suppliers"))
    return out.join(F.broadcast(e.agg(F.count("*").alias("n_edges")))).select("n_nodes", "n_edges", "customers", "suppliers")


@query(f"""WITH {DOC_TERMS}, t AS (SELECT DISTINCT doc_id, term FROM doc_terms WHERE length(term) >= 12), e AS (SELECT 'doc:' || doc_id AS src, 'MENTIONS' AS rel, 'term:' || term AS dst FROM t) SELECT count(DISTINCT src) AS docs, count(DISTINCT dst) AS terms, count(*) AS edges FROM e""")
def answer_graph(c: Catalog) -> DataFrame:
    """Nodes and edges of an answer's graph, without repeats."""
    t = c.doc_terms().where("length(term) >= 12").select("doc_id", "term").distinct()
    return t.agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("term").alias("terms"), F.count("*").alias("edges"))


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT src AS a, dst AS b FROM edges WHERE rel = 'CONTAINS'), up AS (SELECT b AS node, a AS parent FROM e UNION ALL SELECT up.node, e.a FROM up JOIN e ON e.b = up.parent),
r AS (SELECT node, max(CASE WHEN parent LIKE 'region:%' THEN parent END) AS root FROM up GROUP BY node UNION ALL SELECT DISTINCT a, a FROM e WHERE a LIKE 'region:%'), m AS (SELECT root, min(node) AS component, count(*) AS size FROM r GROUP BY root) SELECT component, size FROM m""")
def components(c: Catalog) -> DataFrame:
    """Connected components of the containment edges, with their sizes."""
    found = G.components_of(c.edges().where("rel = 'CONTAINS'"))
    return found.groupBy("component").agg(F.count("*").alias("size"))


@query(f"""WITH RECURSIVE {GRAPH}, e AS (SELECT src AS a, dst AS b FROM edges WHERE rel = 'CONTAINS'), up AS (SELECT b AS node, a AS parent FROM e UNION ALL SELECT up.node, e.a FROM up JOIN e ON e.b = up.parent),
t AS (SELECT node, max(CASE WHEN parent LIKE 'region:%' THEN parent END) AS root FROM up GROUP BY node UNION ALL SELECT DISTINCT a, a FROM e WHERE a LIKE 'region:%'),
s AS (SELECT t.root, t.node, length(n.name) / 100 AS score FROM t JOIN nodes n ON n.id = t.node), z AS (SELECT root, count(*) AS n, min(node) AS component FROM s GROUP BY root), main AS (SELECT root FROM z ORDER BY n DESC, component LIMIT 1),
b AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, node) AS r FROM s), h AS (SELECT node, score FROM b WHERE r = 1 AND root IN (SELECT root FROM main))
SELECT b.node AS src, h.node AS dst, round(b.score + h.score, 4) AS score FROM b, h WHERE b.r = 1 AND b.root NOT IN (SELECT root FROM main)""")
def component_bridges(c: Catalog) -> DataFrame:
    found = G.components_of(c.edges().where("rel = 'CONTAINS'"))
    scores = c.nodes().select(F.col("id").alias("node"), (F.length("name") / 100).alias("score"))
    return G.bridges(found, scores)


@query(f"WITH {TRIPLETS} SELECT DISTINCT subject, relation, object FROM triplets ORDER BY subject, relation, object LIMIT 30")
def sample_triples(c: Catalog) -> DataFrame:
    return c.triplets().select("subject", "relation", "object").distinct().orderBy("subject", "relation", "object").limit(30)


@query(f"""WITH {GRAPH}, d AS (SELECT a.src AS region, b.dst AS supplier FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel = 'CONTAINS' AND b.rel = 'CONTAINS' AND b.dst LIKE 'supplier:%') SELECT region AS src, 'SERVED_BY' AS rel, supplier AS dst FROM d LEFT JOIN edges e ON e.src = d.region AND e.dst = d.supplier WHERE e.src IS NULL""")
def hierarchy_enhancement(c: Catalog) -> DataFrame:
    """A rule edge two levels down, where there is none."""
    edges = c.edges()
    down = edges.where("rel = 'CONTAINS'")
    pairs = down.select("src", F.col("dst").alias("mid")).join(down.select(F.col("src").alias("mid"), "dst"), "mid").where("dst LIKE 'supplier:%'").select("src", F.lit("SERVED_BY").alias("rel"), "dst")
    return J.without(pairs, edges, ["src", "dst"])


_ANSWER = """pt AS (SELECT doc_id AS id, lang AS answer, lower(text) AS text, CASE WHEN doc_id % 4 = 0 THEN [substr(b.w, 1, 6), 'no such space'] END AS applies FROM documents LEFT JOIN (SELECT item_id, regexp_extract(lower(text), '[a-z]{8,}') AS w FROM benchmark) b ON b.item_id = doc_id),
sp AS (SELECT DISTINCT 'en' AS answer, w AS id FROM (SELECT regexp_extract(lower(text), '[a-z]{8,}') AS w FROM benchmark) WHERE w <> '')"""


def _answer(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Points and spaces of one answer a language: documents, and the first long words of benchmark texts (English)."""
    word = c.table("benchmark").select("item_id", F.regexp_extract(F.lower("text"), "[a-z]{8,}", 0).alias("w"))
    spaces = word.where("w <> ''").select(F.lit("en").alias("answer"), F.col("w").alias("id"), F.upper("w").alias("name")).distinct()
    docs = c.table("documents").join(word, F.col("doc_id") == F.col("item_id"), "left")
    applies = F.when(F.col("doc_id") % 4 == 0, F.array(F.substring("w", 1, 6), F.lit("no such space")))
    return docs.select(F.col("lang").alias("answer"), F.col("doc_id").alias("id"), "text", applies.alias("applies")), spaces


@query(f"""WITH {_ANSWER} SELECT pt.answer, pt.id AS src, 'GUIDES' AS rel, sp.id AS dst, CASE WHEN applies IS NULL THEN 0.7 ELSE 0.9 END::DOUBLE AS weight FROM pt JOIN sp USING (answer)
WHERE CASE WHEN applies IS NULL THEN contains(text, sp.id) ELSE len(list_filter(applies, lambda a: a <> '' AND (contains(a, sp.id) OR contains(sp.id, a)))) > 0 END""")
def space_edges(c: Catalog) -> DataFrame:
    """Documents, some with a list of the spaces that they are meant for, and the spaces that they guide."""
    points, spaces = _answer(c)
    return G.space_edges(points, spaces).withColumn("weight", F.col("weight").cast("double"))


@query(f"""WITH {_ANSWER}, k AS (SELECT * FROM (VALUES (0, 'zone', 'three zones'), (1, 'the', 'the plain way'), (2, 'or', 'split flow'), (3, 'an', 'single units')) v(i, k, m)),
h AS (SELECT answer, m, min((0, NULL::BIGINT, i)) AS pos FROM (SELECT DISTINCT answer FROM pt) JOIN k ON contains(answer, k) GROUP BY ALL UNION ALL SELECT answer, m, min((1, id, i)) FROM pt JOIN k ON contains(text, k) GROUP BY ALL),
f AS (SELECT answer, m, min(pos) AS pos FROM h WHERE answer IS NOT NULL GROUP BY ALL), r AS (SELECT answer, m, row_number() OVER (PARTITION BY answer ORDER BY pos, m) AS place FROM f), t AS (SELECT answer, m FROM r WHERE place <= 3)
SELECT answer, m AS src, 'GUIDES' AS rel, sp.id AS dst, 0.8::DOUBLE AS weight FROM t JOIN sp USING (answer) UNION ALL
SELECT answer, m, 'MENTIONED_IN', pt.id::VARCHAR, 0.9::DOUBLE FROM t JOIN pt USING (answer) WHERE len(list_filter(string_split(m, ' '), lambda w: contains(text, w))) > 0""")
def method_edges(c: Catalog) -> DataFrame:
    """The methods that documents of a language suggest, with the spaces that they guide and the documents that tell of them."""
    points, spaces = _answer(c)
    rules = [("zone", "three zones"), ("the", "the plain way"), ("or", "split flow"), ("an", "single units")]
    asked = points.select("answer", F.col("answer").alias("text")).distinct()
    found = G.inferred_methods(asked, points.select("answer", "id", F.col("text").alias("name")), rules)
    edges = G.method_edges(found, points.withColumn("id", F.col("id").cast("string")), spaces)
    return edges.withColumn("weight", F.col("weight").cast("double"))
