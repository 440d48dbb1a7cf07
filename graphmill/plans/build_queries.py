"""Queries of graph construction and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.catalog import Catalog
from graphmill.functions import text as X
from graphmill.operators import build as B
from graphmill.operators import graph_store as GS
from graphmill.operators import provider as PR
from graphmill.operators.joins import first_rule, without
from graphmill.plans.oracle import CHUNKS, DOC_TERMS, EDGES, GRAPH, NODES, TRIPLETS
from graphmill.plans.registry import query
from graphmill.workspace import folder


def _listed(x: str, name: str):
    return F.array_join(F.transform(x, lambda i: i.cast("string")), ",").alias(name)


@query(f"""WITH {TRIPLETS}, m AS (SELECT object AS id, count(*) AS mentions, string_agg(DISTINCT chunk_id::VARCHAR, ',' ORDER BY chunk_id::VARCHAR) AS chunk_ids, max(length(subject)) AS l FROM triplets GROUP BY object),
a AS (SELECT id, string_agg(a, ',' ORDER BY a) AS attributes FROM (SELECT DISTINCT object AS id, unnest([relation, 'd' || (doc_id % 5)]) AS a FROM triplets) GROUP BY id)
SELECT m.id, mentions, chunk_ids, min(subject) AS description, attributes FROM m JOIN triplets t ON t.object = m.id AND length(t.subject) = m.l JOIN a ON a.id = m.id GROUP BY ALL""")
def entity_merge(c: Catalog) -> DataFrame:
    """Mentions of an entity merged: chunk ids and attributes united, the longest description kept."""
    attributes = F.array("relation", F.concat(F.lit("d"), (F.col("doc_id") % 5).cast("string")))
    mentions = c.triplets().select(F.col("object").alias("id"), "chunk_id", F.col("subject").alias("description"), attributes.alias("attributes"))
    return B.merged_entities(mentions, ["id"]).select("id", "mentions", _listed("chunk_ids", "chunk_ids"), "description", F.array_join("attributes", ",").alias("attributes"))


@query(f"""WITH {NODES}, i AS (SELECT label, lower(regexp_replace(name, '\\s+', '', 'g')) AS canonical, min(id) AS id, count(*) AS n FROM nodes WHERE label <> 'Order' GROUP BY ALL) SELECT label, canonical, id, n FROM i""")
def concept_index(c: Catalog) -> DataFrame:
    return c.nodes().where("label <> 'Order'").groupBy("label", X.canonical(F.col("name")).alias("canonical")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("SELECT DISTINCT 'source:' || source AS id, 'Source' AS label, source AS title FROM documents")
def source_nodes(c: Catalog) -> DataFrame:
    return c.table("documents").select("source").distinct().select(F.concat(F.lit("source:"), "source").alias("id"), F.lit("Source").alias("label"), F.col("source").alias("title"))


@query(f"WITH {TRIPLETS} SELECT object AS entity, doc_id, chunk_id, max(confidence) AS confidence, count(*) AS n FROM triplets GROUP BY ALL")
def mentioned_in(c: Catalog) -> DataFrame:
    return c.triplets().groupBy(F.col("object").alias("entity"), "doc_id", "chunk_id").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


@query(f"""WITH {TRIPLETS}, r AS (SELECT object, chunk_id AS round FROM triplets), f AS (SELECT object, min(round) AS first_round FROM r GROUP BY object) SELECT first_round AS round, count(*) AS new_entities, (sum(count(*)) OVER (ORDER BY first_round))::BIGINT AS known FROM f GROUP BY first_round""")
def extraction_rounds(c: Catalog) -> DataFrame:
    """New entities in each round of extraction; a round without any would end it."""
    f = c.triplets().groupBy("object").agg(F.min("chunk_id").alias("round")).groupBy("round").agg(F.count("*").alias("new_entities"))
    return f.withColumn("known", F.sum("new_entities").over(Window.orderBy("round")))  # a row for each round


@query(f"""WITH {TRIPLETS}, d AS (SELECT DISTINCT subject AS src, relation AS rel, object AS dst, 0.9::DOUBLE AS confidence FROM triplets)
SELECT src, rel, dst, confidence, false AS is_inverse FROM d UNION ALL SELECT dst, CASE rel WHEN 'CONTAINS' THEN 'BELONGS_TO' ELSE 'REQUIRED_BY' END, src, 0.85, true FROM d WHERE rel IN ('CONTAINS', 'REQUIRES')""")
def inverse_edge(c: Catalog) -> DataFrame:
    d = c.triplets().select(F.col("subject").alias("src"), F.col("relation").alias("rel"), F.col("object").alias("dst"), F.lit(0.9).alias("confidence")).distinct()
    return B.with_inverse(d)


@query("""SELECT p_partkey AS partkey, p_type || ';' || p_size || ' mm' AS attributes, 'qualitative,quantitative' AS kinds FROM part""")
def attributes_attach(c: Catalog) -> DataFrame:
    a, b = F.col("p_type"), F.concat(F.col("p_size").cast("string"), F.lit(" mm"))
    rows = c.table("part").select(F.col("p_partkey").alias("partkey"), F.posexplode(F.array(a, b)).alias("i", "t")).withColumn("kind", X.is_quantitative(F.col("t")))
    return rows.groupBy("partkey").agg(F.sort_array(F.collect_list(F.struct("i", "t", "kind"))).alias("s")).select("partkey", F.array_join("s.t", ";").alias("attributes"), F.array_join("s.kind", ",").alias("kinds"))


@query(f"WITH {TRIPLETS} SELECT DISTINCT chunk_id, object AS entity_id, relation AS type FROM triplets")
def chunk_entity_index(c: Catalog) -> DataFrame:
    return c.triplets().select("chunk_id", F.col("object").alias("entity_id"), F.col("relation").alias("type")).distinct()


@query(f"""WITH {TRIPLETS}, m AS (SELECT DISTINCT split_part(subject, ':', 2)::BIGINT // 8 AS doc_id, split_part(subject, ':', 2)::BIGINT % 8 AS sequence, object AS entity FROM triplets)
SELECT a.doc_id, a.entity AS a, b.entity AS b, count(*) AS support FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.sequence < b.sequence AND b.sequence - a.sequence <= 3 AND a.entity <> b.entity GROUP BY ALL HAVING count(*) >= 2""")
def cooccurrence(c: Catalog) -> DataFrame:
    """Parts in orders at most three apart; eight neighbouring orders are a document."""
    k = F.substring_index("subject", ":", -1).cast("long")
    mentions = c.triplets().select(F.floor(k / 8).alias("doc_id"), (k % 8).alias("sequence"), F.col("object").alias("entity"))
    return B.cooccurrence(mentions)


@query("""SELECT p_partkey AS partkey, n_nationkey AS nationkey FROM part JOIN nation ON contains(upper(p_name), upper(substr(n_name, 1, 3)))""")
def rule_augmentation(c: Catalog) -> DataFrame:
    """Name contains a key of a small rule table: 25 rules, broadcast."""
    rules = c.table("nation").select(F.col("n_nationkey").alias("nationkey"), F.upper(F.substring("n_name", 1, 3)).alias("_k"))
    return c.table("part").join(F.broadcast(rules), F.upper("p_name").contains(F.col("_k"))).select(F.col("p_partkey").alias("partkey"), "nationkey")


@query(f"""WITH {EDGES}, x AS (SELECT src AS doc_id, dst AS entity FROM edges WHERE rel = 'REQUIRES')
SELECT a.entity AS a, b.entity AS b, count(*) AS docs FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL ORDER BY docs DESC, a, b LIMIT 100""")
def latent_candidates(c: Catalog) -> DataFrame:
    edges = c.edges()
    mentions = edges.where("rel = 'REQUIRES'").select(F.col("src").alias("doc_id"), F.col("dst").alias("entity"))
    known = edges.where("rel = 'PROVIDES'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return B.latent_candidates(mentions, known, 100)


@query()
def fuzzy_pairs(c: Catalog) -> DataFrame:
    """Part types and names that nearly agree; difflib's ratio has no SQL form."""
    return B.fuzzy_pairs(c.table("part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name")), "p_brand", "name")


@query()
def fusion_suggestions(c: Catalog) -> DataFrame:
    """The fifty best fuzzy pairs, with a bonus of 0.02 for each relation type that both have."""
    parts = c.table("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    rels = c.edges().select(F.col("dst").alias("id"), "rel").distinct()
    byname = parts.join(rels, "id", "left").groupBy("p_brand", "name").agg(F.collect_set("rel").alias("rels"))
    pairs = B.fuzzy_pairs(parts, "p_brand", "name")
    a, b = byname.select("p_brand", F.col("name").alias("a"), F.col("rels").alias("_ra")), byname.select("p_brand", F.col("name").alias("b"), F.col("rels").alias("_rb"))
    scored = pairs.join(a, ["p_brand", "a"]).join(b, ["p_brand", "b"]).withColumn("score", F.round(F.col("score") + 0.02 * F.size(F.array_intersect("_ra", "_rb")), 4))
    return scored.select("p_brand", "a", "b", "score").orderBy(F.desc("score"), "a", "b").limit(50)


@query("""WITH s AS (SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 4) AS score FROM nation a JOIN nation b ON a.n_name < b.n_name AND a.n_regionkey = b.n_regionkey)
SELECT CASE WHEN length(a) <= length(b) THEN a ELSE b END AS canonical, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS alias, score FROM s WHERE score >= 0.3 ORDER BY score DESC, canonical, alias LIMIT 20""")
def alias_edges(c: Catalog) -> DataFrame:
    n = c.table("nation").select("n_name", "n_regionkey")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    pairs = a.join(b, "n_regionkey").where("a < b")
    score = F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")), 4)
    short = F.length("a") <= F.length("b")
    return pairs.select(F.when(short, F.col("a")).otherwise(F.col("b")).alias("canonical"), F.when(short, F.col("b")).otherwise(F.col("a")).alias("alias"), score.alias("score")).where("score >= 0.3").orderBy(F.desc("score"), "canonical", "alias").limit(20)


@query(f"""WITH {EDGES}, k AS (SELECT s_suppkey AS id, s_nationkey AS g FROM supplier), m AS (SELECT 'supplier:' || id AS node, 'supplier:' || min(id) OVER (PARTITION BY g) AS target, id, min(id) OVER (PARTITION BY g) AS t FROM k), p AS (SELECT node, min(target) OVER (PARTITION BY t) AS target FROM m),
lex AS (SELECT m.node, min(m2.node) AS target FROM m JOIN m m2 ON m.t = m2.t GROUP BY m.node), r AS (SELECT DISTINCT coalesce(a.target, e.src) AS src, e.rel, coalesce(b.target, e.dst) AS dst FROM edges e LEFT JOIN lex a ON a.node = e.src LEFT JOIN lex b ON b.node = e.dst WHERE e.rel IN ('PROVIDES', 'CONTAINS'))
SELECT src, rel, dst FROM r WHERE src <> dst""")
def node_merge(c: Catalog) -> DataFrame:
    """Suppliers of a nation are one: merges follow chains, edges are moved and united."""
    s = c.table("supplier").select("s_nationkey", F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), "s_suppkey")
    nxt = F.lead("id").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    merges = s.select(F.col("id").alias("src"), nxt.alias("dst"))
    return B.repointed(c.edges().where("rel IN ('PROVIDES', 'CONTAINS')"), B.redirects(merges))


@query(f"""WITH {TRIPLETS}, n AS (SELECT 'part:' || p_partkey AS old, 'type:' || p_type AS new FROM part) SELECT subject, relation, coalesce(n.new, object) AS object, max(confidence) AS confidence FROM triplets LEFT JOIN n ON n.old = object GROUP BY ALL""")
def synonym_mapping(c: Catalog) -> DataFrame:
    names = c.table("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("old"), F.concat(F.lit("type:"), "p_type").alias("new"))
    return B.renamed(c.triplets(), names).groupBy("subject", "relation", "object").agg(F.max("confidence").alias("confidence"))


@query("SELECT p_name AS name, min(p_type) AS type FROM part GROUP BY p_name HAVING count(DISTINCT p_type) = 1")
def unambiguous_names(c: Catalog) -> DataFrame:
    return c.table("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("type"), F.countDistinct("p_type").alias("n")).where("n = 1").drop("n")


@query(f"""WITH {TRIPLETS} SELECT subject AS src, relation AS rel, object AS dst, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT chunk_id)), ',') AS chunk_ids, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS doc_ids, count(*) AS support_count FROM triplets GROUP BY ALL""")
def evidence_agg(c: Catalog) -> DataFrame:
    e = c.triplets().select(F.col("subject").alias("src"), F.col("relation").alias("rel"), F.col("object").alias("dst"), "confidence", "chunk_id", "doc_id")
    return B.evidence(e, ["src", "rel", "dst"]).select("src", "rel", "dst", "confidence", _listed("chunk_ids", "chunk_ids"), _listed("support_doc_ids", "doc_ids"), "support_count")


@query(f"WITH {TRIPLETS} SELECT lower(subject) AS subject, lower(relation) AS relation, lower(object) AS object, max(confidence) AS confidence FROM triplets GROUP BY ALL")
def relation_merge(c: Catalog) -> DataFrame:
    return B.strongest_statements(c.triplets())


@query(f"""WITH {TRIPLETS}, m AS (SELECT subject, CASE relation WHEN 'CONTAINS' THEN 'CONTAINS' WHEN 'REQUIRES' THEN 'REQUIRES' ELSE 'n/a' END AS relation, coalesce('Kind:' || p_brand, object) AS object, confidence, chunk_id, doc_id FROM triplets LEFT JOIN part ON object = 'part:' || p_partkey AND p_size > 10),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(subject), lower(relation), lower(object) ORDER BY chunk_id, doc_id, confidence, object) AS k FROM m WHERE subject <> object AND confidence >= 0.92) SELECT subject, relation, object, confidence FROM r WHERE k = 1""")
def stage_three(c: Catalog) -> DataFrame:
    """Names and relations in their standard form, validation, then the first statement of each triple, case aside."""
    names = c.table("part").where("p_size > 10").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("old"), F.concat(F.lit("Kind:"), "p_brand").alias("new"))
    raw = c.triplets().withColumn("relation", F.when(F.col("relation") == "CONTAINS", "includes").when(F.col("relation") == "REQUIRES", " Requires ").otherwise("n/a"))
    standard = X.normalized_relation(F.col("relation"), ("CONTAINS", "REQUIRES"), {"includes": "CONTAINS"}, ("n/a",))
    return B.optimized(raw, names, standard, ["chunk_id", "doc_id", "confidence", "object"], 0.92).select("subject", "relation", "object", "confidence")


@query(f"WITH {TRIPLETS} SELECT object AS entity, count(DISTINCT doc_id) AS sources FROM triplets GROUP BY object HAVING count(DISTINCT doc_id) >= 2 ORDER BY sources DESC, entity LIMIT 500")
def multi_source_entities(c: Catalog) -> DataFrame:
    return c.triplets().groupBy(F.col("object").alias("entity")).agg(F.countDistinct("doc_id").alias("sources")).where("sources >= 2").orderBy(F.desc("sources"), "entity").limit(500)


@query(f"""WITH {TRIPLETS}, a AS (SELECT *, CASE WHEN confidence >= 0.97 THEN 'accept' WHEN confidence >= 0.92 THEN 'review' ELSE 'reject' END AS action FROM triplets), b AS (SELECT action, (row_number() OVER (PARTITION BY action ORDER BY subject, object, chunk_id, doc_id) - 1) // 100 AS batch FROM a) SELECT action, count(*) AS n, max(batch) + 1 AS batches FROM b GROUP BY action""")
def verified_write(c: Catalog) -> DataFrame:
    """Counters by class, and the number of write batches of a hundred."""
    action = F.when(F.col("confidence") >= 0.97, "accept").when(F.col("confidence") >= 0.92, "review").otherwise("reject")
    return c.triplets().groupBy(action.alias("action")).agg(F.count("*").alias("n")).select("action", "n", F.ceil(F.col("n") / 100).alias("batches"))


@query(f"""WITH {GRAPH}, {TRIPLETS}, t AS (SELECT subject AS src, object AS dst, max(confidence) AS confidence, count(DISTINCT doc_id) AS docs FROM triplets GROUP BY ALL) SELECT e.src, e.rel, e.dst, greatest(coalesce(t.confidence, 0), 0.5)::DOUBLE AS confidence, coalesce(t.docs, 0) AS docs FROM edges e LEFT JOIN t USING (src, dst) WHERE e.rel = 'REQUIRES'""")
def edge_backfill(c: Catalog) -> DataFrame:
    t = c.triplets().groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.max("confidence").alias("_c"), F.countDistinct("doc_id").alias("_d"))
    e = c.edges().where("rel = 'REQUIRES'").join(t, ["src", "dst"], "left")
    return e.select("src", "rel", "dst", F.greatest(F.coalesce("_c", F.lit(0.0)), F.lit(0.5)).alias("confidence"), F.coalesce("_d", F.lit(0).cast("long")).alias("docs"))


@query("""SELECT CASE WHEN p_type LIKE '%BRASS' THEN 'Zone' WHEN p_type LIKE '%STEEL' AND p_size > 20 THEN 'Area' ELSE 'Part' END AS label, (p_type LIKE '%BRASS' OR (p_type LIKE '%STEEL' AND p_size > 20)) AS changed, count(*) AS n FROM part GROUP BY ALL""")
def zone_relabel(c: Catalog) -> DataFrame:
    """Promotion by suffix, with a protected exception."""
    p = c.table("part").select(F.lit("Part").alias("label"), "p_type", "p_size")
    rules = [(F.col("p_type").endswith("BRASS"), "Zone"), (F.col("p_type").endswith("STEEL") & (F.col("p_size") > 20), "Area")]
    return B.relabelled(p, rules).groupBy("label", "changed").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT p_name AS name, list_sort(list(p_partkey)) AS ids FROM part GROUP BY p_name) SELECT name, ids[1] AS kept, len(ids)::INT AS merged, CASE WHEN len(ids) = 1 THEN ids[1] END AS only FROM g""")
def same_name_merge(c: Catalog) -> DataFrame:
    """Same names merged into the smallest id; lists of one element unwrapped."""
    g = c.table("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("kept"), F.count("p_partkey").cast("int").alias("merged"))
    return g.select("name", "kept", "merged", F.when(F.col("merged") == 1, F.col("kept")).alias("only"))


@query("""SELECT c_custkey AS custkey, CASE WHEN c_mktsegment LIKE '%BUILD%' THEN 'group:construction' WHEN c_mktsegment LIKE '%AUTO%' THEN 'group:vehicles' ELSE 'group:other' END AS parent FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphan_attach(c: Catalog) -> DataFrame:
    """Customers without orders get the parent of the first rule that fits."""
    orphans = c.table("customer").join(c.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return orphans.select(F.col("c_custkey").alias("custkey"), first_rule(F.col("c_mktsegment"), [("BUILD", "group:construction"), ("AUTO", "group:vehicles")], "group:other").alias("parent"))


@query(f"""WITH {GRAPH} SELECT (SELECT count(*) FROM nodes WHERE trim(name, ' ') = '') AS unnamed, (SELECT count(*) FROM (SELECT label, name FROM nodes GROUP BY ALL HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM edges WHERE src = dst) AS loops""")
def cleaner_audit(c: Catalog) -> DataFrame:
    nodes = c.nodes()
    repeated = nodes.groupBy("label", "name").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    unnamed = nodes.agg(F.count_if(F.trim("name") == "").alias("unnamed"))
    return unnamed.join(F.broadcast(repeated)).join(F.broadcast(c.edges().agg(F.count_if(F.col("src") == F.col("dst")).alias("loops")))).select("unnamed", "repeated", "loops")


@query(f"""WITH {EDGES}, p AS (SELECT DISTINCT a.src, c.dst FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.rel = 'CONTAINS' AND b.rel = 'PLACED' AND c.rel = 'REQUIRES') SELECT src, 'DEMANDS' AS rel, dst, true AS inferred FROM p WHERE (src, dst) NOT IN (SELECT (src, dst) FROM edges)""")
def enrich_edges(c: Catalog) -> DataFrame:
    """An inferred edge over three typed hops, where none exists."""
    edges = c.edges()
    step = lambda r, a, b: edges.where(F.col("rel") == r).select(F.col("src").alias(a), F.col("dst").alias(b))
    wanted = step("PLACED", "x", "y").join(step("REQUIRES", "y", "dst"), "y").select("x", "dst").distinct()
    pairs = step("CONTAINS", "src", "x").join(wanted, "x").select("src", "dst").distinct()
    return without(pairs, edges, ["src", "dst"]).select("src", F.lit("DEMANDS").alias("rel"), "dst", F.lit(True).alias("inferred"))


@query("SELECT source, count(*) AS new_docs FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def incremental_titles(c: Catalog) -> DataFrame:
    return c.table("documents").join(c.table("labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("new_docs"))


@query(f"""WITH {GRAPH} SELECT (SELECT count(*) > 0 FROM nodes) AS has_nodes, (SELECT count(*) > 0 FROM edges) AS has_edges, (SELECT count(DISTINCT rel) = 4 FROM edges) AS has_relations""")
def prebuild_checks(c: Catalog) -> DataFrame:
    e = c.edges().agg((F.count("*") > 0).alias("has_edges"), (F.countDistinct("rel") == 4).alias("has_relations"))
    return c.nodes().agg((F.count("*") > 0).alias("has_nodes")).join(F.broadcast(e))


@query(f"""WITH {DOC_TERMS}, m AS (SELECT doc_id, term, count(*) AS n FROM doc_terms WHERE length(term) >= 10 GROUP BY ALL) SELECT term, count(*) AS docs, sum(n)::BIGINT AS mentions, count(*) >= 2 AS shared FROM m GROUP BY term""")
def entity_sources(c: Catalog) -> DataFrame:
    m = c.doc_terms().where("length(term) >= 10").groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return m.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("mentions")).withColumn("shared", F.col("docs") >= 2)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS chunk, entity, type FROM (SELECT l_orderkey, unnest(['part:' || l_partkey, 'supplier:' || l_suppkey, 'nation:' || s_nationkey]) AS entity, unnest(['space', 'unit', 'department']) AS type FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)),
s AS (SELECT DISTINCT a.chunk, a.entity, b.entity AS parent FROM m a LEFT JOIN m b ON a.chunk = b.chunk AND ((a.type = 'space' AND b.type IN ('unit', 'department')) OR (a.type = 'unit' AND b.type = 'department')) WHERE a.type IN ('space', 'unit'))
SELECT chunk, entity, coalesce(string_agg(parent, ',' ORDER BY parent), '') AS scope FROM s GROUP BY chunk, entity""")
def scope_inference(c: Catalog) -> DataFrame:
    """The entities of a parent type that an order names are the scope of its parts and suppliers."""
    nation = c.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = c.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(nation, "l_suppkey")
    named = lambda kind, column, label: F.struct(F.concat(F.lit(f"{label}:"), F.col(column).cast("string")).alias("entity"), F.lit(kind).alias("type"))
    ents = F.array(named("space", "l_partkey", "part"), named("unit", "l_suppkey", "supplier"), named("department", "s_nationkey", "nation"))
    mentions = lines.select(F.col("l_orderkey").alias("chunk"), F.explode(ents).alias("e")).select("chunk", "e.*")
    found = B.scope_chains(mentions, {"space": ("unit", "department"), "unit": ("department",)})
    return found.select("chunk", "entity", F.array_join("scope", ",").alias("scope"))


@query()
def cooccurrence_edges(c: Catalog) -> DataFrame:
    """Parts of neighbouring orders, with rules by their brands' types and the graph's own edges as the stronger ones."""
    kind = c.table("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity"), F.substring_index("p_type", " ", -1).alias("type"))
    k = F.substring_index("subject", ":", -1).cast("long")
    mentions = c.triplets().select(F.floor(k / 8).alias("doc_id"), (k % 8).alias("sequence"), F.col("object").alias("entity")).join(kind, "entity")
    known = c.edges().where("rel = 'PROVIDES'")
    return B.cooccurrence_edges(mentions, known, {("BRASS", "STEEL"): ("REQUIRES", 0.7), ("TIN", "TIN"): ("ADJACENT", 0.5)})


@query(f"""WITH {TRIPLETS}, a AS (SELECT object AS id, max(confidence) AS score, list(DISTINCT chunk_id) AS l FROM triplets WHERE relation = 'REQUIRES' GROUP BY object), b AS (SELECT object AS id, min(confidence) AS score, list(DISTINCT chunk_id) AS l FROM triplets WHERE relation = 'CONTAINS' GROUP BY object)
SELECT id, coalesce(b.score, a.score) AS score, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.l, []), coalesce(b.l, [])))), ',') AS chunk_ids FROM a FULL JOIN b USING (id)""")
def graph_upsert(c: Catalog) -> DataFrame:
    """MERGE on id: the new value wins, chunk ids are united."""
    t = c.triplets()
    a = t.where("relation = 'REQUIRES'").groupBy(F.col("object").alias("id")).agg(F.max("confidence").alias("score"), F.collect_set("chunk_id").alias("l"))
    b = t.where("relation = 'CONTAINS'").groupBy(F.col("object").alias("id")).agg(F.min("confidence").alias("score"), F.collect_set("chunk_id").alias("l"))
    return B.upserted(a, b, "id", "score", "l").select("id", "score", _listed("l", "chunk_ids"))


@query(f"WITH {TRIPLETS}, k AS (SELECT DISTINCT relation, object FROM triplets) SELECT relation, CASE relation WHEN 'RELATED_TO' THEN 'review' ELSE 'accept' END AS verdict, count(*) AS n FROM k GROUP BY ALL")
def relations_by_provider(c: Catalog) -> DataFrame:
    """Each distinct relation of an object is judged once, the surest first; a rule stands in for the model."""
    t = c.triplets().groupBy("relation", "object").agg(F.max("confidence").alias("confidence"))
    rows = t.select(F.concat_ws("|", "relation", "object").alias("key"), (-F.col("confidence")).alias("rank"), F.concat_ws("|", "relation", "object").alias("payload"))
    done, _ = PR.answered(rows, lambda payloads: ["review" if p.startswith("RELATED_TO|") else "accept" for p in payloads], folder(c.spark, "provider"), size=200)
    return done.groupBy(F.substring_index("key", "|", 1).alias("relation"), F.col("answer").alias("verdict")).agg(F.count("*").alias("n"))


# -- a stored graph that loses documents ----------------------------------------------------------------------------

#: Suppliers play the documents; those in debt are removed.
_GONE = "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0"


def _without_debtors(c: Catalog) -> GS.Store:
    store = GS.create(c.spark, folder(c.spark, "graph"))
    GS.add(store, c.triplets())
    GS.remove(store, c.table("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("doc_id")))
    return store


@query(f"WITH {TRIPLETS} SELECT subject AS src, relation AS rel, object AS dst, count(*) AS support FROM triplets WHERE doc_id NOT IN ({_GONE}) GROUP BY ALL")
def cascade_delete_edges(c: Catalog) -> DataFrame:
    """Edges that a document still supports after others were removed from a stored graph."""
    return _without_debtors(c).edges()


@query(f"""WITH {TRIPLETS}, k AS (SELECT * FROM triplets WHERE doc_id NOT IN ({_GONE})), n AS (SELECT id, count(*) AS support FROM (SELECT subject AS id FROM k UNION ALL SELECT object FROM k) GROUP BY id), s AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_size = 1)
SELECT coalesce(n.id, s.id) AS id, coalesce(support, 0) AS support, s.id IS NOT NULL AS seed FROM n FULL JOIN s ON n.id = s.id""")
def cascade_delete_nodes(c: Catalog) -> DataFrame:
    """Nodes that are still supported, and seeds, which stay anyway."""
    return _without_debtors(c).nodes(c.table("part").where("p_size = 1").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id")))


@query("SELECT unnest(['edges_support', 'nodes_support', 'dangling_ends']) AS problem, 0::BIGINT AS n")
def cascade_delete_verified(c: Catalog) -> DataFrame:
    """What is left holds together."""
    return GS.verified(_without_debtors(c))


@query(f"""WITH {TRIPLETS}, b AS (SELECT count(DISTINCT doc_id) AS documents, (SELECT count(*) FROM (SELECT subject FROM triplets UNION SELECT object FROM triplets)) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT subject, relation, object FROM triplets)) AS edges FROM triplets)
SELECT unnest(['documents', 'nodes', 'edges']) AS store, unnest([documents, nodes, edges]) AS before, unnest([documents, nodes, edges]) AS after FROM b""")
def rebuild_documents(c: Catalog) -> DataFrame:
    """Counts before and after the debtors' documents are taken out and built again."""
    store = GS.create(c.spark, folder(c.spark, "graph"))
    GS.add(store, c.triplets())
    return GS.rebuilt(store, c.triplets(), c.table("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("doc_id")))
