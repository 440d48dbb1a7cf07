"""Queries of vector and keyword retrieval and of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.catalog import Catalog
from graphmill.functions import text as X
from graphmill.functions import vectors as V
from graphmill.operators import ivf, postings
from graphmill.operators import provider as PR
from graphmill.operators import retrieval as R
from graphmill.operators.joins import overlapping
from graphmill.operators.sets import ordered_union
from graphmill.plans.oracle import CHUNKS, DOC_TERMS, ITEMS, NODES, TASKS, TRIPLETS
from graphmill.plans.registry import query
from graphmill.workspace import folder

_VEC = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT q.id AS query_id, v.id, v.label, list_inner_product(q.e, v.e) AS s FROM v AS q, v WHERE q.id % 100 = 0)"""


def _vectors(c: Catalog) -> DataFrame:
    return c.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _queries(c: Catalog) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return _vectors(c).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))


@query(f"WITH {_VEC} SELECT query_id, id, round(s, 4) AS score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM p) WHERE r <= 10")
def vec_topk(c: Catalog) -> DataFrame:
    return R.vector_top_k(_vectors(c), _queries(c), 10)


@query(f"WITH {_VEC} SELECT query_id, id, round(s, 4) AS score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM p WHERE label IN (1, 2, 3)) WHERE r <= 5 AND s >= 0.1")
def vec_topk_filtered(c: Catalog) -> DataFrame:
    return R.vector_top_k(_vectors(c), _queries(c), 5, keep=F.col("label").isin(1, 2, 3), least=0.1)


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12), 4) AS unit FROM embeddings")
def vec_normalize(c: Catalog) -> DataFrame:
    v = F.col("embedding")
    return c.table("embeddings").select(F.col("vec_id").alias("id"), F.round(V.norm(v), 6).alias("norm"), F.round(V.norm(V.normalized(v)), 4).alias("unit"))


@query("SELECT vec_id AS id, 80 AS padded, 16 AS cut, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE)), 6) AS head FROM embeddings")
def vec_dim_fix(c: Catalog) -> DataFrame:
    v = F.col("embedding")
    return c.table("embeddings").select(F.col("vec_id").alias("id"), F.size(V.fitted(v, 80)).alias("padded"), F.size(V.fitted(v, 16)).alias("cut"), F.round(F.aggregate(V.fitted(v, 16), F.lit(0.0), lambda s, x: s + x), 6).alias("head"))


@query("SELECT label, count(*) AS lists, greatest(8, least(128, round(count(*) * 0.05)::INT)) AS nprobe FROM embeddings GROUP BY label")
def probe_count(c: Catalog) -> DataFrame:
    return c.table("embeddings").groupBy("label").agg(F.count("*").alias("lists")).select("label", "lists", R.probes(F.col("lists")).alias("nprobe"))


@query(f"""WITH {_VEC}, c AS (SELECT label, min(id) AS cid FROM v GROUP BY label), s AS (SELECT v.id, c.label AS list_id, list_inner_product(v.e, q.e) AS s FROM v, c JOIN v AS q ON q.id = c.cid), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, list_id) AS k FROM s) SELECT id, list_id FROM r WHERE k = 1""")
def ivf_assign(c: Catalog) -> DataFrame:
    """Nearest of the labels' first vectors: the cluster column of an inverted-file index."""
    v = _vectors(c)
    centroids = v.groupBy(F.col("label").alias("list_id")).agg(F.min_by("vector", "id").alias("centroid"))
    return R.clustered(v, centroids)


@query()
def ivf_search(c: Catalog) -> DataFrame:
    """The 10 nearest within as few trained lists as find 95 of 100 on sampled queries; recall is tested, not in SQL."""
    index = ivf.build(_vectors(c), folder(c.spark, "ivf"))
    return ivf.search(index, _queries(c), 10, ivf.calibrated(index, _queries(c), 10))


@query(f"WITH {_VEC} SELECT query_id, id, round(s, 4) AS score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM p WHERE label IN (1, 2, 3)) WHERE r <= 10")
def ivf_all_lists(c: Catalog) -> DataFrame:
    """The same index with all lists probed, under a filter: exact."""
    index = ivf.build(_vectors(c), folder(c.spark, "ivf"))
    return ivf.search(index, _queries(c), 10, ivf.LISTS, keep=F.col("label").isin(1, 2, 3))


@query("SELECT label, count(*) AS k, greatest(30, least(64, 2 * count(*)))::INT AS filtered, greatest(10, least(32, 2 * count(*)))::INT AS plain FROM embeddings WHERE vec_id % 100 = 0 GROUP BY label")
def probe_count_by_k(c: Catalog) -> DataFrame:
    """Lists to probe for as many hits as a label has queries, with and without a filter."""
    k = c.table("embeddings").where("vec_id % 100 = 0").groupBy("label").agg(F.count("*").alias("k"))
    return k.select("label", "k", R.probes_for(F.col("k"), True).alias("filtered"), R.probes_for(F.col("k"), False).alias("plain"))


@query(f"""WITH {_VEC}, h AS (SELECT query_id, id, label, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM p), t AS (SELECT * FROM h WHERE r <= 30)
SELECT query_id, id, r::INT AS rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN r <= 20 THEN 0 ELSE 1 END, CASE WHEN r <= 20 THEN -(CASE WHEN label < 5 THEN label ELSE 0 END) ELSE 0 END, r)::INT AS place FROM t""")
def rerank_head_tail(c: Catalog) -> DataFrame:
    """The first 20 of 30 hits by another score (their label, none from 5 on), the tail as it was."""
    hits = R.vector_top_k(_vectors(c), _queries(c), 30).select("query_id", "id", "rank")
    labels = c.table("embeddings").where("label < 5").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("new_score"))
    return R.reranked(hits, lambda h: h.select("query_id", "id").join(labels, "id"), head=20)


@query(f"""WITH {_VEC}, h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM p), t AS (SELECT * FROM h WHERE r <= 20), z AS (SELECT query_id, id, r, row_number() OVER (PARTITION BY query_id ORDER BY -(id % 7), r)::INT AS place FROM t)
SELECT query_id, id, r::INT AS rank, place FROM z WHERE place <= 5""")
def overfetch_rerank(c: Catalog) -> DataFrame:
    """Four times the wanted five are fetched, scored again and cut."""
    hits = R.vector_top_k(_vectors(c), _queries(c), 20).select("query_id", "id", "rank")
    return R.reranked(hits, lambda h: h.select("query_id", "id", (F.col("id") % 7).cast("double").alias("new_score")), top=5)


@query(f"""WITH {DOC_TERMS}, k AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS seq FROM benchmark),
t AS (SELECT item_id, x AS term, list_position(seq, x) AS tier FROM k, unnest(w) AS u(x)), h AS (SELECT DISTINCT t.item_id, t.tier, t.term, d.doc_id FROM t JOIN doc_terms d USING (term)),
m AS (SELECT item_id, min(tier) AS tier FROM h GROUP BY item_id) SELECT item_id, term, count(*) AS n_docs FROM h JOIN m USING (item_id, tier) GROUP BY item_id, term""")
def vec_multi_term_first_hit(c: Catalog) -> DataFrame:
    """For each question the first of its terms that any document has, and how many have it."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    terms = c.table("benchmark").select("item_id", words.alias("w")).select("item_id", F.posexplode("w").alias("tier", "term")).groupBy("item_id", "term").agg(F.min("tier").alias("tier"))
    docs = c.doc_terms().select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("n_docs"))
    return R.first_hits(terms.join(docs, "term"), "item_id", "tier").select("item_id", "term", "n_docs")


_QUESTION = """q AS (SELECT DISTINCT item_id AS query_id, x AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{6,}')[1:15] AS w FROM benchmark), unnest(w) AS u(x))"""


def _questions(c: Catalog) -> DataFrame:
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)), 1, 15)
    return c.table("benchmark").select(F.col("item_id").alias("query_id"), F.explode(words).alias("term")).distinct()


@query(f"""WITH {DOC_TERMS}, {_QUESTION}, l AS (SELECT doc_id, count(*) AS len FROM doc_terms GROUP BY doc_id), c AS (SELECT count(*) AS n, avg(len) AS a FROM l),
tf AS (SELECT term, doc_id, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len / a))), 4) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id) JOIN q USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def text_score(c: Catalog) -> DataFrame:
    """BM25 of each benchmark question against the documents: the score we define for full-text search."""
    return R.bm25(c.doc_terms().select("doc_id", "term"), _questions(c), 5)


@query(f"""WITH {DOC_TERMS}, {_QUESTION}, l AS (SELECT doc_id, count(*) AS len FROM doc_terms GROUP BY doc_id), c AS (SELECT count(*) AS n, avg(len) AS a FROM l),
tf AS (SELECT term, doc_id, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len / a))), 4) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id) JOIN q USING (term), c GROUP BY ALL),
p AS (SELECT item_id AS query_id, regexp_extract(lower(text), '[a-z]+ [a-z]+') AS phrase FROM benchmark),
r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN p USING (query_id) JOIN documents USING (doc_id) WHERE contains(lower(text), phrase)) SELECT query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def text_phrases(c: Catalog) -> DataFrame:
    """The same among documents that contain the first two neighbouring words of the question as a phrase."""
    phrases = c.table("benchmark").select(F.col("item_id").alias("query_id"), F.regexp_extract(F.lower("text"), "[a-z]+ [a-z]+", 0).alias("phrase")).where("phrase <> ''")
    return R.bm25(c.doc_terms().select("doc_id", "term"), _questions(c), 5, phrases=phrases, texts=c.table("documents"))


def _bm25_sql(docs: str) -> str:
    """BM25 of the questions over the documents that a condition keeps."""
    return f"""WITH {DOC_TERMS}, {_QUESTION}, kept AS (SELECT doc_id FROM documents d WHERE {docs}), dt AS (SELECT * FROM doc_terms JOIN kept USING (doc_id)),
l AS (SELECT doc_id, count(*) AS len FROM dt GROUP BY doc_id), c AS (SELECT (SELECT count(*) FROM kept) AS n, (SELECT sum(len) FROM l) / (SELECT count(*) FROM kept) AS a),
tf AS (SELECT term, doc_id, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len / a))), 4) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id) JOIN q USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 5"""


def _indexed(c: Catalog) -> postings.Index:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    index = postings.create(c.spark, folder(c.spark, "postings"))
    postings.add(index, c.table("documents").select("doc_id", words.alias("terms")))
    return index


@query(_bm25_sql("true"))
def text_index_score(c: Catalog) -> DataFrame:
    """BM25 off stored postings: only blocks that can reach the fifth best score are read."""
    return postings.search(_indexed(c), _questions(c), 5)


@query(f"""WITH hits AS ({_bm25_sql("true")}), d AS (SELECT DISTINCT doc_id FROM hits) SELECT doc_id, substr(string_split(text, chr(10))[1], 1, 80) AS point FROM d JOIN documents USING (doc_id)""")
def points_of_hits(c: Catalog) -> DataFrame:
    """A knowledge point of each document that is hit, asked in batches by its best rank; its head stands in for the model's."""
    best = postings.search(_indexed(c), _questions(c), 5).groupBy("doc_id").agg(F.min("rank").alias("rank"))
    rows = best.join(c.table("documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").cast("string").alias("key"), "rank", F.col("text").alias("payload"))
    done, _ = PR.answered(rows, lambda payloads: [p.split("\n")[0][:80] for p in payloads], folder(c.spark, "provider"))
    return done.select(F.col("key").cast("long").alias("doc_id"), F.col("answer").alias("point"))


@query(_bm25_sql("NOT EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.doc_id < d.doc_id)"))
def text_index_without_copies(c: Catalog) -> DataFrame:
    """The same after later copies of a text have been removed from the index, which is not rebuilt."""
    docs = c.table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("first"))
    index = _indexed(c)
    postings.remove(index, docs.where("key IS NOT NULL").join(first, "key").where("doc_id > first").select("doc_id"))
    return postings.search(index, _questions(c), 5)


@query(f"WITH {CHUNKS} SELECT doc_id, sequence FROM chunks WHERE regexp_matches(lower(content), 'worth|\\$\\$|a\\.b')")
def kw_regex_or(c: Catalog) -> DataFrame:
    """Escaped terms, any of them, case ignored: plain containment, no pattern is built."""
    return c.chunks().where(X.contains_any(F.lower("content"), ["worth", "$$", "a.b"])).select("doc_id", "sequence")


@query(f"WITH {CHUNKS} SELECT doc_id, sequence FROM chunks WHERE regexp_matches(content, 'th[aeiou]n.*ing')")
def kw_raw_regex(c: Catalog) -> DataFrame:
    return c.chunks().where(F.col("content").rlike("th[aeiou]n.*ing")).select("doc_id", "sequence")


@query(f"""WITH {CHUNKS}, k AS (SELECT source, doc_id, sequence, CASE WHEN contains(content, 'worthless') THEN 1 WHEN contains(lower(content), 'the thing') THEN 2 WHEN regexp_matches(content, '[0-9]') THEN 3 END AS tier FROM chunks),
m AS (SELECT source, min(tier) AS tier FROM k GROUP BY source) SELECT source, doc_id, sequence, CASE tier WHEN 1 THEN 'terms' WHEN 2 THEN 'text' ELSE 'regex' END AS strategy FROM k JOIN m USING (source, tier)""")
def kw_cascade(c: Catalog) -> DataFrame:
    """Per source the hits of its best strategy that has any, and which."""
    content = F.col("content")
    tier = F.when(content.contains("worthless"), 1).when(F.lower(content).contains("the thing"), 2).when(content.rlike("[0-9]"), 3)
    hits = c.chunks().select("source", "doc_id", "sequence", tier.alias("tier")).where("tier IS NOT NULL")
    return R.first_hits(hits, "source", "tier").select("source", "doc_id", "sequence", F.when(F.col("tier") == 1, "terms").when(F.col("tier") == 2, "text").otherwise("regex").alias("strategy"))


@query("""WITH r AS (SELECT o_orderkey AS k, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT k FROM r WHERE lo <= 6 + 1 AND hi >= 6 - 1""")
def page_overlap(c: Catalog) -> DataFrame:
    r = c.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    r = r.join(c.table("orders").select(F.col("o_orderkey").alias("k")), "k", "left_semi")
    return overlapping(r, "lo", "hi", F.lit(6), 1).select("k")


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, sequence, CASE WHEN content_type <> 'table' THEN NULL WHEN sequence BETWEEN 2 AND 4 THEN 1 ELSE 2 END AS tier FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, sequence) AS k FROM t WHERE tier IS NOT NULL) SELECT doc_id, sequence, tier FROM r WHERE k <= 3""")
def images_near_pages(c: Catalog) -> DataFrame:
    """Tables near line 3 first, then any of the document, three at most."""
    hits = c.chunks().where("content_type = 'table'").select("doc_id", "sequence", F.when(F.abs(F.col("sequence") - 3) <= 1, 1).otherwise(2).alias("tier"))
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("tier", "sequence"))).where("_k <= 3").drop("_k")


@query(f"""WITH {CHUNKS}, a AS (SELECT DISTINCT doc_id FROM chunks WHERE contains(content, 'worthless')) SELECT doc_id, sequence, 'hit' AS origin FROM chunks WHERE contains(content, 'worthless')
UNION ALL SELECT doc_id, min(sequence), 'supplement' FROM chunks WHERE content_type = 'table' AND doc_id NOT IN (SELECT doc_id FROM a) GROUP BY doc_id""")
def supplemented(c: Catalog) -> DataFrame:
    """Hits, and one table of each document that has none."""
    chunks = c.chunks()
    hits = chunks.where(F.col("content").contains("worthless")).select("doc_id", "sequence")
    more = chunks.where("content_type = 'table'").select("doc_id", "sequence").join(hits.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min("sequence").alias("sequence"))
    return hits.withColumn("origin", F.lit("hit")).unionByName(more.withColumn("origin", F.lit("supplement")))


@query(f"WITH {NODES} SELECT id, label, name FROM nodes WHERE contains(lower(name), 'an') ORDER BY label, name, id LIMIT 20")
def entity_substring(c: Catalog) -> DataFrame:
    return c.nodes().where(F.lower("name").contains("an")).orderBy("label", "name", "id").limit(20)


@query("SELECT md5(lower(trim(text, ' '))) AS key, count(*) AS uses FROM documents WHERE text IS NOT NULL GROUP BY 1")
def embedding_cache(c: Catalog) -> DataFrame:
    """Distinct texts are sent to the provider once, whatever number of rows uses them."""
    import pandas as pd

    keyed = c.table("documents").where("text IS NOT NULL").select(F.md5(F.lower(F.trim("text")).cast("binary")).alias("key"), "text")
    cache = keyed.where("false").select("key", F.array(F.lit(0.0)).alias("vector"))
    vectors = R.embedded(keyed, cache, lambda t: pd.Series([[float(len(x)), 1.0] for x in t]))
    return keyed.groupBy("key").agg(F.count("*").alias("uses")).join(vectors.select("key"), "key", "left_semi")


# -- filters --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def doc_scope(c: Catalog) -> DataFrame:
    """Titles are normalised and resolved to documents; ids, if there were any, would win."""
    titles = c.spark.createDataFrame([("a/《src1》",), ("src3.pdf",)], "title string").select(X.normalized_title(F.col("title")).alias("_t"))
    docs = c.table("documents").select("doc_id", "source").withColumn("_t", X.normalized_title(F.col("source")))
    return docs.join(F.broadcast(titles), "_t", "left_semi").select("doc_id", "source")


@query(f"""WITH {ITEMS}, w AS (SELECT *, abs(page - 2) <= 1 OR abs(page - 6) <= 1 AS near FROM items), a AS (SELECT entity_id, bool_or(near) AS any_near FROM w GROUP BY entity_id) SELECT entity_id, pos, page FROM w JOIN a USING (entity_id) WHERE near OR NOT any_near""")
def page_filter(c: Catalog) -> DataFrame:
    """Not strict: a hard filter where it leaves something, else all."""
    near = F.exists(F.array(F.lit(2), F.lit(6)), lambda p: F.abs(F.col("page") - p) <= 1)
    rows = c.items().select("entity_id", "pos", "page", near.alias("near"))
    some = rows.groupBy("entity_id").agg(F.bool_or("near").alias("_any"))
    return rows.join(some, "entity_id").where(F.col("near") | ~F.col("_any")).select("entity_id", "pos", "page")


@query(f"""WITH {TRIPLETS}, t AS (SELECT *, split_part(subject, ':', 1) AS a, split_part(object, ':', 1) AS b FROM triplets) SELECT subject, relation, object, confidence FROM t WHERE relation <> 'RELATED_TO' AND (a, relation, b) IN (('order', 'REQUIRES', 'part'), ('order', 'CONTAINS', 'part')) AND confidence >= 0.95""")
def triple_admission(c: Catalog) -> DataFrame:
    """Allowed relations whose ends have the constrained types, by a broadcast of the constraint table."""
    spark = c.spark
    allowed = spark.createDataFrame([("order", "REQUIRES", "part"), ("order", "CONTAINS", "part")], "_a string, relation string, _b string")
    kind = lambda x: F.substring_index(x, ":", 1)
    rows = c.triplets().where("relation <> 'RELATED_TO' AND confidence >= 0.95").withColumns({"_a": kind("subject"), "_b": kind("object")})
    return rows.join(F.broadcast(allowed), ["_a", "relation", "_b"], "left_semi").select("subject", "relation", "object", "confidence")


@query(f"""WITH {TRIPLETS} SELECT subject, relation, object, confidence FROM triplets WHERE subject <> object AND relation NOT IN ('', 'SKIP') AND confidence >= 0.92""")
def triple_validation(c: Catalog) -> DataFrame:
    return c.triplets().where((F.col("subject") != F.col("object")) & ~F.col("relation").isin("", "SKIP") & (F.col("confidence") >= 0.92)).select("subject", "relation", "object", "confidence")


@query(f"""WITH {TRIPLETS}, t AS (SELECT relation, p_size, p_type, CASE WHEN p_size = 12 THEN 'page 12' WHEN p_size = 13 THEN '>= 13 mm' ELSE p_type END AS name FROM triplets JOIN part ON object = 'part:' || p_partkey),
r AS (SELECT CASE WHEN p_size = 12 THEN 'reject:page_reference' WHEN relation = 'RELATED_TO' THEN 'skip:no_constraint' WHEN relation = 'REQUIRES' AND p_size > 5 THEN 'skip:schema_match' WHEN relation = 'CONTAINS' AND p_size = 13 THEN 'reject:attribute_fragment'
WHEN relation = 'CONTAINS' AND contains(lower(name), 'brass') THEN 'accept:levels' WHEN relation = 'CONTAINS' AND contains(lower(name), 'steel') THEN 'reject:levels' ELSE 'review:ambiguous' END AS x FROM t)
SELECT split_part(x, ':', 1) AS action, split_part(x, ':', 2) AS reason, count(*) AS n FROM r GROUP BY ALL""")
def relation_review(c: Catalog) -> DataFrame:
    """Orders with their parts, whose type words name a level; small parts have a type that no relation allows."""
    from graphmill.operators.build import reviewed

    part = c.table("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("object"), "p_size", "p_type")
    name = F.when(F.col("p_size") == 12, "page 12").when(F.col("p_size") == 13, ">= 13 mm").otherwise(F.col("p_type"))
    rows = c.triplets().join(part, "object").select("subject", F.lit("order").alias("subject_type"), "relation", name.alias("object"), F.when(F.col("p_size") > 5, "piece").otherwise("scrap").alias("object_type"))
    levels = [(("order",), "zone"), (("brass",), "space"), (("steel",), "equipment")]
    out = reviewed(rows, {"REQUIRES": (("order",), ("part",)), "CONTAINS": (("order",), ("box",))}, {"piece": "part"}, levels, {"CONTAINS": [("zone", "space")]}, {"CONTAINS": [("zone", "equipment")]})
    return out.groupBy("action", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {NODES} SELECT CASE label WHEN 'Customer' THEN 'Party' WHEN 'Supplier' THEN 'Party' ELSE label END AS kind, count(*) AS n FROM nodes WHERE label NOT IN ('Order') AND length(trim(name, ' ')) > 1 GROUP BY 1""")
def entity_types(c: Catalog) -> DataFrame:
    kind = X.mapped(F.col("label"), {"Customer": "Party", "Supplier": "Party"}, F.col("label"))
    return c.nodes().where((F.col("label") != "Order") & (F.length(F.trim("name")) > 1)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT item_id, CASE WHEN item_id % 5 = 0 THEN false WHEN contains(text, 'this') THEN true WHEN item_id % 2 = 0 THEN true ELSE false END AS enabled,
CASE WHEN item_id % 5 = 0 THEN 'disabled by flag' WHEN contains(text, 'this') THEN 'time sensitive' WHEN item_id % 2 = 0 THEN 'requested' ELSE 'not needed' END AS reason FROM benchmark""")
def search_policy(c: Catalog) -> DataFrame:
    """An ordered policy of flags and terms."""
    i = F.col("item_id")
    rules = [(i % 5 == 0, False, "disabled by flag"), (X.contains_any(F.col("text"), ["this"]), True, "time sensitive"), (i % 2 == 0, True, "requested")]
    enabled, reason = F.lit(False), F.lit("not needed")
    for cond, on, why in reversed(rules):
        enabled, reason = F.when(cond, F.lit(on)).otherwise(enabled), F.when(cond, F.lit(why)).otherwise(reason)
    return c.table("benchmark").select("item_id", enabled.alias("enabled"), reason.alias("reason"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'graph,vector' WHEN lang = 'de' THEN 'vector' ELSE 'vector,web' END AS workers FROM documents")
def worker_routing(c: Catalog) -> DataFrame:
    """Requested workers that are available, in order of priority."""
    requested = F.when(F.col("lang") == "en", F.array(F.lit("vector"), F.lit("graph"))).when(F.col("lang") == "de", F.array(F.lit("vector"), F.lit("other"))).otherwise(F.array(F.lit("web"), F.lit("vector"), F.lit("vector")))
    priority = F.array(*map(F.lit, ("graph", "vector", "web")))
    return c.table("documents").select("doc_id", F.array_join(F.array_intersect(priority, requested), ",").alias("workers"))


@query(f"""WITH {ITEMS} SELECT mode, count(DISTINCT entity_id) AS entities FROM items, (SELECT unnest(['R0', 'R1', 'R2']) AS mode) WHERE source = 'vector' OR (mode IN ('R1', 'R2') AND source = 'graph') OR mode = 'R2' GROUP BY mode""")
def retrieval_modes(c: Catalog) -> DataFrame:
    """Which retrievers a mode unions: vectors; with the graph; all."""
    modes = F.when(F.col("source") == "vector", F.array(*map(F.lit, ("R0", "R1", "R2")))).when(F.col("source") == "graph", F.array(F.lit("R1"), F.lit("R2"))).otherwise(F.array(F.lit("R2")))
    return c.items().select("entity_id", F.explode(modes).alias("mode")).groupBy("mode").agg(F.countDistinct("entity_id").alias("entities"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND value >= 0.7 GROUP BY user_id")
def perspective_and_quality(c: Catalog) -> DataFrame:
    return c.table("events").where(F.col("event_type").isin("click", "view") & (F.col("value") >= 0.7)).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""WITH {TASKS} SELECT event_id AS k FROM tasks WHERE json_extract_string(extra, '$.page') = '3' OR (module = 'm1' AND status = 'purchase')""")
def kv_exact_filter(c: Catalog) -> DataFrame:
    return c.tasks().where((F.get_json_object("extra", "$.page") == "3") | ((F.col("module") == "m1") & (F.col("status") == "purchase"))).select(F.col("event_id").alias("k"))


@query(f"""WITH {CHUNKS}, u AS (SELECT doc_id, sequence FROM chunks WHERE content_type = 'text' AND n_chars > 400 UNION SELECT doc_id, sequence FROM chunks WHERE content_type = 'table') SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id""")
def candidate_union(c: Catalog) -> DataFrame:
    """Text and table candidates, each once."""
    chunks = c.chunks()
    text = chunks.where("content_type = 'text' AND n_chars > 400").select("doc_id", "sequence")
    return text.unionByName(chunks.where("content_type = 'table'").select("doc_id", "sequence")).distinct().groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'a,' || lang AS terms FROM documents")
def term_union(c: Catalog) -> DataFrame:
    return c.table("documents").select("doc_id", F.array_join(ordered_union(F.array(F.lit("a"), F.lit("")), F.array(F.col("lang"), F.lit("a"))), ",").alias("terms"))
