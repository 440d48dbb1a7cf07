"""Queries of the aggregate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.catalog import Catalog
from graphmill.operators import aggregates as A
from graphmill.plans.oracle import CHUNKS, DOC_TERMS, EDGES, GRAPH, NODES, TASKS, TRIPLETS
from graphmill.plans.registry import query


@query(f"WITH {NODES} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def label_counts(c: Catalog) -> DataFrame:
    return A.counts(c.nodes(), "label")


@query(f"WITH {EDGES} SELECT rel, count(*) AS n FROM edges GROUP BY rel")
def relation_counts(c: Catalog) -> DataFrame:
    return A.counts(c.edges(), "rel")


@query(f"WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes WHERE label IN ('Region', 'Nation')) AS n_concepts")
def graph_totals(c: Catalog) -> DataFrame:
    nodes = c.nodes().agg(F.count("*").alias("n_nodes"), F.count_if(F.col("label").isin("Region", "Nation")).alias("n_concepts"))
    return nodes.join(F.broadcast(c.edges().agg(F.count("*").alias("n_edges")))).select("n_nodes", "n_edges", "n_concepts")


@query(f"WITH {EDGES}, g AS (SELECT rel, count(*) AS n FROM edges GROUP BY rel) SELECT rel, n, round(n / sum(n) OVER (), 4) AS share FROM g ORDER BY n DESC, rel LIMIT 10")
def rel_type_topk_share(c: Catalog) -> DataFrame:
    return A.top_shares(c.edges(), "rel")


@query(f"""WITH {GRAPH}, d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
SELECT label, min(coalesce(k, 0)) AS min_degree, round(avg(coalesce(k, 0)), 4) AS avg_degree, max(coalesce(k, 0)) AS max_degree FROM nodes LEFT JOIN d USING (id) GROUP BY label""")
def degree_stats(c: Catalog) -> DataFrame:
    return A.degree_stats(c.nodes(), c.edges())


@query(f"WITH {TRIPLETS} SELECT subject, relation, object, count(*) AS n FROM triplets GROUP BY ALL HAVING count(*) > 1")
def dup_triplets(c: Catalog) -> DataFrame:
    return A.duplicates(c.triplets())


@query(f"WITH {GRAPH} SELECT count(*) AS dangling FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)")
def dangling_edges(c: Catalog) -> DataFrame:
    return A.dangling(c.nodes(), c.edges())


@query(f"""WITH {CHUNKS}, {GRAPH}, x AS (SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM nodes) AS entities, (SELECT count(*) FROM edges) AS relations),
y AS (SELECT *, round(entities / chunks, 4) AS entities_per_chunk, round(relations / entities, 4) AS relations_per_entity FROM x)
SELECT *, CASE WHEN entities_per_chunk < 2 THEN 'low' WHEN entities_per_chunk > 10 THEN 'high' ELSE 'normal' END AS entity_band,
 CASE WHEN relations_per_entity < 0.2 THEN 'low' WHEN relations_per_entity > 8 THEN 'high' ELSE 'normal' END AS relation_band,
 CASE WHEN entities < 500 THEN 'low' WHEN entities > 5000 THEN 'high' ELSE 'normal' END AS node_band FROM y""")
def extraction_efficiency(c: Catalog) -> DataFrame:
    return A.extraction_efficiency(c.chunks(), c.nodes(), c.edges())


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, round(avg(n_chars), 4) AS avg_chars FROM chunks GROUP BY ROLLUP (doc_id)")
def chunk_lengths(c: Catalog) -> DataFrame:
    return A.chunk_lengths(c.chunks())


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 5")
def top_documents(c: Catalog) -> DataFrame:
    return A.counts(c.chunks(), "doc_id").orderBy(F.desc("n"), "doc_id").limit(5)


@query(f"""WITH {CHUNKS} SELECT doc_id, count(*) AS total, count(*) FILTER (content_type = 'text') AS n_text, count(*) FILTER (content_type = 'table') AS n_table,
 count(*) FILTER (content_type = 'title') AS n_title FROM chunks GROUP BY doc_id""")
def chunk_stats_pivot(c: Catalog) -> DataFrame:
    return A.counts_by_type(c.chunks())


@query("""SELECT o_custkey AS custkey, o_orderkey AS newest, n AS n_versions FROM (
 SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def version_latest(c: Catalog) -> DataFrame:
    rows = c.table("orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("v"))
    return A.versions(rows, "o_custkey", "v").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("newest"), "n_versions")


@query(r"""SELECT source, count(*) AS n_docs, count(*) FILTER (regexp_matches(text, 'https?://')) AS has_url, count(*) FILTER (n_chars > 80) AS long_text,
 count(*) FILTER (regexp_matches(text, '[0-9]{4}')) AS has_year, count(*) FILTER (lang = 'en') AS flagged FROM documents GROUP BY source""")
def coverage_flags(c: Catalog) -> DataFrame:
    d = c.table("documents")
    return d.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("text").rlike("https?://")).alias("has_url"), F.count_if(F.col("n_chars") > 80).alias("long_text"), F.count_if(F.col("text").rlike("[0-9]{4}")).alias("has_year"), F.count_if(F.col("lang") == "en").alias("flagged"))


@query("""WITH f AS (SELECT source, count(*) AS n_images, count(*) FILTER (n_chars > 20) AS done, count(*) FILTER (lang = 'en') AS good, count(*) FILTER (n_chars > 80) AS long FROM documents GROUP BY source)
SELECT source, CASE WHEN n_images = 0 THEN 'NO_IMAGES' WHEN done = 0 THEN 'NOT_STARTED' WHEN done < n_images THEN 'IN_PROGRESS'
 WHEN good >= 0.5 * n_images AND long >= 0.7 * n_images THEN 'HIGH' ELSE 'DONE' END AS status FROM f""")
def coverage_status(c: Catalog) -> DataFrame:
    d = c.table("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 20).alias("done"), F.count_if(F.col("lang") == "en").alias("good"), F.count_if(F.col("n_chars") > 80).alias("long"))
    return d.select("source", A.document_status(F.col("n"), F.col("done"), F.col("good"), F.col("long"), high=0.5).alias("status"))


@query("""SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS english, greatest(0, count(*) - count(*) FILTER (lang = 'en')) AS others, count(DISTINCT source) AS sources
 FROM documents WHERE source = 'src1'""")
def audit_counters(c: Catalog) -> DataFrame:
    d = c.table("documents").where("source = 'src1'")
    return d.agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("english"), F.greatest(F.lit(0).cast("long"), F.count("*") - F.count_if(F.col("lang") == "en")).alias("others"), F.countDistinct("source").alias("sources"))


@query(f"""WITH {CHUNKS}, s AS (SELECT doc_id, max(sequence) AS max_sequence, max(n_chars) AS max_chars, count(*) FILTER (content_type = 'table') AS n_tables FROM chunks GROUP BY doc_id),
w AS (SELECT doc_id, max(length(x))::INT AS max_word FROM (SELECT doc_id, unnest(string_split(content, ' ')) AS x FROM chunks) GROUP BY doc_id)
SELECT s.*, w.max_word FROM s JOIN w USING (doc_id)""")
def multi_facet(c: Catalog) -> DataFrame:
    """Facets over scalars and over unwound positions; the chunk facets and the word facet share the shuffle key."""
    chunks = c.chunks()
    word = F.array_max(F.transform(F.split("content", " "), lambda x: F.length(x)))
    return chunks.groupBy("doc_id").agg(F.max("sequence").alias("max_sequence"), F.max("n_chars").alias("max_chars"), F.count_if(F.col("content_type") == "table").alias("n_tables"), F.max(word).alias("max_word"))


@query("""SELECT coalesce(lang, 'all') AS lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY ROLLUP (lang)""")
def category_rollup(c: Catalog) -> DataFrame:
    return A.rolled_up(c.table("documents"), "lang", F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query(f"""WITH {TASKS} SELECT coalesce(module, 'all') AS module, count(*) AS n, count(*) FILTER (status = 'purchase') AS completed, count(*) FILTER (status = 'error') AS failed,
 round(sum(value) FILTER (status = 'purchase'), 2) AS done_value FROM tasks GROUP BY ROLLUP (module)""")
def ledger_stats(c: Catalog) -> DataFrame:
    done = F.col("status") == "purchase"
    return A.rolled_up(c.tasks(), "module", F.count("*").alias("n"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "error").alias("failed"), F.round(F.sum(F.when(done, F.col("value"))), 2).alias("done_value"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS store, count(*) AS n FROM {t}" for t in ("documents", "embeddings", "pages", "benchmark", "conversations", "events")))
def store_sizes(c: Catalog) -> DataFrame:
    out = None
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations", "events"):
        one = c.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("store"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {TASKS}, o AS (SELECT t.*, (l.doc_id IS NOT NULL) AS matched FROM tasks t LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = t.task_id)
SELECT module AS version, count(*) AS total, count(*) FILTER (status = 'purchase') AS success, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status NOT IN ('purchase', 'error')) AS no_status,
 min(created_at) AS first_at, max(created_at) AS last_at, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS orphan FROM o GROUP BY module""")
def cache_audit(c: Catalog) -> DataFrame:
    labels = c.table("labels").select(F.col("doc_id").alias("task_id")).distinct().withColumn("_has", F.lit(True))
    rows = c.tasks().join(labels, "task_id", "left")
    return rows.groupBy(F.col("module").alias("version")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "purchase").alias("success"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(~F.col("status").isin("purchase", "error")).alias("no_status"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.count_if(F.col("_has").isNotNull()).alias("matched"),
        F.count_if(F.col("_has").isNull()).alias("orphan"),
    )


@query(f"""WITH {TRIPLETS}, b AS (SELECT count(*) AS triplets, count(DISTINCT relation) AS relations FROM triplets), e AS (SELECT count(DISTINCT x) AS entities FROM (SELECT subject AS x FROM triplets UNION ALL SELECT object FROM triplets))
SELECT triplets, relations, entities, round(triplets / relations, 2) AS aof, round(relations / entities, 4) AS diversity FROM b, e""")
def quality_metrics(c: Catalog) -> DataFrame:
    return A.graph_quality(c.triplets())


@query(f"""WITH {TRIPLETS}, g AS (SELECT relation, count(*) AS n FROM triplets WHERE subject IN ('order:1', 'part:2') OR object IN ('order:1', 'part:2') GROUP BY relation)
SELECT relation, n, round(n / sum(n) OVER (), 4) AS score FROM g ORDER BY n DESC, relation LIMIT 5""")
def relation_candidates(c: Catalog) -> DataFrame:
    return A.relation_candidates(c.triplets(), "order:1", "part:2")


@query(f"""WITH {TRIPLETS} SELECT doc_id % 3 AS strategy, count(*) AS triplets, count(DISTINCT relation) AS relations, round(count(*) / count(DISTINCT relation), 2) AS aof FROM triplets GROUP BY 1""")
def aof_compare(c: Catalog) -> DataFrame:
    return c.triplets().groupBy((F.col("doc_id") % 3).alias("strategy")).agg(F.count("*").alias("triplets"), F.countDistinct("relation").alias("relations"), F.round(F.count("*") / F.countDistinct("relation"), 2).alias("aof"))


_SCORES = """s AS (SELECT doc_id, quality AS r0_hit, toxic AS r1_hit, 1 - toxic AS r2_hit, quality + toxic AS r0_accuracy, 2 * quality AS r1_accuracy, 2 * (1 - toxic) AS r2_accuracy,
 quality AS r0_completeness, quality + 1 - toxic AS r1_completeness, 2 * quality AS r2_completeness FROM labels)"""


def _scores(c: Catalog) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    columns = {"r0_hit": q, "r1_hit": t, "r2_hit": 1 - t, "r0_accuracy": q + t, "r1_accuracy": 2 * q, "r2_accuracy": 2 * (1 - t), "r0_completeness": q, "r1_completeness": q + 1 - t, "r2_completeness": 2 * q}
    return c.table("labels").select("doc_id", *(v.alias(k) for k, v in columns.items()))


@query(f"""WITH {_SCORES}, l AS (SELECT 'r0' AS mode, r0_hit AS hit, r0_accuracy AS accuracy, r0_completeness AS completeness FROM s UNION ALL SELECT 'r1', r1_hit, r1_accuracy, r1_completeness FROM s UNION ALL SELECT 'r2', r2_hit, r2_accuracy, r2_completeness FROM s)
SELECT mode, count(*) AS n, sum(hit)::BIGINT AS sum_hit, sum(accuracy)::BIGINT AS sum_accuracy, sum(completeness)::BIGINT AS sum_completeness,
 round(sum(hit) / count(*), 4) AS hit_rate, round(sum(accuracy) / (2 * count(*)), 4) AS accuracy_rate, round(sum(completeness) / (2 * count(*)), 4) AS completeness_rate FROM l GROUP BY mode""")
def benchmark_scores(c: Catalog) -> DataFrame:
    return A.benchmark_summary(_scores(c), ("r0", "r1", "r2"))


@query(f"""WITH {_SCORES} SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)
UNION ALL SELECT doc_id, 'unknown' FROM s WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'bad r0_accuracy' FROM s WHERE r0_accuracy NOT IN (0, 1)""")
def score_validation(c: Catalog) -> DataFrame:
    return A.score_violations(_scores(c), c.table("documents"), "doc_id", {"r0_accuracy": [0, 1]})


_BUILDS = """b AS (SELECT o_orderkey AS build_id, o_orderpriority AS strategy, o_orderdate AS built_at, o_totalprice AS seconds, (o_custkey % 50)::BIGINT AS chunks FROM orders)"""


def _builds(c: Catalog) -> DataFrame:
    return c.table("orders").select(F.col("o_orderkey").alias("build_id"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderdate").alias("built_at"), F.col("o_totalprice").alias("seconds"), (F.col("o_custkey") % 50).alias("chunks"))


@query(f"WITH {_BUILDS} SELECT build_id, strategy, built_at, seconds, chunks FROM b ORDER BY built_at DESC, build_id LIMIT 20")
def build_history(c: Catalog) -> DataFrame:
    return _builds(c).orderBy(F.desc("built_at"), "build_id").limit(20)


@query(f"WITH {_BUILDS} SELECT strategy, count(*) AS builds, round(avg(seconds / chunks), 6) AS seconds_per_chunk FROM b WHERE chunks > 0 AND seconds > 0 GROUP BY strategy")
def eta_per_strategy(c: Catalog) -> DataFrame:
    return A.mean_of_ratios(_builds(c), "strategy", "seconds", "chunks", "seconds_per_chunk")


@query(f"WITH {CHUNKS} SELECT source, count(*) AS n FROM chunks GROUP BY source ORDER BY lower(source)")
def source_list(c: Catalog) -> DataFrame:
    return A.counts(c.chunks(), "source").orderBy(F.lower("source"))


@query("SELECT coalesce(nullif(nullif(source, 'src1'), ''), 'unknown') AS doc, count(*) AS n FROM documents GROUP BY 1")
def doc_distribution(c: Catalog) -> DataFrame:
    return c.table("documents").groupBy(F.coalesce(F.nullif(F.nullif("source", F.lit("src1")), F.lit("")), F.lit("unknown")).alias("doc")).agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES}, p AS (SELECT a.src AS customer, b.dst AS part FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel = 'PLACED' AND b.rel = 'REQUIRES')
SELECT (SELECT count(*) FROM p) AS paths, (SELECT count(DISTINCT part) FROM p) AS parts_reached, (SELECT count(DISTINCT customer) FROM p) AS customers, round((SELECT count(DISTINCT part) FROM p) / (SELECT count(*) FROM part), 4) AS coverage""")
def two_hop_coverage(c: Catalog) -> DataFrame:
    edges = c.edges()
    placed = edges.where("rel = 'PLACED'").select(F.col("src").alias("customer"), F.col("dst").alias("mid"))
    wants = edges.where("rel = 'REQUIRES'").select(F.col("src").alias("mid"), F.col("dst").alias("part"))
    paths = placed.join(wants, "mid").agg(F.count("*").alias("paths"), F.countDistinct("part").alias("parts_reached"), F.countDistinct("customer").alias("customers"))
    return paths.join(F.broadcast(c.table("part").agg(F.count("*").alias("_n")))).select("paths", "parts_reached", "customers", F.round(F.col("parts_reached") / F.col("_n"), 4).alias("coverage"))


@query(f"""WITH {TRIPLETS}, s AS (SELECT object, count(DISTINCT chunk_id) AS size FROM triplets GROUP BY object) SELECT size, count(*) AS n FROM s GROUP BY size""")
def chunk_ids_histogram(c: Catalog) -> DataFrame:
    return c.triplets().groupBy("object").agg(F.countDistinct("chunk_id").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query(f"""WITH {TASKS}, r AS (SELECT module, value, row_number() OVER (PARTITION BY module ORDER BY created_at, event_id) AS i, count(*) OVER (PARTITION BY module) AS n FROM tasks)
SELECT module, count(*) AS n, round(sum(pow(0.8::DOUBLE, n - i) * (CASE WHEN i = 1 THEN 1 ELSE 0.2 END)::DOUBLE * value), 6) AS ewma FROM r GROUP BY module""")
def worker_ewma(c: Catalog) -> DataFrame:
    return A.ewma(c.tasks(), "module", ["created_at", "event_id"], "value")


@query(f"""WITH {TASKS} SELECT module, round(count(*) FILTER (status = 'click') / count(*), 4) AS success_rate, round(count(*) FILTER (status = 'error') / count(*), 4) AS error_rate, (count(*) FILTER (status = 'error') / count(*)) > 0.25 AS is_open FROM tasks GROUP BY module""")
def worker_rates(c: Catalog) -> DataFrame:
    errors = F.count_if(F.col("status") == "error") / F.count("*")
    return c.tasks().groupBy("module").agg(F.round(F.count_if(F.col("status") == "click") / F.count("*"), 4).alias("success_rate"), F.round(errors, 4).alias("error_rate"), (errors > 0.25).alias("is_open"))


@query(f"WITH {TASKS} SELECT module, round(count(*) FILTER (status IN ('click', 'view')) / count(*), 3) AS hit_rate FROM tasks GROUP BY module")
def cache_hit_rate(c: Catalog) -> DataFrame:
    return c.tasks().groupBy("module").agg(F.round(F.avg(F.col("status").isin("click", "view").cast("int")), 3).alias("hit_rate"))


@query("""WITH v AS (SELECT l_suppkey AS doc_id, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
q AS (SELECT doc_id, max(x) AS top, max(x) FILTER (i = floor((n - 1) * 0.95::DOUBLE)) AS quantile FROM v GROUP BY doc_id)
SELECT doc_id, greatest(CASE WHEN top > quantile * 1.05 THEN quantile ELSE top END, 1.0) AS scale FROM q""")
def robust_scale(c: Catalog) -> DataFrame:
    return A.robust_scale(c.table("lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_extendedprice").alias("x")), "doc_id", "x", outlier_ratio=1.05)


@query("""SELECT count(*) AS calls, round(avg(value), 4) AS avg_duration, round(avg(CASE WHEN event_type = 'purchase' THEN value * 2 END), 4) AS avg_cost FROM events WHERE event_type NOT IN ('view', 'error') AND value IS NOT NULL""")
def billed_means(c: Catalog) -> DataFrame:
    calls = c.table("events").withColumn("cost", F.when(F.col("event_type") == "purchase", F.col("value") * 2))
    return A.billed_means(calls, ~F.col("event_type").isin("view", "error"), "value", "cost")


@query(f"""WITH {TASKS} SELECT module, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status = 'click' AND (extra IS NULL OR extra = '' OR extra = '{{}}')) AS empty, count(*) FILTER (status <> 'error' AND NOT (status = 'click' AND (extra IS NULL OR extra = '' OR extra = '{{}}'))) AS kept FROM tasks GROUP BY module""")
def cache_purge(c: Catalog) -> DataFrame:
    empty = (F.col("status") == "click") & (F.col("extra").isNull() | F.col("extra").isin("", "{}"))
    return c.tasks().groupBy("module").agg(F.count_if(F.col("status") == "error").alias("failed"), F.count_if(empty).alias("empty"), F.count_if((F.col("status") != "error") & ~empty).alias("kept"))


@query(f"WITH {CHUNKS} SELECT source, count(*) AS chunks, round(count(*) * (2000 * 0.28::DOUBLE + 800 * 1.14::DOUBLE) / 1000000, 6) AS cost FROM chunks GROUP BY source")
def build_cost(c: Catalog) -> DataFrame:
    return A.counts(c.chunks(), "source").select("source", F.col("n").alias("chunks"), A.build_cost(F.col("n")).alias("cost"))


@query(f"""WITH {TASKS}, s AS (SELECT module AS run, status AS stage, CASE status WHEN 'purchase' THEN 0.4 WHEN 'click' THEN 0.3 ELSE 0.1 END::DOUBLE AS weight, least(1.0::DOUBLE, count(*) / 5000) AS fraction, sum(value) AS runtime, max(value) * 100 AS history FROM tasks GROUP BY module, status),
g AS (SELECT run, sum(weight * fraction) AS d, sum(weight) AS w, sum(runtime) AS runtime, max(history) AS history FROM s GROUP BY run),
o AS (SELECT *, CASE WHEN d >= w THEN 1.0 ELSE least(d / w, 0.99) END::DOUBLE AS overall FROM g)
SELECT run, round(overall, 4) AS overall, round(greatest(coalesce((runtime / nullif(overall, 0)) * overall + history * (1 - overall), runtime / nullif(overall, 0), history) - runtime, 0), 4) AS eta FROM o""")
def weighted_progress(c: Catalog) -> DataFrame:
    weight = F.when(F.col("stage") == "purchase", F.lit(0.4)).when(F.col("stage") == "click", F.lit(0.3)).otherwise(F.lit(0.1))
    stages = c.tasks().groupBy(F.col("module").alias("run"), F.col("status").alias("stage")).agg(F.least(F.lit(1.0), F.count("*") / 5000).alias("fraction"), F.sum("value").alias("runtime"), (F.max("value") * 100).alias("history"))
    return A.progress(stages.withColumn("weight", weight))


@query("SELECT count(*) AS n, count(*) FILTER (url LIKE 'http%') AS with_path, round(count(*) FILTER (url LIKE 'http%') / count(*), 4) AS share FROM pages")
def index_validation(c: Catalog) -> DataFrame:
    has = F.count_if(F.col("url").startswith("http"))
    return c.table("pages").agg(F.count("*").alias("n"), has.alias("with_path"), F.round(has / F.count("*"), 4).alias("share"))


@query(f"""WITH {DOC_TERMS}, m AS (SELECT DISTINCT term, doc_id FROM doc_terms WHERE term IN ('that', 'with', 'this', 'from')) SELECT term AS label, count(*) AS n FROM m GROUP BY term""")
def coverage_by_label(c: Catalog) -> DataFrame:
    hits = c.doc_terms().where(F.col("term").isin("that", "with", "this", "from")).select("term", "doc_id").distinct()
    return hits.groupBy(F.col("term").alias("label")).agg(F.count("*").alias("n"))
