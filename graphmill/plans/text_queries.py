"""Queries of the text functions, over documents, pages and the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.catalog import Catalog
from graphmill.functions import text as X
from graphmill.operators.windows import keywords_by_length
from graphmill.plans.oracle import CHUNKS, TRIPLETS
from graphmill.plans.registry import query


@query("SELECT doc_id, translate(text, 'abcxyz', 'ABCXYZ') AS folded, length(text) AS n FROM documents")
def half_width(c: Catalog) -> DataFrame:
    """Full-width letters made from the text's own come back as plain ones."""
    wide = F.translate("text", "abcxyz", "ＡＢＣＸＹＺ")
    return c.table("documents").select("doc_id", X.half_width(wide).alias("folded"), F.length("text").cast("long").alias("n"))


@query("""SELECT p_partkey AS partkey, regexp_replace(p_size || 'level ' || (p_partkey % 10) || ' ' || p_brand, '\\s+', '', 'g') AS plain FROM part""")
def normalize_numbers(c: Catalog) -> DataFrame:
    """Sizes up to ten are written as Roman numerals first; others are Arabic as they stand."""
    roman = F.create_map(*(F.lit(x) for kv in {v: k for k, v in X.ROMAN.items()}.items() for x in kv))
    size = F.col("p_size").cast("string")
    raw = F.concat(F.coalesce(F.try_element_at(roman, size), size), F.lit(" level "), (F.col("p_partkey") % 10).cast("string"), F.lit(" "), "p_brand")
    return c.table("part").select(F.col("p_partkey").alias("partkey"), X.normalize_numbers(raw).alias("plain"))


@query(r"""SELECT s_suppkey AS suppkey, CASE WHEN lower(regexp_replace(n_name, '\s+', '', 'g')) = 'france' THEN 'gallia' ELSE lower(regexp_replace(n_name, '\s+', '', 'g')) END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def canonicalize(c: Catalog) -> DataFrame:
    nation = c.table("nation").select("n_nationkey", X.canonical(F.col("n_name"), {"FRANCE": "gallia"}).alias("name"))
    return c.table("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("suppkey"), "name")


@query("""SELECT r_name AS region, array_to_string(list_sort(list(DISTINCT lower(regexp_replace(n_name, '\\s+', '', 'g')))), '/') AS scope FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def scope_keys(c: Catalog) -> DataFrame:
    rows = c.table("nation").join(F.broadcast(c.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region")).agg(X.scope_key(F.collect_list("n_name")).alias("scope"))


@query("SELECT s_suppkey AS suppkey, 'entity_' || substr(sha256(lower('Supplier:' || s_name || '|' || s_nationkey)), 1, 16) AS id FROM supplier")
def stable_id(c: Catalog) -> DataFrame:
    return c.table("supplier").select(F.col("s_suppkey").alias("suppkey"), X.stable_id(F.lit("Supplier"), F.col("s_name"), F.col("s_nationkey").cast("string")).alias("id"))


@query("""WITH i AS (SELECT source, doc_id::VARCHAR AS id, substr(sha256(doc_id::VARCHAR), 1, 3) AS cell FROM documents), c AS (SELECT source, cell, sha256(string_agg(id, ',' ORDER BY id)) AS h FROM i GROUP BY ALL)
SELECT source, substr(sha256(string_agg(h, ',' ORDER BY cell)), 1, 16) AS signature, 'schema-' || substr(sha256(source), 1, 16) || '_model-stub' AS version FROM c GROUP BY source""")
def build_signature(c: Catalog) -> DataFrame:
    """Hash of a source's sorted ids in two levels: of 4096 cells by the ids' hashes, then of the cells."""
    ids = c.table("documents").select("source", F.col("doc_id").cast("string").alias("id"))
    cell = F.substring(F.sha2("id", 256), 1, 3)
    cells = ids.groupBy("source", cell.alias("cell")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("id")), ","), 256).alias("h"))
    signature = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell", "h"))), lambda s: s["h"]), ",")
    return cells.groupBy("source").agg(X.text_hash(signature).alias("signature")).select("source", "signature", F.concat(F.lit("schema-"), X.text_hash(F.col("source")), F.lit("_model-stub")).alias("version"))


@query(f"WITH {CHUNKS} SELECT doc_id, sequence, md5(source || sequence || content) AS chunk_id FROM chunks")
def chunk_ids(c: Catalog) -> DataFrame:
    return c.chunks().select("doc_id", "sequence", X.chunk_key(F.col("source"), F.col("sequence"), F.col("content")).alias("chunk_id"))


@query("SELECT item_id, substr(md5(lower(trim(text, ' ')) || '|a=' || item_id || '&b=x'), 1, 16) AS cache_key, sha256(text) || '::stub::local' AS embedding_key FROM benchmark")
def cache_keys(c: Catalog) -> DataFrame:
    filters = F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("item_id").cast("string"))
    return c.table("benchmark").select("item_id", X.cache_key(F.col("text"), filters).alias("cache_key"), X.embedding_key(F.col("text"), "stub", "local").alias("embedding_key"))


@query("""WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' Contains ' WHEN 'view' THEN 'includes' WHEN 'error' THEN 'n/a' WHEN 'signup' THEN '' ELSE 'bought by' END AS raw FROM events)
SELECT raw, CASE trim(raw, ' ') WHEN 'Contains' THEN 'CONTAINS' WHEN 'includes' THEN 'CONTAINS' WHEN 'n/a' THEN 'SKIP' ELSE 'RELATED_TO' END AS rel, count(*) AS n FROM r GROUP BY raw""")
def relation_normalize(c: Catalog) -> DataFrame:
    t = F.col("event_type")
    raw = F.when(t == "click", " Contains ").when(t == "view", "includes").when(t == "error", "n/a").when(t == "signup", "").otherwise("bought by")
    names = c.table("events").groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))  # distinct names first
    return names.select("raw", X.normalized_relation(F.col("raw"), ("CONTAINS", "REQUIRES"), {"includes": "CONTAINS"}, ("n/a",)).alias("rel"), "n")


@query(f"WITH {TRIPLETS} SELECT relation, CASE relation WHEN 'CONTAINS' THEN 'BELONGS_TO' WHEN 'REQUIRES' THEN 'REQUIRED_BY' END AS inverse, count(*) AS n FROM triplets GROUP BY relation")
def inverse_relations(c: Catalog) -> DataFrame:
    return c.triplets().groupBy("relation").agg(F.count("*").alias("n")).select("relation", X.inverse_relation(F.col("relation")).alias("inverse"), "n")


@query(f"""WITH {CHUNKS} SELECT doc_id, sequence, CASE WHEN regexp_matches(content, '[0-9]+\\.?[0-9]*\\s*(mm|cm|m|kg|%)') OR regexp_matches(content, '[<>]=?\\s*[0-9]') OR regexp_matches(content, '[0-9]+\\s*-\\s*[0-9]+') OR regexp_matches(content, '[0-9]{{2,}}') THEN 'quantitative' ELSE 'qualitative' END AS kind FROM chunks""")
def attribute_type(c: Catalog) -> DataFrame:
    return c.chunks().select("doc_id", "sequence", X.is_quantitative(F.col("content")).alias("kind"))


@query("SELECT doc_id, CASE WHEN regexp_replace(source || '-' || lang, '[^A-Za-z0-9_]', '', 'g') = '' THEN 'RELATED_TO' ELSE regexp_replace(source || '-' || lang, '[^A-Za-z0-9_]', '', 'g') END AS name FROM documents")
def sanitize(c: Catalog) -> DataFrame:
    return c.table("documents").select("doc_id", X.sanitized(F.concat_ws("-", "source", "lang")).alias("name"))


@query("""SELECT p_partkey AS partkey, CASE WHEN contains(p_name, 'a') AND p_size > 25 THEN 'ADJACENT' WHEN p_type LIKE '%BRASS' AND p_brand LIKE '%1' THEN 'REQUIRES' ELSE 'CO_OCCUR' END AS rel,
CASE WHEN contains(p_name, 'a') AND p_size > 25 THEN 0.8 WHEN p_type LIKE '%BRASS' AND p_brand LIKE '%1' THEN 0.7 ELSE 0.5 END::DOUBLE AS conf FROM part""")
def relation_refine(c: Catalog) -> DataFrame:
    context = F.when(F.col("p_name").contains("a") & (F.col("p_size") > 25), "next to").otherwise("")
    a = F.when(F.col("p_type").endswith("BRASS"), "Metal").otherwise("Other")
    b = F.when(F.col("p_brand").endswith("1"), "First").otherwise("Other")
    r = X.refined_relation(context, a, b, [("next to", "ADJACENT", 0.8)], [("Metal", "First", "REQUIRES", 0.7)])
    return c.table("part").select(F.col("p_partkey").alias("partkey"), r.alias("r")).select("partkey", "r.rel", "r.conf")


@query("""SELECT doc_id, CASE WHEN contains(lower(coalesce(source, '')), '1') OR contains(lower(coalesce(source, '')), 'gb') THEN 'rules' WHEN contains(lower(coalesce(source, '')), '2') OR contains(lower(coalesce(source, '')), 'case') THEN 'cases' WHEN coalesce(source, '') = '' AND contains(coalesce(lang, ''), '1') THEN 'rules'
WHEN lang = 'de' THEN 'papers' ELSE 'survey' END AS perspective FROM documents""")
def perspective(c: Catalog) -> DataFrame:
    """By words of a document's category, its source; then by its source type, its language."""
    groups = [(("1", "gb"), "rules"), (("2", "case"), "cases")]
    return c.table("documents").select("doc_id", X.perspective(F.col("source"), F.col("lang"), groups, {"de": "papers"}, "survey").alias("perspective"))


@query("""SELECT p_partkey AS partkey, CASE WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'tin') THEN 'space' WHEN contains(lower(p_type), 'steel') THEN 'method' ELSE 'other' END AS kind FROM part""")
def soft_types(c: Catalog) -> DataFrame:
    groups = [(("brass", "tin"), "space"), (("steel",), "method")]
    return c.table("part").select(F.col("p_partkey").alias("partkey"), X.soft_type(F.col("p_type"), groups, "document", "other").alias("kind"))


@query(r"""WITH s AS (SELECT doc_id, text, list_filter(string_split(replace(replace(replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || chr(1), chr(1)), '', ''), '', ''), chr(1)), lambda x: contains(x, 'the'))[1] AS hit FROM documents)
SELECT doc_id, CASE WHEN length(coalesce(hit, text)) > 160 THEN substr(coalesce(hit, text), 1, 160) || '...' ELSE coalesce(hit, text) END AS snippet FROM s""")
def entity_sentence(c: Catalog) -> DataFrame:
    return c.table("documents").select("doc_id", X.sentence_about(F.col("text"), F.lit("the")).alias("snippet"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(figure|fig\.|table)\s*[0-9]+') AS has_media FROM documents""")
def media_refs(c: Catalog) -> DataFrame:
    return c.table("documents").select("doc_id", F.col("text").rlike(r"(?i)\b(figure|fig\.|table)\s*[0-9]+").alias("has_media"))


@query("""SELECT page_id, 2 AS n_images, 'a1' AS first_alt, 'img/' || page_id || '.png' AS first_url, 'x ![a1](local/' || page_id || '.png) y ![b](' || url || ')' AS rewritten FROM pages""")
def image_links(c: Catalog) -> DataFrame:
    """Links in a Markdown text made from the page's own address."""
    md = F.concat(F.lit("x ![a1](img/"), F.col("page_id").cast("string"), F.lit(".png) y ![b]("), "url", F.lit(")"))
    links = X.image_links(md)
    moved = F.regexp_replace(md, r"(!\[[^\]]*\]\()img/", "$1local/")
    return c.table("pages").select("page_id", F.size(links).alias("n_images"), links[0]["alt"].alias("first_alt"), links[0]["url"].alias("first_url"), moved.alias("rewritten"))


@query(r"""WITH t AS (SELECT event_id, 'seen in ' || (1985 + event_id % 60) || ' at page ' || (event_id % 30) AS s FROM events)
SELECT event_id, CASE WHEN 1985 + event_id % 60 BETWEEN 1990 AND 2030 THEN (1985 + event_id % 60)::INT END AS year FROM t""")
def year_extract(c: Catalog) -> DataFrame:
    s = F.concat(F.lit("seen in "), (1985 + F.col("event_id") % 60).cast("string"), F.lit(" at page "), (F.col("event_id") % 30).cast("string"))
    return c.table("events").select("event_id", X.year(s).alias("year"))


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity * 12 AS x0, l_quantity * 20 AS y0, l_quantity * 6 AS x1, l_quantity * 10 AS y1 FROM lineitem),
p AS (SELECT k, n, greatest(0, least(1, round(x0 / 595, 4))) AS a, greatest(0, least(1, round(y0 / 842, 4))) AS b, greatest(0, least(1, round(x1 / 595, 4))) AS c, greatest(0, least(1, round(y1 / 842, 4))) AS d FROM b)
SELECT k, n, least(a, c)::DOUBLE AS x0, least(b, d)::DOUBLE AS y0, greatest(a, c)::DOUBLE AS x1, greatest(b, d)::DOUBLE AS y1 FROM p""")
def bbox_normalize(c: Catalog) -> DataFrame:
    q = F.col("l_quantity")
    box = X.normalized_bbox(F.col("l_linenumber"), F.array(q * 12, q * 20, q * 6, q * 10))
    rows = c.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), box.alias("box"))
    return rows.select("k", "n", *(F.get("box", F.lit(i)).alias(name) for i, name in enumerate(("x0", "y0", "x1", "y1"), 1)))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS plain FROM pages")
def html_text(c: Catalog) -> DataFrame:
    return c.table("pages").select("page_id", X.html_text(F.col("html")).alias("plain"))


@query(r"SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}'))) AS words FROM benchmark")
def tokenization(c: Catalog) -> DataFrame:
    return c.table("benchmark").select("item_id", F.array_sort(X.tokens(F.col("text"))).alias("words"))


@query("""SELECT item_id, CASE WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'and') THEN 'and' END AS focus, CASE WHEN contains(text, 'eron') THEN 'mixed' WHEN contains(text, 'ther') THEN 'relation' WHEN contains(text, 'hand') THEN 'community' ELSE 'entity' END AS kind FROM benchmark""")
def query_kind(c: Catalog) -> DataFrame:
    t = F.col("text")
    return c.table("benchmark").select("item_id", X.first_contained(t, ["the", "and"]).alias("focus"), X.query_kind(t, ["ther"], ["hand"], ["eron"]).alias("kind"))


def _keywords(least: int) -> str:
    """Common table expressions that end in g: item_id, k (the eight longest different words) and grams."""
    return f"""w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{{least},}}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{{{least},}}'), 1) AS i FROM benchmark),
f AS (SELECT item_id, w, min(i) AS i FROM w GROUP BY ALL), o AS (SELECT item_id, list(w ORDER BY length(w) DESC, i)[1:8] AS k FROM f GROUP BY item_id), k AS (SELECT b.item_id, coalesce(o.k, []::VARCHAR[]) AS k FROM benchmark b LEFT JOIN o USING (item_id)),
g AS (SELECT item_id, k, list_concat(list_transform(range(1, least(5, len(k) - 1) + 1), lambda i: k[i] || k[i + 1]), list_transform(range(1, least(5, len(k) - 2) + 1), lambda i: k[i] || k[i + 1] || k[i + 2])) AS grams FROM k)"""


@query(f"""WITH {_keywords(3)} SELECT item_id, array_to_string(grams, ' ') AS grams FROM g""")
def ngrams(c: Catalog) -> DataFrame:
    """All n-grams of the keywords of the whole text; empty where there are fewer than two."""
    rows = c.table("benchmark").select("item_id", keywords_by_length(X.tokens(F.col("text"), "[a-z]{3,}")).alias("w"))
    return rows.select("item_id", F.array_join(X.ngrams(F.col("w")), " ").alias("grams"))


@query("""SELECT n_nationkey AS k, CASE WHEN n_name = 'FRANCE' THEN 'gallia,west' WHEN contains(n_name, 'UNITED') THEN 'allied' ELSE '' END AS found FROM nation""")
def synonym_lookup(c: Catalog) -> DataFrame:
    s = X.synonyms(F.col("n_name"), {"FRANCE": ["west", "gallia"], "UNITED": ["allied"]})
    return c.table("nation").select(F.col("n_nationkey").alias("k"), F.array_join(s, ",").alias("found"))


@query(f"""WITH {_keywords(5)}, l AS (SELECT item_id, list_concat(k, grams, ['extra']) AS l FROM g) SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:20], ' ') AS terms FROM l""")
def query_expand(c: Catalog) -> DataFrame:
    rows = c.table("benchmark").select("item_id", keywords_by_length(X.tokens(F.col("text"), "[a-z]{5,}")).alias("w"))
    return rows.select("item_id", F.array_join(X.expansion(F.col("w"), X.ngrams(F.col("w")), F.array(F.lit("extra"))), " ").alias("terms"))


@query("""WITH w AS (SELECT doc_id, source, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents),
g AS (SELECT doc_id, source, list_filter(w, lambda x: length(x) = 6) AS six, list_filter(w, lambda x: length(x) > 8) AS long, list_filter(w, lambda x: length(x) = 4) AS short FROM w)
SELECT doc_id, array_to_string(list_concat([source], list_transform(six[1:5], lambda x: upper(x)), six[6:8], long[1:3], short[1:2]), ',') AS concepts FROM g""")
def concept_expand(c: Catalog) -> DataFrame:
    """A document's words of six letters stand in for synonyms (in capitals) and related concepts, long ones for narrower."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))))
    of = lambda test: F.filter("w", lambda x: test(F.length(x)))
    rows = c.table("documents").select("doc_id", "source", words.alias("w"))
    six = of(lambda n: n == 6)
    terms = X.concept_expansion(F.col("source"), F.transform(six, lambda x: F.upper(x)), six, of(lambda n: n > 8), of(lambda n: n == 4))
    return rows.select("doc_id", F.array_join(terms, ",").alias("concepts"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages")
def url_host(c: Catalog) -> DataFrame:
    return c.table("pages").select("page_id", X.host(F.col("url")).alias("host"))


@query("""SELECT page_id, round(least(greatest(0.55 + CASE WHEN page_id % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN contains(html, 'the') THEN 0.1 ELSE 0 END + CASE WHEN page_id % 3 = 0 THEN 0.05 ELSE 0 END + CASE WHEN contains(html, 'and') THEN 0.05 ELSE 0 END, (page_id % 100) / 100), 0.95)::DOUBLE, 4) AS score FROM pages""")
def web_relevance(c: Catalog) -> DataFrame:
    i, h = F.col("page_id"), F.col("html")
    return c.table("pages").select("page_id", X.web_relevance(i % 2 == 0, h.contains("the"), i % 3 == 0, h.contains("and"), (i % 100) / 100).alias("score"))


@query("""WITH p AS (SELECT page_id, trim(coalesce(url, ''), ' ') AS url, trim(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), ' ') AS title, trim(coalesce(regexp_extract(html, '<p>([^<]*)', 1), ''), ' ') AS snippet FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url <> '' THEN url ELSE title || '|' || substr(snippet, 1, 80) END ORDER BY page_id) AS r FROM p)
SELECT page_id, url, round(least(0.55 + CASE WHEN contains(url, '/en/') THEN 0.25 ELSE 0 END + CASE WHEN contains(lower(title), 'the') THEN 0.1 ELSE 0 END + CASE WHEN contains(snippet, 'and') THEN 0.05 ELSE 0 END, 0.95)::DOUBLE, 4) AS score FROM k WHERE r = 1 ORDER BY score DESC, page_id LIMIT 30""")
def web_dedup(c: Catalog) -> DataFrame:
    """The 30 best pages, one of each address, or of each title and first 80 characters where there is none."""
    from graphmill.operators.windows import first_by_key

    part = lambda pattern: F.trim(F.coalesce(F.regexp_extract("html", pattern, 1), F.lit("")))
    rows = c.table("pages").select("page_id", F.trim(F.coalesce("url", F.lit(""))).alias("url"), part("<title>([^<]*)</title>").alias("title"), part("<p>([^<]*)").alias("snippet"))
    found = first_by_key(rows.withColumn("_k", X.web_key(F.col("url"), F.col("title"), F.col("snippet"))), ["_k"], ["page_id"])
    score = X.web_relevance(F.col("url").contains("/en/"), F.lower("title").contains("the"), F.lit(False), F.col("snippet").contains("and"), F.lit(0.0))
    return found.select("page_id", "url", score.alias("score")).orderBy(F.desc("score"), "page_id").limit(30)


@query("""SELECT p_partkey AS partkey, (CASE WHEN contains(p_type, p_brand) THEN 1000 + least(length(p_brand), 50) ELSE 0 END + CASE WHEN contains(p_type, 'BRASS') THEN 80 ELSE 0 END + CASE WHEN contains(p_type, 'LARGE') THEN 80 ELSE 0 END + CASE WHEN contains(p_type, p_name) AND length(p_name) < 80 THEN 20 ELSE 0 END)::INT AS score FROM part""")
def entity_relevance(c: Catalog) -> DataFrame:
    s = X.entity_relevance(F.col("p_type"), F.col("p_brand"), F.array(F.lit("BRASS"), F.lit("LARGE")), F.col("p_name"))
    return c.table("part").select(F.col("p_partkey").alias("partkey"), s.cast("int").alias("score"))


@query("""WITH r AS (SELECT p_brand, p_partkey, length(p_type) AS size, row_number() OVER w AS i, sum(length(p_type)) OVER w AS total FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)) SELECT p_brand AS brand, p_partkey AS partkey FROM r WHERE i <= 60 AND total <= 400""")
def bounded_context(c: Catalog) -> DataFrame:
    from graphmill.operators.windows import bounded_selection

    rows = c.table("part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"), "p_retailprice", F.length("p_type").alias("size"))
    return bounded_selection(rows, ["brand"], [F.desc("p_retailprice"), "partkey"], "size", 60, 400).select("brand", "partkey")


@query("SELECT p_partkey AS partkey, least(1.0, CASE WHEN length(p_name) > 5 THEN 0.4 ELSE 0 END + CASE WHEN p_size > 10 THEN 0.3 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 0.4 ELSE 0 END)::DOUBLE AS quality FROM part")
def entity_quality(c: Catalog) -> DataFrame:
    part = lambda x, w: F.when(x, w).otherwise(0.0)
    return c.table("part").select(F.col("p_partkey").alias("partkey"), F.least(F.lit(1.0), part(F.length("p_name") > 5, 0.4) + part(F.col("p_size") > 10, 0.3) + part(F.col("p_retailprice") > 1000, 0.4)).alias("quality"))


@query("""SELECT doc_id, round(CASE WHEN lang = 'en' THEN CASE WHEN contains(text, 'image') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.3 ELSE 0 END + CASE WHEN contains(text, 'new') THEN 0.2 ELSE 0 END + CASE WHEN length(text) >= 500 THEN 0.2 WHEN length(text) >= 200 THEN 0.1 ELSE 0 END
WHEN lang = 'de' THEN CASE WHEN length(text) >= 50 THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.2 ELSE 0 END + CASE WHEN source = 'src0' THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9][m²㎡Pa%级]') THEN 0.2 ELSE 0 END
ELSE CASE WHEN regexp_matches(text, '[0-9]') THEN 0.2 ELSE 0 END + CASE WHEN length(text) >= 30 THEN 0.3 ELSE 0 END + CASE WHEN contains(text, 'law') THEN 0.2 ELSE 0 END + CASE WHEN source = 'src0' THEN 0.2 ELSE 0 END + CASE WHEN contains(text, 'image') THEN 0.1 ELSE 0 END END::DOUBLE, 4) AS quality FROM documents""")
def typed_quality(c: Catalog) -> DataFrame:
    """English documents scored as cases, German ones as design methods, the others as plain entities."""
    t = F.col("text")
    figures, media, backed = t.rlike("[0-9]"), t.contains("image"), F.col("source") == "src0"
    case = X.case_quality(media, figures, t.contains("new"), F.length(t))
    method = X.method_quality(t, F.regexp_extract_all(t, F.lit("[0-9]"), F.lit(0)), backed)
    plain = X.plain_quality(figures, t, t.contains("law"), backed, media)
    return c.table("documents").select("doc_id", F.when(F.col("lang") == "en", case).when(F.col("lang") == "de", method).otherwise(plain).alias("quality"))


@query("""SELECT l_suppkey AS doc, round(least(1, 0.3 * least(count(*) / 5, 1) + 0.4 * max(1 - l_discount) + 0.3 * avg(1 - l_discount) + 0.3 * least(count(DISTINCT l_partkey) / 3, 1))::DOUBLE, 4) AS retrieval, round((0.3 * least(count(DISTINCT l_partkey) / 10, 1) + 0.3 * least(count(*) / 15, 1) + 0.2 * least(count(DISTINCT l_returnflag) / 10, 1) + 0.2 * 0.5)::DOUBLE, 2) AS fusion FROM lineitem GROUP BY l_suppkey""")
def quality_scores(c: Catalog) -> DataFrame:
    g = c.table("lineitem").groupBy(F.col("l_suppkey").alias("doc")).agg(F.count("*").alias("n"), F.max(1 - F.col("l_discount")).alias("top"), F.avg(1 - F.col("l_discount")).alias("mean"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_returnflag").alias("rels"))
    return g.select("doc", F.round(X.retrieval_quality(F.col("n"), F.col("top"), F.col("mean"), F.col("parts")), 4).alias("retrieval"), X.fusion_score(F.col("parts"), F.col("n"), F.col("rels"), F.lit(0.5)).alias("fusion"))


@query("""SELECT l_orderkey AS k, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN 'P' || min(l_linenumber) ELSE 'P' || min(l_linenumber) || '-P' || max(l_linenumber) END AS span FROM lineitem GROUP BY l_orderkey""")
def page_span(c: Catalog) -> DataFrame:
    return c.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(X.page_span(F.collect_set(F.concat(F.lit("p. "), F.col("l_linenumber").cast("string")))).alias("span"))


_CITED = """o AS (SELECT l_orderkey AS k, list(l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS s, min(l_suppkey % 50) AS lo, max(l_suppkey % 50) AS hi FROM lineitem GROUP BY l_orderkey),
d AS (SELECT k, s, lo, hi, list_filter(s, lambda x, i: list_position(s, x) = i) AS firsts FROM o),
r AS (SELECT *, CASE WHEN hi - lo > 30 THEN [lo, hi] ELSE range(lo, hi + 1) END AS spread, array_to_string(list_transform(s, lambda x: '[' || list_position(firsts, x) || ']'), '') AS numbered FROM d)"""


def _cited(c: Catalog) -> DataFrame:
    """A text for each order that cites its suppliers in one group, with the separators in turn, and then a range."""
    rows = c.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("s"), F.min(F.col("l_suppkey") % 50).alias("lo"), F.max(F.col("l_suppkey") % 50).alias("hi"))
    marks = F.array(*map(F.lit, (", ", ",", "，", "、", " ; ")))
    group = F.array_join(F.transform("s", lambda x, i: F.concat(F.when(i > 0, F.element_at(marks, F.pmod(F.col("k") + i, F.lit(5)).cast("int") + 1)).otherwise(""), x["l_suppkey"].cast("string"))), "")
    return rows.select("k", F.concat(F.lit("see ["), group, F.lit("] and")).alias("text"), F.concat(F.lit("also ["), F.col("hi").cast("string"), F.lit(" – "), F.col("lo").cast("string"), F.lit("].")).alias("ranged"))


@query(f"""WITH {_CITED} SELECT k, 'see ' || numbered || ' and' AS renumbered, len(firsts)::INT AS n_cited, array_to_string(list_transform(range(len(firsts) + 1, 6), lambda i: i::VARCHAR), ',') AS missing,
'also ' || array_to_string(list_transform(spread, lambda n: '[' || n || ']'), '') || '.' AS spread FROM r""")
def citation_rewrite(c: Catalog) -> DataFrame:
    """Groups split and renumbered by first appearance; ranges spread; what of five sources isn't cited."""
    fixed = X.renumbered_citations(X.split_citation_groups(F.col("text")))
    rows = _cited(c).select("k", fixed.alias("renumbered"), X.expanded_citation_ranges(F.col("ranged")).alias("spread"))
    return rows.select("k", "renumbered", F.size(X.citations(F.col("renumbered"))).alias("n_cited"), F.array_join(X.missing_citations(F.col("renumbered"), F.lit(5)), ",").alias("missing"), "spread")


@query(f"""WITH {_CITED}, n AS (SELECT k, s, list_sort(list_distinct(s)) AS u FROM r),
j AS (SELECT k, s, u, array_to_string(list_transform(u, lambda x: '[' || x || ']'), '') AS own FROM n)
SELECT k, CASE WHEN len(s) = 1 THEN 'see ' || own || ' and' ELSE 'see ' || own || 'and' END AS sorted,
CASE WHEN len(s) = 1 THEN 'see ' || own || ' and' WHEN len(u) > 2 AND u[-1] - u[1] = len(u) - 1 THEN 'see [' || u[1] || '-' || u[-1] || ']and' ELSE 'see ' || own || 'and' END AS collapsed FROM j""")
def citation_runs(c: Catalog) -> DataFrame:
    """Runs of citations in order, and closed runs as ranges."""
    text = X.split_citation_groups(F.col("text"))
    return _cited(c).select("k", X.sorted_citation_runs(text).alias("sorted"), X.collapsed_citation_runs(text).alias("collapsed"))


@query("""WITH a AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 4 = 1 THEN '' ELSE ' [' || turn || ']' END AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 4 = 1 THEN 'no citation' END, CASE WHEN turn % 4 <> 1 AND turn NOT BETWEEN 1 AND 3 THEN 'unknown citation' END, CASE WHEN length(t) > 200 THEN 'too long' END, CASE WHEN trim(t, ' ') = '' THEN 'empty' END) AS problems FROM a""")
def answer_validation(c: Catalog) -> DataFrame:
    """All answers, every second of which cites its own turn, against three sources."""
    cited = F.when(F.col("turn") % 4 == 1, "").otherwise(F.concat(F.lit(" ["), F.col("turn").cast("string"), F.lit("]")))
    rows = c.table("conversations").where("role = 'assistant'").withColumn("answer", F.concat(F.coalesce("text", F.lit("")), cited))
    return rows.select("conv_id", "turn", F.array_join(X.answer_violations(F.col("answer"), F.lit(3), 200), ",").alias("problems"))


@query("SELECT doc_id, 'a [IMG:1] b  c [IMG:2]' AS aligned FROM documents")
def image_alignment(c: Catalog) -> DataFrame:
    raw = F.concat(F.lit("a [IMG:2] b [IMG:9] c [IMG:"), F.when(F.col("doc_id") % 2 == 0, "1").otherwise("3"), F.lit("]"))
    return c.table("documents").select("doc_id", X.aligned_images(raw, F.lit(3)).alias("aligned"))


_LINES = """l AS (SELECT l_orderkey AS k, l_suppkey AS s, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS i FROM lineitem)"""


def _lines(c: Catalog) -> DataFrame:
    """k and its lines (n, s) in order, an array."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return c.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(line)).alias("lines"))


@query(f"""WITH {_LINES} SELECT k, 'Start' || chr(10) || chr(10) || '### Evidence' || chr(10) || string_agg('line ' || n || chr(10) || chr(10) || '(Figure ' || i || ': by ' || s || ')' || chr(10) || '[IMG:' || i || ']', chr(10) || chr(10) ORDER BY i)
|| chr(10) || chr(10) || '(Figure ' || (count(*) + 1) || ': more)' || chr(10) || '[IMG:' || (count(*) + 1) || ']' || chr(10) || chr(10) || '### Sources' || chr(10) || '- [1] x' AS injected,
'see [IMG:1]' || coalesce(chr(10) || chr(10) || string_agg('(Figure ' || i || ': by ' || s || ')' || chr(10) || '[IMG:' || i || ']', chr(10) || chr(10) ORDER BY i) FILTER (WHERE i > 1), '') AS appended FROM l GROUP BY k""")
def image_placement(c: Catalog) -> DataFrame:
    """An order's suppliers as images: after the paragraphs of a section, and at the end where a text has them not."""
    captions = F.transform("lines", lambda x: F.concat(F.lit("by "), x["s"].cast("string")))
    paragraphs = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("line "), x["n"].cast("string"))), "\n\n")
    text = F.concat(F.lit("Start\n\n### Evidence\n"), paragraphs, F.lit("\n\n### Sources\n- [1] x"))
    rows = _lines(c).select("k", text.alias("text"), captions.alias("captions"))
    return rows.select("k", X.injected_images(F.col("text"), F.array_append("captions", F.lit("more")), "Evidence", "Sources").alias("injected"), X.appended_images(F.lit("see [IMG:1]"), F.col("captions")).alias("appended"))


@query(f"""WITH {_LINES}, f AS (SELECT k, s, min(i) AS i FROM l GROUP BY k, s), g AS (SELECT k, string_agg('[' || s || ']', '' ORDER BY i) AS note FROM f GROUP BY k),
t AS (SELECT k, string_agg('| ' || n || ' | x |', chr(10) ORDER BY i) AS body FROM l GROUP BY k)
SELECT k, 'as [7] says' || chr(10) || '| line | part [8] |' || chr(10) || '|---|:-:|' || chr(10) || body || chr(10) || chr(10) || 'Sources of the table: ' || note || chr(10) || chr(10) || 'end [9]' AS moved FROM t JOIN g USING (k)""")
def table_citations(c: Catalog) -> DataFrame:
    """Suppliers cited in the rows of a table of an order's lines move below it."""
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("| "), x["n"].cast("string"), F.lit(" ["), x["s"].cast("string"), F.lit("] | x |"))), "\n")
    text = F.concat(F.lit("as [7] says\n| line | part [8] |\n|---|:-:|\n"), body, F.lit("\nend [9]"))
    return _lines(c).select("k", X.moved_table_citations(text).alias("moved"))


@query("SELECT page_id, 'docs/' || page_id || '.html' AS path FROM pages")
def relative_paths(c: Catalog) -> DataFrame:
    raw = F.concat(F.lit("C:\\data\\docs\\"), F.col("page_id").cast("string"), F.lit(".html"))
    return c.table("pages").select("page_id", X.relative_path(raw, "C:/data").alias("path"))


@query(r"""SELECT page_id, 'unknown source' AS source, CASE WHEN page_id % 2 = 0 THEN page_id || '|Chapter 2 Wards|2.1' ELSE page_id || '|2.1' END AS location, '' AS snippet, 'docs/' || page_id || '.pdf' AS file_path, CASE WHEN page_id % 3 = 0 THEN '/files/' || page_id ELSE url END AS pdf_url FROM pages""")
def complete_citations(c: Catalog) -> DataFrame:
    """Citations of pages with defaults for what is missing, relative paths and the older name of a field."""
    i, even = F.col("page_id").cast("string"), F.col("page_id") % 2 == 0
    fields = {
        "source": F.lit(""),
        "location": X.page_location(F.col("page_id"), F.lit("Chapter 2"), F.when(even, "Wards"), F.lit("2.1")),
        "file_path": F.concat(F.lit("C:\\data\\docs\\"), i, F.lit(".pdf")),
        "pdf_url": F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/api/v1/files/"), i)),
        "pdfUrl": F.col("url"),
    }
    return c.table("pages").select("page_id", X.complete_citation(fields, "C:/data").alias("x")).select("page_id", "x.source", "x.location", "x.snippet", "x.file_path", "x.pdf_url")


@query(r"SELECT event_id, nullif(regexp_extract(coalesce(props, ''), '(?s)(\{.*\})', 1), '') AS object FROM events")
def json_extract(c: Catalog) -> DataFrame:
    """The object in each event's messy answer; null where there is none."""
    messy = F.concat(F.lit("answer: ```json "), F.coalesce("props", F.lit("")), F.lit(" ``` done"))
    return c.table("events").select("event_id", X.json_in(messy).alias("object"))


@query("SELECT DISTINCT l_linenumber AS attempt, least(60, pow(2, least(8, l_linenumber - 1)))::DOUBLE AS delay FROM lineitem")
def retry_delays(c: Catalog) -> DataFrame:
    return c.table("lineitem").select(F.col("l_linenumber").alias("attempt")).distinct().select("attempt", X.retry_delay(F.col("attempt")).alias("delay"))


@query(f"""WITH {CHUNKS}, s AS (SELECT source, doc_id, sequence, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id, sequence ROWS UNBOUNDED PRECEDING) - n_chars AS before FROM chunks) SELECT source, (before // 20000)::BIGINT AS batch, count(*) AS n FROM s GROUP BY ALL""")
def embedding_batches(c: Catalog) -> DataFrame:
    """Batches of about 20000 characters in order; running sums in two levels, so no task has all chunks of a source."""
    from graphmill.operators.windows import running_sum

    rows = running_sum(c.chunks().select("source", "doc_id", "sequence", "n_chars"), ["source"], "doc_id", ["doc_id", "sequence"], "n_chars", 1000)
    return rows.select("source", F.floor((F.col("running") - F.col("n_chars")) / 20000).alias("batch")).groupBy("source", "batch").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS k, list_sort(list_distinct(list_concat([1], range(3, 6), [(l_orderkey % 7)::BIGINT + 1]))) AS pages FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def page_spec(c: Catalog) -> DataFrame:
    spec = F.concat(F.lit("1, 3-5,"), (F.col("l_orderkey") % 7 + 1).cast("string"))
    return c.table("lineitem").select("l_orderkey").distinct().select(F.col("l_orderkey").alias("k"), X.page_spec(spec).cast("array<bigint>").alias("pages"))


@query("SELECT item_id, contains(text, 'now') OR contains(text, 'this') AS time_sensitive, contains(text, 'image') OR contains(text, 'fig') AS wants_images FROM benchmark")
def intent_flags(c: Catalog) -> DataFrame:
    t = F.col("text")
    return c.table("benchmark").select("item_id", X.contains_any(t, ["now", "this"]).alias("time_sensitive"), X.contains_any(t, ["image", "fig"]).alias("wants_images"))


@query("""SELECT page_id, 'page' || page_id || '.pdf' AS title, CASE WHEN page_id BETWEEN 1 AND 10000 AND page_id <> 4 THEN page_id || ',4' ELSE '4' END AS pages, 'alpha,beta' AS must FROM pages""")
def query_hints(c: Catalog) -> DataFrame:
    """Ids that are no page number (1 to 10000) leave p.4 as the only page."""
    i = F.col("page_id").cast("string")
    q = F.concat(F.lit("what does page "), i, F.lit(" of 【alpha】 and [beta] say, and p.4?"))
    title = X.normalized_title(F.concat(F.lit("a/b/《page"), i, F.lit("》")))
    return c.table("pages").select("page_id", title.alias("title"), F.array_join(F.transform(X.page_numbers(q), lambda p: p.cast("string")), ",").alias("pages"), F.array_join(X.must_include(q), ",").alias("must"))


@query("""SELECT n_nationkey AS k, r_name AS region, lower(n_name) = lower(r_name) OR ((contains(lower(n_name), lower(r_name)) OR contains(lower(r_name), lower(n_name))) AND least(length(n_name), length(r_name)) >= 2 AND least(length(n_name), length(r_name)) / greatest(length(n_name), length(r_name)) >= 0.2) AS is_match FROM nation JOIN region ON n_regionkey = r_regionkey""")
def reasonable_match(c: Catalog) -> DataFrame:
    rows = c.table("nation").join(F.broadcast(c.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("n_nationkey").alias("k"), F.col("r_name").alias("region"), X.is_reasonable_match(F.col("n_name"), F.col("r_name")).alias("is_match"))


@query("""SELECT p_partkey AS partkey, '[brand=' || p_brand || ', size=' || p_size || ']' AS props FROM part""")
def property_whitelist(c: Catalog) -> DataFrame:
    props = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("secret"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    kept = X.whitelisted(props, ["brand", "size"])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return c.table("part").select(F.col("p_partkey").alias("partkey"), F.concat(F.lit("["), shown, F.lit("]")).alias("props"))


@query(r"""SELECT DISTINCT l_linenumber AS n, CASE WHEN l_linenumber > 4 THEN NULL ELSE l_linenumber::VARCHAR END AS chapter, 'Wards' AS title, CASE WHEN l_linenumber > 4 THEN l_linenumber || '.2' END AS subsection FROM lineitem""")
def section_hierarchy(c: Catalog) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    heading = F.when(F.col("l_linenumber") > 4, F.concat(n, F.lit(".2 Wards"))).otherwise(F.concat(F.lit("Chapter "), n, F.lit(" Wards")))
    rows = c.table("lineitem").select("l_linenumber").distinct()
    return rows.select(F.col("l_linenumber").alias("n"), X.section_parts(heading).alias("s")).select("n", "s.*")


@query("SELECT doc_id, '## Wards' || chr(10) || 'from ' || source || '[1][2]' || chr(10) || lang || ' text[3]' || chr(10) || '```' AS tidy FROM documents")
def answer_layout(c: Catalog) -> DataFrame:
    raw = F.concat(F.lit("■ ## Wards [1][2]\nfrom "), "source", F.lit("\n[3] "), "lang", F.lit(" text```"))
    return c.table("documents").select("doc_id", X.tidy_layout(raw).alias("tidy"))


@query("""WITH r AS (SELECT l_orderkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag, l_linestatus) AS i, l_returnflag || ' ' || l_linestatus AS snippet FROM lineitem)
SELECT l_orderkey AS k, string_agg('- [' || i || '] ' || snippet || ' (supplier ' || l_suppkey || ', p. ' || l_linenumber || ')', chr(10) ORDER BY i) AS evidence FROM r GROUP BY l_orderkey""")
def evidence_markdown(c: Catalog) -> DataFrame:
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "snippet"))
    rows = c.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("snippet")).withColumn("number", number)
    line = X.evidence_line(F.col("number"), F.col("snippet"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")), F.col("l_linenumber"))
    lines = rows.select(F.col("l_orderkey").alias("k"), "number", line.alias("line")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("number", "line"))).alias("s"))
    return lines.select("k", F.array_join("s.line", "\n").alias("evidence"))
