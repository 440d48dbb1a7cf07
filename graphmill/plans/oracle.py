"""DuckDB text of the derived tables, as common table expressions."""

CHUNKS = """chunks AS (
  SELECT doc_id, line AS sequence, content, length(content)::INT AS n_chars, source, lang,
    CASE WHEN contains(content, '|') THEN 'table' WHEN len(string_split(content, ' ')) <= 3 THEN 'title' ELSE 'text' END AS content_type
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents)
  WHERE trim(content, ' ') <> '')"""

DOC_TERMS = CHUNKS + """,
doc_terms AS (SELECT doc_id, sequence, unnest(regexp_extract_all(lower(content), '[a-z]{4,}')) AS term FROM chunks)"""

NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order', 'order:' || o_orderkey FROM orders)"""

EDGES = """edges AS (
  SELECT 'region:' || n_regionkey AS src, 'CONTAINS' AS rel, 'nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'CONTAINS', 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'CONTAINS', 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'PLACED', 'order:' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'REQUIRES', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'PROVIDES', 'part:' || l_partkey FROM lineitem)"""

GRAPH = NODES + ",\n" + EDGES

TRIPLETS = """triplets AS (
  SELECT 'order:' || l_orderkey AS subject, CASE l_returnflag WHEN 'R' THEN 'REQUIRES' WHEN 'A' THEN 'CONTAINS' ELSE 'RELATED_TO' END AS relation,
    'part:' || l_partkey AS object, round(1 - l_discount, 2) AS confidence, l_linenumber::BIGINT AS chunk_id, l_suppkey AS doc_id FROM lineitem)"""

TASKS = """tasks AS (
  SELECT user_id AS task_id, 'm' || (user_id % 4) AS module, event_type AS status, ts AS created_at, value, props AS extra, event_id FROM events)"""

MESSAGES = """messages AS (SELECT conv_id AS session_id, turn AS sequence, role, text AS content FROM conversations)"""

ITEMS = """items AS (
  SELECT 'part:' || l_partkey AS entity_id, CASE l_returnflag WHEN 'R' THEN 'vector' WHEN 'A' THEN 'text' ELSE 'graph' END AS source, l_suppkey AS doc_id,
    round(1 - l_discount, 2) AS score, round(l_tax, 2) AS coverage, concat_ws(' ', l_returnflag, l_linestatus, l_quantity::INT) AS snippet,
    l_orderkey AS pos, l_linenumber AS page FROM lineitem)"""
