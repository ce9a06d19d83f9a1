"""The graph, files and folders in DuckDB SQL: the first common table expressions of every oracle query."""

GRAPH = """
nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, 'Region' AS type, 'f' || r_regionkey AS folder_id, CASE WHEN r_regionkey % 5 = 0 THEN ['geo', 'shared'] ELSE ['geo'] END AS file_ids, '' AS description, CAST(NULL AS DOUBLE) AS confidence FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'Nation', 'f' || n_regionkey, CASE WHEN n_nationkey % 5 = 0 THEN ['geo', 'shared'] ELSE ['geo'] END, '', NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'Customer', 'f' || n_regionkey, CASE WHEN c_custkey % 5 = 0 THEN ['cust', 'shared'] ELSE ['cust'] END, c_mktsegment, abs(c_acctbal) / 16384 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, s_name, 'Supplier', 'f' || n_regionkey, CASE WHEN s_suppkey % 5 = 0 THEN ['supp', 'shared'] ELSE ['supp'] END, NULL, abs(s_acctbal) / 16384 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'p' || p_partkey, p_name, 'Part', 'f' || (p_size % 5), CASE WHEN p_partkey % 5 = 0 THEN ['part' || (p_size % 4), 'shared'] ELSE ['part' || (p_size % 4)] END, p_brand || ' ' || p_type, p_retailprice / 16384 FROM part),
li AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
ps AS (SELECT l_partkey, l_suppkey, sum(qty) AS w, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(qty) DESC, l_suppkey) AS n FROM li GROUP BY 1, 2),
cp AS (SELECT o_custkey, l_partkey, sum(price) AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY sum(price) DESC, l_partkey) AS n FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
edges AS (
  SELECT 'n' || n_nationkey || '-r' || n_regionkey AS id, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PART_OF' AS type, CAST(1 AS DOUBLE) AS strength, ['geo'] AS file_ids FROM nation
  UNION ALL SELECT 'c' || c_custkey || '-n' || c_nationkey, 'c' || c_custkey, 'n' || c_nationkey, 'LOCATED_IN', NULL, ['cust'] FROM customer
  UNION ALL SELECT 's' || s_suppkey || '-n' || s_nationkey, 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN', NULL, ['supp'] FROM supplier
  UNION ALL SELECT 'p' || l_partkey || '-s' || l_suppkey, 'p' || l_partkey, 's' || l_suppkey, 'SUPPLIED_BY', CAST(w AS DOUBLE), ['part'] FROM ps WHERE n = 1
  UNION ALL SELECT 'c' || o_custkey || '-p' || l_partkey, 'c' || o_custkey, 'p' || l_partkey, 'BOUGHT', CAST(w AS DOUBLE), ['cust'] FROM cp WHERE n = 1
  UNION ALL SELECT 'c' || o_custkey || '-s' || l_suppkey, 'c' || o_custkey, 's' || l_suppkey, 'SERVED_BY', CAST(1 AS DOUBLE), ['cust'] FROM cp JOIN ps USING (l_partkey) WHERE cp.n = 1 AND ps.n = 1),
adj AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
deg AS (SELECT a AS id, count(*) AS d FROM adj GROUP BY a),
inc AS (SELECT id, sum(d) AS d FROM (SELECT src AS id, count(*) AS d FROM edges GROUP BY 1 UNION ALL SELECT dst, count(*) FROM edges GROUP BY 1) GROUP BY 1),
files AS (SELECT 'o' || o_orderkey AS file_id, 'c' || o_custkey AS folder_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending_review' WHEN 'P' THEN 'processing' END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS file_size, o_orderdate AS created_at FROM orders),
folders AS (SELECT 'c' || c_custkey AS folder_id, c_name AS folder_name, 'n' || c_nationkey AS owner FROM customer)
"""


# Every pair of the line items instead of each one's first.
EVERY = (
    GRAPH.replace("FROM ps WHERE n = 1", "FROM ps")
    .replace("FROM cp WHERE n = 1", "FROM cp")
    .replace("'SERVED_BY', CAST(1 AS DOUBLE), ['cust'] FROM cp JOIN ps USING (l_partkey) WHERE cp.n = 1 AND ps.n = 1", "'SERVED_BY', CAST(sum(price) AS DOUBLE), ['cust'] FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey")
)


def over(text: str, recursive: bool = False, every: bool = False) -> str:
    """An oracle query over the graph: ``text`` goes on with more expressions after a comma, or with SELECT."""
    t = text.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{(EVERY if every else GRAPH).strip()}{'' if t.startswith(',') else chr(10)}{t}"
