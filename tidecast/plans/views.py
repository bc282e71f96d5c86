"""The stand-in entity views written as SQL (DuckDB dialect) for the oracle.

They state the same mapping as ``sources.standins`` does with the
DataFrame API; both sides must stay in step.
"""

AS_OF_SQL = "DATE '2001-09-01'"

VIEWS = {
    "pulls": """pulls AS (
  SELECT 'orders/' || o_orderpriority AS repo, o_orderkey AS number, o_orderdate AS created_at FROM orders)""",
    "commits": """commits AS (
  SELECT l_returnflag AS repo,
         md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)) AS sha,
         l_shipdate AS "date"
  FROM lineitem)""",
    "reported_commits": """commits AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'lineitem/' || l_returnflag END AS repo, l_shipdate AS "date"
  FROM lineitem)""",
    "issues": """issues AS (
  SELECT 'orders/' || o.o_orderpriority AS repo, o.o_orderkey AS issue_number,
         CAST(o.o_orderdate AS DATE) AS created_at,
         CAST(min(l.l_shipdate) AS DATE) AS closed_at,
         CASE WHEN o.o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state,
         CAST(o.o_custkey AS VARCHAR) AS author
  FROM orders o
  LEFT JOIN lineitem l
    ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate AND o.o_orderstatus = 'F'
  GROUP BY o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority)""",
    "releases": """releases AS (
  SELECT 'nation/' || n.n_name AS repo, CAST(o.o_orderkey AS VARCHAR) AS name, o.o_orderdate AS published_at,
         strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_text
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderpriority = '1-URGENT')""",
    "branches": """branches AS (
  SELECT 'part/' || p_brand AS repo, p_name AS name, md5(CAST(p_partkey AS VARCHAR)) AS commit_sha, p_partkey AS seq
  FROM part)""",
    "contributors": """contributors AS (
  SELECT 'customer/' || c.c_mktsegment AS repo, c.c_name AS name, CAST(coalesce(k.n, 0) AS BIGINT) AS contributions,
         c.c_custkey AS seq
  FROM customer c
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) k ON c.c_custkey = k.o_custkey)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH [RECURSIVE] view1 AS (...), view2 AS (...)`` prefix; the caller
    appends ``, more_ctes AS (...) SELECT ...``."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(VIEWS[n] for n in names)
