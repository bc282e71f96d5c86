"""The driver's TPC-H-like tables re-read as repository activity.

Each function returns a clean entity table built
from the parquet tables in ``sf_dir``. The mapping is fixed so that the
same views can be written in plain SQL for the DuckDB oracle
(``plans.oracle``):

* pulls        <- orders   (repo = orders/<o_orderpriority>, created_at = o_orderdate)
* commits      <- lineitem (repo = l_returnflag without an owner, so an invalid key;
                  date = l_shipdate); owned_commits has the key lineitem/<l_returnflag>,
                  reported_commits too but for flag R, whose key stays invalid
* issues       <- orders left join lineitem (closed_at = first ship date on or
                  after the order date, for status F only)
* releases     <- 1-URGENT orders join customer join nation (repo = nation/<n_name>)
* branches     <- part     (repo = part/<p_brand>, list order = p_partkey)
* contributors <- customer left join order counts (repo = customer/<c_mktsegment>,
                  list order = contributions desc, c_custkey)
* repositories <- nation   (no stars/forks in the data -> 0)
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import STRICT_FORMAT

# Fixed value: the "today" the stand-in queries are evaluated at. The
# data ends in August 2001, so this plays the role of now().
AS_OF = _dt.date(2001, 9, 1)


class Tables:
    """Lazy parquet loader for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # one scan definition per table (file listing + footers read once);
        # each use still gets its own pruned, filter-pushed scan
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]


def _key(owner: str, col: str):
    """'owner/name' key out of a column."""
    return F.concat(F.lit(f"{owner}/"), F.col(col)).alias("repo")


def pulls(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(_key("orders", "o_orderpriority"), F.col("o_orderkey").alias("number"),
                    F.col("o_orderdate").alias("created_at"))


def commits(t: Tables) -> DataFrame:
    li = t.lineitem
    sha = F.md5(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
    return li.select(F.col("l_returnflag").alias("repo"), sha.alias("sha"), F.col("l_shipdate").alias("date"))


def owned_commits(t: Tables) -> DataFrame:
    """Commits under valid keys, as the report forecasts them."""
    return commits(t).withColumn("repo", _key("lineitem", "repo"))


def reported_commits(t: Tables) -> DataFrame:
    """Commits as the report queries read them: valid keys, and one without an owner."""
    return commits(t).withColumn("repo", F.when(F.col("repo") == "R", F.col("repo")).otherwise(F.concat(F.lit("lineitem/"), "repo")))


def commit_units(t: Tables) -> DataFrame:
    """A long undated list: one entry for every unit of every line item."""
    return t.lineitem.select(_key("units", "l_returnflag"), F.explode(F.sequence(F.lit(1), F.col("l_quantity").cast("int"))).alias("unit"))


def issues(t: Tables, since: _dt.date | None = None) -> DataFrame:
    """Orders as issues; closed_at is the first ship date >= order date.

    ``since`` keeps the issues created on that day or later. A closing date
    never lies before its creation, so the same bound prunes both scans.

    The join is on the order key only (unique in orders, <= 7 lines each),
    so the sort-merge join's hash partitioning on the key also serves the
    following aggregate: one shuffle per side, no skew.
    """
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    li = t.lineitem.select(F.col("l_orderkey"), F.col("l_shipdate"))
    if since is not None:
        bound = F.lit(f"{since} 00:00:00").cast("timestamp_ntz")
        o, li = o.where(F.col("o_orderdate") >= bound), li.where(F.col("l_shipdate") >= bound)
    j = o.join(li, (o.o_orderkey == li.l_orderkey) & (li.l_shipdate >= o.o_orderdate)
               & (o.o_orderstatus == F.lit("F")), "left")
    g = j.groupBy("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority") \
        .agg(F.min("l_shipdate").alias("first_ship"))
    return g.select(
        _key("orders", "o_orderpriority"),
        F.col("o_orderkey").alias("issue_number"),
        F.col("o_orderdate").cast("date").alias("created_at"),
        F.col("first_ship").cast("date").alias("closed_at"),
        F.when(F.col("o_orderstatus") == "F", F.lit("closed")).otherwise(F.lit("open")).alias("state"),
        F.col("o_custkey").cast("string").alias("author"),
    )


def issues_created(t: Tables) -> DataFrame:
    """(repo, issue_number, created_at) alone: no line items are read."""
    return t.orders.select(_key("orders", "o_orderpriority"), F.col("o_orderkey").alias("issue_number"),
                           F.col("o_orderdate").cast("date").alias("created_at"))


def releases(t: Tables) -> DataFrame:
    """Urgent orders as releases of the customer's nation.

    ``nation`` has a fixed 25 rows (TPC-H spec), so broadcasting it is
    safe at any scale; the orders-customer join is left to AQE, which
    broadcasts customer only when its measured size is under the
    threshold and otherwise keeps the sort-merge join.
    """
    o = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey", "o_orderdate")
    c = t.customer.select("c_custkey", "c_nationkey")
    n = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(_key("nation", "n_name"), F.col("o_orderkey").cast("string").alias("name"),
                    F.col("o_orderdate").alias("published_at"),
                    F.date_format(F.col("o_orderdate"), STRICT_FORMAT).alias("published_text"))


def branches(t: Tables) -> DataFrame:
    p = t.part
    return p.select(_key("part", "p_brand"), F.col("p_name").alias("name"),
                    F.md5(F.col("p_partkey").cast("string")).alias("commit_sha"),
                    F.col("p_partkey").alias("seq"))


# List order of each undated entity, as (column, descending) pairs.
BRANCH_ORDER = [("seq", False)]


def contributors(t: Tables) -> DataFrame:
    """Customers as contributors; contributions = number of orders.

    Orders are pre-aggregated per customer (partial aggregation before the
    shuffle), then joined to customer on the unique key.
    """
    cnt = t.orders.groupBy(F.col("o_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    j = c.join(cnt, c.c_custkey == cnt.o_custkey, "left")
    return j.select(_key("customer", "c_mktsegment"), F.col("c_name").alias("name"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("contributions"),
                    F.col("c_custkey").alias("seq"))


CONTRIBUTOR_ORDER = [("contributions", True), ("seq", False)]


def repositories(t: Tables) -> DataFrame:
    return t.nation.select(_key("nation", "n_name"), F.lit(0).cast("long").alias("stars"),
                           F.lit(0).cast("long").alias("forks"))


def events(t: Tables) -> DataFrame:
    """Short daily stream (30 days): the too-short negative fixture."""
    return t.events.select(F.col("event_type").alias("repo"), F.col("event_id").alias("number"),
                           F.col("ts").alias("created_at"))
