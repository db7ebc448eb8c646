"""Money flow: lookups, balances and one-hop traces. orders plays blocks, lineitem the inputs and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import Tables, query

IO = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


def _io(rows: DataFrame) -> DataFrame:
    return rows.select(*IO)


query("btc_q1", "SELECT * FROM orders WHERE o_orderkey = 33")(lambda t: t.orders.where("o_orderkey = 33"))
query("btc_q2", "SELECT * FROM orders WHERE o_custkey = 7")(lambda t: t.orders.where("o_custkey = 7"))
query("btc_q3", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey = 33")(lambda t: _io(t.lineitem.where("l_orderkey = 33")))
query("btc_q4", "SELECT l_suppkey AS address, round(sum(l_quantity), 8) AS balance, count(*) AS n FROM lineitem WHERE l_suppkey = 5 GROUP BY 1")(lambda t: t.lineitem.where("l_suppkey = 5").groupBy(F.col("l_suppkey").alias("address")).agg(F.round(F.sum("l_quantity"), 8).alias("balance"), F.count("*").alias("n")))
query("btc_q4_all", "SELECT round(sum(l_quantity), 8) AS balance, count(*) AS n FROM lineitem WHERE l_suppkey = 5")(lambda t: t.lineitem.where("l_suppkey = 5").agg(F.round(F.sum("l_quantity"), 8).alias("balance"), F.count("*").alias("n")))
query("btc_q4_signed", "SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END), 8) AS balance FROM lineitem WHERE l_suppkey = 5")(lambda t: t.lineitem.where("l_suppkey = 5").agg(F.round(F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))), 8).alias("balance")))
query("btc_q5", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_suppkey = 5 ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 10")(lambda t: t.lineitem.where("l_suppkey = 5").select("l_orderkey", "l_linenumber", "l_shipdate").orderBy(F.col("l_shipdate").desc_nulls_first(), "l_orderkey", "l_linenumber").limit(10))


def spends(t: Tables, supplier: int) -> DataFrame:
    """Distinct transactions that an address put money into."""
    return t.lineitem.where((F.col("l_suppkey") == supplier) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_shipdate").distinct()


SPENDS = "(SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem WHERE l_suppkey = 5 AND l_returnflag = 'R')"


@query("btc_q6", f"SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_returnflag <> 'R' AND (l_orderkey, l_shipdate) IN {SPENDS} UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey = 5 AND (l_orderkey, l_shipdate) IN {SPENDS}")
def trace(t: Tables) -> DataFrame:
    """Outputs of the transactions that an address spends in, and its own entries in them."""
    tx = spends(t, 5)
    out = t.lineitem.where("l_returnflag <> 'R'").join(tx, ["l_orderkey", "l_shipdate"], "left_semi")
    own = t.lineitem.where("l_suppkey = 5").join(tx, ["l_orderkey", "l_shipdate"], "left_semi")
    return _io(out).unionByName(_io(own))


@query("btc_q7", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT')")
def miner(t: Tables) -> DataFrame:
    """Entries of the one transaction that a scalar subquery finds."""
    key = t.orders.where("o_orderpriority = '1-URGENT'").agg(F.max("o_orderkey")).scalar()
    return _io(t.lineitem.where(F.col("l_orderkey") == key))


query("btc_q8", "SELECT round(sum(l_extendedprice), 2) AS earned, count(*) AS n, min(l_shipdate) AS first_seen FROM lineitem WHERE l_suppkey = 5 AND (l_linestatus = 'F') = TRUE")(lambda t: t.lineitem.where((F.col("l_suppkey") == 5) & ((F.col("l_linestatus") == "F") == F.lit(True))).agg(F.round(F.sum("l_extendedprice"), 2).alias("earned"), F.count("*").alias("n"), F.min("l_shipdate").alias("first_seen")))


@query("btc_q9", "SELECT l_suppkey AS address, round(sum(l_quantity), 8) AS received, count(*) AS n FROM lineitem WHERE l_suppkey <> 5 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 5) GROUP BY 1")
def receivers(t: Tables) -> DataFrame:
    tx = t.lineitem.where("l_suppkey = 5").select("l_orderkey").distinct()
    rows = t.lineitem.where("l_suppkey <> 5").join(tx, "l_orderkey", "left_semi")
    return rows.groupBy(F.col("l_suppkey").alias("address")).agg(F.round(F.sum("l_quantity"), 8).alias("received"), F.count("*").alias("n"))


@query("btc_active", "SELECT l_suppkey AS address, count(*) AS n, count(DISTINCT l_orderkey) AS txs FROM lineitem GROUP BY 1 ORDER BY n DESC, address LIMIT 10")
def most_active(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("address")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("txs")).orderBy(F.col("n").desc(), "address").limit(10)
