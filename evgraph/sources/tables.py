"""The star schema's tables as an evidence graph: nodes, edges, lines, claims, journal, vectors.

Every function gives a lazy DataFrame over Parquet; columns that a query does not use are pruned at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.operators.traverse import Relation
from evgraph.schema import TIERS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


#: Table, key and name column of each kind of node.
NODE_TABLES = {"region": ("region", "r_regionkey", "r_name"), "nation": ("nation", "n_nationkey", "n_name"), "customer": ("customer", "c_custkey", "c_name"), "supplier": ("supplier", "s_suppkey", "s_name"), "part": ("part", "p_partkey", "p_name"), "order": ("orders", "o_orderkey", "o_orderpriority")}


def nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(NODE_TABLES)) -> DataFrame:
    """(id, kind, name, path) of the star schema's rows."""
    out = None
    for kind in kinds:
        table, key, name = NODE_TABLES[kind]
        part = read(spark, sf_dir, table).select(node_id(kind, key).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


def _edge(df: DataFrame, source: Column, target: Column, kind: str, rank: Column | int = 0) -> DataFrame:
    tier = F.element_at(F.array(*map(F.lit, TIERS)), (F.lit(rank) if isinstance(rank, int) else rank) + 1)
    return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), tier.alias("tier"))


def reference_edges(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    out = _edge(read(spark, sf_dir, "nation"), node_id("nation", "n_nationkey"), node_id("region", "n_regionkey"), "REFERENCES")
    out = out.unionByName(_edge(read(spark, sf_dir, "customer"), node_id("customer", "c_custkey"), node_id("nation", "c_nationkey"), "REFERENCES"))
    out = out.unionByName(_edge(read(spark, sf_dir, "supplier"), node_id("supplier", "s_suppkey"), node_id("nation", "s_nationkey"), "REFERENCES"))
    if orders:
        out = out.unionByName(_edge(read(spark, sf_dir, "orders"), node_id("order", "o_orderkey"), node_id("customer", "o_custkey"), "REFERENCES"))
    return out


def use_edges(spark: SparkSession, sf_dir: str, what: tuple[str, ...] = ("order-part", "part-supplier")) -> DataFrame:
    """Distinct USES edges of lineitem; the tier is the most certain that any of its rows gives."""
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    out = None
    for pair in what:
        a, b = {"order-part": ("l_orderkey", "l_partkey"), "part-supplier": ("l_partkey", "l_suppkey")}[pair]
        least = read(spark, sf_dir, "lineitem").groupBy(a, b).agg(F.min(rank).alias("rank"))
        x, y = pair.split("-")
        part = _edge(least, node_id(x, a), node_id(y, b), "USES", F.col("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, tier) of the whole graph."""
    return reference_edges(spark, sf_dir).unionByName(use_edges(spark, sf_dir))


def small_relations(spark: SparkSession, sf_dir: str) -> list[Relation]:
    """:func:`small_edges` as tables of keys."""
    return [
        Relation("nation", "region", "REFERENCES", read(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey"),
        Relation("customer", "nation", "REFERENCES", read(spark, sf_dir, "customer"), "c_custkey", "c_nationkey"),
        Relation("supplier", "nation", "REFERENCES", read(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey"),
    ]


def relations(spark: SparkSession, sf_dir: str, orders: bool = True) -> list[Relation]:
    """The same edges as tables of keys, for traversals that need no tier; without ``orders``, those below parts only."""
    out = [
        *small_relations(spark, sf_dir),
        Relation("part", "supplier", "USES", read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey"),
        Relation("order", "customer", "REFERENCES", read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey"),
    ]
    return [*out, Relation("order", "part", "USES", read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")] if orders else out


def small_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, customer and supplier only."""
    return reference_edges(spark, sf_dir, orders=False)


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file journal: (seq, observed_ms, event_kind, path)."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"signup": "create", "view": "modify", "click": "modify", "purchase": "rename", "error": "delete"}.items() for x in kv]), F.col("event_type"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("observed_ms"), kind.alias("event_kind"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("path"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line from 1, text) of every document."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line"), "text")
