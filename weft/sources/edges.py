"""Edge sources: text edge lists, relational tables projected to graphs, fixtures and generators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.graph import dedup_undirected
from weft.sources.scratch import materialize

#: Zachary's karate club (1977), each line one node and its larger neighbours. Fixed values.
KARATE = """
0 1 2 3 4 5 6 7 8 10 11 12 13 17 19 21 31
1 2 3 7 13 17 19 21 30
2 3 7 8 9 13 27 28 32
3 7 12 13
4 6 10
5 6 10 16
6 16
8 30 32 33
9 33
13 33
14 32 33
15 32 33
18 32 33
19 33
20 32 33
22 32 33
23 25 27 29 32 33
24 25 27 31
25 31
26 29 33
27 33
28 31 33
29 32 33
30 32 33
31 32 33
32 33
"""


def parse_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """Canonical edges of text lines: the first two tokens, where both are digits only.

    Blank lines and lines that begin with # or % are comments; commas, semicolons and tabs separate like
    spaces; further tokens are ignored; loops and repetitions go. Headers, signs and decimals don't parse and
    are skipped, and so are ids beyond 18 digits.
    """
    clean = F.trim(F.regexp_replace(F.col(column), r"[,;\s]+", " "))
    tokens = lines.select(clean.alias("line")).where("line <> '' and line not rlike '^[#%]'").select(F.split("line", " ").alias("t")).where("size(t) >= 2")
    digits = tokens.where(F.col("t")[0].rlike("^[0-9]{1,18}$") & F.col("t")[1].rlike("^[0-9]{1,18}$"))
    return dedup_undirected(digits.select(F.col("t")[0].cast("bigint").alias("u"), F.col("t")[1].cast("bigint").alias("v")))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Edges of text files, gzipped ones too."""
    return parse_edges(spark.read.text(path))


def karate(spark: SparkSession) -> DataFrame:
    rows = [(a, b) for line in KARATE.split("\n") if line for a, *rest in [list(map(int, line.split()))] for b in rest]
    return spark.createDataFrame(rows, "u bigint, v bigint")


def powerlaw_cluster(spark: SparkSession, n: int, m: int, p: float = 0.45, seed: int = 42) -> DataFrame:
    """A growing graph with triangles (Holme and Kim 2002): each node brings m links, to nodes by degree or, with
    probability p, to a neighbour of the last one linked. Sequential by nature: made on the driver, for fixtures."""
    if not 1 <= m < n:
        raise ValueError("m must be between 1 and n - 1")
    rng = random.Random(seed)
    linked: dict[int, set[int]] = {i: set() for i in range(n)}
    ends = list(range(m))  # each node once for each of its links
    for new in range(m, n):
        target = None
        while len(linked[new]) < m:
            open_ = sorted(linked[target] - linked[new] - {new}) if target is not None and rng.random() < p else []
            target = rng.choice(open_) if open_ else rng.choice(ends)
            if target != new and target not in linked[new]:
                linked[new].add(target)
                linked[target].add(new)
        ends += [x for t in linked[new] for x in (t, new)]
    return spark.createDataFrame([(u, v) for u in linked for v in linked[u] if u < v], "u bigint, v bigint")


def shared_order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts returned in the same order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("p")).distinct()
    return _pairs(rows, ["l_orderkey"], "p")


def shared_order_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with large returned positions in the same order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R' and l_quantity >= 40").select("l_orderkey", F.col("l_suppkey").alias("p")).distinct()
    return _pairs(rows, ["l_orderkey"], "p")


def same_day_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ordered on one day with equal priority and status."""
    return group_pairs(same_day_members(spark, sf_dir))


def same_day_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, p), saved: the customers of each day, priority and status, which are numbered."""
    by = ["o_orderdate", "o_orderpriority", "o_orderstatus"]
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*by, F.col("o_custkey").alias("p")).where("p is not null").distinct()
    groups = materialize(rows.select(*by).distinct().withColumn("g", F.monotonically_increasing_id()), "groups")
    return materialize(rows.join(groups, by).select("g", "p"), "members")


#: Members of a group that are paired in one task; larger groups are split into parts of about so many.
GROUP_PART = 1024


def group_pairs(members: DataFrame) -> DataFrame:
    """(u, v) distinct, u < v: who is in a group together, of distinct members(g, p).

    Pairs come from the first group that both are in: members bring the groups before it along, so pairs, which grow
    with the square of a group, are never shuffled. A member of k groups sends k * k / 2 numbers.
    """
    lists = members.groupBy("p").agg(F.sort_array(F.collect_list("g")).alias("gs"))
    placed = lists.select("p", F.posexplode("gs").alias("k", "g"), "gs").select("g", "p", F.slice("gs", 1, F.col("k")).alias("early"))
    sizes = members.groupBy("g").agg(F.ceil(F.count("*") / GROUP_PART).cast("int").alias("parts"))
    dealt = placed.join(sizes, "g")
    left = dealt.select("g", F.col("p").alias("u"), F.col("early").alias("_eu"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = dealt.select("g", F.col("p").alias("v"), F.col("early").alias("_ev"), F.pmod(F.xxhash64("p"), F.col("parts")).cast("int").alias("part"))
    return left.hint("merge").join(right, ["g", "part"]).where((F.col("u") < F.col("v")) & ~F.arrays_overlap("_eu", "_ev")).select("u", "v")


def group_links(members: DataFrame) -> DataFrame:
    """(u, v): each member with the least one of its group, which connect the same nodes as all pairs."""
    least = members.groupBy("g").agg(F.min("p").alias("u"))
    return members.join(least, "g").where("p > u").select("u", F.col("p").alias("v")).distinct()


def _pairs(rows: DataFrame, by: list[str], node: str) -> DataFrame:
    other = rows.withColumnRenamed(node, "q")
    return rows.join(other, by).where(F.col(node) < F.col("q")).select(F.col(node).alias("u"), F.col("q").alias("v")).distinct()


GRAPHS = {"karate": lambda spark, sf_dir: karate(spark), "parts": shared_order_parts, "suppliers": shared_order_suppliers, "customers": same_day_customers}


def load_graph(spark: SparkSession, name: str, sf_dir: str | None = None) -> DataFrame:
    """Canonical edges of a named graph, or of an edge-list file if name is a path."""
    if name in GRAPHS:
        return GRAPHS[name](spark, sf_dir)
    if "/" in name:
        return read_edge_list(spark, name)
    raise ValueError(f"unknown graph {name!r}: {', '.join(sorted(GRAPHS))}, or a path")
