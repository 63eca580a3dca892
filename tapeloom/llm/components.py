"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import kept

C = F.col

#: Links, as counted, up to which the smallest neighbours of a round are sent whole to every task.
SENT = 50_000


def _sized(least: DataFrame, links: int) -> DataFrame:
    """One row a node, to join with links: broadcast if links were counted to be few.

    Spark would size either side by compressed files in which each link counts once, and broadcast more
    than the driver holds. A stored table and a merge join let adaptive execution split the links of a hub.
    """
    return F.broadcast(least) if links <= SENT else kept(least, "least").hint("merge")


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node of its neighbourhood."""
    ways = [F.struct(C(u).alias("u"), C(v).alias("v")) for u, v in (("hi", "lo"), ("lo", "hi"))]
    both = edges.select(F.inline(F.array(*ways)))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    ties = both.join(_sized(least, links), "u").filter(C("v") > C("u")).select(C("v").alias("hi"), C("m").alias("lo")).distinct()
    return ties if links <= SENT else kept(ties, "ties")


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    ties = F.array(F.struct(C("hi").alias("a"), C("m").alias("b")), F.struct(C("lo").alias("a"), C("m").alias("b")))
    pairs = edges.join(_sized(least, links), "hi").select(F.inline(ties)).filter(C("a") != C("b"))
    return pairs.select(C("a").alias("hi"), C("b").alias("lo")).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first()
    return tuple(row)


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, component (smallest node reachable) for every node that has a link.

    Links may repeat, run either way or join a node to itself (ignored); null ends are ignored.
    A hub's links are reduced by grouped minima before each shuffle and are never gathered in one
    task. Each round is written to the shared folder; only its row count and a checksum reach the
    driver. The result is hinted for a join: broadcast up to ``SENT`` links, else merged. An empty
    table gives an empty result.
    """
    edges = (
        links.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .filter(C(left).isNotNull() & C(right).isNotNull() & (C(left) != C(right)))
        .distinct()
    )
    edges = kept(edges, "links")
    seen = None
    while (now := _digest(edges)) != seen:
        seen = now
        edges = kept(_small_star(_large_star(edges, now[0]), now[0]), "stars")
    heads = edges.select(C("lo").alias("node"), C("lo").alias("component")).distinct()
    found = edges.select(C("hi").alias("node"), C("lo").alias("component")).unionByName(heads)
    return F.broadcast(found) if now[0] <= SENT else found.hint("merge")
