"""Connected components of a table of links, by alternating large and small stars.

Each round hangs the larger neighbours of every node on its smallest one, then does the same for
the smaller ones; the links shrink to stars around the smallest node of each component. A node's
minimum is an aggregation, which combines before its shuffle, and is joined back to its links,
where adaptive execution can split a hub. Every round is a table in the shared folder; the driver
sees a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeaudit.sources.work import stored


def _hang(links: DataFrame) -> DataFrame:
    """(u, v, m): each link with the smallest of u and its v's."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_hang(both).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(links: DataFrame) -> DataFrame:
    """The links point to smaller nodes here."""
    hung = _hang(links)
    return (hung.select("u", F.col("m").alias("v"))
            .union(hung.select(F.col("v").alias("u"), F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """(u, v) links to distinct (u, v): every linked node but the smallest of its component, with
    that smallest node. Loops are ignored."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = stored(links.filter(F.col("u") != F.col("v")).distinct(), "links")
    seen = None
    while True:
        sign = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                                                  F.lit(0))).first()
        if sign == seen or not sign[0]:
            return links
        seen = sign
        links = _small(_large(links).distinct())
        links = stored(links.filter(F.col("u") != F.col("v")).distinct(), "links")
