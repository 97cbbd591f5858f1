"""Links, crawl scope and the breadth-first frontier over already fetched pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagemill.functions import urls as u
from pagemill.session import checkpointed


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, href, target of every rooted anchor, navigation included: a pattern over the markup, no parse."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), F.lit(1)))
    links = pages.select("page_id", F.regexp_extract("url", f"^({u.SCHEME}://[^/?#]*)", 1).alias("base"), hrefs.alias("href"))
    return links.where(F.col("href").startswith("/")).select("page_id", "href", F.concat("base", "href").alias("target"))


def scope_reason(link: Column, allow=(), block=(), seed_hosts=(), trees=()) -> Column:
    """First scope rule that a link breaks; null where it is in scope."""
    host = u.host(link)
    out = F.when(~u.is_allowed_host(host, allow, block), "domain_policy").when(~u.is_allowed_path(link), "structural_path")
    if seed_hosts:
        out = out.when(~u.in_hosts(host, seed_hosts), "strict_domain")
    if trees:
        out = out.when(~u.path(link).rlike("^(" + "|".join(re.escape(x) for x in trees) + ")"), "site_tree")
    return out


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int = 0, dead: DataFrame | None = None) -> DataFrame:
    """node and smallest depth of what the seeds reach along edges (src, dst); max_depth 0 goes on until nothing is new.

    One round for each depth: frontier joined with the edges, less what is visited or dead. Each round's frontier is
    checkpointed, so the plan doesn't grow with the depth.
    """
    level = checkpointed(seeds.select(F.col("node").cast("long").alias("node"), F.lit(0).alias("depth")).distinct())
    visited, depth = level, 0
    links = edges.select(F.col("src").alias("node"), F.col("dst").cast("long").alias("dst")).distinct()
    while (max_depth <= 0 or depth < max_depth) and level.take(1):
        depth += 1
        new = level.join(links, "node").select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti")
        if dead is not None:
            new = new.join(dead, "node", "left_anti")
        level = checkpointed(new.withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(level)
    return visited


def low_yield(reports: DataFrame) -> DataFrame:
    """Pages a host's poor yield would have skipped: 15 earlier pages with nothing, or 20 with under a twentieth.

    The gate stays shut once it has closed. Needs one window over each host's pages in order.
    """
    before = W.partitionBy("host").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = reports.withColumn("__n", F.count("*").over(before)).withColumn("__kept", F.coalesce(F.sum(F.col("images_found") + F.col("videos_found")).over(before), F.lit(0)))
    poor = ((F.col("__n") >= 15) & (F.col("__kept") == 0)) | ((F.col("__n") >= 20) & (F.col("__kept") * 20 < F.col("__n")))
    shut = F.bool_or(poor).over(W.partitionBy("host").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("skipped", shut).drop("__n", "__kept")
