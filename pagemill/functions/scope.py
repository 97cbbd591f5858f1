"""Which links of a page lead to pages of the same subject: built-in expressions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from . import text as t, urls as u, vocab as v


def _path(url: Column) -> Column:
    p = F.rtrim(u.path(url), F.lit("/"))
    return F.when(p == "", "/").otherwise(p)


def _segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda x: x != "")


def detail_reason(link: Column, seed: Column, keyword: str = "", aliases=(), anchor: Column | None = None) -> Column:
    """The first rule by which a link is no page about the subject of the seed page; null where it is one.

    Without a keyword or alias only the rules on the seed's own path, pagination and navigation apply.
    """
    p, start, host = _path(link), _path(seed), u.host(link) == u.host(seed)
    low, words = F.lower(p), t.subject_tokens(keyword, tuple(aliases))
    names = list(dict.fromkeys(x for x in (keyword.lower(), *(a.lower().strip() for a in aliases)) if x))
    paged = u.any_of(p, v.PAGE_PARTS) | F.lower(u.query(link)).rlike(r"(?:^|&)(?:page|p|pg)=\d")
    out = F.when(p == start, "same_page").when(paged, "pagination").when(p.isin(*v.NAVIGATION_PATHS), "navigation")
    if not names:
        return out
    on_subject = t.has_subject(low, words)
    of_link, of_seed = _segments(p), _segments(start)
    first, own = F.lower(F.coalesce(F.get(of_link, F.lit(0)), F.lit(""))), F.lower(F.coalesce(F.get(of_seed, F.lit(0)), F.lit("")))
    asked = F.regexp_extract_all(F.lower(seed), F.lit("[?&]q=([^&]+)"), F.lit(1))
    is_search = own.isin(*v.SEARCH_SEGMENTS)
    is_profile = (F.size(of_seed) == 1) & (u.any_of(own, names) | is_search & F.exists(asked, lambda q: u.any_of(q, names)))
    other = host & (F.size(of_link) > 0) & (first != own) & ~u.any_of(first, names) & ((F.size(of_link) == 1) | ~is_search)
    told = F.lit(False) if anchor is None else t.has_subject(F.lower(F.coalesce(anchor, F.lit(""))), words)
    return (
        out.when(first.isin(*v.UTILITY_SEGMENTS) & ~on_subject, "utility")
        .when(u.any_of(p, v.LISTING_PARTS) & ~on_subject, "other_listing")
        .when(start.isin(*v.ROOT_PATHS) & ~F.contains(seed, F.lit("?")) & ~on_subject, "root_seed")
        .when(is_profile & other, "other_profile")
        .when(host & ~on_subject & ~told & t.has_subject(F.lower(start), words), "sibling")
    )


def follows_index(link: Column, seed: Column, keyword: str = "", aliases=(), anchor: Column | None = None) -> Column:
    """Links that an index page leads on to: pages about the subject, and further pages below the seed."""
    below = link.startswith(F.concat(F.rtrim(seed, F.lit("/")), F.lit("/")))
    return detail_reason(link, seed, keyword, aliases, anchor).isNull() | (u.is_pagination(link) & below)


def without_blocked(hosts: Column, blocked) -> Column:
    """The hosts of an array that hold none of the blocked substrings."""
    return F.filter(hosts, lambda h: ~u.any_of(h, blocked)) if blocked else hosts


def matches_pattern(links: DataFrame, patterns: dict[str, str], link: str = "url", host: str = "host") -> DataFrame:
    """The links whose path holds their host's pattern; hosts without one, or with a broken one, let all pass."""
    good = []
    for name, pattern in patterns.items():
        try:
            re.compile(pattern)
        except re.error:
            continue
        if pattern:
            good.append((name, pattern))
    rules = links.sparkSession.createDataFrame(good, "__host string, __pattern string")
    path = u.path(F.col(link))
    rows = links.join(rules, F.col(host) == F.col("__host"), "left").withColumn("__path", F.when(path == "", "/").otherwise(path))
    return rows.where("__pattern is null or regexp_like(__path, __pattern)").select(*links.columns)
