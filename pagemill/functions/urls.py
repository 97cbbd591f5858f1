"""URL functions on columns: built-in expressions only, so they stay inside generated code and reach the scan."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import vocab as v

SCHEME = r"[a-zA-Z][a-zA-Z0-9+.-]*"


def any_of(text: Column, words) -> Column:
    """Whether text contains one of the words (as they are)."""
    return text.rlike("|".join(re.escape(w) for w in words))


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, f"^({SCHEME}):", 1))


def host(u: Column) -> Column:
    """Lower-case authority, port kept; empty if there is none."""
    return F.lower(F.regexp_extract(u, f"^{SCHEME}://([^/?#]*)", 1))


def bare_host(u: Column) -> Column:
    return F.regexp_replace(host(u), ":.*$", "")


def path(u: Column) -> Column:
    return F.regexp_extract(u, f"^(?:{SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def lower_path(u: Column) -> Column:
    return F.rtrim(F.lower(path(u)), F.lit("/"))


def unquoted(text: Column) -> Column:
    """Percent-decoding that leaves plus signs alone, and the text as it is where it cannot be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def canonical(u: Column) -> Column:
    """Without fragment and tracking parameters; other parameters keep their order. Host case and slashes stay."""
    names = "|".join(v.TRACKING_PARAMETERS)
    kept = F.filter(F.split(query(u), "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({names})(=|$)"))
    base = F.regexp_extract(F.trim(u), r"^([^?#]*)", 1)
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def media_key(u: Column) -> Column:
    """One key for all variants of a media file: https, lower case, no query, no trailing slash."""
    return F.concat(F.lit("https://"), host(F.trim(u)), F.rtrim(F.lower(unquoted(path(F.trim(u)))), F.lit("/")))


def url_hash(u: Column) -> Column:
    return F.sha2(F.regexp_replace(u, "#.*$", ""), 256)


def is_http(u: Column) -> Column:
    return scheme(u).isin("http", "https")


def is_image(u: Column) -> Column:
    p = lower_path(u)
    return p.rlike(rf"\.({'|'.join(v.IMAGE_EXTENSIONS)})$") & ~p.rlike(r"page\s+\d+\s*:") & ~p.rlike(r" [^/]*$")


def is_video(u: Column) -> Column:
    return lower_path(u).rlike(rf"\.({'|'.join(v.VIDEO_EXTENSIONS + v.STREAM_EXTENSIONS)})$")


def is_broken(u: Column) -> Column:
    return any_of(F.lower(u), v.BROKEN_MARKS)


def is_media(u: Column) -> Column:
    return ~is_broken(u) & (is_image(u) | is_video(u))


def is_stream_manifest(u: Column) -> Column:
    return F.lower(u).rlike(r"\.(m3u8|mpd)($|\?)")


def video_type(u: Column) -> Column:
    p = F.lower(u)
    return (
        F.when(p.rlike(r"youtube(-nocookie)?\.com|youtu\.be"), "youtube")
        .when(p.rlike(r"vimeo\.com"), "vimeo")
        .when(p.rlike(r"\.m3u8"), "hls")
        .when(p.rlike(r"\.mpd"), "dash")
        .when(is_video(u), "direct")
    )


def video_lines(u: Column) -> Column:
    """Vertical resolution that a URL names (720p); 0 if none."""
    return F.coalesce(F.regexp_extract(u, r"[_\-/](\d{3,4})p", 1).try_cast("int"), F.lit(0))


def has_small_parameter(u: Column, least: int = v.MIN_WIDTH) -> Column:
    values = F.regexp_extract_all(u, F.lit(r"(?i)(?:^|[?&])(?:width|height|w|h)=(\d+)"), F.lit(1))
    return F.exists(values, lambda x: F.coalesce(x.try_cast("bigint") < least, F.lit(False)))


_SIZES = (
    (r"[-_/](\d+)x(\d+)\b", 1, 2),
    (r"/(?:resize|fit|crop)/(\d+)/(\d+)", 1, 2),
    (r"/(?:w|width)_?(\d+)[,/](?:h|height)_?(\d+)", 1, 2),
    (r"[-_](\d+)x\.[a-z0-9]{3,4}$", 1, None),
    (r"[-_]x(\d+)\.[a-z0-9]{3,4}$", None, 1),
)


def has_small_path(u: Column, width: int = v.MIN_WIDTH, height: int = v.MIN_HEIGHT) -> Column:
    """Whether the path names dimensions below the given ones, in one of five usual forms."""
    p, found = F.lower(path(u)), F.lit(False)
    for pattern, w, h in _SIZES:
        for group, least in ((w, width), (h, height)):
            if group:
                found = found | F.coalesce(F.regexp_extract(p, pattern, group).try_cast("bigint") < least, F.lit(False))
    return found


def is_thumbnail(u: Column) -> Column:
    p = lower_path(u)
    named = p.rlike(r"\.pic\d+\.jpe?g|-\d+x\d+\.(?:jpe?g|png|gif|webp|avif)$|/loading\.gif$|/thumbs?[_/]|_(?:poster|thumb|preview|small)\.")
    return named | has_small_path(u, 300, 300) | any_of(p, v.PREVIEW_MARKERS)


def high_resolution(u: Column) -> Column:
    """The URL that usually serves the original of a scaled picture; the same URL if no rule applies."""
    p = F.regexp_replace(path(u), r"(?i)(?:-\d{2,4}x\d{2,4}|-scaled)(\.[a-z0-9]{3,4})$", "$1")
    p = F.regexp_replace(p, r"(?i)[._-]thumb(?:nail)?s?(\.[a-z0-9]{3,4})$", "$1")
    p = F.regexp_replace(F.regexp_replace(p, "(?i)/(?:thumbs|previews?|thumbnails)/", "/images/"), "(?i)/video_thumbs/", "/video_sources/")
    q = query(u)
    q = F.when(F.contains(q, F.lit("name=small")), F.replace(q, F.lit("name=small"), F.lit("name=large"))).otherwise(F.replace(q, F.lit("name=medium"), F.lit("name=large")))
    new = F.concat(F.regexp_extract(u, f"^((?:{SCHEME}:)?(?://[^/?#]*)?)", 1), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")), F.regexp_extract(u, "(#.*)$", 1))
    return F.when((p != path(u)) | (q != query(u)), new).otherwise(u)


def without_size_suffix(u: Column) -> Column:
    return F.regexp_replace(u, r"(?i)[_-](?:thumb|small|thumbnail|preview|mini)(\.[a-z0-9]{3,4})(?=$|\?)", "$1")


def host_suffixes(h: Column) -> Column:
    """A host and its parent domains, for equi-joins with host rules."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def in_hosts(h: Column, hosts) -> Column:
    """Whether a host is one of the given ones or lies below one."""
    names = [x.strip().lower() for x in hosts if x.strip()]
    return h.rlike(rf"(^|\.)({'|'.join(re.escape(x) for x in names)})$") if names else F.lit(False)


def is_allowed_host(h: Column, allow=(), block=()) -> Column:
    closed = in_hosts(h, (*v.BLOCKED_HOSTS, *v.LOGIN_WALL_HOSTS, *block))
    return ~closed & in_hosts(h, allow) if allow else ~closed


def is_search(u: Column) -> Column:
    return any_of(F.lower(path(u)), v.SEARCH_PATHS) | any_of(F.lower(query(u)), v.SEARCH_QUERIES)


def is_pagination(u: Column) -> Column:
    return any_of(F.lower(query(u)), v.PAGE_QUERIES) | F.lower(path(u)).rlike(r"/page/\d+|/p/\d+")


def is_archive(u: Column, title: Column) -> Column:
    """Index and listing pages; a listing path with a page of its own below it is none."""
    p = F.lower(path(u))
    bare = F.trim(p, F.lit("/"))
    listed, deep = any_of(p, v.ARCHIVE_PATHS), F.lit(False)
    for part in v.ARCHIVE_PATHS:
        after = F.filter(F.array(F.trim(F.substr(p, F.instr(p, part) + len(part)), F.lit("/"))), lambda _: F.contains(p, F.lit(part)))
        below = F.split(F.get(after, F.lit(0)), "/")
        deep = deep | F.coalesce((F.size(below) >= 2) & ~F.get(below, F.lit(1)).isin(*v.SHALLOW_PARTS), F.lit(False))
    rest = any_of(F.lower(query(u)), v.ARCHIVE_QUERIES) | any_of(F.lower(F.coalesce(title, F.lit(""))), v.ARCHIVE_TITLES)
    return F.when((bare == "") | bare.isin(*v.INDEX_NAMES), F.lit(True)).when(listed, ~deep).otherwise(rest)


def is_detail(u: Column) -> Column:
    parts = F.filter(F.split(F.lower(path(u)), "/"), lambda x: x != "")
    dotted = F.contains(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")), F.lit("."))
    return ~is_search(u) & ~is_pagination(u) & ((F.size(parts) >= 2) | dotted)


def is_allowed_path(u: Column) -> Column:
    p = F.lower(path(u))
    closed = p.rlike("(" + "|".join(re.escape(x) for x in v.CLOSED_SUFFIXES) + ")$") | any_of(p, v.CLOSED_PATHS)
    return ~closed & ~F.contains(F.lower(query(u)), F.lit("feed="))


def link_priority(u: Column) -> Column:
    """Sort key of links: hinted paths, then shorter, then by name."""
    return F.struct(F.when(any_of(F.lower(u), v.LINK_HINTS), 0).otherwise(1).alias("rank"), F.length(u).alias("length"), F.lower(u).alias("name"))


def background_image(style: Column) -> Column:
    found = F.regexp_extract(style, r"""(?i)background(?:-image)?\s*:\s*[^;]*?url\((['"]?)(.*?)\1\)""", 2)
    return F.when(found != "", found)


def unwrapped(u: Column) -> Column:
    """The target of a search engine's redirect link; the link itself if it is none."""
    target = F.regexp_extract(u, r"[?&](?:uddg|url)=([^&#]*)", 1)
    coded = F.regexp_extract(u, r"[?&]u=a1([A-Za-z0-9_\-]+)", 1)
    padded = F.rpad(F.translate(coded, "-_", "+/"), F.length(coded) + (4 - F.length(coded) % 4) % 4, F.lit("="))
    plain = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(target != "", unquoted(target)).when(coded != "", F.coalesce(plain, u)).otherwise(u)


def slug(text: Column, default: str = "query") -> Column:
    s = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", default).otherwise(s)


def without_wildcard(h: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(h)), r"^\*\.", "")


def paginated(base: Column, n: Column) -> Column:
    return F.when(F.contains(base, F.lit("{page}")), F.replace(base, F.lit("{page}"), n)).when(base.endswith("/"), F.concat(base, n)).otherwise(F.concat(base, F.lit("?page="), n))


def joined(*parts: Column) -> Column:
    """The parts that are there, with a space between them."""
    return F.concat_ws(" ", *parts)


def absolute(base: Column, link: Column) -> Column:
    """The link resolved against its page; an empty or null one is the page. Odd links (relative, with dots) need Python."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([b if not x else urljoin(b or "", x) for b, x in zip(bases, links, strict=True)])

    return run(base, link)


def _java(replacement: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))


def rewritten(u: Column, rules) -> Column:
    """Rewrite rules as data: (pattern, replacement) pairs applied in order, without regard to case."""
    for pattern, replacement in rules:
        u = F.regexp_replace(u, f"(?i){pattern}", _java(replacement))
    return u


def high_resolution_by(u: Column, groups) -> Column:
    """high_resolution after the rules of the first host groups: (substrings of the host, (pattern, replacement) pairs)."""
    p, h = path(u), host(u)
    for hosts, rules in groups:
        p = F.when(any_of(h, hosts), rewritten(p, rules)).otherwise(p)
    return high_resolution(F.concat(F.regexp_extract(u, f"^((?:{SCHEME}:)?(?://[^/?#]*)?)", 1), p, F.regexp_extract(u, r"([?#].*)$", 1)))


def _normalized(u: str) -> str:
    try:
        parts = urlparse(unquote(u))
        kept = [(k, x) for k, x in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in v.TRACKING_PARAMETERS]
        return urlunparse(parts._replace(path=quote(parts.path, safe="/"), query=quote(urlencode(kept), safe="=&%"), fragment=""))
    except ValueError:
        return u


def normalized(u: Column, rules=()) -> Column:
    """Canonical form: rewrite rules, all percent-codes decoded, no fragment and no tracking parameters, encoded anew."""

    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(_normalized, na_action="ignore")

    return run(rewritten(F.trim(u), rules))


def site_candidates(sites: DataFrame, subject: str, site: str = "site") -> DataFrame:
    """site, position, url: the usual shapes of a site's pages about a subject; repeated sites once, empty ones none."""
    name = F.trim(F.col(site))
    base = F.rtrim(F.when(name.rlike("^https?://"), name).otherwise(F.concat(F.lit("https://"), name)), F.lit("/"))
    shapes = [F.replace(F.lit(x.replace("{subject}", quote(subject, safe=""))), F.lit("{base}"), base) for x in v.SITE_TEMPLATES]
    rows = sites.where(F.coalesce(name, F.lit("")) != "").select(base.alias(site), F.posexplode(F.array(*shapes)).alias("position", "url"))
    return rows.distinct()
