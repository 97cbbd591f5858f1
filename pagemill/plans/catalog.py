"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pagemill.functions import text as t, urls as u, vocab as v
from pagemill.operators import extract, frontier, images, media
from . import derived as d
from .derived import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORDS = t.subject_tokens("subject")
CDN = tuple(r[4] for r in d.PROFILES if r[4]) + tuple(r[0] for r in d.PROFILES)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the SQL side: expressions of the same rules in the other engine

def s_host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"


def s_path(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def s_query(x: str) -> str:
    return f"regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1)"


def s_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def s_low_path(x: str) -> str:
    return f"rtrim(lower({s_path(x)}), '/')"


def s_media_key(x: str) -> str:
    return f"'https://' || {s_host(x)} || {s_low_path(x)}"


def s_image(x: str) -> str:
    p = s_low_path(x)
    return f"(regexp_matches({p}, '\\.({'|'.join(v.IMAGE_EXTENSIONS)})$') AND NOT regexp_matches({p}, 'page\\s+\\d+\\s*:') AND NOT regexp_matches({p}, ' [^/]*$'))"


def s_video(x: str) -> str:
    return f"regexp_matches({s_low_path(x)}, '\\.({'|'.join(v.VIDEO_EXTENSIONS + v.STREAM_EXTENSIONS)})$')"


def s_penalty(x: str) -> str:
    total = "(" + " + ".join(f"(CASE WHEN contains({x}, '{m}') THEN 6 ELSE 0 END)" for m in v.PREVIEW_MARKERS) + ")"
    return f"(CASE WHEN {total} > 0 AND {s_any(x, v.FULL_SIZE_WORDS)} THEN {total} - 6 ELSE {total} END)"


def s_small_path(x: str, w: int, h: int) -> str:
    p, out = f"lower({s_path(x)})", []
    for pattern, gw, gh in u._SIZES:
        for g, least in ((gw, w), (gh, h)):
            if g:
                out.append(f"coalesce(TRY_CAST(regexp_extract({p}, '{pattern}', {g}) AS BIGINT) < {least}, false)")
    return "(" + " OR ".join(out) + ")"


def s_small_parameter(x: str, least: int) -> str:
    return f"(len(list_filter(regexp_extract_all({x}, '(?i)(?:^|[?&])(?:width|height|w|h)=(\\d+)', 1), lambda y: TRY_CAST(y AS BIGINT) < {least})) > 0)"


def s_thumbnail(x: str) -> str:
    p = s_low_path(x)
    named = f"regexp_matches({p}, '\\.pic\\d+\\.jpe?g|-\\d+x\\d+\\.(?:jpe?g|png|gif|webp|avif)$|/loading\\.gif$|/thumbs?[_/]|_(?:poster|thumb|preview|small)\\.')"
    return f"({named} OR {s_small_path(x, 300, 300)} OR {s_any(p, v.PREVIEW_MARKERS)})"


def s_lines(x: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract({x}, '[_\\-/](\\d{{3,4}})p', 1) AS INTEGER), 0)"


def s_video_type(x: str) -> str:
    return f"(CASE WHEN regexp_matches(lower({x}), 'youtube(-nocookie)?\\.com|youtu\\.be') THEN 'youtube' WHEN regexp_matches(lower({x}), 'vimeo\\.com') THEN 'vimeo' WHEN regexp_matches(lower({x}), '\\.m3u8') THEN 'hls' WHEN regexp_matches(lower({x}), '\\.mpd') THEN 'dash' WHEN {s_video(x)} THEN 'direct' END)"


def s_archive(x: str, title: str) -> str:
    p = f"lower({s_path(x)})"
    deep = " OR ".join(
        f"(contains({p}, '{a}') AND len(string_split(trim(substr({p}, instr({p}, '{a}') + {len(a)}), '/'), '/')) >= 2 AND string_split(trim(substr({p}, instr({p}, '{a}') + {len(a)}), '/'), '/')[2] NOT IN ('page', 'p', 'sort', 'filter'))"
        for a in v.ARCHIVE_PATHS
    )
    names = ", ".join(f"'{n}'" for n in v.INDEX_NAMES)
    return f"(CASE WHEN trim({p}, '/') = '' OR trim({p}, '/') IN ({names}) THEN true WHEN {s_any(p, v.ARCHIVE_PATHS)} THEN NOT ({deep}) ELSE {s_any(f'lower({s_query(x)})', v.ARCHIVE_QUERIES)} OR {s_any(f'lower({title})', v.ARCHIVE_TITLES)} END)"


def s_in_hosts(h: str, hosts) -> str:
    return "regexp_matches(" + h + ", '(^|\\.)(" + "|".join(x.replace(".", "\\.") for x in hosts) + ")$')"


def s_highres(x: str) -> str:
    p = f"regexp_replace({s_path(x)}, '(?i)(?:-\\d{{2,4}}x\\d{{2,4}}|-scaled)(\\.[a-z0-9]{{3,4}})$', '\\1')"
    p = f"regexp_replace({p}, '(?i)[._-]thumb(?:nail)?s?(\\.[a-z0-9]{{3,4}})$', '\\1')"
    p = f"regexp_replace(regexp_replace({p}, '(?i)/(?:thumbs|previews?|thumbnails)/', '/images/', 'g'), '(?i)/video_thumbs/', '/video_sources/', 'g')"
    q = f"(CASE WHEN contains({s_query(x)}, 'name=small') THEN replace({s_query(x)}, 'name=small', 'name=large') ELSE replace({s_query(x)}, 'name=medium', 'name=large') END)"
    new = f"regexp_extract({x}, '^((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?)', 1) || {p} || (CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END) || regexp_extract({x}, '(#.*)$', 1)"
    return f"(CASE WHEN {p} <> {s_path(x)} OR {q} <> {s_query(x)} THEN {new} ELSE {x} END)"


def s_canonical(x: str) -> str:
    kept = f"list_filter(string_split({s_query(x)}, '&'), lambda y: y <> '' AND NOT regexp_matches(lower(y), '^({'|'.join(v.TRACKING_PARAMETERS)})(=|$)'))"
    return f"(regexp_extract(trim({x}), '^([^?#]*)', 1) || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


def points(test: str, n: int) -> str:
    return f"(CASE WHEN {test} THEN {n} ELSE 0 END)"


ITEMS = f"items AS ({d.MEDIA_ITEMS}), profiles AS ({d.profiles_sql()}), j AS (SELECT items.*, p.media_type AS expected, p.thumb_pattern AS pattern, o.thumb_pattern AS own_pattern FROM items LEFT JOIN profiles p ON {s_host('source_page')} = p.host LEFT JOIN profiles o ON {s_host('url')} = o.host)"
_ALL = "lower(url || ' ' || source_page || ' ' || alt_text || ' ' || page_title)"
_VALL = f"lower(url || ' ' || source_page || ' ' || coalesce({s_video_type('url')}, '') || ' ' || page_title)"


def s_off(*parts: str) -> str:
    own = "lower(" + " || ' ' || ".join(parts) + ")"
    return f"({s_archive('source_page', 'page_title')} AND NOT {s_in_hosts(s_host('url'), CDN)} AND NOT contains({own}, 'subject'))"


S_IMAGE_SCORE = " ".join((
    "CAST(", points(f"contains({_ALL}, 'subject')", 2), "+", points("alt_text <> ''", 1), "+", points("page_title <> ''", 1), "-", points(s_any(_ALL, v.GENERIC_TERMS), 3),
    "-", points(s_any(_ALL, v.PLACEHOLDER_TERMS), 4), "-", s_penalty(_ALL), "+", points(s_any(_ALL, v.IMAGE_WORDS), 1), "+", points(s_image("url"), 2),
    "-", points("regexp_matches(url, '(?i)(?:^|[?&])(width|height|w|h)=\\d{1,3}(?:$|&)')", 3), "-", points("width < 300", 20), "-", points("height < 300", 20),
    "-", points("in_layout", 20), "+", points("expected = 'image'", 3), "-", points(s_off("url", "alt_text"), 15), "AS INTEGER)",
))
S_VIDEO_SCORE = " ".join((
    "CAST(", points(f"contains({_VALL}, 'subject')", 2), "+", points("page_title <> ''", 1), "+", points(f"{s_video_type('url')} IS NOT NULL", 2), "+", points(s_any(_VALL, v.VIDEO_WORDS), 1),
    "+", points(s_video("url"), 2), "-", points("in_layout", 20), "-", s_penalty("lower(url)"), "-", points(s_penalty("lower(source_page || ' ' || page_title)") + " >= 4", 2),
    "+", points("expected = 'video'", 3), "-", points(s_off("url"), 15), "AS INTEGER)",
))
S_IMAGE_REASON = (
    f"CASE WHEN coalesce(regexp_matches(url, pattern), false) OR coalesce(regexp_matches(url, own_pattern), false) THEN 'preview_or_thumbnail' WHEN expected = 'video' THEN 'wrong_media_type_for_domain' WHEN in_layout THEN 'layout_decoration' "
    f"WHEN width < 300 OR height < 300 THEN 'low_resolution' WHEN {s_off('url', 'alt_text')} AND {s_highres('url')} = url THEN 'low_subject_relevance' WHEN {s_any(_ALL, v.UTILITY_TERMS)} THEN 'generic_asset' "
    f"WHEN {s_any(_ALL, v.PLACEHOLDER_TERMS)} THEN 'placeholder_asset' WHEN {s_penalty(_ALL)} >= 6 THEN 'preview_or_thumbnail' WHEN {s_small_parameter('url', 300)} OR {s_small_path('url', 300, 250)} THEN 'low_resolution_hint' "
    f"WHEN NOT contains({_ALL}, 'subject') THEN 'low_subject_relevance' WHEN {S_IMAGE_SCORE} < 1 THEN 'low_score' END"
)
S_VIDEO_REASON = (
    f"CASE WHEN expected = 'image' THEN 'wrong_media_type_for_domain' WHEN in_layout THEN 'layout_decoration' WHEN {s_off('url')} THEN 'low_subject_relevance' WHEN {s_any(_VALL, v.PLACEHOLDER_TERMS)} THEN 'placeholder_asset' "
    f"WHEN {s_penalty('lower(url)')} >= 6 THEN 'preview_or_thumbnail' WHEN NOT contains({_VALL}, 'subject') THEN 'low_subject_relevance' WHEN {S_VIDEO_SCORE} < 1 THEN 'low_score' END"
)
SCORED = f"{ITEMS}, scored AS (SELECT seq, kind, url, source_page, width, height, CASE WHEN kind = 'image' THEN {S_IMAGE_SCORE} ELSE {S_VIDEO_SCORE} END AS score, CASE WHEN kind = 'image' THEN {S_IMAGE_REASON} ELSE {S_VIDEO_REASON} END AS reason FROM j)"


def _joined(spark, sf_dir):
    return media.with_profiles(d.media_items(spark, sf_dir), d.profiles(spark))


def _scored(spark, sf_dir):
    """Every media item with score and reason (null: kept)."""
    return media.judged(_joined(spark, sf_dir), WORDS, CDN).select("seq", "kind", "url", "source_page", "width", "height", "score", "reason")


# ---- URLs of pages

def U():  # noqa: N802 - made when a session is there
    return F.col("url")


@query(f"SELECT page_id, {s_host('url')} AS host, {s_path('url')} AS path, regexp_matches(url, '^(?i)https?:') AS is_http FROM pages")
def url_host_path(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", u.host(U()).alias("host"), u.path(U()).alias("path"), u.is_http(U()).alias("is_http"))


@query(f"SELECT page_id, {s_media_key('url')} AS media_key FROM pages")
def url_media_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", u.media_key(U()).alias("media_key"))


@query(f"SELECT page_id, {s_canonical('url')} AS canonical FROM pages")
def url_canonical(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", u.canonical(U()).alias("canonical"))


@query("SELECT page_id, sha256(regexp_replace(url, '#.*$', '')) AS url_hash FROM pages")
def url_hash(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", u.url_hash(U()).alias("url_hash"))


_S_SEARCH = f"({s_any(f'lower({s_path('url')})', v.SEARCH_PATHS)} OR {s_any(f'lower({s_query('url')})', v.SEARCH_QUERIES)})"
_S_PAGED = f"({s_any(f'lower({s_query('url')})', v.PAGE_QUERIES)} OR regexp_matches(lower({s_path('url')}), '/page/\\d+|/p/\\d+'))"
_S_OPEN = f"(NOT (regexp_matches(lower({s_path('url')}), '\\.(json|xml|css|js)$') OR {s_any(f'lower({s_path('url')})', v.CLOSED_PATHS)}) AND NOT contains(lower({s_query('url')}), 'feed='))"
_S_PARTS = f"list_filter(string_split(lower({s_path('url')}), '/'), lambda y: y <> '')"


@query(f"""SELECT page_id, {_S_SEARCH} AS is_search, {s_archive('url', "''")} AS is_archive, {_S_PAGED} AS is_pagination,
  NOT {_S_SEARCH} AND NOT {_S_PAGED} AND (len({_S_PARTS}) >= 2 OR contains(coalesce({_S_PARTS}[-1], ''), '.')) AS is_detail, {_S_OPEN} AS is_allowed FROM pages""")
def url_flags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", u.is_search(U()).alias("is_search"), u.is_archive(U(), F.lit("")).alias("is_archive"), u.is_pagination(U()).alias("is_pagination"), u.is_detail(U()).alias("is_detail"), u.is_allowed_path(U()).alias("is_allowed"))


@query(f"SELECT page_id, canonical FROM (SELECT page_id, {s_canonical('url')} AS canonical, row_number() OVER (PARTITION BY {s_canonical('url')} ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def canonical_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", u.canonical(U()).alias("canonical"))
    return media.first_per_key(rows, "canonical", "page_id")


@query(f"SELECT {s_host('url')} AS host, count(*) AS pages FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def host_page_counts(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(u.host(U()).alias("host")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "host").limit(20)


_BLOCK = ("example.org", "ads.example.com")


@query(f"SELECT page_id, {s_host('url')} AS host FROM pages WHERE {s_in_hosts(s_host('url'), ('example.com', 'example.org', 'example.net'))} AND NOT {s_in_hosts(s_host('url'), (*v.BLOCKED_HOSTS, *v.LOGIN_WALL_HOSTS, *_BLOCK))}")
def allow_block_hosts(spark, sf_dir):
    """Host rules as a table: hosts are spread into their suffixes, so that the semi and the anti join are on equality."""
    pages = read(spark, sf_dir, "pages").select("page_id", u.host(U()).alias("host"))
    block = spark.createDataFrame([(h,) for h in (*v.BLOCKED_HOSTS, *v.LOGIN_WALL_HOSTS, *_BLOCK)], "suffix string")
    allow = spark.createDataFrame([(h,) for h in ("example.com", "example.org", "example.net")], "suffix string")
    hosts = pages.select("host").distinct().select("host", F.explode(u.host_suffixes(F.col("host"))).alias("suffix"))
    good = hosts.join(allow, "suffix", "left_semi").select("host").distinct().join(hosts.join(block, "suffix", "left_semi"), "host", "left_anti")
    return pages.join(good, "host", "left_semi").select("page_id", "host")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", t.clean(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


_S_LINKS = "SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1)) AS href FROM pages"


@query(f"WITH l AS ({_S_LINKS}) SELECT page_id, href, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href AS target FROM l WHERE starts_with(href, '/')")
def page_links_all(spark, sf_dir):
    return frontier.page_links(read(spark, sf_dir, "pages"))


@query(f"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href AS url FROM ({_S_LINKS}) WHERE starts_with(href, '/'))
SELECT page_id, url AS target, CASE WHEN {s_in_hosts(s_host('url'), (*v.BLOCKED_HOSTS, *v.LOGIN_WALL_HOSTS, 'example.org'))} THEN 'domain_policy' WHEN NOT {_S_OPEN} THEN 'structural_path'
 WHEN NOT {s_in_hosts(s_host('url'), ('example.com',))} THEN 'strict_domain' WHEN NOT starts_with({s_path('url')}, '/e') THEN 'site_tree' END AS reason FROM l""")
def link_scope_reasons(spark, sf_dir):
    links = frontier.page_links(read(spark, sf_dir, "pages"))
    return links.select("page_id", "target", frontier.scope_reason(F.col("target"), block=("example.org",), seed_hosts=("example.com",), trees=("/e",)).alias("reason"))


@query(f"""WITH l AS (SELECT DISTINCT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href AS target FROM ({_S_LINKS}) WHERE starts_with(href, '/'))
SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN {s_any('lower(target)', v.LINK_HINTS)} THEN 0 ELSE 1 END, length(target), lower(target) COLLATE C, target COLLATE C) AS rank FROM l""".replace(" COLLATE C", ""))
def link_priority_rank(spark, sf_dir):
    links = frontier.page_links(read(spark, sf_dir, "pages")).select("page_id", "target").distinct()
    w = W.partitionBy("page_id").orderBy(u.link_priority(F.col("target")), "target")
    return links.withColumn("rank", F.row_number().over(w).cast("long"))


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS src, (o_orderkey * 31 + 7) % 1500 AS dst FROM orders), b AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 3)
SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def frontier_bfs(spark, sf_dir):
    seeds = spark.createDataFrame([(0,)], "node long")
    return frontier.breadth_first(d.link_edges(spark, sf_dir), seeds, max_depth=3)


# ---- media items


@query(f"WITH {ITEMS} SELECT seq, {s_image('url')} AS is_image, {s_video('url')} AS is_video, {s_any('lower(url)', v.BROKEN_MARKS)} AS is_broken, {s_video_type('url')} AS video_type FROM items")
def media_type(spark, sf_dir):
    return d.media_items(spark, sf_dir).select("seq", u.is_image(U()).alias("is_image"), u.is_video(U()).alias("is_video"), u.is_broken(U()).alias("is_broken"), u.video_type(U()).alias("video_type"))


@query(f"WITH {ITEMS} SELECT seq, {s_thumbnail('url')} AS is_thumbnail, {s_small_parameter('url', 400)} AS small_parameter, {s_small_path('url', 400, 300)} AS small_path FROM items")
def low_res_hints(spark, sf_dir):
    return d.media_items(spark, sf_dir).select("seq", u.is_thumbnail(U()).alias("is_thumbnail"), u.has_small_parameter(U()).alias("small_parameter"), u.has_small_path(U()).alias("small_path"))


@query(f"WITH {ITEMS} SELECT seq, {s_highres('url')} AS high_url, regexp_replace(url, '(?i)[_-](?:thumb|small|thumbnail|preview|mini)(\\.[a-z0-9]{{3,4}})($|\\?)', '\\1\\2', 'g') AS plain_url FROM items")
def highres_rewrite(spark, sf_dir):
    return d.media_items(spark, sf_dir).select("seq", u.high_resolution(U()).alias("high_url"), u.without_size_suffix(U()).alias("plain_url"))


@query(f"WITH {ITEMS} SELECT seq, {s_lines('url')} AS lines FROM items WHERE kind = 'video'")
def video_resolution(spark, sf_dir):
    return d.media_items(spark, sf_dir).where("kind = 'video'").select("seq", u.video_lines(U()).alias("lines"))


@query(f"WITH {ITEMS} SELECT seq, {S_IMAGE_SCORE} AS score FROM j WHERE kind = 'image'")
def image_score(spark, sf_dir):
    return _scored(spark, sf_dir).where("kind = 'image'").select("seq", "score")


@query(f"WITH {ITEMS} SELECT seq, {S_VIDEO_SCORE} AS score FROM j WHERE kind = 'video'")
def video_score(spark, sf_dir):
    return _scored(spark, sf_dir).where("kind = 'video'").select("seq", "score")


@query(f"WITH {ITEMS} SELECT seq, {S_IMAGE_REASON} AS reason FROM j WHERE kind = 'image'")
def image_reason(spark, sf_dir):
    return _scored(spark, sf_dir).where("kind = 'image'").select("seq", "reason")


@query(f"WITH {ITEMS} SELECT seq, {S_VIDEO_REASON} AS reason FROM j WHERE kind = 'video'")
def video_reason(spark, sf_dir):
    return _scored(spark, sf_dir).where("kind = 'video'").select("seq", "reason")


@query(f"WITH {ITEMS} SELECT seq, url FROM (SELECT seq, url, row_number() OVER (PARTITION BY {s_canonical('url')} ORDER BY seq) AS n FROM items) WHERE n = 1")
def media_dedup_first(spark, sf_dir):
    return media.first_per_key(d.media_items(spark, sf_dir).select("seq", "url"), u.canonical(U()))


@query(f"""WITH {ITEMS}, k AS (SELECT *, {s_media_key('url')} AS media_key, CASE WHEN kind = 'video' THEN {s_lines('url')} WHEN {s_thumbnail('url')} THEN 0 ELSE 1 END AS a, CASE WHEN {s_query('url')} <> '' THEN 1 ELSE 0 END AS b FROM items)
SELECT media_key, min(seq) AS seq, first(kind ORDER BY seq) AS kind, first(url ORDER BY a DESC, b DESC, seq) AS url, count(*) AS variants FROM k GROUP BY media_key""")
def media_dedup_upgrade(spark, sf_dir):
    return media.upgraded(d.media_items(spark, sf_dir))


@query(f"WITH {SCORED} SELECT seq, kind, score, rank FROM (SELECT seq, kind, score, row_number() OVER (PARTITION BY kind ORDER BY score DESC, seq) AS rank FROM scored WHERE reason IS NULL) WHERE rank <= 100")
def capped_ranked(spark, sf_dir):
    kept = _scored(spark, sf_dir).where("reason is null").withColumn("subject", F.lit(True))
    return media.ranked(kept, "score", "subject", "kind").where("rank <= 100").select("seq", "kind", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SCORED} SELECT {s_canonical('url')} AS canonical, reason, min(seq) AS seq, count(*) AS n FROM scored WHERE reason IS NOT NULL GROUP BY 1, 2")
def reject_dedup(spark, sf_dir):
    return _scored(spark, sf_dir).where("reason is not null").groupBy(u.canonical(U()).alias("canonical"), "reason").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))


@query(f"""WITH {ITEMS} SELECT seq, {s_host('source_page')} || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '_' || substr(trim(regexp_replace(lower(regexp_extract({s_path('url')}, '([^/]*)$', 1)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS stem
FROM (SELECT *, row_number() OVER (PARTITION BY {s_host('source_page')} ORDER BY seq) AS n FROM items)""")
def download_stems(spark, sf_dir):
    host = u.host(F.col("source_page"))
    n = F.row_number().over(W.partitionBy(host).orderBy("seq")).cast("string")
    name = F.substring(u.slug(F.regexp_extract(u.path(U()), "([^/]*)$", 1)), 1, 40)
    return d.media_items(spark, sf_dir).select("seq", F.concat(host, F.lit("_"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")), F.lit("_"), name).alias("stem"))


@query(f"""WITH {ITEMS} SELECT seq, CASE WHEN width * height / 8 < (CASE WHEN kind = 'video' THEN 16384 ELSE 10240 END) THEN 'too_small' WHEN kind = 'image' AND (width < 400 OR height < 300) THEN 'low_resolution' END AS reason FROM items""")
def bytes_gate(spark, sf_dir):
    size = F.col("width") * F.col("height") / 8
    return d.media_items(spark, sf_dir).select("seq", media.bytes_reason(F.col("width"), F.col("height"), size, F.col("kind")).alias("reason"))


# ---- summaries of a run

_STATS = f"""{SCORED}, reports AS ({d.PAGE_REPORTS}),
 i AS (SELECT {s_host('source_page')} AS host, count(*) FILTER (reason IS NULL AND kind = 'image') AS images_kept, count(*) FILTER (reason IS NULL AND kind = 'video') AS videos_kept, count(*) FILTER (reason IS NOT NULL) AS rejected FROM scored GROUP BY 1),
 p AS (SELECT host, count(*) AS pages, count(*) FILTER (images_found = 0 AND videos_found = 0) AS wasted, count(*) FILTER (status = 'skipped') AS skipped FROM reports GROUP BY 1)"""


def _stats(spark, sf_dir):
    host = u.host(F.col("source_page"))
    i = _scored(spark, sf_dir).groupBy(host.alias("host")).agg(F.expr("count_if(reason is null and kind = 'image')").alias("images_kept"), F.expr("count_if(reason is null and kind = 'video')").alias("videos_kept"), F.expr("count_if(reason is not null)").alias("rejected"))
    p = d.page_reports(spark, sf_dir).groupBy("host").agg(F.count("*").alias("pages"), F.expr("count_if(images_found = 0 and videos_found = 0)").alias("wasted"), F.expr("count_if(status = 'skipped')").alias("skipped"))
    names = ("images_kept", "videos_kept", "rejected", "pages", "wasted", "skipped")
    return i.join(p, "host", "full_outer").select("host", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


@query(f"WITH {_STATS} SELECT host, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("images_kept", "videos_kept", "rejected", "pages", "wasted", "skipped")) + " FROM i FULL JOIN p USING (host)")
def run_summary_breakdown(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(f"WITH {SCORED} SELECT {s_host('source_page')} AS host, kind, coalesce(reason, 'kept') AS outcome, count(*) AS n FROM scored GROUP BY 1, 2, 3")
def host_domain_stats(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy(u.host(F.col("source_page")).alias("host"), "kind", F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT reason, count(*) AS n FROM scored WHERE reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_reasons(spark, sf_dir):
    return _scored(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@query(f"WITH {SCORED} SELECT {s_host('source_page')} AS host, count(*) AS kept FROM scored WHERE reason IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_domains(spark, sf_dir):
    return _scored(spark, sf_dir).where("reason is null").groupBy(u.host(F.col("source_page")).alias("host")).agg(F.count("*").alias("kept")).orderBy(F.desc("kept"), "host").limit(3)


@query(f"WITH r AS ({d.PAGE_REPORTS}) SELECT host, count(*) AS pages FROM r GROUP BY host HAVING sum(images_found + videos_found) = 0")
def zero_yield_hosts(spark, sf_dir):
    return d.page_reports(spark, sf_dir).groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.col("images_found") + F.col("videos_found")).alias("found")).where("found = 0").select("host", "pages")


@query(f"""WITH {SCORED}, a AS (SELECT coalesce({s_host('source_page')}, '') AS host, coalesce(reason, 'kept') AS outcome FROM scored)
SELECT host, outcome, count(*) AS n, CAST(grouping(host) + grouping(outcome) AS INTEGER) AS level FROM a GROUP BY ROLLUP (host, outcome)""")
def reason_rollup(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(u.host(F.col("source_page")).alias("host"), F.coalesce("reason", F.lit("kept")).alias("outcome"))
    return rows.rollup("host", "outcome").agg(F.count("*").alias("n"), (F.grouping("host") + F.grouping("outcome")).cast("int").alias("level"))


@query(f"""WITH r AS ({d.PAGE_REPORTS}), c AS (SELECT *, count(*) OVER w AS before, coalesce(CAST(sum(images_found + videos_found) OVER w AS BIGINT), 0) AS kept FROM r WINDOW w AS (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, host, bool_or((before >= 15 AND kept = 0) OR (before >= 20 AND kept * 20 < before)) OVER (PARTITION BY host ORDER BY seq) AS skipped FROM c""")
def low_yield_gate(spark, sf_dir):
    return frontier.low_yield(d.page_reports(spark, sf_dir)).select("seq", "host", "skipped")


@query(f"WITH r AS ({d.PAGE_REPORTS}), profiles AS ({d.profiles_sql()}) SELECT seq, r.host, coalesce(row_number() OVER (PARTITION BY r.host ORDER BY seq) > max_pages, false) AS capped FROM r LEFT JOIN profiles p ON r.host = p.host")
def max_pages_gate(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("host").orderBy("seq"))
    return d.page_reports(spark, sf_dir).join(d.profiles(spark).select("host", "max_pages"), "host", "left").select("seq", "host", F.coalesce(n > F.col("max_pages"), F.lit(False)).alias("capped"))


@query(f"WITH profiles AS ({d.profiles_sql()}) SELECT host, media_type, coalesce(crawl_depth, CASE WHEN crawl_strategy = 'direct' THEN 0 ELSE 1 END) AS depth, unnest(CASE WHEN cdn_host = '' THEN [host] ELSE [host, cdn_host] END) AS allowed FROM profiles")
def profile_hosts(spark, sf_dir):
    p = d.profiles(spark)
    depth = F.coalesce("crawl_depth", F.when(F.col("crawl_strategy") == "direct", 0).otherwise(1))
    hosts = F.array_distinct(F.filter(F.array("host", "cdn_host"), lambda x: x != ""))
    return p.select("host", "media_type", depth.alias("depth"), F.explode(hosts).alias("allowed"))


@query(f"WITH {ITEMS} SELECT seq, {s_in_hosts(s_host('url'), ('h1.example.com', 'cdn.h4.example.com'))} AS blocked FROM items")
def host_suffix_match(spark, sf_dir):
    return d.media_items(spark, sf_dir).select("seq", u.in_hosts(u.host(U()), ("h1.example.com", "cdn.h4.example.com")).alias("blocked"))


# ---- fetch telemetry


@query(f"WITH f AS ({d.FETCH_LOG}) SELECT host, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status <> 200) AS failed, round(avg(latency_ms), 1) AS mean_ms FROM f GROUP BY host")
def latency_rollup(spark, sf_dir):
    return d.fetch_log(spark, sf_dir).groupBy("host").agg(F.expr("count_if(status = 200)").alias("ok"), F.expr("count_if(status <> 200)").alias("failed"), F.round(F.avg("latency_ms"), 1).alias("mean_ms"))


@query(f"WITH f AS ({d.FETCH_LOG}), r AS (SELECT *, count(*) FILTER (status = 200) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM f) SELECT host, coalesce(g, 0) AS run, count(*) AS attempts FROM r GROUP BY 1, 2")
def retry_attempts(spark, sf_dir):
    w = W.partitionBy("host").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = d.fetch_log(spark, sf_dir).withColumn("run", F.coalesce(F.expr("count_if(status = 200)").over(w), F.lit(0)))
    return rows.groupBy("host", "run").agg(F.count("*").alias("attempts"))


@query(f"""WITH f AS ({d.FETCH_LOG}), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) - row_number() OVER (PARTITION BY host, status ORDER BY seq) AS g FROM f)
SELECT host, min(seq) AS first_seq, count(*) AS failures FROM r WHERE status = 429 GROUP BY host, g HAVING count(*) >= 2""")
def cooldown_runs(spark, sf_dir):
    by, each = W.partitionBy("host").orderBy("seq"), W.partitionBy("host", "status").orderBy("seq")
    rows = d.fetch_log(spark, sf_dir).withColumn("g", F.row_number().over(by) - F.row_number().over(each))
    return rows.where("status = 429").groupBy("host", "g").agg(F.min("seq").alias("first_seq"), F.count("*").alias("failures")).where("failures >= 2").select("host", "first_seq", "failures")


@query()
def cooldown_machine(spark, sf_dir):
    from pagemill.streaming import machines

    return machines.cooldowns(d.fetch_log(spark, sf_dir))


@query(f"""WITH f AS ({d.FETCH_LOG}) SELECT host, count(*) FILTER (status = 429) // 5 AS fires, least(10.0, 2.0 * power(2, least(count(*) FILTER (status = 429) // 5, 4))) AS delay_s, count(*) FILTER (status = 429) // 5 >= 5 AS quarantined FROM f GROUP BY host""")
def remediation_fires(spark, sf_dir):
    fires = F.floor(F.expr("count_if(status = 429)") / 5)
    rows = d.fetch_log(spark, sf_dir).groupBy("host").agg(fires.alias("fires"))
    return rows.select("host", "fires", F.least(F.lit(10.0), F.lit(2.0) * F.pow(F.lit(2.0), F.least("fires", F.lit(4)))).alias("delay_s"), (F.col("fires") >= 5).alias("quarantined"))


# ---- events


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def event_type_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_user(spark, sf_dir):
    best = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(best).select("user_id", "r.*")


@query("SELECT event_type, count(*) FILTER (ts >= m - INTERVAL 7 DAY) AS kept, count(*) FILTER (ts < m - INTERVAL 7 DAY) AS pruned FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1")
def ttl_prune(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("m"))
    old = F.col("ts") < F.col("m") - F.expr("INTERVAL 7 DAYS")
    return events.join(F.broadcast(last)).groupBy("event_type").agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("pruned"))


@query("""WITH c AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events), g AS (SELECT *, sum(y) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM c),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY event_id) - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS zeros FROM g) SELECT event_id, user_id, least(3600.0, 60.0 * power(2, least(zeros, 20))) AS delay_s FROM k""")
def zero_yield_backoff(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"))
    rows = rows.withColumn("grp", F.sum("y").over(W.partitionBy("user_id").orderBy("event_id")))
    zeros = F.row_number().over(W.partitionBy("user_id", "grp").orderBy("event_id")) - F.when(F.col("grp") > 0, 1).otherwise(0)
    return rows.select("event_id", "user_id", F.least(F.lit(3600.0), F.lit(60.0) * F.pow(F.lit(2.0), F.least(zeros, F.lit(20)))).alias("delay_s"))


@query("SELECT event_id, CASE WHEN value >= 95 OR user_id % 100 <= 5 THEN 0.25 WHEN value >= 85 OR user_id % 100 <= 15 THEN 0.5 ELSE 1.0 END::DOUBLE AS factor FROM events")
def load_factor(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", t.load_factor(F.col("value"), F.col("user_id") % 100).alias("factor"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts::TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL '15 minutes', ts::TIMESTAMP) - k * INTERVAL '15 minutes' AS start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1")
def sliding_windows(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""WITH l AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, ts::TIMESTAMP AS ts, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def pagination_page(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    page = events.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50)
    return page.join(F.broadcast(events.agg(F.count("*").alias("total"))))


@query("SELECT n_name AS name, 'https://' || lower(replace(n_name, ' ', '-')) || '.example.com/list?page=' || CAST(k AS VARCHAR) AS url FROM nation, (SELECT unnest(range(1, 6)) AS k)")
def paginated_urls(spark, sf_dir):
    base = F.concat(F.lit("https://"), F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("-"))), F.lit(".example.com/list"))
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"), base.alias("b")).select("name", u.paginated(F.col("b"), F.col("k").cast("string")).alias("url"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conversation_turns(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"), F.sum(F.length("text")).alias("chars"))
    return rows.select("conv_id", "turns", F.array_join("r.role", ">").alias("roles"), "chars")


# ---- documents

DOC_WORDS = ("the", "tion", "der", "les")
_S_DOC_SCORE = "CAST(" + " + ".join(points(f"contains(lower(text), '{w}')", 2) for w in DOC_WORDS) + " AS INTEGER)"


@query(f"SELECT doc_id, {_S_DOC_SCORE} AS score, {s_any('lower(text)', DOC_WORDS)} AS has_subject FROM documents")
def doc_subject_score(spark, sf_dir):
    low = F.lower("text")
    return read(spark, sf_dir, "documents").select("doc_id", t.subject_score(low, list(DOC_WORDS)).alias("score"), t.has_subject(low, list(DOC_WORDS)).alias("has_subject"))


@query(f"SELECT doc_id, CAST({s_penalty('lower(text)')} AS INTEGER) AS penalty FROM documents")
def doc_penalties(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.preview_penalty(F.lower("text")).alias("penalty"))


_S_DOC_REASON = f"CASE WHEN length(text) < 200 THEN 'too_short' WHEN {s_any('lower(text)', v.UTILITY_TERMS)} THEN 'generic_asset' WHEN {s_any('lower(text)', v.PLACEHOLDER_TERMS)} THEN 'placeholder_asset' WHEN {s_penalty('lower(text)')} >= 6 THEN 'preview_or_thumbnail' WHEN NOT {s_any('lower(text)', DOC_WORDS)} THEN 'low_subject_relevance' WHEN {_S_DOC_SCORE} < 4 THEN 'low_score' END"


def _doc_reason():
    low = F.lower("text")
    return (
        F.when(F.length("text") < 200, "too_short").when(u.any_of(low, v.UTILITY_TERMS), "generic_asset").when(u.any_of(low, v.PLACEHOLDER_TERMS), "placeholder_asset")
        .when(t.preview_penalty(low) >= 6, "preview_or_thumbnail").when(~t.has_subject(low, list(DOC_WORDS)), "low_subject_relevance").when(t.subject_score(low, list(DOC_WORDS)) < 4, "low_score")
    )


@query(f"SELECT doc_id, {_S_DOC_REASON} AS reason FROM documents")
def doc_reject_reason(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", _doc_reason().alias("reason"))


@query(f"SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_S_DOC_SCORE} DESC, doc_id) AS rank FROM documents WHERE {_S_DOC_REASON} IS NULL) WHERE rank <= 10")
def kept_ranked(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").where(_doc_reason().isNull()).select("doc_id", "source", t.subject_score(F.lower("text"), list(DOC_WORDS)).alias("score"), F.lit(True).alias("subject"))
    return media.ranked(rows, "score", "subject", "source", "doc_id").where("rank <= 10").select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT source, coalesce({_S_DOC_REASON}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1, 2")
def reason_by_source(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source", F.coalesce(_doc_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS labelled, count(*) FILTER (toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, docs, chars, coalesce(labelled, 0) AS labelled, coalesce(toxic, 0) AS toxic FROM a FULL JOIN b USING (source)""")
def source_breakdown(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    a = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    b = docs.join(read(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("labelled"), F.expr("count_if(toxic = 1)").alias("toxic"))
    return a.join(b, "source", "full_outer").select("source", "docs", "chars", F.coalesce("labelled", F.lit(0)).cast("long").alias("labelled"), F.coalesce("toxic", F.lit(0)).cast("long").alias("toxic"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY text")
def exact_content_dedup(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT d.doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def doc_label_join(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


_S_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(string_split(regexp_replace({_S_CLEAN}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') AS s FROM documents)")
def chunk_sentences(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "sentence"))


@query("SELECT doc_id, CAST(k // 450 AS INTEGER) AS pos, substr(text, k + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text)), 450)) AS k FROM documents)")
def chunk_windows(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.windows(F.col("text"), 500, 50)).alias("pos", "chunk"))


@query()
def chunk_rows(spark, sf_dir):
    """Chunks for retrieval: id from the source's checksum and position, with counts."""
    rows = read(spark, sf_dir, "documents").select("doc_id", t.chunks(F.col("text")).alias("c"), F.crc32(F.col("doc_id").cast("string")).alias("crc"))
    rows = rows.select("doc_id", "crc", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "text_chunk"))
    return rows.select(F.format_string("%08x_%d", "crc", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "total_chunks", "text_chunk", F.length("text_chunk").alias("chunk_size"))


@query("SELECT doc_id, array_to_string(list_filter(['trigger', lower(source), lang, 'corpus'], lambda y: y <> ''), ',') AS tags FROM (SELECT doc_id, CASE WHEN length(source) > 2 AND NOT regexp_matches(source, '^[0-9]+$') THEN source ELSE '' END AS source, CASE WHEN length(lang) > 2 THEN lang ELSE '' END AS lang FROM documents)")
def tag_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(t.tag_tokens("trigger", F.col("source"), F.col("lang"), F.lit("corpus")), ",").alias("tags"))


# ---- images, by the part and embeddings tables

_W, _H = "CAST(p_size * 50 AS INTEGER)", "CAST(floor(p_retailprice) AS INTEGER)"


def _sizes(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(_W).alias("w"), F.expr(_H).alias("h"), "p_retailprice")


@query(f"SELECT p_partkey, CASE WHEN w / h >= 1.3 THEN 'landscape' WHEN w / h <= 0.8 THEN 'portrait' ELSE 'square' END || CASE WHEN w >= 1920 OR h >= 1920 THEN ',highres' WHEN w <= 640 AND h <= 640 THEN ',lowres' ELSE '' END AS tags FROM (SELECT p_partkey, {_W} AS w, {_H} AS h FROM part)")
def shape_tags(spark, sf_dir):
    return _sizes(spark, sf_dir).select("p_partkey", F.array_join(t.shape_tags(F.col("w"), F.col("h")), ",").alias("tags"))


@query(f"""SELECT p_partkey, CAST(CASE WHEN abs(w / h - 1.0) < 0.01 OR w <= h THEN 0 ELSE floor((w - h) / 2) END AS INTEGER) AS l, CAST(CASE WHEN abs(w / h - 1.0) < 0.01 OR w > h THEN 0 ELSE floor((h - w) * 0.25) END AS INTEGER) AS t,
 CAST(CASE WHEN abs(w / h - 1.0) < 0.01 OR w <= h THEN w ELSE floor((w - h) / 2) + h END AS INTEGER) AS r, CAST(CASE WHEN abs(w / h - 1.0) < 0.01 OR w > h THEN h ELSE floor((h - w) * 0.25) + w END AS INTEGER) AS b FROM (SELECT p_partkey, {_W} AS w, {_H} AS h FROM part)""")
def crop_box(spark, sf_dir):
    return _sizes(spark, sf_dir).select("p_partkey", t.crop_box(F.col("w"), F.col("h"), 512, 512).alias("x")).select("p_partkey", F.col("x.left").alias("l"), F.col("x.top").alias("t"), F.col("x.right").alias("r"), F.col("x.bottom").alias("b"))


@query(f"SELECT p_partkey, greatest(1.0, least(10.0, round(least(3.0, w * h / 1e6 * 1.2 + 0.5) + least(3.5, (p_retailprice % 128) / 128 * 3.5) + least(3.5, (p_retailprice % 64) / 128 * 3.5), 1)))::DOUBLE AS score FROM (SELECT p_partkey, p_retailprice, {_W} AS w, {_H} AS h FROM part)")
def aesthetic_arith(spark, sf_dir):
    return _sizes(spark, sf_dir).select("p_partkey", t.aesthetic(F.col("w"), F.col("h"), F.col("p_retailprice") % 128, F.col("p_retailprice") % 64).alias("score"))


def _dhash(spark, sf_dir):
    e = F.col("embedding")
    bits = sum((F.when(F.get(e, F.lit(i)) > F.get(e, F.lit(i + 1)), 1 << i).otherwise(0).cast("long") for i in range(63)), F.lit(0).cast("long"))
    return read(spark, sf_dir, "embeddings").select("vec_id", bits.alias("dhash"))


_S_DHASH = "SELECT vec_id, " + " + ".join(f"(CASE WHEN embedding[{i + 1}] > embedding[{i + 2}] THEN {1 << i}::BIGINT ELSE 0 END)" for i in range(63)) + " AS dhash FROM embeddings"


@query(_S_DHASH)
def dhash_bits(spark, sf_dir):
    return _dhash(spark, sf_dir)


@query(f"WITH h AS ({_S_DHASH}) SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(bit_count(xor(a.dhash, b.dhash)) AS INTEGER) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.dhash, b.dhash)) <= 4")
def hamming_pairs(spark, sf_dir):
    return media.near_pairs(_dhash(spark, sf_dir), "vec_id", "dhash", 4)


@query()
def near_dup_greedy(spark, sf_dir):
    """Vectors kept by one pass in order: those near an earlier kept one go."""
    hashes = _dhash(spark, sf_dir)
    return images.greedy_unique(media.near_pairs(hashes, "vec_id", "dhash", 4), hashes, "vec_id")


@query()
def page_extract(spark, sf_dir):
    """Links, images and videos of every page by the parser; in these pages all anchors are navigation."""
    return extract.extract(read(spark, sf_dir, "pages")).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query()
def page_links_scoped(spark, sf_dir):
    return extract.page_edges(read(spark, sf_dir, "pages"))


@query(f"""WITH {SCORED}, p AS (SELECT page_id, {s_host('url')} AS host, {s_canonical('url')} AS canonical, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, {s_archive('url', "''")} AS listed, {_S_OPEN} AS open, html FROM pages),
 r AS (SELECT *, CASE WHEN NOT open THEN 'structural_path' WHEN listed THEN 'listing' WHEN NOT {s_any('lower(html)', DOC_WORDS)} THEN 'low_subject_relevance' WHEN length(html) < 1000 THEN 'low_score' END AS reason FROM p),
 f AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS n FROM r)
SELECT host, count(*) AS pages, count(*) FILTER (reason IS NULL AND n = 1) AS kept, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) FILTER (reason IS NULL AND n > 1) AS duplicates FROM f GROUP BY host""")
def page_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-host summary of pages: canonical URL, ordered rejection, first of each canonical URL."""
    low = F.lower("html")
    reason = F.when(~u.is_allowed_path(U()), "structural_path").when(u.is_archive(U(), F.lit("")), "listing").when(~t.has_subject(low, list(DOC_WORDS)), "low_subject_relevance").when(F.length("html") < 1000, "low_score")
    pages = read(spark, sf_dir, "pages").select("page_id", u.host(U()).alias("host"), u.canonical(U()).alias("canonical"), reason.alias("reason"))
    first = pages.groupBy("canonical").agg(F.min("page_id").alias("first_id"))
    rows = pages.join(first, "canonical")
    kept = F.col("reason").isNull()
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(kept & (F.col("page_id") == F.col("first_id"))).alias("kept"), F.count_if(~kept).alias("rejected"), F.count_if(kept & (F.col("page_id") != F.col("first_id"))).alias("duplicates"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more  # noqa: F401 - registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more  # noqa: F401

    return dict(SQL)
