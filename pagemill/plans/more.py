"""Registered queries on scope, normal forms, runs, telemetry and exports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import scope, text as t, urls as u, vocab as v
from pagemill.operators import runs as r, telemetry as tele
from . import derived as d
from .catalog import SCORED, _scored, query, s_any, s_highres, s_host, s_in_hosts, s_path, s_query
from .derived import read

# ---- scope of links

_TOKENS = ("somesubject", "alias name")


def _has(x: str) -> str:
    return s_any(x, t.subject_tokens("somesubject", _TOKENS))


def _names(x: str) -> str:
    return s_any(x, _TOKENS)


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_PARTS = f"""l AS ({d.SUBJECT_LINKS}), a AS (SELECT *, coalesce(nullif(rtrim({s_path('link')}, '/'), ''), '/') AS p, coalesce(nullif(rtrim({s_path('seed')}, '/'), ''), '/') AS s, {s_host('link')} = {s_host('seed')} AS same FROM l),
 b AS (SELECT *, lower(p) AS low, list_filter(string_split(p, '/'), lambda y: y <> '') AS lp, list_filter(string_split(s, '/'), lambda y: y <> '') AS sp FROM a),
 c AS (SELECT *, lower(coalesce(lp[1], '')) AS first, lower(coalesce(sp[1], '')) AS own FROM b),
 e AS (SELECT *, CASE WHEN p = s THEN 'same_page' WHEN {s_any('p', v.PAGE_PARTS)} OR regexp_matches(lower({s_query('link')}), '(?:^|&)(?:page|p|pg)=\\d') THEN 'pagination' WHEN p IN ({_list(v.NAVIGATION_PATHS)}) THEN 'navigation'
  WHEN first IN ({_list(v.UTILITY_SEGMENTS)}) AND NOT {_has('low')} THEN 'utility' WHEN {s_any('p', v.LISTING_PARTS)} AND NOT {_has('low')} THEN 'other_listing'
  WHEN s IN ({_list(v.ROOT_PATHS)}) AND NOT contains(seed, '?') AND NOT {_has('low')} THEN 'root_seed'
  WHEN len(sp) = 1 AND ({_names('own')} OR (own IN ({_list(v.SEARCH_SEGMENTS)}) AND len(list_filter(regexp_extract_all(lower(seed), '[?&]q=([^&]+)', 1), lambda y: {_names('y')})) > 0))
   AND same AND len(lp) > 0 AND first <> own AND NOT {_names('first')} AND (len(lp) = 1 OR own NOT IN ({_list(v.SEARCH_SEGMENTS)})) THEN 'other_profile'
  WHEN same AND NOT {_has('low')} AND NOT {_has('lower(anchor)')} AND {_has('lower(s)')} THEN 'sibling' END AS reason FROM c)"""


@query(f"WITH {_PARTS} SELECT seq, link, seed, reason FROM e")
def detail_scope(spark, sf_dir):
    rows = d.subject_links(spark, sf_dir)
    return rows.select("seq", "link", "seed", scope.detail_reason(F.col("link"), F.col("seed"), "somesubject", _TOKENS, F.col("anchor")).alias("reason"))


@query(f"WITH {_PARTS} SELECT seq, link FROM e WHERE reason IS NULL OR ((regexp_matches(lower({s_path('link')}), '/page/\\d+|/p/\\d+') OR {s_any(f'lower({s_query('link')})', v.PAGE_QUERIES)}) AND starts_with(link, rtrim(seed, '/') || '/'))")
def index_follow(spark, sf_dir):
    rows = d.subject_links(spark, sf_dir)
    return rows.where(scope.follows_index(F.col("link"), F.col("seed"), "somesubject", _TOKENS, F.col("anchor"))).select("seq", "link")


_PATTERNS = {"example.com": "/(post|somesubject)/", "other.com": "^/$|^/tag", "broken.com": "("}


@query(f"WITH l AS ({d.SUBJECT_LINKS}) SELECT seq, link FROM l WHERE CASE {s_host('link')} WHEN 'example.com' THEN regexp_matches({s_path('link')}, '/(post|somesubject)/') WHEN 'other.com' THEN regexp_matches(coalesce(nullif({s_path('link')}, ''), '/'), '^/$|^/tag') ELSE true END")
def link_patterns(spark, sf_dir):
    rows = d.subject_links(spark, sf_dir).select("seq", "link", u.host(F.col("link")).alias("host"))
    return scope.matches_pattern(rows, _PATTERNS, "link").select("seq", "link")


@query("SELECT c_custkey, list_filter(['h' || CAST(c_custkey % 7 AS VARCHAR) || '.example.com', 'cdn.ads.net', 'x' || c_mktsegment], lambda y: NOT (contains(y, 'ads') OR contains(y, 'h3.') OR contains(y, 'BUILD'))) AS hosts FROM customer")
def profile_block_hosts(spark, sf_dir):
    hosts = F.array(F.concat(F.lit("h"), (F.col("c_custkey") % 7).cast("string"), F.lit(".example.com")), F.lit("cdn.ads.net"), F.concat(F.lit("x"), "c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", scope.without_blocked(hosts, ("ads", "h3.", "BUILD")).alias("hosts"))


# ---- URL forms

_RULES = ((r"^http://", "https://"), (r"/(\d+)x(\d+)/", r"/\2x\1/"))
_RAW = """SELECT o_orderkey AS seq, '  HTTP://Ex.com/a%20b/' || CAST(o_custkey % 50 AS STRING) || 'x9/' || CASE o_orderkey % 5 WHEN 0 THEN 'caf%C3%A9' WHEN 1 THEN 'x+y' WHEN 2 THEN 'plain' WHEN 3 THEN 'q%26r' ELSE '' END || CASE o_orderkey % 4 WHEN 0 THEN '?utm_source=z&b=2%2B3&REF=k&c=' WHEN 1 THEN '?a=x y&flag' WHEN 2 THEN '?hl=en' ELSE '' END || CASE o_orderkey % 3 WHEN 0 THEN '#f' ELSE '' END AS url FROM orders"""
_S_PLAIN = "url_decode(regexp_replace(regexp_replace(trim(url), '(?i)^http://', 'https://', 'g'), '(?i)/(\\d+)x(\\d+)/', '/\\2x\\1/', 'g'))"
_S_KEPT = f"list_filter(string_split({s_query('x')}, '&'), lambda y: y <> '' AND lower(url_decode(replace(string_split(y, '=')[1], '+', ' '))) NOT IN ({_list(v.TRACKING_PARAMETERS)}))"
_S_CODED = "url_encode(url_decode(replace({0}, '+', ' ')))"
_S_PAIR = f"replace({_S_CODED.format('string_split(y, chr(61))[1]')} || '=' || {_S_CODED.format('coalesce(nullif(substr(y, length(string_split(y, chr(61))[1]) + 2), chr(0)), chr(0))')}, '%20', '%2B')"


@query(f"""WITH w AS (SELECT seq, {_S_PLAIN} AS x FROM ({_RAW}))
SELECT seq, regexp_extract(x, '^([a-zA-Z]+://[^/?#]*)', 1) || replace(url_encode({s_path('x')}), '%2F', '/') || CASE WHEN len({_S_KEPT}) > 0 THEN '?' || array_to_string(list_transform({_S_KEPT}, lambda y: {_S_PAIR}), '&') ELSE '' END AS url FROM w""")
def url_normalized(spark, sf_dir):
    rows = d._made(spark, sf_dir, "orders", _RAW)
    return rows.select("seq", u.normalized(F.col("url"), _RULES).alias("url"))


_GROUPS = ((("h1.", "h4."), ((r"/gallery/full", "/originals/p"),)), (("cdn.",), ((r"(\d+)\.png$", r"\1_o.png"),)))


@query(f"""WITH i AS ({d.MEDIA_ITEMS}), g AS (SELECT seq, {s_path('url')} AS p, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS b, regexp_extract(url, '([?#].*)$', 1) AS e FROM i),
 h AS (SELECT seq, b, e, CASE WHEN contains(b, 'h1.') OR contains(b, 'h4.') THEN regexp_replace(p, '(?i)/gallery/full', '/originals/p', 'g') ELSE p END AS p FROM g),
 k AS (SELECT seq, b || CASE WHEN contains(b, 'cdn.') THEN regexp_replace(p, '(?i)(\\d+)\\.png$', '\\1_o.png', 'g') ELSE p END || e AS url FROM h) SELECT seq, {s_highres('url')} AS url FROM k""")
def highres_groups(spark, sf_dir):
    return d.media_items(spark, sf_dir).select("seq", u.high_resolution_by(F.col("url"), _GROUPS).alias("url"))


@query("WITH h AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site FROM pages) SELECT site, CAST(k - 1 AS INTEGER) AS position, site || replace([" + ", ".join("'" + x.removeprefix("{base}") + "'" for x in v.SITE_TEMPLATES) + "][k], '{subject}', 'two%20words') AS url FROM h, range(1, " + str(len(v.SITE_TEMPLATES) + 1) + ") AS r(k)")
def site_candidates(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit(" "), F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.lit("/")).alias("site"), F.regexp_extract("url", "^(https?)://", 1).alias("scheme"))
    return u.site_candidates(pages.select(F.concat("scheme", F.lit("://"), F.trim("site")).alias("site")), "two words")


@query("SELECT p_partkey, concat_ws(' ', nullif(p_brand, 'Brand#11'), p_type, NULL) AS text FROM part")
def safe_join(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", u.joined(F.nullif("p_brand", F.lit("Brand#11")), F.col("p_type"), F.lit(None)).alias("text"))


# ---- runs


@query(f"WITH r AS ({d.RUNS}) SELECT count(DISTINCT run_id) AS runs, CAST(sum(images) AS BIGINT) AS images, CAST(sum(videos) AS BIGINT) AS videos, CAST(sum(pages) AS BIGINT) AS pages FROM r")
def run_totals(spark, sf_dir):
    return r.totals(d.runs(spark, sf_dir))


@query(f"WITH r AS ({d.RUNS}) SELECT subject, run_id, images, videos FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY run_id DESC) AS n FROM r) WHERE n = 1")
def latest_run(spark, sf_dir):
    return r.latest(d.runs(spark, sf_dir).select("subject", "run_id", "images", "videos"))


@query(f"WITH r AS ({d.RUNS}) SELECT run_id, CAST(images + videos AS BIGINT) AS harvest, images + videos >= 9 AS enough FROM r")
def run_harvest(spark, sf_dir):
    return r.harvest(d.runs(spark, sf_dir), 9)


@query(f"""WITH r AS ({d.RUNS}) SELECT run_id, CASE WHEN expected IS NULL THEN (images >= 4 AND videos >= 4) OR (pages >= 3 AND ((images >= 4 AND videos = 0) OR (videos >= 4 AND images = 0)))
 ELSE (expected = 'video' OR images >= 4) AND (expected = 'image' OR videos >= 4) END AS met FROM r""")
def target_met(spark, sf_dir):
    rows = d.runs(spark, sf_dir)
    return rows.select("run_id", r.target_met(F.col("images"), F.col("videos"), F.col("pages"), 4, F.col("expected")).alias("met"))


@query(f"WITH p AS ({d.PAGE_REPORTS}), g AS (SELECT host, CAST(sum(CASE WHEN seq % 60 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS kept, count(*) AS pages FROM p GROUP BY host) SELECT host, kept, pages, kept / pages AS ratio, pages > 20 AND kept / pages < 0.02 AS low FROM g")
def domain_yield(spark, sf_dir):
    rows = d.page_reports(spark, sf_dir).select("host", F.when(F.col("seq") % 60 == 0, 1).otherwise(0).alias("kept"), F.lit(1).alias("pages"))
    return r.domain_yield(rows)


@query(f"WITH p AS ({d.profiles_sql()}) SELECT list_sort(list(DISTINCT media_type)) AS types, 'mixed' AS expected FROM p")
def expected_types(spark, sf_dir):
    return r.expected_types(d.profiles(spark))


@query(f"WITH {SCORED} SELECT {s_host('source_page')} AS host, count(*) FILTER (contains(lower(reason), 'duplicate') OR contains(lower(reason), 'low_resolution')) AS duplicates FROM scored WHERE reason IS NOT NULL GROUP BY 1")
def duplicate_skips(spark, sf_dir):
    rows = _scored(spark, sf_dir).where("reason is not null").select(u.host(F.col("source_page")).alias("host"), F.replace("reason", F.lit("low_resolution"), F.lit("Duplicate_url")).alias("reason"))
    return r.duplicate_skips(rows)


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE l_orderkey % 6 WHEN 0 THEN 'download_failed: 500' WHEN 1 THEN 'download_error' WHEN 2 THEN 'an exception' WHEN 3 THEN 'was download_failed' WHEN 4 THEN 'skipped' END AS f FROM lineitem) WHERE starts_with(f, 'download_failed') OR starts_with(f, 'download_error') OR contains(f, 'exception')")
def dead_downloads(spark, sf_dir):
    why = F.expr("CASE l_orderkey % 6 WHEN 0 THEN 'download_failed: 500' WHEN 1 THEN 'download_error' WHEN 2 THEN 'an exception' WHEN 3 THEN 'was download_failed' WHEN 4 THEN 'skipped' END")
    return r.dead_downloads(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", why.alias("failure_reason"))).select("l_orderkey", "l_linenumber")


@query(f"WITH i AS ({d.MEDIA_ITEMS}), s AS (SELECT kind AS file, {s_host('url')} AS host FROM i) SELECT file, count(*) AS urls, count(DISTINCT host) AS hosts, list_sort(list(DISTINCT host)) AS names FROM s GROUP BY file")
def seed_stats(spark, sf_dir):
    return r.seed_stats(d.media_items(spark, sf_dir).select(F.col("kind").alias("file"), u.host(F.col("url")).alias("host")))


@query("SELECT count(*) AS total, count(*) FILTER (s >= 5) AS passed, count(*) FILTER (s < 5) AS rejected FROM (SELECT p_size / 5 AS s FROM part)")
def aesthetic_breakdown(spark, sf_dir):
    return r.aesthetic_breakdown(read(spark, sf_dir, "part").select((F.col("p_size") / 5).alias("score")), 5.0)


@query("SELECT p_brand AS folder, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY p_brand")
def folder_sizes(spark, sf_dir):
    return r.folder_size(read(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("length")), F.col("p_brand"))


_FILES = "SELECT p_partkey AS seq, 'out/' || p_brand || '/f' || CAST(p_partkey AS STRING) || '.jpg' AS path FROM part"


@query(f"WITH f AS ({_FILES}) SELECT seq, path, CASE WHEN seq % 3 = 0 THEN 'h.example.com' ELSE regexp_extract(path, '([^/]*)/[^/]*$', 1) END AS source_domain FROM f")
def exported_files(spark, sf_dir):
    files = d._made(spark, sf_dir, "part", _FILES)
    return r.exported(files, files.where("seq % 3 = 0").select(F.col("path").alias("file_path"), F.lit("h.example.com").alias("source_domain")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS tags FROM part")
def file_metadata(spark, sf_dir):
    files = read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("file_name"))
    known = read(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").cast("string").alias("file_name"), F.col("p_brand").alias("tags"))
    return r.with_metadata(files, known).select("p_partkey", "tags")


@query(f"WITH i AS ({d.MEDIA_ITEMS}) SELECT seq, CAST(regexp_extract(source_page, '([0-9]+)$', 1) AS INTEGER) < 50 AS is_seeded FROM i")
def seeded_pages(spark, sf_dir):
    seeds = spark.range(50).select(F.explode(F.array(*[F.concat(F.lit(f"https://h{k}.example.com/post/"), F.col("id").cast("string")) for k in range(7)])).alias("url"))
    return r.flagged_seeds(d.media_items(spark, sf_dir).select("seq", "source_page"), seeds).select("seq", "is_seeded")


@query("SELECT url, provider, rank FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY provider, rank) AS n FROM (SELECT 'u' || CAST(o_custkey AS VARCHAR) AS url, o_orderpriority AS provider, o_orderkey AS rank FROM orders)) WHERE n = 1 ORDER BY provider, rank LIMIT 200")
def search_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").alias("rank"))
    return r.first_results(rows, 200)


@query("SELECT url FROM (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS url FROM customer) EXCEPT SELECT 'u' || CAST(o_custkey AS VARCHAR) FROM orders")
def frontier_except(spark, sf_dir):
    have = read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"))
    return r.less(have, read(spark, sf_dir, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url")).distinct())


@query("SELECT url FROM (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS url FROM customer) INTERSECT SELECT 'u' || CAST(o_custkey AS VARCHAR) FROM orders")
def frontier_intersect(spark, sf_dir):
    have = read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"))
    return r.common(have, read(spark, sf_dir, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url")))


@query("SELECT 'u' || CAST(o_custkey AS VARCHAR) AS url, '404_negative_cache' AS reason FROM orders WHERE o_custkey % 10 = 0")
def dead_rejects(spark, sf_dir):
    name = lambda c: F.concat(F.lit("u"), F.col(c).cast("string")).alias("url")
    return r.dead_rejects(read(spark, sf_dir, "orders").select(name("o_custkey")), read(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(name("c_custkey")))


# ---- telemetry

_SEEN = f"""e AS ({d.HOST_EVENTS}), g AS (SELECT *, count(*) FILTER (outcome = 'ok') OVER (PARTITION BY host ORDER BY seq) AS run FROM e),
 k AS (SELECT *, count(*) FILTER (outcome = 'error') OVER (PARTITION BY host, run ORDER BY seq) AS n FROM g),
 m AS (SELECT *, outcome = 'login_wall' OR (outcome = 'error' AND n >= 3) AS fatal, CASE WHEN outcome = 'rate_limited' THEN ts + 5 WHEN outcome = 'error' AND n < 3 THEN ts + 2 END AS until FROM k),
 w AS (SELECT *, coalesce(bool_or(fatal) OVER p, false) AS failed, coalesce(last_value(until IGNORE NULLS) OVER p > ts, false) AS rest, coalesce(sum(found) OVER p, 0) AS so_far FROM m WINDOW p AS (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {_SEEN} SELECT seq, host, NOT failed AND NOT rest AS available, CASE WHEN so_far >= 5 THEN 6 ELSE 1 END AS allowed FROM w")
def host_governor(spark, sf_dir):
    return tele.governed(d.host_events(spark, sf_dir)).select("seq", "host", "available", "allowed")


@query(f"WITH e AS ({d.HOST_EVENTS}), n AS (SELECT *, (row_number() OVER (PARTITION BY host ORDER BY seq) - 1) * 2.5::DOUBLE AS k FROM e) SELECT seq, max(ts - k) OVER (PARTITION BY host ORDER BY seq) + k AS start FROM n")
def request_spacing(spark, sf_dir):
    return tele.spaced(d.host_events(spark, sf_dir).select("seq", "ts", "host"), 2.5).select("seq", "start")


@query()
def bandwidth_pauses(spark, sf_dir):
    return tele.throttled(d.host_events(spark, sf_dir).select("host", "seq", "ts", (F.col("seq") % 5000).alias("bytes")), 300.0)


@query()
def robots_allowed(spark, sf_dir):
    robots = spark.createDataFrame([("example.com", "User-agent: *\nDisallow: /models/\nDisallow: /user/"), ("x.com", None)], "host string, body string")
    return tele.robots_allowed(d.subject_links(spark, sf_dir).select("seq", "link"), robots, link="link")


_S_KIND = f"""CASE WHEN {s_any('lower(line)', v.FETCH_LINES)} THEN CASE WHEN NOT {s_any('lower(line)', v.LOG_FETCHED_FILES)} THEN 'page' END
 WHEN contains(lower(line), 'downloaded ') THEN CASE WHEN contains(lower(line), 'images') OR {s_any('lower(line)', v.LOG_IMAGES)} THEN 'image' WHEN contains(lower(line), 'videos') OR {s_any('lower(line)', v.LOG_VIDEOS)} THEN 'video' END
 WHEN {s_any('upper(line)', v.LOG_ERRORS)} THEN 'error' END"""


@query(f"WITH l AS (SELECT {_S_KIND} AS kind FROM ({d.LOG})) SELECT count(*) FILTER (kind = 'page') AS pages, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'video') AS videos, count(*) FILTER (kind = 'error') AS errors FROM l")
def log_counters(spark, sf_dir):
    return tele.line_counts(d.log(spark, sf_dir))


@query(f"WITH l AS (SELECT seq - min(seq) OVER () AS seq, line FROM ({d.LOG})) SELECT seq, line FROM l WHERE seq >= 300")
def log_from_offset(spark, sf_dir):
    rows = d.log(spark, sf_dir)
    first = rows.agg(F.min("seq")).first()[0] or 0
    return tele.lines_from(rows.withColumn("seq", F.col("seq") - first), 300)


# ---- training export


@query()
def training_export(spark, sf_dir):
    from .catalog import _dhash

    hashes = _dhash(spark, sf_dir).select(F.concat(F.lit("in/"), F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".jpg")).alias("path"), "vec_id", F.when(F.col("vec_id") % 50 != 0, F.col("dhash").bitwiseAND(0xFFFFF)).alias("dhash"))
    rows = hashes.select("path", (F.col("vec_id") % 900).alias("width"), (F.col("vec_id") % 700).alias("height"), "dhash", (F.col("vec_id") % 10).cast("double").alias("score"), F.array(F.lit(" Red Car"), F.lit("x")).alias("tags"))
    return r.training_export(rows, 300, 3.0)
