"""Inputs that stand in for the web records the driver's tables lack: fixed projections, the same text in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import ship

MEDIA_ITEMS = """SELECT o_orderkey AS seq,
  CASE WHEN o_orderkey % 4 = 0 THEN 'video' ELSE 'image' END AS kind,
  'https://cdn.h' || CAST(o_custkey % 7 AS STRING) || '.example.com/' ||
  CASE o_orderkey % 4
    WHEN 0 THEN 'subject/video' || CAST(o_custkey AS STRING) || '_' || CAST(360 * (1 + o_orderkey % 3) AS STRING) || 'p.mp4'
    WHEN 1 THEN 'subject/photo' || CAST(o_custkey AS STRING) || '-' || CAST(50 + o_custkey % 900 AS STRING) || 'x' || CAST(50 + (o_custkey * 7) % 700 AS STRING) || '.jpg'
    WHEN 2 THEN 'thumbs/photo' || CAST(o_custkey AS STRING) || '.jpg?w=' || CAST(50 + o_orderkey % 600 AS STRING)
    ELSE 'gallery/full' || CAST(o_custkey AS STRING) || '.png' END AS url,
  'https://h' || CAST(o_custkey % 7 AS STRING) || '.example.com/post/' || CAST(o_orderkey % 500 AS STRING) AS source_page,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'subject ' || lower(o_orderpriority) END AS alt_text,
  CASE WHEN o_orderkey % 11 = 0 THEN 'site logo' ELSE 'page ' || CAST(o_orderkey % 500 AS STRING) END AS page_title,
  CAST(50 + o_custkey % 1200 AS INT) AS width,
  CAST(50 + (o_custkey * 7) % 900 AS INT) AS height,
  o_orderkey % 13 = 0 AS in_layout
FROM orders"""

PAGE_REPORTS = """SELECT c_custkey AS seq,
  'h' || CAST(c_custkey % 7 AS STRING) || '.example.com' AS host,
  CAST(c_custkey % 4 AS INT) AS depth,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'skipped' ELSE 'success' END AS status,
  CAST(CASE WHEN c_custkey % 7 = 3 THEN 0 ELSE c_custkey % 3 END AS INT) AS images_found,
  CAST(CASE WHEN c_custkey % 7 = 3 THEN 0 ELSE c_custkey % 2 END AS INT) AS videos_found
FROM customer"""

FETCH_LOG = """SELECT event_id AS seq, ts,
  'h' || CAST(user_id % 40 AS STRING) || '.example.com' AS host,
  CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 404 ELSE 200 END AS status,
  value AS latency_ms
FROM events"""

LINK_EDGES = "SELECT o_orderkey AS seq, o_custkey AS src, (o_orderkey * 31 + 7) % 1500 AS dst FROM orders"

RUNS = """SELECT lpad(CAST(c_custkey AS STRING), 8, '0') AS run_id, 's' || CAST(c_custkey % 9 AS STRING) AS subject,
  c_custkey % 17 AS images, (c_custkey * 7) % 5 AS videos, c_custkey % 30 AS pages,
  CASE c_custkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'mixed' END AS expected
FROM customer"""

_LINKS = ("/somesubject", "/somesubject/Photos", "/othermodel", "/privacy-policy", "/models/l/a/other", "/page/2", "/user/login", "/s/faq", "/post/123", "/tag/somesubject", "/a/99/x", "/somesubject/?page=2", "/tag/other", "/Videos/some", "/videos/x/", "/")
_SEEDS = ("/somesubject", "/", "/search?q=somesubject", "/start", "/models/somesubject/all/")

#: Links found on seed pages: shapes that meet each of the scope rules.
SUBJECT_LINKS = f"""SELECT o_orderkey AS seq,
  CASE WHEN o_orderkey % 5 = 0 THEN 'https://other.com' ELSE 'https://example.com' END || CASE o_custkey % {len(_LINKS)} {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_LINKS))} END AS link,
  'https://example.com' || CASE o_orderkey % {len(_SEEDS)} {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_SEEDS))} END AS seed,
  CASE WHEN o_custkey % 7 = 0 THEN 'SomeSubject pictures' ELSE '' END AS anchor
FROM orders"""

HOST_EVENTS = """SELECT event_id AS seq, CAST(event_id AS DOUBLE) / 4 AS ts, 'h' || CAST(user_id % 60 AS STRING) AS host,
  CASE WHEN event_id % 97 = 0 THEN 'login_wall' WHEN event_type = 'error' THEN 'rate_limited' WHEN event_type = 'signup' THEN 'error' ELSE 'ok' END AS outcome,
  CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS found
FROM events"""

LOG = """SELECT event_id AS seq, CASE event_id % 8
  WHEN 0 THEN '2024-01-01 10:00:00 HTTP Request: GET https://h/' || event_type WHEN 1 THEN 'Fetching page https://h/a.JPG' WHEN 2 THEN 'Downloaded 3 images'
  WHEN 3 THEN 'downloaded clip.mp4' WHEN 4 THEN 'Request failed' WHEN 5 THEN 'Downloaded ' || event_type WHEN 6 THEN 'status 429' ELSE event_type END AS line
FROM events"""

#: host, media type, crawl strategy, depth, CDN hosts, page cap, thumbnail pattern
PROFILES = (
    ("h0.example.com", "image", "direct", None, "cdn.h0.example.com", 120, None),
    ("h1.example.com", "video", "index", 2, "", 150, None),
    ("h2.example.com", "mixed", "index", None, "cdn.h2.example.com", None, None),
    ("h3.example.com", "image", "direct", None, "", 100, r"-\d+x\d+\."),
    ("h4.example.com", "mixed", "direct", 1, "", None, None),
    ("h5.example.com", "video", "index", None, "cdn.h5.example.com", 90, None),
)


def profiles_sql() -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x + "'"
    rows = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in PROFILES)
    return f"SELECT * FROM (VALUES {rows}) AS t(host, media_type, crawl_strategy, crawl_depth, cdn_host, max_pages, thumb_pattern)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _made(spark: SparkSession, sf_dir: str, source: str, sql: str) -> DataFrame:
    return spark.sql(sql.rsplit("FROM ", 1)[0] + "FROM {source}", source=read(spark, sf_dir, source))


def media_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "orders", MEDIA_ITEMS)


def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "customer", PAGE_REPORTS)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "events", FETCH_LOG)


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "orders", LINK_EDGES)


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "host string, media_type string, crawl_strategy string, crawl_depth int, cdn_host string, max_pages int, thumb_pattern string")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "customer", RUNS)


def subject_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "orders", SUBJECT_LINKS)


def host_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "events", HOST_EVENTS)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "events", LOG)
