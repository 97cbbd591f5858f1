"""Seed manifests: a commented list of URLs that becomes a table of domain profiles.

A comment's annotations wait for the next URL of a host not seen before, whose profile they describe; a divider drops
them. Credentials in a manifest are never read. Manifests are small configuration, parsed on the driver.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

INDEX = "index→detail"
#: How annotations are written. (field, pattern, value of a match)
_ANNOTATIONS = tuple(
    (name, re.compile(pattern, re.IGNORECASE), value)
    for name, pattern, value in (
        ("media_type", r"\btype\s*:\s*(video|image|mixed)\b", lambda m: m[1].lower()),
        ("crawl_strategy", r"\bcrawl\s*:\s*(direct|index.+?detail)\b", lambda m: "direct" if "direct" in m[1].lower() else INDEX),
        ("crawl_depth", r"#\s*depth\s*:\s*(\d+)", lambda m: int(m[1])),
        ("skip_link_discovery", r"#\s*skip[-_ ]link[-_ ]discovery", lambda m: True),
        ("rate_limit", r"\brate-limit\s*:\s*(\d+(?:\.\d+)?)\s*req/s", lambda m: float(m[1])),
        ("min_image_size", r"\bmin[-_]image[-_]size\s*:\s*(\d+)\s*x\s*(\d+)\b", lambda m: (int(m[1]), int(m[2]))),
        ("thumbnail_prefix_pattern", r"\bthumbnail[-_]prefix\s*:\s*(\S+)\b", lambda m: m[1]),
        ("preferred_engine", r"\bengine\s*:\s*(\S+)\b", lambda m: m[1].lower()),
        ("requires_referer", r"#\s*requires[-_ ]referer", lambda m: True),
        ("disabled", r"\bdisabled\b", lambda m: True),
        ("max_pages", r"\bmax_pages\s*:\s*(\d+)\b", lambda m: int(m[1])),
    )
)
_SUBJECT = re.compile(r"#\s*subject\s*:\s*(.+)", re.IGNORECASE)
_CDN = re.compile(r"#\s*\[cdn\]\s*(\S+)", re.IGNORECASE)
_URL = re.compile(r"https?://\S+")
#: Path parts that name no subject.
COMMON_PARTS = frozenset(("video", "videos", "image", "images", "photo", "photos", "gallery", "galleries", "album", "albums", "model", "models", "category", "tag", "tags", "search", "post", "posts", "page", "user", "users"))


@dataclass
class Profile:
    domain: str
    seed_urls: list[str] = field(default_factory=list)
    media_type: str = "mixed"
    crawl_strategy: str = INDEX
    crawl_depth: int | None = None
    cdn_hosts: list[str] = field(default_factory=list)
    skip_link_discovery: bool = False
    rate_limit: float | None = None
    min_image_size: tuple[int, int] | None = None
    thumbnail_prefix_pattern: str | None = None
    preferred_engine: str | None = None
    requires_referer: bool = False
    disabled: bool = False
    max_pages: int | None = None
    subject_aliases: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    @property
    def effective_depth(self) -> int:
        return self.crawl_depth if self.crawl_depth is not None else 0 if self.crawl_strategy == "direct" else 1


@dataclass
class Manifest:
    subject: str = ""
    entity_tokens: list[str] = field(default_factory=list)
    profiles: list[Profile] = field(default_factory=list)


def concrete_host(name: str) -> str:
    """A CDN host as it can be matched: a first label with a wildcard or a template goes."""
    name = name.lower().strip()
    head, dot, rest = name.partition(".")
    return rest if dot and "." in rest and re.fullmatch(r"[a-z0-9*{}\[\]]+", head) and re.search(r"[*{}\[\]]", head) else name


def entity_tokens(subject: str) -> list[str]:
    """Each alternative of a subject, then its words, distinct, lower case."""
    phrases = [p.strip().lower() for p in re.split(r"[/|,]", subject) if p.strip()]
    return list(dict.fromkeys(x for p in phrases for x in (p, *p.split())))


def parse(text: str) -> Manifest:
    out, by_host, waiting = Manifest(), {}, {}
    for line in map(str.strip, text.splitlines()):
        if line.startswith(("# ---", "# ===")):
            waiting = {}
        elif line.startswith("#"):
            if not out.subject and (m := _SUBJECT.match(line)):
                out.subject, out.entity_tokens = m[1].strip(), entity_tokens(m[1])
                continue
            for name, pattern, value in _ANNOTATIONS:
                if m := pattern.search(line):
                    waiting[name] = value(m)
            if m := _CDN.search(line):
                waiting.setdefault("cdn_hosts", []).append(concrete_host(m[1]))
            if not re.search(r"\b(username|email|password)\s*:", line, re.IGNORECASE):
                waiting.setdefault("notes", []).append(line)
        elif _URL.fullmatch(line) and (host := urlsplit(line).netloc.lower()):
            if host not in by_host:
                if "cdn_hosts" in waiting:
                    waiting["cdn_hosts"] = list(dict.fromkeys(waiting["cdn_hosts"]))
                by_host[host] = Profile(host, **waiting)
                out.profiles.append(by_host[host])
                waiting = {}
            profile = by_host[host]
            if line not in profile.seed_urls:
                profile.seed_urls.append(line)
                parts = (p.strip().lower() for p in urlsplit(line).path.split("/"))
                profile.subject_aliases += [p for p in dict.fromkeys(parts) if re.fullmatch(r"[a-z0-9_]{3,}", p) and p not in COMMON_PARTS and p not in profile.subject_aliases]
    return out


#: What a line with a misspelt or malformed annotation is told. (needs, must match, message)
_CHECKS = tuple(
    (re.compile(needs, re.IGNORECASE), None if right is None else re.compile(right, re.IGNORECASE), message)
    for needs, right, message in (
        (r"(?<![\w-])type\s*:\s*\w", r"type\s*:\s*(image|video|mixed)\b", "invalid type (image, video or mixed)"),
        (r"\btyp:|media[-_]type:", None, "possible typo of 'type'"),
        (r"(?<![\w-])crawl\s*:\s*\S", r"crawl\s*:\s*\S*(direct|index)", "invalid crawl strategy (direct or index→detail)"),
        (r"crawl[-_]strategy:", None, "possible typo of 'crawl'"),
        (r"(?<![\w-])depth\s*:\s*\S", r"depth\s*:\s*\d+(?!\S)", "invalid depth (a whole number)"),
        (r"\bdept:", None, "possible typo of 'depth'"),
        (r"rate[-_]limit\s*:", r"\brate-limit\s*:\s*\d+(\.\d+)?\s*req/s", "malformed Rate-limit (<N> req/s)"),
        (r"ratelimit:|rate limit:", None, "possible typo of 'Rate-limit'"),
        (r"max[-_]?pages\s*:", r"\bmax_pages\s*:\s*\d+\b", "malformed max_pages (<N>)"),
        (r"max pages:", None, "possible typo of 'max_pages'"),
        (r"min[-_]image[-_]size\s*:", r"\bmin[-_]image[-_]size\s*:\s*\d+\s*x\s*\d+\b", "malformed min-image-size (<width>x<height>)"),
        (r"thumbnail[-_]prefix\s*:", r"\bthumbnail[-_]prefix\s*:\s*\S+\b", "malformed thumbnail-prefix"),
    )
)


def validate(text: str) -> list[tuple[int, str]]:
    """(line, message) for everything odd about a manifest; line 0 for the whole."""
    found, seen = [], set()
    if not text.strip():
        return [(0, "the manifest is empty")]
    lines = [x.strip() for x in text.splitlines()]
    if not any(_SUBJECT.match(x) for x in lines):
        found.append((0, "no '# Subject: <name>' header"))
    for n, line in enumerate(lines, 1):
        if line.startswith("#"):
            found += [(n, message) for needs, right, message in _CHECKS if needs.search(line) and (right is None or not right.search(line))]
        elif line and not _URL.fullmatch(line):
            found.append((n, "neither a comment nor a URL"))
        elif line in seen:
            found.append((n, "duplicate URL"))
        elif line:
            seen.add(line)
    if not seen:
        found.append((0, "no seed URLs"))
    return found


def lint(text: str) -> tuple[bool, list[tuple[int, str]]]:
    """Whether a manifest is free of errors, and all it found: what validate finds, and hosts that come back after others."""
    found, done, last = validate(text), set(), None
    for n, line in enumerate((x.strip() for x in text.splitlines()), 1):
        if line and not line.startswith("#") and _URL.fullmatch(line):
            host = re.sub(r"^https?://([^/?#]*).*$", r"\1", line.lower())
            if host != last and host in done:
                found.append((n, f"duplicate domain {host}"))
            done.add(host)
            last = host
    return not found, sorted(found)


_DDL = (
    "domain string, seed_urls array<string>, media_type string, crawl_strategy string, crawl_depth int, cdn_hosts array<string>, skip_link_discovery boolean, rate_limit double, "
    "min_image_size struct<w:int,h:int>, thumbnail_prefix_pattern string, preferred_engine string, requires_referer boolean, disabled boolean, max_pages int, subject_aliases array<string>, notes array<string>"
)


def profiles(spark: SparkSession, manifest: Manifest) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(p).values()) for p in manifest.profiles], _DDL)


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """The URLs of a plain list, comments and blank lines left out."""
    from pyspark.sql import functions as F

    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def from_path(spark: SparkSession, path: str) -> Manifest:
    """Reads a manifest from any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()
    return parse(rows[0]["value"] if rows else "")
