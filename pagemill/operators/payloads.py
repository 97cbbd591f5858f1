"""Media named by the API responses of known sites: projections of payloads already stored.

An extractor is a function from (url, body) to rows (kind, url). The registry picks the first whose test accepts the
URL, by priority and then by name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

Rows = list[tuple[str, str]]


def _kind(url: str) -> str:
    return "video" if re.search(r"\.(mp4|webm|mov|m3u8)($|\?)", url.lower()) else "image"


def _unique(rows: Rows) -> Rows:
    return list(dict.fromkeys(r for r in rows if r[1]))


def _items(value) -> list[dict]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def posts(body) -> Rows:
    """Image boards: the file of each post, or its large version."""
    value = body.get("post", body) if isinstance(body, dict) else body
    return [(_kind(u), u) for p in _items(value) if (u := p.get("file_url") or p.get("large_file_url"))]


def model_gallery(body) -> Rows:
    value = body if isinstance(body, dict) else {}
    rows = [(_kind(x.get("url") or ""), x.get("url")) for x in _items(value.get("items", []))]
    rows += [(_kind(x.get("url") or ""), x.get("url")) for v in _items(value.get("modelVersions", [])) for x in _items(v.get("images", []))]
    return [r for r in rows if r[1]]


def thread(body) -> Rows:
    try:
        post = body[0]["data"]["children"][0]["data"]
    except (KeyError, IndexError, TypeError):
        return []
    rows: Rows = []
    url = post.get("url") or ""
    if re.search(r"\.(jpe?g|png|gif|webp|mp4|webm)$", urlsplit(url).path.lower()):
        rows.append((_kind(url), url))
    if clip := ((post.get("secure_media") or {}).get("reddit_video") or {}).get("fallback_url"):
        rows.append(("video", clip))
    for x in (post.get("media_metadata") or {}).values():
        if x.get("status") == "valid" and (u := (x.get("s") or {}).get("u")):
            rows.append(("image", unescape(u)))
    return rows


def artwork(body) -> Rows:
    assets = _items(body.get("assets", [])) if isinstance(body, dict) else []
    return [("video" if a.get("asset_type") == "video" or ".mp4" in a["image_url"] else "image", a["image_url"]) for a in assets if a.get("image_url")]


def statuses(body) -> Rows:
    """The variant with the highest bitrate (the first of equal ones), pictures in their large size."""
    value = body if isinstance(body, dict) else {}
    rows: Rows = []
    for m in _items(value.get("media_extended", [])):
        if m.get("variants"):
            best = max(_items(m["variants"]), key=lambda v: v.get("bitrate") or 0, default={})
            rows.append(("video", best.get("url") or m.get("url")))
        elif m.get("type") in ("video", "gif"):
            rows.append(("video", m.get("url")))
        else:
            rows.append(("image", _large(m.get("url") or "")))
    if not rows:
        rows = [("video", u) if _kind(u) == "video" else ("image", _large(u)) for u in value.get("mediaURLs", [])]
    return [r for r in rows if r[1]]


def _large(url: str) -> str:
    if not url:
        return url
    new = re.sub(r"name=(small|medium)", "name=large", url)
    return new if "name=" in new else new + ("&" if "?" in new else "?") + "name=large"


def carousel(body) -> Rows:
    value = body if isinstance(body, dict) else {}
    node = value.get("graphql", value).get("shortcode_media", value)
    edges = (node.get("edge_sidecar_to_children") or {}).get("edges") or [{"node": node}]
    return [("video", n["video_url"]) if n.get("is_video") and n.get("video_url") else ("image", n.get("display_url")) for n in (e.get("node", {}) for e in edges)]


def formats(body) -> Rows:
    """Of each entry the MP4 format with the most lines, else the entry's own URL."""
    value = body if isinstance(body, dict) else {}
    rows: Rows = []
    for e in _items(value.get("entries") or value):
        found = [f for f in _items(e.get("formats", [])) if f.get("ext") == "mp4" and f.get("url")]
        rows.append(("video", max(found, key=lambda f: f.get("height") or 0)["url"] if found else e.get("url")))
    return [r for r in rows if r[1]]


def pins(text: str) -> Rows:
    pictures = re.findall(r"https://i\.pinimg\.com/[^\s\"'\\]+?\.(?:jpg|png|webp|gif)", text)
    clips = re.findall(r"https://[^\s\"'\\]+?pinimg\.com/[^\s\"'\\]+?\.mp4", text)
    return [("image", re.sub(r"/\d+x(\d+)?/", "/originals/", u)) for u in pictures] + [("video", u) for u in clips]


def channel(text: str) -> Rows:
    photos = re.findall(r"tgme_widget_message_photo_wrap[^>]*?background-image:\s*url\(['\"]?([^'\")]+)", text)
    return [("image", u) for u in photos] + [("video", u) for u in re.findall(r"<video[^>]+src=[\"']([^\"']+)", text)]


class Registry:
    """Extractors by priority; registering a name again replaces it."""

    def __init__(self):
        self._entries: dict[str, tuple[int, Callable[[str], bool], Callable, bool]] = {}

    def register(self, name: str, accepts: Callable[[str], bool], extract: Callable, priority: int = 100, is_json: bool = True) -> None:
        self._entries[name] = (priority, accepts, extract, is_json)

    def unregister(self, name: str) -> None:
        self._entries.pop(name, None)

    def find(self, url: str) -> str | None:
        return next((n for n, (_, accepts, _, _) in sorted(self._entries.items(), key=lambda x: (x[1][0], x[0])) if accepts(url)), None)

    def extract(self, url: str, body: str) -> Rows:
        name = self.find(url)
        if name is None or not body:
            return []
        _, _, extract, is_json = self._entries[name]
        if is_json:
            try:
                body = json.loads(body)
            except ValueError:
                return []
        return _unique(extract(body))


def _hosts(*names: str, path: str = "") -> Callable[[str], bool]:
    def accepts(url: str) -> bool:
        host = urlsplit(url).netloc.lower().removeprefix("www.")
        return any(host == n or host.endswith("." + n) for n in names) and bool(re.search(path, urlsplit(url).path))

    return accepts


def default_registry() -> Registry:
    r = Registry()
    r.register("artstation", _hosts("artstation.com"), artwork)
    r.register("booru", _hosts("danbooru.donmai.us", "gelbooru.com", "safebooru.org"), posts)
    r.register("civitai", _hosts("civitai.com"), model_gallery)
    r.register("instagram", _hosts("instagram.com", path="/(p|reels?|tv)/"), carousel)
    r.register("pinterest", _hosts("pinterest.com", "pin.it"), pins, is_json=False)
    r.register("reddit", _hosts("reddit.com"), thread)
    r.register("telegram", _hosts("t.me", "telegram.me"), channel, is_json=False)
    r.register("twitter", _hosts("twitter.com", "x.com", "fxtwitter.com", "vxtwitter.com", path="/status/"), statuses)
    r.register("streams", lambda u: bool(re.search(r"\.(m3u8|mpd)$", urlsplit(u).path.lower())), formats)
    return r


def extract(responses: DataFrame) -> DataFrame:
    """page_url, seq, kind, url of stored responses (url, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registry = default_registry()
        for pdf in batches:
            out = [(u, i, *row) for u, b in zip(pdf["url"], pdf["body"], strict=True) if u for i, row in enumerate(registry.extract(u, b or ""))]
            yield pd.DataFrame(out, columns=["page_url", "seq", "kind", "url"])

    return responses.select("url", "body").mapInPandas(run, "page_url string, seq int, kind string, url string")
