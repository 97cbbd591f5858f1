"""Links, images and videos of web pages: one pass over the markup, in Arrow batches.

Extraction works on pages already fetched; nothing here opens a connection.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagemill.functions import vocab as v

# What marks page furniture, and how videos are named in text.
LAYOUT_TAGS = frozenset(("nav", "aside", "footer", "header"))
LAYOUT_WORDS = frozenset(("footer", "header", "sidebar", "nav", "navbar", "menu", "widget", "related", "sponsor", "advert", "ad", "ads", "banner", "social", "breadcrumb"))
#: Attributes that name no picture when others may.
TEXT_ATTRIBUTES = frozenset("alt title class id style width height onclick onload sizes rel target type media aria-label data-title data-alt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: By opened tag: the open elements that it ends, and those that they are not looked for beyond.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)), "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "tr": (("tr", "td", "th"), ("table",))}
ENDS |= dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))) | dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))) | dict.fromkeys(("thead", "tfoot"), ENDS["tbody"])
P_ENDS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
P_WITHIN = ("button", "caption", "object", "table", "td", "th", "template")
_IMAGE = re.compile(r"\.(" + "|".join(v.IMAGE_EXTENSIONS) + r")$")
_VIDEO = re.compile(r"\.(" + "|".join(v.VIDEO_EXTENSIONS + v.STREAM_EXTENSIONS) + r")$")
_STYLE_URL = re.compile(r"""background(?:-image)?\s*:[^;]*?url\((['"]?)(.*?)\1\)""", re.IGNORECASE)
_VIDEO_TEXT = re.compile(r"""https?://(?:www\.)?(?:youtube(?:-nocookie)?\.com/(?:watch\?v=|embed/)|youtu\.be/|(?:player\.)?vimeo\.com/(?:video/)?)[\w-]+|https?://[^\s"'<>\\]+?\.(?:mp4|webm|m3u8|mpd|mov|m4v)(?:\?[^\s"'<>\\]*)?""")
_SIZE = re.compile(r"[_-](?:thumb|small|thumbnail|preview|mini)(\.[A-Za-z0-9]{3,4})(?=$|\?)", re.IGNORECASE)


def is_image(url: str) -> bool:
    path = urlsplit(url).path.lower().rstrip("/")
    return bool(_IMAGE.search(path)) and " " not in path.rsplit("/", 1)[-1]


def is_video(url: str) -> bool:
    return bool(_VIDEO.search(urlsplit(url).path.lower().rstrip("/")))


def video_kind(url: str) -> str | None:
    low = url.lower()
    if re.search(r"youtube(-nocookie)?\.com|youtu\.be", low):
        return "youtube"
    if "vimeo.com" in low:
        return "vimeo"
    return "hls" if ".m3u8" in low else "dash" if ".mpd" in low else "direct" if is_video(url) else None


def best_source(srcset: str) -> str | None:
    """The candidate with the largest width, or density (a thousand for each x); the first of equal ones."""
    best, most = None, -1.0
    for part in srcset.split(","):
        words = part.split()
        if not words:
            continue
        size = 1.0
        if len(words) > 1 and re.fullmatch(r"[0-9.]+[wx]", words[1]):
            try:
                size = float(words[1][:-1]) * (1000 if words[1][-1] == "x" else 1)
            except ValueError:
                size = 1.0
        if size > most:
            best, most = words[0], size
    return best


def json_strings(value) -> Iterator[tuple[str, str]]:
    """(key, string) of every string leaf, in order, without recursion."""
    stack = [("", value)]
    while stack:
        key, x = stack.pop()
        if isinstance(x, dict):
            stack += [(str(k), y) for k, y in reversed(x.items())]
        elif isinstance(x, list):
            stack += [(key, y) for y in reversed(x)]
        elif isinstance(x, str):
            yield key, x


def hidden_sources(url: str) -> list[str]:
    """Videos in an iframe's q parameter, which holds markup (or JSON with a tag) in base64."""
    found = []
    for value in parse_qs(urlsplit(url).query).get("q", ()):
        if len(value) >= 20 and re.fullmatch(r"[A-Za-z0-9+/=_ -]+", value):
            plain = value.replace(" ", "+").replace("-", "+").replace("_", "/")
            try:
                text = base64.b64decode(plain + "=" * (-len(plain) % 4)).decode("utf-8", "replace")
            except (binascii.Error, ValueError):
                continue
            try:
                text = str(json.loads(text).get("tag", text))
            except (ValueError, AttributeError):
                pass
            found += re.findall(r"""<(?:source|video)[^>]*?\ssrc=["']([^"']+)""", text, re.IGNORECASE)
            found += _VIDEO_TEXT.findall(text)
    return list(dict.fromkeys(found))


class Page(HTMLParser):
    """Collects (kind, url, text, width, height, place) of a page; place tells where it was found."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.rows, self.seen = url, [], set()
        self.stack: list[tuple[str, bool]] = []
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.title: list[str] = []
        self.og_title = ""
        self.anchor: dict | None = None
        self.script: list[str] | None = None
        self.script_kind = ""
        self.is_login = False
        self.player = False  # in a video that shows controls and loops
        self.named: list[tuple[str, str, str]] = []  # what any attribute names, for pages without images or videos otherwise

    @property
    def in_layout(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def _cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.open[self.stack.pop()[0]].pop()

    def _imply(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Ends the outermost open element of tags inside the innermost of within."""
        edge = max((self.open[x][-1] for x in within if self.open.get(x)), default=-1)
        inner = [places[bisect_right(places, edge)] for x in tags if (places := self.open.get(x)) and places[-1] > edge]
        if inner:
            self._cut(min(inner))

    def add(self, kind: str, raw: str | None, text: str = "", width=None, height=None, place: str = "") -> None:
        if not raw or raw.startswith(("data:", "javascript:", "#")):
            return
        try:
            url = urljoin(self.url, raw.strip())
            if urlsplit(url).scheme not in ("http", "https"):
                return
        except ValueError:
            return
        key = (kind, url)
        if key not in self.seen:
            self.seen.add(key)
            self.rows.append({"kind": kind, "url": url, "text": " ".join(text.split()), "width": width, "height": height, "place": place, "in_layout": self.in_layout and place != "attribute"})

    def finish(self, videos_too: bool = False) -> None:
        """Where nothing else was found, the images (and videos, if wanted) that any attribute names."""
        self.close()
        for kind in ("image", "video") if videos_too else ("image",):
            if not any(r["kind"] == kind for r in self.rows):
                for found, raw, text in self.named:
                    if found == kind:
                        self.add(kind, raw, text, place="attribute")

    def _name(self, attributes: dict[str, str]) -> None:
        for key, raw in attributes.items():
            raw = raw.strip()
            if len(raw) > 4 and key not in TEXT_ATTRIBUTES and "." in raw:
                try:
                    target = urljoin(self.url, raw)
                    kind = "image" if is_image(target) else "video" if is_video(target) else None
                except ValueError:
                    continue
                if kind:
                    self.named.append((kind, raw, attributes.get("alt") or attributes.get("title", "")))

    def handle_starttag(self, tag: str, attributes) -> None:
        a = {k: x or "" for k, x in attributes}
        words = set(re.split(r"[\s_-]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))
        if tag in P_ENDS:
            self._imply(("p",), P_WITHIN)
        if tag in ENDS:
            self._imply(*ENDS[tag])
        layout = self.in_layout or tag in LAYOUT_TAGS or (tag not in ("html", "body") and bool(words & LAYOUT_WORDS))
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append((tag, layout))
        number = lambda x: int(x) if x.isascii() and x.isdigit() and len(x) < 9 else None
        self._name(a)
        if tag == "video":
            self.player = "controls" in a and "loop" in a
        if tag == "meta":
            name, content = (a.get("property") or a.get("name", "")).lower(), a.get("content", "")
            if name in ("og:title", "title", "twitter:title") and not self.og_title:
                self.og_title = content
            elif name in ("og:image", "twitter:image"):
                self.add("image", content, "", place="meta")
            elif name == "og:url" and re.search("/login|/signin|/auth", content):
                self.is_login = True
        elif tag == "img":
            if not layout:
                raw = best_source(a["srcset"]) if a.get("srcset") else None
                raw = raw or next((a[k] for k in ("data-src", "data-original", "data-lazy-src", "src") if a.get(k)), None)
                self.add("image", raw and _SIZE.sub(r"\1", raw), a.get("alt", ""), number(a.get("width", "")), number(a.get("height", "")), "img")
                if self.anchor is not None:
                    self.anchor["alt"] = self.anchor["alt"] or a.get("alt", "")
        elif tag in ("source", "video"):
            if not layout and (src := a.get("src") or a.get("data-src")) and (tag == "video" or is_video(urljoin(self.url, src)) or a.get("type", "").startswith("video") or self.player and video_kind(urljoin(self.url, src))):
                self.add("video", src, place="video")
        elif tag in ("iframe", "embed"):
            src = a.get("src") or a.get("data-src", "")
            if src:
                if video_kind(urljoin(self.url, src)):
                    self.add("video", src, place=tag)
                else:
                    self.add("link", src, place=tag)
                for hidden in hidden_sources(urljoin(self.url, src)):
                    self.add("video", hidden, place="base64")
        if tag == "a" and a.get("href"):
            self.anchor = {"href": a["href"], "text": [], "alt": "", "layout": layout, "place": "lightbox" if "data-fslightbox" in a or "data-lightbox" in a else "anchor"}
        if tag == "link" and a.get("href"):
            self.add("link", a["href"], place="link")
        if (style := a.get("style")) and not layout and (m := _STYLE_URL.search(style)):
            self.add("image", m[2], place="style")
        if tag == "script":
            self.script, self.script_kind = [], a.get("type", "").lower()

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.anchor is not None:
            a, self.anchor = self.anchor, None
            text = " ".join(" ".join(a["text"]).split()).lower() or a["alt"].lower()
            try:
                target = urljoin(self.url, a["href"])
                media = "image" if is_image(target) else "video" if video_kind(target) else None
            except ValueError:
                target, media = "", None
            if media and not a["layout"]:
                self.add(media, a["href"], text, place=a["place"])
            elif target and not media:
                self.add("link", a["href"], text, place="anchor")
        elif tag == "script" and self.script is not None:
            text, self.script = "".join(self.script), None
            if "ld+json" in self.script_kind:
                self._linked_data(text)
            self._videos_in(text)
        elif tag == "video":
            self.player = False
        if self.open.get(tag):
            self._cut(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)
        elif self.stack and self.stack[-1][0] == "title":
            self.title.append(data)
        else:
            if self.anchor is not None:
                self.anchor["text"].append(data)
            if "://" in data:
                self._videos_in(data)

    def _videos_in(self, text: str) -> None:
        if not self.in_layout:
            for url in _VIDEO_TEXT.findall(text):
                self.add("video", url.replace("\\/", "/"), place="text")

    def _linked_data(self, text: str) -> None:
        try:
            value = json.loads(text)
        except ValueError:
            return
        for key, x in json_strings(value):
            if key in ("contentUrl", "embedUrl") and video_kind(urljoin(self.url, x)):
                self.add("video", x, place="json-ld")
            elif key in ("image", "thumbnailUrl", "contentUrl") or key == "url" and is_image(urljoin(self.url, x)):
                if not is_video(urljoin(self.url, x)):
                    self.add("image", x, "JSON-LD metadata", place="json-ld")


def media_of(url: str, html: str, videos_too: bool = False) -> tuple[str, list[dict], bool]:
    """(title, rows, is login page) of a page."""
    page = Page(url)
    page.feed(html)
    page.finish(videos_too)
    return " ".join(("".join(page.title).strip() or page.og_title).split()), page.rows, page.is_login


def media_of_json(url: str, body: str) -> list[dict]:
    """Images and videos named by the string leaves of a JSON document."""
    try:
        value = json.loads(body)
    except ValueError:
        return []
    out = []
    for _, x in json_strings(value):
        if x.startswith(("http://", "https://", "/", "./", "../")):
            target = urljoin(url, x)
            kind = "video" if video_kind(target) else "image" if is_image(target) else None
            if kind:
                out.append({"kind": kind, "url": target, "text": "", "width": None, "height": None, "place": "json", "in_layout": False})
    return out


_COLUMNS = ["page_id", "page_url", "title", "seq", "kind", "url", "text", "width", "height", "place", "in_layout"]


def extract(pages: DataFrame, videos_too: bool = False) -> DataFrame:
    """One row per link, image and video of pages (page_id, url, html); a null page has none. No shuffle.

    Images that only some other attribute names are taken where a page has no others (videos too, if wanted). A page
    that says it is a login page has one row of kind login_wall and nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                if not html or not url:
                    continue
                if html.lstrip()[:1] in ("{", "["):
                    title, rows = "", media_of_json(url, html)
                else:
                    title, rows, is_login = media_of(url, html, videos_too)
                    if is_login:
                        rows = [{"kind": "login_wall", "url": url, "text": "", "width": None, "height": None, "place": "meta", "in_layout": False}]
                out += [(page_id, url, title, i, *(r[c] for c in _COLUMNS[4:])) for i, r in enumerate(rows)]
            frame = pd.DataFrame(out, columns=_COLUMNS)
            yield frame.astype({"width": "Int32", "height": "Int32"})

    ddl = "page_id bigint, page_url string, title string, seq int, kind string, url string, text string, width int, height int, place string, in_layout boolean"
    return pages.select("page_id", "url", "html").mapInPandas(run, ddl)


def page_edges(pages: DataFrame) -> DataFrame:
    """Links outside navigation to the page's own host, by the order links are followed."""
    from pagemill.functions import urls as u

    links = extract(pages).where("kind = 'link' and not in_layout")
    rows = links.select("page_id", u.host(F.col("page_url")).alias("host"), u.canonical(F.col("url")).alias("target"), "text")
    return rows.where((u.host(F.col("target")) == F.col("host")) & u.is_allowed_path(F.col("target"))).select("page_id", "target", "text").distinct()
