"""Vocabularies of the web rules. Results depend on them."""

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "avif", "apng", "bmp", "heic", "heif")
VIDEO_EXTENSIONS = ("mp4", "webm", "ogv", "mov", "avi", "mkv", "m4v")
STREAM_EXTENSIONS = ("m3u8", "mpd")
UTILITY_TERMS = (
    "logo", "icon", "banner", "badge", "avatar", "placeholder", "sprite", "favicon", "app-store", "play-store",
    "color_indicator", "color-indicator", "color_dot", "color-dot", "service",
)
GENERIC_TERMS = ("watermark", "overlay", "border", "frame", "background", "divider", "separator", "decoration", "spacer")
PLACEHOLDER_TERMS = ("captcha", "blank", "placeholder", "spacer")
PREVIEW_MARKERS = (
    "thumb_vid", "thumb-vid", "_thumb", "-thumb", "thumb.", "thumbnail", "preview", "avatar", "icon", "sprite", "small",
    "tiny", "blur", "lowres", "low-res", "collage", "storyboard", "previewsheet", "sample", "trailer", "short", "promo",
)
FULL_SIZE_WORDS = ("gallery", "post", "full", "highres")
IMAGE_WORDS = ("photo", "image", "gallery", "media", "post")
VIDEO_WORDS = ("video", "clip", "embed", "watch", "movie", "stream", "media", "post")
VIDEO_TYPES = ("youtube", "vimeo", "direct", "hls", "dash")
BROKEN_MARKS = ("placeholder", "404", "notfound", "error-image", "default-thumbnail")
LINK_HINTS = (
    "/gallery", "/galleries", "/album", "/albums", "/photo", "/photos", "/image", "/images", "/video", "/videos", "/media",
    "/post", "/posts", "/upload", "/uploads",
)
BLOCKED_HOSTS = (
    "unsplash.com", "pexels.com", "pixabay.com", "commons.wikimedia.org", "openverse.org", "api.openverse.org",
    "gravatar.com", "google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.net", "pixel.wp.com",
    "adsystem.com", "adservice.google.com", "en.wikipedia.org", "www.wikipedia.org", "www.imdb.com", "www.youtube.com",
    "www.tiktok.com", "onlyfans.com", "linktr.ee", "socialveins.com",
)
LOGIN_WALL_HOSTS = ("facebook.com", "instagram.com", "twitter.com", "x.com", "faceit.com", "linkedin.com", "pinterest.com")
TRACKING_PARAMETERS = (
    "hl", "lang", "locale", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref",
    "source", "ncid", "mc_eid",
)
INDEX_NAMES = ("index.html", "index.php", "index.htm", "home", "homepage")
ARCHIVE_PATHS = ("/category/", "/tag/", "/tags/", "/search", "/actor/", "/models/", "/archives/", "/page/", "/model/", "/actors/", "/categories/")
ARCHIVE_TITLES = ("archives", "category", "tag", "search results", "actor", "models", "actors", "model profile", "all post", "tag:", "category:")
ARCHIVE_QUERIES = ("q=", "s=", "cat=", "tag=", "p=")
SHALLOW_PARTS = ("page", "p", "sort", "filter")
SEARCH_PATHS = ("/search", "/find", "/results", "/query")
SEARCH_QUERIES = ("q=", "search=", "query=", "keyword=", "k=")
PAGE_QUERIES = ("page=", "p=", "start=", "offset=", "paged=")
CLOSED_SUFFIXES = (".json", ".xml", ".css", ".js")
CLOSED_PATHS = ("/wp-json", "/xmlrpc.php", "/feed", "/cdn-cgi/", "/account", "/cart", "/checkout", "goto/account")
MIN_IMAGE_BYTES, MIN_VIDEO_BYTES = 10240, 16384
MIN_WIDTH, MIN_HEIGHT = 400, 300
# Paths that are navigation on any site.
NAVIGATION_PATHS = tuple(
    """/ /about /contact /dmca /privacy /terms /login /register /logout /faq /support /help /about-us /privacy-policy
    /terms-of-service /terms-of-use /cookie-policy /refund-policy /disclaimer /sitemap /sitemap.xml /robots.txt /rss /feed
    /feed.xml /news /blog /advertise /advertising /careers /jobs /press /affiliate /partners /dmca-policy /2257
    /2257-compliance /18-usc-2257 /compliance /trust-and-safety /welcome /welcome-to /welcome-to-the-site /getting-started
    /guidelines /community-guidelines /rules /tos /api /docs /developers /statistics /stats /rankings /trending
    /trending-profiles /trending-medias /daily-search-ranking /most-liked /most-viewed /popular /featured /random /discover
    /explore /user-posts /comments /messages /notifications /settings /account /profile /search /uploads /request
    /contact-us /submit /report /flags /moderation /banned /suspended /deleted /error /404 /500 /page-not-found
    /maintenance /coming-soon /under-construction /forums /community /top /new /fresh /recent /latest /updates /changelog
    /version /status /health /cdn-cgi /icons /img /images /assets /static /fonts /css /js /favicon.ico
    /manifest.webmanifest /manifest.json /site.webmanifest /apple-touch-icon.png""".split()
)
# First path segments of account and utility pages; path parts of listings; pagination parts; names of a root and of searches.
UTILITY_SEGMENTS = (
    "s", "o", "user", "users", "account", "accounts", "auth", "login", "logout", "register", "version", "settings", "admin",
    "moderation", "member", "members", "help", "support", "info", "list", "rss", "feeds", "embed", "widget",
)
LISTING_PARTS = ("/category/", "/tag/", "/model/", "/actor/", "/videos/", "/search/", "/tags/", "/models/", "/actors/")
PAGE_PARTS = ("/page/", "/p/", "/pg/")
ROOT_PATHS = ("/", "/index.html", "/index.php")
SEARCH_SEGMENTS = ("search", "query", "results", "find")
# Shapes of a site's pages about a subject: {base} is the site, {subject} the encoded subject.
SITE_TEMPLATES = (
    "{base}/?f_search={subject}", "{base}/posts?tags={subject}", "{base}/tags/{subject}", "{base}/m/{subject}", "{base}/user/{subject}",
    "{base}/search/{subject}", "{base}/search?q={subject}", "{base}/?s={subject}", "{base}/t/{subject}", "{base}/category/{subject}",
)
# What log lines are told by.
FETCH_LINES = ("http request: get", "fetching page", "routing ")
LOG_IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".gif")
LOG_VIDEOS = (".mp4", ".webm", ".mkv", ".ogv")
LOG_FETCHED_FILES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".mp4", ".webm", ".mkv")
LOG_ERRORS = ("429", "ERROR", "FAILED", "EXCEPTION", "TIMEOUT")
