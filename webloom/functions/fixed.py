"""Results depend on exactly these lists, so they are stated as they are."""

# Path extensions of pages; no extension counts as one.
PAGE_EXTENSIONS = ["", ".html", ".htm", ".xhtml", ".shtml", ".php", ".php3", ".php4", ".php5", ".asp", ".aspx", ".jsp", ".jspx", ".cgi", ".pl", ".do", ".action", ".cfm"]

# Path extensions of assets.
ASSET_EXTENSIONS = [
    ".css", ".js", ".mjs", ".cjs", ".map",
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif", ".svg", ".ico", ".bmp", ".tiff",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".mp4", ".webm", ".ogg", ".ogv", ".mp3", ".wav", ".m4a", ".mov", ".avi",
    ".pdf", ".zip", ".gz", ".tar", ".rar", ".7z", ".doc", ".docx", ".xls", ".xlsx",
    ".ppt", ".pptx", ".csv", ".txt", ".json", ".xml", ".rss", ".atom", ".webmanifest",
]

# Query parameters that only track.
TRACKING = r"(?i)^(utm_[a-z_]+|fbclid|gclid|gclsrc|dclid|msclkid|mc_[a-z]+|_ga|_gl|igshid|yclid|ref_src|ref_url|spm|scm|vero_id|s_kwcid|ttclid|twclid)$"

# Schemes that are never fetched.
SKIP_SCHEMES = ["javascript", "mailto", "tel", "sms", "data", "blob", "about", "file", "ftp", "magnet", "whatsapp", "intent", "market"]

# Second-level labels under which names are registered.
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go"]

# Names that a file must not have, and the longest name in bytes.
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
SEGMENT_BYTES = 90

# Directories of a mirror.
PAGES_DIR, ASSETS_DIR, RAW_DIR = "pages", "assets", "_crawl/raw"

# Extension of an asset by its content type.
TYPE_EXTENSIONS = {
    "text/css": ".css", "text/javascript": ".js", "application/javascript": ".js", "application/x-javascript": ".js",
    "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/avif": ".avif",
    "image/svg+xml": ".svg", "image/x-icon": ".ico", "image/vnd.microsoft.icon": ".ico", "font/woff": ".woff",
    "font/woff2": ".woff2", "font/ttf": ".ttf", "font/otf": ".otf", "application/font-woff": ".woff",
    "application/json": ".json", "application/pdf": ".pdf", "text/plain": ".txt", "text/html": ".html",
    "video/mp4": ".mp4", "audio/mpeg": ".mp3", "image/bmp": ".bmp", "image/tiff": ".tiff",
}

# Attributes that name pages, in the order in which they are looked at.
PAGE_ATTRS = [("a", "href"), ("area", "href"), ("form", "action")]
FRAME_ATTRS = [("iframe", "src"), ("frame", "src")]

# Attributes that name assets.
ASSET_ATTRS = [
    ("img", "src"), ("script", "src"), ("source", "src"), ("video", "src"), ("video", "poster"), ("audio", "src"), ("embed", "src"),
    ("object", "data"), ("track", "src"), ("input", "src"), ("image", "href"), ("image", "xlink:href"), ("use", "href"), ("use", "xlink:href"),
]
SRCSET_ATTRS = [("img", "srcset"), ("source", "srcset")]

# Attributes that hold a lazily loaded source, first one first.
LAZY_SRC = ["data-src", "data-original", "data-lazy-src", "data-echo", "data-url", "data-img"]

# Rel words of links to assets, and of links that stay absolute.
ASSET_RELS = ["stylesheet", "icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon", "manifest", "preload", "prefetch", "modulepreload", "apple-touch-startup-image"]
ABSOLUTE_RELS = ["canonical", "alternate", "dns-prefetch", "preconnect", "author", "license", "search", "pingback", "webmention"]

# Beginnings of content types that are pages.
HTML_TYPES = ["text/html", "application/xhtml", "application/xml", "text/xml"]

# Statuses worth another try, and error texts.
RETRY_STATUSES = [429, 500, 502, 503, 504]
ROBOTS_ERROR, WALL_PREFIX = "blocked by robots.txt", "challenge: "

# Markup that only an interstitial has.
INTERSTITIAL_MARKERS = ["/cdn-cgi/challenge-platform/", "cf-browser-verification", "cf_chl_opt", 'id="challenge-form"', "id='challenge-form'", "cf-challenge-running", "_cf_chl_opt"]

# Numbered errors that deny; 1015 limits the rate, others of the range deny.
ERROR_PATTERN = r"error\s*(?:code[: ]*)?1(0[01][0-9]|02[0-9])\b"
RATE_LIMIT_ERROR = "1015"

# Markup of captcha vendors, first one first.
CAPTCHA_MARKERS = [
    ("challenges.cloudflare.com", "cloudflare-turnstile"), ("cf-turnstile", "cloudflare-turnstile"), ("hcaptcha.com", "hcaptcha"), ("h-captcha", "hcaptcha"),
    ("google.com/recaptcha", "recaptcha"), ("gstatic.com/recaptcha", "recaptcha"), ("g-recaptcha", "recaptcha"), ("geo.captcha-delivery.com", "datadome"),
    ("captcha-delivery.com", "datadome"), ("px-captcha", "perimeterx"), ("_pxhd", "perimeterx"), ("funcaptcha", "arkose"), ("arkoselabs.com", "arkose"),
]
OTHER_VENDORS = ["cloudflare", "akamai", "datadome", "perimeterx", "imperva", "incapsula"]

# Wording of walls; the first eight are clear by themselves.
WALL_PHRASES = [
    "verify you are human", "verifying you are human", "are you a robot", "checking your browser", "checking if the site connection is secure", "just a moment",
    "please enable javascript and cookies", "review the security of your connection", "additional security check is required",
    "unusual traffic from your computer network", "sorry, you have been blocked", "access denied", "attention required",
]
CLEAR_PHRASES = 8
RATE_PHRASES = ["too many requests", "rate limited", "rate limit exceeded", "you are being rate limited", "slow down"]
LOGIN_PHRASES = ["sign in to continue", "log in to continue", "you must be logged in", "please log in to view"]
WALL_TITLES = ["just a moment...", "just a moment", "attention required! | cloudflare"]

# Kinds of walls that a person can clear; characters of a short page, and of a page's scanned part.
CLEARABLE = ["interstitial", "captcha", "login-wall"]
SHORT_TEXT, SCANNED = 2500, 200_000

# Where style sheets and refreshing pages name another file; matched without case.
CSS_URL = r"url\(\s*(['\"]?)([^'\")]+?)\1\s*\)"
CSS_IMPORT = r"@import\s+(?:url\(\s*)?(['\"]?)([^'\")\s;]+)\1\s*\)?"
META_REFRESH = r"^\s*(\d+)\s*;\s*url\s*=\s*(.+?)\s*$"
