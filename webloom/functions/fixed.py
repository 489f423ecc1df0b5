"""Fixed values that results depend on: marker lists, patterns and lookup tables.

They state a given behaviour and must not be changed for style. Regular expressions are written so that RE2 and
java.util.regex read them alike: white space is spelled out, flags are inline.
"""

from __future__ import annotations

# Page classification markers.
SPA_MARKERS = (
    'id="root"', 'id="app"', 'id="__next"', 'id="__nuxt"', 'id="__gatsby"', 'id="svelte"', "ng-app", "data-reactroot", "data-reactid",
    "data-remix-run", "data-sveltekit", "data-astro-", "<script src", "window.__initial_state__", "__next_data__", "__nuxt__",
    "__sveltekit_data", "window.__remixcontext", "window.__astro", "gatsby-focus-wrapper",
)
BUILDER_MARKERS = ("framerusercontent.com", "webflow.io", "wixsite.com", "squarespace.com/universal")
STORYBOOK_MARKERS = ('id="storybook-root"', 'id="storybook-docs"', "__storybook", "?path=/docs/", "/iframe.html")
WALL_PHRASES = (
    "performing security verification", "verify you are human", "checking your browser", "enable javascript and cookies", "security check",
    "access denied", "request blocked", "the request could not be satisfied", "generated by cloudfront", "configured to block access",
)
CF_STRONG = ("cf-browser-verification", "cf-challenge-running", "/cdn-cgi/challenge-platform/", "_cf_chl_opt", "window._cf_chl_opt")
CF_WEAK = (
    "just a moment", "checking your browser", "attention required", "performance &amp; security by cloudflare",
    "performance & security by cloudflare",
)
ANTI_BOT_MARKERS = (
    "just a moment", "attention required", "cf-browser-verification", "cf-challenge", "checking your browser before accessing",
    "this site is using a security service to protect itself", "ray id", "cloudflare", "blocked by network security",
    "your request has been blocked", "captcha", "access denied",
)
SOFT_BLOCK_STATUS = (401, 403, 404, 405, 406, 410, 412, 429, 451, 500, 503)
#: (vendor, groups): a vendor is found if all markers of one group are there, in this order of vendors.
VENDOR_MARKERS = (
    ("cloudflare", (("challenge-form", "__cf_chl_f_tk="), ("cf-error-code",), ("/cdn-cgi/challenge-platform/",))),
    ("akamai", (("pardon our interruption",),)),
    ("perimeterx", (("window._pxappid =",), ("captcha.px-cdn.net",))),
    ("datadome", (("captcha-delivery.com",),)),
    ("imperva", (("_incapsula_resource",), ("incapsula incident id",))),
    ("sucuri", (("sucuri website firewall",),)),
    ("kasada", (("kpsdk.scriptstart = kpsdk.now()",),)),
    ("cloudfront", (("generated by cloudfront",), ("the request could not be satisfied",))),
)
AKAMAI_REFERENCE = r"Reference #[0-9]+\.[0-9a-f]+\.[0-9]+\.[0-9a-f]+"

# Content types and paths.
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".avif", ".bmp", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp4", ".webm",
    ".mov", ".avi", ".mkv", ".mp3", ".wav", ".ogg", ".m4a", ".flac", ".zip", ".gz", ".tar", ".7z", ".rar", ".bin",
)
TEXT_TYPES = (
    "application/xhtml+xml", "application/xml", "application/json", "application/ld+json", "application/rss+xml", "application/atom+xml",
    "application/pdf",
)
BINARY_TYPES = ("application/octet-stream", "application/zip", "application/gzip", "application/x-tar")
BINARY_FAMILIES = ("image/", "video/", "audio/", "font/")
STATUS_TEXT = {
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout",
    410: "Gone", 429: "Too Many Requests", 451: "Unavailable For Legal Reasons", 500: "Internal Server Error", 502: "Bad Gateway",
    503: "Service Unavailable", 504: "Gateway Timeout",
}

# Blocked request patterns.
BLOCKED_PATTERNS = (
    "*2mdn.net*", "*adobestats.com*", "*adsappier.com*", "*affirm.com*", "*ampproject.org*", "*braintree-api.com*", "*braintreegateway.com*",
    "*chatra.io*", "*convertexperiments.com*", "*doubleclick.net*", "*estorecontent.com*", "*google-analytics.com*", "*googleadservices.com*",
    "*googleapis.com*", "*googlesyndication.com*", "*googletagservices.com*", "*googletagmanager.com*", "*googlevideo.com*", "*gstatic.com*",
    "*facebook.com*", "*lexx.me*", "*paypal.com*", "*paypalobjects.com*", "*pointandplace.com*", "*typekit.net*", "*twitter.com*",
    "*hotjar.com*", "*clarity.ms*", "*analytics.google.com*", "*youtube.com*", "*listrakbi.com*", "*static.cloudflareinsights.com*",
)

# Patterns over markup and markdown.
WS = r"[\t\n\f\r ]"
BODY = r"(?s)<body[^>]*>(.*)</body>"
SCRIPT_BLOCK = r"(?s)<script.*?(?:</script>|\z)"
STYLE_BLOCK = r"(?s)<style.*?(?:</style>|\z)"
ANY_TAG = r"(?s)<[^>]*(?:>|\z)|>"
ANCHOR_HREF = r"""<a[^>]+href=["']([^"']+)["']"""
IMAGE_SRC = r"""<img[^>]+src=["']([^"']+)["']"""
HTTP_URL = r"""(?i)https?://[^\t\n\f\r <>"')\]]+"""
WWW_URL = r"""(?i)www\.[^\t\n\f\r <>"')\]]+"""
EXCLUDED_SCHEME = r"^(?:javascript:|mailto:|data:|tel:|blob:|#)"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HTML_LANG = r"""(?is)<html[^>]*[\t\n\f\r ]lang=["']([^"']*)["']"""
#: Applied in this order; only the last crosses lines.
NOISE_STEPS = (
    r"(?i)<script[^>]*>[^\n]*?</script>",
    r"(?i)<style[^>]*>[^\n]*?</style>",
    r"(?i)<noscript[^>]*>[^\n]*?</noscript>",
    r"(?i)<iframe[^>]*>[^\n]*?</iframe>",
    r"(?i)<svg[^>]*>[^\n]*?</svg>",
    r"""(?i)<img[^>]*src=["']data:[^"']*["'][^>]*>""",
    r"""(?i)(?:https?://|www\.)[^\t\n\f\r <>"']+\.[a-z]{2,}[^\t\n\f\r <>"']*""",
    r"(?si)<button[^>]*>.*?</button>",
)
IMG_TAG = r"(?i)<img[^>]*>"
ANCHOR_PAIR = r"(?i)<a[^>]*>([^\n]*?)</a>"
ANCHOR_OPEN = r"(?i)<a[^>]*>"
EMPTY_BOX = r"(?si)<div[^>]*>[\t\n\f\r ]*</div>|<span[^>]*>[\t\n\f\r ]*</span>"
BLANKS = r"[ \t]{2,}"
BLANK_LINES = r"\n[\t\n\f\r ]*\n[\t\n\f\r ]*\n+"
MARKDOWN_STEPS = (
    r"\[¶?\]\(#[^)]*\)",
    r"¶",
    r" §",
    r"!\[[^\]]*\]\(data:[^)]*\)",
    r"!\[\]\(/\)",
    r"!\[[^\]]*\]\(\)",
    r"!\[([^\]]*)\]\([^)]+\)",
)
MARKDOWN_LINK = r"\[([^\]]+)\]\([^)]+\)"
TOKEN_BREAK = r"[\t\n\x0B\f\r\x{85}\p{Z}\p{P}]+"
ENTITIES = (
    ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#x27;", "'"), ("&#x2F;", "/"),
    ("&nbsp;", " "),
)

# Ranking.
BM25_K1, BM25_B, TITLE_WEIGHT, SNIPPET_WEIGHT = 1.5, 0.75, 2.0, 1.0

# Brand extraction.
SOCIAL_EXCLUDED = (
    "status=", "share=", "intent/tweet", "/status/", "facebook.com/photo", "facebook.com/event", "facebook.com/groups", "facebook.com/plugins",
    "facebook.com/sharer", "instagram.com/explore", "instagram.com/direct", "youtube.com/watch", "youtube.com/playlist", "youtube.com/shorts",
    "tiktok.com/discover", "tiktok.com/tag", "github.com/issues", "github.com/pulls", "github.com/notifications", "github.com/settings",
    "github.com/sponsors", "linkedin.com/feed", "linkedin.com/messaging", "linkedin.com/notifications", "linkedin.com/posts/", "linkedin.com/pulse/",
)
SOCIAL_SELECTORS = (
    "footer a", "header a", ".footer a", ".header a", "[class*='footer'] a", "[class*='social'] a", "[class*='contact'] a", ".social-links a",
    ".social-media a",
)
#: (type, hosts, account patterns on the path without a trailing slash, excluded accounts). Groups of a pattern make the account.
SOCIAL_PLATFORMS = (
    ("linkedin", ("linkedin.com",), (r"(?i)^/(company|in|school|showcase)/([^/]+)",), ()),
    ("x", ("x.com", "twitter.com"), (r"^/([^/]+)",), ("i", "home", "explore", "notifications", "messages", "settings", "search", "compose")),
    ("github", ("github.com",), (r"^/([^/]+)",), ("settings", "issues", "pulls", "notifications", "sponsors", "marketplace")),
    ("discord", ("discord.com",), (r"(?i)^/(invite)/([^/]+)", r"(?i)^/(channels)/([^/]+)(?:/([^/]+))?"), ()),
    ("discord", ("discord.gg",), (r"^/([^/]+)",), ()),
    ("facebook", ("facebook.com",), (r"(?i)^/(pages)/([^/]+)(?:/([^/]+))?", r"^/([^/]+)"), ("groups", "marketplace", "watch", "gaming", "events")),
    ("instagram", ("instagram.com",), (r"^/([^/]+)",), ("explore", "direct", "accounts")),
    ("youtube", ("youtube.com",), (r"(?i)^/(channel|c|user)/([^/]+)", r"^/(@[^/]+)"), ()),
    ("tiktok", ("tiktok.com",), (r"(?i)^/(channel)/([^/]+)", r"^/(@[^/]+)"), ()),
)
BRAND_LINK_WORDS = ("blog", "careers", "contact", "pricing", "privacy", "terms", "login", "signup")
ADDRESS_WORDS = ("address", "footer", "contact", "location")
ADDRESS_FIELDS = (
    ("city", r"(?i)(?:city|town)[:\t\n\f\r ]+([A-Za-z\t\n\f\r ]+?)(?:,|\n|$)"),
    ("country", r"(?i)(?:country|nation)[:\t\n\f\r ]+([A-Za-z\t\n\f\r ]+?)(?:,|\n|$)"),
    ("postal_code", r"(?i)(?:postal|zip|pin)[:\t\n\f\r ]*([0-9A-Za-z\t\n\f\r -]+?)(?:,|\n|$)"),
    ("state_province", r"(?i)(?:state|province)[:\t\n\f\r ]+([A-Za-z\t\n\f\r ]+?)(?:,|\n|$)"),
)
IMAGE_EXTENSIONS = {".svg": "svg", ".ico": "ico", ".webp": "webp", ".avif": "avif", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".gif": "gif"}
IMAGE_TYPES = {
    "image/svg+xml": "svg", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico", "image/webp": "webp", "image/avif": "avif",
    "image/png": "png", "image/jpeg": "jpeg", "image/gif": "gif",
}
#: The CSS named colours of the public CSS Color specification that stand for a plain hue; a longer table is a parameter.
COLOR_NAMES = {
    "000000": "Black", "FFFFFF": "White", "FF0000": "Red", "00FF00": "Lime", "0000FF": "Blue", "FFFF00": "Yellow", "00FFFF": "Aqua",
    "FF00FF": "Magenta", "C0C0C0": "Silver", "808080": "Gray", "800000": "Maroon", "808000": "Olive", "008000": "Green", "800080": "Purple",
    "008080": "Teal", "000080": "Navy", "FFA500": "Orange", "FFC0CB": "Pink", "A52A2A": "Brown", "FFD700": "Gold", "F5F5DC": "Beige",
    "4B0082": "Indigo", "EE82EE": "Violet", "FA8072": "Salmon", "D2691E": "Chocolate", "FF7F50": "Coral", "DC143C": "Crimson",
    "F0E68C": "Khaki", "E6E6FA": "Lavender", "FF6347": "Tomato", "40E0D0": "Turquoise", "F5DEB3": "Wheat", "6A5ACD": "Slate Blue",
    "708090": "Slate Gray", "2E8B57": "Sea Green", "87CEEB": "Sky Blue", "D2B48C": "Tan", "DDA0DD": "Plum", "DA70D6": "Orchid",
    "191970": "Midnight Blue",
}

# Wrappers of noise (class and id phrases, exact tokens, token prefixes, roles).
NOISE_PHRASES = (
    "sidebar", "table-of-contents", "tableofcontents", "infobox", "navbox", "nav-box", "navigation", "breadcrumb", "cookie", "consent", "banner",
    "disqus", "advert", "popup", "modal", "subscribe", "printfooter", "catlinks", "mw-panel", "mw-navigation", "sitesub", "jump-to-nav",
    "mw-editsection", "reflist", "mw-references", "authority-control", "mw-indicators", "sistersitebox", "mbox", "ambox", "ombox", "hatnote",
    "shortdescription", "sphinxsidebar", "sphinxfooter", "copyright", "dropdown", "city-selector", "location-selector", "lang-selector",
    "language-selector", "skip-to", "skip-link", "skiplinks", "promo", "promotional", "widget", "widgets", "site-footer", "site-header",
    "page-footer", "page-header", "global-nav", "global-footer", "global-header", "main-nav", "primary-nav", "secondary-nav", "social-share",
    "social-links", "social-icons", "follow-us", "site-map", "sitemap", "playground", "railway", "up.railway", "external-link", "sharing",
    "share", "follow-btn", "follow-container", "btn-follow", "btn-fab", "like-btn", "article-tags", "article-tags-list", "article-tags-element",
    "tags-link", "option-btn", "btn-share", "sharing-btn", "w-sharing", "expand-extra-info", "extra-content-cta", "main-icon", "icon",
    "fab-label", "icon-xlarge", "icon-large", "i-follow", "i-share", "i-facebook", "i-x", "i-whatsapp", "i-threads", "i-bluesky", "i-linkedin",
    "i-reddit", "i-flipboard", "is-hidden", "article-options", "article-topics", "articleTopics", "articleTopicsRow", "linkButtonRow",
    "reader-comments", "article-reader-comments", "add-comment", "comment-form", "commentForm", "house-rules", "most-read", "most-watched",
    "dont-miss", "don't miss", "taboola", "ez-modal", "modal-", "column-content",
)
NOISE_TOKENS = ("toc", "share", "social", "related", "recommended")
NOISE_PREFIXES = ("ad-", "ads-")
NOISE_ROLES = ("navigation", "banner", "contentinfo", "complementary")
SEMANTIC_TAGS = frozenset(
    "article section main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd p blockquote pre code table thead tbody tr td th strong em b i u figure figcaption picture label form input".split()
)
CONTENT_HINTS = (
    "article", "content", "main", "body", "post", "story", "entry", "markdown", "markdown-body", "readme", "repository-content", "layout-main",
    "articlebody", "question", "answer", "mw-parser-output", "page-content", "text", "prose", "readme", "documentation",
)
PRIORITY_SELECTORS = ("#readme .markdown-body", "#readme", ".markdown-body", ".repository-content", ".Layout-main", "article", "main", '[role="main"]')
SCORED_SELECTORS = (
    "#readme", ".markdown-body", ".repository-content", ".Layout-main", ".post-content", ".article-body", ".entry-content", ".article-content",
    ".post-body", ".story-body", ".content-body", "#main-content", "#article", "#content", ".content", ".main", '[itemprop="articleBody"]',
    '[itemprop="text"]', ".main-page-content", ".js-post-body", ".s-prose", "#question", ".page-content", "#page-content", '[role="article"]',
    ".mw-parser-output", "#mw-content-text", "#bodyContent", ".mw-body-content",
)
INNER_SELECTORS = (
    "#readme", ".markdown-body", ".repository-content", ".Layout-main", ".main-page-content", ".article-content", ".post-content",
    ".entry-content", ".content-body", ".article-body", '[itemprop="articleBody"]', '[itemprop="text"]', ".mw-parser-output", "#mw-content-text",
    "#content", ".content", "article",
)

# Class and id words of the published readability algorithm.
UNLIKELY = r"(?i)-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|foot|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote"
MAYBE = r"(?i)and|article|body|column|main|shadow"
POSITIVE = r"(?i)article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story"
NEGATIVE = r"(?i)hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|foot|footer|footnote|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|tool|widget"
BYLINE = r"(?i)byline|author|dateline|writtenby|p-author"
EMBEDDED_VIDEO = r"(?i)//(www\.)?((dailymotion|youtube|youtube-nocookie|player\.vimeo|v\.qq)\.com|(archive|upload\.wikimedia)\.org|player\.twitch\.tv)"


# Line breaks inside lists of a markdown text, and what they become.
REFLOWED = ((r'":\s*\n+\s*\[', '": ['), (r'"\),\s*\n+\s*\[', '"), ['), (r'",\s*\n+\s*([A-Z])', r'", \1'))
# Metadata names of an article's fields, the first that a page has wins.
ARTICLE_TITLES = ("dc:title", "dcterm:title", "og:title", "weibo:article:title", "weibo:webpage:title", "title", "twitter:title")
ARTICLE_BYLINES = ("dc:creator", "dcterm:creator", "author")
ARTICLE_EXCERPTS = ("dc:description", "dcterm:description", "og:description", "weibo:article:description", "weibo:webpage:description", "description", "twitter:description")
# The forms of those names in a meta element's property and name.
META_PROPERTY = r"(?i)\s*(?:dc|dcterm|og|twitter)\s*:\s*(?:author|creator|description|title|site_name|image\S*)\s*"
META_NAME = r"(?i)^\s*(?:(?:dc|dcterm|og|twitter|weibo:(?:article|webpage))\s*[.:]\s*)?(?:author|creator|description|title|site_name|image)\s*$"
# Parts of class or id, and attributes, of containers of an article's text.
STORY_NAMES = ("story-content", "text-story", "article-body", "story-body", "article-content", "story-page-card", "story-element-card")
STORY_ATTRIBUTES = (("data-test-id", "text"), ("itemprop", "articleBody"))
