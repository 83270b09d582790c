"""Word lists, lookup tables, limits and patterns that results depend on.

Everything here is a constant of the data contract. Patterns are written for
Java regular expressions; ``{B}`` marks an ASCII word boundary, because ``\\b``
in Java treats accented letters as word characters.
"""

# ASCII word boundary and the white space set of web text.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# --- fixed values: URLs and names -----------------------------------------
TRACKING_PARAMS = [
    "pvs", "ref", "ref_", "referrer", "source", "gclid", "fbclid", "msclkid",
    "yclid", "mc_cid", "mc_eid", "igshid", "_ga", "_gl", "_hsenc", "_hsmi", "spm",
]
CRAWL_ASSET_EXT = (
    r"(?i)\.(png|jpe?g|gif|svg|webp|ico|css|js|mjs|json|xml|zip|gz|tar|pdf|mp4|webm"
    r"|mp3|wav|woff2?|ttf|eot|map|txt|rss|atom)$"
)
CALL_ASSET_EXT = (
    r"(?i)\.(css|js|mjs|png|jpg|jpeg|gif|svg|webp|ico|woff|woff2|ttf|eot|map|mp4"
    r"|webm|mp3|wav)$"
)
INDEX_DOCUMENT = r"(?i)/index\.(?:html?|php|aspx?)$"
GENERIC_HOST_LABELS = [
    "www", "app", "apps", "api", "web", "go", "get", "my", "dashboard", "console",
    "account", "accounts", "portal", "admin", "secure", "login", "auth", "sso",
    "dev", "staging", "beta", "try", "use",
]
PAGE_PARAMS = ["page", "p", "offset"]
OFFSET_STEP = 20
SLUG_MAX = None
MAX_SITEMAPS = None

# --- fixed values: redaction and normalisation ------------------------------
REDACTED = "[REDACTED]"
SENSITIVE_HEADERS = [
    "authorization", "proxy-authorization", "cookie", "set-cookie",
    "x-api-key", "x-auth-token", "x-csrf-token", "x-xsrf-token",
]
SENSITIVE_NAME = (
    r"(?i)(token|secret|password|passwd|authorization|api[-_]?key|access[_-]?token"
    r"|refresh[_-]?token|client[_-]?secret|session|credential|bearer)"
)
REDACT_DEPTH = None
MIN_SECRET_CHARS = 12
SECRET_JWT = B + r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}" + B
SECRET_BEARER = B + r"((?i:Bearer|token))" + WS + r"+[A-Za-z0-9._~+/=-]{12,}"
SECRET_PREFIXED = (
    B + r"((sk|pk|rk|api|key|tok)[_-][A-Za-z0-9]{16,}|gh[posu]_[A-Za-z0-9]{20,}"
    r"|xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{12,})" + B
)
SECRET_HEX = B + r"(?i)(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{40,}" + B
SECRET_BASE64 = (
    B + r"(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[0-9])"
    r"[A-Za-z0-9+/_-]{40,}={0,2}" + B
)
SECRET_EMAIL = B + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + B

# (pattern, replacement) pairs; order matters.
VOLATILE_TEXT = [
    (r"(?i)" + B + r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}" + B, "{{UUID}}"),
    (B + r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?" + B, "{{TIMESTAMP}}"),
    (B + r"[\w.+-]+@[\w-]+\.[\w.-]+" + B, "{{EMAIL}}"),
    (r"Bearer" + WS + r"+[A-Za-z0-9._\-]+", "Bearer {{TOKEN}}"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "{{JWT}}"),
    (B + r"(?:sk-|pk-|ghp_|xox[baprs]-)[A-Za-z0-9_-]{10,}" + B, "{{TOKEN}}"),
    (r"(?i)" + B + r"[0-9a-f]{16,}" + B, "{{HEX}}"),
    (B + r"\d{13}" + B, "{{EPOCH}}"),
    (B + r"\d{10}" + B, "{{EPOCH}}"),
]
# Counts and relative times that change while a page stays the same.
VOLATILE_COUNTS = [
    (r"(?i)" + B + r"(?:an?|\d+)" + WS + r"+(?:second|minute|hour|day|week|month|year)s?" + WS + r"+ago" + B, "{{RELATIVE_TIME}}"),
    (r"(?i)" + B + r"in" + WS + r"+(?:an?|\d+)" + WS + r"+(?:second|minute|hour|day|week|month|year)s?" + B, "{{RELATIVE_TIME}}"),
    (r"(?i)" + B + r"(?:just now|yesterday|moments ago)" + B, "{{RELATIVE_TIME}}"),
    (B + r"\d{1,3}(?:,\d{3})+" + B, "{{COUNT}}"),
    (B + r"\d+(?:\.\d+)?[kKmM]" + B, "{{COUNT}}"),
    (r"(?i)" + B + r"\d+(" + WS + r"+(?:likes|downloads|stars|followers|views|comments|results|items|members))" + B, "{{COUNT}}$1"),
]
COUNT_KEY = r"(?i)^(downloads|likes|stars|followers|views|total|count)$|(?i)_count$|Count$"
# Attributes whose value changes on every response.
VOLATILE_ATTRS = ["nonce", "integrity"]

HTML_SECRETS = [
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[REDACTED_JWT]"),
    (B + r"hf_[A-Za-z0-9]{20,}", "[REDACTED_HF_TOKEN]"),
    (B + r"sk-[A-Za-z0-9\-_]{20,}", "[REDACTED_API_KEY]"),
    (B + r"gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED_GITHUB_TOKEN]"),
    (B + r"github_pat_[A-Za-z0-9_]{20,}", "[REDACTED_GITHUB_PAT]"),
    (B + r"AKIA[0-9A-Z]{16}" + B, "[REDACTED_AWS_KEY]"),
    (B + r"AIza[0-9A-Za-z_-]{30,}", "[REDACTED_GOOGLE_KEY]"),
    (B + r"xox[baprs]-[0-9A-Za-z-]{10,}", "[REDACTED_SLACK_TOKEN]"),
    (B + r"Bearer" + WS + r"+[A-Za-z0-9._-]{20,}", "[REDACTED_BEARER]"),
    (r"(?i)(\"(?:api[_-]?key|access[_-]?token|secret|client[_-]?secret|password|refresh[_-]?token)\""
     + WS + r"*:" + WS + r"*\")[^\"]{8,}(\")", "$1[REDACTED_SECRET]$2"),
]

# --- fixed values: network calls ----------------------------------------------
ASSET_RESOURCE_TYPES = [
    "stylesheet", "script", "image", "font", "media", "websocket", "eventsource",
    "manifest", "texttrack",
]
JSON_MIME = r"(?i)(^|/)json|\+json|graphql"
STREAM_MIME = r"(?i)text/event-stream|application/x-ndjson|application/stream\+json"
GRAPHQL = r"(?i)graphql"
GRAPHQL_OPERATION = B + r"(query|mutation|subscription)" + WS + r"+([A-Za-z0-9_]+)"
MAX_BODY_BYTES = None
SAMPLE_CHARS = None
MAX_EXAMPLES = None
MAX_FRAMES = None
MAX_FRAME_CHARS = None
MAX_SOCKETS = None
VOLATILE_QUERY = r"(?i)^(_$|_t$|ts$|t$|cb$|v$|timestamp|nonce|sig|signature|rand)"
STATUS_TEXT = {
    "200": "OK", "201": "Created", "202": "Accepted", "204": "No Content",
    "301": "Moved Permanently", "302": "Found", "304": "Not Modified",
    "400": "Bad Request", "401": "Unauthorized", "403": "Forbidden", "404": "Not Found",
    "409": "Conflict", "422": "Unprocessable Entity", "429": "Too Many Requests",
    "500": "Internal Server Error", "502": "Bad Gateway", "503": "Service Unavailable",
}
ENVELOPE_KEYS = ["data", "items", "results", "rows", "records", "nodes"]
RESHAPE_KEYS = ["data", "items", "results", "rows", "records", "edges", "nodes"]
RECORD_ID_KEYS = ["id", "_id", "slug", "name", "key", "uuid"]
KEPT_RESPONSE_HEADER = (
    r"(?i)^(content-type|link|x-total|x-total-count|x-next-page|x-page|x-per-page"
    r"|x-next-cursor|x-ratelimit-.*|ratelimit-.*|retry-after)$"
)
VOLATILE_BODY_KEY = r"(?i)(created|updated|modified|timestamp|date|expires|time|_at$|At$)"
ISO_DATE_VALUE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$"
FIXED_DATE = "2024-01-01T00:00:00.000Z"
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
SCHEMA_DEPTH = None
SCHEMA_ARRAY_SAMPLE = None
SEGMENT_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SEGMENT_HEX = r"(?i)^[0-9a-f]{12,}$"
SEGMENT_NUMBER = r"^\d+$"
LONG_SEGMENT = 16
SCORE_BASE, SCORE_OPERATION, SCORE_BODY = 1, 100, 50
SCORE_QUERY, SCORE_QUERY_PART, SCORE_GENERIC = 25, 5, 2

# --- fixed values: capture quality ----------------------------------------------
LOGIN_URL = r"(?i)/(login|signin|sign-in|sign_in|auth/login|account/login)(" + B + r"|/|\?|#|$)"
CHALLENGE_TEXT = {
    "cloudflare": r"(?i)just a moment|checking your browser|attention required|cf-browser-verification",
    "captcha": r"(?i)verify you are (a )?human|complete the captcha|unusual traffic from your",
    "compat": r"(?i)not compatible with|unsupported browser|upgrade (your|to a) .{0,20}browser"
              r"|please use a (modern|supported|different) browser",
    "access": r"(?i)access denied|access to this page has been denied|pardon our interruption"
              r"|you (have been|are being) blocked|request blocked|reference #?\d|error[ -]?54\d|akamai",
    "shell": r"(?i)this is embarrassing|we'?re aware of the (issue|problem)|it'?s not you,? it'?s us"
             r"|something went wrong.{0,40}(try again|helpful links)",
}
NOT_FOUND_TEXT = r"(?i)" + B + r"(?:404|not found|does not exist|no longer available|page gone|gone)" + B
BLANK_CHARS = 20
CHALLENGE_CHARS = None
THIN_ELEMENTS = 60
THIN_CHARS = 200
RETRYABLE_ERROR = r"(?i)timeout|timed out|exceeded"
MAX_BACKOFF_MS = 30000

# --- fixed values: page content ----------------------------------------------------
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
]
# A start tag that closes an open paragraph.
PARAGRAPH_CLOSERS = [
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "main", "nav", "ol", "p", "pre", "section", "table", "ul",
]
MAX_ELEMENTS = None
LISTING_PARENT_TAGS = ["ul", "ol", "div", "section", "main", "tbody"]
LISTING_PARENT_ROLES = ["list", "grid", "feed"]
LISTING_MIN_ITEMS = 4
LISTING_MAX_ROWS = None
LISTING_MAX_CHARS = None
# (tier, css selector) of main-content regions, best first.
CONTENT_SELECTORS = [
    "#readme", "[data-target=readme]", ".markdown-body", ".markdown", "article .prose",
    "[class*=prose]", "[class*=markdown]", "article", "main article", ".model-card",
    ".dataset-card",
]
CONTENT_STRUCTURE_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "pre", "code", "ul", "ol"]
CONTENT_MIN_CHARS = 120
CONTENT_STRUCTURE_WEIGHT = 200
CONTENT_MAX_CHARS = None

ENTITY_TYPES = {
    "models": "model", "model": "model", "datasets": "dataset", "dataset": "dataset",
    "orgs": "org", "org": "org", "organizations": "org", "organization": "org",
    "users": "user", "user": "user", "members": "user", "files": "file", "file": "file",
    "blob": "file", "resolve": "file", "spaces": "space", "space": "space",
    "collections": "collection", "collection": "collection", "papers": "paper",
    "paper": "paper",
}
ENTITY_ID_KEYS = ["id", "_id", "name", "slug", "fullName", "full_name", "modelId", "login"]
RELATION_RULES = [
    (["author", "owner", "createdBy", "created_by", "user", "login"], "author", "user"),
    (["org", "organization", "namespace"], "in-org", "org"),
    (["dataset", "datasets", "trainedOn", "trained_on"], "uses-dataset", "dataset"),
]
# First words of paths that lead to parts of a site and not to what an owner has.
SECTION_WORDS = ["docs", "blog", "api", "index", "main", "tree", "blob", "resolve", "static"]
OWNED_TYPES = ["model", "dataset", "space", "collection", "paper"]
MAX_ENTITY_FIELDS = None
MAX_ENTITY_ITEMS = None
MAX_RELATION_ITEMS = None

FONT_EXTS = [".woff2", ".woff", ".ttf", ".otf", ".eot"]
IMAGE_EXTS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".avif", ".bmp"]
SCRIPT_EXTS = [".js", ".mjs", ".cjs"]
EXT_BY_MEDIA_TYPE = {
    "font/woff2": ".woff2", "font/woff": ".woff", "font/ttf": ".ttf", "font/otf": ".otf",
    "application/font-woff2": ".woff2", "application/font-woff": ".woff",
    "application/vnd.ms-fontobject": ".eot", "application/x-font-ttf": ".ttf",
    "application/x-font-otf": ".otf", "image/svg+xml": ".svg", "image/png": ".png",
    "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/avif": ".avif",
    "image/bmp": ".bmp", "image/x-icon": ".ico", "image/vnd.microsoft.icon": ".ico",
    "text/css": ".css", "application/javascript": ".js", "text/javascript": ".js",
    "application/ecmascript": ".js", "application/x-javascript": ".js",
}
MAX_ASSET_BYTES = None
MAX_STYLESHEET_BYTES = None
MAX_FONT_FACES = None
MAX_CSS_VARS = None

TOKEN_NOISE = ["transparent", "rgba(0, 0, 0, 0)", "none", "0px", "normal", "auto", ""]
# category -> (title, ranked cap, css prefix, css cap)
TOKEN_CATEGORIES = {
    "colors": ("Colors", 24, "color", 16),
    "backgrounds": ("Backgrounds", 24, "bg", 12),
    "borderColors": ("Border colors", 16, "border", 8),
    "fonts": ("Font families", 16, "font", 6),
    "fontSizes": ("Font sizes", 16, "text", 12),
    "spacing": ("Spacing", 16, "space", 12),
    "radii": ("Radii", 16, "radius", 8),
    "shadows": ("Shadows", 16, "shadow", 8),
}
MONO_FAMILY = r"(?i)mono|consolas|menlo|courier|code"
MAX_TEXT_COLORS = None
TYPE_ROLES = ["h1", "h2", "h3", "h4", "h5", "h6", "body", "a", "button", "li", "code"]
MAX_TYPE_SAMPLES = None
STATE_PROPS = [
    "color", "background-color", "border-color", "border-top-color", "border-bottom-color",
    "box-shadow", "outline", "outline-color", "outline-width", "opacity", "transform",
    "text-decoration-line", "text-decoration", "cursor", "filter",
]
MAX_SURFACES = None
MAX_CUSTOM_TAGS = None
MAX_REPRESENTATIVES = None
MAX_BOXES = None
BOX_PROPS = [
    "display", "position", "boxSizing", "margin", "padding", "gap", "rowGap", "columnGap",
    "flexDirection", "flexWrap", "justifyContent", "alignItems", "gridTemplateColumns",
    "gridTemplateRows", "gridAutoFlow", "width", "height", "maxWidth", "zIndex",
    "overflow", "borderRadius",
]
BOX_NOISE = ["", "none", "normal", "auto", "0px", "0px 0px", "0px 0px 0px 0px"]
LANDMARK_TAGS = ["header", "nav", "main", "footer", "aside", "section", "h1", "h2", "h3"]
LANDMARK_ROLES = [
    "banner", "navigation", "main", "contentinfo", "complementary", "search", "region",
]
FILLABLE_KINDS = ["input", "textarea", "searchbox", "textbox", "spinbutton"]
CLICKY_INPUT_TYPES = [
    "checkbox", "radio", "file", "range", "color", "submit", "button", "reset", "image",
]
POPUP_VALUES = ["menu", "listbox", "dialog", "grid", "tree", "true"]
PER_REGION_QUOTA = None
MAX_LABEL = None
MAX_OPTIONS = None

# --- fixed values: trees, actions, tasks ---------------------------------------------
ROOT_ROLES = ["WebArea", "RootWebArea"]
MAX_TREE_NODES = None
MAX_TREE_DEPTH = None
MAX_DIFF_ITEMS = None
HARD_DENY = (
    r"(?i)" + B + r"(log\s?out|sign\s?out|logout|signout|delete\s+account|close\s+account"
    r"|deactivate|pay" + B + r"|payment|checkout|place\s+order|buy\s+now|purchase|billing"
    r"|subscribe" + B + r"|upgrade\s+plan)" + B
)
DESTRUCTIVE = (
    r"(?i)" + B + r"(delete|remove|destroy|discard|reset|revoke|cancel|unsubscribe|archive"
    r"|block|report|flag|send|post" + B + r"|publish|submit|save|confirm|approve|reject|merge"
    r"|transfer|withdraw|leave" + B + r"|disconnect)" + B
)
SEARCH_FORM = r"(?i)" + B + r"(search|filter|find|query|go)" + B
OUTCOME_RANK = {"download": 0, "navigation": 1, "modal": 2, "dom-change": 3}
MAX_BEHAVIORS = None
MAX_NETWORK = None
MAX_DOWNLOAD_BYTES = None
MAX_ACTIONS = None
MAX_ACTIONS_PER_PAGE = None
TASK_ROLES = {
    "link": "link", "button": "button", "tab": "tab", "menuitem": "menuitem",
    "searchbox": "textbox", "textbox": "textbox",
}
MAX_ROUTE_TASKS = None
MAX_COVERAGE_TASKS = None
MAX_DATA_ASSERTIONS = None
MAX_ENTITY_TASKS = None
MAX_LISTING_TASKS = None
MAX_LISTING_TASK_ROWS = None
SALIENT_MIN, SALIENT_MAX = 2, 80
SALIENT_KEYS = [
    "id", "name", "title", "label", "fullName", "displayName", "slug", "author", "modelId",
]
RECORD_KEYS = ["data", "items", "results", "models", "datasets"]
ROW_TAGS = ["li", "article", "tr"]
ROW_ROLES = ["row", "listitem"]
PIXEL_MAX_DELTA = 35215.0
PIXEL_THRESHOLD = 0.1
WORST_ROUTES = 10
