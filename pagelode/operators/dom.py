"""Element tables from page HTML, and everything read straight off them."""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import collapse, head, let, spread, top_per_group
from ..session import ship_package, stage, staging_path

_ATTR = r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?"

# What a start tag closes: (start tags, tags it closes, tags that stop the search).
_CLOSES = [
    (R.PARAGRAPH_CLOSERS, ["p"], ["button", "td", "th"]),
    (["li"], ["li"], ["ul", "ol"]),
    (["option"], ["option"], ["select"]),
    (["tr"], ["tr"], ["table"]),
    (["td", "th"], ["td", "th"], ["tr", "table"]),
    (["dt", "dd"], ["dt", "dd"], ["dl"]),
]
_SHUTS = {tag: (set(shut), set(stops)) for tags, shut, stops in _CLOSES for tag in tags}
# Tags that break a line of text, so words on both sides stay apart.
_BREAKS = R.PARAGRAPH_CLOSERS + ["li", "br", "tr", "td", "th", "dt", "dd", "option", "body", "title", "button"]


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# The same patterns for the walk.
_PY_HIDDEN = re.compile(r"(?is)<!--.*?-->|(<(script|style)\b[^>]*>).*?(</\2\s*>)")
_PY_TOKEN = re.compile(r"<[^>]*>|[^<]+|<")
_PY_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_PY_ATTR = re.compile(_ATTR)
_PY_WS = re.compile("[\\t\\n\\x0b\\x0c\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")
_PY_BREAKS = frozenset(_BREAKS)


def unescape(text: Column) -> Column:
    """The named entities of plain text."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|template|title)\b[^>]*>.*?</\1\s*>", " ")
    return collapse(unescape(F.regexp_replace(bare, r"<[^>]*>", " ")))


def _attr(attrs: Column, name: str) -> Column:
    return F.try_element_at(attrs, F.lit(name))


_NODE_SCHEMA = (
    "page_id bigint, url string, pos int, tag string, attrs map<string,string>, depth int, "
    "ancestors array<struct<pos:int,tag:string>>, parent_pos int, landmark string, in_menu boolean, end_pos int, text string")
_LANDMARKS = {"header": "header", "banner": "header", "footer": "footer", "contentinfo": "footer", "nav": "nav",
              "navigation": "nav", "aside": "aside", "complementary": "aside", "main": "main"}
_PAGES_PER_BATCH = 64


def _plain_tag(token: str):
    """What a tag says by itself; None for what is no tag. Tags recur, so short ones are kept (``_known_tag``)."""
    named = _PY_TAG.match(token)
    if named is None:
        return None
    tag = named[2].lower()
    breaks = tag in _PY_BREAKS
    if named[1]:
        return True, tag, breaks, (), (), None, False, None, False
    attrs = {}
    for name, double, single, bare in _PY_ATTR.findall(token[named.end():]):
        attrs.setdefault(name.lower(), _plain(double + single + bare))
    role = attrs.get("role", "").lower()
    landmark = (_LANDMARKS.get(tag if tag not in ("banner", "contentinfo", "navigation", "complementary") else "")
                or _LANDMARKS.get(role if role not in ("header", "footer", "nav", "aside") else ""))
    menu = (role in ("menu", "listbox", "dialog") or attrs.get("aria-modal") == "true"
            or attrs.get("aria-expanded") == "true" or (tag == "dialog" and "open" in attrs))
    leaf = tag in R.VOID_TAGS or token.endswith("/>")
    return False, tag, breaks, tuple(attrs), tuple(attrs.values()), landmark, menu, _SHUTS.get(tag), leaf


_known_tag = lru_cache(maxsize=8192)(_plain_tag)
_KNOWN_CHARS = 256


class _Elements:
    """Columns of the elements of a few pages; ``above`` holds rows of ancestors, ``parent`` -1 where there is none."""

    def __init__(self):
        self.tag, self.names, self.values, self.attrs_end = [], [], [], [0]
        self.depth, self.above, self.parent, self.landmark, self.in_menu, self.end_pos, self.text = ([] for _ in range(7))
        self.pages = []


def _walk(html: str, max_elements: int | None, with_text: bool, out: _Elements) -> None:
    """Appends the elements of one page in document order, by one pass with a stack of open elements."""
    first, tags, end_pos = len(out.tag), out.tag, out.end_pos
    open_rows, open_tags, landmarks, menus = [], [], [None], [False]
    starts, ends, parts, chars, blank = [], [], [], 0, False

    def shut_to(depth: int) -> None:
        at = len(tags) - first
        for row in open_rows[depth:]:
            end_pos[row], ends[row - first] = at, chars
        del open_rows[depth:], open_tags[depth:], landmarks[depth + 1:], menus[depth + 1:]

    for token in _PY_TOKEN.findall(_PY_HIDDEN.sub(lambda m: (m[1] or "") + (m[3] or ""), html)):
        if token[0] != "<":
            if with_text:
                # White space collapses as it comes; a blank on a border belongs to no element's text.
                text = _PY_WS.sub(" ", _plain(token))
                if blank and text[0] == " ":
                    text = text[1:]
                if text:
                    parts.append(text)
                    chars, blank = chars + len(text), text[-1] == " "
            continue
        known = _known_tag(token) if len(token) <= _KNOWN_CHARS else _plain_tag(token)
        if known is None:
            continue
        ending, tag, breaks, names, values, landmark, menu, shuts, leaf = known
        if ending:
            if tag in open_tags:
                shut_to(len(open_tags) - 1 - open_tags[::-1].index(tag))
        elif max_elements is None or len(tags) - first < max_elements:
            if shuts and not shuts[0].isdisjoint(open_tags):
                at = next(i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i] in shuts[0] or open_tags[i] in shuts[1])
                if open_tags[at] in shuts[0]:
                    shut_to(at)
        if breaks and with_text and not blank:
            # Before the element begins and after another has ended.
            parts.append(" ")
            chars, blank = chars + 1, True
        if ending or not (max_elements is None or len(tags) - first < max_elements):
            continue
        row = len(tags)
        tags.append(tag)
        out.names.extend(names)
        out.values.extend(values)
        out.attrs_end.append(len(out.names))
        out.depth.append(len(open_rows))
        out.above.extend(open_rows)
        out.parent.append(open_rows[-1] if open_rows else -1)
        landmark = landmark or landmarks[-1]
        out.landmark.append(landmark)
        out.in_menu.append(menus[-1])
        end_pos.append(row - first + 1)
        starts.append(chars)
        ends.append(chars)
        if not leaf:
            open_rows.append(row)
            open_tags.append(tag)
            landmarks.append(landmark)
            menus.append(menus[-1] or menu)
    shut_to(0)
    out.pages.append(len(tags) - first)
    if with_text:
        page_text = "".join(parts)
        out.text.extend([page_text[start:end].strip(" ") for start, end in zip(starts, ends)])


def _plain(text: str) -> str:
    if "&" in text:
        for entity, char in _ENTITIES:
            text = text.replace(entity, char)
    return text


def dom_nodes(pages: DataFrame, max_elements: int | None = R.MAX_ELEMENTS, with_text: bool = True) -> DataFrame:
    """One row per element in document order.

    Output: page_id, url, pos, tag, attrs, depth, ancestors (pos and tag, outermost
    first), parent_pos, landmark, in_menu, end_pos, text. Questions about elements
    inside others join on an ancestor position, never on all pairs of a page.

    Void tags are never opened, some start tags close an open element, an end tag
    closes through its match or is ignored. The walk is the one step with no
    good built-in form: the same fold as a native ``aggregate`` was measured at more
    than twice the time, so pages pass through an Arrow batch function. Pages are dealt
    over tasks before (``spread``), as a file's splits may leave most of them to one.
    """
    arrow = _arrow_schema()

    def walk(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, _PAGES_PER_BATCH):
                some, out = batch.slice(first, _PAGES_PER_BATCH), _Elements()
                for html in some.column(2).to_pylist():
                    _walk(html or "", max_elements, with_text, out)
                yield _columns(some, out, arrow, with_text)

    ship_package(pages.sparkSession)
    return spread(pages.select("page_id", "url", "html"), "page_id").mapInArrow(walk, _NODE_SCHEMA)


def stored_nodes(pages: DataFrame, max_elements: int | None = R.MAX_ELEMENTS, with_text: bool = True) -> DataFrame:
    """E01 as a table: the element table of ``pages``, walked once and kept bucketed by page.

    For questions that read the elements several times. All elements of a page lie in one bucket, in document order, so
    windows and aggregates within pages need no exchange; with ``spark.sql.requireAllClusterKeysForCoPartition`` off, neither do
    joins of elements of a page. The table lies in the shared folder and goes when the driver's JVM ends.
    """
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"elements_{uuid.uuid4().hex}"
    (dom_nodes(pages, max_elements, with_text).repartition(buckets, "page_id").write.format("parquet").bucketBy(buckets, "page_id")
     .sortBy("page_id", "pos").option("path", staging_path(spark, name)).saveAsTable(name))
    return spark.table(name)


def _columns(pages: pa.RecordBatch, out: _Elements, schema: pa.Schema, with_text: bool) -> pa.RecordBatch:
    """The rows of a few pages; nested columns are put together from flat arrays."""
    counts = np.array(out.pages, np.int64)
    page = np.repeat(np.arange(len(counts)), counts)
    total = len(page)
    pos = (np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    tags, parent, above = pa.array(out.tag, pa.string()), np.array(out.parent, np.int64), np.array(out.above, np.int64)
    depth = np.array(out.depth, np.int32)
    steps = pa.StructArray.from_arrays([pa.array(pos[above]), tags.take(pa.array(above))], fields=list(schema.field("ancestors").type.value_type))
    columns = {
        "page_id": pages.column(0).take(pa.array(page)), "url": pages.column(1).take(pa.array(page)), "pos": pa.array(pos), "tag": tags,
        "attrs": pa.MapArray.from_arrays(pa.array(out.attrs_end, pa.int32()), pa.array(out.names, pa.string()), pa.array(out.values, pa.string())),
        "depth": pa.array(depth),
        "ancestors": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(depth)]).astype(np.int32)), steps),
        "parent_pos": pa.array(pos[parent] if total else pos, mask=parent < 0), "landmark": pa.array(out.landmark, pa.string()),
        "in_menu": pa.array(out.in_menu, pa.bool_()), "end_pos": pa.array(out.end_pos, pa.int32()),
        "text": pa.array(out.text, pa.string()) if with_text else pa.nulls(total, pa.string())}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if columns[f.name].type != f.type else columns[f.name] for f in schema], schema=schema)


def _arrow_schema() -> pa.Schema:
    step = pa.struct([("pos", pa.int32()), ("tag", pa.string())])
    return pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("pos", pa.int32()), ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("depth", pa.int32()), ("ancestors", pa.list_(step)),
        ("parent_pos", pa.int32()), ("landmark", pa.string()), ("in_menu", pa.bool_()), ("end_pos", pa.int32()),
        ("text", pa.string())])


def attr(name: str) -> Column:
    """Attribute of a node row, NULL when absent."""
    return _attr(F.col("attrs"), name)


def has_attr(name: str) -> Column:
    return F.array_contains(F.map_keys("attrs"), name)


def role() -> Column:
    return F.lower(F.coalesce(attr("role"), F.lit("")))


def classes() -> Column:
    return F.filter(F.split(F.coalesce(attr("class"), F.lit("")), R.WS + "+"), lambda c: c != "")


# --- page quality ------------------------------------------------------------------------------


def challenge_pages(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Q01: kind of block page, NULL for a real one; first matching test wins."""
    src, title, cls = (F.coalesce(attr(n), F.lit("")) for n in ("src", "title", "class"))
    flags = nodes.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("elements"),
        F.bool_or(((F.col("tag") == "iframe") & src.contains("challenges.cloudflare.com"))
                  | F.coalesce(attr("id"), F.lit("")).isin("challenge-running", "cf-challenge-running")
                  | (cls.contains("cf-") & F.lower(cls).contains("challenge"))).alias("has_cloudflare"),
        F.bool_or(((F.col("tag") == "iframe") & (src.contains("recaptcha") | src.contains("hcaptcha")
                                                 | F.lower(title).contains("captcha")))
                  | F.array_contains(classes(), "g-recaptcha") | F.array_contains(classes(), "h-captcha")).alias("has_captcha"))
    texts = pages.select("page_id", "url", head(visible_text(F.col("html")), R.CHALLENGE_CHARS).alias("body_text"))
    text = F.col("body_text")
    t = R.CHALLENGE_TEXT
    kind = (
        F.when(F.col("has_cloudflare") | text.rlike(t["cloudflare"]), "cloudflare")
        .when(F.col("has_captcha") | text.rlike(t["captcha"]), "captcha")
        .when(text.rlike(t["compat"]), "compat").when(text.rlike(t["access"]) | text.rlike(t["shell"]), "access")
        .when((F.col("elements") < R.THIN_ELEMENTS)
              & (F.length(F.regexp_replace(text, R.WS + "+", "")) < R.THIN_CHARS), "thin"))
    return texts.join(flags, "page_id", "left").fillna({"elements": 0, "has_cloudflare": False, "has_captcha": False}).select(
        "page_id", "url", kind.alias("kind"), "elements")


def auth_states(nodes: DataFrame) -> DataFrame:
    """Q02: authed, anonymous or unknown per page from its URL and markers."""
    low = lambda n: F.lower(F.coalesce(attr(n), F.lit("")))
    label, test = low("aria-label"), low("data-testid")
    marker = (
        low("href").rlike("logout|signout|sign-out")
        | (F.col("tag").isin("button", "a") & label.contains("account"))
        | ((F.col("tag") == "button") & label.contains("profile"))
        | test.contains("user-menu") | test.contains("avatar")
        | ((F.col("tag") == "img") & low("alt").contains("avatar")) | label.contains("user menu"))
    seen = nodes.groupBy("page_id", "url").agg(
        F.bool_or(marker).alias("marked"),
        F.bool_or((F.col("tag") == "input") & (low("type") == "password")).alias("login_form"))
    return seen.select("page_id", "url", F.when(F.col("url").rlike(R.LOGIN_URL), "anonymous").when(F.col("marked"), "authed")
                       .when(F.col("login_form"), "anonymous").otherwise("unknown").alias("auth_state"))


# --- repeated groups and regions -------------------------------------------------------------------


_TEST_ATTRS = ("data-testid", "data-test", "data-cy")


def _quoted(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def unique_selectors(nodes: DataFrame, wanted: Column) -> DataFrame:
    """The shortest selector of each wanted element: ``page_id, pos, tag, selector``.

    In this order: its id, each test attribute (both only if no other element of the page has the same), and else a chain of
    ``tag:nth-of-type(n)`` steps from the element upwards, which ends as soon as no other element of the page ends in the same
    steps, at an ancestor with an id of its own (written as ``#id``), or at the body.

    Elements are stored once without their text, so the page walk runs once. Every chain is counted under a hash of its steps;
    a chain counted once names its element, so no element is compared with another, and the smallest length wins.
    """
    ident = attr("id")
    names = F.filter(F.array(
        F.struct(F.lit(0).alias("rank"), F.when(ident.rlike(r"^[A-Za-z][\w-]*$"), F.concat(F.lit("#"), ident)).alias("css")),
        *[F.struct(F.lit(i).alias("rank"), F.when(attr(name) != "", F.concat(F.lit(f'[{name}="'), _quoted(attr(name)), F.lit('"]'))).alias("css"))
          for i, name in enumerate(_TEST_ATTRS, 1)]), lambda n: n["css"].isNotNull())
    slim = stage(nodes.select("page_id", "pos", "tag", "parent_pos", F.transform("ancestors", lambda a: a["pos"]).alias("above"),
                              names.alias("names"), wanted.alias("wanted")), "elements")
    own = slim.select("page_id", "pos", F.inline("names")).groupBy("page_id", "css").agg(
        F.count("*").alias("n"), F.min("pos").alias("pos"), F.min("rank").alias("rank")).filter("n = 1")
    own = own.groupBy("page_id", "pos").agg(F.min_by("css", "rank").alias("named"), F.min(F.when(F.col("rank") == 0, F.col("css"))).alias("anchor"))
    nth = F.row_number().over(Window.partitionBy("page_id", "parent_pos", "tag").orderBy("pos"))
    placed = stage(slim.withColumn("nth", nth).filter("tag <> 'html'").join(own, ["page_id", "pos"], "left").select(
        "page_id", "pos", "tag", "wanted", "above", "named", "anchor", F.concat("tag", F.lit(":nth-of-type("), "nth", F.lit(")")).alias("step")), "steps")
    # Nearest first, so that a chain of any length is the head of the list.
    spots = placed.select("page_id", F.col("pos").alias("of"), F.posexplode(F.reverse(F.concat("above", F.array("pos")))).alias("at", "pos"))
    steps = placed.select("page_id", "pos", "step", F.struct("anchor", (F.col("tag") == "body").alias("body")).alias("stop"))
    chains = spots.join(steps, ["page_id", "pos"]).groupBy("page_id", F.col("of").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("at", "step", "stop"))).alias("up"))
    chains = stage(chains, "chains")
    heads = chains.select("page_id", "pos", F.explode(F.transform(F.sequence(F.lit(1), F.size("up")), lambda n: F.struct(
        n.alias("n"), F.xxhash64(n, F.array_join(F.transform(F.slice("up", F.lit(1), n), lambda u: u["step"]), ">")).alias("h")))).alias("head"))
    single = heads.groupBy("page_id", "head.h").agg(
        F.count("*").alias("times"), F.min("pos").alias("pos"), F.min("head.n").alias("n")).filter("times = 1")
    shortest = single.groupBy("page_id", "pos").agg(F.min("n").alias("shortest"))

    def first_where(test) -> Column:
        """1-based place of the first step from the parent on that passes."""
        return F.array_min(F.transform(F.filter("up", lambda u: test(u) & (u["at"] > 0)), lambda u: u["at"] + 1))
    asked = placed.filter("wanted").select("page_id", "pos", "tag", "named")
    told = asked.join(chains, ["page_id", "pos"]).join(shortest, ["page_id", "pos"], "left")
    told = told.withColumns({"anchored": first_where(lambda u: u["stop"]["anchor"].isNotNull()), "whole": F.coalesce(F.array_min(
        F.transform(F.filter("up", lambda u: u["stop"]["body"]), lambda u: u["at"] + 1)), F.size("up"))})
    told = told.withColumn("ends", F.least("shortest", "anchored", "whole"))
    written = F.transform(F.slice("up", F.lit(1), F.col("ends")), lambda u: F.when(
        u["at"] + 1 == F.col("anchored"), u["stop"]["anchor"]).otherwise(u["step"]))
    return told.select("page_id", "pos", "tag", F.coalesce("named", F.array_join(F.reverse(written), ">")).alias("selector"))


def container_selectors(nodes: DataFrame) -> DataFrame:
    """What the parents of dominant groups are called: ``page_id, pos, selector``.

    A unique id, else ``tag[role=...]`` if it is unique, else ``tag.class`` with the first class if at most three elements
    have it, else the tag.
    """
    first = F.get(classes(), F.lit(0))
    role_of, ident = F.nullif(attr("role"), F.lit("")), attr("id")
    names = F.filter(F.array(
        F.struct(F.lit(0).alias("rank"), F.lit(1).alias("most"), F.when(ident.rlike(r"^[A-Za-z][\w-]*$"), F.concat(F.lit("#"), ident)).alias("css")),
        F.struct(F.lit(1).alias("rank"), F.lit(1).alias("most"), F.concat("tag", F.lit('[role="'), role_of, F.lit('"]')).alias("css")),
        F.struct(F.lit(2).alias("rank"), F.lit(3).alias("most"), F.concat("tag", F.lit("."), F.regexp_replace(
            first, r"([^\w-])", r"\\$1")).alias("css"))), lambda n: n["css"].isNotNull())
    # Every class of an element counts for how often a class selector matches.
    matched = F.concat(F.transform(F.filter(names, lambda n: n["rank"] < 2), lambda n: n["css"]), F.transform(F.array_distinct(classes()), lambda c: F.concat(
        "tag", F.lit("."), F.regexp_replace(c, r"([^\w-])", r"\\$1"))))
    slim = stage(nodes.select("page_id", "pos", "parent_pos", "tag", "attrs", names.alias("names"), matched.alias("matched")), "elements")
    groups = dominant_groups(slim).select("page_id", F.col("parent_pos").alias("pos"))
    counts = slim.select("page_id", F.explode("matched").alias("css")).groupBy("page_id", "css").agg(F.count("*").alias("n"))
    parents = slim.join(groups, ["page_id", "pos"])
    usable = parents.select("page_id", "pos", F.inline("names")).join(counts, ["page_id", "css"]).filter(F.col("n") <= F.col("most"))
    best = usable.groupBy("page_id", "pos").agg(F.min_by("css", "rank").alias("css"))
    return parents.join(best, ["page_id", "pos"], "left").select("page_id", "pos", F.coalesce("css", "tag").alias("selector"))


def child_signature() -> Column:
    return F.concat_ws("|", "tag", F.coalesce(attr("role"), F.lit("")),
                       F.array_join(F.array_sort(classes()), "."))


def dominant_groups(nodes: DataFrame) -> DataFrame:
    """Largest group of like children per page: parent_pos, signature, items."""
    parents = nodes.filter(F.col("tag").isin(*R.LISTING_PARENT_TAGS) | role().isin(*R.LISTING_PARENT_ROLES)).select(
        "page_id", F.col("pos").alias("parent_pos"))
    groups = (
        nodes.filter("parent_pos is not null").withColumn("signature", child_signature())
        .groupBy("page_id", "parent_pos", "signature").agg(F.count(F.lit(1)).alias("items"), F.min("pos").alias("first_pos"))
        .filter(F.col("items") >= R.LISTING_MIN_ITEMS).join(parents, ["page_id", "parent_pos"], "left_semi"))
    # Most items; then the earlier parent; then the group that starts first.
    return groups.groupBy("page_id").agg(F.max_by(
        F.struct("parent_pos", "signature", "items"),
        F.struct("items", -F.col("parent_pos"), -F.col("first_pos"))).alias("g")).select("page_id", "g.*")


def listing_rows(nodes: DataFrame) -> DataFrame:
    """One row per item of the page's dominant group: row_no, fields, href."""
    best = dominant_groups(nodes)
    items = (
        nodes.filter("parent_pos is not null").withColumn("signature", child_signature())
        .join(best.select("page_id", "parent_pos", "signature"), ["page_id", "parent_pos", "signature"]))
    items = top_per_group(items, ["page_id"], [F.col("pos")], R.LISTING_MAX_ROWS, "row_no")
    items = items.select("page_id", "url", "row_no", F.col("pos").alias("item_pos"),
                         F.col("attrs").alias("item_attrs"), F.col("text").alias("item_text"))
    cls = F.lower(F.coalesce(attr("class"), F.lit("")))
    kind = F.array_compact(F.array(
        F.when((F.col("tag") == "a") & has_attr("href"), "link"),
        F.when(F.col("tag").rlike("^h[1-6]$") | (role() == "heading"), "title"),
        F.when((F.col("tag") == "time") | has_attr("datetime"), "date"),
        F.when((attr("itemprop") == "author") | (attr("rel") == "author") | cls.contains("author") | cls.contains("owner"), "author")))
    marks = nodes.select("page_id", "pos", "text", attr("href").alias("h"), attr("datetime").alias("dt"), "ancestors",
                         F.explode(kind).alias("k")).withColumn("item_pos", F.explode(F.concat(
                             F.transform("ancestors", lambda a: a["pos"]), F.when(F.col("k") == "link", F.array("pos")).otherwise(
                                 F.array().cast("array<int>"))))).drop("ancestors")
    inside = items.select("page_id", "row_no", "item_pos").join(marks, ["page_id", "item_pos"])
    first = inside.groupBy("page_id", "row_no").agg(
        F.min_by(F.struct("h", "text"), F.when(F.col("k") == "link", F.col("pos"))).alias("link"),
        F.min_by("text", F.when(F.col("k") == "title", F.col("pos"))).alias("title"),
        F.min_by(F.coalesce(F.nullif("dt", F.lit("")), "text"), F.when(F.col("k") == "date", F.col("pos"))).alias("date"),
        F.min_by("text", F.when(F.col("k") == "author", F.col("pos"))).alias("author"))
    rows = items.join(first, ["page_id", "row_no"], "left")
    cap = lambda c: F.nullif(head(c, R.LISTING_MAX_CHARS), F.lit(""))
    link_text = F.when(~F.col("link.text").eqNullSafe(F.nullif("title", F.lit(""))), F.col("link.text"))
    named = F.map_filter(F.create_map(
        F.lit("title"), cap(F.col("title")), F.lit("link"), cap(link_text), F.lit("date"), cap(F.col("date")),
        F.lit("author"), cap(F.col("author"))), lambda k, v: v.isNotNull())
    extra = F.map_filter(F.transform_keys(F.map_filter("item_attrs", lambda k, v: k.startswith("data-") & (v != "")
                         & (F.lit(True) if R.LISTING_MAX_CHARS is None else F.length(v) <= R.LISTING_MAX_CHARS)), lambda k, v: F.substring(k, 6, 1 << 20)), lambda k, v: k != "")
    fields = let(F.struct(named.alias("n"), extra.alias("e")), lambda m: F.map_concat(
        m["n"], F.map_filter(F.transform_values(m["e"], lambda k, v: collapse(v)),
                             lambda k, v: ~F.array_contains(F.map_keys(m["n"]), k))))
    rows = rows.withColumn("fields", fields).withColumn("fields", F.when(
        (F.size("fields") == 0) & (F.col("item_text") != ""), F.create_map(F.lit("text"), head(F.col("item_text"), R.LISTING_MAX_CHARS)))
        .otherwise(F.col("fields"))).withColumn("href", U.href(U.resolve(F.col("url"), F.col("link.h"))))
    kept = rows.filter((F.size("fields") > 0) | F.col("href").isNotNull())
    # A page with too few rows left has no listing.
    enough = kept.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= R.LISTING_MIN_ITEMS)
    return kept.join(enough, "page_id", "left_semi").select("page_id", "url", "row_no", "fields", "href")


def content_tier(nodes: DataFrame) -> DataFrame:
    """Tiers of the content selectors an element matches."""
    cls_text = F.lower(F.coalesce(attr("class"), F.lit("")))
    cls = classes()
    inside_main = F.col("in_main")
    tests = {
        "#readme": attr("id") == "readme", "[data-target=readme]": attr("data-target") == "readme",
        ".markdown-body": F.array_contains(cls, "markdown-body"), ".markdown": F.array_contains(cls, "markdown"),
        "article .prose": F.array_contains(cls, "prose") & F.col("in_article"),
        "[class*=prose]": cls_text.contains("prose"), "[class*=markdown]": cls_text.contains("markdown"),
        "article": F.col("tag") == "article", "main article": (F.col("tag") == "article") & inside_main,
        ".model-card": F.array_contains(cls, "model-card"), ".dataset-card": F.array_contains(cls, "dataset-card"),
    }
    tier = F.coalesce(*[F.when(F.coalesce(tests[s], F.lit(False)), F.lit(i)) for i, s in enumerate(R.CONTENT_SELECTORS)])
    return nodes.withColumn("tier", tier).filter("tier is not null")


def main_content(nodes: DataFrame) -> DataFrame:
    """Main text region of a page: best score within the first tier that has one."""
    inside = lambda tag: F.exists("ancestors", lambda a: a["tag"] == tag)
    flagged = nodes.withColumns({"in_article": inside("article"), "in_main": inside("main")})
    regions = content_tier(flagged).filter(F.length("text") >= R.CONTENT_MIN_CHARS).select("page_id", "url", "pos", "tier", "text")
    parts = nodes.filter(F.col("tag").isin(*R.CONTENT_STRUCTURE_TAGS)).select(
        "page_id", F.explode(F.transform("ancestors", lambda a: a["pos"])).alias("pos")).groupBy("page_id", "pos").agg(
        F.count(F.lit(1)).alias("structure"))
    scored = regions.join(parts, ["page_id", "pos"], "left").withColumn(
        "score", F.length("text") + R.CONTENT_STRUCTURE_WEIGHT * F.coalesce("structure", F.lit(0)))
    best = scored.groupBy("page_id", "url").agg(F.min_by(
        F.struct("tier", "pos", "score", "text"), F.struct(F.col("tier"), -F.col("score"), F.col("pos"))).alias("r"))
    names = F.array(*[F.lit(s) for s in R.CONTENT_SELECTORS])
    return best.select("page_id", "url", F.get(names, F.col("r.tier")).alias("selector"), "r.pos", "r.score",
                       head(F.col("r.text"), R.CONTENT_MAX_CHARS).alias("text"))
