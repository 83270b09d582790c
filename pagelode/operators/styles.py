"""Assets, fonts, design tokens, type scales, style states and layout boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import first_items, first_rows, lookup, once, position_in, strip, rank_all, top_per_group


# --- assets -----------------------------------------------------------------------------------


def _base_name(url: Column) -> Column:
    return F.substring_index(F.coalesce(U.pathname(url), F.lit("")), "/", -1)


def _extension(name: Column) -> Column:
    """Lower-case extension with its dot; a leading dot is no extension."""
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1))


def _media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def asset_category(media: Column, ext: Column) -> Column:
    return (
        F.when(media.startswith("font/") | media.startswith("application/font") | ext.isin(*R.FONT_EXTS), "fonts")
        .when((media == "image/svg+xml") | (ext == ".svg"), "svg")
        .when(media.startswith("image/") | ext.isin(*R.IMAGE_EXTS), "images")
        .when((media == "text/css") | (ext == ".css"), "css")
        .when(media.contains("javascript") | media.contains("ecmascript") | ext.isin(*R.SCRIPT_EXTS), "js"))


def assets(responses: DataFrame, max_bytes: int | None = R.MAX_ASSET_BYTES, mode: str = "web") -> DataFrame:
    """Saved assets: category, file name and size, first response per URL.

    ``responses`` is (url, content_type, bytes, seq). The first response of a URL
    decides, also when it is then dropped for its kind or size.
    """
    first = responses.filter(F.col("url").rlike("(?i)^https?://")).groupBy("url").agg(
        F.min_by(F.struct("content_type", "bytes", "seq"), F.col("seq")).alias("r")).select("url", "r.*")
    known = R.FONT_EXTS + R.IMAGE_EXTS + R.SCRIPT_EXTS + [".svg", ".css"]
    # Each of these is read in many places below, and a URL is parsed for it.
    named = once(once(first, base=_base_name(F.col("url")), media=_media_type(F.col("content_type"))), url_ext=_extension(F.col("base"))).withColumn(
        "category", asset_category(F.col("media"), F.col("url_ext"))).filter(F.col("category").isNotNull())
    if max_bytes is not None:
        named = named.filter(F.col("bytes") <= max_bytes)
    by_type = F.coalesce(lookup(F.col("media"), R.EXT_BY_MEDIA_TYPE),
                         F.when(F.col("media").rlike("^font/."), F.concat(F.lit("."), F.substring("media", 6, 100))),
                         F.when(F.col("media").rlike("^image/[a-z0-9]+$"), F.concat(F.lit("."), F.substring("media", 7, 100))), F.lit(".bin"))
    stem = F.regexp_replace(F.lower(F.regexp_replace("base", r"(?<=.)\.[^.]*$", "")), r"[^a-z0-9._-]", "-")
    stem = F.substring(F.regexp_replace(F.regexp_replace(stem, "-+", "-"), r"^[-.]+|[-.]+$", ""), 1, 40)
    slug = F.coalesce(F.nullif(stem, F.lit("")), F.lit("asset"))
    file = F.concat(F.lit(f"{mode}/assets/"), "category", F.lit("/"), slug, F.lit("-"), F.sha1("url"),
                    F.when(F.col("url_ext").isin(*known), F.col("url_ext")).otherwise(by_type))
    return named.select("url", "content_type", "bytes", "category", file.alias("file"), "seq")


def _no_comments(css: Column) -> Column:
    return F.regexp_replace(css, r"(?s)/\*.*?\*/", "")


def font_faces(sheets: DataFrame) -> DataFrame:
    """@font-face rules of style sheets (url, css, seq), one row per source URL."""
    blocks = first_items(F.regexp_extract_all(_no_comments(F.col("css")), F.lit(r"(?i)@font-face\s*\{([^}]*)\}"), F.lit(1)), R.MAX_FONT_FACES)
    rules = sheets.select("url", "seq", F.posexplode(blocks).alias("rule_no", "body"))
    value = lambda prop: F.nullif(strip(F.regexp_extract("body", rf"(?i){prop}\s*:\s*([^;]+)", 1)), F.lit(""))
    refs = F.regexp_extract_all(F.regexp_extract("body", r"(?i)src\s*:\s*([^;]+)", 1),
                                F.lit(r"(?i)url\(\s*(['\"]?)([^'\")]+)\1\s*\)"), F.lit(2))
    named = (
        rules.select("url", "seq", "rule_no", F.regexp_replace(value("font-family"), r"^['\"]|['\"]$", "").alias("family"),
                     value("font-weight").alias("weight"), value("font-style").alias("style"), F.posexplode(refs).alias("src_no", "ref"))
        .withColumn("ref", strip(F.col("ref"))).filter("ref <> '' and not startswith(ref, 'data:')"))
    return once(named, src_url=U.href(U.resolve(F.col("url"), F.col("ref")))).select(
        "seq", "rule_no", "src_no", "family", "weight", "style", "src_url")


def link_fonts(saved: DataFrame, faces: DataFrame) -> DataFrame:
    """Font files with the descriptor of the first rule that names them."""
    first = faces.groupBy("src_url").agg(F.min_by(F.struct("family", "weight", "style"), F.struct("seq", "rule_no", "src_no")).alias("d"))
    fonts = saved.filter("category = 'fonts'")
    return fonts.join(first, fonts["url"] == first["src_url"], "left").select(
        "url", "file", F.col("d.family").alias("family"), F.col("d.weight").alias("weight"), F.col("d.style").alias("style"))


# --- tokens -----------------------------------------------------------------------------------------


def token_values(rows: DataFrame) -> DataFrame:
    """Style values that carry a signal, one row each: page_id, category, value.

    ``rows`` holds one element per row: color, background, border_width,
    border_color, radius, shadow, spacing, font_family, font_size.
    """
    one = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("category"), v.alias("value")))
    width = F.coalesce(F.regexp_extract("border_width", r"^\s*([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    pairs = F.concat(
        one("colors", F.array("color")), one("backgrounds", F.array("background")),
        one("borderColors", F.array(F.when(width > 0, F.col("border_color")))),
        one("radii", F.array("radius")), one("shadows", F.array("shadow")),
        one("spacing", F.split(F.coalesce("spacing", F.lit("")), r"\s+")),
        one("fonts", F.array(strip(F.regexp_replace(F.substring_index("font_family", ",", 1), "['\"]", "")))),
        one("fontSizes", F.array("font_size")))
    return (
        rows.select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.category", F.trim("p.value").alias("value"))
        .filter(F.col("value").isNotNull() & ~F.col("value").isin(*R.TOKEN_NOISE)))


def token_tally(values: DataFrame) -> DataFrame:
    """Tallies per page: page_id, category, value, n."""
    return values.groupBy("page_id", "category", "value").agg(F.count(F.lit(1)).alias("n"))


def ranked_tokens(values: DataFrame, capped: bool = False) -> DataFrame:
    """Values of a category over all pages, most used first; ``capped`` keeps each category's first few.

    Counting goes straight to (category, value), where partial counts on the map
    side leave little to shuffle; a tally per page is not needed for the totals.
    With ``capped``, the window sees distinct values only, cut by rank before the shuffle; without, values are numbered in
    ranges, so that a category is not one task.
    """
    totals = values.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))
    caps = lookup(F.col("category"), {c: t[1] for c, t in R.TOKEN_CATEGORIES.items()})
    most = max(t[1] for t in R.TOKEN_CATEGORIES.values()) if capped else None
    order = [F.desc("n"), F.col("value")]
    ranked = top_per_group(totals, ["category"], order, most) if capped else rank_all(totals, ["category"], order)
    return ranked.filter(F.col("rank") <= caps) if capped else ranked


def css_variables(sheets: DataFrame) -> DataFrame:
    """Custom properties per page: scope, name, value, distinct and in order.

    ``sheets`` is (page_id, seq, css).
    """
    blocks = F.regexp_extract_all(_no_comments(F.col("css")), F.lit(r"([^{}]*)\{([^{}]*)\}"), F.lit(0))
    rules = sheets.select("page_id", "seq", F.posexplode(blocks).alias("rule_no", "rule"))
    scope = strip(F.regexp_extract("rule", r"^([^{}]*)\{", 1))
    decls = F.split(F.regexp_extract("rule", r"\{([^{}]*)\}", 1), ";")
    rows = rules.filter(~strip(F.col("rule")).startswith("@")).select(
        "page_id", "seq", "rule_no", F.coalesce(F.nullif(scope, F.lit("")), F.lit(":root")).alias("scope"), F.posexplode(decls).alias("decl_no", "d"))
    rows = rows.select("page_id", "scope", F.struct("seq", "rule_no", "decl_no").alias("place"),
                       strip(F.regexp_extract("d", r"^([^:]*):", 1)).alias("name"), strip(F.regexp_extract("d", r"^[^:]*:(.*)$", 1)).alias("value"))
    rows = rows.filter("startswith(name, '--') and value <> ''").groupBy("page_id", "scope", "name", "value").agg(F.min("place").alias("place"))
    return top_per_group(rows, ["page_id"], [F.col("place")], R.MAX_CSS_VARS, "var_no")


def canonical_variables(found: DataFrame) -> DataFrame:
    """Per name the most frequent value over pages, ties by value."""
    counts = found.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"), F.max("n").alias("n"))


def scoped_variables(found: DataFrame) -> DataFrame:
    """Last value of a name per scope, in page order."""
    return found.groupBy("name", "scope").agg(F.max_by("value", F.struct("page_id", "var_no")).alias("value"))


# --- typography ----------------------------------------------------------------------------------------


def page_samples(samples: DataFrame) -> DataFrame:
    """First twelve samples per role and page, in row order ``seq``."""
    return top_per_group(samples, ["page_id", "role"], [F.col("seq")], R.MAX_TYPE_SAMPLES, "sample_no")


def font_families(samples: DataFrame) -> DataFrame:
    """Families by use, with the body and the mono family marked."""
    first = strip(F.regexp_replace(F.substring_index("family", ",", 1), "[\"']", ""))
    totals = samples.groupBy(first.alias("family")).agg(F.count(F.lit(1)).alias("n")).filter("family <> ''")
    mono = F.col("family").rlike(R.MONO_FAMILY)
    place = F.struct(-F.col("n"), F.col("family"))
    best = totals.agg(F.min_by("family", F.when(mono, place)).alias("mono_family"),
                      F.coalesce(F.min_by("family", F.when(~mono, place)), F.min_by("family", place)).alias("body_family"))
    return totals.join(best).select("family", "n", (F.col("family") == F.col("body_family")).alias("is_body"),
                                    F.col("family").eqNullSafe(F.col("mono_family")).alias("is_mono"))


def text_colors(samples: DataFrame) -> DataFrame:
    """Twelve most used text colours."""
    counts = samples.filter("color <> ''").groupBy("color").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counts, [F.desc("n"), "color"], R.MAX_TEXT_COLORS)


def type_scale(samples: DataFrame) -> DataFrame:
    """Per role the most frequent size, weight, line height and spacing; ties to the larger size."""
    keys = ["role", "size", "weight", "line_height", "spacing"]
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    px = F.coalesce(F.regexp_extract("size", r"^\s*([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    best = counts.groupBy("role").agg(F.min_by(F.struct(*keys[1:], "n"), F.struct(-F.col("n"), -px, F.col("seq"))).alias("b"))
    named = best.select(F.when(F.col("role") == "p", "body").otherwise(F.col("role")).alias("role"), "b.*")
    return named.withColumn("role_order", position_in(F.col("role"), R.TYPE_ROLES))


# --- states and boxes -------------------------------------------------------------------------------------


def style_delta(snapshots: DataFrame, resting: str = "rest") -> DataFrame:
    """Tracked properties that differ between the resting and another state."""
    tracked = snapshots.filter(F.col("prop").isin(*R.STATE_PROPS))
    rest = tracked.filter(F.col("state") == resting).select("page_id", "selector", "prop", F.col("value").alias("from_value"))
    other = tracked.filter(F.col("state") != resting).withColumnRenamed("value", "to_value")
    return other.join(rest, ["page_id", "selector", "prop"]).filter("from_value <> to_value")


def layout_boxes(elements: DataFrame) -> DataFrame:
    """Up to 40 boxes per page: landmarks and headings in order, then the largest containers.

    ``elements`` is (page_id, pos, tag, role, class, x, y, width, height, box), and ``seq`` if positions may repeat: then
    boxes of one place come in its order, and else by their geometry, so that a rerun numbers them alike.
    """
    ties = [F.col(c) for c in ("seq", "tag", "x", "y", "width", "height") if c in elements.columns]
    cls = F.lower(F.coalesce("class", F.lit("")))
    tier = F.when(F.col("tag").isin(*R.LANDMARK_TAGS) | F.coalesce(F.col("role").isin(*R.LANDMARK_ROLES), F.lit(False)), 0).when(
        F.col("tag").isin("div", "ul", "ol", "article") | cls.contains("card") | cls.contains("container"), 1)
    area = F.col("width") * F.col("height")
    visible = elements.withColumn("tier", tier).filter("tier is not null and width > 0 and height > 0")
    picked = top_per_group(visible, ["page_id"], [F.col("tier"), F.when(F.col("tier") == 1, -area).otherwise(F.lit(0.0)), F.col("pos"), *ties],
                           R.MAX_BOXES, "box_no")
    tenth = lambda c: F.floor(F.col(c) * 10 + 0.5) / 10.0
    kept = F.map_filter("box", lambda k, v: k.isin(*R.BOX_PROPS) & v.isNotNull() & ~v.isin(*R.BOX_NOISE))
    return picked.select("page_id", "box_no", "pos", "tag", *[tenth(c).alias(c) for c in ("x", "y", "width", "height")], kept.alias("box"))


