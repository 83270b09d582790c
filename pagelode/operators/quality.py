"""how well pages were captured, and pages that say "not found" under a good status."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import urls as U
from ..functions.core import collapse
from ..functions.graph import components
from ..functions.redact import stabilize_text
from ..session import stage
from .dom import visible_text

#: Fingerprints this many bits apart or fewer are near. Of six bands, a near pair shares three at least.
BITS, NEAR = 64, 3
BANDS = [(0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64)]
#: A near text on at least so many pages of a host, and on this share of them, counts as a stock answer.
STOCK_PAGES, STOCK_SHARE = 3, 0.1
#: What each finding takes off a score of 1.
FINDINGS = {"blank": 0.6, "thin": 0.3, "no_landmark": 0.1, "not_found": 0.5, "copy": 0.3}


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, title, text``: visible text with counts and relative times masked; empty for what is null."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", F.coalesce(U.host(F.col("url")), F.lit("")).alias("host"),
                        collapse(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
                        stabilize_text(visible_text(html)).alias("text"))


def _says_not_found() -> Column:
    return F.col("title").rlike(R.NOT_FOUND_TEXT) | ((F.length("text") < R.THIN_CHARS) & F.col("text").rlike(R.NOT_FOUND_TEXT))


def capture_quality(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Score of each page: ``page_id, url, chars, elements, copies, host_pages, score, findings``.

    ``copies`` counts the host's pages with exactly this text. The score is 1 less what the findings take: ``blank`` (next to
    no text), ``thin`` (few elements and little text), ``no_landmark`` (no main region), ``not_found`` (the title, or all of
    a short text, says so) and ``copy`` (a stock text, see ``STOCK_PAGES``). Copies are counted per host and digest and
    joined back, so a text on a third of all pages costs one row per task.
    """
    # The text's only white space is single blanks; texts are made once, and what is asked of them is kept.
    texts = stage(page_texts(pages).select("page_id", "url", "host", F.md5("text").alias("digest"), F.length(F.translate("text", " ", "")).alias(
        "chars"), _says_not_found().alias("says_not_found")), "quality-texts")
    built = nodes.groupBy("page_id").agg(F.count("*").alias("elements"), F.bool_or(F.col("landmark") == "main").alias("has_main"))
    per_text = texts.groupBy("host", "digest").agg(F.count("*").alias("copies"))
    per_host = per_text.groupBy("host").agg(F.sum("copies").alias("host_pages"))
    joined = (texts.join(per_text.join(per_host, "host"), ["host", "digest"])
              .join(built, "page_id", "left").fillna({"elements": 0, "has_main": False}))
    chars = F.col("chars")
    tests = {"blank": chars < R.BLANK_CHARS, "thin": (F.col("elements") < R.THIN_ELEMENTS) & (chars < R.THIN_CHARS),
             "no_landmark": ~F.col("has_main"), "not_found": F.col("says_not_found"),
             "copy": (F.col("copies") >= STOCK_PAGES) & (F.col("copies") >= STOCK_SHARE * F.col("host_pages"))}
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    taken = sum((F.when(test, F.lit(round(100 * FINDINGS[name]))).otherwise(0) for name, test in tests.items()), F.lit(0))
    return joined.select("page_id", "url", "chars", "elements", "copies", "host_pages",
                         (F.greatest(100 - taken, F.lit(0)) / 100).alias("score"), F.array_join(found, ", ").alias("findings"))


def fingerprints(texts: DataFrame) -> DataFrame:
    """SimHash of each text by its words and word pairs: ``id, print``; a text without words has the print 0."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}{}]+"), lambda w: w != "")
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice(
        "words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    hashed = texts.select("id", words.alias("words")).select("id", F.explode_outer(F.concat("words", pairs)).alias("w")).select(
        "id", F.when(F.col("w").isNotNull(), F.xxhash64("w")).alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"v{i}") for i in range(BITS)]
    summed = hashed.groupBy("id").agg(*votes)
    bits = sum((F.when(F.col(f"v{i}") > 0, F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long")).otherwise(
        F.lit(0).cast("long")) for i in range(1, BITS)), F.when(F.col("v0") > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select("id", bits.alias("print"))


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def near_links(prints: DataFrame) -> DataFrame:
    """All pairs ``a, b`` of ``prints (id, host, print)`` of one host within ``NEAR`` bits; fingerprints of a host are distinct.

    Pairs meet where three bands of six, so some 32 bits, are equal: few that are not near do, and no near pair is missed.
    """
    masks = [_long(sum((1 << high) - (1 << low) for low, high in kept)) for kept in combinations(BANDS, len(BANDS) - NEAR)]
    keyed = prints.select("id", "host", "print", F.inline(F.array(*[F.struct(F.lit(i).alias("bands"), F.col("print").bitwiseAND(
        F.lit(mask).cast("long")).alias("part")) for i, mask in enumerate(masks)])))
    other = keyed.select("host", "bands", "part", F.col("id").alias("b"), F.col("print").alias("other"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= NEAR
    return keyed.join(other, ["host", "bands", "part"]).filter((F.col("id") < F.col("b")) & near).select(F.col("id").alias("a"), "b").distinct()


def soft_404(pages: DataFrame) -> DataFrame:
    """Pages of one stock text per host: ``page_id, url, stock_id, near, host_pages, says_not_found, soft_404``.

    Distinct texts of a host become fingerprints; those within ``NEAR`` bits are linked, and connected ones are one stock text,
    named by its smallest page. ``near`` counts its pages. A page is a soft 404 when its stock text is on ``STOCK_PAGES`` pages
    and ``STOCK_SHARE`` of its host, or when it says itself that nothing was found. Equal texts, and then equal fingerprints,
    are one from the start, so a stock answer on most pages is one row.
    """
    texts = stage(page_texts(pages).withColumn("digest", F.md5("text")), "stock-pages")
    distinct = stage(texts.groupBy("host", "digest").agg(
        F.min("page_id").alias("id"), F.count("*").alias("pages"), F.first("text").alias("text")), "stock-texts")
    printed = stage(fingerprints(distinct).join(distinct.select("id", "host", "digest", "pages"), "id"), "stock-prints")
    prints = stage(printed.groupBy("host", "print").agg(F.min("id").alias("id")), "stock-kinds")
    links = stage(near_links(prints), "stock-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = prints.join(components(ends, links), "id", "left").select("host", "print", F.coalesce("label", "id").alias("stock_id"))
    named = printed.join(labels, ["host", "print"]).select("host", "digest", "pages", "stock_id")
    sizes = named.groupBy("stock_id").agg(F.sum("pages").alias("near"))
    hosts = named.groupBy("host").agg(F.sum("pages").alias("host_pages"))
    placed = texts.join(named.join(sizes, "stock_id").join(hosts, "host").drop("pages"), ["host", "digest"])
    stock = (F.col("near") >= STOCK_PAGES) & (F.col("near") >= STOCK_SHARE * F.col("host_pages"))
    return placed.select("page_id", "url", "stock_id", "near", "host_pages", _says_not_found().alias("says_not_found"),
                         (stock | _says_not_found()).alias("soft_404"))
