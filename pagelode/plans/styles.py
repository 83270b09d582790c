"""Style queries: assets, fonts, tokens, typography, states, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..operators import styles as T
from ..sources import adapters as A
from . import sqltext as S


def _samples(spark, sf):
    """Row order is the full text of the sample, as line items have no key of their own."""
    rows = A.type_samples(spark, sf)
    keys = ["family", "size", "weight", "line_height", "spacing", "color"]
    return rows.withColumn("seq", F.concat_ws("|", "page_id", "role", *keys))


_SAMPLES = ("t0 AS (" + A.select_sql(A.TYPE_SAMPLES, A.LINES_WITH_PARTS_SQL) + "), t AS (SELECT *, page_id || '|' || role || '|' || family || "
            "'|' || size || '|' || weight || '|' || line_height || '|' || spacing || '|' || color AS seq FROM t0), kept AS (SELECT * FROM t)")


def _boxes(spark, sf):
    """Boxes of line items: geometry from quantity, price and dates."""
    lines = A.lines_with_parts(spark, sf)
    return lines.selectExpr(*_BOX, "l_orderkey AS seq").withColumn("box", F.create_map(
        F.lit("display"), F.when(F.col("pos") % 2 == 0, "none").otherwise("flex"), F.lit("gap"), F.col("gap"), F.lit("color"), F.lit("red"),
        F.lit("margin"), F.lit("0px 0px")))


_BOX = [
    "l_suppkey AS page_id", "CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS pos",
    "CASE l_linenumber WHEN 1 THEN 'header' WHEN 2 THEN 'h2' WHEN 3 THEN 'div' WHEN 4 THEN 'span' WHEN 5 THEN 'ul' ELSE 'p' END AS tag",
    "CASE WHEN p_size = 7 THEN 'search' END AS role",
    "CASE WHEN p_size % 5 = 0 THEN 'Card-' || CAST(p_size AS STRING) ELSE 'x' END AS class",
    "l_discount * 1000.05 AS x", "l_tax * 333.333 AS y", "l_quantity * 1.26 AS width",
    "CASE WHEN p_size = 9 THEN 0.0 ELSE p_size * 2.5 END AS height", "CAST(p_size % 3 AS STRING) || 'px' AS gap",
]


def e20(spark, sf):
    return T.layout_boxes(_boxes(spark, sf)).select(
        "page_id", "box_no", "pos", "tag", "x", "y", "width", "height", F.array_join(F.transform(
            F.array_sort(F.map_entries("box")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";").alias("box"))


def _vars(spark, sf):
    return T.css_variables(A.css_texts(spark, sf))


QUERIES = {
    "e12_page_tally": lambda spark, sf: T.token_tally(T.token_values(A.style_rows(spark, sf, by_page=True))),
    "e09_assets": lambda spark, sf: T.assets(A.asset_responses(spark, sf)).drop("seq"),
    "e10_font_faces": lambda spark, sf: T.font_faces(A.css_texts(spark, sf)),
    "e10_font_links": lambda spark, sf: T.link_fonts(T.assets(A.asset_responses(spark, sf)), T.font_faces(A.css_texts(spark, sf))),
    "e12_ranked_tokens": lambda spark, sf: T.ranked_tokens(T.token_values(A.style_rows(spark, sf))),
    "e13_css_variables": lambda spark, sf: _vars(spark, sf).select("page_id", "var_no", "scope", "name", "value"),
    "e13_canonical_variables": lambda spark, sf: T.canonical_variables(_vars(spark, sf)),
    "e13_scoped_variables": lambda spark, sf: T.scoped_variables(_vars(spark, sf)),
    "e14_font_families": lambda spark, sf: T.font_families(T.page_samples(_samples(spark, sf))),
    "e14_text_colors": lambda spark, sf: T.text_colors(T.page_samples(_samples(spark, sf))),
    "e15_type_scale": lambda spark, sf: T.type_scale(T.page_samples(_samples(spark, sf))),
    "e19_style_delta": lambda spark, sf: T.style_delta(A.snapshots(spark, sf)),
    "e20_layout_boxes": e20,
}

_ASSETS = (S.view("r", A.ASSET_RESPONSES, "part") + ", f AS (SELECT url, min_by(content_type, seq) AS content_type, min_by(bytes, seq) AS bytes FROM r GROUP BY "
           "url), b AS (SELECT *, regexp_extract(url, '([^/]*)$', 1) AS base, lower(trim(string_split(content_type, ';')[1])) AS media FROM f), x AS (SELECT *, "
           "lower(regexp_extract(base, '^.+?(\\.[^.]*)$', 1)) AS ext FROM b), c AS (SELECT *, CASE WHEN starts_with(media, 'font/') OR ext IN "
           f"({S.quoted(R.FONT_EXTS)}) THEN 'fonts' WHEN media = 'image/svg+xml' OR ext = '.svg' THEN 'svg' WHEN starts_with(media, 'image/') OR ext IN "
           f"({S.quoted(R.IMAGE_EXTS)}) THEN 'images' WHEN media = 'text/css' OR ext = '.css' THEN 'css' WHEN contains(media, 'javascript') OR ext = '.js' THEN 'js' END AS "
           "category FROM x), n AS (SELECT url, content_type, bytes, category, 'web/assets/' || category || '/' || left(regexp_replace(lower(regexp_replace(base, "
           "'\\.[^.]*$', '')), '[^a-z0-9._-]', '-', 'g'), 40) || '-' || sha1(url) || CASE WHEN ext <> '' AND ext <> '.html' THEN ext WHEN media = 'image/avif' THEN "
           "'.avif' ELSE '.bin' END AS file FROM c WHERE category IS NOT NULL)")
_FACES = (S.view("css", A.CSS_TEXTS, "part") + ", bl AS (SELECT url, seq, regexp_extract_all(regexp_replace(css, '(?s)/\\*.*?\\*/', '', 'g'), "
          "'(?i)@font-face\\s*\\{([^}]*)\\}', 1) AS bs FROM css), ru AS (SELECT url, seq, unnest(bs) AS body, generate_subscripts(bs, 1) - 1 AS rule_no FROM bl), rf AS (SELECT "
          "*, regexp_extract_all(regexp_extract(body, '(?i)src\\s*:\\s*([^;]+)', 1), 'url\\(\\s*[''\"]?([^''\")]+)[''\"]?\\s*\\)', 1) AS refs FROM ru), fs AS (SELECT url, seq, "
          "rule_no, body, unnest(refs) AS ref, generate_subscripts(refs, 1) - 1 AS src_no FROM rf), faces AS (SELECT seq, rule_no, src_no, trim(regexp_extract(body, "
          "'font-family:([^;]+)', 1), '\"') AS family, regexp_extract(body, 'font-weight:([^;]+)', 1) AS weight, regexp_extract(body, 'font-style:([^;]+)', 1) AS style, CASE "
          "WHEN starts_with(ref, '../') THEN 'https://cdn.example.com/' || substr(ref, 4) ELSE 'https://cdn.example.com' || ref END AS src_url FROM fs WHERE NOT "
          "starts_with(ref, 'data:'))")
_TALLY = ("s AS (" + A.select_sql(A.STYLE_ROWS, A.LINES_WITH_PARTS_SQL) + "), v AS (SELECT 'colors' AS category, color AS value FROM s UNION ALL SELECT 'backgrounds', background FROM s "
          "UNION ALL SELECT 'borderColors', border_color FROM s WHERE border_width = '1px' UNION ALL SELECT 'radii', radius FROM s UNION ALL SELECT 'shadows', shadow FROM s UNION ALL SELECT "
          "'spacing', unnest(string_split(spacing, ' ')) FROM s UNION ALL SELECT 'fonts', trim(replace(string_split(font_family, ',')[1], '\"', '')) FROM s UNION ALL SELECT 'fontSizes', font_size "
          f"FROM s), tot AS (SELECT category, value, count(*) AS n FROM v WHERE value NOT IN ({S.quoted(R.TOKEN_NOISE)}) GROUP BY 1, 2), ranked AS (SELECT category, value, n, row_number() OVER "
          "(PARTITION BY category ORDER BY n DESC, value) AS rank FROM tot)")
_VARS = (S.view("css", A.CSS_TEXTS, "part") + ", ru AS (SELECT page_id, seq, x.r AS rule_no, x.s AS scope, x.body FROM css, (VALUES (0, ':root'), (1, '.dark')) y(r, s), LATERAL (SELECT y.r, y.s, "
         "regexp_extract(css, CASE y.r WHEN 0 THEN ':root\\{([^}]*)' ELSE '\\.dark\\{([^}]*)' END, 1) AS body) x), de AS (SELECT page_id, seq, rule_no, scope, unnest(string_split(body, ';')) AS d, "
         "generate_subscripts(string_split(body, ';'), 1) AS i FROM ru), nv AS (SELECT page_id, scope, trim(regexp_extract(d, '^([^:]*):', 1)) AS name, trim(regexp_extract(d, '^[^:]*:(.*)$', 1)) AS value, "
         "min([seq, rule_no, i]) AS place FROM de WHERE starts_with(trim(d), '--') GROUP BY 1, 2, 3, 4), vars AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS var_no FROM nv WHERE value "
         "<> '')")

ORACLES = {
    "e09_assets": f"WITH {_ASSETS} SELECT * FROM n",
    "e10_font_faces": f"WITH {_FACES} SELECT * FROM faces",
    "e10_font_links": f"WITH {_ASSETS}, {_FACES}, first AS (SELECT src_url, min_by(struct_pack(f := family, w := weight, s := style), [seq, rule_no, src_no]) AS d FROM faces GROUP BY 1) SELECT url, file, d.f AS "
        "family, d.w AS weight, d.s AS style FROM n LEFT JOIN first ON src_url = url WHERE category = 'fonts'",
    "e12_page_tally": "WITH " + _TALLY.replace("SELECT 'colors' AS category", "SELECT page_id, 'colors' AS category").replace("UNION ALL SELECT ", "UNION ALL SELECT page_id, ") .replace(
        "SELECT category, value, count(*) AS n FROM v", "SELECT page_id, category, value, count(*) AS n FROM v").replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)") + " SELECT page_id, category, value, n FROM tot",
    "e12_ranked_tokens": f"WITH {_TALLY} SELECT category, value, n, rank FROM ranked",
    "e13_css_variables": f"WITH {_VARS} SELECT page_id, var_no, scope, name, value FROM vars",
    "e13_canonical_variables": f"WITH {_VARS}, c AS (SELECT name, value, count(*) AS n FROM vars GROUP BY 1, 2) SELECT name, value, n FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, value) = 1",
    "e13_scoped_variables": f"WITH {_VARS} SELECT name, scope, max_by(value, [page_id, var_no]) AS value FROM vars GROUP BY 1, 2",
    "e14_font_families": f"WITH {_SAMPLES}, f AS (SELECT trim(replace(string_split(family, ',')[1], '\"', '')) AS family, count(*) AS n FROM kept GROUP BY 1) SELECT family, n, row_number() OVER (ORDER BY contains(family, "
        "'mono'), n DESC, family) = 1 AS is_body, contains(family, 'mono') AND row_number() OVER (PARTITION BY contains(family, 'mono') ORDER BY n DESC, family) = 1 AS is_mono FROM f",
    "e14_text_colors": f"WITH {_SAMPLES} SELECT color, count(*) AS n FROM kept GROUP BY color",
    "e15_type_scale": f"WITH {_SAMPLES}, g AS (SELECT role, size, weight, line_height, spacing, count(*) AS n, min(seq) AS sq, CAST(replace(size, 'px', '') AS INT) AS px FROM kept GROUP BY ALL) SELECT CASE role WHEN 'p' THEN 'body' "
        "ELSE role END AS role, size, weight, line_height, spacing, n, CASE role WHEN 'h1' THEN 0 WHEN 'h2' THEN 1 WHEN 'p' THEN 6 WHEN 'a' THEN 7 WHEN 'button' THEN 8 WHEN 'li' THEN 9 ELSE 10 END AS role_order FROM g "
        "QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, px DESC, sq) = 1",
    "e19_style_delta": f"WITH s0 AS ({A.select_sql(A.SNAPSHOTS, 'lineitem')}), s AS (SELECT page_id, selector, state, prop, min(value) AS value FROM s0 GROUP BY 1, 2, 3, 4) SELECT o.page_id, o.selector, o.prop, o.state, r.value AS from_value, o.value "
        f"AS to_value FROM s o JOIN s r ON r.page_id = o.page_id AND r.selector = o.selector AND r.prop = o.prop AND r.state = 'rest' AND o.state <> 'rest' WHERE r.value <> o.value AND o.prop IN ({S.quoted(R.STATE_PROPS)})",
    "e20_layout_boxes": "WITH b AS (" + A.select_sql(_BOX, A.LINES_WITH_PARTS_SQL) + "), t AS (SELECT *, CASE WHEN tag IN ('header', 'h2') OR role = 'search' THEN 0 WHEN tag IN ('div', 'ul') OR contains(lower(class), 'card') THEN 1 "
        "END AS tier FROM b WHERE width > 0 AND height > 0), p AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tier, CASE WHEN tier = 1 THEN -(width * height) ELSE 0.0 END, pos) AS box_no FROM t WHERE tier IS NOT NULL "
        ") SELECT page_id, box_no, pos, tag, floor(x * 10 + 0.5) / 10.0 AS x, floor(y * 10 + 0.5) / 10.0 AS y, floor(width * 10 + 0.5) / 10.0 AS width, floor(height * 10 + 0.5) / 10.0 AS height, "
        "array_to_string(list_filter([CASE WHEN pos % 2 <> 0 THEN 'display:flex' END, CASE WHEN gap <> '0px' THEN 'gap:' || gap END], lambda s: s IS NOT NULL), ';') AS box FROM p",
}
