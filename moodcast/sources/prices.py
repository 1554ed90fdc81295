"""SRC-8 / SRC-9: price rows out of stored HTML pages, as a Spark job.

Pages are a table (page_id, name, html); each layout is read with regular
expressions over the page text -- rows, then cells -- so extraction runs in
the executors next to the data. It handles the two fixed page layouts only;
it is not a general HTML parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodcast.functions.exprs import col_, parse_epoch_text, parse_number, parse_us_date

# Fixed values (the two page layouts): layout A rows carry the class
# "datatable_row__Hk3IV" and contain <time>, cell 1 the date (month/day/year),
# cell 2 the value; layout B rows sit under id "results_box" in <tbody>, with
# the attribute "data-real-value" on cells 1 and 2.
# Layout A pattern:
ROW_A_RE = r'(?s)<tr[^>]*class="[^"]*datatable_row__Hk3IV[^"]*"[^>]*>(.*?)</tr>'
# Layout B patterns:
AFTER_BOX_RE = r'(?s)id="results_box"(.*)'
TBODY_RE = r"(?s)<tbody[^>]*>(.*?)</tbody>"
ROW_RE = r"(?s)<tr[^>]*>(.*?)</tr>"
CELL_RE = r"(?s)<td[^>]*>(.*?)</td>"
CELL_ATTR_RE = r"(?s)<td([^>]*)>"
REAL_VALUE_RE = r'data-real-value="([^"]*)"'
TAG_RE = r"<[^>]*>"
EDGE_SPACE_RE = r"^\s+|\s+$"


def _text(c: Column) -> Column:
    """Text of an HTML fragment: tags removed, outer white space stripped."""
    return F.regexp_replace(F.regexp_replace(c, TAG_RE, ""), EDGE_SPACE_RE, "")


def _rows(html: Column, row_re: str) -> Column:
    return F.regexp_extract_all(html, F.lit(row_re), 1)


def extract_prices_a(pages: DataFrame, name: str = "nasdaq", html: str = "html") -> DataFrame:
    """(page_id, row_idx, timestamp, name, value) from layout A pages.

    Rows without ``<time>`` (headers) are skipped (FIL-7); a date or number
    that does not parse gives no row.
    """
    rows = pages.select("page_id", F.posexplode(_rows(col_(html), ROW_A_RE)).alias("row_idx", "row"))
    rows = rows.filter(F.col("row").contains("<time"))
    cells = F.regexp_extract_all(F.col("row"), F.lit(CELL_RE), 1)
    out = rows.select(
        "page_id", "row_idx",
        parse_us_date(_text(F.get(cells, 0))).alias("timestamp"),
        F.lit(name).alias("name"),
        parse_number(_text(F.get(cells, 1))).alias("value"))
    return out.filter(F.col("timestamp").isNotNull() & F.col("value").isNotNull())


def extract_prices_b(pages: DataFrame, name: str = "bitcoin", html: str = "html") -> DataFrame:
    """(page_id, row_idx, timestamp, name, value) from layout B pages.

    A row is skipped when either cell lacks the attribute or it is empty.
    """
    box = F.regexp_extract(col_(html), AFTER_BOX_RE, 1)
    bodies = F.regexp_extract_all(box, F.lit(TBODY_RE), 1)
    rows_text = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(ROW_RE), 1)))
    rows = pages.select("page_id", F.posexplode(rows_text).alias("row_idx", "row"))
    attrs = F.regexp_extract_all(F.col("row"), F.lit(CELL_ATTR_RE), 1)
    date = F.regexp_extract(F.coalesce(F.get(attrs, 0), F.lit("")), REAL_VALUE_RE, 1)
    value = F.regexp_extract(F.coalesce(F.get(attrs, 1), F.lit("")), REAL_VALUE_RE, 1)
    out = rows.select("page_id", "row_idx", date.alias("_d"), value.alias("_v"))
    out = out.filter((F.col("_d") != "") & (F.col("_v") != ""))
    return out.select("page_id", "row_idx", parse_epoch_text("_d").alias("timestamp"),
                      F.lit(name).alias("name"), parse_number("_v").alias("value")) \
        .filter(F.col("timestamp").isNotNull() & F.col("value").isNotNull())


def extract_prices(pages: DataFrame) -> DataFrame:
    """Both layouts over a page table whose ``name`` says which series it holds."""
    a = extract_prices_a(pages.filter(F.col("name") == "nasdaq"), "nasdaq")
    b = extract_prices_b(pages.filter(F.col("name") == "bitcoin"), "bitcoin")
    return a.unionByName(b)
