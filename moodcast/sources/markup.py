"""SRC-8 / SRC-9 on pages as they are served: a tag tokeniser and a table automaton.

``sources/prices.py`` reads the two layouts with fixed patterns, in the one form in
which they are usually written. Here a page is cut into tokens (comments and scripts
dropped) and each token becomes a row; running sums and last values over the
tokens of a page play the automaton:

  table  opened minus closed tables give the depth, the last opening at that depth the table
  row    number of <tr> in that table; it ends at </tr>, at the next <tr> or section, at </table>
  cell   number of <td> or <th> in that row; it ends likewise, so end tags may be missing

So attributes may stand in any order, with either quotes or none, tags in any
case, values behind entities, and tables inside cells: their text belongs to
their own cells. All windows and groupings are by page first, so one shuffle of
pages serves them all and a long page spills instead of growing in memory.
The pages are dealt over as many tasks as they have ``TASK_BYTES``: each window
sorts a task's tokens anew, so what a task holds must not grow with the table.

Defined cases: a page without an id gives no rows (``page_id`` is the key of the
table); a NULL or empty page, or one without such rows, gives none; rows whose
date or number does not parse are dropped but counted in ``row_idx``; a ``<`` that
opens no tag is text; a tag with over 400 quoted parts is text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodcast.functions.exprs import col_, parse_epoch_text, parse_number, parse_us_date

# Fixed values (the two page layouts): class of a layout A row, id of the layout B
# box, attribute of its cells.
ROW_CLASS = "datatable_row__Hk3IV"
BOX_ID = "results_box"
VALUE_ATTR = "data-real-value"

# A comment, a script or style with its content, a tag, text, a stray "<".
TOKEN_RE = (r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
            r"""|<[/!?]?[a-z](?:[^<>"']++|"[^"]*+"|'[^']*+'){0,400}+>|[^<]++|<""")
SKIPPED_RE = r"(?i)^<(!|\?|script\b|style\b)"
NAME_RE = r"^<(/?[A-Za-z][A-Za-z0-9]*)"
ATTR_RE = r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
EDGES_RE = r"^[\s\u00a0]+|[\s\u00a0]+$"
# Named entities; the ampersand last, so that nothing is decoded twice.
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
CELLS = ("td", "th")
SECTIONS = ("tbody", "thead", "tfoot")
# Pages of so many bytes share a task; all sorts of their tokens together take about a hundred times that.
TASK_BYTES = 4 << 20


def decode_entities(c) -> Column:
    """Numeric entities of the basic plane and the named ones above; others stay as they are."""
    text = col_(c)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)&#(x[0-9a-f]{1,4}|[0-9]{1,5});"), 1))

    def put(acc: Column, code: Column) -> Column:
        hexed = F.lower(code).startswith("x")
        digits = F.when(hexed, F.upper(F.substr(code, F.lit(2)))).otherwise(F.conv(code, 10, 16))
        point = F.conv(digits, 16, 10).cast("int")
        plain = point.between(1, 0xD7FF) | point.between(0xE000, 0xFFFF)
        sign = F.when(plain, F.decode(F.unhex(F.lpad(digits, 4, "0")), "UTF-16BE"))
        return F.replace(acc, F.concat(F.lit("&#"), code, F.lit(";")),
                         F.coalesce(sign, F.concat(F.lit("&#"), code, F.lit(";"))))

    out = F.aggregate(found, text, put)
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def attribute(tag, name: str) -> Column:
    """Value of an attribute of a tag token, entities decoded; NULL without it, '' without a value."""
    inner = F.regexp_replace(F.regexp_replace(col_(tag), NAME_RE, ""), r"/?>$", "")
    names = F.transform(F.regexp_extract_all(inner, F.lit(ATTR_RE), 1), F.lower)
    value = F.element_at(F.regexp_extract_all(inner, F.lit(ATTR_RE), 2), F.array_position(names, name).cast("int"))
    quoted = value.rlike("""^["']""")
    bare = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.when(F.array_contains(names, name), decode_entities(bare))


def dealt(pages: DataFrame, html: str = "html", task_bytes: int = TASK_BYTES) -> DataFrame:
    """The pages with an id, dealt by it over one task for each ``task_bytes`` of them (a number read from the table)."""
    known = pages.where("page_id is not null")
    size = known.agg(F.sum(F.octet_length(col_(html)))).first()[0] or 0
    least = pages.sparkSession.sparkContext.defaultParallelism
    return known.repartition(max(least, math.ceil(size / task_bytes)), "page_id")


def tokens(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, pos, tok, name): tags with their lower-case name ("/name" for end tags), text with an empty one."""
    toks = dealt(pages, html).select(
        "page_id", F.posexplode(F.regexp_extract_all(col_(html), F.lit(TOKEN_RE), 0)).alias("pos", "tok"))
    return (toks.where(~F.col("tok").rlike(SKIPPED_RE))
            .withColumn("name", F.lower(F.regexp_extract("tok", NAME_RE, 1))))


def _last(window, true_at, false_at) -> Column:
    """Whether the last of the named tags up to a token was one of ``true_at``."""
    name = F.col("name")
    state = F.when(name.isin(*true_at), True).when(name.isin(*false_at), False)
    return F.coalesce(F.last(state, ignorenulls=True).over(window), F.lit(False))


def _ends(*names: str) -> list[str]:
    return [f"/{n}" for n in names]


def table_tokens(toks: DataFrame) -> DataFrame:
    """Each token with its table (``depth``, ``table``), section, row and cell and whether those are open."""
    name, page = F.col("name"), Window.partitionBy("page_id").orderBy("pos")
    closes = (name == "/table").cast("int")
    # an end tag belongs to what it closes
    d = toks.withColumn("depth", F.sum((name == "table").cast("int") - closes).over(page) + closes)
    d = d.withColumn("table", F.coalesce(F.last(F.when(name == "table", F.col("pos")), ignorenulls=True).over(
        Window.partitionBy("page_id", "depth").orderBy("pos")), F.lit(-1)))
    table = Window.partitionBy("page_id", "depth", "table").orderBy("pos")
    d = d.withColumns({
        "row": F.sum((name == "tr").cast("int")).over(table),
        "in_row": _last(table, ["tr"], [*_ends("tr", "table", *SECTIONS), *SECTIONS]),
        "in_body": _last(table, ["tbody"], [*_ends("tbody", "table"), "thead", "tfoot"])})
    row = Window.partitionBy("page_id", "depth", "table", "row").orderBy("pos")
    return d.withColumns({"cell": F.sum(name.isin(*CELLS).cast("int")).over(row),
                          "in_cell": _last(row, CELLS, [*_ends(*CELLS), *_ends("tr", "table")])})


def in_box(toks: DataFrame, box_id: str) -> DataFrame:
    """Adds ``boxed``: whether a token lies inside the page's first element with that id."""
    name, pos = F.col("name"), F.col("pos")
    page = Window.partitionBy("page_id")
    ordered = page.orderBy("pos")
    # the attributes of the few tags that hold the id's letters are read, no others
    is_box = (name != "") & F.col("tok").contains(box_id) & attribute("tok", "id").eqNullSafe(F.lit(box_id))
    d = toks.withColumn("_box", F.min(F.when(is_box, F.struct("pos", "name"))).over(page))
    begun = F.coalesce(pos >= F.col("_box.pos"), F.lit(False))
    step = F.when(begun & (name == F.col("_box.name")), 1).when(
        begun & (name == F.concat(F.lit("/"), F.col("_box.name"))), -1).otherwise(0)
    d = d.withColumn("_level", F.sum(step).over(ordered))
    d = d.withColumn("_least", F.min(F.when(begun, F.col("_level"))).over(ordered))
    return d.withColumn("boxed", F.coalesce(F.col("_least") >= 1, F.lit(False))).drop("_box", "_level", "_least")


def table_rows(toks: DataFrame, carry: tuple = ()) -> DataFrame:
    """One row per table row: (page_id, start, tag, has_time, in_body, carry..., open_1, open_2, text_1, text_2).

    ``start`` is the position of its ``<tr>``, ``open_k`` the tag of cell k, ``text_k`` its
    text. ``carry`` names flags of the ``<tr>`` token.
    """
    name = F.col("name")
    at_tr = name == "tr"

    def text(k: int) -> Column:
        parts = F.collect_list(F.when((F.col("cell") == k) & F.col("in_cell") & (name == ""), F.struct("pos", "tok")))
        return F.array_join(F.transform(F.array_sort(parts), lambda x: x["tok"]), "").alias(f"text_{k}")

    flags = [F.max(F.when(at_tr, F.col(c))).alias(c) for c in ("in_body", *carry)]
    tags = [F.max(F.when((F.col("cell") == k) & name.isin(*CELLS), F.col("tok"))).alias(f"open_{k}") for k in (1, 2)]
    # other tags open and close nothing here, and only rows, cells and text are read
    used = toks.where(name.isin("", "time", "table", "tr", *CELLS, *SECTIONS, *_ends("table", "tr", *CELLS, *SECTIONS)))
    used = used.withColumn("tok", F.when(name.isin("", "tr", *CELLS), F.col("tok")))
    kept = table_tokens(used).where(F.col("in_row") & (at_tr | (name == "time") | F.col("cell").between(1, 2)))
    return kept.groupBy("page_id", "depth", "table", "row").agg(
        F.min("pos").alias("start"), F.max(F.when(at_tr, F.col("tok"))).alias("tag"),
        F.max(name == "time").alias("has_time"), *flags, *tags, text(1), text(2)).drop("depth", "table", "row")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("page_id").orderBy("start")) - 1)


def _stripped(c: str) -> Column:
    return F.regexp_replace(decode_entities(c), EDGES_RE, "")


def _prices(rows: DataFrame, name: str, when: Column, value: Column) -> DataFrame:
    out = rows.select("page_id", "row_idx", when.alias("timestamp"), F.lit(name).alias("name"), value.alias("value"))
    return out.where("timestamp is not null and value is not null")


def markup_prices_a(pages: DataFrame, name: str = "nasdaq", html: str = "html") -> DataFrame:
    """SRC-8: (page_id, row_idx, timestamp, name, value) of the rows of ``ROW_CLASS`` that hold ``<time>``."""
    rows = table_rows(tokens(pages, html))
    classes = F.split(F.regexp_replace(attribute("tag", "class"), r"\s+", " "), " ")
    rows = _numbered(rows.where(F.col("tag").contains(ROW_CLASS) & F.array_contains(classes, ROW_CLASS)))
    return _prices(rows.where("has_time"), name, parse_us_date(_stripped("text_1")), parse_number(_stripped("text_2")))


def markup_prices_b(pages: DataFrame, name: str = "bitcoin", html: str = "html") -> DataFrame:
    """SRC-9: the same of the body rows inside ``BOX_ID`` whose first two cells carry ``VALUE_ATTR``."""
    rows = table_rows(in_box(tokens(pages, html), BOX_ID), carry=("boxed",))
    rows = _numbered(rows.where("boxed and in_body"))
    rows = rows.select("page_id", "row_idx", attribute("open_1", VALUE_ATTR).alias("d"), attribute("open_2", VALUE_ATTR).alias("v"))
    return _prices(rows.where("d <> '' and v <> ''"), name, parse_epoch_text("d"), parse_number("v"))


def markup_prices(pages: DataFrame) -> DataFrame:
    """Both layouts over a page table whose ``name`` says which series it holds."""
    return markup_prices_a(pages.where("name = 'nasdaq'")).unionByName(markup_prices_b(pages.where("name = 'bitcoin'")))
