"""Web pages: text, links, outline and catalog tables."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as S

from ..functions import fixed_values as V, html as H, text as T, urls as U
from ..operators import catalog as C
from ..plans import scale


def _struct(**fields) -> S.StructType:
    return S.StructType([S.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _INT = S.StringType(), S.IntegerType()
_LINKS = S.ArrayType(_struct(label=_TEXT, href=_TEXT, media=S.BooleanType()))
_ANCHORS = S.ArrayType(_struct(label=_TEXT, href=_TEXT))
_SECTIONS = S.ArrayType(_struct(title=_TEXT, links=_ANCHORS))
_CELLS = S.ArrayType(_struct(table_no=_INT, row_no=_INT, col_no=_INT, text=_TEXT, links=_ANCHORS))


@F.pandas_udf(_TEXT)
def _text(html: pd.Series) -> pd.Series:
    return html.map(H.page_text)


@F.pandas_udf(_TEXT)
def stored_text(content: pd.Series) -> pd.Series:
    """Text of the bytes of a stored page."""
    return content.map(H.stored_text, na_action="ignore")


@F.pandas_udf(_LINKS)
def _links(html: pd.Series) -> pd.Series:
    return html.map(H.page_links)


@F.pandas_udf(_SECTIONS)
def _sections(html: pd.Series) -> pd.Series:
    return html.map(H.sections)


@F.pandas_udf(_CELLS)
def _cells(html: pd.Series) -> pd.Series:
    return html.map(H.table_cells)


def page_text(pages: DataFrame) -> DataFrame:
    """Readable text of each page."""
    return pages.withColumn("text", T.clean_block(_text("html"))).drop("html")


def page_links(pages: DataFrame, hosts, follow: bool = False) -> DataFrame:
    """Absolute links of each page, the first of each URL, with their kind.

    ``follow`` keeps what a crawl goes on with: files, deep modules and courses
    other than the page itself.
    """
    rows = (T.unnest(pages, ["page_id", "url"], _links("html"), "pos", "l")
                 .filter(~F.col("l.href").startswith("data:"))
                 .select("page_id", F.col("url").alias("_base"), "pos", "l.label",
                         U.normalize(U.resolve("url", "l.href")).alias("url")))
    rows = scale.first_rows(rows, ["page_id", "url"], ["pos"])
    out = (rows.withColumn("kind", U.link_kind("url", hosts))
               .withColumn("label", F.when(F.col("label") == "", V.DEFAULT_LABEL).otherwise(F.col("label"))))
    if follow:
        out = out.filter(F.col("kind").isin("file", "deep", "course") & (F.col("url") != U.normalize("_base")))
    return out.select("page_id", "pos", "label", "url", "kind")


def page_outline(pages: DataFrame, hosts) -> DataFrame:
    """Sections and their activities; links of type ``other`` are no activity.

    One row per activity; a section without one gives a row with nulls.
    """
    sections = T.unnest(pages, ["page_id", "url"], _sections("html"), "section_idx", "s")
    links = sections.select("page_id", "section_idx", F.col("s.title").alias("section_title"), F.transform(
        "s.links", lambda l: F.struct(l["label"].alias("activity_name"),
                                      U.normalize(U.resolve(F.col("url"), l["href"])).alias("url"))).alias("_l"))
    typed = links.withColumn("_l", F.transform("_l", lambda l: F.struct(
        l["activity_name"].alias("activity_name"), l["url"].alias("url"),
        U.activity_type(l["url"], hosts).alias("mod_type"))))
    kept = F.filter("_l", lambda l: l["mod_type"] != "other")
    # first link of a URL: its position is the first position of that URL
    urls = F.transform("_k", lambda l: l["url"])
    once = F.filter(F.transform("_k", lambda l, i: F.when(F.array_position(urls, l["url"]) == i + 1, l)),
                    lambda l: l.isNotNull())
    rows = typed.withColumn("_k", kept).withColumn("_k", once)
    return (rows.select("page_id", "section_idx", "section_title", F.posexplode_outer("_k").alias("_i", "a"))
                .select("page_id", "section_idx", "section_title", (F.col("_i") + 1).alias("activity_order"),
                        "a.activity_name", "a.url", "a.mod_type"))


def catalog_from_tables(pages: DataFrame) -> DataFrame:
    """Catalog rows of HTML tables.

    The header row is the first one that names a material column and a code or
    name column; several columns may carry one role. Blank code, name and
    lecturer cells take the value above.
    """
    base = F.col("url")
    # every page is parsed once; roles, header and rows all read its cells
    cells = scale.checkpointed(T.unnest(pages, [F.col("page_id").alias("tab"), "url"], _cells("html"), "_i", "c").select("tab", "url", "c.*"))
    names = F.create_map(*[F.lit(x) for kv in V.CATALOG_HEADERS.items() for x in kv])
    roles = cells.withColumn("role", F.try_element_at(names, T.fold("text"))).filter(F.col("role").isNotNull())
    per_row = roles.groupBy("tab", "table_no", "row_no").agg(
        F.bool_or(F.col("role") == "material").alias("m"), F.bool_or(F.col("role").isin("code", "name")).alias("k"))
    header = (per_row.filter("m and k").groupBy("tab", "table_no").agg(F.min("row_no").alias("_head")))
    columns = (roles.join(header, ["tab", "table_no"]).filter(F.col("row_no") == F.col("_head"))
                    .select("tab", "table_no", "_head", "col_no", "role"))
    body = (cells.join(columns, ["tab", "table_no", "col_no"]).filter(F.col("row_no") > F.col("_head")))

    def first_text(role: str):
        return F.min(F.when((F.col("role") == role) & (F.col("text") != ""), F.struct("col_no", "text")))["text"]

    cell_links = F.filter(F.transform("links", lambda l: F.struct(
        U.canonical_link(U.resolve(base, l["href"])).alias("url"), l["label"].alias("label"))), lambda l: l["url"] != "")
    links = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(
        F.col("role") == "material", F.struct("col_no", cell_links.alias("ls"))))), lambda s: s["ls"]))
    # one logical row of a table: its cells, no more
    rows = body.groupBy("tab", "table_no", "row_no").agg(
        first_text("code").alias("course_code"), first_text("name").alias("course_name"),
        first_text("lecturer").alias("lecturer"), links.alias("material_links"))
    filled = C.fill_down(rows, ["tab", "table_no"], "row_no", ["course_code", "course_name", "lecturer"])
    return C.usable_rows(filled)
