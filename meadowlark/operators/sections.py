"""From page text to lines, and from lines to titled sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meadowlark.functions.patterns import HEADING_LINES, HEADING_STARTS
from meadowlark.functions.text import has_any, repaired_ordinals, trimmed
from meadowlark.functions.titles import classified, is_title

#: More lines with a row of dots than this make a page a table of contents.
DOTTED_LINES, HEAD_LINES = 5, 5
_YEAR = r"(20\d{2})\s+(?:Colorado\s+)?Elk"


def is_skipped(text: Column) -> Column:
    """Contents and methodology pages, which hold no rows."""
    lines = F.split(text, "\n")
    # the first test of each is cheap, and enough for most pages
    dotted = text.contains("....") & (F.size(F.filter(lines, lambda x: x.contains("...."))) > DOTTED_LINES)
    headed = text.contains("Contents") & F.array_join(F.slice(lines, 1, HEAD_LINES), " ").contains("Contents")
    return dotted | headed | (text.contains("Methodology") & text.contains("stratified random"))


def page_outlines(pages: DataFrame) -> DataFrame:
    """One slim row per page of (file, file_ord, page_no, text): ``year``, ``titles`` and ``before``.

    year: the first that one of the file's skipped pages names, else that of the first line that starts with one, else
    null. titles: the page's titles in order, each classified here once. before: the title that an earlier page left open.
    Texts are read once and only lines that may be titles leave the read; the windows by file are over one row a page.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x, k: F.struct(k.alias("line_no"), trimmed(x).alias("line")))
    dated = F.filter(lines, lambda x: x["line"].rlike(r"^20\d{2}") & x["line"].contains("Elk"))
    none = F.array().cast("array<struct<line_no:int,line:string>>")
    marked = pages.withColumn("text", text).withColumn("skipped", is_skipped(F.col("text")))
    slim = (
        marked.select(
            "file", "file_ord", "page_no",
            F.when(F.col("skipped"), F.nullif(F.regexp_extract("text", _YEAR, 1), F.lit(""))).alias("named"),
            F.when(F.col("skipped") | ~text.contains("Elk"), none).otherwise(dated).alias("dated"),
        )
        .groupBy("file", "file_ord", "page_no")
        .agg(F.min("named").alias("named"), F.array_sort(F.flatten(F.collect_list("dated"))).alias("dated"))
    )
    opening = F.try_element_at(F.filter(F.transform("dated", lambda x: F.regexp_extract(x["line"], r"^(20\d{2})\s+Elk", 1)), lambda y: y != ""), F.lit(1))
    by_page = Window.partitionBy("file").orderBy("page_no")
    whole = by_page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    year = F.coalesce(F.first("named", ignorenulls=True).over(whole), F.first(opening, ignorenulls=True).over(whole))
    of_year = F.transform(F.filter("dated", lambda x: is_title(x["line"], F.col("year"))), lambda x: F.struct(x["line_no"], repaired_ordinals(x["line"]).alias("title")))
    section = lambda x: F.struct(F.col("page_no").alias("page_no"), x["line_no"].alias("line_no"))
    titles = F.transform(of_year, lambda x: F.struct(section(x).alias("section"), classified(x["title"]).alias("meta")))
    earlier = by_page.rowsBetween(Window.unboundedPreceding, -1)
    return (
        slim.withColumn("year", year.cast("bigint"))
        .withColumn("titles", titles)
        .withColumn("before", F.last(F.try_element_at("titles", F.lit(-1)), ignorenulls=True).over(earlier))
        .select("file", "file_ord", "page_no", "year", "titles", "before")
    )


def years_of(outlines: DataFrame) -> DataFrame:
    """(file, file_ord, year); null for files that name no year."""
    return outlines.groupBy("file", "file_ord").agg(F.max("year").alias("year"))


def report_years(pages: DataFrame) -> DataFrame:
    """(file, file_ord, year) of the reports; see :func:`page_outlines`."""
    return years_of(page_outlines(pages))


def page_lines(pages: DataFrame) -> DataFrame:
    """The trimmed lines of the pages that count, without blank ones and bare page numbers; further columns ride along."""
    return (
        pages.where(F.col("text").isNotNull() & ~is_skipped(F.col("text")))
        .select(*[c for c in pages.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .withColumn("line", trimmed(F.col("line")))
        .where((F.col("line") != "") & ~F.col("line").rlike(r"^\d{1,3}$"))
    )


def in_sections(pages: DataFrame, outlines: DataFrame | None = None) -> DataFrame:
    """The lines of ``pages`` that belong to a section, with ``year``, ``section`` (page and line of its title), ``meta``
    and ``is_title``.

    A title opens a section and ends the one before; lines before a file's first title, and those under a title of no
    known table, belong to none and go. Titles are classified by the repaired line; rows keep the line as it came. A page
    brings its titles and the open one along, so lines never move: the one join is of page rows by file and page, however
    long a report is. ``outlines`` may be given where they are kept.
    """
    outlines = page_outlines(pages) if outlines is None else outlines
    titled = outlines.where((F.size("titles") > 0) | F.col("before").isNotNull()).drop("file_ord")
    lines = page_lines(pages.join(titled, ["file", "page_no"]))
    own = F.try_element_at(F.filter("titles", lambda t: t["section"]["line_no"] <= F.col("line_no")), F.lit(-1))
    return (
        lines.withColumn("title", F.coalesce(own, "before"))
        .where(F.col("title.meta").isNotNull())
        .withColumn("is_title", F.col("title.section") == F.struct("page_no", "line_no"))
        .select("file", "file_ord", "page_no", "line_no", "line", "year", "title.section", "title.meta", "is_title")
    )


def is_heading(line):
    """Column headings and notes; no row has such a shape, so only diagnostics need this."""
    found = line.isin(*HEADING_LINES) | (line.contains("Data Analysis Unit") & line.contains("Map"))
    for start in HEADING_STARTS:
        found = found | line.startswith(start)
    return found


def unparsed_lines(sections: DataFrame, record: str = "is_record", first: int = 5) -> DataFrame:
    """The first lines of each section without records that are neither headings nor records, for diagnosis."""
    by_section = Window.partitionBy("file", "section")
    left = (
        sections.withColumn("__n", F.sum(F.col(record).cast("int")).over(by_section))
        .where((F.col("__n") == 0) & ~F.col("is_title") & ~is_heading(F.col("line")) & (F.col("line") != "") & ~has_any(F.col("line"), "Seasons"))
        .withColumn("__k", F.row_number().over(by_section.orderBy("page_no", "line_no")))
    )
    return left.where(F.col("__k") <= first).select("file", "section", "meta", "page_no", "line_no", "line")
