"""Queries over raw pages and their addresses, and over texts in labelled folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalise_path, path_stem, strip_prefix, url_path
from ..session import new_path
from ..sources import html as H
from ..sources.textfiles import read_labelled_dirs, write_labelled_dirs
from .roles import table


def page_extract(spark, sf_dir):
    """Regular parts of a page as native expressions; entities stay as written."""
    p, html = table(spark, sf_dir, "pages"), F.col("html")
    return p.select(
        "page_id",
        F.regexp_extract(html, '<html lang="([a-z]*)"', 1).alias("lang"),
        H.tag_text(html, "title").alias("title"),
        H.tag_text(html, "h1").alias("heading"),
        strip_prefix(H.tag_text(html, "footer"), "&copy; ").alias("footer"),
        F.regexp_count(html, F.lit("<p>")).cast("bigint").alias("n_paragraphs"),
        F.length(H.tag_text(html, "article")).cast("bigint").alias("article_chars"),
    )


def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(H.links(F.col("html"))).alias("pos", "link")).select(
        "page_id", "pos", "link.href", "link.text"
    )


def page_records(spark, sf_dir):
    """One record per article of a page, by the parser."""
    return H.extract_with(table(spark, sf_dir, "pages"), "page_id", H.article_records, H.ARTICLE_SCHEMA)


def normalise_url(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    # Path parameters and doubled slashes, as a client may send them.
    sent = F.concat(F.lit("//"), F.regexp_replace(url_path(F.col("url")), "/", "//"))
    return p.select("page_id", sent.alias("sent"), normalise_path(sent).alias("path"))


def path_stem_query(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    image = F.concat(F.regexp_replace("url", r"[?#].*", ""), F.lit("_flag_"), "page_id", F.lit(".small.png"))
    return p.select("page_id", path_stem(image).alias("stem"))


def labelled_files(spark, sf_dir):
    """Documents written one per file in a folder per language, and read by folder.

    The writer ends every file with a line break.
    """
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("in_"), "lang").alias("label"), "text")
    folders = write_labelled_dirs(docs, new_path(spark, "labelled"))
    return read_labelled_dirs(spark, folders).select(strip_prefix(F.col("label"), "label=").alias("label"), "text")


QUERIES = {
    "page_extract": page_extract,
    "page_links": page_links,
    "page_records": page_records,
    "normalise_url": normalise_url,
    "path_stem": path_stem_query,
    "labelled_files": labelled_files,
}


def _sql_tag(tag: str) -> str:
    found = f"regexp_extract(html, '<{tag}[^>]*>(.*?)</{tag}>', 1, 's')"
    return f"case when regexp_matches(html, '<{tag}[^>]*>.*?</{tag}>', 's') then trim(regexp_replace({found}, '<[^>]*>', '', 'g')) end"


_LINK = """'<a href="([^"]*)"[^>]*>(.*?)</a>'"""

SQL = {
    "page_extract": f"""
select page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) as lang, {_sql_tag("title")} as title, {_sql_tag("h1")} as heading,
       case when starts_with({_sql_tag("footer")}, '&copy; ') then ({_sql_tag("footer")})[8:] else {_sql_tag("footer")} end as footer,
       cast(len(regexp_extract_all(html, '<p>')) as bigint) as n_paragraphs, length({_sql_tag("article")}) as article_chars
from pages""",
    "page_links": f"""
select page_id, cast(generate_subscripts(h, 1) - 1 as integer) as pos, unnest(h) as href, unnest(t) as text
from (select page_id, regexp_extract_all(html, {_LINK}, 1, 's') as h, regexp_extract_all(html, {_LINK}, 2, 's') as t from pages)""",
    "normalise_url": r"""
select page_id, sent,
       regexp_replace(regexp_replace(regexp_extract(sent, '^[^;?]*'), '/+', '/', 'g'), '/$', '') || regexp_extract(sent, '^[^;?]*(.*)$', 1) as path
from (select page_id, '//' || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#;]*([^#]*)', 1), '/', '//', 'g') as sent from pages)""",
    "path_stem": r"""
select page_id, split_part(split_part(split_part(regexp_replace(url, '[?#].*', '') || '_flag_' || page_id || '.small.png', '/', -1), '_', -1), '.', 1) as stem
from pages""",
    "labelled_files": "select 'in_' || lang as label, text || chr(10) as text from documents",
}
