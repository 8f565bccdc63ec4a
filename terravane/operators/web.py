"""Fields of fetched HTML pages, with JVM text functions; character references are resolved in Arrow batches.

Markup is read the way the HTML standard treats it: a paragraph ends at its
closing tag or where the next paragraph starts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from terravane.functions import as_column, text

# Elements whose content is not part of the page text.
DROPPED = ("script", "style", "noscript", "svg", "footer", "header", "nav")


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    import html

    return values.map(lambda v: None if v is None else html.unescape(v))


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def without_tags(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")


def without_dropped(html: Column) -> Column:
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return html


def first_group(html: Column, pattern: str) -> Column:
    found = F.regexp_extract(html, pattern, 1)
    return F.when(F.length(found) > 0, found)


def _attribute_content(html: Column, attribute: str, value: str) -> Column:
    before = rf"""(?is)<meta\b[^>]*{attribute}\s*=\s*["']{value}["'][^>]*\bcontent\s*=\s*["']([^"']*)["']"""
    after = rf"""(?is)<meta\b[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*{attribute}\s*=\s*["']{value}["']"""
    return F.coalesce(first_group(html, before), first_group(html, after))


def paragraphs(html: Column, least: int = 30) -> Column:
    """Texts of the paragraphs of the article, or of the page when it has none."""

    def blocks(region: Column) -> Column:
        parts = F.split(region, r"(?i)<p(?:\s[^>]*)?>")
        inner = F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts) - 1)).otherwise(
            F.array().cast("array<string>")
        )
        return F.transform(
            inner,
            lambda part: collapse(
                without_tags(F.regexp_replace(part, r"(?is)</(?:p|article|body)\s*>.*", ""))
            ),
        )

    article = F.coalesce(first_group(html, r"(?is)<article\b[^>]*>(.*?)</article\s*>"), F.lit(""))
    inside = blocks(article)
    chosen = F.when(F.size(inside) > 0, inside).otherwise(blocks(html))
    return F.filter(chosen, lambda p: F.length(p) >= least)


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, description, article_text and clean_text, entities resolved."""
    page = F.col(html)
    title = collapse(without_tags(first_group(page, r"(?is)<title\b[^>]*>(.*?)</title\s*>")))
    heading = F.coalesce(
        *[
            F.when(F.length(found) > 0, found)
            for found in (
                collapse(without_tags(first_group(page, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>")))
                for tag in ("h1", "h2")
            )
        ]
    )
    described = F.coalesce(
        _attribute_content(page, "name", "description"),
        _attribute_content(page, "property", "og:description"),
        _attribute_content(page, "name", "twitter:description"),
    )
    raw = {
        "title": F.coalesce(F.when(F.length(title) > 0, title), heading),
        "description": F.trim(described),
        "article_text": F.array_join(paragraphs(page), "\n\n"),
        "clean_text": collapse(without_tags(without_dropped(page))),
    }
    # only texts that hold a reference leave the JVM
    marked = {name: _unescape(F.when(F.contains(F.col(name), F.lit("&")), F.col(name))) for name in raw}
    return pages.withColumns(raw).withColumns({name: F.coalesce(found, F.col(name)) for name, found in marked.items()})


def links(pages: DataFrame, identity: str, html: str = "html") -> DataFrame:
    """One row per link: href and visible text."""
    pattern = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
    both = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), 1).alias("href"),
        F.regexp_extract_all(html, F.lit(pattern), 2).alias("label"),
    )
    return (
        pages.select(identity, F.explode(both).alias("_l"))
        .select(identity, F.col("_l.href").alias("href"), collapse(without_tags(F.col("_l.label"))).alias("label"))
    )


@dataclass(frozen=True)
class BulletinStates:
    """What a page is called that links an active bulletin, says there is none, links others, links nothing."""

    active: str
    none: str
    linked: str
    nothing: str


def bulletin_status(
    link_rows: DataFrame,
    identity: str,
    phrases: Sequence[str],
    none_phrase: str,
    active_phrase: str,
    states: BulletinStates,
) -> DataFrame:
    """Per page: bulletins linked (distinct URLs) and a status, strongest evidence first."""
    combined = F.lower(F.concat_ws(" ", "label", "href"))
    wanted = link_rows.where(text.has_any(combined, phrases, bounded=False))
    none = F.contains(F.lower("href"), F.lit(none_phrase))
    active = F.contains(F.lower("label"), F.lit(active_phrase)) & ~none
    per_page = wanted.groupBy(identity).agg(
        F.countDistinct("href").alias("bulletins"),
        F.bool_or(active).alias("_active"),
        F.bool_or(none).alias("_none"),
    )
    pages = link_rows.select(identity).distinct()
    joined = pages.join(per_page, identity, "left")
    status = (
        F.when(F.col("_active"), states.active)
        .when(F.col("_none"), states.none)
        .when(F.col("bulletins") > 0, states.linked)
        .otherwise(states.nothing)
    )
    return joined.select(identity, F.coalesce("bulletins", F.lit(0)).alias("bulletins"), status.alias("status"))


def document_id(value) -> Column:
    return text.content_hash(as_column(value))
