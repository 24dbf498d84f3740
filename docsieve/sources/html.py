"""Text of web pages: what a reader sees, and what attributes hide. Expressions only, so that pages stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts without visible text, elements that end a line, entities.
INVISIBLE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|nav|footer|title)[^>]*>"
TAGS = r"<[^>]*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
#: Attributes that carry text which isn't shown.
HIDDEN = r'(?i)(?:alt|title|href|content|value|placeholder)="([^"]*)"'


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts, styles and comments; blocks end lines, runs of blanks are one."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), INVISIBLE, " ")
    out = F.regexp_replace(F.regexp_replace(out, BREAKS, "\n"), TAGS, "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), " ?\n[ \n]*", "\n"))


def hidden_values(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HIDDEN), F.lit(1))


def texts(pages: DataFrame) -> DataFrame:
    """(page_id, text, part): the visible text, and the hidden values as lines; both can be reviewed like documents."""
    parts = F.array(F.struct(F.lit("visible").alias("part"), visible_text(F.col("html")).alias("text")), F.struct(F.lit("hidden").alias("part"), F.array_join(hidden_values(F.col("html")), "\n").alias("text")))
    return pages.select("page_id", F.explode(parts).alias("x")).select("page_id", "x.text", "x.part")
