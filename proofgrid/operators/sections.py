"""Markdown texts as tables of sections and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions.keys import strip

# Heading marks and the separator line.
HEADING = r"^(#{1,3}) "
BLANK = r"[^\S\n]*"
BOUNDARY = rf"\n(?=#{{1,3}} |{BLANK}---{BLANK}(?:\n|$))"
SEPARATOR = rf"^{BLANK}---{BLANK}(?:\n|$)"


def sections(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, section_no, type, level, text, content``.

    The text is cut before each heading or separator line, so a piece is a mark and the
    lines that belong to it. Text before the first mark and after a separator belongs to
    no section. All of it happens inside the document's row, without a shuffle.
    """
    marks = F.length(F.regexp_extract("piece", HEADING, 1))
    is_separator = F.col("piece").rlike(SEPARATOR)
    parts = F.split("piece", "\n", 2)
    heading = F.substring(parts[0], marks + 2, F.length(parts[0]))
    kind = F.when(is_separator, "separator").when(marks == 1, "title").otherwise("heading")
    # The first piece has no mark if the document starts with other text.
    led = F.col(text).rlike(HEADING) | F.col(text).rlike(SEPARATOR)
    found = documents.select(doc, led.cast("int").alias("_led"), text)
    pieces = found.select(doc, "_led", F.posexplode(F.split(F.col(text), BOUNDARY)).alias("pos", "piece"))
    return pieces.filter((marks > 0) | is_separator).select(
        doc,
        (F.col("pos") + F.col("_led")).alias("section_no"),
        kind.alias("type"),
        F.when(~is_separator, marks).alias("level"),
        F.when(~is_separator, strip(heading)).alias("text"),
        F.when(~is_separator, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("content"),
    )


def line_kind(line: Column) -> Column:
    stars = F.length(line) - F.length(F.replace(line, F.lit("*"), F.lit("")))
    return (
        F.when(line.startswith("- "), "bullet")
        .when(line.startswith("*") & line.endswith("*") & (stars == 2), "italic")
        .when(line.endswith(":") & line.contains("**"), "subheading")
        .otherwise("paragraph")
    )


def content_lines(parts: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Non-blank lines of section contents with kind, text without marks and bold spans."""
    lines = parts.select(*keys, F.posexplode(F.split(F.col(content), "\n")).alias("line_no", "_line"))
    lines = lines.withColumn("_line", strip(F.col("_line"))).filter("_line != ''")
    kind = line_kind(F.col("_line"))
    body = (
        F.when(kind == "bullet", F.substring("_line", 3, 2**30))
        .when(kind == "italic", F.substring(F.col("_line"), F.lit(2), F.length("_line") - 2))
        .otherwise(F.col("_line"))
    )
    spans = F.transform(
        F.regexp_extract_all(body, F.lit(r"(\*\*.*?\*\*)"), 1),
        lambda s: F.substring(s, F.lit(3), F.length(s) - 4),
    )
    return lines.select(*keys, "line_no", kind.alias("kind"), strip(body).alias("line"), spans.alias("bold"))
