"""Identifiers and text keys of QA records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats below decide ids and keys.
IMAGE_TAG = "<image>"
ITEM_ID_HEX = 20
INTERVENTION_ID_HEX = 24
MISSING = "None"
UNLABELLED = "unlabelled"
SPACE = "(?U)[\\s\\x1c-\\x1f]+"
EDGE_SPACE = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def hash60(text: Column) -> Column:
    """60 bits of md5 as bigint: the shared source of every draw, shuffle and sample."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def source_id(metadata: str = "metadata") -> Column:
    """Group key of a record: the source image id, else the image id, else ``'None'``."""
    named = F.nullif(F.col(f"{metadata}.source_img_id").cast("string"), F.lit(""))
    return F.coalesce(named, F.col(f"{metadata}.img_id").cast("string"), F.lit(MISSING))


def question_text(content: Column) -> Column:
    return strip(F.replace(content, F.lit(IMAGE_TAG), F.lit("")))


def canonical(text: Column) -> Column:
    """Lower case with runs of white space as one blank; the key for dedupe and audits."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def joined(*parts: Column) -> Column:
    """Parts with ``|`` between; nulls become ``'None'`` instead of vanishing."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(MISSING)) for p in parts])


def item_id(source: Column, question: Column) -> Column:
    return F.substring(F.sha2(joined(source, question), 256), 1, ITEM_ID_HEX)


def intervention_id(item, method, intervention, treatment, fraction, mode, repeat) -> Column:
    key = joined(item, method, intervention, treatment, F.format_string("%.6f", fraction), mode, repeat)
    return F.substring(F.sha2(key, 256), 1, INTERVENTION_ID_HEX)


def stable_seed(*parts: Column) -> Column:
    """The first eight sha256 bytes modulo 2**32, that is hex digits 9 to 16."""
    return F.conv(F.substring(F.sha2(joined(*parts), 256), 9, 8), 16, 10).cast("bigint")


def words(text: Column) -> Column:
    """White-space tokens; empty text has none."""
    return F.filter(F.split(canonical(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def labels_or_default(classes: Column) -> Column:
    known = F.transform(classes, lambda c: F.coalesce(c, F.lit(MISSING)))
    return F.when(F.coalesce(F.size(classes), F.lit(0)) > 0, known).otherwise(F.array(F.lit(UNLABELLED)))


def stratum_text(value: Column) -> Column:
    """Stratum keys are strings and a null stratum is the text ``'None'``."""
    return F.coalesce(value.cast("string"), F.lit(MISSING))
