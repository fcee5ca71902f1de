"""Text functions: overlapping chunks, HTML to text, token overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """array<struct<chunk_no, chunk>> of `size` characters, each `overlap` into the one before; a short last one stays."""
    stride = max(1, size - overlap)
    n = F.char_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, i: F.struct(i.alias("chunk_no"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))


#: Elements that go with what is in them, one after another, and entities in the order in which they are read.
HIDDEN = ("script", "style", "noscript", "header", "footer")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, headers and footers go with what is in them, then comments and tags; blanks squeezed."""
    bare = html
    for tag in HIDDEN:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def token_overlap(a: Column, b: Column, least: int = 4) -> Column:
    """0, 1 or 2: how many tokens of `least` letters or more two texts share, at most 2."""
    tokens = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(rf"[a-z0-9]{{{least},}}"), F.lit(0)))
    return F.least(F.size(F.array_intersect(tokens(a), tokens(b))), F.lit(2))


def ungrounded(answer: Column, evidence: Column) -> Column:
    """Whether the answer has capitalised tokens that the evidence lacks."""
    tokens = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("[A-Z][A-Za-z0-9]{2,}"), F.lit(0)))
    return F.size(F.array_except(tokens(answer), tokens(evidence))) > 0
