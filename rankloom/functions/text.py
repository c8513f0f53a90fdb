"""Token features of text columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every Unicode space, and the four separators that count as spaces as well.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens, without empty ones."""
    return F.array_remove(F.split(F.lower(text), WHITESPACE), "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def token_overlap(left: Column, right: Column) -> Column:
    """Number of distinct tokens that both texts hold."""
    return F.size(F.array_intersect(tokens(left), tokens(right)))


def keyword_count(text: Column, keyword: str) -> Column:
    """Occurrences of ``keyword`` as a substring, none overlapping another."""
    lowered, keyword = F.lower(text), keyword.lower()
    removed = F.length(lowered) - F.length(F.replace(lowered, F.lit(keyword), F.lit("")))
    return (removed / F.lit(len(keyword))).cast("int")


def pair_features(query: Column, document: Column, keyword: str = "learning") -> list[Column]:
    """Query length, document length, common tokens, keyword in query and in document."""
    return [
        token_count(query).alias("query_tokens"),
        token_count(document).alias("document_tokens"),
        token_overlap(query, document).alias("common_tokens"),
        keyword_count(query, keyword).alias("query_keyword"),
        keyword_count(document, keyword).alias("document_keyword"),
    ]


def preview(text: Column, n: int = 50, always: bool = False) -> Column:
    """The first ``n`` characters for display, dotted if cut (or always)."""
    dotted = F.concat(F.substring(text, 1, n), F.lit("..."))
    return dotted if always else F.when(F.length(text) > n, dotted).otherwise(text)
