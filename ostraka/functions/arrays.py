"""Array expressions: n-grams, windows and set measures, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIGRAM_MARK = "␟"


def starts(tokens: Column, width: int | Column) -> Column:
    """1-based start positions of the windows of ``width`` tokens; empty when there is none."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.when(F.size(tokens) >= w, F.sequence(F.lit(1), F.size(tokens) - w + 1)).otherwise(F.array().cast("array<int>"))


def ngrams(tokens: Column, n: int) -> Column:
    return F.transform(starts(tokens, n), lambda i: F.slice(tokens, i, n))


def with_bigrams(tokens: Column) -> Column:
    """The tokens, then their adjacent pairs joined by a mark; fewer than two tokens stay as they are."""
    pairs = F.transform(starts(tokens, 2), lambda i: F.concat(F.get(tokens, i - 1), F.lit(BIGRAM_MARK), F.get(tokens, i)))
    return F.concat(tokens, pairs)


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct tokens; 0 if either side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def interleave_lines(lines: Column, mark: str) -> Column:
    """Token lists of lines joined into one, with ``mark`` between lines and none after the last."""
    marked = F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.array(F.lit(mark)), x)))
    return F.flatten(marked)
