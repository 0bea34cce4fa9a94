"""String expressions shared by operators: what counts as white space, and what stands outside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that separate tokens (Unicode white space and the ASCII separators).
WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The same characters, for a trim that looks at the ends of a value only.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trimmed(c: Column) -> Column:
    """Without outer white space; a value of white space only is null."""
    t = F.trim(c, F.lit(BLANKS))
    return F.when(t != "", t)


def pieces(c: Column) -> Column:
    """The pieces between white space; null for null."""
    return F.filter(F.split(c, WHITE), lambda t: t != "")
