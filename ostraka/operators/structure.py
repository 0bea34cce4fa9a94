"""Marked-up texts as events, words, lines and members.

Editorial marks are milestones: ``[`` and ``]`` open and close what is restored, ``⸢`` and ``⸣``
what is damaged, across words and lines. The state at a word is the last mark before it in
document order, found with a running window inside the document; restored wins over damaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sides and their abbreviations in line labels.
SIDES = {"Vs.": "obverse", "Rs.": "reverse", "lk. Rd.": "left_edge", "r. Rd.": "right_edge", "u. Rd.": "lower_edge", "o. Rd.": "upper_edge"}
STATES = ("attested", "laes", "restored", "illegible_x")


def words(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, line, pos, word): words of every line in document order; ``pos`` numbers words through the document."""
    cut = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    toks = F.filter(F.split("s", "[ \t\r]+"), lambda t: t != "")
    each = cut.select(key, "line", F.posexplode(toks).alias("w", "word"))
    return each.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("line", "w")) - 1)


def _last_mark(word: Column, opens: str, closes: str) -> Column:
    """1 or 0 as the last mark of a word opens or closes; null without a mark."""
    o, c = F.locate(opens, F.reverse(word)), F.locate(closes, F.reverse(word))
    return F.when((o == 0) & (c == 0), None).when(c == 0, 1).when(o == 0, 0).when(o < c, 1).otherwise(0)


def milestone_states(word_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(..., state, open_r, open_d): attested, laes, restored or illegible_x per word, and whether a stretch is open where the word begins.

    A word is restored (damaged) if it begins inside an open stretch or opens one itself.
    """
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = word_rows.withColumn("dm", _last_mark(F.col("word"), "[", "]")).withColumn("lm", _last_mark(F.col("word"), "⸢", "⸣"))
    marked = marked.withColumn("open_r", F.coalesce(F.last("dm", ignorenulls=True).over(before), F.lit(0)) == 1).withColumn("open_d", F.coalesce(F.last("lm", ignorenulls=True).over(before), F.lit(0)) == 1)
    restored = F.col("open_r") | F.contains("word", F.lit("["))
    damaged = F.col("open_d") | F.contains("word", F.lit("⸢"))
    bare = F.translate("word", "[]⸢⸣()", "")
    state = F.when(bare == "x", "illegible_x").when(restored, "restored").when(damaged, "laes").otherwise("attested")
    return marked.withColumn("state", state).drop("dm", "lm")


def word_class(word: Column) -> Column:
    """number, determinative, logogram, syllabic or plain; the first that holds."""
    bare = F.translate(word, "[]⸢⸣()", "")
    return (F.when(bare.rlike(r"\A[0-9]+\z") | (bare == "<NUM>"), "number")
            .when(bare.rlike(r"\A\{[^{}]+\}"), "determinative")
            .when(bare.rlike(r"\A\p{Lu}[\p{Lu}.]+(?:-.*)?\z"), "logogram")
            .when(F.contains(bare, F.lit("-")), "syllabic").otherwise("plain"))


def signs(word_rows: DataFrame, *keep: str) -> DataFrame:
    """(``keep``..., sign, offset, state): signs of each word at their start offset in it, in the state that holds there; empty pieces are dropped.

    ``word_rows`` come from ``milestone_states``. Marks of the word before a sign change the state it begins in, a
    mark the sign itself begins with counts too, and a bare ``x`` is illegible whatever stands around it.
    """
    pieces = F.split("word", "-")
    at = F.transform(pieces, lambda p, i: F.struct(p.alias("sign"), F.array_join(F.slice(pieces, F.lit(1), i), "-").alias("before"), i.alias("i")))
    each = word_rows.select(*keep, "open_r", "open_d", F.explode(at).alias("s")).select(*keep, "open_r", "open_d", "s.*").where("sign <> ''")

    def inside(opens: str, closes: str, carried: str, begins: str) -> Column:
        last = _last_mark(F.col("before"), opens, closes)
        return F.when(last.isNull(), F.col(carried)).otherwise(last == 1) | F.col("sign").rlike(begins)

    bare = F.translate("sign", "[]⸢⸣()", "")
    state = (F.when(bare == "x", "illegible_x").when(inside("[", "]", "open_r", r"\A[⸢(]*\["), "restored").when(inside("⸢", "⸣", "open_d", r"\A[\[(]*⸢"), "laes").otherwise("attested"))
    offset = F.length("before") + F.when(F.col("i") > 0, 1).otherwise(0)
    return each.select(*keep, "sign", offset.alias("offset"), state.alias("state"))


def line_label(line: Column) -> dict[str, Column]:
    """side, number and prime of a labelled line; side is "other" where its abbreviation is unknown."""
    pattern = r"\A((?:\p{L}+\. ?)*+)([0-9]+)(′?) "
    head, number, prime = F.trim(F.regexp_extract(line, pattern, 1)), F.regexp_extract(line, pattern, 2), F.regexp_extract(line, pattern, 3)
    side = F.when(head == "", None)
    for short, name in SIDES.items():
        side = side.when(head == short, name)
    return {"side": side.otherwise("other"), "number": F.when(number != "", number.cast("int")), "prime": F.when(number != "", prime != "")}


def member_chain(c: Column) -> Column:
    """Ordered (member, join) of a chain such as ``{A+B(+)C}``: how each member joins the one before."""
    text = F.regexp_replace(c, r"[{}\s]", "")
    names = F.filter(F.split(text, r"\(\+\)|\+"), lambda t: t != "")
    joins = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.regexp_extract_all(text, F.lit(r"(\(\+\)|\+)"), 1), lambda j: F.when(j == "+", "direct").otherwise("indirect")))
    return F.zip_with(names, F.slice(joins, F.lit(1), F.size(names)), lambda n, j: F.struct(n.alias("member"), j.alias("join")))


def relation_basis(join_type: Column, adjacent: Column) -> Column:
    """What a join relation rests on; combinations the sources do not state are unknown."""
    return (F.when(adjacent & (join_type == "+"), "direct").when(adjacent & (join_type == "(+)"), "indirect")
            .when(~adjacent & (join_type == "inferred"), "inferred").otherwise("unknown"))


def structural_relation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(..., shared, ordering, deltas, identifiable, consistent) of two arrays of line numbers."""
    common = F.array_intersect(a, b)
    deltas = F.array_distinct(F.transform(common, lambda x: F.array_position(b, x) - F.array_position(a, x)))
    ordering = (F.when(F.size(common) > 0, "overlap").when(F.array_max(a) < F.array_min(b), "a_before_b")
                .when(F.array_max(b) < F.array_min(a), "b_before_a").otherwise("interleaved_without_shared_rows"))
    return pairs.select("*", F.size(common).alias("shared"), ordering.alias("ordering"), F.size(deltas).alias("deltas"),
                        ((F.size(common) > 0) & (F.size(deltas) == 1)).alias("identifiable"), (F.size(deltas) <= 1).alias("consistent"))


def islands(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(``key``, ``value``, length): maximal runs of one value along the order, per key."""
    w = Window.partitionBy(key).orderBy(*order)
    v = Window.partitionBy(key, value).orderBy(*order)
    tagged = rows.select(key, value, (F.row_number().over(w) - F.row_number().over(v)).alias("g"))
    return tagged.groupBy(key, value, "g").agg(F.count(F.lit(1)).alias("length")).drop("g")


def glyph_alignment(glyphs: Column, tokens: Column) -> Column:
    """How a glyph row and a token row agree: exact, edge_trim, skeleton_only or unresolved.

    Glyphs are one sign each; lost signs (▒) at the edges may be missing among the tokens.
    """
    trimmed = F.regexp_replace(glyphs, "^▒+|▒+$", "")
    n, t, core = F.char_length(glyphs), F.size(tokens), F.char_length(trimmed)
    return (F.when(n == t, "exact").when(core == t, "edge_trim")
            .when(F.char_length(F.translate(glyphs, "▒", "")) == F.size(F.filter(tokens, lambda x: x != "x")), "skeleton_only").otherwise("unresolved"))


def codepoint_class(c: Column) -> Column:
    """Class of a single character by its code point."""
    cp = F.ascii(c)
    return (F.when(cp < 0x80, "ascii").when(cp < 0x100, "latin1").when(cp < 0x250, "latin_extended").when((cp >= 0x300) & (cp < 0x370), "combining")
            .when((cp >= 0x2000) & (cp < 0x2070), "punctuation").when((cp >= 0x2080) & (cp < 0x20A0), "subscript").when((cp >= 0x12000) & (cp < 0x12550), "wedge_sign").otherwise("other"))
