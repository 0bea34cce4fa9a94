"""Renderings of marked-up words as tokens, structured sequences and ids, and what labels and names say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that stand for structure, in the order of their ids.
SPECIALS = ("<PAD>", "<UNK>", "<MASK>", "<LINE>", "<EDGE_T>", "<EDGE_B>", "<EDGE_L>", "<EDGE_R>", "<GAP>")
#: Words of titles of catch-all bins, and how long such a title may be.
BIN_WORDS = r"(?i)fragmente|fragments?|bruchst[uü]cke|unbestimmbar|unidentif|divers|unclassified|nicht zugeordnet"
BIN_TITLE_WORDS = 6

_MARKS = "[]⸢⸣()"


def bare(word: Column) -> Column:
    """A word without editorial marks."""
    return F.translate(word, _MARKS, "")


def word_tokens(word: Column, kind: Column, state: Column, attested: bool) -> Column:
    """Tokens of one word: nothing for an empty word or, if ``attested``, for a restored one; ``<NUM>`` for
    a number; one token for a logogram or determinative; the signs of any other."""
    text = bare(word)
    signs = F.filter(F.split(text, "-"), lambda s: s != "")
    out = F.when(text == "", F.array().cast("array<string>"))
    if attested:
        out = out.when(state == "restored", F.array().cast("array<string>"))
    return out.when(kind == "number", F.array(F.lit("<NUM>"))).when(kind.isin("logogram", "determinative"), F.array(text)).otherwise(signs)


def rendered(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, full, attested, ideograms, n_attested): token lists of each document from (``key``, pos, word, class, state)."""
    row = words.select(
        key, "pos", word_tokens(F.col("word"), F.col("class"), F.col("state"), False).alias("f"), word_tokens(F.col("word"), F.col("class"), F.col("state"), True).alias("a"),
        F.when((F.col("class") == "logogram"), F.array(bare(F.col("word")))).otherwise(F.array().cast("array<string>")).alias("i"))
    listed = row.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "f", "a", "i"))).alias("xs"))

    def joined(name: str) -> Column:
        return F.flatten(F.transform("xs", lambda x: x[name]))

    return listed.select(key, joined("f").alias("full"), joined("a").alias("attested"), joined("i").alias("ideograms"), F.size(joined("a")).alias("n_attested"))


def structured(lines: Column, top_lost: Column, bottom_lost: Column) -> Column:
    """Lines (arrays of tokens) as one sequence between edges, with ``<LINE>`` between lines; a lost edge is a ``<GAP>``."""
    between = F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.array(F.lit("<LINE>")), x)))
    first = F.array(F.when(top_lost, F.lit("<GAP>")).otherwise(F.lit("<EDGE_T>")))
    last = F.array(F.when(bottom_lost, F.lit("<GAP>")).otherwise(F.lit("<EDGE_B>")))
    return F.concat(first, F.flatten(between), last)


def informative(tokens: Column) -> Column:
    """Tokens of a line that tell something: neither structure nor worn signs."""
    return F.filter(tokens, lambda t: ~t.isin(*SPECIALS, "<NUM>", "<PAR>") & (t != "x"))


def vocabulary(tokens: DataFrame, key: str, min_df: int = 2) -> DataFrame:
    """(token, df, id): tokens of at least ``min_df`` records, numbered in their order after the special tokens.

    Ids are given by ranges: the sorted partitions are counted, and each adds what stands before it,
    so no task numbers the whole vocabulary.
    """
    df = tokens.select(key, F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return numbered(df, "token", len(SPECIALS))


def numbered(rows: DataFrame, order: str, first: int) -> DataFrame:
    """``rows`` with a column id: their place in the order, counted from ``first``; distinct values of ``order`` are assumed."""
    from ..storage import Scratch

    placed = Scratch(rows.sparkSession, "numbered").cut(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    before, total = [], first
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    starts = rows.sparkSession.createDataFrame(before, "part int, before long")
    return placed.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("before") + F.col("n")).alias("id"))


def token_ids(records: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(``key``, ids): tokens as ids in order, unknown ones as that of ``<UNK>``; an empty list stays empty."""
    each = records.select(key, F.posexplode_outer("tokens").alias("pos", "token"))
    met = each.join(vocab.select("token", "id"), "token", "left")
    unknown = F.lit(SPECIALS.index("<UNK>")).cast("long")
    pair = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", unknown).alias("id")))
    return met.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["id"]).alias("ids"))


def fine_tokens(text: Column) -> Column:
    """Sub-word pieces of a word: ``<PAR>`` for a paragraph rule, ``<NUM>`` for a number; a logogram is cut at
    ``-`` and ``.`` unless it holds ``×``; other words are cut at ``-`` and lower-cased."""
    t = bare(text)
    logogram = t.rlike(r"\A\p{Lu}[\p{Lu}×.]+(?:-.*)?\z")
    cut = F.when(t.rlike(r"\A[§=_]+\z"), F.array(F.lit("<PAR>"))).when(t.rlike(r"\A[0-9]+\z") | (t == "<NUM>"), F.array(F.lit("<NUM>")))
    cut = cut.when(logogram & (F.instr(t, "×") > 0), F.split(t, "-")).when(logogram, F.split(t, "[-.]")).otherwise(F.split(F.lower(t), "-"))
    return F.filter(cut, lambda s: s != "")


_SIGLA = r"\A\s*\{€([0-9+]+)\}\s*"


def full_label(raw: Column) -> dict[str, Column]:
    """What a line label says: member siglum (where there is one only), all sigla, side, side as written, column, remainder."""
    text = F.coalesce(raw, F.lit(""))
    group = F.regexp_extract(text, _SIGLA, 1)
    sigla = F.when(group != "", F.split(group, r"\+")).otherwise(F.array().cast("array<string>"))
    remainder = F.trim(F.regexp_replace(text, _SIGLA, ""))
    head = F.regexp_extract(remainder, r"\A((?:[^0-9 ]+(?: |\z))*)", 1)
    parts = F.filter(F.split(F.trim(head), " "), lambda t: t != "")
    roman = F.filter(parts, lambda t: t.rlike(r"\A[IVX]+\z"))
    written = F.array_join(F.filter(parts, lambda t: ~t.rlike(r"\A[IVX]+\z")), " ")
    from .structure import SIDES

    side = F.when(written == "", None)
    for short, name in SIDES.items():
        side = side.when(written == short, name)
    return {
        "siglum": F.when(F.size(sigla) == 1, F.get(sigla, F.lit(0))), "sigla": sigla, "side": side.otherwise("other"), "side_raw": F.when(written != "", written),
        "column": F.when(F.size(roman) > 0, F.element_at(roman, -1)), "remainder": remainder}


def side_column_edge(label: Column) -> dict[str, Column]:
    """Side, column and physical edge named in a label, the first pattern that holds, and whether it is marked uncertain."""
    s = F.trim(label)
    edge = (F.when(s.rlike(r"\bu\.\s*Rd\.?"), "lower").when(s.rlike(r"\bo\.\s*Rd\.?"), "upper").when(s.rlike(r"\blk\.\s*Rd\.?"), "left").when(s.rlike(r"\b(r|re)\.\s*Rd\.?"), "right"))
    side = (F.when(s.rlike(r"\bSeite\s*A\b"), "side_A").when(s.rlike(r"\bSeite\s*B\b"), "side_B")
            .when(s.rlike(r"\bVs\.?") | s.rlike(r"(?i)\bobv\.?"), "obverse").when(s.rlike(r"\bRs\.?") | s.rlike(r"(?i)\brev\.?"), "reverse"))
    # a numeral stands by itself: what is a letter beside it must not depend on the dialect's word boundary
    off = r"[^\p{L}\p{M}\p{N}_]"
    roman, small = (F.regexp_extract(s, rf"(?:^|{off})({n})(?:$|{off})", 1) for n in ("I{1,3}|IV|VI?", "i{1,3}|iv|vi?"))
    column = (F.when(s.rlike(r"(?i)\b(lk|li|l)\.\s*(Kol|col)\.?"), "left").when(s.rlike(r"(?i)\b(r|re)\.\s*(Kol|col)\.?"), "right")
              .when(roman != "", roman).when(small != "", F.upper(small)))
    return {"side": side, "column": column, "edge": edge, "uncertain": F.coalesce((F.instr(s, "?") > 0) | (F.instr(s, "!") > 0), F.lit(False))}


def bin_title(title: Column, seeded: Column) -> dict[str, Column]:
    """Whether a title names a catch-all bin: a telling word in a short title; in a long one, or without the word for a seeded number, it is uncertain."""
    told, words = title.rlike(BIN_WORDS), F.size(F.filter(F.split(title, r"\s+"), lambda t: t != ""))
    return {
        "is_bin": told & (words <= BIN_TITLE_WORDS), "uncertain": (told & (words > BIN_TITLE_WORDS)) | (~told & seeded),
        "reason": F.when(~told & seeded, "seeded_without_word").when(~told, "no_word").when(words <= BIN_TITLE_WORDS, "word_in_short_title").otherwise("word_in_long_title")}


def name_keys(names: DataFrame, column: str) -> DataFrame:
    """``names`` with folded (NFKC, case folded), letters (ASCII letters of the NFKD form) and numbers (joined by ``.``) of ``column``.

    Unicode normal forms have no Spark expression; the distinct names pass through one Arrow batch at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import unicodedata

        for frame in frames:
            values = frame[column]
            folded = values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())
            letters = values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v).casefold() if "a" <= c <= "z"))
            yield pd.DataFrame({column: values, "folded": folded, "letters": letters})

    distinct = names.select(column).where(F.col(column).isNotNull()).distinct()
    keyed = distinct.mapInPandas(run, f"{column} string, folded string, letters string")
    keyed = keyed.withColumn("numbers", F.array_join(F.regexp_extract_all(column, F.lit("([0-9]+)"), 1), "."))
    return names.join(keyed, column, "left")


# The names of the categories and the marks they are told by.
def parse_failure(line: Column, message: Column, column: Column, text: Column) -> Column:
    """Category of an XML failure by the line it stands in, the first that holds."""
    quoted = F.length(F.regexp_replace(F.substring(line, F.lit(1), column), '[^"]', "")) % 2 == 1

    def count(needle: str) -> Column:
        return (F.length(line) - F.length(F.replace(line, F.lit(needle), F.lit("")))) / len(needle)

    marker = "<w><del_in/><del_fin/>"
    # after a marker a line or the text ends before the word does
    left_open = F.exists(
        F.slice(F.split(text, marker, -1), F.lit(2), F.greatest(F.size(F.split(text, marker, -1)) - 1, F.lit(0))),
        lambda rest: rest.rlike(r"(?s)(?:<lb|</text>)") & ~F.regexp_extract(rest, r"(?s)\A(.*?)(?:<lb|</text>)", 1).contains("</w>"))
    return (F.when(line.contains("<AO:-LineNrExpl"), "invalid_qname_ao_dash_linenr")
            .when(message.contains("invalid token") & (F.substring(line, column + 1, F.lit(2)) == "</") & quoted, "unescaped_markup_inside_attribute")
            .when(line.contains("<AO:TxtPubl>") & line.contains("</TxtPubl>"), "namespace_prefix_mismatch")
            .when(message.contains("mismatched tag") & (count("<sGr>") > count("</sGr>")) & line.contains("</w>"), "unclosed_inline_element_before_word_close")
            .when(message.contains("mismatched tag") & F.coalesce(left_open, F.lit(False)), "unclosed_empty_damage_word_at_line_boundary").otherwise("unclassified_parse_failure"))


def closed_bin(value: Column, bins: list[tuple[str, int, int | None]]) -> Column:
    """Name of the closed bin (low to high, null high is open) a value lies in; a value in none stops the job."""
    out = None
    for name, low, high in bins:
        inside = (value >= low) if high is None else value.between(low, high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(F.raise_error(F.lit("a value lies in no configured bin")).cast("string"))


def basis_family(bases: Column) -> Column:
    """``X_only`` for one basis, ``mixed:A+B`` for several, in their order."""
    names = F.array_sort(F.array_distinct(bases))
    return F.when(F.size(names) == 1, F.concat(F.get(names, F.lit(0)), F.lit("_only"))).when(F.size(names) > 1, F.concat(F.lit("mixed:"), F.array_join(names, "+")))


# The names of the outcomes.
def outcome(n_alt: Column, unique_top: Column, accepted: Column, exact: Column) -> Column:
    """What is presented of a span: nothing for want of evidence, for a tie or by the rule, else the top reading, which agrees or differs."""
    return (F.when(n_alt == 0, "abstain_no_anchor_evidence").when(~unique_top, "abstain_evidence_tie").when(~accepted, "abstain_calibrated_threshold")
            .when(exact, "accepted_exact_agreement").otherwise("accepted_variant"))


def names_term(name: Column, term: Column) -> Column:
    """Whether a name holds a term, both without case and anything but letters and digits."""
    def fold(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")

    return (fold(term) != "") & F.contains(fold(name), fold(term))
