"""Contracts, policy, renderings and label parsers on small fixtures."""

import pytest
from pyspark.sql import functions as F

from ostraka.operators import contracts as ct
from ostraka.operators import rendering as rn


def test_lineage_takes_the_most_interpretive_class_and_denial(spark):
    fields = spark.createDataFrame([("a", "OBSERVED_ARTIFACT"), ("b", "EDITORIAL_RESTORATION"), ("c", "SYSTEM_TECHNICAL"), ("d", "CATALOG_METADATA")], "field string, declared string")
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("c", "d"), ("c", "d")], "field string, depends_on string")
    denied = spark.createDataFrame([("d",)], "field string")
    got = {r.field: (r.effective, r.denied) for r in ct.lineage(fields, edges, denied).collect()}
    assert got == {"a": ("EDITORIAL_RESTORATION", False), "b": ("EDITORIAL_RESTORATION", False), "c": ("EDITORIAL_RESTORATION", True), "d": ("CATALOG_METADATA", True)}
    assert ct.lineage(fields.limit(0), edges.limit(0)).count() == 0


@pytest.mark.parametrize("field, edge", [(("x", "NO_SUCH_CLASS"), None), (None, ("b", "a")), (None, ("a", "nowhere")), (None, ("a", "a"))])
def test_lineage_fails_closed(spark, field, edge):
    fields = [("a", "OBSERVED_ARTIFACT"), ("b", "EDITORIAL_RESTORATION")] + ([field] if field else [])
    edges = [("a", "b")] + ([edge] if edge else [])
    with pytest.raises(Exception):
        ct.lineage(spark.createDataFrame(fields, "field string, declared string"), spark.createDataFrame(edges, "field string, depends_on string")).collect()


def test_policy_order_of_verdicts(spark):
    rows = [(None, False), ("MODEL_DERIVED", True), ("MODEL_DERIVED", False), ("SYSTEM_TECHNICAL", False), ("OBSERVED_ARTIFACT", False)]
    df = spark.createDataFrame(rows, "e string, d boolean")
    plain = [r[0] for r in df.select(ct.policy_verdict(F.col("e"), F.col("d"), "artifact_strict")).collect()]
    assert plain == ["unknown_field", "denied_lineage", "class_not_admitted", "admitted", "admitted"]
    assert df.select(ct.policy_verdict(F.col("e"), F.col("d"), "artifact_strict", True)).collect()[3][0] == "technical_as_feature"
    assert df.select(ct.policy_verdict(F.col("e"), F.col("d"), "discovery_assisted")).collect()[2][0] == "admitted"


def test_guard_stops(spark):
    labels = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "other"), ("d", None)], "id string, label string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "id string")
    assert {r.id: r.breach for r in ct.guard(ids, labels, "id").collect()} == {"a": None, "b": "test", "c": "unknown_split", "d": "missing", "e": "missing"}
    assert ct.guarded(ids.where("id = 'a'"), labels, "id").count() == 1
    for bad in "bcde":
        with pytest.raises(Exception):
            ct.guarded(ids.where(f"id = '{bad}'"), labels, "id").collect()
    with pytest.raises(ValueError):
        ct.dev_only("test")
    ct.dev_only("dev")


def test_stamps_do_not_depend_on_order_and_are_checked(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "k int, v string")
    a, b = (ct.stamp(x, "u", "k", "v").first() for x in (df, df.orderBy(F.desc("k")).repartition(3)))
    assert a == b and a.content != ct.stamp(df.where("k > 0"), "u", "k", "v").first().content
    assert ct.expect_stamp(ct.stamp(df, "u", "k"), "u", 50).count() == 1
    for name, n in (("w", 50), ("u", 49)):
        with pytest.raises(Exception):
            ct.expect_stamp(ct.stamp(df, "u", "k"), name, n).collect()


def test_reachability_health_and_partitions(spark):
    truth = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c"), ("q3", "c")], "query string, gold string")
    cand = spark.createDataFrame([("a",)], "gold string")
    declared = spark.createDataFrame([("q1", "b"), ("q2", None)], "query string, gold string")
    assert [tuple(r) for r in ct.unreachable(truth, cand, declared).collect()] == [("q3", "c")]
    rows = spark.createDataFrame([(1.0, float("nan"), 5.0), (2.0, 1.0, 5.0)], "a double, b double, c double")
    assert {r.feature: r.degenerate for r in ct.feature_health(rows, ["a", "b", "c"]).collect()} == {"a": False, "b": True, "c": True}
    coefs = spark.createDataFrame([("x", -0.5, 1), ("y", 0.0, 1), ("z", 0.5, None), ("w", 0.5, 1)], "feature string, coefficient double, intent int")
    assert [r.feature for r in ct.against_intent(coefs).collect()] == ["x"]
    whole = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    parts = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (9, 1)], "k int, fold int")
    assert tuple(ct.partition_faults(whole, parts, "k", "fold").first()) == (1, 1, 1)


def test_ids_of_tokens(spark):
    docs = spark.createDataFrame([("d1", ["b", "a", "a"]), ("d2", ["a", "c", "b"]), ("d3", [])], "k string, tokens array<string>")
    vocab = rn.vocabulary(docs, "k")
    first = len(rn.SPECIALS)
    assert {r.token: (r.df, r.id) for r in vocab.collect()} == {"a": (2, first), "b": (2, first + 1)}
    assert {r.k: r.ids for r in rn.token_ids(docs, vocab, "k").collect()} == {"d1": [first + 1, first, first], "d2": [first, 1, first + 1], "d3": []}


def test_labels(spark):
    df = spark.createDataFrame([("{€1+2} Vs. II 3′",), ("{€4} Rs. 12",), ("5",), ("xyz IV 1",), (None,), ("lk. Rd. 2",)], "s string")
    got = [tuple(r) for r in df.select(*[rn.full_label(F.col("s"))[n] for n in ("siglum", "sigla", "side", "side_raw", "column", "remainder")]).collect()]
    assert got[0] == (None, ["1", "2"], "obverse", "Vs.", "II", "Vs. II 3′") and got[1] == ("4", ["4"], "reverse", "Rs.", None, "Rs. 12")
    assert got[2][2:5] == (None, None, None) and got[3][2:5] == ("other", "xyz", "IV") and got[4][5] == "" and got[5][2] == "left_edge"
    edge = spark.createDataFrame([("Vs. li. Kol. 3?",), ("Seite B ii 4",), ("u. Rd. 1",), (None,)], "s string")
    got = [tuple(r) for r in edge.select(*[rn.side_column_edge(F.col("s"))[n] for n in ("side", "column", "edge", "uncertain")]).collect()]
    assert got == [("obverse", "left", None, True), ("side_B", "II", None, False), (None, None, "lower", False), (None, None, None, False)]


@pytest.mark.parametrize("line, message, column, text, want", [
    ("x <AO:-LineNrExpl a>", "m", 0, "", "invalid_qname_ao_dash_linenr"),
    ('<a b="x</i>">', "not well-formed (invalid token)", 7, "", "unescaped_markup_inside_attribute"),
    ("<AO:TxtPubl>K</TxtPubl>", "mismatched tag", 0, "", "namespace_prefix_mismatch"),
    ("<w><sGr>A</w>", "mismatched tag", 0, "", "unclosed_inline_element_before_word_close"),
    ("<lb/>", "mismatched tag", 0, "<w><del_in/><del_fin/><lb/>", "unclosed_empty_damage_word_at_line_boundary"),
    ("<lb/>", "mismatched tag", 0, "<w><del_in/><del_fin/></w><lb/>", "unclassified_parse_failure"),
])
def test_categories_of_failures(spark, line, message, column, text, want):
    df = spark.createDataFrame([(line, message, column, text)], "l string, m string, c int, t string")
    assert df.select(rn.parse_failure(F.col("l"), F.col("m"), F.col("c"), F.col("t"))).first()[0] == want


def test_names_bins_and_titles(spark):
    names = spark.createDataFrame([("Kü 1-22",), ("ＫＵＢ 3",), (None,)], "n string")
    got = {r.n: (r.folded, r.letters, r.numbers) for r in rn.name_keys(names, "n").collect()}
    assert got["Kü 1-22"] == ("kü 1-22", "ku", "1.22") and got["ＫＵＢ 3"] == ("kub 3", "kub", "3") and got[None] == (None, None, None)
    assert spark.range(1).select(rn.closed_bin(F.lit(7), [("a", 0, 5), ("b", 6, None)])).first()[0] == "b"
    with pytest.raises(Exception):
        spark.range(1).select(rn.closed_bin(F.lit(-1), [("a", 0, 5)])).collect()
    titles = spark.createDataFrame([("Fragmente", False), ("Fragments of a long treaty with the king of Kizzuwatna", False), ("Treaty", True), ("Treaty", False)], "t string, s boolean")
    t = rn.bin_title(F.col("t"), F.col("s"))
    assert [tuple(r) for r in titles.select(t["is_bin"], t["uncertain"]).collect()] == [(True, False), (False, True), (False, True), (False, False)]
    fam = spark.createDataFrame([(["+"],), (["dup", "+", "+"],), ([],)], "b array<string>")
    assert [r[0] for r in fam.select(rn.basis_family(F.col("b"))).collect()] == ["+_only", "mixed:+" + "+dup", None]
