"""Small fixtures of the library's own operators."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ostraka.functions.stats import fisher_exact, wilson
from ostraka.operators import align, audit, calibration, retrieval, structure, synth, text, witness
from ostraka.sources import archives
from ostraka.storage import Scratch
from ostraka.streaming import events


def _lines(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, scope string, unit string, family int, line int, tokens array<string>")


def test_spans_stay_inside_lines(spark):
    lines = _lines(spark, [(1, "s", "u", 1, 0, ["a", "b", "c"]), (1, "s", "u", 1, 1, ["d", "e", "f"]), (1, "s", "u", 1, 2, ["g"])])
    got = {(r.line, r.start, r.m) for r in witness.masked_spans(lines, 1, 1, "scope", "unit").collect()}
    assert got == {(0, 1, "b"), (1, 1, "e")}


def test_votes_and_omission(spark):
    rows = [(1, "s", "u", 1, 0, ["L", "g", "R"]), (2, "s", "u", 2, 0, ["L", "g", "R"]), (3, "s", "u", 3, 0, ["L", "v", "w", "R"]), (4, "s", "u", 4, 0, ["L", "R"]), (5, "s", "u", 2, 0, ["L", "g", "R"]), (6, "t", "u", 6, 0, ["L", "z", "R"])]
    lines = _lines(spark, rows)
    w = witness.counted(lines, 1, [1], "scope", "unit", spelled=True)
    c = {r.family: r for r in witness.candidates(w, [1], 5).where("m = 'g'").collect()}
    assert {x.m: x.support for x in c[1].first} == {"g": 1, "v\x1fw": 1, "": 1} and c[1].n_alt == 3
    s = witness.standings(w, [1]).where("family = 1").first()
    assert (s.n_alt, s.top, s.runner_up, s.unique_top, s.top_exact) == (3, 1, 1, False, False)
    census = witness.census(lines, 1, 1, "scope", "unit").first()
    assert census.eligible == 5 and census.exact == 3  # the two middles of the long line and the lone scope do not count


@pytest.mark.parametrize("seed", range(4))
def test_witness_counts_match_votes_cast_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [(d, rng.choice("st"), rng.choice("uv"), d // 2, i, [rng.choice("ab" if seed % 2 else "abcx") for _ in range(rng.randint(0, 9))]) for d in range(14) for i in range(rng.randint(1, 3))]
    rows = [r for r in rows if r[5]]
    index = {}
    for d, scope, _, f, _, t in rows:
        for i in range(len(t)):
            for n in range(13):
                if i + 2 + n <= len(t):
                    index.setdefault((scope, t[i], t[i + 1 + n]), set()).add((tuple(t[i + 1:i + 1 + n]), f))
    families = {}
    for r in rows:
        families.setdefault(r[1], set()).add(r[3])
    want, lists, n_spans = {}, {}, {}
    for d, scope, unit, f, line, t in rows:
        for i in range(1, len(t) - 1):
            if len(families[scope]) > 1:
                n_spans[unit] = n_spans.get(unit, 0) + 1
            votes = {}
            for m, g in index[(scope, t[i - 1], t[i + 1])]:
                if g != f:
                    votes[m] = votes.get(m, 0) + 1
            if votes:
                best = sorted(votes.values(), reverse=True) + [0]
                want[(d, line, i)] = (len(votes), sum(votes.values()), best[0], best[1], votes.get((t[i],), 0))
                lists[(d, line, i)] = sorted(((-s, "\x1f".join(m)) for m, s in votes.items()))
    lines = _lines(spark, rows)
    spans = witness.masked_spans(lines, 1, 1, "scope", "unit")
    w = Scratch(spark, "t").cut(witness.counted(lines, 1, [1], "scope", "unit", spelled=True), "w")
    key = [*witness.PAIR, "m", "family"]
    got = {(r.doc_id, r.line, r.start): (r.n_alt, r.total, r.top, r.runner_up, r.gold_support) for r in spans.join(witness.standings(w, [1]), key).collect()}
    assert got == want and want
    last, size = witness.tied_size(F.col("first"), F.col("n_alt"), F.col("levels"), F.col("own"), 3)
    for r in spans.join(witness.candidates(w, [1], 3).withColumn("last", last).withColumn("size", size), key).collect():
        full = lists[(r.doc_id, r.line, r.start)]
        assert [(-x.support, x.m) for x in r.first] == full[:3]
        assert r.size == sum(-s >= -full[min(3, len(full)) - 1][0] for s, _ in full)
    census = {r.unit: r for r in witness.census(lines, 1, 1, "scope", "unit").collect()}
    assert {u: r.eligible for u, r in census.items()} == n_spans
    assert sum(r.supported for r in census.values()) == len(want) and sum(r.exact for r in census.values()) == sum(x[4] > 0 for x in want.values())
    assert sum(r.ambiguous for r in census.values()) == sum(x[0] > 1 for x in want.values())


def test_tie_complete_and_disagreement(spark):
    df = spark.createDataFrame([(1, m, s) for m, s in (("a", 3), ("b", 2), ("c", 1), ("d", 1))], "sid int, middle string, support int")
    assert calibration.tie_complete(df, ["sid"], 3).count() == 4
    assert [r.middle for r in calibration.ranked(df, ["sid"]).orderBy("rank").collect()] == ["a", "b", "c", "d"]


def test_greedy_folds(spark):
    df = spark.createDataFrame([(1, 100), (2, 80), (3, 40), (4, 20), (5, 10), (6, 0)], "u int, w long")
    folds = {}
    for r in calibration.greedy_folds(df, "u", "w", 3).collect():
        folds.setdefault(r.fold, set()).add(r.u)
    assert sorted(map(sorted, folds.values())) == [[1], [2], [3, 4, 5, 6]]


def test_rules_and_full_abstention(spark):
    rules = calibration.rules(spark)
    assert rules.count() == 300 and rules.where("rule_id = 's1_m2_d0p0_a2'").count() == 1
    prof = spark.createDataFrame([(0, 2, 1, 0.67, 2, True, True, 60), (1, 0, 0, 0.0, 0, False, False, 5)], "fold int, top long, margin long, dominance double, n_alt long, unique_top boolean, top_exact boolean, n long")
    out = {(r.fold, r.target): r for r in calibration.cross_calibrate(prof, rules).collect()}
    assert len(out) == 8
    assert out[(0, 0.7)].rule_id is None and out[(0, 0.7)].accepted == 0  # the other fold has nothing to fit on
    assert out[(1, 0.7)].rule_id is not None and out[(1, 0.7)].accepted == 0


def test_wilson_and_fisher(spark):
    low, high = wilson(F.col("h"), F.col("n"))
    rows = spark.createDataFrame([(90, 100), (0, 0)], "h int, n int").select(low.alias("l"), high.alias("u")).collect()
    assert tuple(rows[0]) == (0.825634, 0.944771) and tuple(rows[1]) == (None, None)
    f = fisher_exact(17, 29, 76, 60)
    assert abs(f["odds_ratio"] - 0.4627949183) < 1e-9 and abs(f["two_sided"] - 0.0281429852) < 1e-9
    assert abs(f["greater"] - 0.9917895753) < 1e-9 and abs(f["less"] - 0.0199851163) < 1e-9
    assert fisher_exact(1, 0, 0, 1)["odds_ratio"] == float("inf")


def test_bm25_toy(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["c", "c", "d"]), (4, [])], "doc_id int, tokens array<string>")
    queries = spark.createDataFrame([(10, ["a", "c"]), (11, ["c", "c", "zz"])], "query_id int, tokens array<string>")
    got = {(r.query_id, r.doc_id): round(r.score, 6) for r in retrieval.bm25(docs, queries).collect()}
    assert got == {(10, 1): 1.481813, (10, 2): 0.693147, (10, 3): 0.853104, (11, 2): 0.693147, (11, 3): 0.853104}


def test_alignment_cases():
    def words(s):
        return s.split()

    exact = align.two_flanks(words("A B"), words("D E"), words("A B X D E"), 3)
    assert exact[0] == (("X",), 1.0)
    gapped = dict(align.two_flanks(words("A B C"), words("D E F"), words("A B Z C X D E F"), 3))
    assert ("X",) in gapped and gapped[("X",)] < 1.0
    assert all(len(m) <= 2 for m, _ in align.two_flanks(words("A B"), words("D E"), words("A B X Y Z D E"), 2))
    assert align.two_flanks(words("D E"), words("A B"), words("A B X D E"), 3) != exact


def test_alignment_counts_families_once(spark):
    spans = spark.createDataFrame([("q", 0, 1, ["A", "B"], ["D", "E"])], "sid string, scope int, family long, left array<string>, right array<string>")
    line = ["A", "B", "X", "D", "E"]
    lines = spark.createDataFrame([("l1", 0, 2, line), ("l2", 0, 2, line), ("own", 0, 1, line)], "lid string, scope int, family long, tokens array<string>")
    top = align.aligned(spans, lines).orderBy(F.desc("best")).first()
    assert (top.middle, top.families, top.best) == ("X", 1, 1.0)


def test_structure(spark):
    docs = spark.createDataFrame([(1, "a [b\nc] ⸢d x⸣ e"), (2, None)], "doc_id int, text string")
    states = [r.state for r in structure.milestone_states(structure.words(docs)).orderBy("pos").collect()]
    assert states == ["attested", "restored", "restored", "laes", "illegible_x", "attested"]
    pairs = spark.createDataFrame([([4, 5, 6], [2, 3, 4, 5, 6]), ([1, 2], [5, 6]), ([1, 3], [2, 4])], "a array<int>, b array<int>")
    got = [(r.shared, r.ordering, r.identifiable) for r in structure.structural_relation(pairs, "a", "b").collect()]
    assert got == [(3, "overlap", True), (0, "a_before_b", False), (0, "interleaved_without_shared_rows", False)]
    chain = spark.createDataFrame([("{KBx 1+KBx 2(+)KBx 3}",)], "c string").select(structure.member_chain(F.col("c")).alias("m")).first().m
    assert [(m.member, m.join) for m in chain] == [("KBx1", None), ("KBx2", "direct"), ("KBx3", "indirect")]
    glyphs = spark.createDataFrame([("ab", ["1", "2"]), ("▒ab", ["1", "2"]), ("a▒b", ["1", "2"]), ("abc", ["1"])], "g string, t array<string>")
    assert [r[0] for r in glyphs.select(structure.glyph_alignment(F.col("g"), F.col("t"))).collect()] == ["exact", "edge_trim", "skeleton_only", "unresolved"]


def test_families_take_the_least_id(spark):
    docs = spark.createDataFrame([(3, "t"), (1, "t"), (2, None), (5, None), (4, "u")], "doc_id int, text string")
    assert {r.doc_id: r.family for r in text.families(docs).collect()} == {1: 1, 3: 1, 2: 2, 5: 5, 4: 4}


def test_audits(spark):
    rows = spark.createDataFrame([(0.1, False), (0.2, True), (0.2, False), (0.3, True)], "s double, y boolean")
    assert audit.auc(rows, "s", "y").first().auc == 0.875
    left = spark.createDataFrame([("KBx 1.1",), ("P 5",), ("twin",)], "l string")
    right = spark.createDataFrame([("KBx 1.1+",), ("P. 5",), ("TWIN",), ("Twin",)], "r string")
    passes = [("exact", lambda c: c), ("plus", lambda c: F.regexp_replace(c, r"\+$", "")), ("format", lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")))]
    assert {(r.name, r.l, r.r) for r in audit.reconcile(left, right, passes).collect()} == {("plus", "KBx 1.1", "KBx 1.1+"), ("format", "P 5", "P. 5")}


def test_dense_search(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [2.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])]
    got = [(r.query_id, r.vec_id, r["rank"]) for r in audit.dense_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 4, 2), (100, 4, 1), (100, 1, 2)] or sorted(got) == sorted([(0, 1, 1), (0, 4, 2), (100, 4, 1), (100, 1, 2)])


def test_cuts_and_erosion_are_deterministic(spark):
    docs = spark.createDataFrame([(i, [f"l{k}" for k in range(12)]) for i in range(20)] + [(99, ["a"])], "doc_id int, lines array<string>")
    a, b = synth.vertical_cuts(docs, 5).collect(), synth.vertical_cuts(docs, 5).collect()
    assert sorted(map(tuple, [(r.doc_id, r.gap) for r in a])) == sorted(map(tuple, [(r.doc_id, r.gap) for r in b])) and len(a) == 20
    assert all(len(r.upper) + r.gap + len(r.lower) == 12 and r.upper and r.lower for r in a)
    worn = docs.select(synth.erode(F.col("lines"), 1.0, 1, F.col("doc_id")).alias("w")).first().w
    assert set(worn) == {"x"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t/CTH 12_XML/one.xml", "<a>x<b/>y</a>")
        z.writestr("t/CTH 13_XML/one.xml", "<a>")
        z.writestr("__MACOSX/t/._one.xml", "junk")
        z.writestr("t/notes.txt", "no")
    members = archives.xml_members(spark, str(tmp_path))
    assert members.count() == 2
    index = archives.archive_index(members).first()
    assert (index.stem, index.entries, index.groups) == ("one", 2, ["12", "13"])
    rows = archives.xml_events(members).orderBy("member", "pos").collect()
    assert [(r.event, r.tag, r.text) for r in rows if r.error is None] == [("start", "a", None), ("text", None, "x"), ("start", "b", None), ("end", "b", None), ("text", None, "y"), ("end", "a", None)]
    assert [r.error is not None for r in rows].count(True) == 1


def test_gate_comes_before_decoding(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"doc": "ok", "n": 1, "tail": {"x": [1, 2]}}\n{"doc": "blocked", "n": broken\n')
    allowed = spark.createDataFrame([("ok",)], "doc string")
    rows = archives.gated_json(spark, str(path), allowed, "doc string, n int", "doc", "tail").collect()
    assert [tuple(r) for r in rows] == [("ok", 1)]
    path.write_text('{"n": 1}\n')
    with pytest.raises(Exception, match="does not begin"):
        archives.gated_json(spark, str(path), allowed, "doc string, n int", "doc").collect()
    assert archives.canonical_hash({"b": 1, "a": "é"}) == archives.canonical_hash(json.loads('{"a":"é","b":1}'))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, "click", float(i)) for i in range(40)], "event_id long, user_id long, event_type string, value double")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 600)).withColumn("props", F.lit("{}"))
    rows.select("event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "e"))
    q = events.windowed(events.read(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("w").collect()))
    assert got == sorted(map(tuple, events.windowed(spark.read.parquet(str(tmp_path / "e"))).collect())) and len(got) == 7
