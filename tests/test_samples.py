"""Composites, samples, packets, classification, files, and what must not change a score."""

import hashlib
import math
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ostraka.operators import audit, bayes, packets, retrieval, synth, thirds
from ostraka.operators import calibration as cal
from ostraka.operators import composites as co
from ostraka.operators import sampling as sm
from ostraka.plans import samples
from ostraka.sources import archives, files
from ostraka.storage import Scratch, scratch_scope


def test_members_pairs_tiers_and_quarantine(spark):
    members = spark.createDataFrame([("P", "1", 1), ("P", "2", 2), ("P", "3", 3), ("Q", "1", 1), ("R", "1", 1), ("R", "2", 2)], "parent string, member string, ord int")
    rows = [("P", i, "1", 3) for i in range(10)] + [("P", i, "2", 3) for i in range(5, 14)] + [("P", 9, "3", 3), ("P", 99, "9", 1), ("Q", 1, "1", 1)]
    lines = spark.createDataFrame(rows, "parent string, line int, member string, signs int")
    got = {(r.parent, r.member_a, r.member_b): (r.declared, r.n_shared, r.geometry) for r in co.member_pairs(members, lines).collect()}
    assert got == {
        ("P", "1", "2"): (True, 5, "extended_overlap_duplicate_like"), ("P", "2", "3"): (True, 1, "seam_single_line_transition"),
        ("P", "1", "3"): (False, 1, "seam_single_line_transition"), ("R", "1", "2"): (True, 0, "no_overlap_seam")}
    assert [r.parent for r in co.quarantined(members, lines).collect()] == ["R"]
    t = {(r.member_a, r.member_b): r for r in co.tiered(co.member_pairs(members, lines), lines).where("parent = 'P'").collect()}
    assert (t["1", "2"].tier, t["1", "2"].lines_a, t["1", "2"].signs_b, t["1", "2"].untestable) == ("C", 5, 12, False)
    assert (t["2", "3"].tier, t["2", "3"].lines_a, t["2", "3"].untestable) == ("B", None, None)
    assert co.member_pairs(members.limit(0), lines).count() == 0


def test_lost_edges(spark):
    rows = [
        ("a", 0, True, None, None, "x", "x"), ("a", 1, False, False, None, "attested", "laes"), ("a", 2, False, False, None, "laes", "restored"),
        ("b", 0, False, True, None, "attested", "attested"), ("b", 1, True, None, None, "x", "x"),
        ("c", 0, True, None, "upper", "x", "x"), ("c", 1, False, False, None, "attested", "attested"), ("d", 0, True, None, None, "x", "x")]
    df = spark.createDataFrame(rows, "k string, line int, gap boolean, prime boolean, edge string, first string, last string")
    got = {r.k: (r.lines, r.top_lost, r.bottom_lost, r.first_state, r.last_state) for r in co.edge_profile(df, "k").collect()}
    assert got == {"a": (2, True, False, "attested", "restored"), "b": (1, True, True, "attested", "attested"), "c": (1, False, False, "attested", "attested")}


def test_quotas_strata_and_samples(spark):
    rows = spark.createDataFrame([("A", "u", 1), ("A", "u", 2), ("A", "v", 3), ("A", "u", 4), ("B", "w", 5), ("B", "w", 6)], "c string, u string, k int")
    got = {(r.c, r.k): r.place for r in sm.quota(rows, "c", "u", ["k"], 3).collect()}
    assert got == {("A", 1): 1, ("A", 3): 2, ("A", 2): 3, ("B", 5): 1, ("B", 6): 2}
    assert sm.quota(rows, "c", "u", ["k"], 3, fill=False).count() == 3
    units = spark.createDataFrame([(i, "big") for i in range(40)] + [(100 + i, "three") for i in range(3)] + [(200, "one")], "u int, s string")
    by = {}
    for r in sm.stratified(units, "u", "s", 0.8, 0.1).collect():
        by.setdefault(r.s, []).append(r.split)
    assert sorted(by["three"]) == ["dev", "test", "train"] and by["big"].count("train") == 32 and by["big"].count("dev") == 4 and by["one"] == ["train"]
    w = spark.createDataFrame([(i, 10) for i in range(50)], "u int, n int")
    assert sm.until_enough(w, "u", "n", 7, 1000).count() == 7 and sm.until_enough(w, "u", "n", 30, 35).count() == 4
    values = spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,)], "v double")
    assert sorted(r.v for r in sm.hard_quarter(values, "v").collect()) == [1.0, 2.0]


def test_best_place_gap_and_adjacency(spark):
    rows = spark.createDataFrame([("k", 0.5, "b", 1), ("k", 0.5, "a", 2), ("k", 0.1, "a", 0), ("m", None, "a", 0)], "k string, s double, d string, o int")
    assert [tuple(r) for r in sm.best_with_place(rows, ["k"], "s", ["d", "o"], 0.2).collect()] == [("k", 0.5, "a", 2, 2)]
    a = spark.createDataFrame([("x", 10, 9), ("y", 0, 0)], "k string, accepted long, exact long")
    b = spark.createDataFrame([("x", 20, 10), ("y", 5, 5)], "k string, accepted long, exact long")
    assert tuple(sm.transfer_gap(a, b, ["k"]).first()) == (40.0, 1)
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), (None, "c"), ("a", "c")], "x string, y string")
    assert {tuple(r) for r in sm.adjacency(pairs, "x", "y").collect()} == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}
    members = spark.createDataFrame([("g", m) for m in "abcd"] + [("g", "a"), ("h", "z"), (None, "q")], "g string, m string")
    known = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "z"), (None, "a")], "member_a string, member_b string")
    assert {tuple(r) for r in sm.unlinked_pairs(members, "g", "m", known).collect()} == {("g", 4, 6, 1, 5), ("h", 1, 0, 0, 0)}


def test_sequential_rules(spark):
    w = spark.createDataFrame([(1, 100), (2, 80), (3, 40), (4, 20), (5, 10), (6, 0)], "u int, w long")
    shares = {"train": 0.8, "dev": 0.1, "test": 0.1}
    got = {r.u: r.split for r in audit.greedy_split(w, "u", "w", shares).collect()}
    held, want = dict.fromkeys(shares, 0.0), {}
    for u, n in ((1, 100), (2, 80), (3, 40), (4, 20), (5, 10), (6, 0)):
        s = min(shares, key=lambda x: (held[x] / shares[x], list(shares).index(x)))
        held[s] += n
        want[u] = s
    assert got == want
    assert audit.greedy_split(w.limit(0), "u", "w", shares).count() == 0 and cal.greedy_folds(w.limit(0), "u", "w", 3).count() == 0


def test_packets_hide_the_answer_and_are_checked(spark):
    rows = [("d", 1, 2, 3, "accepted_exact_agreement", [("g", 2), ("h", 1)]), ("d", 2, 1, 1, "abstain_evidence_tie", [("g", 1)])]
    df = spark.createDataFrame(rows, "doc string, line int, n_alt int, total long, outcome string, first array<struct<m:string,support:long>>")
    made = packets.body(df, ["doc", "line"])
    assert all("agreement" not in r.body and r.sha == hashlib.sha256(r.body.encode()).hexdigest() for r in made.collect())
    assert {r.action for r in made.collect()} == {"present_one", "abstain"}
    assert all(r.packets == 0 for r in packets.packet_faults(made).collect())
    swapped = made.withColumn("body", F.regexp_replace("body", '"families":2', '"families":0'))
    found = {r.fault: r.packets for r in packets.packet_faults(swapped).collect()}
    assert found["hash_not_of_body"] == 1 and found["order_broken"] == 1 and found["empty_support"] == 1 and found["unreadable"] == 0
    told = made.withColumn("body", F.regexp_replace("body", '"action"', '"gold":"g","action"')).withColumn("sha", F.sha2("body", 256)).withColumn("action", F.lit("abstain"))
    found = {r.fault: r.packets for r in packets.packet_faults(told).collect()}
    assert found["answer_in_packet"] == 2 and found["action_differs"] == 1 and found["hash_not_of_body"] == 0


def test_bayes_matches_models_fitted_fold_by_fold(spark):
    rng = random.Random(3)
    words = {"p": "abcde", "q": "cdefg", "r": "xyz"}
    docs = [(i, lab, [rng.choice(words[lab]) for _ in range(rng.randint(0, 8))]) for i, lab in enumerate(rng.choice("ppqqqr") for _ in range(60))]
    df = Scratch(spark, "t").cut(bayes.folded(spark.createDataFrame(docs, "k int, lab string, tokens array<string>"), "k", "lab", 4), "docs")
    rows = df.collect()
    got = {r.k: r.guess for r in bayes.predicted(df, "k", "lab").collect()}
    for r in rows:
        train = [x for x in rows if x.fold != r.fold]
        vocab = {t for x in train for t in x.tokens}
        scores = {}
        for lab in sorted({x.lab for x in train}):
            mine = [t for x in train if x.lab == lab for t in x.tokens]
            s = math.log(sum(x.lab == lab for x in train) / len(train))
            s += sum(math.log((mine.count(t) + 1) / (len(mine) + len(vocab))) for t in r.tokens if t in vocab)
            scores[lab] = round(s, 6)
        assert got[r.k] == min(scores, key=lambda x: (-scores[x], x))
    assert len(got) == 60


def test_scores_of_bags_and_of_pairs(spark):
    """Order of tokens and of candidates must not change a bag's score; another text must."""
    rng = random.Random(8)
    docs = [(i, [rng.choice("abcdefgh") for _ in range(12)]) for i in range(20)]
    scrambled = [(i, rng.sample(t, len(t))) for i, t in docs]
    corrupt = [(i, [x + "'" if i == 3 else x for x in t]) for i, t in docs]
    q = spark.createDataFrame([(100, docs[3][1])], "query_id int, tokens array<string>")

    def scores(rows):
        return {r.doc_id: round(r.score, 9) for r in retrieval.bm25(spark.createDataFrame(rows, "doc_id int, tokens array<string>"), q).collect()}

    base = scores(docs)
    assert scores(scrambled) == base and scores(docs[::-1]) == base and scores(docs) == base
    assert 3 in base and 3 not in scores(corrupt)


def test_cuts_lose_what_they_say(spark):
    lines = spark.createDataFrame([("d", i, [f"t{j}" for j in range(i)]) for i in range(1, 12)], "doc_id string, line int, tokens array<string>")
    for r in synth.horizontal_cuts(lines, 3).collect():
        n = r.line
        assert len(r.left) + len(r.right) <= n and r.eroded <= min(2, n - 1) and r.left == [f"t{j}" for j in range(len(r.left))]
        assert not r.right or r.right[-1] == f"t{n - 1}"
    assert synth.eligible(lines).first().n_signs == 66
    v = {(r.line, r.view): r.tokens for r in synth.views(lines, 3, 0.2, 2).collect()}
    assert len(v) == 22 and any(v[i, 1] != v[i, 2] for i in range(1, 12)) and synth.views(lines.where("line < 5"), 3, 0.2, 2).count() == 0
    worn = lines.select(synth.erode(F.col("tokens"), 0.0, 1, F.col("line")).alias("t"), "tokens").collect()
    assert all(r.t == r.tokens for r in worn)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "q", y\nz', 1), ("b", None, 2), ("c", "", 3)], "k string, v string, n int")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "csv"), "k string, v string, n int").where("k = 'a'").collect()} == {("a", 'x "q", y\nz', 1)}
    files.write_jsonl(rows, str(tmp_path / "jsonl"))
    assert {tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "jsonl"), "k string, v string, n int").collect()} == {("a", 'x "q", y\nz', 1), ("b", None, 2), ("c", "", 3)}
    made = []

    def build():
        made.append(1)
        return rows

    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "kept"), build).count() == 3
    assert made == [1]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("CTH 5_XML/K 1.xml", "CTH 6_XML/K 1.xml", "CTH 5_XML/K 2.xml", "__MACOSX/CTH 5_XML/._K 2.xml", "read.me"):
            z.writestr(name, "<a/>")
    stems, twice, kinds = files.directory_summary(files.archive_directory(spark, str(tmp_path)))
    assert {(r.stem, r.entries, tuple(r.groups)) for r in stems.collect()} == {("K 1", 2, ("5", "6")), ("K 2", 1, ("5",))}
    assert [tuple(r) for r in twice.collect()] == [("K 1", 2)] and {tuple(r) for r in kinds.collect()} == {("xml", 4), ("me", 1)}
    h = files.file_hashes(spark, str(tmp_path), "*.zip")
    assert h.first().sha256 == hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()
    m = files.manifest(spark.createDataFrame([("f", "OBSERVED_ARTIFACT"), ("g", "OBSERVED_ARTIFACT")], "field string, effective string"), h, "artifact_strict")
    assert m["classes"]["OBSERVED_ARTIFACT"] == {"count": 2, "share": 1.0} and len(m["sha256"]) == 64
    assert files.report(rows.select("k", "n").orderBy("k"), "T").splitlines()[2:5] == ["| k | n |", "| --- | --- |", "| a | 1 |"]
    page = spark.createDataFrame([('<span><a href="x"> CTH 5.1 </a></span> Treaty <b>x</b><a> CTH 6 </a></span>Fragments<',)], "h string")
    assert [tuple(x) for x in page.select(files.catalogue_titles(F.col("h")).alias("t")).first().t] == [("5.1", "Treaty"), ("6", "Fragments")]


def test_order_of_keys(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"id": "a", "x": 1}\n\n{"id": "b"}\n{"id": "b"}\n')
    (tmp_path / "bad.jsonl").write_text('{"id": "b"}\n{"id": "a", broken\n{"x": 1}\n')
    assert archives.key_order_faults(spark, str(tmp_path / "good.jsonl"), "id").count() == 0
    assert [(r.previous, r.found) for r in archives.key_order_faults(spark, str(tmp_path / "bad.jsonl"), "id").orderBy("line").collect()] == [("b", "a"), ("a", None)]


def test_scratch_tables_go_with_their_scope(spark):
    with scratch_scope():
        s = Scratch(spark, "scope")
        assert s.cut(spark.range(3).toDF("x"), "t").count() == 3
        assert files.exists(spark, f"{s.root}/t")
    assert not files.exists(spark, s.root)


@pytest.mark.parametrize("n, k", [(0, 3), (5, 2), (4100, 3)])
def test_dense_search_in_shards(spark, n, k):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(n, 4)).round(2)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(n)] + [(n, None), (n + 1, [0.0] * 4)], "vec_id long, embedding array<double>")
    got = {}
    for r in audit.dense_topk(df, k, shard=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True) if n else v
    for q in range(0, n, 100):
        s = np.round(u @ u[q], 9)
        want = sorted((i for i in range(n) if i != q), key=lambda i: (-s[i], i))[:k]
        assert [i for _, i in sorted(got[q])] == want
    assert len(got) == -(-n // 100)


def test_third_witnesses_are_found_in_blocks_without_a_table_of_runs(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    passages = [[rng.choice("abcdef") for _ in range(8)] for _ in range(4)]
    texts = {}
    for i in range(60):
        t = [x for p in rng.sample(passages, rng.randint(0, 2)) for x in [f"n{i}"] * rng.randint(0, 2) + p[rng.randint(0, 3):]]
        texts[f"f{i}"] = t or ["x"] * rng.randint(1, 6)
    pairs = [(f"f{a}", f"f{b}") for a, b in (sorted(rng.sample(range(60), 2), key=lambda i: f"f{i}") for _ in range(150))]
    pairs = sorted(set(pairs))

    def spans(w, a, b, n):
        def places(f):
            runs = {tuple(texts[f][i:i + n]) for i in range(len(texts[f]) - n + 1)}
            return [i for i in range(len(texts[w]) - n + 1) if tuple(texts[w][i:i + n]) in runs]
        return any(abs(p - q) >= n for p in places(a) for q in places(b))

    want = {(a, b, n): any(w not in (a, b) and spans(w, a, b, n) for w in texts) for a, b in pairs for n in (3, 5)}
    assert 20 < sum(want.values()) < len(want) - 20
    frags = spark.createDataFrame(list(texts.items()), "fragment_id string, tokens array<string>")
    out = thirds.covered(frags, spark.createDataFrame([*pairs, ("f1", "gone")], "a string, b string"), (3, 5))
    assert {(r.a, r.b, r.n): r.s == 1 for r in out.collect()} == want and out.count() == len(want)
    monkeypatch.setattr(thirds, "PORTION", 3)
    monkeypatch.setattr(thirds, "PLACES", 5)
    number = {f: i for i, f in enumerate(texts)}
    code = {t: i for i, t in enumerate(sorted({t for x in texts.values() for t in x}))}
    lists = pa.array([[code[t] for t in x] for x in texts.values()], pa.list_(pa.int64()))
    a, b = (np.array([number[p[i]] for p in pairs]) for i in (0, 1))
    for n in (3, 5):
        found = thirds._Block(np.arange(60), lists, n).covered(a, b, lists.take(pa.array(a)), lists.take(pa.array(b)))
        assert {(*p, n): bool(x) for p, x in zip(pairs, found)} == {k: v for k, v in want.items() if k[2] == n}
    assert thirds.covered(frags.limit(0), spark.createDataFrame(pairs, "a string, b string"), (3,)).count() == 0
    log = [(f, "f0", " ".join(t), " ".join(texts["f0"])) for f, t in texts.items()]
    spark.createDataFrame(log, "query_id string, predicted string, query_rendering string, predicted_rendering string").write.parquet(str(tmp_path / "failures.parquet"))
    spark.createDataFrame([(*p, "A") for p in pairs], "fragment_id_a string, fragment_id_b string, tier string").write.parquet(str(tmp_path / "join_pairs.parquet"))
    query = samples.third_witness_coverage(spark, str(tmp_path))
    assert "posexplode" not in query._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.n, r.tier, r.pairs, r.covered) for r in query.collect()} == {(n, "A", len(pairs), sum(v for k, v in want.items() if k[2] == n)) for n in (3, 5)}
