"""What spans are told in buckets of anchor pairs, against tables of windows."""

import random

import pytest

from ostraka.operators import witness


@pytest.fixture
def lines(spark):
    rng = random.Random(5)
    rows = [(d, rng.choice("st"), rng.choice(["u", "v", None]), d // 2, i, [rng.choice("abc") for _ in range(rng.randint(1, 9))]) for d in range(16) for i in range(3)]
    return spark.createDataFrame(rows, "doc_id long, scope string, unit string, family long, line int, tokens array<string>")


def _no_windows(monkeypatch):
    def never(*_, **__):
        raise AssertionError("a table of windows")

    monkeypatch.setattr(witness, "windows", never)
    monkeypatch.setattr(witness, "counted", never)


def test_census_grid_makes_no_table_of_windows(lines, monkeypatch):
    want = {}
    for r in lines.collect():
        for a in (1, 2):
            for m in (1, 2):
                for i in range(a, len(r.tokens) - m - a + 1):
                    l, g, z = r.tokens[i - a:i], r.tokens[i:i + m], r.tokens[i + m:i + m + a]
                    votes = {tuple(t[j:k]) for t, f in ((x.tokens, x.family) for x in lines_of(lines, r.scope, r.family)) for j in range(a, len(t)) if t[j - a:j] == l for k in range(j, min(len(t), j + 12) + 1) if t[k:k + a] == z}
                    c = want.setdefault((a, m), [0, 0, 0])
                    c[0], c[1], c[2] = c[0] + bool(votes), c[1] + (tuple(g) in votes), c[2] + (len(votes) > 1)
    _no_windows(monkeypatch)
    got = {(r.anchors, r["mask"]): [r.supported, r.exact, r.ambiguous] for r in witness.census_grid(lines, [1, 2], [1, 2], "scope", "unit").collect()}
    assert got == want and all(x[1] for x in want.values())


_held: dict = {}


def lines_of(lines, scope, family):
    if not _held:
        for r in lines.collect():
            _held.setdefault(r.scope, []).append(r)
    return [r for r in _held[scope] if r.family != family]


QUERIES = ["adaptive_horizon", "disagreement_flags", "rank_calibration", "candidate_set_depths", "disagreement_taxonomy", "evidence_packets"]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_make_no_table_of_windows(spark, monkeypatch, tmp_path, name):
    import duckdb

    import __spark_entry__

    rng = random.Random(9)
    words = ["a", "b", "b\x01", "bé", "c"]
    rows = [(d, None if d == 39 else "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 11))) for _ in range(3)), rng.choice(["x", "y", None]), rng.choice(["u", "v", None])) for d in range(40)]
    rows += [(100 + d, rows[d][1], rows[d][2], "w") for d in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    _no_windows(monkeypatch)
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got
