"""The intervals of the join retrieval suite."""

import pytest

from ostraka.operators import ranks
from ostraka.plans import suite


def test_intervals_search_once_and_tell_what_the_suite_tells(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want = {r.tier: r for r in suite.task_b_suite(spark, folder).where("variant = 'full_distractor'").collect()}["pooled"]
    searches = []
    init = ranks.Search.__init__
    monkeypatch.setattr(ranks.Search, "__init__", lambda self, *x, **y: (searches.append(1), init(self, *x, **y))[1])
    got = {r.k: r for r in suite.task_b_intervals(spark, folder).collect()}
    assert len(searches) == 1
    assert got[1].mean == pytest.approx(want.recall_1) and got[10].mean == pytest.approx(want.recall_10)
    assert all(r.lower <= r.mean <= r.upper for r in got.values())
