"""Tables that grow with the loci are dealt by key: none goes through the driver, however small its files look."""

import os

import pytest

from genolith.plans import queries_model as qm
from genolith.plans import queries_topography as qt

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_topography_sends_no_locus_table_through_the_driver(spark):
    freq, loci, seen = qt.freq(spark, DATA), qt.loci(spark, DATA), qt.observations(spark, DATA)
    m = qt.model(spark, DATA)
    for df in (m.cells(freq, loci), m.context_offsets(freq, loci), m.locus_offsets(freq, loci), m.observed(seen, freq, loci), *m.component_distributions(freq, loci)):
        assert broadcasts(df) == 0
    s, wide = qt.state_model(spark, DATA)
    assert broadcasts(s.context_offsets(freq, wide)) == broadcasts(s.observed(seen, freq, wide)) == 0


def test_locus_models_send_no_locus_table_through_the_driver(spark):
    assert broadcasts(qm._loci(spark, DATA)) == 0


def test_rounds_go_over_stored_observations(spark):
    for query in (qt.component_posteriors, qt.context_statistics, qt.locus_statistics, qt.estep_contributions):
        plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan  # each round joined observations and cells anew, and dealt them by sample


def test_deviance_sends_the_samples_to_the_cells(spark, monkeypatch):
    given, plain = [], qt.tp.Topography._explained
    monkeypatch.setattr(qt.tp.Topography, "_explained", lambda self, cells, nk, total, few=False: given.append(few) or plain(self, cells, nk, total, few))
    assert qt.deviance_score(spark, DATA).count() == 1
    assert given == [True]  # all cells were dealt by their few samples
