"""What a query uses more than once lies in files: its last plan does not read the tables again."""

import pytest

from factorloom.plans import kept, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["b6_run_metrics", "e12_narrative_inputs", "s13_annual_xbrl", "x14_all_factor_rows"])
def test_a_query_that_reads_its_rows_twice_works_them_out_once(spark, name):
    assert not [f for f in registry.queries()[name](spark, SF).inputFiles() if "lineitem" in f]


def test_scores_of_runs_are_worked_out_once_for_all_tables_of_theirs(spark):
    told = kept.all_runs(registry.Model(spark, SF))[1]
    assert [f for f in told["positions"].inputFiles() if "/tables-" in f and "/rows/" in f]


def test_a_resolution_and_its_changes_are_worked_out_once(spark):
    found = registry.queries()["r7_reresolved"](spark, SF)
    assert not [f for f in found.inputFiles() if "lineitem" in f]
    assert {r.change: r.n for r in found.collect()}.keys() == {"REMOVED", "CHANGED", "SCORES"}
