"""A selection of the registered queries against DuckDB on the smallest tables, and the contract of the entry point."""

import os

import pytest

from cohortflow.plans import catalog
from oracle import compare

SF = "/root/testdata/sf0.001"
SOME = ("trajectory_summary", "trajectory_event_table", "score_summary", "grouping_report", "matched_comparisons", "presentation_signed_ranks", "holm_family", "agreement_table", "majority_vote", "latest_revisions", "execution_summary", "message_histories", "blinding_digests", "join_report", "catalogue_eligibility", "similarity_and_drift", "success_turns_scan", "fault_isolating_scan", "csv_tables", "full_record_export", "append_only_store", "data_dictionary", "blinded_files", "rerating_sample", "relational_division")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
