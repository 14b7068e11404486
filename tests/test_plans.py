"""Physical plans of the main path."""
import re

from conftest import SF
from pisoval.plans.batch import value_batch
from pisoval.plans.native import value_native
from pisoval.sources import driver_tables as d


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_valuation_adds_no_shuffle(spark, refs):
    listings = d.listings(spark, SF)
    text = plan(value_native(listings, refs))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert len(re.findall(r"\bSortMergeJoin", text)) == len(re.findall(r"\bSortMergeJoin", plan(listings)))


def test_batch_outcome_has_no_nested_loop(spark, refs):
    text = plan(value_batch(d.raw_listings(spark, SF), refs))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "Window" not in text


def test_only_the_features_read_the_texts(spark, refs):
    from pisoval.plans.features import TEXT, build_features
    assert TEXT not in build_features(d.listings(spark, SF), refs).columns


def test_reconciling_values_each_side_once(spark):
    """A filter on what a valuation derives would repeat it below."""
    from pisoval.catalog.queries import QUERIES
    text = QUERIES["reconcile_estimates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in text.splitlines() if re.search(r"\bFilter\b.*lambda", line)]


def test_contract_conditions_are_compiled():
    from pisoval.plans.contract import bad_fields
    assert "array_compact" not in str(bad_fields())
