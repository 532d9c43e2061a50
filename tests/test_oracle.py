"""Every registered query of the library with a SQL twin gives the same rows in Spark and DuckDB."""

import pytest

from quantloom import registry

from .oracle import differences

registry.queries()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, name):
    assert differences(spark, registry.queries()[name], registry.oracle_sql()[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows_of_numbers_without_twin(spark, sf, name):
    """Fits and hash-made draws: every query gives rows, and no figure is missing or out of range."""
    rows = registry.queries()[name](spark, sf).collect()
    assert rows
    for r in rows:
        for column, v in r.asDict().items():
            assert v is not None or column in ("ic", "share_strong"), (name, r)
            assert column not in ("accuracy", "hit_rate", "auroc", "frequency", "rank_ic", "mean_p") or 0 <= v <= 1, (name, r)
