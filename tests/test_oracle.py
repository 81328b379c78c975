"""Every registered query against its SQL oracle in DuckDB at sf0.01 (as the
driver checks it): same columns, row count and rounded values."""

import pytest

from conftest import SF_ORACLE
from oracle_compare import compare


@pytest.mark.parametrize("force", [False, True])
def test_queries_match_oracle(spark, force):
    from varkit.operators.rank import CONF_ROWS_PER_BUCKET
    if force:
        spark.conf.set(CONF_ROWS_PER_BUCKET, "50")
    try:
        names = None
        if force:
            names = ["profile_numeric", "profile_categorical", "trends_numeric", "binned_line", "box_stats",
                     "smooth_tails", "gains_table", "match_buckets"]
        res = compare(spark, SF_ORACLE, names)
    finally:
        spark.conf.unset(CONF_ROWS_PER_BUCKET)
    bad = {k: v for k, v in res.items() if v[0] not in ("ok", "rows-only")}
    assert not bad, bad
