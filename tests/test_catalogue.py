"""Every query of the catalogue runs; those with SQL give its rows."""

import pytest

from millrace.plans import modelling as catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, check_oracle, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLE_SQL:
        check_oracle(found, catalogue.ORACLE_SQL[name], sf_dir)
    else:
        assert found.count() > 0


def test_flagship(spark, sf_dir):
    assert catalogue.flagship(spark, sf_dir).count() == 1000
