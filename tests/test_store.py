import pytest
from pyspark.errors import AnalysisException

from millrace.operators import models as M
from millrace.sources.store import Store


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.results().count() == 0 and s.value("sets", 1) is None and s.done(1) == set()
    assert (s.new_version("first"), s.new_version("second")) == (1, 2)
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert s.cached("clean", 1, make).count() == s.cached("clean", 1, make).count() == 3
    assert made == [1]
    with pytest.raises(AnalysisException):
        s.put_table("clean", 1, spark.range(1))
    s.put_value("sets", 1, ["a"])
    s.put_value("sets", 1, ["a", "b"])
    assert s.value("sets", 1) == ["a", "b"]
    row = {"model": "tree", "dataset": "d", "params": "{}", "mean_objective": 0.8, "std_objective": 0.1, "mean_time": 1.0, "std_time": 0.0}
    s.append_results(M.ledger(spark, [row]), 1)
    s.append_results(M.ledger(spark, [{**row, "model": "ridge"}]), 2)
    assert s.done(1) == {("tree", "d", "{}")} and s.results().count() == 2
    assert s.results().first()["worst_case"] == pytest.approx(0.7)
