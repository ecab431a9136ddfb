import time

import pytest
from pyspark.sql import functions as F

from textquarry.operators import search


def hits(spark, rows):
    return spark.createDataFrame([("q", i, s) for i, s in rows], "query_id string, id string, score double")


def test_backends_that_raise_or_sleep_are_left_out(spark):
    good, other = hits(spark, [("a", 3.0), ("b", 2.0)]), hits(spark, [("b", 9.0), ("c", 1.0)])

    @F.udf("double")
    def slow(x):
        time.sleep(600)
        return x

    def broken():
        raise RuntimeError("down")

    @F.udf("double")
    def failing(x):
        raise ValueError("bad row")

    backends = {"good": lambda: good, "other": lambda: other, "broken": broken, "slow": lambda: good.withColumn("score", slow("score")), "failing": lambda: good.withColumn("score", failing("score"))}
    began = time.time()
    got, errors = search.federate_answering(backends, 3, seconds=12)
    assert time.time() - began < 40
    assert sorted(errors) == ["broken", "failing", "slow"] and "down" in errors["broken"] and "no answer" in errors["slow"]
    want = search.federate({"good": good, "other": other}, 3)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [tuple(r) for r in want.orderBy("rank").collect()]
    weighted, errors = search.federate_answering({"good": lambda: good, "other": lambda: other}, 3, "weighted")
    assert not errors and sorted(weighted.collect()) == sorted(search.federate({"good": good, "other": other}, 3, "weighted").collect())


def test_no_answer_at_all_is_an_error(spark):
    def broken():
        raise RuntimeError("down")

    with pytest.raises(search.AllBackendsFailed) as e:
        search.federate_answering({"a": broken, "b": broken}, 3)
    assert sorted(e.value.errors) == ["a", "b"]
    with pytest.raises(ValueError):
        search.federate_answering({}, 3)
