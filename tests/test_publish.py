"""Sets of tables: a failing gate or contract leaves the old set, a repeated run changes nothing, keys keep their latest rows."""

import pytest
from pyspark.sql import functions as F

from claimsieve.plans.storage import new_path
from claimsieve.sources import publish as P
from claimsieve.sources import tables as T


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_publish(spark):
    root = new_path(spark, "publish-test")
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, v string, load_ts int")
    b = spark.createDataFrame([("n", 0.5)], "name string, score double")
    rule = {"b": {"score": F.expr("score between 0 and 1")}}
    more = {"checks": rule, "keys": {"a": ["id"]}, "merge": {"a": "load_ts"}}
    assert P.published(spark, root) == {} and P.manifest(spark, root) is None
    made = P.publish(spark, root, "v1", {"a": a, "b": b}, **more)
    assert {k: t["rows"] for k, t in made["tables"].items()} == {"a": 2, "b": 1} and P.manifest(spark, root) == made
    first = P.published(spark, root)
    bad = [
        ({"a": a, "b": b.limit(0)}, T.ContractError),
        ({"a": a, "b": spark.createDataFrame([("m", 1.5), ("k", None)], b.schema)}, T.ContractError),
        ({"a": a.select("id", "v", F.expr("assert_true(id < 2)").cast("int").alias("load_ts")), "b": b}, Exception),
    ]
    for tables, error in bad:
        with pytest.raises(error):
            P.publish(spark, root, "v2", tables, **more)
        assert P.manifest(spark, root) == made and rows(P.published(spark, root)["a"]) == rows(a)
    with pytest.raises(T.ContractError, match="duplicate_key 2"):
        P.publish(spark, root, "v2", {"a": a.union(a), "b": b}, keys={"a": ["id"]})
    with pytest.raises(ValueError):
        P.publish(spark, root, "../v", {"a": a})
    late = spark.createDataFrame([(2, "z", 2, 9), (3, "w", 2, 9), (1, "old", 0, 9)], "id int, v string, load_ts int, other int")
    P.publish(spark, root, "v2", {"a": late, "b": b}, **more)
    want = [(1, "x", 1), (2, "z", 2), (3, "w", 2)]
    assert rows(P.published(spark, root)["a"]) == want and rows(first["a"]) == rows(a)
    again = P.publish(spark, root, "v2", {"a": a.limit(0), "b": None}, **more)
    assert again["version"] == "v2" and rows(P.published(spark, root)["a"]) == want
    with pytest.raises(T.ContractError, match="another run"):
        P._switch(spark, root, 2, made)
    P.publish(spark, root, "v3", {"a": a, "b": None}, mode="fixture")
    assert set(P.published(spark, root)) == {"a"}
    assert P.prune(spark, root, 1) == ["v1", "v2"] and rows(P.published(spark, root)["a"]) == rows(a)
