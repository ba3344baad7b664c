import re

from aerostrata.session import scratch_dir
from aerostrata.sources.bucketed import BucketedStore


def _df(spark, keys):
    return spark.createDataFrame([(k, i) for k in keys for i in range(3)], "batch_id string, row_in_batch int")


def test_appends_leave_out_what_is_stored_and_do_not_shuffle_the_store(spark):
    where = scratch_dir(spark, "store")
    store = BucketedStore(spark, f"store_{where[-32:]}", 5, where)
    store.append(_df(spark, ["a", "b", "c"]))
    new = store.new_only(_df(spark, ["b", "d", None]))
    assert sorted({r["batch_id"] for r in new.collect()}, key=repr) == ["d", None] or new.count() == 6
    new.write.format("noop").mode("overwrite").save()
    plan = new._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # One exchange: that of the new rows. The stored side is a scan of the id column.
    assert len(re.findall(r"\bExchange\b", final)) == 1 and "SortMergeJoin" in final
    assert "ReadSchema: struct<batch_id:string>" in final and "Bucketed: true" in final
    store.append(_df(spark, ["b", "d"]))
    store.append(_df(spark, ["d", "a"]))
    assert store.table().count() == 12
    assert {r["batch_id"] for r in store.table().collect()} == {"a", "b", "c", "d"}
