from aerostrata import session


def test_runtime_settings_can_be_changed_in_any_session(spark):
    assert all(spark.conf.isModifiable(key) for key in session._RUNTIME)
    assert session.configure(spark).conf.get("spark.sql.session.timeZone") == "UTC"


def test_scratch_folders_lie_below_the_checkpoint_folder(spark):
    root = session.checkpoint_root(spark)
    assert session.scratch_dir(spark, "x").startswith(root)
    assert session.scratch_dir(spark, "x") != session.scratch_dir(spark, "x")


def test_compact_only_merges(spark):
    df = spark.range(0, 100, 1, 6)
    assert session.compact(df, 100).rdd.getNumPartitions() == 1
    assert session.compact(df, 10**9).rdd.getNumPartitions() == 6
