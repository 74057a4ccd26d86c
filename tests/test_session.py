"""Written intermediate tables."""

from corvane import session


def test_materialized_tables_are_read_again_and_dropped(spark):
    session.drop_materialized(spark)
    df = session.materialize(spark.createDataFrame([(1, "a"), (None, None)], "i long, t string"), "probe")
    assert sorted((r.i, r.t) for r in df.where("i IS NOT NULL").collect()) == [(1, "a")] and df.count() == 2
    assert "probe-" in df.inputFiles()[0] and session.drop_materialized(spark) == 1
    assert session.drop_materialized(spark) == 0


def test_shared_folder_stays_the_same(spark):
    folder = session.shared_dir(spark)
    assert folder == session.shared_dir(spark) and not folder.endswith("/")


def test_configured_folder_is_used():
    class Conf:
        def get(self, key, default):
            return "hdfs://x/shared/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert session.shared_dir(Session()) == "hdfs://x/shared"
