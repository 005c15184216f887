"""Readers by name, versioned publishing, temporary tables."""

import os

import pytest
from pyspark.sql import functions as F

from txlens.constants import REQUIRED_COLUMNS
from txlens.operators.normalize import MissingColumnsError
from txlens.session import checkpoint_dir, delete_materialized, materialize, temporary_tables
from txlens.sources import feed, sinks


def rows(spark, n=3, columns=REQUIRED_COLUMNS):
    df = spark.range(n).select(*[F.concat(F.lit(f"{c}-"), "id").alias(c) for c in REQUIRED_COLUMNS])
    return df.select(*columns)


def test_columns_are_matched_by_name(spark, tmp_dir):
    sinks.append_transactions(rows(spark, columns=REQUIRED_COLUMNS[::-1]).withColumn("extra", F.lit("x")), f"{tmp_dir}/a")
    got = feed.read_transactions(spark, f"{tmp_dir}/a")
    assert {tuple(r) for r in got.select("transaction_id", "user_id").collect()} == {
        (f"transaction_id-{i}", f"user_id-{i}") for i in range(3)}


def test_a_file_in_another_order_stops_the_job(spark, tmp_dir):
    sinks.append_transactions(rows(spark).coalesce(1), f"{tmp_dir}/a")
    sinks.append_transactions(rows(spark, columns=REQUIRED_COLUMNS[::-1]).coalesce(1), f"{tmp_dir}/a")
    with pytest.raises(Exception, match="CSV header"):
        feed.read_transactions(spark, f"{tmp_dir}/a").collect()


def test_missing_columns_are_named(spark, tmp_dir):
    sinks.append_transactions(rows(spark, columns=[c for c in REQUIRED_COLUMNS if c != "status"]), f"{tmp_dir}/a")
    with pytest.raises(MissingColumnsError, match="status"):
        feed.read_transactions(spark, f"{tmp_dir}/a")
    with pytest.raises(MissingColumnsError, match="status"):
        feed.stream_transactions(spark, f"{tmp_dir}/a")
    assert feed.read_transactions(spark, f"{tmp_dir}/none") is None


def test_line_breaks_need_multi_line(spark, tmp_dir):
    df = rows(spark, 1).withColumn("status", F.lit('a, "b"\nc'))
    sinks.append_transactions(df, f"{tmp_dir}/a")
    assert [r.status for r in feed.read_transactions(spark, f"{tmp_dir}/a", multi_line=True).collect()] == ['a, "b"\nc']


def test_publish_moves_the_pointer_and_keeps_one_version(spark, tmp_dir):
    path = f"{tmp_dir}/table"
    for n in (1, 2, 3):
        before = feed.read_published(spark, path) if n > 1 else None
        assert sinks.publish(spark.range(n), path)
        assert feed.read_published(spark, path).count() == n
        if before is not None:
            assert before.count() == n - 1          # a reader of the version before is undisturbed
    assert sum(d.startswith("version=") for d in os.listdir(path)) == 2


def test_a_failed_write_leaves_the_old_version(spark, tmp_dir):
    path = f"{tmp_dir}/table"
    sinks.publish(spark.range(5), path)
    with pytest.raises(Exception):
        sinks.publish(spark.range(3).withColumn("x", F.raise_error(F.lit("stop"))), path)
    assert feed.read_published(spark, path).count() == 5


def test_empty_features_publish_nothing(spark, tmp_dir):
    df = spark.createDataFrame([], "transaction_id string, event_ts timestamp")
    assert sinks.write_features(df, f"{tmp_dir}/f") is False
    assert feed.current_version(spark, f"{tmp_dir}/f") is None
    one = spark.sql("SELECT 't' AS transaction_id, timestamp'2024-01-01 00:00:00' AS event_ts")
    assert sinks.write_features(one, f"{tmp_dir}/f") is True
    assert str(feed.read_features(spark, f"{tmp_dir}/f").first().event_date) == "2024-01-01"


def test_temporary_tables_go(spark):
    folder = f"{checkpoint_dir(spark)}/txlens-materialized/{spark.sparkContext.applicationId}".removeprefix("file:")
    with temporary_tables(spark) as keep:
        assert keep(spark.range(4)).count() == 4
        inside = set(os.listdir(folder))
    assert len(inside) == len(os.listdir(folder)) + 1
    materialize(spark.range(2))
    delete_materialized(spark)
    assert not os.path.exists(folder)


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from txlens import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_model_and_scaler_round_trip(spark, tmp_dir):
    from txlens.operators import ml
    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                 (F.col("id") % 17 > 12).cast("int").alias("Class"))
    for kind in ("network", "logistic"):
        model, scaler = ml.train_classifier(df, ["a", "b"], kind=kind, max_iter=30)
        ml.save_model(model, scaler, f"{tmp_dir}/{kind}")
        again = ml.load_model(spark, f"{tmp_dir}/{kind}", kind)
        want = [round(r.score, 9) for r in ml.predict(model, df, scaler, ["a", "b"]).orderBy("a", "b").collect()]
        assert want == [round(r.score, 9) for r in ml.predict(again[0], df, again[1], ["a", "b"]).orderBy("a", "b").collect()]


def test_metrics_ignore_rows_without_a_score(spark):
    from txlens.operators import ml
    rows = [(0.9, 1), (0.2, 0), (0.6, 0), (None, 1), (0.4, None)]
    m = ml.evaluate(spark.createDataFrame(rows, "score double, Class int")).first()
    assert m.val_auc == 1.0 and m.val_accuracy == pytest.approx(2 / 3)
    none = ml.evaluate(spark.createDataFrame([(0.5, 1)], "score double, Class int")).first()
    assert none.val_auc is None


def test_kmeans_keeps_rows_with_missing_features(spark):
    from txlens.operators import risk
    rows = [(i, float(i % 3) * 10, None if i % 10 == 0 else 1.0) for i in range(60)] + [(99, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out, _, _ = risk.kmeans(df, ["a", "b"], 3, 2)
    got = {r.id: r.cluster for r in out.collect()}
    assert len(got) == 61 and all((got[i] is None) == (i % 10 == 0) for i in range(60)) and got[99] is None
    with pytest.raises(ValueError, match="distinct points"):
        risk.kmeans(df.filter("id < 3"), ["a", "b"], 3, 1)


def test_split_keeps_rows_without_a_label(spark):
    from txlens.operators.sampling import stratified_split
    rows = [(f"k{i}", None if i % 4 == 0 else i % 2) for i in range(100)]
    got = stratified_split(spark.createDataFrame(rows, "k string, Class int"), "Class", "k").collect()
    assert len(got) == 100
    for label, n in ((None, 25), (0, 25), (1, 50)):
        assert sum(r.is_validation for r in got if r.Class == label) == round(0.2 * n)


def test_device_risk_counts_one_first_sighting(spark):
    from txlens.functions.rules import device_risk
    rows = [("a", "u", "d", 1), ("a", "u", "d", 1), ("b", "u", "d", 2), ("c", "u", None, 1), ("d", "u", None, 2), ("e", None, "d", 1)]
    got = sorted((r.transaction_id, r.device_signal) for r in device_risk(
        spark.createDataFrame(rows, "transaction_id string, user_id string, device_id string, event_ts int")).collect())
    assert got == [("a", 0.12), ("a", 0.78), ("b", 0.12), ("c", 0.78), ("d", 0.12), ("e", 0.78)]


def test_job_entry_points(spark, tmp_dir):
    from decimal import Decimal

    from txlens import jobs
    feed_rows = [(f"t{i}", "u", "10", f"2024-01-01T0{i}:00:00Z", str(i), "0.1", "0.2", "1", "0.9", "approved") for i in range(5)]
    sinks.append_transactions(spark.createDataFrame(feed_rows, ", ".join(f"{c} string" for c in REQUIRED_COLUMNS)), f"{tmp_dir}/feed")
    assert jobs.main(["features", "--input", f"{tmp_dir}/feed", "--output", f"{tmp_dir}/features"], spark) == 0
    assert feed.read_features(spark, f"{tmp_dir}/features").count() == 5
    spark.createDataFrame([("u", Decimal("25.00"))], "user_id string, account_balance decimal(14,2)").write.parquet(f"{tmp_dir}/profiles")
    jobs.main(["decisions", "--input", f"{tmp_dir}/feed", "--output", f"{tmp_dir}/decisions", "--state", f"{tmp_dir}/state",
               "--profiles", f"{tmp_dir}/profiles", "--blacklist", f"{tmp_dir}/none", "--feed", f"{tmp_dir}/accepted"], spark)
    got = {r.transaction_id: r.code for r in spark.read.parquet(f"{tmp_dir}/decisions").collect()}
    assert got == {"t0": 200, "t1": 200, "t2": 400, "t3": 400, "t4": 400}
    assert feed.read_transactions(spark, f"{tmp_dir}/accepted").count() == 2
    with pytest.raises(SystemExit):
        jobs.main(["features", "--input", "a", "--output", "b", "--watch", "8"], spark)


def test_stream_reads_line_breaks_like_the_batch(spark, tmp_dir):
    df = rows(spark, 3).withColumn("status", F.concat(F.lit('a, "b"\nc'), "transaction_id"))
    sinks.append_transactions(df, f"{tmp_dir}/a")
    stream = feed.stream_transactions(spark, f"{tmp_dir}/a", multi_line=True)
    q = (stream.writeStream.format("parquet").option("path", f"{tmp_dir}/out")
         .option("checkpointLocation", f"{tmp_dir}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    batch = feed.read_transactions(spark, f"{tmp_dir}/a", multi_line=True)
    assert (sorted(map(tuple, spark.read.parquet(f"{tmp_dir}/out").select(*REQUIRED_COLUMNS).collect()))
            == sorted(map(tuple, batch.select(*REQUIRED_COLUMNS).collect())) == sorted(map(tuple, df.collect())))


@pytest.mark.parametrize("job, start", [("features", "start_feature_stream"), ("decisions", "start_decision_stream")])
def test_jobs_pass_multi_line_to_streams(spark, monkeypatch, job, start):
    from txlens import jobs
    seen = {}

    class Query:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(jobs, start, lambda *args, **options: seen.update(options) or Query())
    monkeypatch.setattr(jobs, "delete_materialized", lambda spark: None)
    jobs.main([job, "--input", "in", "--output", "out", "--state", "state", "--watch", "8", "--multi-line",
               "--profiles", "p", "--blacklist", "b"], spark)
    assert seen["multi_line"] is True
