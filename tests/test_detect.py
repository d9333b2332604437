from __future__ import annotations

import math

import time

import pytest
from pyspark.sql import functions as F

from oddlines.operators import decisions, features, metrics, reports
from oddlines import storage
from oddlines.plans import detect


@pytest.fixture(scope="module")
def lines(spark):
    rows = [("app.log", "app", i, f"user u{i % 9} read page {i} in {i % 50} ms") for i in range(400)]
    rows += [("app.log", "app", 400 + i, f"kernel panic unexpected fault {w} halted") for i, w in enumerate("xyz")]
    rows += [("db.log", "db", i, f"select rows from table t{i % 4} took {i} ms") for i in range(300)]
    return spark.createDataFrame(rows, "file_path string, source_folder string, seq long, value string")


@pytest.fixture(scope="module")
def detected(lines):
    result, model = detect.detect_log_anomalies(lines)
    return result.cache(), model


def test_odd_lines_are_flagged(detected):
    result, _ = detected
    assert result.count() == 703
    flagged = result.filter("is_anomaly")
    assert 0 < flagged.count() <= math.ceil(0.03 * 703)
    assert flagged.filter(F.col("value").contains("panic")).count() == 3
    assert result.filter("is_anomaly != (anomaly_label = -1) or is_anomaly != (anomaly_score < 0)").isEmpty()


def test_saved_model_repeats_its_scores(spark, detected, tmp_path):
    result, model = detected
    model.save(f"file://{tmp_path}/model")
    loaded = detect.Model.load(spark, f"file://{tmp_path}/model")
    rows = result.withColumn("model", F.lit("all")).drop("anomaly_label", "is_anomaly", "anomaly_score")
    again = detect.score_with_model(rows, loaded)
    key = ["file_path", "seq", "anomaly_label", "anomaly_score"]
    assert sorted(map(tuple, again.select(key).collect())) == sorted(map(tuple, result.select(key).collect()))


def test_each_source_has_its_own_model(lines, detected):
    result, model = detect.detect_per_source(lines)
    assert {r[0] for r in model.nodes.select("model").distinct().collect()} == {"app", "db"}
    assert result.count() == 703
    terms = {r["term"] for r in model.vocabulary.filter("model = 'db'").collect()}
    assert "select" in terms and "panic" not in terms
    alone, _ = detect.detect_per_source(lines.filter("source_folder = 'db'"))
    key = ["seq", "anomaly_label", "anomaly_score"]
    ours = result.filter("source_folder = 'db'").select(key)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, alone.select(key).collect()))


def test_mismatched_rows_are_refused(lines):
    vectors = lines.select("file_path", "seq")
    detect.check_same_rows(lines.filter("file_path = 'db.log'"), vectors.filter("file_path = 'db.log'"), "seq")
    with pytest.raises(ValueError):
        detect.check_same_rows(lines.filter("file_path = 'db.log'"), vectors.filter("seq < 10"), "seq")


def test_empty_input_gives_empty_result(lines):
    result, _ = detect.detect_log_anomalies(lines.filter("false"))
    assert result.isEmpty() and {"template", "is_anomaly", "anomaly_score"} <= set(result.columns)


def test_idf_values(spark):
    vocab = spark.createDataFrame([("a", 3), ("b", 1)], "term string, df long")
    got = {r["term"]: r["idf"] for r in features.with_idf(vocab, F.lit(3)).collect()}
    assert got["a"] == 1.0 and got["b"] == pytest.approx(1.693147, abs=1e-6)


def labelled(spark, tp, fp, fn, tn):
    rows = [(True, True)] * tp + [(False, True)] * fp + [(True, False)] * fn + [(False, False)] * tn
    return spark.createDataFrame(rows, "y_true boolean, y_pred boolean")


def test_metrics(spark):
    m = metrics.classification_metrics(labelled(spark, 3, 1, 2, 4)).first()
    assert (m["precision"], m["recall"], round(m["f1"], 6)) == (0.75, 0.6, 0.666667)
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion_matrix(labelled(spark, 3, 1, 2, 4)).collect()}
    assert cells == {(False, False): 4, (False, True): 1, (True, False): 2, (True, True): 3}
    m = metrics.classification_metrics(labelled(spark, 0, 0, 2, 8)).first()
    assert (m["precision"], m["recall"], m["f1"]) == (0, 0, 0)
    assert metrics.confusion_matrix(labelled(spark, 0, 0, 0, 3)).count() == 4


@pytest.mark.parametrize("anomalies,k", [(1, 1), (20, 17)])
def test_top_share(spark, anomalies, k):
    rows = [(i, -1.0, True) for i in range(anomalies)] + [(100 + i, 1.0, False) for i in range(5)]
    df = spark.createDataFrame(rows, "seq long, anomaly_score double, is_anomaly boolean")
    top = metrics.top_share(df).collect()
    assert sorted(r["seq"] for r in top) == list(range(k))  # ties go to the first rows
    verdicts = spark.createDataFrame([(0, False)], "seq long, is_real_fault boolean")
    got = metrics.precision_at_share(df, verdicts).first()
    assert (got["k"], got["validated"]) == (k, k - 1)
    assert metrics.precision_at_share(df.filter("not is_anomaly"), verdicts).isEmpty()


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(i, 2.5, False) for i in range(4)], "seq long, anomaly_score double, is_anomaly boolean")
    assert [tuple(r) for r in reports.score_histogram(df, 10).collect()] == [(0, False, 4, 2.5)]


def test_project_existing(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert decisions.project_existing(df, ["y", "gone"]).columns == ["y"]


def test_work_tables_go_and_texts_are_stored_once(spark, lines, monkeypatch):
    """After fitting only what the result reads is left, and no stored column repeats another."""
    stored = []
    real = detect.materialize
    monkeypatch.setattr(detect, "materialize", lambda d, label: stored.append((label, real(d, label))) or stored[-1][1])
    result, _ = detect.detect_log_anomalies(lines)
    names = {label: set(table.columns) for label, table in stored}
    assert not {"event", "source", "level", "combined"} & names["prepared"]
    assert result.filter("event != template or combined != concat('INFO ', source_folder, ' ', event_clean)").isEmpty()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(storage.work_root(spark))
    left = {s.getPath().toString() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)}
    paths = {label: table.inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[1] for label, table in stored if label in ("prepared", "scores")}
    assert all(any(path.endswith(name) for path in left) for name in paths.values())
    for label, table in stored:
        if label in ("texts", "vectors"):
            with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
                table.count()


def test_pairs_are_counted_for_frequent_words_only(spark, monkeypatch):
    """The vocabulary is that of all words and pairs, with ties, weights and models."""
    texts = [("a", i, f"aa bb cc{i % 3} dd{i} aa bb", 1 + i % 4) for i in range(40)] + [("b", 100, "aa aa bb", 2), ("b", 101, "", 1)]
    df = spark.createDataFrame(texts, "model string, id long, text string, freq long")
    grams = features.ngram_rows(df, ["model", "id", "freq"], "text")
    for most in (1, 4, 7, 1000):
        for extra in ({}, {"freq": "freq", "model": ["model"]}):
            whole = features.vocabulary(grams, ["id"], most, **extra)
            ours = features.ngram_vocabulary(df, ["id"], "text", most, **extra)
            assert sorted(map(tuple, ours.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    stored = {}
    real = features.materialize
    monkeypatch.setattr(features, "materialize", lambda d, label: stored.setdefault(label, real(d, label)))
    features.ngram_vocabulary(df, ["id"], "text", 2)
    assert {r["term"] for r in stored["frequent"].collect()} == {"aa", "bb"}


def test_only_what_differs_from_the_line_is_stored(spark, lines, monkeypatch):
    """Templates that are the line, and texts that no mask alters, are read from other columns; lines go once mined."""
    stored, given = {}, []
    real = detect.materialize
    with monkeypatch.context() as m:
        m.setattr(detect, "materialize", lambda d, label: stored.setdefault(label, real(d, label)))
        whole, _ = detect.detect_log_anomalies(lines)
    prepared = stored["prepared"]
    assert prepared.filter("template = value").isEmpty() and prepared.filter("event_clean = lower(template)").isEmpty()
    ours, _ = detect.detect_log_anomalies(lambda: given.append(storage.materialize(lines, "files")) or given[0])
    assert ours.columns == whole.columns and sorted(map(str, ours.collect())) == sorted(map(str, whole.collect()))
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        given[0].count()


def test_terms_of_several_models_are_sent_to_the_texts(spark):
    """Not the far larger rows of words are moved, whatever size the engine would send."""
    texts = spark.createDataFrame([("a", "x", "aa bb", 1), ("b", "y", "aa cc", 1)], "model string, text_key string, combined string, freq long")
    vocab = features.ngram_vocabulary(texts, ["text_key"], "combined", 5, freq="freq", model=["model"], moved=False)
    vocab = storage.materialize(features.with_idf(vocab, F.lit(2)), "vocabulary")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grams = features.ngram_rows(texts, ["model", "text_key"], "combined")
        weights = features.tfidf(grams, vocab, ["text_key"], model=["model"])
        plan = weights._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert weights.count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffle_files_go_with_the_stored_table(spark):
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = files()
    storage.materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "few")
    end = time.time() + 20
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before
