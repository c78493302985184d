import importlib

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldlake.ml import anomaly, evaluation, models
from yieldlake.ml.inference import FrozenScorer, require_parity
from yieldlake.ml.models import Candidate, fit
from yieldlake.ml.preprocess import FeaturePrep
from yieldlake.operators import splits
from yieldlake.profile import ContractError, Evaluation, Profile
from yieldlake.sources import readers, sinks

PROFILE = Profile("t", "label", -1, 1, timestamp="ts", excluded=("row_id",), feature_prefix="sensor_")
FAST = Candidate("lr", "logistic_regression", max_iter=8)


@pytest.fixture(scope="module")
def frame(spark):
    i = F.col("id")
    return spark.range(240).select(
        i.alias("row_id"), F.expr("timestamp_ntz'2021-01-01' + make_dt_interval(cast(id div 2 as int))").alias("ts"),
        F.when(i % 6 == 0, 1).otherwise(-1).alias("label"),
        (F.when(i % 6 == 0, 3.0).otherwise(0.0) + (i * 17 % 29) / 29.0).alias("sensor_a"),
        F.when(i % 4 != 0, (i * 13 % 31) / 31.0).alias("sensor_b"), F.lit(1.0).alias("sensor_c")).cache()


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_feature_and_metadata_pair(spark, tmp_path):
    features = write(tmp_path / "f.data", ["1.5 NaN  3", "4 5 6"])
    labels = write(tmp_path / "l.data", ['-1 "19/07/2008 11:55:00"', '1 "19/07/2008 12:32:00"'])
    plan = readers.Ingestion("feature_metadata_pair", {
        "features": readers.TextSource(features, r"\s+"), "metadata": readers.TextSource(labels, r"\s+")},
        {"metadata_columns": ["label", "timestamp"]})
    rows = readers.build_canonical(spark, plan).orderBy("row_pos").collect()
    assert rows[0].label == "-1" and rows[0].timestamp == "19/07/2008 11:55:00"
    assert (rows[0].sensor_0, rows[0].sensor_1, rows[1].sensor_2) == (1.5, None, 6.0)
    out = str(tmp_path / "canonical")
    sinks.materialize(spark, plan, out)
    with pytest.raises(Exception):
        sinks.materialize(spark, plan, out)
    short = write(tmp_path / "s.data", ['-1 "19/07/2008 11:55:00"'])
    bad = readers.Ingestion(plan.adapter, {**plan.sources, "metadata": readers.TextSource(short, r"\s+")}, plan.options)
    with pytest.raises(ContractError):
        readers.build_canonical(spark, bad)


def test_delimited_and_strict_scans(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["a,b", "1,NaN", "2,3"])
    assert readers.read_sensor_csv(spark, path).where("b is null").count() == 1
    for name, lines in (("b.csv", ["a,a", "1,2"]), ("c.csv", ["a,b", "1"]), ("d.csv", ["a,", "1,2"])):
        with pytest.raises(ContractError):
            readers.read_sensor_csv(spark, write(tmp_path / name, lines))
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.StringType())])
    spaced = readers.scan_delimited(spark, readers.TextSource(write(tmp_path / "e.txt", ["1.0   u", "2.5 v"]), r"\s+"), schema)
    assert [tuple(r) for r in spaced.orderBy("x").collect()] == [(1.0, "u"), (2.5, "v")]


def test_manifest_scan_is_pruned(spark, tmp_path):
    line = '{"source_row_position": 0, "lot_id": "L", "pattern_label": null, "label_status": "unlabeled", "other": [1, 2]}'
    back = readers.read_manifest(spark, write(tmp_path / "m.jsonl", [line]))
    assert "other" not in back.columns and back.first().lot_id == "L"


def test_split_sink_writes_after_checks(spark, frame, tmp_path):
    tagged = splits.tag_splits(frame, PROFILE, "row_id")
    checks = sinks.write_splits(tagged, PROFILE, str(tmp_path / "splits"))
    assert checks.where("status = 'FAIL'").isEmpty()
    assert spark.read.parquet(str(tmp_path / "splits" / "splits")).count() == 480
    leaky = tagged.where("strategy = 'time'").withColumn("ts", F.lit("2021-01-01").cast("timestamp_ntz"))
    with pytest.raises(ContractError):
        sinks.write_splits(leaky, PROFILE, str(tmp_path / "leaky"))
    with pytest.raises(FileExistsError):
        sinks.write_splits(tagged, PROFILE, str(tmp_path / "splits"))
    assert [p.name for p in tmp_path.iterdir()] == ["splits"]  # what failed left nothing


def test_preprocessing_learns_from_fit_rows_only(spark, frame):
    model = FeaturePrep(features=["sensor_a", "sensor_b", "sensor_c"], scale=True).fit(frame.where("row_id < 120"))
    assert model.get("features") == ["sensor_a", "sensor_b"] and model.get("removedConstant") == ["sensor_c"]
    values = frame.where("row_id < 120").select(model.values().alias("v"))
    stats = values.select(F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b")).agg(
        F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b")).first()
    assert [round(x, 9) + 0.0 for x in stats] == [0.0, 1.0, 0.0, 1.0]


def test_future_labels_do_not_change_past_scores(spark, frame):
    settings = Evaluation(n_splits=2, n_repeats=1)

    def past(df):
        done = evaluation.compare_temporal(df, PROFILE, [FAST], ["sensor_a", "sensor_b"], ["row_id"], settings, 2, 2)
        mine = done["oof_predictions"].where("outer_fold = 1").orderBy("row_id").collect()
        return [(r.row_id, round(r.positive_score, 9)) for r in mine], done

    first, done = past(frame)
    changed, _ = past(frame.withColumn("label", F.when(F.col("row_id") >= 160, -F.col("label")).otherwise(F.col("label"))))
    assert first == changed and len(first) > 0
    assert {r["mode"] for r in done["fold_results"].collect()} == {"default", "temporal_oof"}
    assert done["folds"].count() == 2 and done["oof_coverage"].where("excluded_initial_samples <= 0").isEmpty()


def test_failing_rows_do_not_reach_normal_only_fits(spark, frame):
    a = anomaly.fit_pca_detector(frame, PROFILE, ["sensor_a", "sensor_b"])
    spoiled = frame.withColumn("sensor_a", F.when(F.col("label") == 1, 1e6).otherwise(F.col("sensor_a")))
    b = anomaly.fit_pca_detector(spoiled, PROFILE, ["sensor_a", "sensor_b"])
    assert a.prep.get("means") == pytest.approx(b.prep.get("means"))
    forest = anomaly.fit_forest_detector(frame, PROFILE, ["sensor_a", "sensor_b"], ["row_id"], trees=15)
    mean = {r.label: r.m for r in forest.score(frame).groupBy("label").agg(F.avg(anomaly.SCORE).alias("m")).collect()}
    assert mean[1] > mean[-1]


def test_frozen_scorer_round_trip_and_guards(spark, frame, tmp_path):
    model = fit(frame, PROFILE, FAST, ["sensor_a", "sensor_b", "sensor_c"])
    scorer = FrozenScorer.from_fit(model, PROFILE, 0.5, 20)
    rows = frame.select("row_id", *scorer.sensors)
    first = scorer.score(rows, ["row_id"])
    scorer.save(str(tmp_path / "scorer"))
    require_parity(first, FrozenScorer.load(str(tmp_path / "scorer")).score(rows, ["row_id"]), ["row_id"])
    alone = scorer.score(rows.where("row_id = 6").select(*reversed(scorer.sensors), "row_id"), ["row_id"])
    require_parity(first.where("row_id = 6"), alone, ["row_id"])
    changed = scorer.retarget(0.0).score(rows, ["row_id"])
    assert changed.where("not predicted_positive").isEmpty()
    for bad in (rows.drop("sensor_a"), rows.withColumn("extra", F.lit(1.0)),
                rows.withColumn("sensor_a", F.lit(float("inf"))),
                rows.withColumns({"sensor_a": F.lit(None).cast("double"), "sensor_b": F.lit(None).cast("double")})):
        with pytest.raises(ContractError):
            scorer.score(bad, ["row_id"])
    with pytest.raises(ContractError):
        FrozenScorer.from_fit(model, PROFILE, 0.5, 1)
    sinks.write_predictions(scorer, rows, ["row_id"], str(tmp_path / "predictions"))
    assert spark.read.parquet(str(tmp_path / "predictions")).count() == 240


def test_selectors_and_results_sink(spark, frame, tmp_path):
    names = ["sensor_a", "sensor_b"]
    for kind in ("forest", "gain", "l1", "stable_forest"):
        c = Candidate(kind, "logistic_regression", selector=kind, top_k=1, trees=3, repeats=2, max_iter=8)
        model = fit(frame, PROFILE, c, names, ["row_id"])
        assert model.selected[0]["feature"] == "sensor_a"
    done = evaluation.compare_later_period(frame.where("row_id < 160"), frame.where("row_id >= 160"), PROFILE, [FAST], names,
                                           ["row_id"], 0.5)
    sinks.write_results({"comparison": done, "none": None}, str(tmp_path / "out"), note="x")
    assert spark.read.parquet(str(tmp_path / "out" / "comparison")).first().average_precision > 0.9
    assert spark.read.parquet(str(tmp_path / "out" / "run")).first().tables == "comparison"


def test_scans_reject_what_they_cannot_read(spark, tmp_path):
    two = tmp_path / "two"
    two.mkdir()
    (two / "part-0.csv").write_text("a,b\n1,2\n")
    (two / "part-1.csv").write_text("b,a\n20,10\n")
    with pytest.raises(ContractError):
        readers.read_sensor_csv(spark, str(two)).collect()
    quoted = tmp_path / "quoted.csv"
    quoted.write_text('"a,x",b\n1,2\n')
    assert readers.read_sensor_csv(spark, str(quoted)).columns == ["a,x", "b"]
    for text in ("a,b\n1,2,3\n", "a,b\n1\n", "a,b\n1,abc\n"):
        bad = tmp_path / "bad.csv"
        bad.write_text(text)
        with pytest.raises(ContractError):
            readers.read_sensor_csv(spark, str(bad)).collect()
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in "abc"])
    for text in ("1 2 3\n4 5\n", "1 2 3\n6 7 8 9\n"):
        lines = tmp_path / "lines.txt"
        lines.write_text(text)
        with pytest.raises(Exception, match="does not have 3 fields"):
            readers.scan_delimited(spark, readers.TextSource(str(lines), r"\s+"), schema).collect()
    features, labels = tmp_path / "f.txt", tmp_path / "l.txt"
    plan = readers.Ingestion("feature_metadata_pair", {
        "features": readers.TextSource(str(features), r"\s+"), "metadata": readers.TextSource(str(labels), r"\s+")},
        {"metadata_columns": ["label", "stamp"]})
    for first, second in (("1 abc\n2 3\n", '1 "d"\n2 "e"\n'), ("1 2\n2 3\n", '1 "d" x\n2 "e"\n')):
        features.write_text(first)
        labels.write_text(second)
        with pytest.raises(ContractError):
            readers.build_canonical(spark, plan)


def test_l1_penalty_shrinks(spark):
    from yieldlake.ml.models import Candidate, fit
    from yieldlake.profile import Profile
    rows = [(i, float(i % 7), float((i * 13) % 11), 1 if (i % 7) > 4 and i % 3 else -1) for i in range(120)]
    frame = spark.createDataFrame(rows, "row_id int, sensor_0 double, sensor_1 double, label int")
    profile = Profile("p", label="label", negative=-1, positive=1, timestamp=None, excluded=("row_id",), feature_prefix="sensor_")
    plain = fit(frame, profile, Candidate("a", "logistic_regression"), ["sensor_0", "sensor_1"]).model
    for mode in ("none", "balanced"):
        model = fit(frame, profile, Candidate("b", "logistic_regression_l1", weight_mode=mode), ["sensor_0", "sensor_1"])
        assert model.model.getRegParam() == pytest.approx(1 / model.weights["total"]) and model.model.getElasticNetParam() == 1.0
    penalised = fit(frame, profile, Candidate("b", "logistic_regression_l1"), ["sensor_0", "sensor_1"]).model
    assert sum(map(abs, penalised.coefficients)) < sum(map(abs, plain.coefficients))


def test_constants_without_exact_binary_form(spark):
    from yieldlake.operators import distribution, quality
    from yieldlake.profile import Profile
    frame = spark.createDataFrame([(0.1, float(i), 0.0 if i % 2 else -0.0, i % 2) for i in range(9)], "a double, b double, sensor_z double, label int")
    assert {r.correlation for r in distribution.correlations(frame, ["a", "b"]).collect()} == {None}
    profile = Profile("p", label="label", negative=0, positive=1, timestamp=None, feature_prefix="sensor_")
    assert [r.status for r in quality.feature_profile(frame.select("sensor_z", "label"), profile).collect()] == ["removed_constant"]


@pytest.mark.parametrize("module, name", [("sink_queries", "stored_predictions"), ("comparison_queries", "saved_scorer_parity")])
def test_stored_scorers_use_every_sensor(spark, monkeypatch, module, name):
    plans = importlib.import_module(f"yieldlake.plans.{module}")
    used, fit = [], plans.fit
    monkeypatch.setattr(plans, "fit", lambda *args: used.append(list(args[3])) or fit(*args))
    assert getattr(plans, name)(spark, "/root/testdata/sf0.001").count() > 0
    assert used == [[f"sensor_{i}" for i in range(6)]]


def test_split_gains_equal_the_best_split_by_hand(spark):
    rows = [(i, float(i % 6), float(i % 4), 1 if i % 6 > 3 and i % 5 else -1) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id int, a double, b double, label int")
    profile = Profile("g", label="label", negative=-1, positive=1, excluded=("row_id",))
    got = dict(models.weighted_gains(df, profile, models.Candidate("stump", "boosted_trees", trees=1, selector_depth=1), ["a", "b"]))
    positive = sum(y == 1 for *_, y in rows)
    weight = {1: (len(rows) - positive) / positive, -1: 1.0}

    def error(part):
        w = sum(weight[r[3]] for r in part)
        return sum(weight[r[3]] for r in part) - (sum(weight[r[3]] * r[3] for r in part) ** 2 / w if w else 0.0)

    best = {c: max(error(rows) - error([r for r in rows if r[c] <= cut]) - error([r for r in rows if r[c] > cut])
                   for cut in sorted({r[c] for r in rows})[:-1]) for c in (1, 2)}
    assert list(got) == ["a"] and best[1] > best[2]
    assert got["a"] == pytest.approx(best[1], rel=1e-9)


def test_averaged_gains_count_folds_alike():
    runs = [[("a", 30.0), ("b", 10.0)], [("b", 1.0)], []]
    assert models.averaged_gains(runs, ["a", "b", "c"]) == [("b", pytest.approx((0.25 + 1.0) / 3)), ("a", pytest.approx(0.25)), ("c", 0.0)]


@pytest.mark.parametrize("classifier", ["logistic_regression", "random_forest"])
def test_models_score_in_a_session_with_job_tags(spark, frame, classifier):
    """A session with a job tag or an observed metric can't be sent to tasks; a training summary refers to it."""
    spark.addTag("scoring")
    try:
        spark.range(1).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
        model = fit(frame, PROFILE, Candidate("m", classifier, max_iter=8, trees=3), ["sensor_a", "sensor_b"])
        assert not model.model.hasSummary
        assert model.score(frame).where("positive_score between 0 and 1").count() == 240
    finally:
        spark.removeTag("scoring")


def test_stored_fold_rows_are_not_written_again(spark, frame, monkeypatch):
    """Statistics of rows that are stored read them in place and equal those of written rows."""
    written = models.prep_statistics(frame, PROFILE, ["sensor_a", "sensor_b"])
    calls = []
    monkeypatch.setattr("yieldlake.ml.preprocess.cut_lineage", calls.append)
    assert models.prep_statistics(frame, PROFILE, ["sensor_a", "sensor_b"], True).medians == written.medians and not calls


def test_boosted_trees_fit_counted_bins(spark, tmp_path):
    """Rows with equal bins and label become one weighted row: the trees are those of all rows, the fit is bounded."""
    rows = [(i, float(i % 9), None if i % 4 == 0 else float(i % 5), 1 if i % 9 > 5 and i % 5 else -1) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id int, sensor_a double, sensor_b double, label int")
    names = ["sensor_a", "sensor_b"]
    c = Candidate("m", "boosted_trees", weight_mode="ratio", trees=3, depth=3)
    known = models.prep_statistics(df, PROFILE, names, candidates=[c])
    assert 10 < known.binned[1].count() < 100 and known.binned[1].agg(F.sum("__n")).first()[0] == 3000
    model = fit(df, PROFILE, c, names, known=known)
    prep = models.FeaturePrep(features=names).build(known)
    weighted = models.with_target(df, PROFILE, model.weights)
    plain = models.Fitted(c, prep, models.build_classifier(c, model.weights["total"]).fit(prep.transform(weighted)), model.weights)
    both = model.score(df).select("row_id", F.col("positive_score").alias("a")).join(
        plain.score(df).select("row_id", F.col("positive_score").alias("b")), "row_id")
    assert both.where("abs(a - b) < 1e-9").count() == 3000
    scorer = FrozenScorer.from_fit(model, PROFILE, 0.5, 5)
    scorer.save(str(tmp_path / "scorer"))
    assert FrozenScorer.load(str(tmp_path / "scorer")).score(df.select("row_id", *names), ["row_id"]).join(
        both, "row_id").where("positive_score = a").count() == 3000


def test_weight_and_depth_grid_boosts_all_trees(spark, monkeypatch):
    plans = importlib.import_module("yieldlake.plans.model_queries")
    grid = []
    monkeypatch.setattr(plans.evaluation, "compare_later_period", lambda *args, **_: grid.extend(args[3]))
    plans.weight_and_depth_grid(spark, "/root/testdata/sf0.001")
    built = [models.build_classifier(c, 1.0) for c in grid]
    assert [(b.getMaxIter(), b.getMaxDepth()) for b in built] == [(300, 5)] * 3 + [(300, 2)] * 3
    assert [c.weight_mode for c in grid] == ["none", "sqrt_ratio", "ratio"] * 2


def test_bins_of_many_values_keep_the_imputed_median_apart(spark):
    df = spark.range(8000).select(F.when(F.col("id") % 2 == 0, F.pmod(F.col("id") * 7919, F.lit(8000)).cast("double")).alias("x"),
                                  F.lit(1).alias("label"))
    prep = models.FeaturePrep(features=["x"])
    known = prep.statistics(df)
    edges = models.bin_edges(known, df, ["x"])["x"]
    assert len(edges) == 31 and edges == sorted(edges)
    counts = {r.b: r["count"] for r in df.select(F.get(prep.build(known).binned({"x": edges}).values(), F.lit(0)).alias("b")).groupBy("b").count().collect()}
    # Half of the rows are imputed; the others spread over the bins, of which the widest takes two steps.
    largest = max(counts.values())
    assert len(counts) == 32 and 4000 <= largest < 4100 and sorted(counts.values())[-2] < 300


def test_rows_of_running_sums_are_made_once(spark, spread, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(50).select("id", F.lit(1).cast("bigint").alias("n")).mapInArrow(seen, "id bigint, n bigint")
    from yieldlake.scale import running_sum
    assert running_sum(df, [F.col("id")], ["n"]).agg(F.max("cum_n")).first()[0] == 50 and made.value == 50


def test_fits_of_one_fold_share_counts_and_statistics(spark, frame, monkeypatch):
    """Class weights and fixed inputs come from the shared statistics, without a pass over the rows."""
    names = ["sensor_a", "sensor_b"]
    known = models.prep_statistics(frame, PROFILE, names)
    c = Candidate("f", "logistic_regression", selector="fixed", fixed=("sensor_a",), weight_mode="ratio", max_iter=5)
    alone = fit(frame, PROFILE, c, names)
    monkeypatch.setattr(models, "label_counts", lambda *_: pytest.fail("counted again"))
    monkeypatch.setattr(models.FeaturePrep, "statistics", lambda *_: pytest.fail("read again"))
    shared = fit(frame, PROFILE, c, names, known=known)
    assert shared.weights == alone.weights and shared.prep.get("means") == alone.prep.get("means")
    assert list(shared.model.coefficients) == list(alone.model.coefficients)
