import numpy as np
import pytest
from fieldloom.operators import ablation, metrics, perceptron
from pyspark.sql import functions as F


def table_of(spark, x, y, folds=2):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i % folds, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "fold int, y int, " + ", ".join(f"{n} double" for n in names)), names


@pytest.fixture(scope="module")
def ring():
    x = np.random.default_rng(4).standard_normal((400, 2))
    return x, (np.abs(x).sum(axis=1) > 1.4).astype(int)


def test_slope_of_the_loss():
    rng = np.random.default_rng(2)
    x, w = rng.standard_normal((30, 3)), perceptron.starting(3, 7)
    for c in (0, 1):
        loss, slope = (lambda s: (s[0], s[1:]))(perceptron.loss_and_slope(w, x, c, np.ones(30)))
        s = perceptron.scores(w, x)
        assert np.isclose(loss, -np.log(1 / (1 + np.exp(-s if c else s))).sum())
        for i in rng.choice(len(w), 25, replace=False):
            step = np.zeros(len(w))
            step[i] = 1e-6
            near = (perceptron.loss_and_slope(w + step, x, c, 1)[0] - perceptron.loss_and_slope(w - step, x, c, 1)[0]) / 2e-6
            assert abs(near - slope[i]) < 1e-4


def test_sums_are_those_of_a_plain_loop(spark, ring):
    x, y = ring
    x, y = np.concatenate([x, np.repeat(x[:1], 25, axis=0)]), np.concatenate([y, np.repeat(y[:1], 25)])
    df, names = table_of(spark, x, y, 3)
    given = ablation.by_folds(df.repartition(5), names, "y", "fold")
    tried = np.array([perceptron.starting(2, k) for k in range(3)])
    rows = perceptron.dealt(given)
    got = perceptron._sums(given, rows, tried)
    rows = rows.collect()
    assert sum(r.learned + r.held for r in rows) == 425 and all(abs(r.held - (r.learned + r.held) / perceptron.HELD) < 1 for r in rows)
    for k in range(3):
        others = np.array([r.x for r in rows if r.fold != k for _ in range(r.learned + r.held)])
        assert np.allclose(given.scale[k], [others.mean(axis=0), others.std(axis=0)])
        for c in (0, 1):
            some = [((np.array(r.x) - given.scale[k, 0]) / given.scale[k, 1], r.learned, r.held) for r in rows if r.fold != k and r.y == c]
            assert got[k, c, 0] == sum(n for _, n, _ in some) and got[k, c, -2] == sum(n for _, _, n in some) > 0
            assert got[k, c, -1] == sum(n * ((perceptron.scores(tried[k], v[None])[0] >= 0) == c) for v, _, n in some)
            assert np.allclose(got[k, c, 1:-2], sum(n * perceptron.loss_and_slope(tried[k], v[None], c, 1) for v, n, _ in some))


def test_a_ring_that_no_line_can_tell(spark, ring):
    df, names = table_of(spark, *ring)
    line, net = (f(df, names).withColumn("k", F.lit(1)) for f in (ablation.logistic_predictions, perceptron.perceptron_predictions))
    assert net.count() == 400
    told = metrics.confusion_metrics(net, ["k"]).first().balanced_accuracy
    assert told > 0.85 > 0.65 > metrics.confusion_metrics(line, ["k"]).first().balanced_accuracy


def test_tasks_change_nothing_and_rare_classes_count(spark, ring):
    x, y = ring
    rare = np.concatenate([np.flatnonzero(y == 0), np.flatnonzero(y == 1)[:20]])
    df, names = table_of(spark, x[rare], y[rare])
    one, many = (perceptron.learned(ablation.by_folds(df.repartition(n), names, "y", "fold"), most=12) for n in (1, 9))
    assert np.allclose(one, many, atol=1e-4)
    told = metrics.confusion_metrics(perceptron.perceptron_predictions(df, names).withColumn("k", F.lit(1)), ["k"]).first()
    assert told.balanced_accuracy > 0.7


def test_descent_stops_when_the_held_out_score_does():
    x = perceptron._Descent(np.array([4.0, -2.0]))
    for n in range(50):
        if x.done:
            break
        at = x.tried()
        x.told((at**2 * [1, 3]).sum(), 2 * at * [1, 3], 0.5 if n else 0.9)
    assert x.done and x.best.tolist() == [4.0, -2.0] and np.abs(x.at).max() < 1e-3
    x = perceptron._Descent(np.array([4.0, -2.0]))
    for _ in range(50):
        at = x.tried()
        loss = (at**2 * [1, 3]).sum()
        if not x.done:
            x.told(loss, 2 * at * [1, 3], -loss)
    assert x.done and np.abs(x.best).max() < 1e-2


def test_edges(spark):
    schema = "fold int, y int, a double, b string, x string"
    assert perceptron.perceptron_predictions(spark.createDataFrame([], schema), ["a"]).count() == 0
    assert perceptron.perceptron_predictions(spark.createDataFrame([(0, 1, 1.0, "", "")] * 5, schema), ["a"]).count() == 0
    same = [(k, 1, 2.0, None, "clash") for k in (0, 1) for _ in range(6)] + [(0, None, 1.0, "", ""), (None, 0, 1.0, "", "")]
    assert {tuple(r) for r in perceptron.perceptron_predictions(spark.createDataFrame(same, schema), ["a"]).collect()} == {(0, 1, 1), (1, 1, 1)}
    mixed = [(k, y, None if y else 1.0, "", "") for k in (0, 1) for y in (0, 1) for _ in range(6)]
    out = perceptron.perceptron_predictions(spark.createDataFrame(mixed, schema), ["a"]).collect()
    assert len(out) == 24 and all(r.y == r.y_pred for r in out)
