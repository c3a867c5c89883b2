"""The regression of the cluster on the author features: predictions and their report."""
import numpy as np
import pytest

from authornet.plans import q_analysis as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    model, train, test = Q._fitted_resampled(spark, SF)
    return model, train, test.collect(), Q.ST.predict(model, test, "x", "author").join(test.select("author", "label"), "author").collect()


def test_predictions_are_the_softmax_of_the_fit(fitted):
    model, _, test, rows = fitted
    W, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    x = {r.author: np.array(r.x) for r in test}
    assert len(rows) == len(test) > 0 and {r.author for r in rows} == set(x)
    for r in rows:
        s = W @ x[r.author] + b
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert np.allclose(r.probability, p, atol=1e-9) and abs(sum(r.probability) - 1) < 1e-9 and r.prediction == int(np.argmax(p))


def test_report_recounts_the_predictions(spark, fitted, monkeypatch):
    rows = fitted[3]
    df = spark.createDataFrame([(r.author, r.prediction, r.label) for r in rows], "author string, prediction int, label int")
    monkeypatch.setattr(Q, "q_d9c", lambda spark, sf: df)
    report = {r.cls: r for r in Q.q_d13c(spark, SF).collect()}
    classes = {r.label for r in rows} | {r.prediction for r in rows}
    f1 = {}
    for c in classes:
        tp = sum(r.label == c == r.prediction for r in rows)
        support, predicted = sum(r.label == c for r in rows), sum(r.prediction == c for r in rows)
        precision, recall = tp / predicted if predicted else 0.0, tp / support if support else 0.0
        f1[c] = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        got = report[str(c)]
        assert got.support == support and np.allclose([got.precision, got.recall, got.f1], [precision, recall, f1[c]], atol=1e-6)
    assert abs(report["macro avg"].f1 - np.mean(list(f1.values()))) < 1e-6 and report["weighted avg"].support == len(rows)


def test_rewritten_tables_give_new_results(spark, tmp_path):
    """Nothing is kept from an earlier call on the same path."""
    import shutil
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/t/{t}.parquet")
    first = Q.analysis_tables(spark, f"{tmp_path}/t")["messages"].count()
    spark.read.parquet(f"{SF}/documents.parquet").limit(100).write.mode("overwrite").parquet(f"{tmp_path}/t/documents.parquet")
    second = Q.analysis_tables(spark, f"{tmp_path}/t")["messages"].count()
    assert 0 < second < first
    shutil.rmtree(tmp_path)
