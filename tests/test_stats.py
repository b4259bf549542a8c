"""Golden vectors of the significance tests (inputs and outputs published
with the reference's logs)."""

import numpy as np
import pytest

from parlance.functions import stats as st


def test_paired_t_pvalue():
    assert st.t_pvalue(1.1672034734115613, 4, "greater") == pytest.approx(0.15398141315952762, rel=1e-9)
    assert st.t_pvalue(2.653768268989025, 4, "greater") == pytest.approx(0.028379044464640502, rel=1e-9)


def test_paired_t_statistic_from_folds(spark):
    from parlance.operators import evaluate as ev
    a = [0.75229358, 0.64220183, 0.67592593, 0.72222222, 0.74074074]  # augment l svm, acc
    b = [0.66055046, 0.72477064, 0.55555556, 0.67592593, 0.71296296]  # target-only svm, acc
    rows = [("A", i, x, 0.0) for i, x in enumerate(a)] + [("B", i, x, 0.0) for i, x in enumerate(b)]
    scores = spark.createDataFrame(rows, "method string, fold int, acc double, fms double")
    r = ev.paired_t(scores, "A", "B").filter("metric = 'acc'").first()
    assert r["t"] == pytest.approx(1.167203, abs=1e-6)
    assert r["alternative"] == "greater"


def test_wilcoxon_exact():
    a = np.array([0.7706422, 0.67889908, 0.63888889, 0.7037037, 0.75])
    b = np.array([0.66055046, 0.72477064, 0.55555556, 0.67592593, 0.71296296])
    w, p = st.wilcoxon_zsplit(a - b, "greater")
    assert (w, p) == (12.0, pytest.approx(0.15625))
    fa = np.array([0.80620155, 0.73684211, 0.67768595, 0.75384615, 0.80291971])
    fb = np.array([0.60215054, 0.72222222, 0.41463415, 0.66019417, 0.65934066])
    w, p = st.wilcoxon_zsplit(fa - fb, "greater")
    assert (w, p) == (15.0, pytest.approx(0.03125))


TRUE = [0, 0, 0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1, 0, 1, 0, 1, 1, 0, 1, 1, 1, 0, 0, 0, 1, 1, 1, 0, 1, 1, 0, 0,
        0, 0, 0, 1, 1, 1, 0, 1, 1]
AUGMENT = [0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1, 0, 0, 0, 1, 1, 0,
           0, 0, 0, 1, 1, 1, 1, 0, 0, 1]
MULT = [0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1, 0, 0, 0, 1, 1, 0, 0,
        0, 0, 1, 1, 1, 1, 0, 0, 1]
TARGET = [0, 0, 1, 1, 1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0,
          0, 0, 0, 1, 1, 1, 1, 0, 0, 1]


@pytest.mark.parametrize("pred,chi2,p", [(AUGMENT, 0.25, 0.6170750774519739), (MULT, 0.0, 1.0)])
def test_mcnemar(spark, pred, chi2, p):
    from parlance.operators import evaluate as ev
    df = spark.createDataFrame(list(zip(TRUE, pred, TARGET)), "label int, pred_a int, pred_b int")
    r = ev.mcnemar_pvalue(ev.mcnemar(df)).first()
    assert r["chi2"] == pytest.approx(chi2)
    assert r["p_value"] == pytest.approx(p, rel=1e-9)


def test_welch_t_matches_definition(spark):
    from parlance.operators import evaluate as ev
    rng = np.random.default_rng(0)
    a, b = rng.normal(1, 1, 30), rng.normal(0, 2, 40)
    rows = [("f", 1, float(x)) for x in a] + [("f", 0, float(x)) for x in b]
    df = spark.createDataFrame(rows, "feature string, cohort int, value double")
    r = ev.with_t_pvalue(ev.welch_table(df)).first()
    va, vb = a.var(ddof=1) / 30, b.var(ddof=1) / 40
    t = (a.mean() - b.mean()) / np.sqrt(va + vb)
    assert r["t"] == pytest.approx(t, abs=1e-6)
    dfree = (va + vb) ** 2 / (va ** 2 / 29 + vb ** 2 / 39)
    assert r["p_value"] == pytest.approx(st.t_pvalue(t, dfree), rel=1e-6)
