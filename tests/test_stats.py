import numpy as np
import pytest

from verbascope.functions import special
from verbascope.operators import stats


def correlate(spark, x, y):
    rows = spark.createDataFrame([(None if a is None else float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, total_score double")
    return stats.correlations(rows, ("x",)).first()


def test_correlation(spark):
    r = correlate(spark, (1, 2, 3, 4), (1, 3, 2, 5))
    assert r["r"] == pytest.approx(0.8315218406202999, abs=1e-12) and r["sd"] == pytest.approx(1.118033988749895) and r["n"] == 4


@pytest.mark.parametrize("gap", [None, float("nan")])
def test_pairs_without_a_value_go(spark, gap):
    r = correlate(spark, (1, 2, gap, 4), (1, 3, 9, 5))
    assert r["n"] == 3 and r["r"] == pytest.approx(0.9819805060619656, abs=1e-12)


@pytest.mark.parametrize(("x", "y"), [((1, 1, 1), (1, 2, 3)), ((1, 2), (1, 2)), ((None, None, None), (1, 2, 3)), ((1, 2, 3), (4, 4, 4))])
def test_no_correlation(spark, x, y):
    assert correlate(spark, x, y)["r"] is None


def test_tails():
    assert special.f_tail(5, 3, 1000) == pytest.approx(0.0019077, abs=1e-7) and 1 - special.f_cdf(5, 3, 1000) == pytest.approx(0.0019077, abs=1e-7)
    assert special.t_two_sided(-2, 100) == pytest.approx(0.048212, abs=1e-6)
    assert special.pearson_p(1.0, 5) == 0 and special.pearson_p(None, 5) is None and special.pearson_p(0.3, 2) is None
    assert 1 - special.f_cdf(80, 3, 2000) == pytest.approx(0, abs=1e-15) and 0 < special.f_tail(80, 3, 2000) < 1e-40


@pytest.mark.parametrize(("t", "df"), [(0.5, 3), (2.5, 7), (12, 40)])
def test_t_against_the_jvm(spark, t, df):
    known = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df))
    assert special.t_two_sided(t, df) == pytest.approx(2 * known.cumulativeProbability(-float(t)), rel=1e-9)


def frame(spark, n, collinear=False, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    if collinear:
        x[:, 4] = 2 * x[:, 0] - x[:, 1]
    y = x @ np.array([0.5, 0.2, 0.4, 0, 0.1]) + rng.normal(size=n) + 20
    columns = [*stats.WORD_BLOCK, *stats.PHRASE_BLOCK, "total_score"]
    rows = [(*map(float, r), float(t), "letter" if i % 3 else "report") for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", genre string"), x, y


def r2(x, y):
    design = np.column_stack([np.ones(len(x)), x])
    left = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    return 1 - left @ left / ((y - y.mean()) @ (y - y.mean()))


@pytest.mark.parametrize("collinear", [False, True])
def test_hierarchy(spark, collinear):
    rows, x, y = frame(spark, 200, collinear)
    got = {r["grp"]: r for r in stats.hierarchical(rows).collect()}
    assert set(got) == {"overall", "letter", "report"} and got["report"]["n"] == 67
    total = got["overall"]
    assert total["r2_word"] == pytest.approx(r2(x[:, :2], y), abs=1e-10) and total["r2_both"] == pytest.approx(r2(x, y), abs=1e-10) and total["r2_phrase"] == pytest.approx(r2(x[:, 2:], y), abs=1e-10)
    f = ((r2(x, y) - r2(x[:, :2], y)) / 3) / ((1 - r2(x, y)) / 194)
    assert total["f"] == pytest.approx(f, rel=1e-8) and total["p"] == pytest.approx(1 - special.f_cdf(f, 3, 194), abs=1e-12) and total["r2_both"] >= total["r2_word"]


@pytest.mark.parametrize(("n", "status"), [(29, "skipped"), (30, "ok")])
def test_small_groups_are_skipped(spark, n, status):
    assert stats.hierarchical(frame(spark, n)[0], group=None).first()["status"] == status


def test_marks(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0001, 0.005, 0.03, 0.2, None)], "p double")
    assert [r[0] for r in rows.select(stats.stars(rows.p)).collect()] == ["***", "**", "*", "", ""]
