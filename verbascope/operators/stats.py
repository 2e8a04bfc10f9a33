"""Correlations and nested least squares over index rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbascope.functions.special import f_cdf, f_tail, pearson_p
from verbascope.operators.indices import PHRASE_INDICES

# Correlations of two earlier runs (document tables, then fixed levels), None where none was given.
REFERENCE_R = {
    "PH_ratio_A1": (-0.132, -0.109),
    "PH_ratio_A2": (None, +0.007),
    "PH_ratio_B1": (None, +0.047),
    "PH_ratio_B2": (+0.042, +0.042),
    "PH_ratio_C1": (+0.046, +0.046),
    "PH_ratio_C2": (None, +0.009),
    "PH_ratio_A": (-0.090, -0.096),
    "PH_ratio_B": (+0.066, +0.077),
    "PH_ratio_C": (None, +0.038),
    "PH_ratio_AboveB1": (+0.090, +0.096),
    "PH_ratio_AboveB2": (+0.060, +0.060),
    "PH_mean_score": (+0.100, +0.097),
    "PH_high_low_ratio": (+0.078, +0.081),
    "PH_score_var": (None, +0.007),
    "PH_pv_ratio": (+0.074, +0.070),
    "PH_multi_ratio": (-0.073, -0.020),
}
# The predictors of the two blocks, and the least group that is fitted.
WORD_BLOCK = ("W_mean_score", "W_ratio_A1")
PHRASE_BLOCK = ("PH_mean_score", "PH_ratio_A1", "PH_pv_ratio")
LEAST_GROUP = 30


def correlations(rows: DataFrame, names: tuple[str, ...] = PHRASE_INDICES, outcome: str = "total_score") -> DataFrame:
    """index, place, mean, sd, n, r: each index with the outcome, over the rows that have the index.

    One aggregate over the rows turned to (index, value): sums are combined
    before the shuffle, so it moves as many rows as there are indices.
    """
    stack = ", ".join(f"'{n}', {i}, `{n}`" for i, n in enumerate(names))
    long = rows.select(F.col(outcome).alias("y"), F.expr(f"stack({len(names)}, {stack}) AS (`index`, place, x)")).where("x IS NOT NULL AND NOT isnan(x)")
    sd_x, sd_y = F.stddev_pop("x"), F.stddev_pop("y")
    got = long.groupBy("index", "place").agg(F.avg("x").alias("mean"), sd_x.alias("sd"), F.count("*").alias("n"), F.covar_pop("x", "y").alias("_xy"), sd_y.alias("_sy"))
    r = F.when((F.col("n") >= 3) & (F.col("sd") > 0) & (F.col("_sy") > 0), F.col("_xy") / (F.col("sd") * F.col("_sy")))
    every = rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "`index` string, place int")
    # least and greatest pass over nulls, which must stay
    out = every.join(got.withColumn("r", F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))), ["index", "place"], "left")
    return out.select("index", "place", "mean", "sd", F.coalesce("n", F.lit(0)).alias("n"), "r")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def correlation_table(table: DataFrame) -> DataFrame:
    """``correlations`` with p, significance marks and the correlations of earlier runs: one row for each index."""
    # the two comparators are columns of a literal table, at most as long as the list of indices
    known = table.sparkSession.createDataFrame([(k, v6, fixed) for k, (v6, fixed) in REFERENCE_R.items()], "`index` string, r_docx_v6 double, r_v12_fixed double")

    @F.pandas_udf("double")
    def p_of(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([pearson_p(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")

    with_p = table.withColumn("p", F.nanvl(p_of("r", "n"), F.lit(None).cast("double")))
    return with_p.withColumn("sig", stars(F.col("p"))).withColumnRenamed("r", "r_senseaware").join(known, "index", "left")


def moments(rows: DataFrame, columns: tuple[str, ...], group: str | None = None) -> DataFrame:
    """Counts, and covariances of all pairs of ``columns``, over all rows and by ``group``, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = [F.count("*").alias("n"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov")]
    if group is None:
        return rows.agg(*aggs).select(F.lit(None).cast("string").alias("grp"), F.lit(True).alias("overall"), "n", "cov")
    return rows.rollup(group).agg(F.grouping(group).alias("g"), *aggs).select(F.col(group).alias("grp"), (F.col("g") == 1).alias("overall"), "n", "cov")


def explained(cov: np.ndarray, predictors: list[int], outcome: int) -> float:
    """R² of least squares with an intercept, of minimum norm where predictors are collinear, from centred moments."""
    xx, xy = cov[np.ix_(predictors, predictors)], cov[predictors, outcome]
    scale = np.sqrt(np.clip(np.diag(xx), 0, None))
    scale[scale == 0] = 1.0
    beta = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (xy / scale)
    return float((xy / scale) @ beta / cov[outcome, outcome])


def nested_test(n: int, cov: np.ndarray, first: int, added: int, survival: bool = False) -> dict:
    """R² of the first block, of both and of the added one alone, with the F test of the gain.

    ``cov`` is in the order first block, added block, outcome. p is one less
    the distribution function, or the tail itself with ``survival``.
    """
    y = first + added
    if n < LEAST_GROUP or cov[y, y] <= 0:
        return {"status": "skipped", "r2_word": None, "r2_both": None, "r2_phrase": None, "delta_r2": None, "f": None, "p": None, "sig": None}
    word, both = explained(cov, list(range(first)), y), explained(cov, list(range(y)), y)
    rest = n - y - 1
    f = ((both - word) / added) / ((1 - both) / rest) if both < 1 else float("inf")
    p = (0.0 if f == float("inf") else f_tail(f, added, rest)) if survival else 1 - (1.0 if f == float("inf") else f_cdf(f, added, rest))
    return {
        "status": "ok", "r2_word": word, "r2_both": both, "r2_phrase": explained(cov, list(range(first, y)), y), "delta_r2": both - word, "f": f, "p": p, "sig": p < 0.05,
    }


def hierarchical(rows: DataFrame, group: str | None = "genre", survival: bool = False) -> DataFrame:
    """The nested test over all rows and by group: as many rows as groups, fitted from their moments."""
    columns = (*WORD_BLOCK, *PHRASE_BLOCK, "total_score")
    schema = "grp string, n long, status string, r2_word double, r2_both double, r2_phrase double, delta_r2 double, f double, p double, sig boolean"

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for grp, overall, n, values in part[["grp", "overall", "n", "cov"]].itertuples(index=False):
                cov, at = np.zeros((len(columns), len(columns))), 0
                for i in range(len(columns)):
                    for j in range(i, len(columns)):
                        value = values[at]
                        cov[i, j] = cov[j, i] = 0.0 if value is None else value
                        at += 1
                out.append({"grp": "overall" if overall else grp, "n": n} | nested_test(int(n), cov, len(WORD_BLOCK), len(PHRASE_BLOCK), survival))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return moments(rows, columns, group).mapInPandas(fit, schema)
