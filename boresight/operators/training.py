"""Precursor models: out-of-fold logistic regressions of all families and folds, trained together.

A regression's Newton step needs only the sums of its gradient and Hessian, and sums of different regressions don't disturb
each other. So every family times every fold, and the family's final model, advance in the same passes over the rows: a task
adds up its rows for all of them, Spark adds up the tasks, and only the sums (a small square matrix a model) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boresight.operators import evaluate, features
from boresight.sources.tables import settled

FAMILIES = ("LC", "SP", "OP", "TQ")  # fixed values: the families with a model
PENALTY, LEAST_POSITIVE, LEAST_STD = 0.5, 20, 1e-6  # fixed values: inverse strength of the penalty, positives that a family needs, what is added to a deviation
THRESHOLDS = [i / 100 for i in range(50, 100)]  # fixed values


def group_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Adds ``fold``, the same for all rows of a group (null is a group): groups from the largest on (ties by name) are dealt in turn.

    Groups are counted by size first, so that only groups of equal size are put in order together.
    """
    sizes = rows.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    before = sizes.groupBy("__n").agg(F.count("*").alias("__groups")).withColumn("__before", F.coalesce(F.sum("__groups").over(Window.orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__n").orderBy("__group")) - 1 + F.col("__before")
    dealt = sizes.join(before, "__n").select("__group", (place % folds).cast("int").alias("fold"))
    return rows.join(dealt, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def _sums(rows: DataFrame, names: list[str], models: dict, at: dict) -> dict:
    """(loss, gradient, Hessian) of each model at its weights ``at``, from one pass over the rows."""
    keys, p = list(at), len(names) + 1
    labels = sorted({f for f, _ in keys})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(keys), 1 + p + p * p))
        for pdf in batches:
            raw, fold = pdf[names].to_numpy(float), pdf["fold"].to_numpy()
            for i, (family, k) in enumerate(keys):
                m, mine = models[family, k], fold != k
                x = np.hstack([(raw[mine] - m["mean"]) / m["std"], np.ones((mine.sum(), 1))])
                y = pdf[f"y_{family}"].to_numpy(float)[mine]
                weight = np.where(y == 1, m["weights"][1], m["weights"][0])
                z = x @ at[family, k]
                q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                total[i, 0] += (weight * (np.logaddexp(0, z) - y * z)).sum()
                total[i, 1 : 1 + p] += x.T @ (weight * (q - y))
                total[i, 1 + p :] += ((x * (weight * q * (1 - q))[:, None]).T @ x).ravel()
        yield pd.DataFrame({"model": range(len(keys)), "sums": list(total)})

    each = rows.select("fold", *names, *[f"y_{f}" for f in labels]).mapInPandas(add, "model int, sums array<double>")
    added = each.select("model", F.posexplode("sums").alias("i", "x")).groupBy("model", "i").agg(F.sum("x").alias("x")).collect()  # models times (features + 1) squared
    flat = np.zeros((len(keys), 1 + p + p * p))
    for r in added:
        flat[r.model, r.i] = r.x
    own = np.diag([1.0] * (p - 1) + [0.0])  # the intercept bears no penalty
    return {k: (flat[i, 0] * PENALTY + at[k] @ own @ at[k] / 2, flat[i, 1 : 1 + p] * PENALTY + own @ at[k], flat[i, 1 + p :].reshape(p, p) * PENALTY + own) for i, k in enumerate(keys)}


def fit(rows: DataFrame, names: list[str], families: list[str], folds: int = 5, close: float = 1e-9, most: int = 60) -> dict:
    """Class-balanced L2 logistic regressions on z-scored features: ``{(family, fold): {coef, intercept, mean, std}}``; fold -1 is the model of all rows.

    ``rows(fold, *names, y_<family>)`` should be stored, as each of some ten passes reads them. Rows with a feature that is null
    or no finite number take no part. A family with fewer than ``LEAST_POSITIVE`` positives has no model, nor has a fold outside which one
    of the classes is missing. A step that makes the loss grow is halved; a model is done when its gradient is below ``close`` a row.
    """
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) & (F.abs(n) < float("inf"))
    rows = rows.where(whole).select("fold", *[F.col(n).cast("double").alias(n) for n in names], *[F.col(f"y_{f}").cast("int").alias(f"y_{f}") for f in families])
    # Deviations are summed about the means of all rows, so that a large mean costs no digits.
    about = rows.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names]).first()
    shifted = [F.col(n) - F.lit(about[n]) for n in names]
    counts = [F.sum(f"y_{f}").alias(f"y_{f}") for f in families]
    by_fold = rows.groupBy("fold").agg(F.count("*").alias("n"), *counts, *[F.sum(x).alias(f"s_{n}") for n, x in zip(names, shifted)], *[F.sum(x * x).alias(f"q_{n}") for n, x in zip(names, shifted)]).collect()
    models, at = {}, {}
    for k in range(-1, folds):
        kept = [r for r in by_fold if r.fold != k]
        n = sum(r.n for r in kept)
        mean = np.array([sum(r[f"s_{c}"] for r in kept) for c in names]) / max(n, 1)
        std = np.sqrt(np.maximum(np.array([sum(r[f"q_{c}"] for r in kept) for c in names]) / max(n, 1) - mean**2, 0)) + LEAST_STD
        for f in families:
            positive = sum(r[f"y_{f}"] for r in kept)
            if sum(r[f"y_{f}"] for r in by_fold) >= LEAST_POSITIVE and 0 < positive < n:
                models[f, k] = {"mean": mean + np.array([about[c] for c in names]), "std": std, "weights": (n / (2 * (n - positive)), n / (2 * positive)), "n": n}
                at[f, k] = np.zeros(len(names) + 1)
    best, done = {}, {}
    for _ in range(most):
        if not at:
            break
        for key, (loss, gradient, hessian) in _sums(rows, names, models, at).items():
            if key in best and loss > best[key][0] + 1e-12 * abs(loss):
                at[key] = (at[key] + best[key][1]) / 2
                continue
            best[key] = (loss, at[key])
            if np.abs(gradient).max() <= close * models[key]["n"]:
                done[key] = at.pop(key)
            else:
                at[key] = at[key] - np.linalg.solve(hessian, gradient)
    done |= {k: best[k][1] for k in at}
    return {k: {"coef": w[:-1].tolist(), "intercept": float(w[-1]), "mean": models[k]["mean"].tolist(), "std": models[k]["std"].tolist()} for k, w in done.items()}


def out_of_fold(rows: DataFrame, models: dict, names: list[str], families: list[str], folds: int = 5) -> DataFrame:
    """Adds ``p_<family>``, each row's probability under the model fitted without its fold (null without one, or without all features)."""
    for f in families:
        p = F.lit(None).cast("double")
        for k in range(folds):
            if (f, k) in models:
                p = F.when(F.col("fold") == k, features.score_family(models[f, k], names)[0]).otherwise(p)
        known = F.lit(True)
        for n in names:
            known = known & F.col(n).isNotNull()
        rows = rows.withColumn(f"p_{f}", F.when(known, p))
    return rows


def alarm_report(scored: DataFrame, segments: DataFrame, thresholds: list[float] | None = None, most: float = 2.0) -> DataFrame:
    """By family the threshold that keeps false alarms rare, and what it catches: ``family, threshold, false_per_day, n_events, event_recall, median_lead_min``.

    ``scored(segment, family, t, p)``, a row each 10 seconds; ``segments(segment, kind, t_onset)``, one row a segment.
    """
    told = scored.join(segments.select("segment", "kind"), "segment")
    rates = evaluate.false_alarm_rates(told, thresholds or THRESHOLDS)
    chosen = evaluate.choose_threshold(rates, most)
    own = told.where(F.col("kind") == F.col("family")).join(F.broadcast(chosen), "family")  # a row a family; other families' alarms are no event's
    alarms = features.episodes(own, ["segment", "family"], "t", F.col("p") >= F.col("threshold")).select("segment", "family", F.col("t").alias("alarm_t"))
    leads = evaluate.event_leads(alarms, segments).groupBy("family").agg(F.count("*").alias("n_events"), F.avg(F.col("lead_min").isNotNull().cast("int")).alias("event_recall"), F.median("lead_min").alias("median_lead_min"))
    found = chosen.join(rates, ["family", "threshold"], "left").join(leads, "family", "left")
    return found.select("family", "threshold", "false_per_day", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("event_recall", F.lit(0.0)).alias("event_recall"), "median_lead_min")


def report(rows: DataFrame, segments: DataFrame, names: list[str], families: list[str] | None = None, folds: int = 5) -> DataFrame:
    """Validation of each family's model on groups that it never saw; ``rows(group, segment, t, *names, y_<family>)``, ``segments`` as above.

    Scores are taken to six places. Families without a model have no row.
    """
    families = list(families or FAMILIES)
    dealt = settled(group_folds(rows, "group", folds))
    models = fit(dealt, names, families, folds)
    made = out_of_fold(dealt, models, names, families, folds)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.round(f"p_{f}", 6).alias("p"), F.col(f"y_{f}").alias("label")) for f in families if (f, -1) in models] or [F.struct(F.lit("").alias("family"), F.lit(0.0).alias("p"), F.lit(0).alias("label"))]))
    scored = made.select("segment", "t", each.alias("x")).select("segment", "t", "x.*").where("p IS NOT NULL AND family <> ''")
    ranked = evaluate.auc(scored.withColumnRenamed("p", "score"), ["family"], "label", "score").select("family", (F.col("p") + F.col("n")).alias("n_samples"), F.col("p").alias("n_positive"), "auc")
    return ranked.join(alarm_report(scored.drop("label"), segments), "family")
