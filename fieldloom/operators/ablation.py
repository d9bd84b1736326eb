"""Cross-validated classifiers over sets of features."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.metrics import confusion_metrics, majority_predictions, over_folds
from fieldloom.operators.quality import not_empty
from fieldloom.operators.rounds import settled

# The explicit feature sets.
COMPACT_SETS = {
    "compact_geometry": [
        "geom_rx_x", "geom_rx_y", "geom_rx_z", "geom_tx_rx_distance", "geom_all_line_dist_min",
        "geom_dynamic_line_dist_min", "geom_dynamic_rx_dist_min", "geom_dynamic_count", "geom_dynamic_centroid_count",
    ],
    "compact_geometry_material": [
        "geom_rx_x", "geom_rx_y", "geom_rx_z", "geom_tx_rx_distance", "geom_all_line_dist_min",
        "geom_dynamic_line_dist_min", "geom_dynamic_rx_dist_min", "geom_dynamic_count", "geom_dynamic_centroid_count", "mat_metal_line_dist_min",
        "mat_metal_rx_dist_min", "mat_metal_count", "mat_metal_dynamic_count", "mat_glass_line_dist_min", "mat_glass_rx_dist_min",
        "mat_wood_line_dist_min", "mat_wood_rx_dist_min", "mat_plastic_line_dist_min", "mat_plastic_rx_dist_min", "mat_textile_line_dist_min",
        "mat_cardboard_line_dist_min",
    ],
    "compact_geometry_semantic": [
        "geom_rx_x", "geom_rx_y", "geom_rx_z", "geom_tx_rx_distance", "geom_all_line_dist_min",
        "geom_dynamic_line_dist_min", "geom_dynamic_rx_dist_min", "geom_dynamic_count", "geom_dynamic_centroid_count", "sem_robot_arm_line_dist_min",
        "sem_robot_arm_rx_dist_min", "sem_robot_arm_count", "sem_robot_arm_dynamic_count", "sem_shelf_line_dist_min", "sem_window_line_dist_min",
        "sem_desk_line_dist_min", "sem_door_line_dist_min", "sem_robot_line_dist_min", "sem_drone_line_dist_min", "sem_laptop_line_dist_min",
    ],
    "compact_full_object_aware": [
        "geom_rx_x", "geom_rx_y", "geom_rx_z", "geom_tx_rx_distance", "geom_all_line_dist_min",
        "geom_dynamic_line_dist_min", "geom_dynamic_rx_dist_min", "geom_dynamic_count", "geom_dynamic_centroid_count", "mat_metal_line_dist_min",
        "mat_metal_rx_dist_min", "mat_metal_count", "mat_metal_dynamic_count", "mat_glass_line_dist_min", "mat_glass_rx_dist_min",
        "mat_wood_line_dist_min", "mat_wood_rx_dist_min", "mat_plastic_line_dist_min", "mat_plastic_rx_dist_min", "mat_textile_line_dist_min",
        "mat_cardboard_line_dist_min", "sem_robot_arm_line_dist_min", "sem_robot_arm_rx_dist_min", "sem_robot_arm_count", "sem_robot_arm_dynamic_count",
        "sem_shelf_line_dist_min", "sem_window_line_dist_min", "sem_desk_line_dist_min", "sem_door_line_dist_min", "sem_robot_line_dist_min",
        "sem_drone_line_dist_min", "sem_laptop_line_dist_min", "obj_panda_line_dist_min", "obj_panda_rx_dist_min", "obj_panda_centroid_x_mean",
        "obj_panda_centroid_y_mean", "obj_panda_centroid_z_mean", "obj_ur5_rg2_line_dist_min", "obj_ur5_rg2_rx_dist_min", "obj_ur5_rg2_centroid_x_mean",
        "obj_ur5_rg2_centroid_y_mean", "obj_ur5_rg2_centroid_z_mean",
    ],
}
#: The wide sets are all columns with these beginnings.
WIDE_SETS = {"geometry_only": ("geom_",), "geometry_material": ("geom_", "mat_"), "geometry_semantic": ("geom_", "sem_"), "full_object_aware": ("geom_", "mat_", "sem_", "obj_")}
RAW_SETS = {"raw_occupancy": ("raw_",)}


def columns_of(df: DataFrame, name: str) -> list[str]:
    """A set's columns in `df`; those that are missing are an error."""
    if name in COMPACT_SETS:
        missing = [c for c in COMPACT_SETS[name] if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        return list(COMPACT_SETS[name])
    found = sorted(c for c in df.columns if c.startswith((WIDE_SETS | RAW_SETS)[name]))
    if not found:
        raise ValueError(f"no column for {name}")
    return found


def _newton_sums(rows: DataFrame, folds: Sequence[int], scale: np.ndarray, w: np.ndarray) -> dict[int, np.ndarray]:
    """For each fold (its place in `folds`) the sums over the other folds' rows that a Newton step needs, one after
    another: loss, slope and curvature at the weights w[k], unweighted ones of each class apart. Tasks are no more
    than cores, each adds its rows up, and only the sums, by fold, reach the driver.

    scale: by fold, means and spreads of the features."""
    d = scale.shape[2]
    parts = d + 1, (d + 1) ** 2

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(folds), 2, 1 + sum(parts)))
        for batch in batches:
            x, y, own = np.array(batch["x"].tolist(), float).reshape(len(batch), d), batch["y"].to_numpy(), batch["fold"].to_numpy()
            for k, fold in enumerate(folds):
                for c in (0, 1):
                    mine = (own != fold) & (y == c)
                    z = np.hstack([(x[mine] - scale[k, 0]) / scale[k, 1], np.ones((mine.sum(), 1))])
                    s = z @ w[k]
                    p = 1 / (1 + np.exp(-np.clip(s, -60, 60)))
                    sums[k, c, 0] += (np.logaddexp(0, s) - c * s).sum()
                    sums[k, c, 1 : 1 + parts[0]] += z.T @ (p - c)
                    sums[k, c, 1 + parts[0] :] += ((z * (p * (1 - p))[:, None]).T @ z).ravel()
        yield pd.DataFrame({"k": range(len(folds)), "sums": list(sums.reshape(len(folds), -1))})

    few = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInPandas(add, "k int, sums array<double>")
    each = few.select("k", F.posexplode("sums").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    out = {k: np.zeros((2, 1 + sum(parts))) for k in range(len(folds))}
    for r in each.collect():
        out[r.k].reshape(-1)[r.i] = r.v
    return out


def balanced_logistic(rows: DataFrame, folds: Sequence[int], counts: np.ndarray, scale: np.ndarray, ridge: float = 0.1, most: int = 100, close: float = 1e-6) -> np.ndarray:
    """For each fold the weights (bias last) of a logistic regression over the other folds' rows, with class weights
    n / (2 n_class) and an L2 penalty that spares the bias, by Newton steps that are halved until the loss falls.
    Each round is one pass over the rows for all folds, each of which stops by itself.

    counts: by fold, the training rows of both classes; a class without rows gives weights that always say the other."""
    d = scale.shape[2]
    penalty = np.append(np.full(d, ridge), 0.0)
    w, step, size, now = np.zeros((len(folds), d + 1)), np.zeros((len(folds), d + 1)), np.ones(len(folds)), np.full(len(folds), np.inf)
    w[:, d] = np.where(counts.min(axis=1) > 0, 0.0, np.where(counts[:, 1] > 0, 60.0, -60.0))
    left, tried = {k for k in range(len(folds)) if counts[k].min() > 0}, w.copy()
    for _ in range(most):
        if not left:
            break
        sums = _newton_sums(rows, folds, scale, tried)
        for k in sorted(left):
            whole = (sums[k] / (2 * counts[k])[:, None]).sum(axis=0)
            loss = whole[0] + 0.5 * (penalty * tried[k] ** 2).sum()
            if loss <= now[k] + 1e-12:
                done = now[k] - loss < 1e-12 or np.abs(size[k] * step[k]).max() < close
                done = bool(done and np.isfinite(now[k]))
                w[k], now[k], size[k] = tried[k], loss, 1.0
                step[k] = np.linalg.solve(whole[d + 2 :].reshape(d + 1, d + 1) + np.diag(penalty + 1e-9), whole[1 : d + 2] + penalty * w[k])
            else:
                size[k] /= 2
                done = size[k] <= 1e-6
            tried[k] = w[k] - size[k] * step[k]
            left -= {k} if done else set()
    return w


@dataclass
class Folds:
    """Rows (fold, y, x) as a written table; the folds, ascending; by fold, how many rows of both classes the others have,
    and the means and spreads of their features."""

    rows: DataFrame
    names: list[int]
    counts: np.ndarray
    scale: np.ndarray

    def scaled(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the place of its fold, and its features as that fold's model takes them."""
        k = np.searchsorted(self.names, batch["fold"].to_numpy())
        x = np.array(batch["x"].tolist(), float).reshape(len(batch), self.scale.shape[2])
        return k, (x - self.scale[k, 0]) / self.scale[k, 1]


def by_folds(df: DataFrame, features: Sequence[str], target: str, fold: str) -> Folds:
    """What a learner needs of each fold's training rows, from two passes over the table. Missing features are 0; rows
    without a target or fold are left out."""
    rows = df.select(F.col(fold).cast("int").alias("fold"), F.col(target).cast("int").alias("y"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))
    rows = settled(rows.where("y IS NOT NULL AND fold IS NOT NULL"))
    sizes = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    folds, d = sorted({f for f, _ in sizes}), len(features)
    count, mean, var = np.array([sum(sizes.get((f, c), 0) for c in (0, 1)) for f in folds], float), np.zeros((len(folds), d)), np.zeros((len(folds), d))
    each = rows.select("fold", F.posexplode("x").alias("i", "v")).groupBy("fold", "i").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    for r in each.collect() if len(folds) > 1 else []:
        mean[folds.index(r.fold), r.i], var[folds.index(r.fold), r.i] = r.mean, r.var
    counts, scale = np.zeros((len(folds), 2)), np.zeros((len(folds), 2, d))
    for k in range(len(folds) if len(folds) > 1 else 0):
        others = np.arange(len(folds)) != k
        share = (count[others] / count[others].sum())[:, None]
        middle = (share * mean[others]).sum(axis=0)
        spread = np.sqrt((share * (var[others] + (mean[others] - middle) ** 2)).sum(axis=0))
        scale[k] = middle, np.where(spread < 1e-9, 1.0, spread)
        counts[k] = [sum(n for (f, y), n in sizes.items() if y == c and f != folds[k]) for c in (0, 1)]
    return Folds(rows, folds, counts, scale)


def logistic_predictions(df: DataFrame, features: Sequence[str], target: str = "y", fold: str = "fold") -> DataFrame:
    """(fold, y, y_pred) of every row, learned from the rows of all other folds, whatever their number; folds are few.
    Features are standardised by the training rows, missing ones are 0; rows without a target are left out, and one
    fold alone gives no rows."""
    given, d = by_folds(df, features, target, fold), len(features)
    if len(given.names) < 2:
        return df.sparkSession.createDataFrame([], "fold int, y int, y_pred int")
    w, whole = balanced_logistic(given.rows, given.names, given.counts, given.scale), replace(given, rows=None)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k, x = whole.scaled(batch)
            yield pd.DataFrame({"fold": batch["fold"], "y": batch["y"], "y_pred": ((x * w[k, :d]).sum(axis=1) + w[k, d] >= 0).astype("int32")})

    return given.rows.mapInPandas(predict, "fold int, y int, y_pred int")


LOGISTIC = "balanced_logistic"


def without_prefixes(df: DataFrame, kept: Sequence[str], dropped: Sequence[str]) -> DataFrame:
    """The columns that begin with one of `kept` and with none of `dropped`."""
    return df.select(*[c for c in df.columns if c.startswith(tuple(kept)) and not c.startswith(tuple(dropped))])


def receivers_only(df: DataFrame, rx_filter: Sequence[str]) -> DataFrame:
    """The rows of the receivers; none is an error."""
    return not_empty(df.where(F.col("rx_id").isin(*rx_filter)), f"the selection of {', '.join(rx_filter)}")


def _spark_ml() -> Callable[..., DataFrame]:
    """Imported only where one of its models is asked for."""
    try:
        from fieldloom.operators.classifiers import predictions
    except ImportError as e:
        raise RuntimeError("models other than balanced_logistic need Spark ML") from e
    return predictions


def ablation(df: DataFrame, sets: Sequence[str], target: str, fold: str = "fold", rx_filter: Sequence[str] | None = None, models: Sequence[str] = (LOGISTIC,)) -> DataFrame:
    """A result row for the majority baseline and for each feature set and model: rows, share of positives, and mean
    and standard deviation over folds of each metric. models: balanced_logistic and those of `classifiers`. A target
    with fewer than two values, as that of an empty table, is an error."""
    if rx_filter:
        df = receivers_only(df, rx_filter)
    rows = df.where(F.col(target).isNotNull())
    facts = rows.agg(F.count(F.lit(1)).alias("num_rows"), F.avg(F.col(target).cast("double")).alias("positive_ratio"), F.count_distinct(target).alias("n")).first()
    if facts.n < 2:
        raise ValueError(f"{target} has fewer than two values")
    base = majority_predictions(rows.select(F.col(fold), F.col(target).cast("int").alias("y")), fold)
    parts = [base.select(F.lit("majority_baseline").alias("feature_set"), F.lit("majority").alias("model"), F.col(fold).alias("fold"), "y", "y_pred")]
    for name in sets:
        for model in models:
            learn = logistic_predictions if model == LOGISTIC else partial(_spark_ml(), model=model)
            guesses = learn(rows, columns_of(rows, name), target=target, fold=fold)
            parts.append(guesses.select(F.lit(name).alias("feature_set"), F.lit(model).alias("model"), "fold", "y", "y_pred"))
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p)
    each = confusion_metrics(all_rows, ["feature_set", "model", "fold"])
    out = over_folds(each, ["feature_set", "model"])
    head = [F.lit(target).alias("target"), F.lit(",".join(rx_filter) if rx_filter else "ALL").alias("rx_filter"), "feature_set", F.lit(facts.num_rows).alias("num_rows"), F.lit(facts.positive_ratio).alias("positive_ratio"), "model"]
    return out.select(*head, *out.columns[2:])
