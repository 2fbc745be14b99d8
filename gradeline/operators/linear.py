"""Logistic models of all folds and variants in lockstep: one preparation, and one job for each step of all fits together."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Generator, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.columns import logit
from gradeline.operators.boosting import task_count
from gradeline.operators.checks import ContractError
from gradeline.operators.ordering import exact_medians
from gradeline.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class LogisticSettings:
    C: float = 1.0
    balanced: bool = True
    max_iter: int = 200
    tol: float = 1e-9


@dataclass(frozen=True)
class Preparation:
    """What the fit rows of one fold say about the features: medians, means and deviations after the median fill, levels, class sizes."""

    numeric: tuple[str, ...]
    middle: tuple[float, ...]
    mean: tuple[float, ...]
    deviation: tuple[float, ...]
    categorical: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]
    sizes: tuple[float, float]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *(f"{c}={v}" for c, vs in zip(self.categorical, self.levels, strict=True) for v in vs)]

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """(rows, features): filled and scaled numbers, then one column per level."""
        out = []
        for c, middle, mean, deviation in zip(self.numeric, self.middle, self.mean, self.deviation, strict=True):
            x = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out.append((np.where(np.isnan(x), middle, x) - mean) / deviation)
        for c, levels in zip(self.categorical, self.levels, strict=True):
            codes = pa.compute.index_in(batch.column(c).cast(pa.string()).fill_null("missing"), pa.array(levels, pa.string()))
            codes = codes.fill_null(-1).to_numpy(zero_copy_only=False)
            out += [(codes == k).astype(float) for k in range(len(levels))]
        return np.column_stack(out)

    def weights(self, y: np.ndarray, balanced: bool) -> np.ndarray:
        total = sum(self.sizes)
        return np.where(y == 1, total / (2 * self.sizes[1]), total / (2 * self.sizes[0])) if balanced else np.ones(len(y))


def logit_column(p: str, eps: float) -> Column:
    return logit(F.col(p), eps)


def _number(value: float) -> str:
    return f"({value!r}D)"


def _text(value: str) -> str:
    quoted = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{quoted}'"


@dataclass(frozen=True)
class LogisticModel:
    """Fitted coefficients over a preparation; a feature left out has none."""

    preparation: Preparation
    coefficients: tuple[float, ...]
    intercept: float
    kept: tuple[int, ...] = field(default=())

    def margin_sql(self) -> str:
        """The linear predictor as SQL text."""
        p, terms, k = self.preparation, [_number(self.intercept)], 0
        by_place = dict(zip(self.kept, self.coefficients, strict=True))
        for c, middle, mean, deviation in zip(p.numeric, p.middle, p.mean, p.deviation, strict=True):
            if k in by_place:
                x = f"coalesce(nanvl(cast(`{c}` as double), cast(null as double)), {_number(middle)})"
                terms.append(f"({x} - {_number(mean)}) / {_number(deviation)} * {_number(by_place[k])}")
            k += 1
        for c, levels in zip(p.categorical, p.levels, strict=True):
            cases = []
            for level in levels:
                if k in by_place:
                    cases.append(f"when {_text(level)} then {_number(by_place[k])}")
                k += 1
            if cases:
                terms.append(f"case coalesce(cast(`{c}` as string), 'missing') {' '.join(cases)} else 0D end")
        return " + ".join(terms)

    def margin(self) -> Column:
        return F.expr(self.margin_sql())

    def score(self, rows: DataFrame, p: str = "p", margin: str | None = None) -> DataFrame:
        z = self.margin()
        return rows.select("*", (1 / (1 + F.exp(-z))).alias(p), *([z.alias(margin)] if margin else []))

    def named(self) -> dict[str, float]:
        names = self.preparation.names
        return {names[k]: v for k, v in zip(self.kept, self.coefficients, strict=True)} | {"(intercept)": self.intercept}


def preparations(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str = "target", by: str = "fold") -> dict[int, Preparation]:
    """The preparation of every group of fit rows: one grouped aggregate, and one for all their exact medians."""
    aggregates = [f"count_if(`{target}` = {k}) as size_{k}" for k in (0, 1)] + ["count(1) as rows"]
    for c in numeric:
        x = f"nanvl(cast(`{c}` as double), cast(null as double))"
        aggregates += [f"count({x}) as `n_{c}`", f"avg({x}) as `m_{c}`", f"var_pop({x}) as `v_{c}`"]
    aggregates += [f"sort_array(collect_set(coalesce(cast(`{c}` as string), 'missing'))) as `l_{c}`" for c in categorical]
    middles: dict = {}
    if numeric:
        numbers = rows.select(by, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in numeric])
        middles = exact_medians(numbers, numeric, by)
    out = {}
    for r in rows.groupBy(by).agg(*map(F.expr, aggregates)).collect():  # one row per group
        if not min(r["size_0"], r["size_1"]):
            raise ContractError("both classes are needed to fit a model")
        if empty := [c for c in numeric if (r[by], c) not in middles]:
            raise ContractError(f"columns without any value: {empty}")
        filled = []
        for c in numeric:
            n, k, middle, mean = r["rows"], r[f"n_{c}"], middles[r[by], c], r[f"m_{c}"]
            whole = (k * mean + (n - k) * middle) / n
            variance = (k * (r[f"v_{c}"] + (mean - whole) ** 2) + (n - k) * (middle - whole) ** 2) / n
            filled.append((middle, whole, math.sqrt(variance) or 1.0))
        columns = tuple(zip(*filled, strict=True)) if filled else ((), (), ())
        out[r[by]] = Preparation(tuple(numeric), *columns, tuple(categorical), tuple(tuple(r[f"l_{c}"]) for c in categorical),
                                 (float(r["size_0"]), float(r["size_1"])))
    return out


@dataclass(frozen=True)
class Logistic:
    """Settings and features of a logistic model: called with fit rows it fits one, over folds all of them in lockstep.

    ``uses`` names the columns of a variant; the others are prepared but get no coefficient.
    """

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    settings: LogisticSettings = LogisticSettings()
    uses: tuple[str, ...] | None = None
    target: str = "target"

    def __call__(self, rows: DataFrame) -> LogisticModel:
        return fit_together(rows.withColumn("fold", F.lit(0)), [self])[0, 0]

    def out_of_fold(self, long: DataFrame, folds: Sequence[int]) -> DataFrame:
        return out_of_fold(long, folds, [self])[0]

    def places(self, preparation: Preparation) -> np.ndarray:
        used = set(self.uses if self.uses is not None else [*self.numeric, *self.categorical])
        owners = [*preparation.numeric, *(c for c, vs in zip(preparation.categorical, preparation.levels, strict=True) for _ in vs)]
        return np.array([k for k, c in enumerate(owners) if c in used], int)


_BLOCK = "fold int, y binary, x binary"


def fit_together(fit: DataFrame, variants: Sequence[Logistic]) -> dict[tuple[int, int], LogisticModel]:
    """A model for every (variant number, fold) of the fit rows (fold, target, features) by Newton steps.

    The optimum is that of C * weighted loss + |coefficients|^2 / 2 with a free intercept. Every step is one job in which all open
    fits get their loss, gradient and curvature from each block; a step that raises a loss is halved.
    """
    head = variants[0]
    if any((v.numeric, v.categorical, v.target) != (head.numeric, head.categorical, head.target) for v in variants):
        raise ValueError("variants that are fitted together must share their columns")
    fit = fit.select(F.col("fold").cast("int").alias("fold"), F.col(head.target).cast("double").alias(head.target), *head.numeric, *head.categorical)
    plans = preparations(fit, head.numeric, head.categorical, head.target)
    if not plans:
        raise ContractError("both classes are needed to fit a model")
    rows = sum(sum(p.sizes) for p in plans.values())

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            for fold in np.unique(folds):
                part = batch.filter(pa.array(folds == fold))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(fold)], pa.int32()), pa.array([part.column(head.target).to_numpy().tobytes()], pa.binary()),
                     pa.array([plans[int(fold)].matrix(part).tobytes()], pa.binary())], names=["fold", "y", "x"])

    tasks = task_count(rows, fit.sparkSession.sparkContext.defaultParallelism)
    state = checkpointed(fit.repartition(tasks).mapInArrow(packed, _BLOCK))
    blocks = state.rdd.map(_unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    places = {(k, f): variants[k].places(p) for k in range(len(variants)) for f, p in plans.items()}
    settings = {k: v.settings for k, v in enumerate(variants)}
    found = _newton(blocks, places, plans, settings)
    blocks.unpersist()
    return {m: LogisticModel(plans[m[1]], tuple(beta[:-1].tolist()), float(beta[-1]), tuple(places[m].tolist())) for m, beta in found.items()}


def _unpacked(row: Mapping) -> tuple:
    y = np.frombuffer(row["y"])
    return row["fold"], y, np.frombuffer(row["x"]).reshape(len(y), -1)


def _newton(blocks: RDD, places: Mapping, plans: Mapping[int, Preparation], settings: Mapping[int, LogisticSettings]) -> dict:
    beta = {m: np.zeros(len(at) + 1) for m, at in places.items()}
    last: dict = {m: (math.inf, b) for m, b in beta.items()}
    open_models = set(beta)
    for _ in range(max(s.max_iter for s in settings.values())):
        now = {m: beta[m] for m in open_models}
        sums = blocks.mapPartitions(lambda rows, now=now: [_curvature(rows, now, places, plans, settings)]).treeReduce(_added)
        for m in sorted(open_models):
            loss, gradient, curvature = sums[m]
            ridge = np.r_[np.full(len(places[m]), 1 / settings[m[0]].C), 0.0]
            loss += (ridge * now[m] ** 2).sum() / 2
            if loss > last[m][0] * (1 + 1e-12):
                beta[m] = (now[m] + last[m][1]) / 2
                continue
            gradient = gradient + ridge * now[m]
            move = np.linalg.lstsq(curvature + np.diag(ridge), gradient, rcond=None)[0]
            last[m] = (loss, now[m])
            beta[m] = now[m] - move
            if np.abs(gradient).max() <= settings[m[0]].tol * sum(plans[m[1]].sizes) and np.abs(move).max() <= 1e-7 * max(1.0, np.abs(beta[m]).max()):
                open_models.discard(m)
        if not open_models:
            break
    return beta


def _curvature(rows: Iterable[tuple], now: Mapping, places: Mapping, plans: Mapping[int, Preparation], settings: Mapping[int, LogisticSettings]) -> dict:
    """Loss, gradient and curvature sums of every open model over the blocks of a task."""
    sums: dict = {}
    for fold, y, x in rows:
        for m, beta in now.items():
            if m[1] != fold:
                continue
            z = x[:, places[m]] @ beta[:-1] + beta[-1]
            w = plans[fold].weights(y, settings[m[0]].balanced)
            p = 1 / (1 + np.exp(-z))
            design = np.column_stack([x[:, places[m]], np.ones(len(y))])
            part = ((w * (np.logaddexp(0, z) - y * z)).sum(), design.T @ (w * (p - y)), design.T @ (design * (w * p * (1 - p))[:, None]))
            sums[m] = part if m not in sums else tuple(a + b for a, b in zip(sums[m], part, strict=True))
    return sums


def _added(a: dict, b: dict) -> dict:
    return {m: tuple(x + y for x, y in zip(a[m], b[m], strict=True)) if m in a and m in b else a.get(m, b.get(m)) for m in a.keys() | b.keys()}


def out_of_fold(long: DataFrame, folds: Sequence[int], variants: Sequence[Logistic]) -> list[DataFrame]:
    """Held-out rows with ``p`` for each variant; the fold's model is chosen inside one column expression."""
    wanted = long.filter(F.col("fold").isin(*folds))
    models = fit_together(wanted.filter("part = 'fit'"), variants)
    held = wanted.filter("part = 'holdout'")
    out = []
    for k in range(len(variants)):
        margin = " ".join(f"when {int(f)} then {models[k, f].margin_sql()}" for f in folds)
        out.append(held.withColumn("p", F.expr(f"1D / (1D + exp(-(case fold {margin} end)))")))
    return out


# ---- any smooth losses in lockstep ---------------------------------------------------------------


Descent = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def descent(start: np.ndarray, tolerance: float = 1e-6, steps: int = 200, memory: int = 10) -> Descent:
    """A minimum of one smooth loss by limited-memory quasi-Newton steps: yields the points to try, is sent (loss, gradient) of each.

    A step that does not lower the loss enough is shortened in the next try; the fit ends when its gradient is below ``tolerance``.
    """
    point = np.array(start, float)
    value, gradient = yield point
    pairs: list = []
    reach, direction = 1.0, -gradient / max(1.0, np.linalg.norm(gradient))
    if np.abs(gradient).max(initial=0) <= tolerance:
        return point
    for _ in range(steps):
        tried = point + reach * direction
        loss, slope = yield tried
        if loss > value + 1e-4 * reach * gradient @ direction:
            reach /= 2
            if reach < 1e-12:
                break
            continue
        s, y = tried - point, slope - gradient
        if s @ y > 1e-16:
            pairs = [*pairs[1 - memory:], (s, y)] if len(pairs) >= memory else [*pairs, (s, y)]
        point, value, gradient, reach = tried, loss, slope, 1.0
        if np.abs(slope).max() <= tolerance:
            break
        direction = -_two_loops(slope, pairs)
    return point


def lockstep(evaluate: Callable[[dict], dict], fits: Mapping) -> dict:
    """What many fits return: ``evaluate`` takes {name: point} of all open ones and returns {name: what is sent back}, one job a step."""
    asked, done = {}, {}

    def moved(name: object, answer: object) -> None:
        try:
            asked[name] = fits[name].send(answer)
        except StopIteration as end:
            asked.pop(name, None)
            done[name] = end.value

    for name in fits:
        moved(name, None)
    while asked:
        for name, answer in evaluate(dict(asked)).items():
            moved(name, answer)
    return done


def minimised(evaluate: Callable[[dict], dict], starts: Mapping, tolerance: float = 1e-6, steps: int = 200, memory: int = 10) -> dict:
    """Minima of many smooth losses at once: ``evaluate`` takes {name: point} of all open fits and returns {name: (loss, gradient)}."""
    return lockstep(evaluate, {m: descent(w, tolerance, steps, memory) for m, w in starts.items()})


def _two_loops(gradient: np.ndarray, pairs: list) -> np.ndarray:
    """The inverse curvature of the last steps applied to a gradient."""
    q, kept = gradient.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(kept), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return q
