"""Retention curve fits by profile and depth, one grouped job for all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("theta_r", "theta_s", "alpha", "n")
SCHEMA_TAIL = (
    "method string, status string, n_obs int, theta_r double, theta_s double, alpha double, n double, theta_r_stderr double, theta_s_stderr double, alpha_stderr double, n_stderr double, "
    "chi_squared double, reduced_chi_squared double, aic double, bic double"
)
LEAST_POINTS = 4
POINTS = 120_000  # of the curves that are fitted side by side
SEARCHED = 500  # curves whose populations are held at once

# Arrays hold a curve in their last axis: parameters are (4, curves), what is measured (points, curves), so that numpy runs along many curves.


def curve(p: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """Water contents of many curves at once: ``p`` is (4, curves), ``psi`` (points, curves)."""
    tr, ts, a, n = p
    return tr + (ts - tr) / (1 + (a * np.maximum(psi, 1e-9)) ** n) ** (1 - 1 / n)


def suction(p: np.ndarray, theta: np.ndarray) -> np.ndarray:
    tr, ts, a, n = p
    se = np.clip((theta - tr) / np.maximum(ts - tr, 1e-9), 1e-9, 1 - 1e-9)
    return (se ** (-n / (n - 1)) - 1) ** (1 / n) / a


def start_and_bounds(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Saturated near the largest content (10 % either way), residual from 0 to 1.1 times the smallest, alpha 0.05 in [1e-5, 5], n 1.5 in [1.001, 10]."""
    one = np.ones_like(lo)
    low = np.stack([0 * one, 0.9 * hi, 1e-5 * one, 1.001 * one])
    high = np.stack([np.maximum(1.1 * lo, 1e-6), 1.1 * hi, 5 * one, 10 * one])
    return np.clip(np.stack([lo, hi, 0.05 * one, 1.5 * one]), low + 1e-9, high - 1e-9), low, high


def _free(p, low, high):
    s = np.clip((p - low) / (high - low), 1e-9, 1 - 1e-9)
    return np.log(s / (1 - s))


def _bound(u, low, high):
    return low + (high - low) / (1 + np.exp(-np.clip(u, -40, 40)))


def _square(r: np.ndarray) -> np.ndarray:
    return (r * r).sum(axis=0)


def _differences(f, p: np.ndarray) -> list[np.ndarray]:
    """The derivative of ``f`` by each parameter, by central differences."""
    out = []
    for k in range(len(p)):
        h = np.zeros_like(p)
        h[k] = 1e-6 * np.maximum(np.abs(p[k]), 1e-3)
        out.append((f(p + h) - f(p - h)) / (2 * h[k]))
    return out


class Curves:
    """Residuals of many curves: called with parameters and the curves that they are for. ``slopes`` gives the residuals and their derivative by each parameter."""

    def __init__(self, psi: np.ndarray, theta: np.ndarray, seen: np.ndarray):
        self.logs, self.theta, self.seen = np.log(np.maximum(psi, 1e-9)), theta, None if seen.all() else seen.astype(float)

    def __call__(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        tr, ts, a, n = p
        r = self.logs[:, rows]
        r += np.log(a)
        r *= n
        np.exp(r, out=r)
        r += 1
        np.log(r, out=r)
        r *= 1 / n - 1
        np.exp(r, out=r)
        r *= ts - tr
        r += tr
        r -= self.theta[:, rows]
        return r if self.seen is None else r * self.seen[:, rows]

    def slopes(self, p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tr, ts, a, n = p
        x = self.logs[:, rows]
        x += np.log(a)
        z = np.exp(n * x)
        log = np.log(1 + z)
        z /= 1 + z
        held = np.exp((1 / n - 1) * log)
        steep = (ts - tr) * held
        j = [1 - held, held, steep * z * ((1 - n) / a), -steep * (log / n**2 + (1 - 1 / n) * z * x)]
        r = steep + tr - self.theta[:, rows]
        return (r, j) if self.seen is None else (r * self.seen[:, rows], [x * self.seen[:, rows] for x in j])

    def search(self, rows: slice):
        """Sums of squares of many members for each of the curves ``rows``, as a function of parameters (4, members, curves) with alpha by its logarithm, in single precision."""
        logs, theta = self.logs[:, rows].astype(np.float32), self.theta[:, rows].astype(np.float32)
        seen = None if self.seen is None else self.seen[:, rows].astype(np.float32)

        def cost(u):
            tr, ts, a, n = u
            wide, power, out, r = ts - tr, 1 / n - 1, np.zeros_like(tr), np.empty_like(tr)
            for k in range(len(logs)):
                np.add(a, logs[k], out=r)
                r *= n
                np.minimum(r, 80, out=r)
                np.exp(r, out=r)
                r += 1
                np.log(r, out=r)
                r *= power
                np.exp(r, out=r)
                r *= wide
                r += tr
                r -= theta[k]
                r *= r
                if seen is not None:
                    r *= seen[k]
                out += r
            return out

        return cost


def _solved(a: dict, g: np.ndarray) -> np.ndarray:
    """Solutions of many positive definite systems side by side, ``a`` by (row, column) of the lower half."""
    size = len(g)
    c: dict = {}
    x: list = []
    for i in range(size):
        for k in range(i + 1):
            v = a[i, k] - sum(c[i, m] * c[k, m] for m in range(k))
            c[i, k] = np.sqrt(np.maximum(v, 1e-30)) if i == k else v / c[k, k]
        x.append((g[i] - sum(c[i, m] * x[m] for m in range(i))) / c[i, i])
    for i in reversed(range(size)):
        x[i] = (x[i] - sum(c[m, i] * x[m] for m in range(i + 1, size))) / c[i, i]
    return np.stack(x)


def levenberg(residual, p0: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Damped least squares of many curves side by side, on parameters that a logistic map keeps in their bounds.

    ``residual(p, rows)`` gives the residuals (points, rows) of the curves ``rows`` at ``p``; where it has ``slopes`` these are taken, else central differences.
    Curves that no longer gain drop out.
    """
    size = len(p0)
    pairs = [(i, k) for i in range(size) for k in range(i + 1)]

    def moved(u, rows):
        lo, hi = low[:, rows], high[:, rows]
        p = _bound(u, lo, hi)
        if hasattr(residual, "slopes"):
            (r, j), by = residual.slopes(p, rows), (p - lo) * (hi - p) / (hi - lo)
        else:
            r, j, by = residual(p, rows), _differences(lambda v: residual(_bound(v, lo, hi), rows), u), np.ones(size)
        return _square(r), np.stack([(j[i] * j[k]).sum(axis=0) * by[i] * by[k] for i, k in pairs]), np.stack([(j[k] * r).sum(axis=0) * by[k] for k in range(size)])

    u = _free(p0, low, high)
    rows = np.arange(u.shape[1])
    damp = np.full(len(rows), 1e-2)
    before, a, g = moved(u, rows)
    for _ in range(rounds):
        if not len(rows):
            break
        held = dict(zip(pairs, a[:, rows], strict=True))
        for k in range(size):
            held[k, k] = held[k, k] * (1 + damp[rows]) + 1e-12
        step = np.clip(-_solved(held, g[:, rows]), -5, 5)
        after, its_a, its_g = moved(u[:, rows] + step, rows)
        better = after < before[rows]
        won = rows[better]
        done = better & (before[rows] - after < 1e-9 * before[rows] + 1e-24)
        u[:, won] += step[:, better]
        before[won], a[:, won], g[:, won] = after[better], its_a[:, better], its_g[:, better]
        damp[won] = np.maximum(damp[won] / 3, 1e-12)
        damp[rows[~better]] *= 4
        rows = rows[~(done | (damp[rows] > 1e8))]
    return _bound(u, low, high)


def nelder(residual, p0: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 800) -> np.ndarray:
    """Downhill simplex on the same free parameters; the simplices of all curves move side by side, and those that have closed drop out."""
    cost = lambda u, rows: _square(residual(_bound(u, low[:, rows], high[:, rows]), rows))
    x0 = _free(p0, low, high)
    size = len(x0)
    out = x0.copy()
    rows = np.arange(x0.shape[1])
    s = np.stack([x0, *(x0 + 0.5 * np.eye(size)[k][:, None] for k in range(size))])  # (places, parameters, curves) of those that still move
    v = np.stack([cost(x, rows) for x in s])
    for left in reversed(range(rounds + 1)):
        least, most = v.min(axis=0), v.max(axis=0)
        closed = (most - least < 1e-16 + 1e-10 * least) | (left == 0)
        if closed.any():
            best = v[:, closed].argmin(axis=0)
            out[:, rows[closed]] = s[:, :, closed][best, :, np.arange(len(best))].T
            rows, s, v, least, most = rows[~closed], s[:, :, ~closed], v[:, ~closed], least[~closed], most[~closed]
        if not len(rows):
            break
        last = v == most
        last &= last.cumsum(axis=0) == 1  # one place, if some are as bad
        worst = np.where(last[:, None], s, 0).sum(axis=0)
        next_worst = np.where(last, -np.inf, v).max(axis=0)
        centre = (s.sum(axis=0) - worst) / size
        x = 2 * centre - worst
        fx = cost(x, rows)
        far, inner = fx < least, fx >= next_worst  # a step further, or back inside
        y = np.where(far, 3 * centre - 2 * worst, centre + 0.5 * (np.where(fx < most, x, worst) - centre))
        fy = np.full(len(rows), np.inf)
        tried = far | inner
        fy[tried] = cost(y[:, tried], rows[tried])
        second = (far & (fy < fx)) | (inner & (fy < np.minimum(fx, most)))
        moved = last & (~inner | second)
        s = np.where(moved[:, None], np.where(second, y, x), s)
        v = np.where(moved, np.where(second, fy, fx), v)
        shrink = np.flatnonzero(inner & ~second)
        if len(shrink):
            t = s[:, :, shrink]
            best = t[v[:, shrink].argmin(axis=0), :, np.arange(len(shrink))].T
            s[:, :, shrink] = best + 0.5 * (t - best)
            v[:, shrink] = [cost(x, rows[shrink]) for x in s[:, :, shrink]]
    return _bound(out, low, high)


def evolution(residual, p0: np.ndarray, low: np.ndarray, high: np.ndarray, size: int = 24, rounds: int = 80) -> np.ndarray:
    """Global search: differential evolution over the whole bounds (alpha by its logarithm), then damped least squares from the best member.

    All curves draw the same random numbers, so a fit does not depend on those beside it. Members are told apart in single precision; the least squares are in double.
    """
    first = []
    for at in range(0, p0.shape[1], SEARCHED):
        some = slice(at, min(at + SEARCHED, p0.shape[1]))
        if isinstance(residual, Curves):
            cost = residual.search(some)
        else:
            rows = np.tile(np.arange(some.start, some.stop), size)
            cost = lambda u: _square(residual(np.concatenate([u[:2], np.exp(u[2:3]), u[3:]]).reshape(len(u), -1).astype(float), rows[: u[0].size])).reshape(u[0].shape)  # noqa: E731, B023
        first.append(_searched(cost, *(x[:, some] for x in (p0, low, high)), size, rounds))
    return levenberg(residual, np.clip(np.concatenate(first, axis=1), low + 1e-9, high - 1e-9), low, high)


def _searched(cost, p0: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, rounds: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    draw = lambda *shape: rng.random(shape).astype(np.float32)
    told = lambda p: np.concatenate([p[:2], np.log(p[2:3]), p[3:]]).astype(np.float32)
    lo, hi, start = (told(x)[:, None] for x in (low, high, np.clip(p0, low, high)))
    k = len(p0)
    u = lo + (hi - lo) * draw(k, size, 1)
    u[:, :1] = start
    known = lambda u: np.nan_to_num(cost(u), copy=False, nan=np.inf)
    v = known(u)
    best_of = lambda: np.take_along_axis(u, v.argmin(axis=0)[None, None], axis=1)
    for _ in range(rounds):
        a, b = (rng.permutation(size) for _ in range(2))
        trial = (best_of() - u) * (np.float32(0.7) * draw(size, 1))
        trial += np.float32(0.7) * (u[:, a] - u[:, b])
        trial += u
        np.clip(trial, lo, hi, out=trial)
        np.copyto(trial, u, where=rng.random((k, size, 1)) >= 0.9)
        w = known(trial)
        better = w < v
        np.copyto(u, trial, where=better)
        np.copyto(v, w, where=better)
    found = best_of()[:, 0].astype(float)
    found[2] = np.exp(found[2])
    return found


def multistart(residual, p0, low, high) -> np.ndarray:
    """Damped least squares from several starts of alpha and n, the best of each curve kept."""
    rows = np.arange(p0.shape[1])
    best, least = p0, np.full(len(rows), np.inf)
    for a in (0.005, 0.05, 0.5):
        for n in (1.2, 2.0):
            start = np.clip(np.stack([p0[0], p0[1], np.full(len(rows), a), np.full(len(rows), n)]), low + 1e-9, high - 1e-9)
            p = levenberg(residual, start, low, high, 60)
            chi = _square(residual(p, rows))
            best = np.where(chi < least, p, best)
            least = np.minimum(chi, least)
    return best


METHODS = {"least_squares": levenberg, "nelder": nelder, "multistart": multistart, "evolution": evolution}


def fit_many(points: list[tuple[np.ndarray, np.ndarray]], methods: list[str], inverse: bool | str = False) -> list[pd.DataFrame]:
    """Fits of many (suction, water content) series with their statistics, a table a method and a row a series. ``inverse``: log10 suctions are fitted at the
    observed contents instead, or with ``weighted`` suctions themselves, each weighted by its inverse (of at least 1 cm)."""
    of = np.repeat(np.arange(len(points)), [len(x) for x, _ in points])
    x, y = (np.concatenate([p[k] for p in points]) for k in (0, 1))
    ok = np.isfinite(x) & np.isfinite(y) & (x >= 0)
    of, x, y = of[ok], x[ok], y[ok]
    count = np.bincount(of, minlength=len(points))
    place = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    shape = (max(int(count.max()), 1), len(points))
    psi, theta, seen = np.ones(shape), np.zeros(shape), np.zeros(shape, bool)
    psi[place, of], theta[place, of], seen[place, of] = x, y, True
    hi, lo = np.where(seen, theta, -np.inf).max(axis=0), np.where(seen, theta, np.inf).min(axis=0)
    able = np.flatnonzero((count >= LEAST_POINTS) & (hi > 0))
    out = [pd.DataFrame({"method": m, "status": "Failed", "n_obs": count.astype("int32")} | {c.split()[0]: np.nan for c in SCHEMA_TAIL.split(", ")[3:]}) for m in methods]
    if not len(able):
        return out
    psi, theta, seen, count = psi[:, able], theta[:, able], seen[:, able], count[able]
    p0, low, high = start_and_bounds(lo[able], hi[able])
    residual = forward = Curves(psi, theta, seen)
    if inverse:  # suctions are steep at both ends, so the curve itself gives the start
        target = np.log10(np.maximum(psi, 1e-3))
        if inverse == "weighted":
            residual = lambda p, rows: np.where(seen[:, rows], (np.minimum(suction(p, theta[:, rows]), 1e9) - psi[:, rows]) / np.maximum(psi[:, rows], 1.0), 0.0)
        else:
            residual = lambda p, rows: np.where(seen[:, rows], np.log10(np.maximum(suction(p, theta[:, rows]), 1e-3)) - target[:, rows], 0.0)
        p0 = levenberg(forward, p0, low, high)
    every = np.arange(len(able))
    for method, table in zip(methods, out, strict=True):
        p = METHODS[method](residual, p0, low, high)
        if inverse:
            p = np.where(_square(residual(p0, every)) < _square(residual(p, every)), p0, p)
        r, j = residual.slopes(p, every) if residual is forward else (residual(p, every), _differences(lambda v: residual(v, every), p))
        chi = _square(r)
        known = np.isfinite(chi)
        j = np.stack(j, axis=-1)[:, known].swapaxes(0, 1)  # (curves, points, parameters)
        cov = np.linalg.pinv(np.matmul(j.swapaxes(1, 2), j), hermitian=True)
        n, k, c = count[known], len(p), chi[known]
        reduced = np.where(n > k, c / np.maximum(n - k, 1), np.nan)
        per = n * np.log(np.maximum(c, 1e-250) / n)
        spread = np.sqrt(np.maximum(np.einsum("gkk->gk", cov) * reduced[:, None], 0))
        values = [*p[:, known], *spread.T, c, reduced, per + 2 * k, per + np.log(n) * k]
        table.loc[able[known], table.columns[3:]] = np.stack(values, axis=1)
        table.loc[able[known], "status"] = "Success"
    return out


def gathered(obs: DataFrame, by: list[str], psi: str, theta: str) -> DataFrame:
    """(by, __x, __y): the points of each key as two arrays, unknown ones NaN."""
    point = F.struct(F.col(psi).cast("double").alias("x"), F.col(theta).cast("double").alias("y"))
    rows = obs.groupBy(*by).agg(F.sort_array(F.collect_list(point)).alias("__p"))
    known = lambda c: F.transform("__p", lambda p: F.coalesce(p[c], F.lit(float("nan"))))
    return rows.select(*by, known("x").alias("__x"), known("y").alias("__y"))


def spread(rows: DataFrame, by: list[str]) -> DataFrame:
    """Keys dealt to a stated number of tasks, four for each core, which adaptive execution leaves alone: the work on a key is out of proportion to its bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def fits(obs: DataFrame, by: list[str], methods: list[str] | None = None, inverse: bool | str = False, psi: str = "suction_cm", theta: str = "theta") -> DataFrame:
    """A row for each key and method: parameters, standard errors, chi squared, AIC and BIC; ``Failed`` below four observations.

    A key is one profile at one depth, tens of points: they are gathered in arrays, and the fits of a whole batch of keys run side by side in
    vectorised searches.
    """
    methods = methods or ["least_squares"]
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in obs.select(*by).schema.fields]
    rows = spread(gathered(obs, by, psi, theta), by)

    def run(batches):
        for batch in batches:
            most = max(batch["__x"].map(len).max(), 1) if len(batch) else 1
            some = max(POINTS // most, 1)
            for at in range(0, len(batch), some):
                part = batch.iloc[at : at + some].reset_index(drop=True)
                points = [(np.asarray(x, dtype=float), np.asarray(y, dtype=float)) for x, y in zip(part["__x"], part["__y"], strict=True)]
                for got in fit_many(points, methods, inverse):
                    yield pd.concat([part[by], got], axis=1)

    return rows.mapInPandas(run, ", ".join(keys) + ", " + SCHEMA_TAIL)


def compared(all_fits: DataFrame, by: list[str]) -> DataFrame:
    """Fits ranked within their key by AIC."""
    from soilspark.operators.series import top

    return top(all_fits.where("status = 'Success'"), by, ["aic", "method"], 100)
