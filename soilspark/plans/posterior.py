"""Posteriors of retention curves: the chains of many keys advance side by side."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilspark.plans.fit import LEAST_POINTS, NAMES, gathered, spread

CHAINS = 4
BATCH = 256  # keys whose chains advance together: some 170 MB of draws and random numbers
FEW = 16  # keys whose draws are summed up at once: some MB, which a core's own cache mostly holds
HALF = 25  # steps change each 2 HALF steps while chains are tuned
# fixed values: the priors' centres and widths, and their bounds where nothing else is known
THETA_R, THETA_R_SD, THETA_R_CAP = 0.01, 0.05, 0.05
THETA_S, THETA_S_SD, THETA_S_FLOOR, THETA_S_UPPER = 0.45, 0.15, 0.45, 0.65
ALPHA, LOG_ALPHA_SD = 0.0098, 1.0
N_LOW, N_HIGH, N_SD = 1.001, 8.0, 1.0
SIGMA_SD = 0.05
_LIMITS = ["theta_r_cap", "theta_s_floor", "theta_s_upper"]


def series_bounds(days: DataFrame, by: list[str], theta: str = "theta", upper: float = THETA_S_UPPER) -> DataFrame:
    """(by, theta_r_cap, theta_s_floor, theta_s_upper) from the least and the largest water content of each series: residual water is below what was ever measured,
    saturation above it. Where the largest leaves no room below ``upper``, that is raised."""
    ends = days.groupBy(*by).agg(F.min(theta).alias("lo"), F.max(theta).alias("hi")).where("lo is not null")
    floor = F.greatest(F.lit(0.0), F.least(F.col("hi"), F.lit(0.99)))
    room = F.when(floor >= upper - 1e-3, F.least(F.lit(0.99), floor + 0.02)).otherwise(F.lit(upper))
    return ends.select(*by, F.greatest(F.lit(1e-6), F.col("lo") - 1e-5).alias("theta_r_cap"), floor.alias("theta_s_floor"), room.alias("theta_s_upper"))


def log_density(u: np.ndarray, psi: np.ndarray, theta: np.ndarray, seen: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Of points ``u`` (keys, chains, 5: theta_r, theta_s, log alpha, n - 1, log sigma), up to a constant of each key; -inf outside the bounds (keys, 3)."""
    chains = u.shape[1]
    return _density(psi, theta, seen, limits, chains)(np.ascontiguousarray(u.reshape(-1, 5).T)).reshape(u.shape[:2])


def _density(psi: np.ndarray, theta: np.ndarray, seen: np.ndarray, limits: np.ndarray, chains: int):
    """``log_density`` of points (5, keys x chains): points of the curves come first and all chains last, and only what lies within the bounds is computed."""
    wide = lambda x: np.repeat(x, chains, axis=0)
    log_psi, theta, there = (np.ascontiguousarray(wide(x).T) for x in (np.log(np.maximum(psi, 1e-9)), theta, seen.astype(float)))
    whole, alike = bool(seen.all()), bool((log_psi == log_psi[:, :1]).all())
    more = wide(seen.sum(axis=1)).astype(float) - 1
    cap, floor, upper = (np.ascontiguousarray(wide(limits[:, k])) for k in range(3))
    low = np.array([0.0, -np.inf, -np.inf, np.nextafter(N_LOW - 1, 2), np.nextafter(-20, 0)])[:, None]
    low = np.repeat(low, len(cap), axis=1)
    low[1] = floor
    high = np.stack([cap, upper, np.full(len(cap), np.inf), np.full(len(cap), np.nextafter(N_HIGH - 1, 0)), np.full(len(cap), np.nextafter(2, 0))])
    centre, width = np.array([[THETA_R], [THETA_S], [np.log(ALPHA)], [0.0]]), np.array([[THETA_R_SD], [THETA_S_SD], [LOG_ALPHA_SD], [N_SD]])
    square = lambda x: np.einsum("pc,pc->c", x, x)

    def density(u: np.ndarray) -> np.ndarray:
        out = np.full(u.shape[1], -np.inf)
        inside = u >= low
        inside &= u <= high
        inside[2] = u[1] >= u[0] + 1e-6  # alpha has no bounds
        at = np.flatnonzero(np.logical_and.reduce(inside, axis=0))
        of = lambda x: x.take(at, axis=-1, mode="clip")
        v = of(u)
        tr, ts, la, m, s = v
        n = 1 + m
        x = (log_psi[:, :1] if alike else of(log_psi)) + np.clip(la, -40, 10)
        x *= n
        np.exp(x, out=x)  # at most some exp(180)
        x += 1
        np.log(x, out=x)
        x *= 1 / n - 1
        np.exp(x, out=x)
        x *= ts - tr
        x += tr
        x -= of(theta)
        if not whole:
            x *= of(there)
        sigma = np.exp(s)
        prior = v[:4] - centre
        prior /= width
        fit = square(x)
        fit /= sigma * sigma
        fit += square(prior)
        sigma /= SIGMA_SD
        fit += sigma * sigma
        out[at] = -0.5 * fit - of(more) * s
        return out

    return density


def sampled(psi: np.ndarray, theta: np.ndarray, seen: np.ndarray, limits: np.ndarray, seeds: list[int], draws: int, tune: int, chains: int = CHAINS) -> np.ndarray:
    """Draws (keys, chains, draws, 5) of adaptive random walks; the steps of all chains of a key follow what they have seen together while they are tuned.

    Each key's random numbers come from its own seed, so what it gets does not depend on the keys beside it. Of the steps before the draws only sums of each ``HALF`` are kept.
    """
    keys = len(seeds)
    z = np.empty((keys, tune + draws, chains, 5), dtype=np.float32)
    e = np.empty((keys, tune + draws, chains))
    first = np.empty((keys, chains, 5))
    for k, seed in enumerate(seeds):
        rng = np.random.default_rng(seed)
        rng.standard_normal(out=z[k], dtype=np.float32)
        rng.random(out=e[k])
        first[k] = rng.random((chains, 5))
    cap, floor, upper = (limits[:, None, k] for k in range(3))
    top = np.where(seen, theta, -np.inf).max(axis=1)[:, None]
    start_r = cap * first[..., 0]
    low = np.maximum(floor, start_r + 1e-6)
    start_s = np.clip(top + 0.02 * (first[..., 1] - 0.5), low, np.maximum(low, upper))
    u = np.stack([start_r, start_s, np.log(ALPHA) + 2 * (first[..., 2] - 0.5), 0.1 + 1.5 * first[..., 3], np.log(0.02) + 2 * (first[..., 4] - 0.5)], axis=-1)
    density = _density(psi, theta, seen, limits, chains)
    origin = u.mean(axis=1)[..., None]
    u = np.ascontiguousarray(u.reshape(-1, 5).T)
    now = density(u)
    step = np.broadcast_to(np.diag([0.01, 0.01, 0.3, 0.15, 0.3]), (keys, 5, 5)).copy()
    chain = np.empty((draws, 5, keys * chains))
    last = np.empty((HALF, 5, keys * chains))
    sums: list[tuple[np.ndarray, np.ndarray]] = []  # of each HALF steps, from the origin: of the values, and of their products
    taken = np.zeros(keys * chains)
    scale = np.ones(keys)
    for i in range(tune + draws):
        if i and i <= tune and i % (2 * HALF) == 0:
            rate = taken.reshape(keys, chains).mean(axis=1) / (2 * HALF)
            taken[:] = 0
            scale = np.clip(scale * np.exp(rate - 0.3), 0.05, 5)  # about every third step is taken
            if i >= 4 * HALF:
                held = i - i // 2
                one, two = (sum(x) / (held * chains) for x in zip(*sums[i // 2 // HALF :], strict=True))
                cov = (two - one * one.transpose(0, 2, 1)) * (2.38**2 / 5) + 1e-10 * np.eye(5)
                step = np.linalg.cholesky(cov)
        if i % (2 * HALF) == 0:  # moves of all steps until the next change
            part = z[:, i : i + 2 * HALF]
            each = part.reshape(keys, -1, 5).astype(float)
            move = np.matmul(each, step.transpose(0, 2, 1) * scale[:, None, None]).reshape(part.shape)
            move = np.ascontiguousarray(move.transpose(1, 3, 0, 2)).reshape(part.shape[1], 5, -1)
            bar = np.log(np.ascontiguousarray(e[:, i : i + 2 * HALF].transpose(1, 0, 2))).reshape(part.shape[1], -1)
        at = i % (2 * HALF)
        new = u + move[at]
        p = density(new)
        yes = bar[at] < p - now
        u = np.where(yes, new, u)
        now = np.where(yes, p, now)
        taken += yes
        if i >= tune:
            chain[i - tune] = u
            continue
        last[i % HALF] = u
        if (i + 1) % HALF == 0:
            from_origin = np.ascontiguousarray(last.reshape(HALF, 5, keys, chains).transpose(2, 1, 0, 3)).reshape(keys, 5, -1) - origin
            sums.append((from_origin.sum(axis=2, keepdims=True), np.matmul(from_origin, from_origin.transpose(0, 2, 1))))
    return chain.reshape(draws, 5, keys, chains).transpose(2, 3, 0, 1)


def r_hat(x: np.ndarray) -> np.ndarray:
    """Of draws (..., chains, draws) the ratio of the spread over all halves of chains to that within them; 1 where all agree."""
    half = x.shape[-1] // 2
    parts = np.concatenate([x[..., :half], x[..., -half:]], axis=-2)
    within, between = parts.var(axis=-1, ddof=1).mean(axis=-1), parts.mean(axis=-1).var(axis=-1, ddof=1)
    return np.sqrt(((half - 1) / half * within + between) / np.maximum(within, 1e-300))


def effective(x: np.ndarray, lags: int | None = None) -> np.ndarray:
    """Effective sample sizes of draws (..., chains, draws): autocorrelations added up in pairs to the first pair below 0, which is looked for in the first eighth of the lags and, where it is not
    there, in all."""
    c, n = x.shape[-2:]
    lags = lags or max(n // 8, 2)
    centred = x - x.mean(axis=-1, keepdims=True)
    f = np.fft.rfft(centred, n=n + lags, axis=-1)
    cov = np.fft.irfft((f.real**2 + f.imag**2).mean(axis=-2), n=n + lags, axis=-1)[..., :lags] / n  # mean over the chains
    within = cov[..., 0] * n / (n - 1)
    spread = within * (n - 1) / n + (x.mean(axis=-1).var(axis=-1, ddof=1) if c > 1 else 0.0)
    rho = 1 - (within[..., None] - cov) / np.maximum(spread, 1e-300)[..., None]
    rho[..., 0] = 1.0
    pairs = rho[..., 0 : lags - lags % 2 : 2] + rho[..., 1 : lags - lags % 2 + 1 : 2]
    on = np.cumprod(pairs > 0, axis=-1) > 0
    out = np.asarray(np.minimum(c * n / np.maximum(2 * np.where(on, pairs, 0.0).sum(axis=-1) - 1, 1e-3), c * n * np.log10(c * n)))
    more = on[..., -1]
    if lags < n and more.any():
        out[more] = effective(x[more], n)
    return out


def summary(draws: np.ndarray) -> dict[str, np.ndarray]:
    """mean, q025, q975, r_hat and ess (keys, parameters) of draws (keys, chains, draws, 5), of alpha and n themselves."""
    values = np.ascontiguousarray(draws[..., : len(NAMES)].transpose(0, 3, 1, 2))
    np.exp(values[:, 2], out=values[:, 2])
    values[:, 3] += 1
    flat = np.sort(values.reshape(*values.shape[:2], -1), axis=-1)
    at = np.array([0.025, 0.975]) * (flat.shape[-1] - 1)
    below = flat[..., np.floor(at).astype(int)]
    low, high = np.moveaxis(below + (flat[..., np.ceil(at).astype(int)] - below) * (at % 1), -1, 0)
    return {"mean": flat.mean(axis=-1), "q025": low, "q975": high, "r_hat": r_hat(values), "ess": effective(values)}


def posterior(obs: DataFrame, by: list[str], draws: int = 2000, tune: int = 1000, seed: int = 42, psi: str = "suction_cm", theta: str = "theta", bounds: DataFrame | None = None, chains: int = CHAINS) -> DataFrame:
    """(by, param, mean, q025, q975, n_obs, r_hat, ess) of each key of four known observations or more.

    Priors: theta_r normal(0.01, 0.05) in 0 to its cap, theta_s normal(0.45, 0.15) in its floor (above theta_r) to its upper bound, log alpha normal(log 0.0098, 1), n normal(1, 1) in
    1.001 to 8, sigma half-normal(0.05). ``bounds`` are those of ``series_bounds``; a key that they lack has 0.05, 0.45 and 0.65. A key is one profile at one depth, tens of points; ``BATCH``
    keys of a task are sampled together.
    """
    rows = gathered(obs, by, psi, theta)
    rows = rows.join(bounds.select(*by, *_LIMITS), by, "left") if bounds is not None else rows.withColumns({c: F.lit(None).cast("double") for c in _LIMITS})
    known = {"theta_r_cap": THETA_R_CAP, "theta_s_floor": THETA_S_FLOOR, "theta_s_upper": THETA_S_UPPER}
    rows = spread(rows, by).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in known.items()}).withColumn("__name", F.concat_ws("\x1f", *[F.col(c).cast("string") for c in by]))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in obs.select(*by).schema.fields)

    def run(batches):
        for batch in batches:
            points = [(x[ok], y[ok]) for x, y in zip(batch["__x"], batch["__y"], strict=True) for ok in [np.isfinite(x) & np.isfinite(y) & (x >= 0)]]
            able = np.flatnonzero([len(x) >= LEAST_POINTS for x, _ in points])
            for at in range(0, len(able), BATCH):
                part = able[at : at + BATCH]
                width = max(len(points[k][0]) for k in part)
                pad = lambda j, fill: np.stack([np.append(points[k][j], np.full(width - len(points[k][j]), fill)) for k in part])  # noqa: B023, E731
                count = np.array([len(points[k][0]) for k in part])
                seen = np.arange(width)[None, :] < count[:, None]
                table = batch.iloc[part]
                seeds = [zlib.crc32(f"{seed}\x1f{name}".encode()) for name in table["__name"]]
                got = sampled(pad(0, 1.0), pad(1, 0.0), seen, table[_LIMITS].to_numpy(dtype=float), seeds, draws, tune, chains)
                told = [summary(got[k : k + FEW]) for k in range(0, len(part), FEW)]
                told = {c: np.concatenate([one[c] for one in told]) for c in told[0]}
                for k, name in enumerate(NAMES):
                    one = table[by].assign(param=name, **{c: v[:, k] for c, v in told.items()})
                    yield one.assign(n_obs=count)[[*by, "param", "mean", "q025", "q975", "n_obs", "r_hat", "ess"]]

    return rows.mapInPandas(run, keys + ", param string, mean double, q025 double, q975 double, n_obs int, r_hat double, ess double")
