"""Conditional least squares of ARIMA models with moving-average terms, all symbols at once.

Gauss-Newton from a start such as the Hannan-Rissanen estimate. The residuals
``e`` of a trial obey ``theta(B) e = z - c - phi z``, and so do their derivatives
by every coefficient with another right side, so one filter by ``1 / theta(B)``
gives all columns of the normal equations. Its response is summed until it has
died away; a chunk of a long symbol therefore needs only ``WARM`` rows of the
chunk before it, and a symbol is filtered in many tasks. Per round each chunk
sends one small moment matrix, which is summed per symbol and solved there; a
trial that does not lower the sum of squares is drawn back towards the best
one. The result is never worse than the start.

A start whose moving-average part has a root beyond ``MAX_ROOT`` dies away too
slowly for the warm-up and is left as it is; so is one without such a part, as
least squares are exact there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tickforge.operators import sequence as seq
from tickforge.operators.moments import matrix, solve
from tickforge.session import cut_lineage

#: 0.985^2048 is 4e-14.
WARM, MAX_ROOT, MAX_PHI_ROOT = 2048, 0.985, 0.999
ROUNDS, CHUNK, GAIN = 8, 1 << 17, 1e-9


def largest_root(coef) -> float:
    """Largest modulus of the roots of x^n + c1 x^(n-1) + ... + cn; below one, a
    recurrence with these coefficients dies away."""
    coef = np.asarray(coef, float)
    return float(np.abs(np.roots(np.concatenate([[1.0], coef]))).max()) if coef.any() else 0.0


def response(theta, n: int) -> np.ndarray:
    """The first weights of 1 / theta(B), at most ``n``, until they have died away."""
    out, q = [1.0], len(theta)
    while len(out) < n and max(abs(v) for v in out[-q:]) > 1e-17:
        out.append(-sum(t * out[-j] for j, t in enumerate(theta, 1) if j <= len(out)))
    return np.asarray(out)


def _filter(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Every row of x filtered by the weights, from a start of zeros."""
    n = x.shape[1]
    size = 1 << (n + len(weights) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(weights, size), size)[:, :n]


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[k:] = x[:len(x) - k]
    return out


def residuals(z: np.ndarray, c: float, phi, theta) -> tuple[np.ndarray, np.ndarray]:
    """Residuals from zero before the first full set of lags, and as rows the filtered
    regressors: minus the derivatives by c, phi and theta."""
    p = len(phi)
    known = np.ones(len(z))
    known[:p] = 0.0
    weights = response(theta, len(z))
    z_lags = [_lagged(z, i) * known for i in range(1, p + 1)]
    u = (z - c) * known - sum((f * x for f, x in zip(phi, z_lags, strict=True)), np.zeros(len(z)))
    e = _filter(u[None, :], weights)[0]
    return e, _filter(np.stack([known, *z_lags, *[_lagged(e, j) for j in range(1, len(theta) + 1)]]), weights)


def _parts(trial, p: int, q: int, max_p: int) -> tuple[float, np.ndarray, np.ndarray]:
    trial = np.asarray(trial, float)
    return float(trial[0]), trial[1:1 + p], trial[1 + max_p:1 + max_p + q]


_STATE = "_k string, p int, q int, trial array<double>, best array<double>, ssr double, n long, done boolean"


def refine(bars: DataFrame, start: DataFrame, max_p: int, max_q: int, rounds: int = ROUNDS, chunk_rows: int = CHUNK) -> DataFrame:
    """(_k, c, phi, theta, sigma2, aic, bic, last_e, rmse, mae, mape) of the refined models.

    ``bars``: ``_k`` (never null), position, ``_z`` (never null), ``close`` and ``_in``,
    which marks the rows whose squares are summed. ``start``: ``_k``, p, q, c, phi, theta.
    """
    width = 1 + max_p + max_q
    columns = [f.strip().split()[0] for f in _STATE.split(",")]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.q > 0 and largest_root(r.theta) <= MAX_ROOT:
                    trial = np.zeros(width)
                    trial[0], trial[1:1 + r.p], trial[1 + max_p:1 + max_p + r.q] = r.c, r.phi, r.theta
                    out.append((r.k, r.p, r.q, trial.tolist(), None, None, None, False))
            yield pd.DataFrame(out, columns=columns)

    def moments(z: pd.DataFrame, trial: pd.DataFrame) -> pd.DataFrame:
        if z.empty or trial.empty:
            return pd.DataFrame(columns=["_k", "m", "n"])
        z, r = z.sort_values(seq.RN), trial.iloc[0]
        e, g = residuals(z["_z"].to_numpy(), *_parts(r["trial"], r["p"], r["q"], max_p))
        mine = (z["_in"] & ~z[seq.HALO]).to_numpy()
        rows = np.zeros((width + 1, int(mine.sum())))
        rows[[0, *range(1, 1 + r["p"]), *range(1 + max_p, 1 + max_p + r["q"])]] = g[:, mine]
        rows[-1] = e[mine]
        m = rows @ rows.T
        return pd.DataFrame({"_k": [r["_k"]], "m": [m[np.triu_indices(width + 1)].tolist()], "n": [rows.shape[1]]})

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, p, q, trial, best, ssr, n, done, m, rows in batch[[*columns, "m", "rows"]].itertuples(index=False):
                if done or m is None:
                    out.append((k, p, q, trial, best, ssr, n, True))
                    continue
                use = [0, *range(1, 1 + p), *range(1 + max_p, 1 + max_p + q)]
                a, trial = matrix(m, width + 1), np.asarray(trial, float)
                first = best is None
                if not math.isfinite(a[-1, -1]) or not first and a[-1, -1] >= ssr:
                    if first:
                        out.append((k, p, q, trial, None, None, None, True))
                        continue
                    best = np.asarray(best, float)
                    trial = best + (trial - best) / 4
                    done = bool(np.abs(trial - best).max() < 1e-9)
                else:
                    done = not first and 1 - a[-1, -1] / ssr < GAIN
                    best, ssr, n = trial, float(a[-1, -1]), int(rows)
                    delta = solve(a[np.ix_(use, use)], a[use, -1])
                    done = done or delta is None
                    if not done:
                        move = np.zeros(width)
                        move[use] = delta
                        for _ in range(40):
                            trial = best + move
                            _, phi, theta = _parts(trial, p, q, max_p)
                            if largest_root(-phi) < MAX_PHI_ROOT and largest_root(theta) <= MAX_ROOT:
                                break
                            move /= 2
                        else:
                            done = True
                out.append((k, p, q, trial.tolist(), best.tolist(), ssr, n, done))
            yield pd.DataFrame(out, columns=columns)

    def final(z: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        names = ["_k", "at", "last_e", "rows", "squares", "abs", "share", "shares"]
        if z.empty or best.empty:
            return pd.DataFrame(columns=names)
        z, r = z.sort_values(seq.RN), best.iloc[0]
        e, _ = residuals(z["_z"].to_numpy(), *_parts(r["best"], r["p"], r["q"], max_p))
        mine = (z["_in"] & ~z[seq.HALO]).to_numpy()
        own, close = e[mine], z["close"].to_numpy()[mine]
        share = np.abs(own[close != 0] / close[close != 0])
        last = np.concatenate([e[::-1][:max_q], np.zeros(max(0, max_q - len(e)))])
        return pd.DataFrame([(r["_k"], int(z[seq.RN].iloc[-1]), last.tolist(), len(own), float(own @ own),
                              float(np.abs(own).sum()), float(share.sum()), len(share))], columns=names)

    state = cut_lineage(start.select(F.col("_k").alias("k"), "p", "q", "c", "phi", "theta").mapInPandas(begin, _STATE))
    parts = bars.join(state.select("_k"), "_k", "left_semi")
    parts = cut_lineage(seq.chunked(parts, "_k", seq.RN, back=WARM, chunk_rows=chunk_rows, positioned=True))
    chunks = cut_lineage(parts.select("_k", seq.CK).distinct())
    by_chunk = parts.groupBy("_k", seq.CK)
    size = (width + 1) * (width + 2) // 2
    for _ in range(rounds):
        open_ = state.where("not done")
        if open_.isEmpty():
            break
        tries = chunks.join(open_.select("_k", "p", "q", "trial"), "_k").groupBy("_k", seq.CK)
        sums = by_chunk.cogroup(tries).applyInPandas(moments, "_k string, m array<double>, n long").groupBy("_k").agg(
            F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m"), F.sum("n").alias("rows"))
        state = cut_lineage(state.join(sums, "_k", "left").mapInPandas(step, _STATE))
    done = state.where("best is not null")
    ends = by_chunk.cogroup(chunks.join(done.select("_k", "p", "q", "best"), "_k").groupBy("_k", seq.CK)).applyInPandas(
        final, "_k string, at long, last_e array<double>, rows long, squares double, abs double, share double, shares long")
    ends = ends.groupBy("_k").agg(
        F.max_by("last_e", "at").alias("last_e"), F.sqrt(F.sum("squares") / F.sum("rows")).alias("rmse"),
        (F.sum("abs") / F.sum("rows")).alias("mae"), (F.try_divide(F.sum("share"), F.sum("shares")) * 100).alias("mape"))
    k = F.col("p") + F.col("q") + 2
    fit = F.col("n") * F.log(F.col("ssr") / F.col("n"))
    return done.where("ssr > 0").join(ends, "_k").select(
        "_k", F.col("best")[0].alias("c"), F.slice("best", F.lit(2), F.col("p")).alias("phi"),
        F.slice("best", F.lit(2 + max_p), F.col("q")).alias("theta"), (F.col("ssr") / (F.col("n") - k + 1)).alias("sigma2"),
        (fit + 2 * k).alias("aic"), (fit + k * F.log("n")).alias("bic"), "last_e", "rmse", "mae", "mape")
