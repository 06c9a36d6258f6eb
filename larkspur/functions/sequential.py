"""Kernels of algorithms that walk a series in order: arrays in, a dict of arrays or values out.

They are plain NumPy functions; ``plans.by_series`` and ``plans.summarised`` run them on
each series of a table.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable

import numpy as np

NAN = float("nan")


def decay_of(kind: str, value: float) -> float:
    return {"center_of_gravity": 1 / (1 + value), "span": 2 / (value + 1), "halflife": 1 - math.exp(-math.log(2) / value), "fixed": value}[kind]


def ewm(x: np.ndarray, alpha: float, finite: bool = False) -> np.ndarray:
    """Exponentially weighted mean; ``finite`` divides by the sum of the weights so far.

    Rows before the first number are 0. If there are any, the finite form counts the weight
    of the first number but not its value. A later row that is no number ends the series.
    """
    x = np.asarray(x, float)
    out, known = np.zeros(len(x)), np.flatnonzero(x == x)
    if not len(known):
        return out
    start, keep = int(known[0]), 1 - alpha
    out[start] = value = x[start]
    total, weight = (x[start] if start == 0 else 0.0), 1.0
    for i in range(start + 1, len(x)):
        if finite:
            total, weight = total * keep + x[i], weight * keep + 1
            out[i] = total / weight
        else:
            out[i] = value = alpha * x[i] + keep * value
    return out


def span(x: np.ndarray, n: float) -> np.ndarray:
    """The finite form by span."""
    return ewm(x, decay_of("span", n), True)


def plain_span(x: np.ndarray, n: float) -> np.ndarray:
    return ewm(x, decay_of("span", n))


def rolled(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, n: int) -> np.ndarray:
    """f over axis 1 of every window of the last n values."""
    x = np.asarray(x, float)
    out = np.full(len(x), NAN)
    if len(x) >= n:
        out[n - 1 :] = f(np.lib.stride_tricks.sliding_window_view(x, n))
    return out


def mean(x, n):
    return rolled(lambda w: w.mean(1), x, n)


def before(x: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.full(len(x), NAN)
    out[n:] = np.asarray(x, float)[: len(x) - n]
    return out


def ewm_mean(x, kind="span", value=10.0, finite=False):
    return {"ewm": ewm(x, decay_of(kind, value), finite)}


def ewm_cov(x, y, kind="span", value=10.0):
    """Bias-corrected exponentially weighted covariance and correlation, by recurrence; the first is not a number."""
    a = decay_of(kind, value)
    cov, cor = np.full(len(x), NAN), np.full(len(x), NAN)
    s = s2 = mx = my = cxx = cyy = cxy = 0.0
    for i, (u, v) in enumerate(zip(np.asarray(x, float), np.asarray(y, float))):
        d, q = 1 - a, (1 - a) ** 2
        old, s, s2 = s * d, s * d + 1, s2 * q + 1
        nx, ny = (mx * old + u) / s, (my * old + v) / s
        cxx, cyy, cxy = cxx * d + (u - mx) * (u - nx), cyy * d + (v - my) * (v - ny), cxy * d + (u - mx) * (v - ny)
        mx, my = nx, ny
        if i:
            cov[i] = cxy / s * (s * s / (s * s - s2))
            cor[i] = cxy / math.sqrt(cxx * cyy) if cxx > 0 and cyy > 0 else NAN
    return {"cov": cov, "corr": cor}


def ewm_var(x, kind="span", value=10.0):
    v = ewm_cov(x, x, kind, value)["cov"]
    return {"var": v, "std": np.sqrt(v)}


def zero_lag_mean(x, n=10):
    x, out = np.asarray(x, float), np.full(len(x), NAN)
    first = int(np.argmax(x == x)) + (n - 1) // 2
    out[first:] = span((2 * x - before(x, (n - 1) // 2))[first:], n)
    return {"zlmm": out}


def partial_autocorrelation(x, max_lag=10):
    """For each k the weight of the nearest of k neighbours in the least-squares fit of a row by these, without a constant."""
    x, out = np.asarray(x, float), [1.0]
    for k in range(1, max_lag):
        neighbours = np.lib.stride_tricks.sliding_window_view(x, k)[:-1]
        out.append(float(np.linalg.solve(neighbours.T @ neighbours, neighbours.T @ x[k:])[-1]))
    return {"pacf": out}


def fixed_autocorrelation(x, lag, blocks=False):
    """Correlation of ``lag`` rows with the ``lag`` rows behind them, for each row that begins such a pair (or each block).

    Towards the end both parts shrink to what is left; one row alone has no correlation.
    """
    x, n = np.asarray(x, float), len(x)
    out = np.full(n, NAN)
    for row, begin in enumerate(range(0, n - n % lag, lag) if blocks else range(n - lag)):
        middle = begin + lag
        if middle >= n:
            break
        size = min(lag, n - middle)
        a, b = x[middle - size : middle], x[middle : middle + size]
        if size > 1 and a.std() > 0 and b.std() > 0:
            out[row] = np.corrcoef(a, b)[0, 1]
    return {"facf": out}


def max_sub_array(x, low=-np.inf, high=np.inf, smallest=False):
    """Kadane's largest (least) sum of a run of rows; values beyond the bounds are passed over, and the end is exclusive."""
    found = _sub_arrays(x, low, high, smallest)
    best = found[-1] if found else (0.0, 0, 0)
    return {"sum": best[0], "begin": best[1], "end": best[2]}


def _sub_arrays(x, low, high, smallest):
    """Each record of the best sum so far, with its run."""
    sign, best, now, begin, out = -1.0 if smallest else 1.0, -np.inf, -np.inf, 0, []
    for i, v in enumerate(np.asarray(x, float)):
        if not low <= v <= high:
            continue
        if now + sign * v < sign * v:
            begin, now = i, sign * v
        else:
            now = now + sign * v if now > -np.inf else sign * v
        if now > best:
            best = now
            out.append((sign * now, begin, i + 1))
    return out


def n_max_sub_arrays(x, n=5, low=-np.inf, high=np.inf, smallest=False):
    """The n best of the records that the search for the best run passes through, best first."""
    best = sorted(_sub_arrays(x, low, high, smallest), key=lambda r: r[0], reverse=not smallest)[:n]
    return {"sums": [r[0] for r in best], "begins": [r[1] for r in best], "ends": [r[2] for r in best]}


def inversions(x):
    """Pairs out of order, by merging."""
    x = np.asarray(x, float)

    def count(part):
        if len(part) < 2:
            return 0, part
        a, left = count(part[: len(part) // 2])
        b, right = count(part[len(part) // 2 :])
        return a + b + int((len(left) - np.searchsorted(left, right, "right")).sum()), np.sort(np.concatenate([left, right]), kind="stable")

    return {"inversions": count(x)[0]}


def kendall(x, y):
    """Pairs in agreement less pairs in conflict, over all pairs. A tie takes the sign of the other difference, as the sign of a product with 0 does."""
    x, y, total = np.asarray(x, float), np.asarray(y, float), 0.0
    for i in range(len(x)):
        total += np.copysign(1.0, (x[i] - x[i + 1 :]) * (y[i] - y[i + 1 :])).sum()
    return {"kendall": total / (len(x) * (len(x) - 1) / 2)}


def expanding(x, f=np.mean, n=3, step=1):
    """f over rows i to i + n - 1, where n grows by ``step`` at each row; leading rows are not numbers."""
    x = np.asarray(x, float)
    out, size = [NAN] * (n - 1), n
    for i in range(len(x)):
        if i + size > len(x):
            break
        out.append(float(f(x[i : i + size])))
        size += step
    return {"expanding": np.array((out + [NAN] * len(x))[: len(x)])}


# Fits, smoothing, decomposition, tests


def cubic_spline(x, y):
    """Second-order, first-order and third-order coefficients of the natural spline at each knot."""
    x, y, n = np.asarray(x, float), np.asarray(y, float), len(x)
    h = np.diff(x)
    a, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 3 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    c = np.linalg.solve(a, r)
    b = np.append(np.diff(y) / h - h * (2 * c[:-1] + c[1:]) / 3, NAN)
    return {"b": b, "c": c, "d": np.append(np.diff(c) / (3 * h), NAN)}


def lowess(y, x, loops=3, frac=2 / 3):
    """Locally weighted linear regression with bisquare weights of the residuals."""
    x, y, n = np.asarray(x, float), np.asarray(y, float), len(x)
    k = max(2, min(n, int(frac * n + 1e-10)))
    robust, fit = np.ones(n), np.zeros(n)
    for _ in range(loops + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            r = np.partition(d, k - 1)[k - 1]
            w = robust * np.clip(1 - (d / max(r, 1e-300)) ** 3, 0, 1) ** 3
            s = w.sum()
            if s <= 0:
                fit[i] = y[i]
                continue
            mx = (w * x).sum() / s
            v = (w * (x - mx) ** 2).sum()
            slope = (w * (x - mx) * y).sum() / v if v > 1e-300 else 0.0
            fit[i] = (w * y).sum() / s + slope * (x[i] - mx)
        res = np.abs(y - fit)
        m = np.median(res)
        robust = np.clip(1 - (res / max(6 * m, 1e-300)) ** 2, 0, 1) ** 2 if m > 0 else np.ones(n)
    return {"lowess": fit, "weights": robust}


def decompose(y, period=12, frac=0.3, multiplicative=False):
    y = np.asarray(y, float)
    trend = lowess(y, np.arange(len(y)), 3, frac)["lowess"]
    rest = y / trend if multiplicative else y - trend
    cycle = np.array([np.mean(rest[i::period]) for i in range(period)])
    cycle = cycle / cycle.mean() if multiplicative else cycle - cycle.mean()
    seasonal = cycle[np.arange(len(y)) % period]
    return {"trend": trend, "seasonal": seasonal, "residual": rest / seasonal if multiplicative else rest - seasonal}


#: Levels of KPSS by the critical values that a statistic is below of.
KPSS_LEVELS = ((0.347, 0.1), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def kpss(x):
    """Squares of the cumulated residuals of a linear trend, over n squared times their variance."""
    x = np.asarray(x, float)
    t = np.arange(1.0, len(x) + 1)
    e = x - np.polyval(np.polyfit(t, x, 1), t)
    stat = float((np.cumsum(e) ** 2).sum() / (len(x) ** 2 * e.var()))
    return {"statistic": stat, "level": next((level for bound, level in KPSS_LEVELS if stat < bound), 0.0)}


def augmented_dickey_fuller(x, lag=1, trend=False):
    """Autocovariance at ``lag`` over the variance, with the linear trend removed on request."""
    x = np.asarray(x, float)
    if trend:
        t = np.arange(1.0, len(x) + 1)
        x = x - np.polyval(np.polyfit(t, x, 1), t)
    d = x - x.mean()
    return {"statistic": float((d[lag:] * d[: len(d) - lag]).sum() / (len(x) - lag - 1) / x.var())}


def _normal_cdf(z):
    return 0.5 * (1 + np.vectorize(math.erf)(np.asarray(z, float) / math.sqrt(2)))


def _exp(v):
    """Infinity where the result is beyond a double, as in SQL."""
    try:
        return math.exp(v)
    except OverflowError:
        return math.inf


def anderson_darling(x):
    """The statistic and its p-value; the published fit of the latter means nothing far beyond 13, and is infinite where it overflows."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    f = np.clip(_normal_cdf((x - x.mean()) / x.std(ddof=1)), 1e-300, 1 - 1e-16)
    i = np.arange(1, n + 1)
    a = (-n - ((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1]))).sum() / n) * (1 + 4 / n - 25 / n**2)
    p = _exp(1.2937 - 5.709 * a + 0.0186 * a * a) if a > 0.6 else math.exp(0.9177 - 4.279 * a - 1.38 * a * a) if a > 0.34 else 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a) if a > 0.2 else 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a)
    return {"statistic": float(a), "p_value": float(p)}


def shapiro_wilk(x):
    """Royston's approximation, for 4 to 5000 values."""
    from statistics import NormalDist

    x = np.sort(np.asarray(x, float))
    n, nd = len(x), NormalDist()
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / math.sqrt(n), m @ m
    a = m / math.sqrt(mm)
    last = a[-1] + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
    if n > 5:
        second = a[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = second, -second
    else:
        a[1:-1] = m[1:-1] / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[-1], a[0] = last, -last
    w = min(1.0, (a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n < 12:
        g = -2.273 + 0.459 * n
        z = (-math.log(max(1e-300, g - math.log(max(1e-300, 1 - w)))) - np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)) / math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        v = math.log(n)
        z = (math.log(max(1e-300, 1 - w)) - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], v)) / math.exp(np.polyval([0.0030302, -0.082676, -0.4803], v))
    return {"statistic": float(w), "p_value": float(1 - nd.cdf(z))}


#: P-values of the Cramer-von Mises statistic by its upper bounds.
CVM_LEVELS = (
    (0.0275, 1.0), (0.051, 0.99), (0.092, 0.95), (0.126, 0.9), (0.152, 0.85), (0.195, 0.8), (0.220, 0.75), (0.275, 0.7), (0.319, 0.65), (0.347, 0.6), (0.393, 0.55), (0.429, 0.5),
)


def cramer_von_mises(x):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    f = _normal_cdf((x - x.mean()) / x.std(ddof=1))
    t = float(1 / (12 * n) + (((2 * np.arange(1, n + 1) - 1) / (2 * n) - f) ** 2).sum())
    return {"statistic": t, "p_value": next((p for bound, p in CVM_LEVELS if t < bound), float(np.finfo(float).eps))}


# Signals, anomalies, forecasts


def fft(x):
    f = np.fft.fft(np.asarray(x, float))
    return {"real": f.real, "imag": f.imag, "magnitude": np.abs(f), "angle": np.angle(f)}


def seasonal_period(x, detrend=True):
    x = np.asarray(x, float)
    if detrend:
        x = x - lowess(x, np.arange(len(x)), 1, 0.5)["lowess"]
    m = np.abs(np.fft.rfft(x - x.mean()))
    k = int(m[1:].argmax()) + 1
    return {"period": len(x) / k, "magnitude": float(m[k]), "frequency": k / len(x), "index": k}


def dynamic_time_warp(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    row = np.concatenate([[0.0], np.full(len(y), np.inf)])
    for u in x:
        cost, new = np.abs(u - y), np.full(len(y) + 1, np.inf)
        for j in range(1, len(y) + 1):
            new[j] = cost[j - 1] + min(row[j], new[j - 1], row[j - 1])
        row = new
    return {"distance": float(row[-1])}


def fft_outliers(x, n=5, threshold=1.0):
    x = np.asarray(x, float)
    f = np.fft.fft(x)
    f[n:] = 0
    return {"outlier": np.abs(x - np.fft.ifft(f).real) > threshold}


def local_outliers(x, k=5, threshold=1.5, textbook=False):
    """Mean density of the k nearest neighbours over a row's own.

    A row's reach is the larger of its distance to a neighbour and its distance to the row
    whose number is that neighbour's rank; in the textbook's form, the neighbour's own reach.
    """
    x, n = np.asarray(x, float), len(x)
    score = np.ones(n)
    if n > k + 1:
        d = np.abs(x[:, None] - x[None, :])
        near = np.argsort(d, 1, kind="stable")[:, 1 : k + 1]
        away = np.take_along_axis(d, near, 1)
        reach = np.maximum(away[near, -1], away) if textbook else np.maximum(away, d[:, :k])
        density = k / np.maximum(reach.sum(1), 1e-300)
        score = density[near].mean(1) / density
    return {"score": score, "outlier": score > threshold}


def knn_outliers(x, window=5, k=3):
    """Mean distance of each window of rows to its k nearest, averaged over the windows that hold a row."""
    x, n = np.asarray(x, float), len(x)
    if n < window + k:
        return {"score": np.full(n, NAN)}
    w = np.lib.stride_tricks.sliding_window_view(x, window)
    score = np.array([np.partition(np.sqrt(((w - own) ** 2).sum(1)), k)[: k + 1].sum() / k for own in w])
    total, many = np.zeros(n), np.zeros(n)
    for j in range(window):
        total[j : j + len(w)] += score
        many[j : j + len(w)] += 1
    return {"score": total / many}


def isolation_outliers(x, trees=100, threshold=0.6, seed=0):
    """Isolation by random cuts of one column. Rows of a node are a run of the sorted ones, so that a cut is a search in them."""
    x, rng = np.asarray(x, float), np.random.default_rng(seed)
    n = len(x)
    order = np.argsort(x, kind="stable")
    s = x[order].tolist()
    if n > 1 and s[0] != s[-1] and not math.isfinite(s[-1] - s[0]):
        raise OverflowError("values to cut must be finite")
    expected = lambda k: 2 * (math.log(max(1, k - 1)) + 0.5772156649) - 2 * (k - 1) / k if k > 1 else 0
    ends, draws, used = {}, rng.random(4096).tolist(), 0  # draws are the stream that single ones would be
    depth = np.zeros(n)
    for _ in range(trees if n else 0):
        found, sizes, todo = [], [], [(0, n, 0)]
        while todo:
            a, b, at = todo.pop()
            low, high = s[a], s[b - 1]
            if at >= 10 or b - a < 2 or low == high:
                key = at, b - a
                if key not in ends:
                    ends[key] = at + expected(b - a)
                found.append(ends[key])
                sizes.append(b - a)
                continue
            if used == len(draws):
                draws, used = rng.random(4096).tolist(), 0
            cut = bisect_left(s, low + (high - low) * draws[used], a, b)
            used += 1
            todo += [(p, q, at + 1) for p, q in ((a, cut), (cut, b)) if q > p]
        depth += np.repeat(found[::-1], sizes[::-1])  # the last rows come first
    c = 2 * (math.log(max(1, n - 1)) + 0.5772156649) - 2 * (n - 1) / max(1, n)
    score = np.empty(n)
    score[order] = 2 ** (-depth / trees / max(c, 1e-9))
    return {"score": score, "outlier": score > threshold}


def arima(x, periods=3, p=2, d=1, q=1):
    """Hannan-Rissanen estimates of phi and theta on the differenced series, and its forecasts."""
    x = np.asarray(x, float)
    y, heads = x, []
    for _ in range(d):
        heads.append(y[-1])
        y = np.diff(y)
    m = max(p, q) + 3
    long = np.stack([y[m - k - 1 : len(y) - k - 1] for k in range(m)], 1)
    e = np.concatenate([np.zeros(m), y[m:] - long @ np.linalg.lstsq(long, y[m:], rcond=None)[0]])
    a = np.stack([*[y[m - k : len(y) - k] for k in range(1, p + 1)], *[e[m - k : len(y) - k] for k in range(1, q + 1)]], 1)
    b = np.linalg.lstsq(a, y[m:], rcond=None)[0]
    res, future, errors = y[m:] - a @ b, list(y), list(e)
    for _ in range(periods):
        future.append(sum(b[k] * future[-k - 1] for k in range(p)) + sum(b[p + k] * errors[-k - 1] for k in range(q)))
        errors.append(0.0)
    out = np.array(future[-periods:])
    for h in reversed(heads):
        out = h + np.cumsum(out)
    return {"forecast": out.tolist(), "phi": b[:p].tolist(), "theta": b[p:].tolist(), "sigma_sq": float(res.var())}


def holt_winters(x, periods=3, season=0, alpha=0.25, beta=0.1, gamma=0.1, multiplicative=False):
    """Holt's method, or with a season Holt and Winters'; starting values are means of the first differences or of whole seasons."""
    x, n = np.asarray(x, float), len(x)
    if not season:
        level, trend = x[0], float(np.diff(x[: min(n, 11)]).mean())
        fitted = [level]
        for v in x[1:]:
            fitted.append(level + trend)
            old, level = level, alpha * v + (1 - alpha) * (level + trend)
            trend = beta * (level - old) + (1 - beta) * trend
        return {"forecast": [level + k * trend for k in range(1, periods + 1)], "fitted": fitted}
    whole = x[: max(2, n // season) * season].reshape(-1, season)
    means = whole.mean(1)
    first = (whole / means[:, None] if multiplicative else whole - means[:, None]).mean(0)
    level, trend = means[0], (means[-1] - means[0]) / (len(means) - 1) / season
    cycle = [*first]  # what later rows write is read one season on
    fitted = [(level + trend) * first[0] if multiplicative else level + trend + first[0]]
    for t in range(1, n):
        s = cycle[t - season] if t >= season else first[t]
        fitted.append((level + trend) * s if multiplicative else level + trend + s)
        old, level = level, alpha * (x[t] / s if multiplicative else x[t] - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - old) + (1 - beta) * trend
        new = gamma * (x[t] / level if multiplicative else x[t] - level) + (1 - gamma) * s
        if t < season:
            cycle[t] = new
        else:
            cycle.append(new)
    last = cycle[n - season : n]
    out = [level + k * trend for k in range(1, periods + 1)]
    return {"forecast": [v * last[(n - 1 + k) % season] if multiplicative else v + last[(n - 1 + k) % season] for k, v in enumerate(out, 1)], "fitted": fitted}


def lstm(x, periods=3, hidden=8, window=10, epochs=20, rate=0.01, seed=0):
    """One LSTM cell with a linear output, fitted by back-propagation through ``window`` steps."""
    return lstm_many([x], periods, hidden, window, epochs, rate, seed)[0]


#: Series that are fitted side by side: enough to outweigh the calls, few enough for the cache.
SIDE_BY_SIDE = 512


def lstm_many(series, periods=3, hidden=8, window=10, epochs=20, rate=0.01, seed=0):
    """``lstm`` of each of several series, which are fitted side by side: series are the last axis of all arrays."""
    xs, forecasts = [np.asarray(x, float) for x in series], [None] * len(series)
    longest = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
    for begin in range(0, len(xs), SIDE_BY_SIDE):
        some = longest[begin : begin + SIDE_BY_SIDE]
        found = _lstm_side_by_side([xs[i] for i in some], periods, hidden, window, epochs, rate, seed)
        for i, forecast in zip(some, found):
            forecasts[i] = {"forecast": forecast}
    return forecasts


def _lstm_side_by_side(xs, periods, hidden, window, epochs, rate, seed):
    """Forecasts of series that come longest first, so that those with rows left are always the first ones."""
    many, n = len(xs), np.array([len(x) for x in xs])
    centre, scale = np.array([x.mean() for x in xs]), np.array([x.std() or 1.0 for x in xs])
    z = np.zeros((n[0] + periods, many))
    for k, x in enumerate(xs):
        z[: n[k], k] = (x - centre[k]) / scale[k]
    rng = np.random.default_rng(seed)
    w = np.repeat(rng.normal(0, 0.3, (4 * hidden, hidden + 2))[:, :, None], many, 2)
    out = np.repeat(rng.normal(0, 0.3, hidden + 1)[:, None], many, 1)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def forward(w, part):
        k = part.shape[1]
        h, c, steps = np.zeros((hidden, k)), np.zeros((hidden, k)), []
        for v in part:
            inp = np.concatenate([h, v[None], np.ones((1, k))])
            g = np.einsum("ijs,js->is", w, inp)
            (i, f, o), new = sig(g[: 3 * hidden]).reshape(3, hidden, k), np.tanh(g[3 * hidden :])
            was, c = c, f * c + i * new
            t = np.tanh(c)
            h = o * t
            steps.append((inp, i, f, o, new, was, t))
        return h, steps

    for _ in range(epochs):
        for at in range(n[0] - window):
            k = int(np.count_nonzero(n - window > at))
            mine, last = w[:, :, :k], out[:, :k]  # views: what is subtracted stays
            h, steps = forward(mine, z[at : at + window, :k])
            err = (last[:-1] * h).sum(0) + last[-1] - z[at + window, :k]
            dh, dc, grad = err * last[:-1], np.zeros((hidden, k)), np.zeros((4 * hidden, hidden + 2, k))
            last -= rate * err * np.concatenate([h, np.ones((1, k))])
            for inp, i, f, o, new, was, t in reversed(steps):
                dc = dc + dh * o * (1 - t * t)
                g = np.concatenate([dc * new * i * (1 - i), dc * was * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - new * new)])
                grad += g[:, None] * inp[None]
                dh, dc = np.einsum("ijs,is->js", mine[:, :hidden], g), dc * f
            mine -= rate * np.clip(grad, -1, 1)
    forecast = np.empty((periods, many))
    for p in range(periods):
        for tail in np.unique(np.minimum(n + p, window)):  # short series have fewer rows than the window
            which = np.flatnonzero(np.minimum(n + p, window) == tail)
            ends = n[which] + p
            h, _ = forward(w[:, :, which], np.stack([z[ends - tail + j, which] for j in range(tail)]) if tail else np.empty((0, len(which))))
            z[ends, which] = (out[:-1, which] * h).sum(0) + out[-1, which]
            forecast[p, which] = z[ends, which] * scale[which] + centre[which]
    return forecast.T.tolist()


def hurst(x, ranges=(1, 2, 4)):
    """Slope of log R/S over log size, for the series cut into each number of parts."""
    x, sizes, rs = np.asarray(x, float), [], []
    for r in ranges:
        n = len(x) // r
        parts = x[: n * r].reshape(r, n)
        c = np.cumsum(parts - parts.mean(1, keepdims=True), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = (np.maximum(c.max(1), 0) - c.min(1)) / parts.std(1, ddof=1)
        sizes.append(math.log(n))
        rs.append(math.log(found.mean()))
    return {"hurst": float(np.polyfit(sizes, rs, 1)[0]) if np.isfinite(rs).all() else NAN}


def lagrange_fill(x, index):
    """Missing values from the polynomial through all known points."""
    x, t = np.asarray(x, float).copy(), np.asarray(index, float)
    known = ~np.isnan(x)
    for i in np.flatnonzero(~known):
        x[i] = sum(x[j] * np.prod([(t[i] - t[m]) / (t[j] - t[m]) for m in np.flatnonzero(known) if m != j]) for j in np.flatnonzero(known))
    return {"filled": x}


def repaired(x, flags, index=None, policy="linear_interpolate"):
    """Flagged values from the rows next to them, left to right, so that runs build on what is repaired.

    The first and the last row have no neighbour on one side: only fill_forward repairs the
    last one and fill_backward the first one.
    """
    x, n = np.asarray(x, float).copy(), len(x)
    t = np.arange(n, dtype=float) if index is None else np.asarray(index, float)
    for i in np.flatnonzero(np.asarray(flags, bool)):
        if policy == "fill_forward":
            x[i] = x[i - 1] if i else x[i]
        elif policy == "fill_backward":
            x[i] = x[i + 1] if i + 1 < n else x[i]
        elif 0 < i < n - 1:
            share = 0.5 if policy == "mid_point" else (t[i] - t[i - 1]) / (t[i + 1] - t[i - 1])
            x[i] = x[i - 1] + share * (x[i + 1] - x[i - 1])
    return {"repaired": x}


def align_slots(index, interval, from_start=True):
    """For each row the number of the value that is put there when a coarser column is laid over the index, or -1.

    A value comes every ``interval``; where the index jumps over that point, it goes to the
    row before, from which the next interval counts. Where several values come to one row,
    ``slot`` is the last of them and ``first`` the first one.
    """
    t = np.asarray(index, float)
    out, first, ref, value, start = np.full(len(t), -1, np.int64), np.full(len(t), -1, np.int64), 0, 0, 0
    if from_start and len(t):
        out[0], first[0], value, start = 0, 0, 1, 1
    for i in range(start, len(t)):
        gap = t[i] - t[ref]
        if gap >= interval:
            ref = i if gap == interval else i - 1
            if first[ref] < 0:
                first[ref] = value
            out[ref] = value
            value += 1
    return {"slot": out, "first": first}
