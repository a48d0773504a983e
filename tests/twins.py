"""Plain loops over one series, against which the anomaly operators are held."""

import math
from collections import Counter

import numpy as np

LEVELS = ((0.5, 5.0), (1.0, 6.0), (1.5, 8.0), (2.5, 10.0))


def deviation(x, m, kind="allan"):
    """The deviation at ``m`` points, None without a difference."""
    x = np.asarray(x, float)
    if kind == "hadamard":
        d, scale = np.array([x[i + 3 * m] - 3 * x[i + 2 * m] + 3 * x[i + m] - x[i] for i in range(len(x) - 3 * m)]), 6.0 * m * m
    else:
        d, scale = np.array([x[i + 2 * m] - 2 * x[i + m] + x[i] for i in range(len(x) - 2 * m)]), 2.0 * m * m
    if kind == "mod_allan" and len(d):
        d = np.convolve(d, np.ones(m), "valid") / m
    return math.sqrt((d * d).sum() / (scale * len(d))) if len(d) else None


def deviations(x):
    out, m = {}, 1
    while 3 * m <= len(x):
        out[m] = deviation(x, m)
        m = max(m + 1, int(1.5 * m))
    return out


def noise_and_tau(devs):
    t, d = list(devs), list(devs.values())
    pts = [(math.log(a), math.log(b)) for a, b in zip(t, d) if b > 0]
    noise = "Unknown"
    if len(t) >= 3 and len(pts) >= 2:
        slope = np.polyfit(*np.array(pts).T, 1)[0]
        noise = next((name for name, top in (("WhitePhase", -0.75), ("FlickerPhase", -0.25), ("FlickerFrequency", 0.25), ("RandomWalk", 0.75)) if slope < top), "FlickerWalk")
    lows = [(min(((d[i - 1] + d[i + 1]) / 2 - d[i]) / np.mean(d), 1.0), -t[i]) for i in range(1, len(t) - 1) if d[i] < d[i - 1] and d[i] < d[i + 1]]
    return noise, -max(lows)[1] if lows else {"WhitePhase": 15, "FlickerPhase": 15, "RandomWalk": 60, "FlickerWalk": 60}.get(noise, 30)


def smooth(v, w):
    n, h = len(v), w // 2
    if w <= 2 or n < 2 * w:
        return list(map(float, v))
    pick = lambda i: v[:w] if i < h else v[n - w :] if i + h >= n else v[i - h : i + h + 1]
    return [float(np.mean(pick(i))) for i in range(n)]


def cliffs(v):
    """{idx: (kind, magnitude)}."""
    mean, sd, n, out = np.mean(v), np.std(v), len(v), {}
    cv = sd / abs(mean) if mean else 0
    s, p = (5, 0.5) if cv > 0.4 else (4, 0.35) if cv > 0.25 else (3, 0.25)
    for i in range(1, n):
        d = abs(v[i] - v[i - 1])
        if (d > s * sd or mean and d / abs(mean) > p) and (i == n - 1 or abs(v[i + 1] - v[i]) < d / 2):
            out[i] = ("step", d)
    for i in range(2, n - 2):
        d = abs((v[i + 1] + v[i + 2]) / 2 - (v[i - 2] + v[i - 1]) / 2)
        if d > 1.5 * s * sd and not {i - 1, i, i + 1} & out.keys():
            out[i] = ("level", d)
    return out


def cusum(v, k, h):
    mean, sd, sums, out = np.mean(v), np.std(v), [0.0, 0.0], []
    for i, x in enumerate(v):
        for side, sign in enumerate((1, -1)):
            sums[side] = max(0.0, sums[side] + sign * (x - mean) - k * sd)
            if sums[side] > h * sd:
                out.append((i, ("up", "down")[side]))
                sums[side] = 0.0
    return out


def dev_at(devs, at):
    pts = [(m, d) for m, d in devs.items() if d > 0]
    return float(np.exp(np.interp(math.log(at), [math.log(m) for m, _ in pts], [math.log(d) for _, d in pts]))) if pts else 0.0


def changes(v, tau, devs, step=1.0):
    """{idx: confidence}."""
    n, out = len(v), {}
    if n < 60:
        return out
    span = min(max(2 * tau * step, 30), 120) / step
    w = min(max(int(span + 0.5), 10), n // 4)
    dev = dev_at(devs, span)
    for i in range(w, n, w // 2):
        a, b = np.array(v[i - w : i]), np.array(v[i : i + w])
        if len(b) < w // 2:
            break
        d, se = abs(b.mean() - a.mean()), math.sqrt((a.var() + b.var()) / 2) * math.sqrt(1 / len(a) + 1 / len(b))
        t, sig, pct = d / se if se > 0 else 0, d / dev if dev > 0 else 0, d / abs(a.mean()) if a.mean() else 0
        conf = 0.5 * min(sig / 10, 1) + 0.3 * min(t / 10, 1) + 0.2 * min(2 * pct, 1)
        if t > 3 and sig > 2 and pct > 0.1 and conf > 0.4 and all(i - j >= w for j in out):
            out[i] = conf
    return out


def transitions(v, kind):
    """{idx: (ratio, confidence)}."""
    n, out, last = len(v), {}, None
    w = max(n // 4, 50)
    for start in range(0, n - w + 1 if n >= 100 else 0, w // 2):
        now = deviation(v[start : start + w], max(w // 10, 2), kind)
        if last:
            r = now / last
            if r < 0.5 or r > 2:
                out[start] = (r, 0.8 if r < 0.33 or r > 3 else 0.7)
        last = now
    return out


def anomalies(v):
    """{idx: (type, confidence, severity)} of the whole detection at one second a step."""
    n, devs = len(v), deviations(v)
    noise, tau = noise_and_tau(devs)
    s = smooth(v, tau)
    med = np.median(s)
    mad = np.median(np.abs(np.array(s) - med))
    m = {"WhitePhase": 4, "FlickerPhase": 4, "RandomWalk": 6.5, "FlickerWalk": 6.5}.get(noise, 5)
    outliers = {i for i, x in enumerate(s) if abs(x - med) > m * 1.4826 * mad}
    cl, levels, score = cliffs(v), [cusum(v, k, h) for k, h in LEVELS], Counter()
    alarms, shifts = {i for found in levels for i, _ in found}, levels[1]

    def add(i, own, near, reach):
        score[i] += own
        for o in range(1, reach + 1):
            score[i - o] += near
            score[i + o] += near

    for i in outliers:
        add(i, 1.0, 0, 0)
    for i, c in changes(v, tau, devs).items():
        add(i, 4 * c, 1.2 * c, 5)
    for i in cl:
        add(i, 3.0, 0.8, 1)
    for i, _ in shifts:
        add(i, 2.0, 0, 0)
    for i in alarms - cl.keys() - {i for i, _ in shifts}:
        add(i, 0.5, 0, 0)
    for kind, base, big in (("allan", 3.5, 1.0), ("hadamard", 3.0, 0.8), ("mod_allan", 3.2, 0.9)):
        for i, (r, c) in transitions(v, kind).items():
            own = base * c + (big if r > 3 or r < 0.33 else big / 2)
            add(i, own, own * 0.2, 10)
    out = {}
    for i, x in score.items():
        if not 0 <= i < n or not x:
            continue
        far = abs(s[i] - med) / mad if mad > 0 else 0
        one = 0.8 if far > 10 else 0.7 if far > 7 else 0.6 if far > 5 else 0.4
        c = next((c for least, c in ((3, 0.95), (2.5, 0.9), (2, 0.85), (1.5, 0.7), (1, one)) if x >= least), 0.3)
        if c >= 0.7 or far > 7 and x >= 1.5:
            kind = "Combined" if i in outliers & alarms else "PointOutlier" if i in outliers else "LevelShift" if i in {j for j, _ in shifts} else "TrendChange"
            out[i] = (kind, c, "Critical" if c >= 0.95 and far > 10 else "High" if c >= 0.9 or c >= 0.85 and far > 7 else "Medium" if c >= 0.8 or far > 7 else "Low")
    return out
