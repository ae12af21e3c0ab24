"""The index and run theory in plain loops, straight from their definitions."""

from statistics import NormalDist


def index(pool, part, scale=3):
    ref = pool + part
    if not all(v is not None and v >= 0 for v in ref):
        return None
    sums = lambda x: [sum_in_order(x[i : i + scale]) for i in range(len(x) - scale + 1)]
    y_ref, y = sums(ref), sums(part)
    z = [None] * (scale - 1) + [None] * len(y)
    for k in range(12):
        own = y_ref[k::12]
        for i in range(k, len(y), 12):
            p = (sum(v <= y[i] for v in own) - 0.44) / (len(own) + 0.12)
            z[i + scale - 1] = NormalDist().inv_cdf(p)
    return z


def sum_in_order(values):
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total


def labels(mask):
    out, n = [], 0
    for i, m in enumerate(mask):
        if m and (not i or not mask[i - 1]):
            n += 1
        out.append(n if m else 0)
    return out, n


def run_theory(z):
    """(d, m, pi, ddd, drd) of each event."""
    s = [float("nan") if v is None else v for v in z]
    lab, n = labels([0 <= v <= 1 for v in s])
    for e in range(1, n + 1):
        at = [i for i, x in enumerate(lab) if x == e]
        if len(at) < 6:
            for i in at:
                s[i] = -0.000001
    lab, n = labels([v < 0 for v in s])
    for e in range(1, n + 1):
        at = [i for i, x in enumerate(lab) if x == e]
        if min(s[i] for i in at) > -1:
            for i in at:
                s[i] = 0.000001
    lab, n = labels([v < 0 for v in s])
    found = []
    for e in range(1, n + 1):
        own = [s[i] for i, x in enumerate(lab) if x == e]
        d, m = len(own), sum(abs(v) for v in own)
        first = own.index(min(own)) + 1
        found.append((d, m, m / d, first, d - first))
    return found


def metrics(pool, part):
    """Means over events, or None where the cell is left out."""
    if pool[0] is None or sum(v or 0 for v in pool) == 0 and None not in pool:
        return None
    z = index(pool, part)
    if z is None or not min(v for v in z if v is not None) < -1:
        return None
    found = run_theory(z)
    return tuple(sum(e[i] for e in found) / len(found) for i in range(5))
