"""Volume-delay functions, written once for Columns and for numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


class OnColumns:
    """The few operations that the formulas need, as Spark expressions."""

    sqrt, power = staticmethod(F.sqrt), staticmethod(F.pow)

    @staticmethod
    def where(c, a, b):
        return F.when(c, a if hasattr(a, "alias") else F.lit(a)).otherwise(b)

    @staticmethod
    def most(a, b):
        return F.greatest(a if hasattr(a, "alias") else F.lit(float(a)), b if hasattr(b, "alias") else F.lit(float(b)))

    @staticmethod
    def value(v, like):
        return F.lit(float(v))

    @staticmethod
    def least(a, b):
        return F.least(a if hasattr(a, "alias") else F.lit(float(a)), b if hasattr(b, "alias") else F.lit(float(b)))


class OnArrays:
    sqrt, power, where, most, least = staticmethod(np.sqrt), staticmethod(np.power), staticmethod(np.where), staticmethod(np.maximum), staticmethod(np.minimum)

    @staticmethod
    def value(v, like):
        return np.full(np.shape(like), float(v))


def demand_over_capacity(k, volume, lanes, hours, plf, capacity):
    """Hourly lane demand over hourly lane capacity, with the guards of the engine."""
    d = volume / k.most(0.01, lanes) / max(0.001, hours) / k.most(1e-4, plf)
    return d, d / k.most(0.1, capacity)


def bpr(k, t0, x, alpha, beta, linear=0.0):
    return t0 * (linear * x + 1 + alpha * k.power(x, beta))


def conic(k, t0, x, a, b):
    return t0 * (2 + k.sqrt(a * a * (1 - x) * (1 - x) + b * b) - a * (1 - x) - b)


def conic_b(a):
    return (2 * a - 1) / (2 * a - 2)


def bpr2(k, t0, x, alpha, beta):
    return t0 * (1 + alpha * k.power(x, k.where(x > 1, 2 * beta, beta)))


def inrets(k, t0, x, alpha):
    return k.where(x <= 1, t0 * (1.1 - alpha * x) / k.most(0.05, 1.1 - x), t0 * ((1.1 - alpha) / 0.1) * x * x)


def akcelik(k, t0, x, alpha, beta):
    z = x - 1
    return t0 + alpha * (z + k.sqrt(z * z + beta * x))


def signal(k, t0, x, alpha, beta, green, cycle=60.0):
    g = k.least(0.95, k.most(0.05, green))
    return bpr(k, t0, x, alpha, beta) + 0.5 * cycle * (1 - g) ** 2 / k.most(0.05, 1 - k.least(1.0, x) * g) / 60


def queue_speeds(k, x, free, cutoff, alpha, beta, cd, n, hours):
    """(reference speed, queue speed, congested hours, period speed) of the queue-based function."""
    ref = k.where(x < 1, (1 - x) * free + x * cutoff, cutoff)
    queue = ref / (1 + alpha * k.power(x, beta))
    p = cd * k.power(x, n)
    return ref, queue, p, k.where(p > hours, queue, p / hours * queue + (1 - p / hours) * (ref + free) / 2)


def qvdf(k, x, length, free, cutoff, alpha, beta, cd, n, hours):
    return length / k.most(0.1, queue_speeds(k, x, free, cutoff, alpha, beta, cd, n, hours)[3]) * 60


#: Parameters of a link and what they are where a network doesn't give them; cutoff is a share of the free speed.
DEFAULTS = {"linear": 0.0, "conic_a": 0.0, "conic_b": 0.0, "cutoff": 0.75, "cp": 0.28125, "cd": 1.0, "n": 1.0, "s": 4.0, "green": 0.45}


def conic_parameters(k, a, b, alpha, beta):
    """a and b of the conic: the link's own (b from a where only a is given), else its alpha and beta."""
    own_b = k.where(b > 0, b, k.where(a > 1, (2 * a - 1) / k.most(1e-9, 2 * a - 2), beta))
    return k.where(a > 0, a, alpha), own_b


def travel_time(k, vdf_type, t0, x, alpha, beta, length, free, *, hours=1.0, added_per_mile=0.0, cutoff=None, **own):
    """Minutes by the link's own function: 0 BPR, 1 conic, 2 queue, 3 BPR2, 4 INRETS, 5 Akcelik, 6 signal.

    own: the link's parameters by their names in DEFAULTS; ``cutoff`` is a speed.
    """
    o = {n: own.get(n, k.value(v, x)) for n, v in DEFAULTS.items()}
    a, b = conic_parameters(k, o["conic_a"], o["conic_b"], alpha, beta)
    slow = cutoff if cutoff is not None else DEFAULTS["cutoff"] * free
    t = bpr(k, t0, x, alpha, beta, o["linear"])
    for code, other in ((1, conic(k, t0, x, a, b)), (2, qvdf(k, x, length, free, slow, alpha, beta, o["cd"], o["n"], hours)), (3, bpr2(k, t0, x, alpha, beta)), (4, inrets(k, t0, x, alpha)), (5, akcelik(k, t0, x, alpha, beta)), (6, signal(k, t0, x, alpha, beta, o["green"]))):
        t = k.where(vdf_type == code, other, t)
    return k.most(0.0, t + added_per_mile * length)


def generalized_minutes(toll, length, operating_cost, vot):
    return (toll + length * operating_cost) / vot * 60
