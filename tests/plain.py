"""Plain forms of matrix methods, which the tests compare the library with."""

import numpy as np


def normalized_matrix(x):
    d = np.diag(x)
    s = x.sum(1) - d
    out = x / (2 * np.where(s == 0, 1, s))[:, None]
    np.fill_diagonal(out, 0.5)
    return (out + out.T) / 2


def dominant_entries(x, k):
    n = x.shape[1]
    order = np.argsort(x, 1, kind="stable")[:, n - (k - 1 if k == n else k) :]
    out = np.zeros_like(x)
    np.put_along_axis(out, order, np.take_along_axis(x, order, 1), 1)
    return out


def fuse_matrices(views, k=10, rounds=10):
    now = [normalized_matrix(v) for v in views]
    near = [normalized_matrix(dominant_entries(v, k)) for v in now]
    for _ in range(rounds):
        total = sum(now)
        now = [normalized_matrix(p @ ((total - v) / (len(now) - 1)) @ p.T) for p, v in zip(near, now)]
    total, many = sum(now), sum((v > 0).astype(float) for v in now)
    return np.divide(total, many, out=np.zeros_like(total), where=many > 0)
