"""Kernels on dense boxes against plain loops over cells."""

import math

import numpy as np
import pytest

from windgrid.operators import dense


def plain_at(f, c, axis, step):
    n = list(c)
    n[axis] = min(max(n[axis] + step, 0), f.shape[axis] - 1)
    return f[tuple(n)]


def plain_slope(f, c, axis):
    n = f.shape[axis]
    if n == 1:
        return 0.0
    if c[axis] == 0 or c[axis] == n - 1:
        return plain_at(f, c, axis, 1) - f[c] if c[axis] == 0 else f[c] - plain_at(f, c, axis, -1)
    return (plain_at(f, c, axis, 1) - plain_at(f, c, axis, -1)) / 2


def plain_mean(f, c, axes=(0, 1, 2)):
    return sum(plain_at(f, c, a, s) for a in axes for s in (-1, 1)) / (2 * len(axes))


def each(shape, rule):
    out = np.zeros(shape)
    for c in np.ndindex(*shape):
        out[c] = rule(c)
    return out


def plain_active_mean(f, active, c):
    near = []
    for axis in range(3):
        for step in (-1, 1):
            n = list(c)
            n[axis] += step
            if 0 <= n[axis] < f.shape[axis] and active[tuple(n)]:
                near.append(f[tuple(n)])
    return sum(near) / len(near) if near else f[c]


def plain_sweep(u, v, conf, source, first, how):
    """One sweep, cell by cell, with layers and anchor."""
    shape, active = u.shape, conf > 1e-6
    spread = each(shape, lambda c: plain_slope(u, c, 2) + plain_slope(v, c, 1))
    speed = each(shape, lambda c: math.hypot(u[c], v[c]))

    def kinds(c):
        pairs = [math.hypot(u[c] - u[n], v[c] - v[n]) for s in (-1, 1) if 0 <= c[0] + s < shape[0] for n in [(c[0] + s, c[1], c[2])]]
        strong = active[c] and speed[c] >= 60
        return strong and max(pairs, default=0) <= 2, strong and abs(speed[c] - plain_mean(speed, c, (0,))) >= 25

    out = []
    for f, axis in ((u, 2), (v, 1)):
        def moved(c, f=f, axis=axis):
            gain = min(0.65, how.diffusion * (1 - conf[c]) + how.smooth)
            risk = any(kinds(c))
            mean = plain_mean(f, c, (1, 2)) if risk else plain_mean(f, c)
            return f[c] + gain * ((1 - how.damp_context) if risk else 1) * (mean - f[c]) - how.divergence * plain_slope(spread, c, axis)

        new = each(shape, moved)
        new = new + each(shape, lambda c, n=new: how.smooth * (1 - conf[c]) * (plain_active_mean(n, active, c) - n[c]))
        out.append(new + how.anchor * conf * (first[len(out)] - new))
    scale = each(shape, lambda c: min(1.0, how.most_speed / max(1e-6, math.hypot(out[0][c], out[1][c]))))
    done = []
    for new, f, a in zip([out[0] * scale, out[1] * scale], (u, v), first, strict=True):
        def last(c, new=new, f=f, a=a):
            x, (level, apart) = new[c], kinds(c)
            x = (1 - how.keep_layer * conf[c]) * x + how.keep_layer * conf[c] * a[c] if level else x
            x = (1 - how.damp_context * conf[c]) * x + how.damp_context * conf[c] * a[c] if apart else x
            keep = how.preserve if source[c] else 0.0
            return keep * f[c] + (1 - keep) * x

        done.append(each(shape, last))
    return *done, each(shape, lambda c: max(conf[c], min(0.45, how.fill * plain_mean(conf, c))))


@pytest.mark.parametrize("shape", [(3, 4, 5), (1, 3, 4), (2, 1, 1)])
def test_relaxation_against_loops(shape):
    rng = np.random.default_rng(4)
    u, v = rng.normal(50, 40, shape), rng.normal(40, 40, shape)
    if shape[0] == 3:
        u[:, 1, 1], v[:, 1, 1] = 70.0, 5.0  # a strong column without any jump
    conf, source = rng.random(shape) * (rng.random(shape) > 0.3), rng.random(shape) > 0.7
    how = dense.Relaxation(sweeps=3)
    got = dense.relax(u, v, conf, source, how)
    first, want = (u, v), (u, v, conf)
    for _ in range(3):
        want = plain_sweep(*want, source, first, how)
    for a, b in zip(got, want, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)
    if shape[0] == 3:
        assert dense.layers_at_risk(u, v, conf >= 0)[0][:, 1, 1].all()


def test_relaxation_keeps_sources_and_limits_speed():
    u, v = np.full((2, 3, 3), 200.0), np.zeros((2, 3, 3))
    source = np.zeros((2, 3, 3), dtype=bool)
    source[0, 1, 1] = True
    ru, rv, conf = dense.relax(u, v, np.full((2, 3, 3), 0.9), source, dense.Relaxation(sweeps=4, preserve=1.0))
    assert ru[0, 1, 1] == 200 and conf.min() == 0.9
    ru, rv, _ = dense.relax(u, v, np.zeros((2, 3, 3)), source & False, dense.Relaxation(sweeps=4))
    assert np.hypot(ru, rv).max() <= 120 + 1e-9
    ru, _, _ = dense.relax(u, v, np.zeros((2, 3, 3)), source & False, dense.Relaxation(sweeps=4, anchor=None))
    assert ru.max() == 200


def test_analysis_against_loops():
    rng, shape = np.random.default_rng(5), (3, 3, 4)
    b, p, o = [tuple(rng.normal(20, 30, shape) for _ in range(2)) + (rng.random(shape) * (rng.random(shape) > 0.4),) for _ in range(3)]
    sites = [dense.Site(*dense.sight(shape, s, (1.0, 2.0)), rng.normal(0, 20, shape), w) for s, w in (((0, 0, 0), 1.0), ((0.0, 2.5, 3.5), rng.random(shape)))]
    t = dense.Terms(most_speed=60.0)
    u, v, loss = dense.analyse(b, p, o, sites, 4, t)
    x = [b[0].copy(), b[1].copy()]
    edge = lambda c: any(i in (0, n - 1) for i, n in zip(c, shape, strict=True))
    for _ in range(4):
        spread = each(shape, lambda c: plain_slope(x[0], c, 2) + plain_slope(x[1], c, 1))
        new = []
        for i, axis in ((0, 2), (1, 1)):
            f = x[i]

            def moved(c, f=f, i=i, axis=axis):
                curve = plain_at(f, c, 0, -1) - 2 * f[c] + plain_at(f, c, 0, 1)
                radial = sum((x[0][c] * s.east[c] + x[1][c] * s.north[c] + b[2][c] * s.up[c] - s.seen[c]) * np.broadcast_to(s.weight, shape)[c] * (s.north if i else s.east)[c] for s in sites)
                return (
                    f[c] + 0.018 * (plain_mean(f, c) - f[c]) - 0.006 * plain_slope(spread, c, axis) + 0.006 * curve + 0.04 * (b[i][c] - f[c]) + 0.22 * p[2][c] * (p[i][c] - f[c])
                    + 0.28 * o[2][c] * (o[i][c] - f[c]) - 0.08 * radial + 0.02 * edge(c) * (b[i][c] - f[c])
                )

            new.append(each(shape, moved))
        speed = np.hypot(*new)
        x = [n * np.minimum(1, 60 / np.maximum(speed, 1e-6)) for n in new]
    np.testing.assert_allclose(u, x[0], atol=1e-9)
    np.testing.assert_allclose(v, x[1], atol=1e-9)
    assert np.hypot(u, v).max() <= 60 + 1e-9
    assert loss["background"] == pytest.approx(np.hypot(u - b[0], v - b[1]).mean()) and set(loss) == {"background", "prior", "observation", "radial", "smooth", "divergence", "shear", "boundary"}


def test_sight_is_a_unit_vector():
    e, n, up = dense.sight((3, 4, 5), (0.0, 1.0, 1.0), (5.0, 100.0))
    far = np.sqrt(e**2 + n**2 + up**2)
    assert far[0, 1, 1] == 0 and np.allclose(np.delete(far.ravel(), 1 * 5 + 1), 1)
    assert n[0, 0, 1] == 1 and e[0, 1, 2] == 1 and up[1, 1, 1] == 1  # rows run southwards
