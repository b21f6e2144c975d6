"""Interval tree clocks (Almeida, Baquero and Fonte): causal stamps that fork, join and compare without fixed names.

An id is 0, 1 or a pair of ids; an event tree is an integer or (integer, left, right).
"""

from __future__ import annotations

SEED = (1, 0)


def _norm_id(i):
    return i[0] if isinstance(i, tuple) and i in ((0, 0), (1, 1)) else i


def split(i):
    if i == 0:
        return 0, 0
    if i == 1:
        return (1, 0), (0, 1)
    left, right = i
    if left == 0:
        a, b = split(right)
        return (0, a), (0, b)
    if right == 0:
        a, b = split(left)
        return (a, 0), (b, 0)
    return (left, 0), (0, right)


def add(a, b):
    if a == 0:
        return b
    if b == 0:
        return a
    if not (isinstance(a, tuple) and isinstance(b, tuple)):
        raise ValueError("the ids overlap")
    return _norm_id((add(a[0], b[0]), add(a[1], b[1])))


def _low(e):
    return e if isinstance(e, int) else e[0] + min(_low(e[1]), _low(e[2]))


def _high(e):
    return e if isinstance(e, int) else e[0] + max(_high(e[1]), _high(e[2]))


def _up(e, n):
    return e + n if isinstance(e, int) else (e[0] + n, e[1], e[2])


def _norm(e):
    if isinstance(e, int):
        return e
    n, a, b = e
    if isinstance(a, int) and a == b:
        return n + a
    m = min(_low(a), _low(b))
    return n + m, _up(a, -m), _up(b, -m)


def _open(e):
    return (e, 0, 0) if isinstance(e, int) else e


def leq(a, b) -> bool:
    """Whether all events of the first tree are in the second."""
    top = a if isinstance(a, int) else a[0]
    if top > (b if isinstance(b, int) else b[0]):
        return False
    if isinstance(a, int):
        return True
    n, left, right = a
    p, q = (b, b) if isinstance(b, int) else (_up(b[1], b[0]), _up(b[2], b[0]))
    return leq(_up(left, n), p) and leq(_up(right, n), q)


def merge(a, b):
    if isinstance(a, int) and isinstance(b, int):
        return max(a, b)
    a, b = _open(a), _open(b)
    if a[0] > b[0]:
        a, b = b, a
    d = b[0] - a[0]
    return _norm((a[0], merge(a[1], _up(b[1], d)), merge(a[2], _up(b[2], d))))


def _fill(i, e):
    if i == 0 or isinstance(e, int) and i != 1:
        return e
    if i == 1:
        return _high(e)
    n, a, b = e
    if i[0] == 1:
        right = _fill(i[1], b)
        return _norm((n, max(_high(a), _low(right)), right))
    if i[1] == 1:
        left = _fill(i[0], a)
        return _norm((n, left, max(_high(b), _low(left))))
    return _norm((n, _fill(i[0], a), _fill(i[1], b)))


def _grow(i, e):
    """The cheapest new event: (tree, cost)."""
    if i == 1 and isinstance(e, int):
        return e + 1, 0
    if isinstance(e, int):
        tree, cost = _grow(i, (e, 0, 0))
        return tree, cost + 1000
    n, a, b = e
    best = []
    if i[0] != 0:
        tree, cost = _grow(i[0], a)
        best.append(((n, tree, b), cost + 1))
    if i[1] != 0:
        tree, cost = _grow(i[1], b)
        best.append(((n, a, tree), cost + 1))
    return min(best, key=lambda x: x[1])


def fork(stamp):
    i, e = stamp
    a, b = split(i)
    return (a, e), (b, e)


def event(stamp):
    i, e = stamp
    if i == 0:
        raise ValueError("an anonymous stamp has no events")
    filled = _fill(i, e)
    return i, filled if filled != e else _norm(_grow(i, e)[0])


def join(a, b):
    return add(a[0], b[0]), merge(a[1], b[1])
