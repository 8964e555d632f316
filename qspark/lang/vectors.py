"""The language's functions on plain values: atoms and lists on the driver, as in scripts and literals."""

from __future__ import annotations

import bisect
import datetime
import fnmatch
import functools
import itertools
import math
import random
import statistics
import uuid
from collections.abc import Callable
from typing import Any

from .reader import EPOCH, Stamp, Sym, Time, Vec, stamp

DAY = datetime.date(2000, 1, 1)


def is_list(x: Any) -> bool:
    return isinstance(x, list)


def atomic(f: Callable) -> Callable:
    """Element by element over lists, atoms repeated."""

    @functools.wraps(f)
    def g(*args):
        sizes = {len(a) for a in args if is_list(a)}
        if not sizes:
            return f(*args)
        if len(sizes) > 1:
            raise ValueError("length: vectors of different lengths")
        n = sizes.pop()
        return Vec(g(*(a[k] if is_list(a) else a for a in args)) for k in range(n))

    return g


def strict(f: Callable) -> Callable:
    return atomic(lambda *a: None if any(x is None or x != x for x in a) else f(*a))


def _like(x, v):
    """v in the kind of x."""
    return type(x)(v) if isinstance(x, (Time, Stamp)) else v


def _add(a, b):
    if isinstance(a, datetime.date):
        return Stamp((a - DAY).days * 86_400_000_000_000 + b * 1_000_000) if isinstance(b, Time) else a + datetime.timedelta(days=b)
    if isinstance(b, datetime.date) or (isinstance(b, (Time, Stamp)) and not isinstance(a, (Time, Stamp))):
        return _add(b, a)
    if isinstance(a, Stamp) and isinstance(b, Time):
        return Stamp(int(a) + int(b) * 1_000_000)
    if isinstance(a, Time) and isinstance(b, Stamp):
        return _add(b, a)
    return _like(a, a + b)


def _sub(a, b):
    if isinstance(a, datetime.date):
        if isinstance(b, datetime.date):
            return (a - b).days
        return Stamp((a - DAY).days * 86_400_000_000_000 - b * 1_000_000) if isinstance(b, Time) else a - datetime.timedelta(days=b)
    if isinstance(a, Stamp):
        return int(a) - int(b) if isinstance(b, Stamp) else Stamp(int(a) - int(b) * (1_000_000 if isinstance(b, Time) else 1))
    return _like(a, a - b)


def _floor_div(a, b):
    if b == 0:
        return None
    q = math.floor(a / b) if isinstance(a, float) or isinstance(b, float) else int(a) // int(b)
    return float(q) if isinstance(a, float) else _like(a, q)


def _mod(a, b):
    return None if b == 0 else _like(a, a - math.floor(a / b) * b if isinstance(a, float) or isinstance(b, float) else int(a) % int(b))


def _xbar(a, w):
    if not w:
        return None
    if isinstance(a, datetime.date):
        days = (a - DAY).days
        return DAY + datetime.timedelta(days=days - days % w)
    if isinstance(a, Stamp):
        n = int(w) * (1_000_000 if isinstance(w, Time) else 1)
        return Stamp(int(a) - int(a) % n)
    return _like(a, a - _mod(a, w)) if isinstance(a, float) or isinstance(w, float) else _like(a, int(a) - int(a) % int(w))


def half_away(x):
    return float(math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)) if isinstance(x, float) else x


add, sub, mul = strict(_add), strict(_sub), strict(lambda a, b: _like(a, a * b))
floor_div, mod, xbar = strict(_floor_div), strict(_mod), strict(_xbar)
true_div = strict(lambda a, b: None if b == 0 else a / b)
neg = strict(lambda a: _like(a, -a))
round_, floor_, ceil_ = strict(half_away), strict(lambda x: float(math.floor(x)) if isinstance(x, float) else x), strict(lambda x: float(math.ceil(x)) if isinstance(x, float) else x)


def _key(x):
    """Nulls are smallest."""
    return (0, 0) if x is None or x != x else (1, x)


eq, ne = atomic(lambda a, b: _key(a) == _key(b)), atomic(lambda a, b: _key(a) != _key(b))
lt, gt = atomic(lambda a, b: _key(a) < _key(b)), atomic(lambda a, b: _key(a) > _key(b))
le, ge = atomic(lambda a, b: _key(a) <= _key(b)), atomic(lambda a, b: _key(a) >= _key(b))
not_ = atomic(lambda a: not a)


def and_(*p):
    return functools.reduce(atomic(lambda a, b: bool(a and b)), p)


def or_(*p):
    return functools.reduce(atomic(lambda a, b: bool(a or b)), p)


def known(x: list) -> list:
    return [v for v in x if v is not None and v == v]


def listed(f: Callable) -> Callable:
    return lambda x: f(x) if is_list(x) else f([x])


sum_ = listed(lambda x: sum(known(x)))
avg = listed(lambda x: statistics.fmean(known(x)) if known(x) else None)
min_, max_ = listed(lambda x: min(known(x), default=None)), listed(lambda x: max(known(x), default=None))
med = listed(lambda x: float(statistics.median(known(x))) if known(x) else None)
dev = listed(lambda x: statistics.pstdev(known(x)) if known(x) else None)


def count(x):
    return len(x) if isinstance(x, (list, str, dict)) and not isinstance(x, Sym) else 1


def first(x):
    return (x[0] if x else None) if is_list(x) or isinstance(x, str) and not isinstance(x, Sym) else x


def last(x):
    return (x[-1] if x else None) if is_list(x) or isinstance(x, str) and not isinstance(x, Sym) else x


def distinct(x):
    own = list(dict.fromkeys(x))
    return Vec(sorted(own, key=_key)) if all(isinstance(v, int) for v in own) else Vec(own)


def group(x):
    out: dict = {}
    for k, v in enumerate(x):
        out.setdefault(v, Vec()).append(k)
    return out


def where(m):
    return Vec(k for k, v in enumerate(m) if v)


def filter_(x, m):
    return Vec(v for v, k in zip(x, m, strict=True) if k)


def at(x, i):
    if is_list(i):
        return Vec(at(x, k) for k in i)
    if isinstance(x, dict):
        return x.get(i)
    return x[i] if isinstance(i, int) and 0 <= i < len(x) else None


def take(x, n):
    if is_list(n):
        return x[n[0] : n[0] + n[1]] if isinstance(x, str) and not isinstance(x, Sym) else Vec(x[n[0] : n[0] + n[1]])
    if not is_list(x) and (not isinstance(x, str) or isinstance(x, Sym)):
        return Vec([x] * abs(n))
    if not x:
        return x
    out = [x[(k if n >= 0 else k - abs(n)) % len(x)] for k in range(abs(n))]
    return "".join(out) if isinstance(x, str) else Vec(out)


def in_(x, s):
    own = {_key(v) for v in s} if is_list(s) else {_key(s)}
    return Vec(in_(v, s) if is_list(v) else _key(v) in own for v in x) if is_list(x) else _key(x) in own


def within(x, b):
    return atomic(lambda v: v is not None and b[0] <= v <= b[1])(x)


def like(x, p):
    p = p.replace("[^", "[!")
    return Vec(like(v, p) for v in x) if is_list(x) else fnmatch.fnmatchcase(x, p)


def find(x, y):
    if is_list(y):
        return Vec(find(x, v) for v in y)
    return x.index(y) if y in x else None


def bin_(x, y):
    return Vec(bin_(x, v) for v in y) if is_list(y) else bisect.bisect_right(x, y) - 1


def binr(x, y):
    return Vec(binr(x, v) for v in y) if is_list(y) else bisect.bisect_left(x, y)


def iasc(x):
    return Vec(sorted(range(len(x)), key=lambda k: _key(x[k])))


def idesc(x):
    return Vec(sorted(range(len(x)), key=functools.cmp_to_key(lambda a, b: (_key(x[a]) < _key(x[b])) - (_key(x[a]) > _key(x[b])))))


def asc(x):
    return {k: x[k] for k in sorted(x, key=lambda k: _key(x[k]))} if isinstance(x, dict) else Vec(x[k] for k in iasc(x))


def desc(x):
    return {k: x[k] for k in sorted(x, key=lambda k: _key(x[k]), reverse=True)} if isinstance(x, dict) else Vec(x[k] for k in idesc(x))


def rank(x):
    return iasc(iasc(x))


def xrank(x, n):
    if n <= 0:
        raise ValueError("domain: the number of buckets must be positive")
    return Vec(r * n // len(x) for r in rank(x))


def reverse(x):
    return x[::-1] if isinstance(x, str) else Vec(x[::-1])


def as_list(x):
    return x if is_list(x) else Vec([x])


def concat(a, b):
    if isinstance(a, str) and isinstance(b, str) and not isinstance(a, Sym):
        return a + b
    return Vec([*as_list(a), *as_list(b)])


def union(a, b):
    return Vec(dict.fromkeys(concat(a, b)))


def sect(a, b):
    return Vec(v for v in a if v in b)


def except_(a, b):
    return Vec(v for v in a if v not in as_list(b))


def raze(x):
    return Vec(itertools.chain.from_iterable(as_list(v) for v in x))


def remove(x, i):
    gone = set(as_list(i))
    return {k: v for k, v in x.items() if k not in gone} if isinstance(x, dict) else Vec(v for k, v in enumerate(x) if k not in gone)


def split(x, sep):
    if is_list(x):
        return Vec(Vec(x[a:b]) for a, b in zip(sep, [*sep[1:], len(x)], strict=True))
    return Vec(x.split(sep))


def text(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, Time):
        s, ms = divmod(abs(int(x)), 1000)
        return f"{'-' if x < 0 else ''}{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{ms:03d}"
    if isinstance(x, Stamp):
        s, ns = divmod(int(x), 10**9)
        return f"{EPOCH + datetime.timedelta(seconds=s):%Y.%m.%dD%H:%M:%S}.{ns:09d}"
    if isinstance(x, datetime.date):
        return f"{x:%Y.%m.%d}"
    if isinstance(x, float):
        return f"{x:.2f}"
    if is_list(x):
        return "[" + " ".join(map(text, x)) + "]"
    return str(x)


def format_(pattern, *args):
    parts = str(pattern).split("%")
    out = parts[0]
    for k, p in enumerate(parts[1:]):
        out += (text(args[k]) if k < len(args) else "%") + p
    return out


def _cast(kind, x):
    """kind: upper-case type name."""
    if x is None:
        return None
    try:
        if kind == "B8":
            return bool(x)
        if kind in ("I16", "I32", "I64", "U8"):
            if isinstance(x, datetime.date):
                return (x - DAY).days
            v = int(float(x)) if isinstance(x, str) and "." in x else int(x)
            return v & 255 if kind == "U8" else v
        if kind == "F64":
            return float(x)
        if kind in ("SYMBOL", "ENUM"):
            return Sym(text(x) if not isinstance(x, str) else x)
        if kind in ("C8", "STRING"):
            return text(x) if not isinstance(x, str) else str(x)
        if kind == "GUID":
            return str(uuid.UUID(x))
        if kind == "DATE":
            if isinstance(x, str):
                return datetime.date(int(x[:4]), int(x[5:7]), int(x[8:10]))
            if isinstance(x, Stamp):
                return DAY + datetime.timedelta(days=int(x) // 86_400_000_000_000)
            return x if isinstance(x, datetime.date) else DAY + datetime.timedelta(days=int(x))
        if kind == "TIME":
            from .reader import _millis

            if isinstance(x, Stamp):
                return Time(int(x) % 86_400_000_000_000 // 1_000_000)
            return Time(_millis(x) if isinstance(x, str) else 0 if isinstance(x, datetime.date) else int(x))
        if kind == "TIMESTAMP":
            if isinstance(x, datetime.date):
                return Stamp((x - DAY).days * 86_400_000_000_000)
            if isinstance(x, str):
                if "D" not in x:
                    t = datetime.datetime.fromisoformat(x.replace(".", "-", 2) if x[4] == "." else x)
                    t = t.astimezone(datetime.timezone.utc).replace(tzinfo=None) if t.tzinfo else t
                    return Stamp(int((t - EPOCH) / datetime.timedelta(microseconds=1)) * 1000)
                return stamp(x)
            return Stamp(int(x))
    except (ValueError, TypeError, OverflowError):
        return None
    raise ValueError(f"value: unknown type {kind}")


def cast(kind, x):
    kind = str(kind).upper()
    if kind in ("C8", "STRING") and is_list(x):
        return Vec(_cast(kind, v) for v in x)
    return atomic(lambda v: _cast(kind, v))(x)


def type_(x) -> Sym:
    one = x[0] if is_list(x) and x else x
    names = [(bool, "B8"), (Time, "TIME"), (Stamp, "TIMESTAMP"), (int, "I64"), (float, "F64"), (Sym, "SYMBOL"), (datetime.date, "DATE"), (dict, "DICT"), (str, "C8")]
    name = next((n for k, n in names if isinstance(one, k)), "NULL" if one is None else "LIST")
    if is_list(x):
        return Sym(name if len({type(v) for v in x if v is not None}) <= 1 and name not in ("C8", "NULL") else "LIST")
    return Sym(name if isinstance(x, dict) else "C8" if name == "C8" else name.lower())


def til(n):
    return Vec(range(n))


def rand(n, most):
    return Vec(random.randrange(most) for _ in range(n))


def guid(n):
    return Vec(str(uuid.uuid4()) for _ in range(n))
