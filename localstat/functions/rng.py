"""Seeded draws written as column expressions.

Every draw is a pure function of (seed, key, draw number), so a lost task recomputes
the same sets, and any SQL engine with ``md5`` and 64-bit integers gives the same
ones. One digest per key starts a stream; the numbers of a stream come from fifth
powers modulo the prime 2**31 - 1, a bijection that costs three multiplications and
stays inside generated code.
"""

import math

from pyspark.sql import functions as F

PRIME = 2147483647  # 2**31 - 1
# Increments between the powers of one stream.
STEPS = [104729, 1299709, 15485863, 32452843, 49979687]


def stream_keys(seed, *cols):
    """Three numbers for a key, as a struct ``(a, b, c)``: a start and two steps.

    The steps lie in 1 .. PRIME - 1, so draws of one stream start from different places.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    part = [F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint") for start in (1, 9, 17)]
    return F.struct(
        (part[0] % PRIME).alias("a"),
        (part[1] % (PRIME - 1) + 1).alias("b"),
        (part[2] % (PRIME - 1) + 1).alias("c"),
    )


def power(x, step):
    """SQL text of one number of the stream, from the one before it (below PRIME)."""
    y = f"({x} + {step})"
    y2 = f"({y} * {y} % {PRIME})"
    return f"{y2} * {y2} % {PRIME} * {y} % {PRIME}"


def numbers(start, prefix="_u", n=5):
    """SQL text of ``n`` successive numbers of the stream that starts at column ``start``.

    For one ``selectExpr``: each number refers to the alias of the one before it.
    """
    names = [start, *[f"{prefix}{i}" for i in range(n)]]
    return [f"{power(names[i], STEPS[i])} AS {names[i + 1]}" for i in range(n)]


def below(u, n):
    """Map a number of the stream to 0 .. n-1 by scaling (SQL text)."""
    return f"({u} * ({n}) div {PRIME})"


def draws_needed(choices, r, max_size=4, risk=1e-18):
    """How many draws give at least ``r`` distinct sets, except with probability ``risk``.

    A draw picks a size 1..max_size evenly, then a set of that size out of ``choices``
    nodes. Two tail bounds on the number of distinct sets are used, whichever settles
    first: bounded differences (few repeats) and Chernoff on the sets still missing
    (``r`` close to all there are).
    """
    counts = [math.comb(choices, s) for s in range(1, max_size + 1)]
    total = sum(counts)
    if r > total:
        raise ValueError(f"only {total} distinct sets exist, {r} asked for")

    def enough(draws):
        misses = [(c, draws * math.log1p(-1 / (max_size * c))) for c in counts if c]
        found = sum(-c * math.expm1(log) for c, log in misses)
        if found - math.sqrt(draws * math.log(1 / risk) / 2) >= r:
            return True
        missing, room = sum(c * math.exp(log) for c, log in misses), total - r + 1
        return missing < room and room * (1 + math.log(missing / room)) - missing <= math.log(risk)

    low, high = r, r + 1
    while not enough(high):
        low, high = high, high * 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high


def stratified(rank, n, total, u, key=("_b", "_c"), out="_pick"):
    """SQL texts that pick a number below ``total`` for each ``rank`` in 0 .. n-1, all of them distinct.

    The numbers are cut into ``n`` even stretches; each rank takes a random one of its stretch,
    by the stream numbers ``u``, and all are moved on cyclically by a random distance that
    depends on the key. So every single pick is equally likely to be any number. ``n`` is at
    most ``total``, which is below 2**61; the last text is the result.
    """
    high = PRIME + 1
    width = f"{total} div {n} + IF({rank} < {total} % {n}, 1, 0)"
    first = f"{rank} * ({total} div {n}) + least({rank}, {total} % {n})"
    shift = f"({key[0]} * {high} + {key[1]}) % {total}"
    jitter = f"({u[0]} * {high} + {u[1]}) % ({width})"
    return [f"({first} + {jitter} + {shift}) % {total} AS {out}"]


def falling(n, k):
    """SQL text of ``n (n - 1) .. (n - k + 1)``."""
    pair = f"{n} * ({n} - 1)"
    return {1: n, 2: pair, 3: f"{pair} * ({n} - 2)", 4: f"{pair} * ({pair} - 4 * {n} + 6)"}[k]


def largest_choice(x, k, guess):
    """SQL texts of a guess and of the largest n with C(n, k) <= x.

    The root of ``k! x`` lies less than one below it; whole numbers decide which it is.
    """
    product = f"double({math.factorial(k)} * {x})"
    root = {2: f"sqrt({product})", 3: f"cbrt({product})", 4: f"sqrt(sqrt({product}))"}[k]
    whole = f"greatest(bigint(floor({root} + {(k - 1) / 2}D)), {k - 1}L) + 1 AS {guess}"
    return whole, f"IF({falling(guess, k)} < {math.factorial(k)} * ({x} + 1), {guess}, {guess} - 1)"
