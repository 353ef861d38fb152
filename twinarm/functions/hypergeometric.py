"""Hypergeometric sums for exact tests, in memory that does not grow with the counts.

Sums over a support are walked outwards from the most likely point in blocks of fixed
size until what follows is beyond double precision; so a table of 1e10 subjects costs some
million terms, a block at a time. Probabilities of a level's count are those of a
binomial with the common share, in the saddle-point form, which keeps its digits at
any count.

Tables of three levels and more are walked by a ``Network``, its last levels from running sums. ``FarTail``
is for those far out on large counts, where the likelier tables are too many to be walked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

SLACK = 1e-7  # relative slack when comparing table probabilities
BLOCK = 8192
REACH = 45.0  # terms below exp(-REACH) of the largest are beyond the precision of a sum
DEPTH = 60.0  # running sums reach this far below the lowest bound they are asked for
TURN = 150  # the integral of a far tail ends at this many saddle points, and fades out on its last part
PERIOD = 30.0  # its sum repeats where the weights have fallen to exp(-PERIOD)
_SMALL = np.array([0.0] + [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 17)])


def stirling_error(n: np.ndarray) -> np.ndarray:
    """ln n! minus Stirling's formula."""
    big = np.maximum(n, 16.0)
    inv = 1.0 / big
    sq = inv * inv
    series = inv * (1 / 12 - sq * (1 / 360 - sq * (1 / 1260 - sq * (1 / 1680 - sq / 1188))))
    return np.where(n <= 16, _SMALL[np.clip(n, 0, 16).astype(int)], series)


def deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x, by a series where the two are close."""
    v = (x - mean) / (x + mean)
    near = np.abs(v) < 0.1
    w = np.where(near, v, 0.0)
    total, term = (x - mean) * w, 2 * x * w
    for j in range(1, 12):
        term = term * w * w
        total = total + term / (2 * j + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
    return np.where(near, total, plain)


def log_binomial(n, x, share) -> np.ndarray:
    """ln of the binomial probability of ``x`` of ``n`` with a share strictly between 0 and 1; -inf outside the support."""
    n, x, share = np.broadcast_arrays(*(np.asarray(a, float) for a in (n, x, share)))
    inside = (x > 0) & (x < n)
    m, k = np.where(inside, n, 2.0), np.where(inside, x, 1.0)
    body = (stirling_error(m) - stirling_error(k) - stirling_error(m - k) - deviance(k, m * share) - deviance(m - k, m * (1 - share))
            + 0.5 * np.log(m / (2 * math.pi * k * (m - k))))
    ends = np.where(x == 0, n * np.log1p(-share), np.where(x == n, n * np.log(share), -np.inf))
    return np.where(inside, body, ends)


class Table:
    """The family of 2x2 tables with the margins of one table.

    ``x`` is the count of the first row and first column, ``m`` and ``n`` the
    column totals, ``k`` the first row total.
    """

    def __init__(self, x: int, m: int, n: int, k: int):
        self.x, self.m, self.n, self.k = int(x), int(m), int(n), int(k)
        self.low, self.high = max(0, self.k - self.n), min(self.k, self.m)

    def log_ratio(self, x, log_odds=0.0):
        """ln P(x + 1) / P(x)."""
        x = np.asarray(x, float)
        return np.log((self.m - x) * (self.k - x)) - np.log((x + 1) * (self.n - self.k + x + 1)) + log_odds

    def mode(self, log_odds: float) -> int:
        a, b = self.low, self.high
        while a < b:
            mid = (a + b) // 2
            if self.log_ratio(mid, log_odds) > 0:
                a = mid + 1
            else:
                b = mid
        return a

    def blocks(self, start: int, log_odds: float, step: int, reach: float = REACH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Points beyond ``start`` on one side, a block at a time, with ln P relative to that at ``start``, down to -reach."""
        total, at, end = 0.0, start, self.high if step > 0 else self.low
        while at != end and total > -reach:
            count = min(BLOCK, abs(end - at))
            if step > 0:
                terms, points = self.log_ratio(np.arange(at, at + count), log_odds), np.arange(at + 1, at + count + 1)
            else:
                points = np.arange(at - 1, at - count - 1, -1)
                terms = -self.log_ratio(points, log_odds)
            lp = total + np.cumsum(terms)
            yield points, lp
            total, at = float(lp[-1]), at + step * count

    def moments(self, log_odds: float) -> tuple[float, float, tuple[float, float], tuple[float, float]]:
        """Mean and variance, then probability and mean of the points up to x and of those from x on."""
        centre = self.mode(log_odds)
        sums = np.zeros((3, 3))  # all, up to x, from x on: weight, distance from the mode, its square

        def add(points: np.ndarray, weight: np.ndarray) -> None:
            apart = (points - centre).astype(float)
            for row, chosen in enumerate((slice(None), points <= self.x, points >= self.x)):
                w, d = weight[chosen], apart[chosen]
                sums[row] += w.sum(), w @ d, w @ (d * d)

        add(np.array([centre]), np.ones(1))
        for step in (1, -1):
            for points, lp in self.blocks(centre, log_odds, step):
                add(points, np.exp(lp))
        weight, first, second = sums[0]
        sides = tuple((float(row[0] / weight), float(centre + row[1] / row[0]) if row[0] > 0 else math.nan) for row in sums[1:])
        return float(centre + first / weight), float(second / weight - (first / weight) ** 2), sides[0], sides[1]

    def two_sided_p(self) -> float:
        """Sum of the probabilities of all tables no likelier than this one."""
        centre = self.mode(0.0)
        here = 0.0
        if self.x != centre:
            step = 1 if self.x > centre else -1
            for points, lp in self.blocks(centre, 0.0, step, 800.0):
                if step * int(points[-1]) >= step * self.x:
                    here = float(lp[abs(self.x - int(points[0]))])
                    break
            else:
                return 0.0  # less likely than the smallest double
        total, found = 1.0, 1.0 if here >= -SLACK else 0.0
        for step in (1, -1):
            for points, lp in self.blocks(centre, 0.0, step, REACH - here):
                weight = np.exp(lp)
                total += weight.sum()
                found += weight[lp <= here + SLACK].sum()
        return float(min(1.0, found / total))

    def mean(self, log_odds: float) -> float:
        return self.moments(log_odds)[0]

    def tail(self, log_odds: float, upper: bool) -> float:
        return self.moments(log_odds)[3 if upper else 2][0]

    def odds_ratio(self, level: float = 0.95) -> tuple[float, float, float]:
        """Conditional maximum likelihood odds ratio and its exact interval, by root searches in the log of the odds."""
        if self.low == self.high:
            return float("nan"), 0.0, float("inf")
        goal = math.log((1 - level) / 2)
        at_low, at_high = self.x == self.low, self.x == self.high

        def centre(t: float) -> tuple[float, float]:
            mean, variance, _, _ = self.moments(t)
            return mean - self.x, variance

        def side(t: float, upper: bool) -> tuple[float, float]:
            """ln of a tail minus its goal, rising in t, and its slope: the mean there minus that of all."""
            mean, _, below, above = self.moments(t)
            p, inside = above if upper else below
            if p <= 0:
                return (-math.inf, math.nan) if upper else (math.inf, math.nan)
            return (math.log(p) - goal, inside - mean) if upper else (goal - math.log(p), mean - inside)

        inner = min(max(self.x, self.low + 0.5), self.high - 0.5)
        start = math.log(inner * (self.n - self.k + inner) / ((self.m - inner) * (self.k - inner)))
        width = 1 / math.sqrt(max(self.moments(start)[1], 1e-6))
        middle = start if at_low or at_high else root(centre, start, width)
        estimate = 0.0 if at_low else float("inf") if at_high else math.exp(middle)
        lower = 0.0 if at_low else math.exp(root(lambda t: side(t, True), middle - 2 * width, width))
        upper = float("inf") if at_high else math.exp(root(lambda t: side(t, False), middle + 2 * width, width))
        return estimate, lower, upper


def root(rising, start: float, width: float) -> float:
    """Root of a rising function that gives its value and slope: a bracket that doubles, then Newton's steps inside it."""
    low = high = start
    value, slope = rising(start)
    step = width
    while (value > 0 if low == high else rising(low)[0] > 0) and low > -700:
        low, step = low - step, step * 2
    step = width
    while (value < 0 if low == high else rising(high)[0] < 0) and high < 700:
        high, step = high + step, step * 2
    at = start if low < start < high else 0.5 * (low + high)
    for _ in range(100):
        value, slope = rising(at)
        if value == 0:
            return at
        low, high = (at, high) if value < 0 else (low, at)
        new = at - value / slope if slope > 0 else math.nan
        if not low < new < high:
            new = 0.5 * (low + high)
        if abs(new - at) <= 1e-14 * max(1.0, abs(at)) or high - low <= 1e-14 * max(1.0, abs(at)):
            return new
        at = new
    return at


class Network:
    """Tables with given level totals and a given total of one column, level by level.

    A node is the number of levels passed and what is left of the column; a path to it
    has the log probability of the counts passed. The longest path on from a node is
    bounded by the dual of the best split of what is left over the other levels: where
    even that is no likelier than the observed table, all tables beyond count and their
    probabilities add up in closed form. The shortest path on is that of full and empty
    levels: where even that is too likely, no table beyond counts.
    """

    def __init__(self, rows: Sequence[int], share: float, most: float):
        self.rows, self.share, self.most = np.asarray(rows, float), share, most
        self.after = np.concatenate([np.cumsum(self.rows[::-1])[::-1], [0.0]])

    def longest(self, place: int, left: np.ndarray) -> np.ndarray:
        """An upper bound of the log probability of any split of ``left`` over the levels from ``place`` on, exact for one level."""
        levels = self.rows[place:]
        if len(levels) == 1:
            return log_binomial(levels[0], left, self.share)
        t = (left + 0.5) / (self.after[place] + 1)
        with np.errstate(invalid="ignore"):
            price = np.log((1 - t) / t) + math.log(self.share / (1 - self.share))
        taken, total = 0.0, 0.0
        for n in levels:
            x = np.floor((n + 1) * t)
            taken = taken + x
            total = total + log_binomial(n, x, self.share)
        return np.where((left >= 0) & (left <= self.after[place]), total + price * (left - taken), -np.inf)

    def shortest(self, place: int, left: np.ndarray) -> np.ndarray:
        """A lower bound of the log probability of any split of ``left`` over the levels from ``place`` on: that of full and empty levels only."""
        return left * math.log(self.share) + (self.after[place] - left) * math.log1p(-self.share)

    def inner(self, place: int, left: np.ndarray, lp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last count of level ``place`` whose longest path may be likelier than the observed table; empty where last < first.

        Paths are concave in the count, so all counts beyond both ends are absorbed.
        """
        n, rest = self.rows[place], self.after[place + 1]
        low, high = np.maximum(0, left - rest), np.minimum(n, left)
        above = lambda x: lp + log_binomial(n, x, self.share) + self.longest(place + 1, left - x) > self.most
        # Before one level more the bound is exact and so is the top; before several, counts near it are taken for inside.
        single = place == len(self.rows) - 2
        top = np.clip(np.floor((n + 1) * (left + 1) / (n + rest + 2) if single else (n + 1) * (left + 0.5) / (self.after[place] + 1)), low, high)
        margin = 0.0 if single else len(self.rows) + 2.0
        ends = []
        for side, end in ((-1, low), (1, high)):
            near, far = np.clip(top + side * margin, low, high), end + side
            # ``near`` is taken for inside; the bisection moves it out to the last count that is.
            while True:
                open_ = np.abs(far - near) > 1
                if not open_.any():
                    break
                mid = np.trunc((near + far) / 2)
                inside = above(mid)
                near, far = np.where(open_ & inside, mid, near), np.where(open_ & ~inside, mid, far)
            ends.append(near)
        first, last = ends
        # What was only taken for inside is given up again.
        for _ in range(1 if single else 2 * len(self.rows) + 6):
            first = first + ((first <= last) & ~above(first))
            last = last - ((first <= last) & ~above(last))
        return first, last

    def outer(self, place: int, left: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Probability, over the levels from ``place`` on, that their counts add up to ``left`` and the first is outside of first..last."""
        n, rest = self.rows[place], self.after[place + 1]
        total = np.zeros(len(left))
        steps = np.arange(64)
        for side, start in ((-1, first - 1), (1, last + 1)):
            # A tail starts in the support at the earliest.
            at = np.clip(start, np.maximum(0, left - rest), np.minimum(n, left))
            todo = np.flatnonzero(side * (at - start) >= 0)
            if side > 0:
                todo = todo[start[todo] <= np.minimum(n, left[todo])]
            else:
                todo = todo[start[todo] >= np.maximum(0, left[todo] - rest)]
            while len(todo):
                # One probability a block, the others by ratios of neighbours.
                x, m = at[todo, None] + side * steps, left[todo, None]
                anchor = np.exp(log_binomial(n, x[:, :1], self.share) + log_binomial(rest, m - x[:, :1], self.share))
                y = x[:, :-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = (n - y) * (m - y) / ((y + 1) * (rest - m + y + 1)) if side > 0 else y * (rest - m + y) / ((n - y + 1) * (m - y + 1))
                terms = np.concatenate([anchor, anchor * np.cumprod(np.where(np.isfinite(ratio), np.maximum(ratio, 0), 0), axis=1)], axis=1)
                total[todo] += terms.sum(1)
                at[todo] += side * len(steps)
                todo = todo[(terms[:, -1] > 1e-18 * total[todo]) & (terms[:, -1] > 0)]
        return total

    def window(self, level: int, depth: float) -> tuple[int, int]:
        """First and last count of a level whose log probability is at most ``depth`` below the largest."""
        return window(self.rows[level], self.share, depth)

    def tail_of_last_three(self, left: np.ndarray, lp: np.ndarray, weight: np.ndarray, first: np.ndarray, last: np.ndarray) -> float:
        """What the tables beyond nodes three levels before the end add, from their counts first..last on.

        Children that have the same left over split it over the same two levels: those splits are listed once, by
        rising probability from both ends with running sums, and a child looks up where it crosses the bound.
        ``weight`` is the number of paths over the probability of the column total.
        """
        place = len(self.rows) - 3
        some = last >= first
        if not some.any():
            return 0.0
        left, lp, weight, first, last = (a[some] for a in (left, lp, weight, first, last))
        start = int(first.min())
        own = log_binomial(self.rows[place], np.arange(start, int(last.max()) + 1), self.share)
        tops = [float(log_binomial(n, np.floor((n + 1) * self.share), self.share)) for n in self.rows[place + 1:]]
        lowest = self.most - float(lp.max()) - float(own.max()) - DEPTH
        (a0, a1), (b0, b1) = (self.window(place + 1 + i, max(tops[i], 0.0) + tops[1 - i] - lowest + 1) for i in (0, 1))
        one = log_binomial(self.rows[place + 1], np.arange(a0, a1 + 1), self.share)
        other = log_binomial(self.rows[place + 2], np.arange(b0, b1 + 1), self.share)[::-1]
        total = 0.0
        for rest in range(int((left - last).min()), int((left - first).max()) + 1):
            x = left - rest
            mine = np.flatnonzero((x >= first) & (x <= last))
            low, high = max(a0, rest - b1), min(a1, rest - b0)
            if not len(mine) or low > high:
                continue
            split = one[low - a0:high + 1 - a0] + other[low + b1 - rest:high + 1 + b1 - rest]
            top = int(split.argmax())
            sums = np.exp(split)
            rising, falling = split[:top + 1], split[:top:-1]
            below, above = (np.concatenate([[0.0], np.cumsum(side)]) for side in (sums[:top + 1], sums[:top:-1]))
            further = lp[mine] + own[(x[mine] - start).astype(int)]
            bound = self.most - further
            found = below[np.searchsorted(rising, bound, "right")] + above[np.searchsorted(falling, bound, "right")]
            total += float((weight[mine] * np.exp(further) * found).sum())
        return total


def window(n: float, share: float, depth: float) -> tuple[int, int]:
    """First and last count of ``n`` whose binomial log probability is at most ``depth`` below the largest."""
    top = int(min(n, math.floor((n + 1) * share)))
    bound = float(log_binomial(n, top, share)) - depth
    ends = []
    for end in (0, int(n)):
        near, far = top, end
        if float(log_binomial(n, far, share)) >= bound:
            ends.append(far)
            continue
        while abs(far - near) > 1:
            mid = (near + far) // 2
            near, far = (mid, far) if float(log_binomial(n, mid, share)) >= bound else (near, mid)
        ends.append(near)
    return ends[0], ends[1]


def network_paths(rows: Sequence[int], share: float, most: float) -> float:
    """About how many paths a network holds before its last two levels: the volume of the likelier tables there."""
    n = np.asarray(rows, float)
    tops = float(log_binomial(n, np.floor((n + 1) * share), share).sum())
    size = len(n) - 2
    spread = 0.5 * (np.log(n[:size] * share * (1 - share)).sum() + math.log(n[size:].sum() / n.sum()))
    return math.exp(min(700.0, spread + 0.5 * size * math.log(2 * math.pi * max(tops - most, 0.5)) - math.lgamma(size / 2 + 1)))


class FarTail:
    """Sum of the probabilities of all tables no likelier than one far out, by inverting their Laplace transform.

    With L the log probability of a table over that bound, the sum over L <= 0 of exp(L) is the integral, along a
    line of real part s between 0 and 1, of the sum of exp(s L) over all tables, over 1 - s. That sum is one
    coefficient of a product of one polynomial a level, so the work follows the reach of a level and not the
    number of tables. On the real line, s times L bounds it from above: ``log_bound`` is a bound of ln p for every s.
    """

    def __init__(self, rows: Sequence[int], column: int, share: float, most: float, whole: float):
        n = np.asarray(rows, float)
        tops = log_binomial(n, np.minimum(n, np.floor((n + 1) * share)), share)
        self.depth, self.scale = float(tops.sum()) - most, most - whole
        self.s = min(0.5, (len(n) - 1) / (2 * max(self.depth, 1.0)))
        ends = [window(r, share, 25.0 / self.s) for r in n]
        self.parts = [log_binomial(r, np.arange(a, b + 1), share) - t for r, (a, b), t in zip(n, ends, tops)]
        spread = math.sqrt(n.sum() * share * (1 - share) / self.s)
        self.length = 1 << math.ceil(math.log2(max(7.5 * spread, *(len(p) for p in self.parts), 2)))
        shift = (column - sum(a for a, _ in ends)) % self.length
        self.turn = np.exp(2j * math.pi * (np.arange(self.length) * shift % self.length) / self.length) / self.length
        self.log_bound = self.scale + self.s * self.depth + math.log(max(self.tables(self.s).real, 5e-324))
        # The step repeats the sum at a distance beyond which it has vanished on both sides.
        self.step = 2 * math.pi / max(PERIOD / self.s, (self.depth + PERIOD) / (1 - self.s))
        self.terms = math.ceil(TURN * self.s / self.step)

    def tables(self, s: complex) -> complex:
        """Sum over all tables of exp(s L), from the largest possible L on."""
        product = self.turn
        for part in self.parts:
            product = product * np.fft.fft(np.exp(s * part), self.length)
        return complex(product.sum())

    def share(self, first: int, last: int) -> float:
        """What the terms first..last - 1 of the integral's sum add to p, over exp(log_bound)."""
        total = 0.0
        for k in range(first, min(last, self.terms)):
            s = complex(self.s, k * self.step)
            at = (k / self.terms - 0.4) / 0.6  # a smooth end, so that the cut leaves no ripples
            fade = 1.0 if at <= 0 else 1 / (1 + math.exp(max(-700.0, min(700.0, 1 / (1 - at) - 1 / at))))
            term = np.exp(s * self.depth + self.scale - self.log_bound) * self.tables(s) / (1 - s)
            total += fade * term.real * (0.5 if k == 0 else 1.0)
        return total * self.step / math.pi
