"""Chinese restaurants of a hierarchical Pitman-Yor model, many at once in numpy arrays.

A dish is a context with the symbol behind it, as one number: the symbol in the lowest byte, the context's last
byte above it, and so on. The dishes of one context are one restaurant; a restaurant's parent is that of the context
without its first byte, and every table is a customer of the same symbol there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Table sizes and table numbers up to which the draws for discount and strength are exact; beyond, expected values.
EXACT = 1 << 16
#: Uniform draws keep this far from 0 and 1, so that rounding moves no customer to another dish.
EDGE = 1e-6
#: Tables handled at once: the arrays of a step over them stay in the processor's cache.
STEP_TABLES = 1 << 15


def _dish_totals(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, counts long."""
    out, some = np.zeros(len(counts), np.int64), counts > 0
    if len(values):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], dtype=np.int64)
    return out


def _dealt(weight: np.ndarray, ends: np.ndarray, t: np.ndarray, m: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """m customers of each dish dealt to its tables (t, one at least, up to ends) by weight, as a systematic sample that begins at shift."""
    run = np.cumsum(weight)
    last = ends - 1
    upto = run[last]
    before = np.append(0.0, upto[:-1])
    line = np.empty(len(t), complex)  # both numbers are repeated at once
    line.real = m / (upto - before)
    line.imag = shift - before * line.real
    line = np.repeat(line, t)
    run *= line.real
    run += line.imag
    place = run.astype(np.int64)
    place[last] = m
    out = np.empty_like(place)
    np.subtract(place[1:], place[:-1], out=out[1:])
    first = ends - t
    out[first] = place[first]
    return out


def _distinct(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value of an ordered array begins, and the number of its value for every place."""
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Level:
    """All restaurants with contexts of one length: dishes by key, and the sizes of their tables, dish after dish."""

    def __init__(self, keys: np.ndarray, discount: float, strength: float):
        """keys are in order, so restaurants are runs of dishes."""
        self.keys, self.discount, self.strength = keys, discount, strength
        at, self.room = _distinct(keys >> np.uint64(8))
        self.rooms = len(at)
        self.others = np.zeros(self.rooms, np.int64)  # tables in each restaurant of dishes that are not here
        self.c, self.t, self.size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(0, np.int64)

    def part(self, which: np.ndarray) -> Level:
        """Some dishes alone, in restaurants with the tables of all."""
        out = Level(self.keys[which], self.discount, self.strength)
        own = self.room[which]
        tables = self.others + self.total(self.t) - np.bincount(own, self.t[which], self.rooms)
        out.others = tables[own[_distinct(own)[0]]]
        out.c, out.t, out.size = self.c[which], self.t[which], self.size[np.repeat(which, self.t)]
        return out

    def put(self, which: np.ndarray, part: Level) -> None:
        """The dishes of part() as they are now."""
        rest = self.size[~np.repeat(which, self.t)]
        self.c[which], self.t[which] = part.c, part.t
        inside = np.repeat(which, self.t)
        self.size = np.empty(len(inside), np.int64)
        self.size[inside], self.size[~inside] = part.size, rest

    def total(self, of_dish: np.ndarray) -> np.ndarray:
        """Sums over the dishes of each restaurant."""
        return np.bincount(self.room, of_dish, self.rooms)

    def one_table_each(self, customers: np.ndarray) -> None:
        self.c, self.t, self.size = customers.copy(), (customers > 0).astype(np.int64), customers[customers > 0]

    def opening(self, parent: np.ndarray) -> np.ndarray:
        """The weight of a new table of each dish."""
        return (self.strength + self.discount * (self.others + self.total(self.t)))[self.room] * parent

    def predictive(self, parent: np.ndarray) -> np.ndarray:
        """Probability of every dish in its restaurant, given that of its symbol in the parent."""
        return (self.c - self.discount * self.t + self.opening(parent)) / (self.strength + self.total(self.c))[self.room]

    def _over_tables(self, m: np.ndarray, less: float, rng: np.random.Generator) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """m customers of each dish dealt to its tables by size less a number, as a systematic sample (for one customer: a
        plain draw). Until all had their turn: some dishes, where the tables of each end, the tables' sizes, the customers for each."""
        some = self.t > 0
        shift = EDGE + (1 - 2 * EDGE) * rng.random(some.sum())
        if not some.all():
            shift, all_shifts = np.zeros(len(some)), shift
            shift[some] = all_shifts
        ends, a, x = np.cumsum(self.t), 0, 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, x + STEP_TABLES, "right")))
            y = int(ends[b - 1])
            size, own = self.size[x:y], ends[a:b] - x
            parts = own, self.t[a:b], m[a:b], shift[a:b]
            if not some[a:b].all():
                parts = [v[some[a:b]] for v in parts]
            yield slice(a, b), own, size, _dealt(size - less, *parts)
            a, x = b, y

    def leave(self, m: np.ndarray, rng: np.random.Generator) -> None:
        """m customers of each dish, picked at random, stand up; empty tables go."""
        c, t, kept = self.c - m, self.t.copy(), [self.size[:0]]
        for own, ends, old, left in self._over_tables(m, 0.0, rng):
            size = old - left
            if len(size) and size.min() < 0:  # rounding: as many as sit there
                np.maximum(size, 0, out=size)
                c[own] = _dish_totals(size, self.t[own])
            gone = np.flatnonzero(size == 0)
            if len(gone):
                t[own] -= np.bincount(np.searchsorted(ends, gone, "right"), minlength=len(ends))
                size = size[size > 0]
            kept.append(size)
        self.c, self.t, self.size = c, t, np.concatenate(kept)

    def sit(self, m: np.ndarray, parent: np.ndarray, rng: np.random.Generator) -> None:
        """m customers of each dish sit down: at a new table, or at one by size less discount. The weights are those at their
        start, but for their sum, which grows by one with each of them."""
        new, old = self.opening(parent), self.c - self.discount * self.t
        opened = np.where(self.c > 0, rng.binomial(m, new / np.maximum(new + old + np.maximum(m - 1, 0) / 2, 1e-300)), m)
        kept = [self.size[:0]]
        for own, ends, size, more in self._over_tables(m - opened, self.discount, rng):
            some = opened[own]
            kept.append(np.insert(size + more, np.repeat(ends, some), 1) if some.any() else size + more)
        self.t, self.c, self.size = self.t + opened, self.c + m, np.concatenate(kept)

    def follow(self, customers: np.ndarray, parent: np.ndarray, rng: np.random.Generator) -> None:
        """Have as many customers of each dish as given: some leave at random, others come one by one, into a
        large dish in groups of a quarter of those seated."""
        while (due := self.c != customers).any():
            if 2 * due.sum() < len(due):
                part = self.part(due)
                part.follow(customers[due], parent[due], rng)
                self.put(due, part)
                return
            if (self.c > customers).any():
                self.leave(np.maximum(self.c - customers, 0), rng)
            if (self.c < customers).any():
                self.sit(np.minimum(np.maximum(customers - self.c, 0), np.maximum(1, self.c // 4)), parent, rng)

    def move(self, groups: int, parent: np.ndarray, rng: np.random.Generator, begin: int = 0) -> None:
        """A Gibbs sweep: every customer of each dish leaves and sits down anew given all others, one at a time in a dish of up
        to `groups` customers; those of a larger one in so many groups of equal size. Groups before `begin` have moved."""
        for i in range(begin, groups):
            some = self.c > max(i, 1)  # a single customer has a table in any case
            if 4 * some.sum() < 3 * len(some):
                if some.any():
                    part = self.part(some)
                    part.move(groups, parent[some], rng, i)
                    self.put(some, part)
                return
            n = np.clip(self.c, 1, groups)
            before = self.c
            self.leave(np.where(some, before * (i + 1) // n - before * i // n, 0), rng)
            self.sit(before - self.c, parent, rng)

    def evidence(self, rng: np.random.Generator) -> np.ndarray:
        """Sums of the auxiliary draws from which discount and strength are sampled: see sample_parameters."""
        d, s = self.discount, self.strength
        tables, seated = self.total(self.t), self.total(self.c)
        tables, seated = tables[seated > 0], seated[seated > 0]
        logs = np.log(rng.beta(s + 1, seated[seated > 1] - 1)).sum()

        def beyond(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For i = 1, 2, ..: how many of x are above i."""
            n = np.bincount(np.minimum(x, EXACT).astype(np.int64), minlength=2)
            over = len(x) - np.cumsum(n)
            return np.arange(1, max(1, len(n) - 1)), over[1 : max(1, len(n) - 1)]

        i, n = beyond(tables)
        kept = rng.binomial(n, s / (s + d * i)).sum() if len(i) else 0
        j, m = beyond(self.size)
        split = rng.binomial(m, (1 - d) / (j - d)).sum() if len(j) else 0
        tail = (1 - d) * np.log(np.maximum(self.size, EXACT) / EXACT).sum()
        return np.array([n.sum() - kept, split + tail, kept, -logs], float)


def sample_parameters(evidence: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """Discount and strength of a level from the sums of evidence(), under flat Beta and unit Gamma priors."""
    closed, split, kept, minus_logs = evidence
    return float(np.clip(rng.beta(1 + closed, 1 + split), 0.01, 0.99)), float(max(1e-3, rng.gamma(1 + kept, 1 / (1 + minus_logs))))


class Hierarchy:
    """Restaurants with contexts of first to last bytes over the dishes with contexts of last bytes in keys, some
    perhaps without customers, under the given probabilities of their symbols behind first - 1 bytes."""

    def __init__(self, keys: np.ndarray, customers: np.ndarray, first: int, last: int, parameters: list[tuple[float, float]]):
        self.levels: list[Level] = []
        self.up: list[np.ndarray] = []
        for k in range(last, first - 1, -1):
            self.levels.insert(0, Level(keys, *parameters[k]))
            short = keys & np.uint64((1 << 8 * k) - 1)
            order = np.argsort(short)
            at, number = _distinct(short[order])
            up = np.empty(len(keys), np.int64)
            up[order] = number
            keys = short[order[at]]
            self.up.insert(0, up)
        self.roots, self.customers = keys, customers

    def rising(self, k: int) -> np.ndarray:
        """The customers that the level below, or the text, sends to level k."""
        return self.customers if k == len(self.levels) - 1 else np.bincount(self.up[k + 1], self.levels[k + 1].t, len(self.levels[k].keys)).astype(np.int64)

    def sent(self) -> np.ndarray:
        """Customers of the roots: the tables of the first level by dish of one byte less."""
        return np.bincount(self.up[0], self.levels[0].t, len(self.roots)).astype(np.int64)

    def predictive(self, base: np.ndarray) -> list[np.ndarray]:
        """The parents' probabilities of each level's dishes, and at the end those of the longest contexts."""
        out, p = [], base
        for level, up in zip(self.levels, self.up, strict=True):
            out.append(p[up])
            p = level.predictive(out[-1])
        return [*out, p]

    def run(self, base: np.ndarray, sweeps: int, burn_in: int, groups: int, rng: np.random.Generator) -> np.ndarray:
        """Sample seatings and return the mean of the longest contexts' probabilities after each sweep behind burn_in.

        At first every dish has one table; under the probabilities that follow, all customers then sit down one
        after the other. Each sweep moves all customers (see Level.move) from the longest contexts up; tables that open
        or close there send customers to the parents or take them back.
        """
        order = range(len(self.levels) - 1, -1, -1)
        for k in order:
            self.levels[k].one_table_each(self.rising(k))
        mean = np.zeros(len(self.customers))
        for s in range(sweeps):
            parents = self.predictive(base)
            for k in order:
                level = self.levels[k]
                if not s:
                    level.one_table_each(np.zeros(len(level.keys), np.int64))
                level.follow(self.rising(k), parents[k], rng)
                level.move(groups, parents[k], rng)
            if s >= burn_in:
                mean += self.predictive(base)[-1]
        return mean / (sweeps - burn_in)
