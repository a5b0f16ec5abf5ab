"""Cutting-stock patterns by column generation over a histogram of lengths."""

from __future__ import annotations

import numpy as np

#: Length classes of the linear program.
CLASSES = 192
#: The program ends when its value is within this share of the bound that the prices give.
GAP = 0.001
#: Far more exchanges of patterns than a program of CLASSES rows takes; reaching it is an error, not an end.
MOST_STEPS = 200_000


def length_classes(lengths: np.ndarray, counts: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """Upper edges of at most ``most`` length classes, denser where documents are.

    Edges stand at even steps of the cumulative root of the counts, which keeps
    the sum of (edge - length) low; every distinct length has its own class
    when there are few.
    """
    if len(lengths) <= most:
        return lengths.copy()
    steps = np.cumsum(np.sqrt(counts))
    ends = np.searchsorted(steps, np.linspace(0, steps[-1], most + 1)[1:] * (1 - 1e-12))
    return lengths[np.unique(np.minimum(ends, len(lengths) - 1))]


def price(edges: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Most valuable patterns within ``capacity`` by knapsack dynamic programming: the best of all, then the best that holds each class.

    Each class is added to the table of best values by capacity at once: along
    steps of its length, the best with any number of it is a running maximum of
    the best without, less that number's value.
    """
    m = len(edges)
    tables = np.empty((m + 1, capacity + 1))
    tables[0] = 0
    for c, (e, v) in enumerate(zip(edges.tolist(), values.tolist(), strict=True)):
        steps = -(-(capacity + 1) // e)
        padded = np.zeros(steps * e)
        padded[: capacity + 1] = tables[c]
        padded[capacity + 1 :] = tables[c, -1]
        gains = v * np.arange(steps)[:, None]
        tables[c + 1] = (np.maximum.accumulate(padded.reshape(steps, e) - gains, axis=0) + gains).ravel()[: capacity + 1]
    patterns = np.zeros((m + 1, m))
    room = np.r_[capacity, capacity - edges]
    patterns[np.arange(1, m + 1), np.arange(m)] = 1
    rows = np.arange(m + 1)
    for c in range(m - 1, -1, -1):  # all patterns are read back from the tables together
        live = rows
        while len(live):
            live = live[room[live] >= edges[c]]
            live = live[tables[c + 1, room[live]] > tables[c, room[live]] + 1e-12]
            patterns[live, c] += 1
            room[live] -= edges[c]
    return np.unique(patterns[1:], axis=0) if (patterns[0] == 0).all() else np.concatenate([patterns[:1], np.unique(patterns[1:], axis=0)])


def solve(edges: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is used in the linear program's solution.

    Revised simplex over the inverse basis; it starts from patterns of one
    class each. A round prices by the knapsack and goes on with the patterns
    found until none of them betters the solution. The value divided by the
    best price bounds every solution from below; it ends within GAP of that.
    """
    m = len(edges)
    start = capacity // edges
    basis, inverse = np.diag(start).astype(float), np.diag(1.0 / start)
    # a little more of each class, unlike the others, so that no two ratios tie
    used = (demand + 1e-7 * demand.sum() * np.random.default_rng(0).uniform(0.5, 1, m) / m) / start
    steps, pool = 0, np.zeros((0, m))
    while True:
        duals = inverse.sum(axis=0)
        found = price(edges, np.maximum(duals, 0), capacity)
        values = found @ duals
        if values.max() <= 1 + GAP:
            break
        pool = np.concatenate([pool[pool @ duals > 0.9], found])[-8 * m :]
        while True:
            values = pool @ duals
            best = int(values.argmax())
            if values[best] <= 1 + GAP / 10:
                break
            way = inverse @ pool[best]
            ratios = np.where(way > 1e-9, used / np.where(way > 1e-9, way, 1), np.inf)
            out = int(ratios.argmin())
            step = ratios[out]
            used = np.maximum(used - step * way, 0)
            used[out] = step
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
            basis[:, out] = pool[best]
            duals = inverse.sum(axis=0)
            steps += 1
            if steps > MOST_STEPS:
                raise RuntimeError("the program over patterns did not end")
    return basis, used


def fill(lengths: list[tuple[int, object]], capacity: int) -> list[list[object]]:
    """Best-fit decreasing: bins of the keys of ``lengths`` (length, key)."""
    import bisect

    room: list[tuple[int, int]] = []  # (free, bin), ascending
    bins: list[list[object]] = []
    for length, key in sorted(lengths, key=lambda x: -x[0]):
        k = bisect.bisect_left(room, (length, -1))
        if k < len(room):
            free, at = room.pop(k)
        else:
            free, at = capacity, len(bins)
            bins.append([])
        bins[at].append(key)
        if free > length:
            bisect.insort(room, (free - length, at))
    return bins


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, classes: int = CLASSES) -> dict[str, np.ndarray]:
    """Where documents go that are ranked by falling length.

    ``lengths`` ascend, each in 1 .. capacity. The solution's uses are rounded
    down; the documents this leaves, a bounded number at the short end of each
    class, fill further sequences by best-fit decreasing on their own lengths.

    Returns arrays: before (number of longer documents, by length index), and
    segments of ranks: start (ascending), base, per (documents of the segment
    in one sequence), slot; the document of rank r in segment s stands in
    sequence base[s] + (r - start[s]) // per[s] at place slot[s] + (r - start[s]) % per[s].
    """
    if not len(lengths):
        empty = np.zeros(0, np.int64)
        return {"before": empty, "start": empty, "base": empty, "per": empty, "slot": empty, "sequences": np.zeros(1, np.int64)}
    edges = length_classes(lengths, counts, classes)
    cls = np.searchsorted(edges, lengths)
    demand = np.bincount(cls, weights=counts, minlength=len(edges)).astype(np.int64)
    before = counts[::-1].cumsum()[::-1] - counts
    ahead = demand[::-1].cumsum()[::-1] - demand  # the longest class ranks first
    patterns, used = solve(edges, demand.astype(float), capacity)
    whole = np.floor(used + 1e-9).astype(np.int64)
    done, sequences, segments = np.zeros(len(edges), np.int64), 0, []
    for p in np.flatnonzero(whole):
        slot, times = 0, int(whole[p])
        # a pattern may be used too often for the last documents of a class
        while times and (done + patterns[:, p] * times > demand).any():
            with np.errstate(divide="ignore", invalid="ignore"):
                left = np.where(patterns[:, p] > 0, (demand - done) // np.maximum(patterns[:, p], 1), times)
            times = int(max(0, min(times, left.min())))
        if not times:
            continue
        for c in np.flatnonzero(patterns[:, p]):
            per = int(patterns[c, p])
            segments.append((ahead[c] + done[c], sequences, per, slot))
            done[c] += per * times
            slot += per
        sequences += times
    rest = []
    for c in np.flatnonzero(done < demand):
        left, rank = int(demand[c] - done[c]), int(ahead[c] + demand[c])
        for i in np.flatnonzero(cls == c):  # from the shortest up
            take = min(left, int(counts[i]))
            for _ in range(take):
                rank -= 1
                rest.append((int(lengths[i]), rank))
            left -= take
    for own in fill(rest, capacity):
        for slot, rank in enumerate(own):
            segments.append((rank, sequences, 1, slot))
        sequences += 1
    segments.sort()
    start, base, per, slot = (np.array(x, np.int64) for x in zip(*segments, strict=True))
    return {"before": before.astype(np.int64), "start": start, "base": base, "per": per, "slot": slot, "sequences": np.array([sequences])}
