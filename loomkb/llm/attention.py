"""A causal self-attention network in numpy: one head, one layer, on top of counts of symbol pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols of a window, symbols that a further window goes on (the rest is context) and components.
WINDOW, STRIDE, DIM = 24, 20, 16
#: Symbols, and groups they are dealt to; one more row of the embedding stands for a text's beginning.
SYMBOLS, GROUPS = 1024, 32
BEGIN = SYMBOLS
SHAPES = {
    "embed": (SYMBOLS + 1, DIM),
    "place": (WINDOW, DIM),
    "query": (DIM, DIM),
    "key": (DIM, DIM),
    "value": (DIM, DIM),
    "mixed": (DIM, DIM),
    "group": (DIM, GROUPS),
    "group0": (GROUPS,),
}
SIZES = {k: int(np.prod(s)) for k, s in SHAPES.items()}
PARAMETERS = sum(SIZES.values())
#: What keeps a symbol from those after it.
LATER = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
SCALE = np.float32(DIM**-0.5)
#: Bounds of the logits, so that no maximum need be taken off before powers are.
BOUND = np.float32(40)
ONES = np.ones((max(WINDOW, GROUPS), 1), np.float32)
#: Places of each symbol's components in one vector.
CELLS = np.arange(SIZES["embed"]).reshape(-1, DIM)
#: Windows that are scored together (their numbers stay in a core's cache).
BATCH = 256


def grouped(counts: np.ndarray, seed: int = 13) -> np.ndarray:
    """Groups of symbols that follow and are followed by like ones: k-means on the first singular vectors of the pairs' shares."""
    shares = lambda m: np.sqrt(m / np.maximum(m.sum(axis=1, keepdims=True), 1))
    m = np.concatenate([shares(counts[:SYMBOLS]), shares(counts.T)], axis=1)
    u, s, _ = np.linalg.svd(m @ m.T)
    x = u[:, :DIM] * np.sqrt(s[:DIM])
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(SYMBOLS, GROUPS, replace=False))]
    for _ in range(20):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        for g in range(GROUPS):
            if (near == g).any():
                centres[g] = x[near == g].mean(axis=0)
    return near


class Prior:
    """How often each symbol follows the one before it: logarithms for the groups, and for a symbol within its group."""

    def __init__(self, counts: np.ndarray):
        """``counts`` of the pairs (SYMBOLS + 1 x SYMBOLS); rare pairs lean on the symbols' own shares."""
        self.group_of = grouped(counts)
        share = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * SYMBOLS)
        lean = (counts > 0).sum(axis=1, keepdims=True) + 1.0
        p = (counts + lean * share) / (counts.sum(axis=1, keepdims=True) + lean)
        own = p @ np.eye(GROUPS)[self.group_of]
        self.group = np.log(np.maximum(own, 1e-30)).astype(np.float32)
        self.within = np.log(p / own[:, self.group_of]).astype(np.float32)


def initial(seed: int = 13) -> np.ndarray:
    """Parameters before training, as one vector: small random weights, nothing added to the logits."""
    rng = np.random.default_rng(seed)
    p = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    for k, size in {"embed": 0.5, "place": 0.1, "query": DIM**-0.5, "key": DIM**-0.5, "value": DIM**-0.5, "mixed": DIM**-0.5}.items():
        p[k] += rng.normal(0, size, SHAPES[k])
    return np.concatenate([p[k].ravel() for k in SHAPES])


def named(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters in one vector."""
    ends = np.cumsum(list(SIZES.values()))
    return {k: flat[end - SIZES[k] : end].reshape(SHAPES[k]) for k, end in zip(SHAPES, ends.tolist(), strict=True)}


class Space:
    """Arrays for a step over some windows, kept from step to step: making them anew takes longer than filling them."""

    def __init__(self, windows: int):
        n, f = windows, np.float32
        self.first, self.o = np.empty((n, WINDOW, DIM), f), np.empty((n, WINDOW, DIM), f)
        self.a, self.da = np.empty((n, WINDOW, WINDOW), f), np.empty((n, WINDOW, WINDOW), f)
        self.qkv, self.dqkv = np.empty((n * WINDOW, 3 * DIM), f), np.empty((n * WINDOW, 3 * DIM), f)
        self.out, self.dout, self.do, self.rows = (np.empty((n * WINDOW, DIM), f) for _ in range(4))
        self.z, self.before = np.empty((n * WINDOW, GROUPS), f), np.empty((n * WINDOW, GROUPS), f)
        self.size = np.empty((n * WINDOW, 1), f)


#: The spaces of the numbers of windows met lately.
SPACES: dict[int, Space] = {}


def _space(windows: int) -> Space:
    if windows not in SPACES:
        if len(SPACES) >= 4:
            SPACES.clear()
        SPACES[windows] = Space(windows)
    return SPACES[windows]


def _attended(p: dict[str, np.ndarray], x: np.ndarray) -> Space:
    """Masked attention over a batch of windows, with what a step back needs; valid until the next batch of as many windows."""
    s = _space(len(x))
    np.take(p["embed"], x, axis=0, out=s.first, mode="clip")
    s.first += p["place"]
    rows = s.first.reshape(-1, DIM)
    np.matmul(rows, _all_ways(p), out=s.qkv)
    q, k, v = _ways(s.qkv)
    np.matmul(q, k.transpose(0, 2, 1), out=s.a)
    np.clip(s.a, -BOUND, BOUND, out=s.a)
    s.a += LATER
    np.exp(s.a, out=s.a)
    np.matmul(s.a.reshape(-1, WINDOW), ONES[:WINDOW], out=s.size)
    np.matmul(s.a, v, out=s.o)
    o = s.o.reshape(-1, DIM)
    o /= s.size
    np.matmul(o, p["mixed"], out=s.out)
    s.out += rows
    return s


def _all_ways(p: dict[str, np.ndarray]) -> np.ndarray:
    """The matrices of query (scaled), key and value side by side."""
    return np.concatenate([p["query"] * SCALE, p["key"], p["value"]], axis=1)


def _ways(m: np.ndarray) -> tuple[np.ndarray, ...]:
    """Query, key and value of windows whose rows hold them side by side."""
    m = m.reshape(-1, WINDOW, 3 * DIM)
    return m[:, :, :DIM], m[:, :, DIM : 2 * DIM], m[:, :, 2 * DIM :]


def log_probabilities(p: dict[str, np.ndarray], prior: Prior, x: np.ndarray, y: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of the targets ``y`` at the places ``taken`` (flat) of the windows ``x``."""
    s, n = _attended(p, x), len(taken)
    before, z = x.ravel()[taken].astype(np.int64), s.z[:n]
    np.matmul(np.take(s.out, taken, axis=0, out=s.dout[:n], mode="clip"), p["group"], out=z)
    z += p["group0"]
    z += np.take(prior.group, before, axis=0, out=s.before[:n], mode="clip")
    np.clip(z, -BOUND, BOUND, out=z)
    own = z.ravel()[np.arange(0, z.size, GROUPS) + prior.group_of[y]]
    np.exp(z, out=z)
    return own - np.log(z @ ONES[:GROUPS])[:, 0] + prior.within.ravel()[before * SYMBOLS + y]


def log_scores(p: dict[str, np.ndarray], prior: Prior, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The natural logarithm of every symbol's probability, given those before it in its window.

    ``symbols`` are all texts' symbols, of which text i's end before ``ends[i]``;
    none is empty. A text's first window begins with the sign of a beginning and
    scores all of its places, a further one the last ``STRIDE`` places, so each
    symbol is scored once with at least WINDOW - STRIDE before it where there are.
    A window may run on beyond its text's end: those places are not scored, and
    the mask keeps them from the others.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    often = 1 + np.maximum(0, -(-(ends - starts - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(ends)), often)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(often) - often, often)
    begins, lows = starts[text] + nth * STRIDE, np.where(nth > 0, WINDOW - STRIDE, 0)
    highs = np.minimum(ends[text] - begins, WINDOW)
    shown = np.lib.stride_tricks.sliding_window_view(np.concatenate([[0], symbols, np.zeros(WINDOW)]).astype(np.int16), WINDOW)
    out, at, places = np.empty(len(symbols), np.float64), 0, np.arange(WINDOW)
    for low in range(0, len(text), BATCH):
        own = slice(low, low + BATCH)
        x, y = shown[begins[own]], shown[begins[own] + 1]
        x[nth[own] == 0, 0] = BEGIN
        taken = np.flatnonzero((places >= lows[own, None]) & (places < highs[own, None]))
        out[at : at + len(taken)] = log_probabilities(p, prior, x, y.ravel()[taken], taken)
        at += len(taken)
    return out


def gradient(p: dict[str, np.ndarray], prior: Prior, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean loss of the targets' groups over the places of weight 1, and its gradient as one vector."""
    flat = np.empty(PARAMETERS, np.float32)
    return _gradient(p, prior, x, y, weight, flat, named(flat)), flat


def _gradient(p: dict[str, np.ndarray], prior: Prior, x: np.ndarray, y: np.ndarray, weight: np.ndarray, flat: np.ndarray, d: dict[str, np.ndarray]) -> float:
    """The loss; the gradient goes to ``flat``, of which ``d`` are the views."""
    s, met = _attended(p, x), x.ravel().astype(np.int64)
    o, first = s.o.reshape(-1, DIM), s.first.reshape(-1, DIM)
    weight = weight.ravel().astype(np.float32)
    n, e = max(1.0, float(weight.sum())), s.z
    np.matmul(s.out, p["group"], out=e)
    e += p["group0"]
    e += np.take(prior.group, met, axis=0, out=s.before, mode="clip")
    np.clip(e, -BOUND, BOUND, out=e)
    np.exp(e, out=e)
    sums = (e @ ONES[:GROUPS])[:, 0]
    at, cells = np.arange(0, e.size, GROUPS) + prior.group_of[y.ravel()], e.ravel()
    loss = -float(np.log(np.maximum(cells[at] / sums, 1e-30)) @ weight) / n
    weight /= np.float32(n)
    e *= (weight / sums)[:, None]
    cells[at] -= weight
    np.matmul(s.out.T, e, out=d["group"])
    np.matmul(np.ones(len(e), np.float32), e, out=d["group0"])
    dout = np.matmul(e, p["group"].T, out=s.dout)
    np.matmul(o.T, dout, out=d["mixed"])
    do = np.matmul(dout, p["mixed"].T, out=s.do)
    # shares of the attention are a / size; the size divides the narrow rows instead, and what a row's shares take together is do times o
    do /= s.size
    taken = np.multiply(do, o, out=s.rows) @ ONES[:DIM]
    do = do.reshape(s.first.shape)
    (q, k, v), (dq, dk, dv) = _ways(s.qkv), _ways(s.dqkv)
    np.matmul(s.a.transpose(0, 2, 1), do, out=dv)
    np.matmul(do, v.transpose(0, 2, 1), out=s.da)
    da = s.da.reshape(-1, WINDOW)
    da -= taken
    s.da *= s.a
    np.matmul(s.da, k, out=dq)
    np.matmul(s.da.transpose(0, 2, 1), q, out=dk)
    ways = first.T @ s.dqkv
    np.multiply(ways[:, :DIM], SCALE, out=d["query"])
    d["key"][:], d["value"][:] = ways[:, DIM : 2 * DIM], ways[:, 2 * DIM :]
    dout += np.matmul(s.dqkv, _all_ways(p).T, out=s.rows)
    np.sum(dout.reshape(s.first.shape), axis=0, out=d["place"])
    d["embed"].fill(0)
    np.add.at(flat[: SIZES["embed"]], np.take(CELLS, met, axis=0).ravel(), dout.ravel())
    return loss


def trained(flat: np.ndarray, prior: Prior, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float) -> np.ndarray:
    """The parameters after an Adam step for each batch (inputs, targets, weights)."""
    flat = flat.copy()
    first, second, move, g = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), np.empty_like(flat)
    p, d = named(flat), named(g)
    for step, (x, y, weight) in enumerate(batches, 1):
        _gradient(p, prior, x, y, weight, g, d)
        first += np.multiply(np.subtract(g, first, out=move), np.float32(0.1), out=move)
        g *= g
        g -= second
        g *= np.float32(0.01)
        second += g
        np.sqrt(np.divide(second, np.float32(1 - 0.99**step), out=move), out=move)
        move += np.float32(1e-8)
        np.divide(first, move, out=move)
        move *= np.float32(rate / (1 - 0.9**step))
        flat -= move
    return flat
