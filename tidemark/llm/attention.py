"""A small causal self-attention language model over subword ids, in numpy.

One head: each position asks those before it and itself, within a window, by
query and key vectors of the ids and a bias of their distance; what it hears
(value vectors) and its own vector give the shares of a mixture of ready
distributions over the ids, the last of which is that of what followed the
position's own id in the training texts. So a token costs a mixture, not a
softmax over the vocabulary, and probabilities still sum to 1.

Windows overlap: a window is a block of STEP positions and the block before
it as context; only the block's own positions are scored, each once.
"""

from __future__ import annotations

import numpy as np

STEP = 8
WIDTH = 2 * STEP
KEY, VALUE, MIX = 16, 20, 31
#: Columns of what is heard of an id: key, value and a one.
HEARD = KEY + VALUE + 1
#: Ids below this have a row of pair counts of their own; all others share that of RARE.
PAIR_ROWS = 1024
#: Weight of the unigram beside the counts of what follows an id.
PAIR_PRIOR = 5.0
#: Ids of the model: PAD (masked), START, END, RARE, then frequent subword ids.
PAD, START, END, RARE = range(4)
FIRST = 4
_F = np.float32
_REL = np.arange(STEP)[:, None] + STEP - np.arange(WIDTH)[None]  # distance of key from query; below 0 lies ahead
_CAUSAL = np.where(_REL >= 0, 0.0, -1e9).astype(_F)
LEARNT = ("query", "key", "value", "own", "bias", "share", "share0")


def start_model(unigram: np.ndarray, pairs: np.ndarray | None = None, seed: int = 5) -> dict[str, np.ndarray]:
    """Untrained parameters; `unigram` holds counts of the model's ids, `pairs` counts of an id (row) and the next one."""
    rng, n = np.random.default_rng(seed), len(unigram)
    uni = (unigram + 0.5) / (unigram + 0.5).sum()
    mass = uni[:, None] * rng.gamma(2.0, 0.5, size=(n, MIX)) * 1000.0
    free = uni.copy()
    free[[PAD, START]] = 0.0
    pairs = np.zeros((min(n, PAIR_ROWS), n), _F) if pairs is None else pairs
    share0 = np.zeros(MIX + 1, _F)
    share0[MIX] = 2.0  # what follows an id tells more than any component does at first
    return {
        "query": rng.normal(0, 0.1, (n, KEY)).astype(_F), "key": rng.normal(0, 0.1, (n, KEY)).astype(_F), "value": rng.normal(0, 0.1, (n, VALUE)).astype(_F), "own": rng.normal(0, 0.3, (n, VALUE)).astype(_F),
        "bias": (-0.2 * np.arange(WIDTH)).astype(_F), "share": rng.normal(0, 0.3, (VALUE, MIX + 1)).astype(_F), "share0": share0, "mass": mass.astype(_F), "uni": uni.astype(_F),
        "free": (free / free.sum()).astype(_F), "pair": pairs.astype(_F), "pair_sum": pairs.sum(1).astype(_F),
    }


def follows(model: dict[str, np.ndarray], asking: np.ndarray, targets: np.ndarray, less: float = 0.0) -> np.ndarray:
    """Smoothed share of each target among what followed the asking id; `less` is taken off the target's own count while it is learnt from."""
    x, y = asking.ravel(), targets.ravel()
    row = np.where(x < len(model["pair"]), x, RARE)
    n = np.maximum(model["pair"].ravel().take(row * model["pair"].shape[1] + y) - less, 0)
    return (n + PAIR_PRIOR * model["free"].take(y)) / (np.maximum(model["pair_sum"].take(row) - less, 0) + PAIR_PRIOR)


def distributions(model: dict[str, np.ndarray]) -> np.ndarray:
    """Each component's distribution over the ids (id by component), smoothed by the unigram."""
    mass = model["mass"] + 2.0 * model["uni"][:, None]
    mass[PAD] = mass[START] = 0.0
    return (mass / mass.sum(0)).astype(_F)


def to_blocks(ids: np.ndarray, counts: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows B x WIDTH, targets B x STEP, blocks of each text) of texts laid one after another, each with its END.

    Where `begins` is False a part of a text starts in the midst of it and has no START.
    """
    n_blocks = -(-counts // STEP)
    first = np.cumsum(n_blocks) - n_blocks
    total = int(n_blocks.sum())
    start = np.cumsum(counts) - counts
    place = np.repeat(first * STEP - start, counts) + np.arange(len(ids))
    targets = np.zeros(total * STEP, np.int32)
    targets[place] = ids
    inputs = np.zeros(total * STEP, np.int32)
    inputs[1:] = targets[:-1]
    some = np.flatnonzero(counts)
    inputs[first[some] * STEP] = START if begins is None else np.where(begins[some], START, RARE)
    inputs[targets == PAD] = PAD
    inputs, targets = inputs.reshape(-1, STEP), targets.reshape(-1, STEP)
    before = np.zeros_like(inputs)
    before[1:] = inputs[:-1]
    before[first[some]] = PAD
    return np.concatenate([before, inputs], axis=1), targets, n_blocks


def forward(model: dict[str, np.ndarray], dist: np.ndarray, windows: np.ndarray, targets: np.ndarray, less: float = 0.0) -> tuple[np.ndarray, dict]:
    """Probability of each target (1 where padded), and what the gradient needs."""
    asking = windows[:, STEP:]
    q, k, v = model["query"][asking], model["key"][windows], model["value"][windows]
    score = q @ k.transpose(0, 2, 1)
    score += (model["bias"][np.maximum(_REL, 0)] + _CAUSAL)[None]
    score += np.where(windows == PAD, _F(-1e9), _F(0))[:, None, :]
    score -= score.max(-1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(-1, keepdims=True)
    h = (score @ v + model["own"][asking]).reshape(-1, VALUE)
    share = h @ model["share"] + model["share0"]
    share -= share.max(-1, keepdims=True)
    np.exp(share, out=share)
    share /= share.sum(-1, keepdims=True)
    part = share * np.concatenate([dist[targets.ravel()], follows(model, asking, targets, less)[:, None]], axis=1)
    p = part.sum(-1)
    real = targets.ravel() != PAD
    return np.where(real, p, 1.0), {"asking": asking, "q": q, "k": k, "v": v, "att": score, "h": h, "share": share, "part": part, "p": p, "real": real}


def gradient(model: dict[str, np.ndarray], windows: np.ndarray, c: dict) -> tuple[dict, np.ndarray]:
    """Gradient of the mean log loss, and each component's responsibility for each target."""
    resp = c["part"] / np.maximum(c["p"], 1e-30)[:, None]
    resp[~c["real"]] = 0.0
    d_share = np.where(c["real"][:, None], c["share"] - resp, 0.0).astype(_F) / max(1, int(c["real"].sum()))
    out = {"share": c["h"].T @ d_share, "share0": d_share.sum(0)}
    d_h = (d_share @ model["share"].T).reshape(-1, STEP, VALUE)
    d_v = c["att"].transpose(0, 2, 1) @ d_h
    d_att = d_h @ c["v"].transpose(0, 2, 1)
    d_score = c["att"] * (d_att - (d_att * c["att"]).sum(-1, keepdims=True))
    by_rel = np.zeros(WIDTH, _F)
    np.add.at(by_rel, np.maximum(_REL, 0), np.where(_REL >= 0, d_score.sum(0), 0.0))
    out["bias"] = by_rel
    for name, index, d in (("query", c["asking"], d_score @ c["k"]), ("own", c["asking"], d_h), ("key", windows, d_score.transpose(0, 2, 1) @ c["q"]), ("value", windows, d_v)):
        out[name] = add_rows(index.ravel(), d.reshape(-1, d.shape[-1]), len(model[name]))
    return out, resp


def add_rows(index: np.ndarray, rows: np.ndarray, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """Sum of the rows of each index, added to `out` if given."""
    k = rows.shape[1]
    out = np.zeros(n * k, _F) if out is None else out.reshape(-1)
    # A complex number adds two columns in one step.
    kind, wide = (np.complex64, k // 2) if k % 2 == 0 else (_F, k)
    np.add.at(out.view(kind), (index.astype(np.int64)[:, None] * wide + np.arange(wide)).ravel(), np.ascontiguousarray(rows, _F).ravel().view(kind))
    return out.reshape(n, k)


def adam(model: dict, g: dict, m: dict, v: dict, rate: float, t: int) -> None:
    for k in g:
        m[k] += _F(0.1) * (g[k] - m[k])
        v[k] += _F(0.01) * (g[k] * g[k] - v[k])
        step = v[k] * _F(1 / (1 - 0.99**t))
        np.sqrt(step, out=step)
        step += _F(1e-8)
        np.divide(m[k], step, out=step)
        step *= _F(rate / (1 - 0.9**t))
        model[k] -= step


class Learner:
    """A pass over windows in a stream, as to_blocks() lays them: every window's responsibilities go into the masses, and every window moves the vectors, a block of them at a step.

    The ready distributions stay those of the start until all parts of the
    training texts are summed, as a step of expectation and maximisation has it.
    All vectors of an id lie in one row: key, value, a one that sums the weights
    (padding has none), query, own vector, a zero.
    """

    #: Windows of a step, and of what is worked on at once.
    BLOCK, PIECE = 4096, 512

    def __init__(self, model: dict, rate: float):
        self.given, self.rate, self.dist = model, rate, distributions(model)
        self.pairs, self.row = following(model, 1.0)
        n = len(model["query"])
        one, zero = np.ones((n, 1), _F), np.zeros((n, 1), _F)
        rows = np.concatenate([model["key"], model["value"], one, model["query"], model["own"], zero], axis=1)
        rows[PAD, KEY:HEARD] = 0.0
        self.tables = {"rows": rows, "share": np.concatenate([model["share"], model["share0"][None]]), "bias": model["bias"].copy()}
        self.comp = np.concatenate([self.dist, zero], axis=1)
        self.odds = np.zeros((n, MIX + 1), np.float64)
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.tables.items()} for _ in range(2))
        self.steps = self.windows = 0

    def learn(self, windows: np.ndarray, targets: np.ndarray) -> None:
        for lo in range(0, len(windows), self.BLOCK):
            w, y = windows[lo : lo + self.BLOCK], targets[lo : lo + self.BLOCK]
            self.steps += 1
            self.windows += len(w)
            adam(self.tables, self.gradient(w, y), self.m, self.v, self.rate, self.steps)

    def gradient(self, windows: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss by the tables, as the function of that name has it; the responsibilities go into the masses."""
        rows, share = self.tables["rows"], self.tables["share"]
        out = {k: np.zeros_like(x) for k, x in self.tables.items()}
        odds = np.zeros(self.odds.shape, _F)
        of_heard, of_asks = np.ascontiguousarray(rows[:, :HEARD]), np.ascontiguousarray(rows[:, HEARD:])
        bias, by_distance = self.tables["bias"][np.maximum(_REL, 0)] + _CAUSAL, np.zeros(_REL.shape, _F)
        each, ones = _F(1 / max(1, np.count_nonzero(targets))), np.ones(MIX + 1, _F)
        for lo in range(0, len(windows), self.PIECE):
            w, flat = windows[lo : lo + self.PIECE], targets[lo : lo + self.PIECE].ravel()
            asking, real = w[:, STEP:], (flat != PAD).astype(_F)
            heard, asks = of_heard.take(w, 0), of_asks.take(asking, 0)
            key, value, query = heard[..., :KEY], heard[..., KEY:], asks[..., :KEY]
            att = query @ key.transpose(0, 2, 1)
            att += bias
            _exp(att)
            att *= (w != PAD)[:, None, :]
            h = att @ value
            total = 1 / np.maximum(h[:, :, VALUE:], _F(1e-30))
            att *= total
            h *= total  # the last column becomes 1, for the last row of share
            h += asks[..., KEY:]
            h = h.reshape(-1, VALUE + 1)
            part, comp = _exp(h @ share), self.comp.take(flat, 0)
            comp[:, MIX] = self.pairs.take(self.row.take(asking.ravel()) + flat)
            by_p = (real / np.maximum(np.einsum("ij,ij->i", part, comp), _F(1e-30)))[:, None]
            comp *= part
            comp *= by_p * -each
            part *= by_p
            add_rows(flat, part, len(odds), odds)
            part *= (each / np.maximum(part @ ones, _F(1e-30)))[:, None]
            comp += part
            d_h = (comp @ share[:VALUE].T).reshape(-1, STEP, VALUE)
            d_score = d_h @ value[..., :VALUE].transpose(0, 2, 1)
            d_score -= np.einsum("bij,bij->bi", d_score, att)[..., None]
            d_score *= att
            d_rows = np.zeros((len(w), STEP, rows.shape[1]), _F)
            by_place, heard_by = d_score.transpose(0, 2, 1), att.transpose(0, 2, 1)
            d_key, d_value = d_rows[..., :KEY], d_rows[..., KEY : HEARD - 1]
            np.matmul(by_place[:, STEP:], query, out=d_key)
            np.matmul(heard_by[:, STEP:], d_h, out=d_value)
            # What a block hears of the one before it belongs to that block's own positions.
            key_before, value_before = by_place[:, :STEP] @ query, heard_by[:, :STEP] @ d_h
            d_key[:-1] += key_before[1:]
            d_value[:-1] += value_before[1:]
            np.add.at(out["rows"][:, : HEARD - 1], w[0, :STEP], np.concatenate([key_before[0], value_before[0]], axis=1))
            np.matmul(d_score, key, out=d_rows[..., HEARD : HEARD + KEY])
            d_rows[..., HEARD + KEY : -1] = d_h
            add_rows(asking.ravel(), d_rows.reshape(-1, rows.shape[1]), len(rows), out["rows"])
            out["share"] += h.T @ comp
            by_distance += d_score.sum(0)
        self.odds += odds
        np.add.at(out["bias"], np.maximum(_REL, 0), np.where(_REL >= 0, by_distance, 0.0))
        return out

    @property
    def model(self) -> dict[str, np.ndarray]:
        rows, share = self.tables["rows"], self.tables["share"]
        return self.given | {"key": rows[:, :KEY], "value": rows[:, KEY : HEARD - 1], "query": rows[:, HEARD : HEARD + KEY], "own": rows[:, HEARD + KEY : -1], "share": share[:VALUE], "share0": share[VALUE], "bias": self.tables["bias"]}

    @property
    def mass(self) -> np.ndarray:
        """Responsibilities by id and component: an id's share of a component is the same wherever it stands, so only the rest was summed."""
        return self.dist * self.odds[:, :MIX]


def train(model: dict[str, np.ndarray], windows: np.ndarray, targets: np.ndarray, rate: float, seed: int, passes: int = 1, batch: int = 512) -> dict[str, np.ndarray]:
    """Passes of Adam over the windows; the components' masses follow the responsibilities (online EM)."""
    model = model | {k: model[k].copy() for k in (*LEARNT, "mass")}
    m, v = ({k: np.zeros_like(model[k]) for k in LEARNT} for _ in range(2))
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(passes)])
    dist = distributions(model)
    steps = -(-len(order) // batch)
    fresh = np.zeros_like(model["mass"])
    for t, lo in enumerate(range(0, len(order), batch), 1):
        pick = order[lo : lo + batch]
        w, y = windows[pick], targets[pick]
        _, c = forward(model, dist, w, y, 1.0)
        g, resp = gradient(model, w, c)
        adam(model, g, m, v, rate * (1 - 0.9 * (t - 1) / steps), t)
        fresh = fresh * _F(1 - min(0.1, 1.0 / (1 + t / 4))) + add_rows(y.ravel(), resp, len(fresh))[:, :MIX]
        if t % 4 == 0 or t == steps:
            model["mass"] = fresh
            dist = distributions(model)
    return model


def ready(model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The tables of shares(): a column of ones behind the values sums the weights, and padding, all zeros, has none."""
    n = len(model["query"])
    value = np.concatenate([model["value"], np.ones((n, 1), _F)], axis=1)
    value[PAD] = 0.0
    return {
        "query": model["query"], "key": model["key"], "value": value, "own": np.concatenate([model["own"], np.zeros((n, 1), _F)], axis=1),
        "share": np.concatenate([model["share"], model["share0"][None]]), "bias": (model["bias"][np.maximum(_REL, 0)] + _CAUSAL)[None],
    }


def _exp(x: np.ndarray) -> np.ndarray:
    """exp in place, of 60 at most."""
    if x.max(initial=0.0) > 60.0:
        np.minimum(x, 60.0, out=x)
    return np.exp(x, out=x)


def shares(tables: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Shares of the mixture at each position, up to a factor: what forward() does, without what only the gradient needs; `tables` is ready() of the model."""
    asking = windows[:, STEP:]
    att = tables["query"].take(asking, 0) @ tables["key"].take(windows, 0).transpose(0, 2, 1)
    att += tables["bias"]
    h = _exp(att) @ tables["value"].take(windows, 0)
    h /= np.maximum(h[:, :, VALUE:], _F(1e-30))  # the last column becomes 1, for share0
    h += tables["own"].take(asking, 0)
    return _exp(h.reshape(-1, VALUE + 1) @ tables["share"])


def following(model: dict[str, np.ndarray], less: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """follows() for every row and target at once: (the table as one array, where each id's row begins in it)."""
    n = np.maximum(model["pair"] - _F(less), 0)
    n += _F(PAIR_PRIOR) * model["free"]
    n /= (np.maximum(model["pair_sum"] - less, 0) + PAIR_PRIOR).astype(_F)[:, None]
    ids = np.arange(len(model["free"]))
    return n.ravel(), np.where(ids < len(model["pair"]), ids, RARE) * n.shape[1]


def log10_probabilities(model: dict[str, np.ndarray], dist: np.ndarray, windows: np.ndarray, targets: np.ndarray, chunk: int = 1024, table: tuple | None = None) -> np.ndarray:
    """Sum of log10 probabilities of each window's targets; `table` is following() of the model."""
    out = np.zeros(len(windows))
    pairs, row = table or following(model)
    tables, ones = ready(model), np.ones(MIX + 1, _F)
    for lo in range(0, len(windows), chunk):
        w, y = windows[lo : lo + chunk], targets[lo : lo + chunk].ravel()
        share = shares(tables, w)
        p = np.einsum("ij,ij->i", share[:, :MIX], dist.take(y, 0))
        p += share[:, MIX] * pairs.take(row.take(w[:, STEP:].ravel()) + y)
        p /= share @ ones
        p[y == PAD] = 1.0
        out[lo : lo + chunk] = np.log10(np.maximum(p, 1e-30, out=p), out=p).reshape(-1, STEP).sum(1, dtype=np.float64)
    return out
