"""A small causal self-attention language model in numpy, for operator 2: training and batched scoring.

One layer: a token attends to up to WINDOW tokens before and with it; its own embedding and that of the token before it reach the
output through full-rank skip tables too. The output is factored: a group by softmax, a member of the group by softmax, and the
token's frozen share of the member. Frequent tokens are members of their own; tokens with like neighbours are in one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Tokens of a window, and tokens that each window scores: all but the first window of a text re-read WINDOW - STRIDE as context.
WINDOW, STRIDE = 32, 16
WIDTH = 16
#: Groups, members of each, and those of them that are single tokens.
GROUPS, MEMBERS, SINGLE = 32, 32, 30
KNOWN = 4096  # tokens that the tables tell apart as input
STEPS, BATCH, RATE, SKIP_RATE = 800, 96, 0.02, 0.5
#: Windows of a step of the pass over all texts, and its rates for tables of rows and for the rest.
PASS_BATCH, ROW_RATE, PASS_RATE = 256, 0.05, 0.002
TABLES = ("skip", "skip2", "inner_skip", "inner_skip2")
ADAM = 1 << 14  # parameters that a step moves at a time: they stay in the cache
TOP = 256  # frequent ids that tell groups apart by their neighbourhood


@dataclass
class Attention:
    """``known`` maps ids to rows of the tables (0: any other id, 1: the start); ``cls`` maps ids to group * MEMBERS + member, and
    ``share`` to the log share of the member."""

    known: np.ndarray
    cls: np.ndarray
    share: np.ndarray
    q: np.ndarray  # rows x WIDTH, and so k and v
    k: np.ndarray
    v: np.ndarray
    pq: np.ndarray  # WINDOW x WIDTH
    pk: np.ndarray
    out: np.ndarray  # WIDTH x GROUPS
    skip: np.ndarray  # rows x GROUPS, from the token before; skip2 from the one before that
    skip2: np.ndarray
    inner: np.ndarray  # GROUPS x WIDTH x MEMBERS
    inner_skip: np.ndarray  # rows x GROUPS x MEMBERS
    inner_skip2: np.ndarray

    def log_probs(self, ids: np.ndarray, offsets: np.ndarray, batch: int = 512) -> np.ndarray:
        """Natural log probability of every token given those before it in its text (texts lie between offsets)."""
        # A text is read shifted by one, a start in front; windows of its positions score STRIDE targets each.
        n = np.diff(offsets)
        rows = np.ones(len(ids), np.int32)
        rows[1:] = self.known[ids[:-1]]
        rows[offsets[:-1][n > 0]] = 1
        per = -(-n // STRIDE)
        text = np.repeat(np.arange(len(n)), per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        first = offsets[:-1][text] + nth * STRIDE  # the first target of each window
        back = WINDOW - STRIDE
        at = first[:, None] + np.arange(-back, STRIDE)
        real = (at >= offsets[:-1][text][:, None]) & (at < offsets[1:][text][:, None])
        token = rows.take(at, mode="clip") if len(ids) else np.zeros(at.shape, np.int32)
        token *= real
        z = np.empty(len(ids), np.float32)
        group, member = (x.astype(np.uint8).take(ids) for x in np.divmod(self.cls, MEMBERS))  # bytes sort fast
        see = np.tril(np.ones((WINDOW, WINDOW), np.float32))[back:]
        ones = np.ones(WINDOW, np.float32)
        safe = np.linalg.norm(self.q, axis=1).max(initial=0) + np.linalg.norm(self.pq, axis=1).max()
        safe *= np.linalg.norm(self.k, axis=1).max(initial=0) + np.linalg.norm(self.pk, axis=1).max()
        inner_skip, inner_skip2 = (x.reshape(-1, MEMBERS) for x in (self.inner_skip, self.inner_skip2))
        whole = real.all(1)  # most windows lie within a text
        for full in (True, False):
            some = np.flatnonzero(whole == full)
            for i in range(0, len(some), batch):
                w = some[i : i + batch]
                t, r = token[w], real[w]
                # ``take`` moves rows several times faster than an index does.
                q, k, v = self.q.take(t[:, back:], 0), self.k.take(t, 0), self.v.take(t, 0)
                q += self.pq[back:]
                k += self.pk
                a = q @ k.transpose(0, 2, 1)
                if safe > 80:
                    np.minimum(a, 40, out=a)
                np.exp(a, out=a)
                a *= see if full else see * r[:, None]
                h = a @ v
                h *= (1 / (a.reshape(-1, WINDOW) @ ones + np.float32(1e-20))).reshape(*a.shape[:2], 1)
                mine, last, before = at[w, back:], t[:, back:], t[:, back - 1 : -1]
                h, mine, last, before = (x.reshape(-1, *x.shape[2:]) if full else x[r[:, back:]] for x in (h, mine, last, before))
                g = group.take(mine)
                order = np.argsort(g, kind="stable")  # members of a group are computed together
                h, mine, last, before, g = (x.take(order, 0) for x in (h, mine, last, before, g))
                g = g.astype(np.int32)
                outer = h @ self.out
                outer += self.skip.take(last, 0)
                outer += self.skip2.take(before, 0)
                inner = np.empty((len(g), MEMBERS), np.float32)
                cut = np.searchsorted(g, np.arange(GROUPS + 1))
                for c in np.flatnonzero(np.diff(cut)):
                    part = slice(cut[c], cut[c + 1])
                    np.matmul(h[part], self.inner[c], out=inner[part])
                inner += inner_skip.take(last * GROUPS + g, 0)
                inner += inner_skip2.take(before * GROUPS + g, 0)
                each = np.arange(len(mine)) * MEMBERS
                hit = outer.take(np.arange(len(mine)) * GROUPS + g)
                hit += inner.take(each + member.take(mine))
                z[mine] = hit - np.log((np.exp(outer, out=outer) @ ones[:GROUPS]) * (np.exp(inner, out=inner) @ ones[:MEMBERS]))
        return z + self.share.take(ids)


def token_keys(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What is counted of each token of texts that lie between offsets: its id."""
    return ids.astype(np.int64)


def neighbour_keys(ids: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each two adjacent tokens: the latter with the place of the former, and the former with the place of the latter."""
    inner = np.ones(max(0, len(ids) - 1), bool)
    ends = at[1:-1] - 1
    inner[ends[(ends >= 0) & (ends < len(inner))]] = False
    a, b = ids[:-1][inner].astype(np.int64), ids[1:][inner].astype(np.int64)
    width, other = 2 * int(place.max()) + 2, int(place.max()) + 1
    return np.concatenate((b * width + place[a], a * width + other + place[b]))


def bigram_keys(ids: np.ndarray, at: np.ndarray, known: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Of each token: the row of the token before it, or of the start, and its own class."""
    before = np.ones(len(ids), np.int64)
    before[1:] = known[ids[:-1]]
    before[at[:-1][np.diff(at) > 0]] = 1
    return before * (GROUPS * MEMBERS) + cls[ids]


def tally(texts: list[np.ndarray]):
    """The counts of keys of ``texts``: a function of (keys, their arguments) that gives (distinct keys, counts)."""
    ids = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return lambda keys, *args: np.unique(keys(ids, at, *args), return_counts=True)


def classes(near: np.ndarray, order: np.ndarray, rounds: int = 10) -> np.ndarray:
    """group * MEMBERS + member of every id; ``order`` lists the ids from the most frequent on, ``near`` counts their neighbours.

    Groups gather ids that follow and precede the same frequent ids. The most frequent ids fill the single members, each in the
    nearest group that has room; the others share the members left in their group, and ids that the texts do not hold are dealt
    round."""
    shared = MEMBERS - SINGLE
    deal = np.arange(len(order))
    cls = (deal % GROUPS * MEMBERS + SINGLE + deal // GROUPS % shared).astype(np.int32)
    held = order[near[order].any(1)]
    if not len(held):
        return cls
    x = np.sqrt(near[held])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[np.arange(GROUPS) % len(held)].copy()
    for _ in range(rounds):
        mine = (x @ centre.T).argmax(1)
        for c in np.unique(mine):
            centre[c] = np.sqrt(near[held[mine == c]].sum(0))
            centre[c] /= np.linalg.norm(centre[c])
    like, filled = x @ centre.T, np.zeros(GROUPS, int)
    for i, s in zip(held[: GROUPS * SINGLE], like, strict=False):
        g = int(np.where(filled < SINGLE, s, -1).argmax())
        cls[i] = g * MEMBERS + filled[g]
        filled[g] += 1
    rest = held[GROUPS * SINGLE :]
    cls[rest] = like[GROUPS * SINGLE :].argmax(1) * MEMBERS + SINGLE + np.arange(len(rest)) % shared
    return cls


def _softmax(x: np.ndarray, see: np.ndarray | None = None, weight: np.float32 = np.float32(1)) -> np.ndarray:
    """Along the last axis and in place; ``see`` weighs what is seen, ``weight`` is the sum."""
    if x.max(initial=0) > 60:
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    if see is not None:
        x *= see
    x *= (weight / (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], np.float32) + np.float32(1e-30))).reshape(*x.shape[:-1], 1)
    return x


_causal = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def slopes(p: dict[str, np.ndarray], token: np.ndarray, before: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Slopes of the mean loss of windows: of the parameters that all tokens share, and of the TABLES as (row of the flat table, slope)
    for each target. A target of -1 is none; ``before`` has the token before each."""
    token, before = token.reshape(-1).astype(np.int64), before.reshape(-1).astype(np.int64)
    shape = (*target.shape, WIDTH)
    q, k, v = ((p["e"] @ p[x]).take(token, 0).reshape(shape) for x in ("wq", "wk", "wv"))
    q += p["pq"]
    k += p["pk"]
    a = _softmax(q @ k.transpose(0, 2, 1), _causal)
    full = a @ v
    at = np.flatnonzero(target.reshape(-1) >= 0)  # only these positions have a target
    tg, tm = np.divmod(target.reshape(-1).take(at), MEMBERS)
    order = np.argsort(tg.astype(np.uint8), kind="stable")  # members of a group are computed together
    at, tg, tm = at.take(order), tg.take(order), tm.take(order)
    h, last, prior = full.reshape(-1, WIDTH).take(at, 0), token.take(at), before.take(at)
    n = len(h)
    inner_skip, inner_skip2 = (p[x].reshape(-1, MEMBERS) for x in TABLES[2:])
    one, two = last * GROUPS + tg, prior * GROUPS + tg
    d = h @ p["out"]
    d += p["skip"].take(last, 0)
    d += p["skip2"].take(prior, 0)
    cut = np.searchsorted(tg, np.arange(GROUPS + 1))
    held = [(c, slice(cut[c], cut[c + 1])) for c in np.flatnonzero(np.diff(cut))]
    di, dh_inner = np.empty((n, MEMBERS), np.float32), np.empty((n, WIDTH), np.float32)
    for c, part in held:
        np.matmul(h[part], p["inner"][c], out=di[part])
    di += inner_skip.take(one, 0)
    di += inner_skip2.take(two, 0)
    each, part_of_all = np.arange(n), np.float32(1 / max(1, n))
    for x, width, hit in ((d, GROUPS, tg), (di, MEMBERS, tm)):
        _softmax(x, weight=part_of_all).reshape(-1)[each * width + hit] -= part_of_all
    g = {"inner": np.zeros_like(p["inner"]), "out": h.T @ d}
    for c, part in held:
        np.matmul(h[part].T, di[part], out=g["inner"][c])
        np.matmul(di[part], p["inner"][c].T, out=dh_inner[part])
    dh_inner += d @ p["out"].T
    whole = np.zeros_like(full)
    whole.reshape(-1, WIDTH)[at] = dh_inner
    da = whole @ v.transpose(0, 2, 1)
    da -= np.einsum("bwd,bwd->bw", whole, full)[:, :, None]
    da *= a
    dq, dk, dv = da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ whole
    g["pq"], g["pk"] = dq.sum(0), dk.sum(0)
    # By row of the table first: it has fewer rows than there are tokens.
    g["e"] = np.zeros_like(p["e"])
    places = cells(token, WIDTH)
    for name, dx in (("wq", dq), ("wk", dk), ("wv", dv)):
        dx = by_cell(places, dx.reshape(-1, WIDTH), len(p["e"]))
        g[name] = p["e"].T @ dx
        g["e"] += dx @ p[name].T
    return g, {"skip": (last, d), "skip2": (prior, d), "inner_skip": (one, di), "inner_skip2": (two, di)}


def cells(row: np.ndarray, width: int) -> np.ndarray:
    """Where ``by_cell`` adds the columns of each row, two of them as one complex number."""
    return ((row * (width // 2))[:, None] + np.arange(width // 2)).reshape(-1)


def by_cell(places: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``x`` for each of ``rows`` rows, by ``cells``."""
    out = np.zeros((rows, x.shape[1]), np.float32)
    np.add.at(out.view(np.complex64).reshape(-1), places, np.ascontiguousarray(x, np.float32).view(np.complex64).reshape(-1))
    return out


def by_row(row: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of ``x`` for each."""
    seen = np.zeros(int(row.max(initial=-1)) + 1, bool)
    seen[row] = True
    rows = np.flatnonzero(seen)
    nth = np.empty(len(seen), np.int64)
    nth[rows] = np.arange(len(rows))
    return rows, by_cell(cells(nth.take(row), x.shape[1]), x, len(rows))


def whole_windows(ids: np.ndarray, at: np.ndarray, known: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, before, target) of windows that lie side by side: each token of the texts between offsets is a target once."""
    n = np.diff(at)
    row = np.ones(len(ids), np.int32)
    row[1:] = known[ids[:-1]]
    row[at[:-1][n > 0]] = 1
    ahead = np.zeros(len(ids), np.int32)
    ahead[1:] = row[:-1]
    ahead[at[:-1][n > 0]] = 0
    per = -(-n // WINDOW)
    place = np.arange(len(ids)) + np.repeat((np.cumsum(per) - per) * WINDOW - at[:-1], n)
    token, before, target = (np.full(int(per.sum()) * WINDOW, x, np.int32) for x in (0, 0, -1))
    token[place], before[place], target[place] = row, ahead, cls[ids]
    return tuple(x.reshape(-1, WINDOW) for x in (token, before, target))


def walk(p: dict[str, np.ndarray], parts: Iterator[tuple[np.ndarray, np.ndarray]], known: np.ndarray, cls: np.ndarray) -> int:
    """Steps from ``p``, in place, over all texts of ``parts`` (ids, offsets); says how many tokens they have. Rows of the tables move
    by the slopes that they have met so far (Adagrad), what all tokens share by Adam."""
    rng = np.random.default_rng(3)
    flat = {x: p[x].reshape(-1, p[x].shape[-1]) for x in TABLES}
    met = {x: np.full(len(v), 1e-8, np.float32) for x, v in flat.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in p.items() if k not in TABLES} for _ in range(2))
    tokens = step = 0
    for ids, at in parts:
        if not len(ids):
            continue
        tokens += len(ids)
        token, before, target = whole_windows(ids, at, known, cls)
        order = rng.permutation(len(token))
        for some in np.array_split(order, -(-len(order) // PASS_BATCH)):
            step += 1
            g, sparse = slopes(p, token[some], before[some], target[some])
            for name, (row, d) in sparse.items():
                row, d = by_row(row, d)
                far = met[name].take(row)
                far += np.einsum("nd,nd->n", d, d) / d.shape[1]
                met[name][row] = far
                d *= (ROW_RATE / np.sqrt(far))[:, None]
                flat[name][row] = np.subtract(flat[name].take(row, 0), d, out=d)
            for name, m in mean.items():
                m *= 0.9
                m += 0.1 * g[name]
                square[name] *= 0.99
                square[name] += 0.01 * g[name] ** 2
                p[name] -= PASS_RATE / (1 - 0.9**step) * m / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-6)
    return tokens


def train(texts: list[np.ndarray], vocabulary: int, steps: int | None = None, seed: int = 2, counted=None, passed: Callable | None = None) -> Attention:
    """Learns by Adam on random windows of the ids of ``texts``, from where ``passed`` goes on: it is given the parameters, ``known``,
    ``cls`` and the number of all tokens, and gives the parameters after steps over all texts. ``vocabulary`` counts all ids. ``counted`` gives the counts of all
    texts, as ``tally`` does. Without these two ``texts`` are all there is."""
    rng = np.random.default_rng(seed)
    counted = tally(texts) if counted is None else counted
    keys, c = counted(token_keys)
    count = np.zeros(vocabulary)
    count[keys] = c
    order = np.argsort(-count, kind="stable")
    top = min(TOP, vocabulary - 1)
    place = np.full(vocabulary, top)
    place[order[:top]] = np.arange(top)
    near = np.zeros((vocabulary, 2 * top + 2), np.float32)
    keys, c = counted(neighbour_keys, place)
    near.reshape(-1)[keys] = c
    cls = classes(near, order)
    del near
    smooth = count + 0.01
    share = np.log(smooth / np.bincount(cls, smooth, GROUPS * MEMBERS)[cls]).astype(np.float32)
    seen = order[: min(int((count > 2).sum()), KNOWN)]
    known = np.zeros(vocabulary, np.int32)
    known[seen] = 2 + np.arange(len(seen))
    rows = 2 + len(seen)
    # The skip tables start as smoothed counts of groups and members after a token.
    bigram = np.zeros(rows * GROUPS * MEMBERS, np.float32)
    keys, c = counted(bigram_keys, known, cls)
    bigram[keys] = c
    bigram = bigram.reshape(rows, GROUPS, MEMBERS)
    total = np.maximum(np.bincount(cls, smooth, GROUPS * MEMBERS), 1e-6).reshape(GROUPS, MEMBERS)
    pg, pm = total.sum(1) / total.sum(), total / total.sum(1, keepdims=True)
    groups = bigram.sum(2)
    p = {"skip": np.log((groups + 4 * pg) / (groups.sum(1, keepdims=True) + 4)).astype(np.float32), "inner_skip": np.log((bigram + 4 * pm) / (groups[:, :, None] + 4)).astype(np.float32)}
    del bigram
    p |= {"skip2": np.zeros_like(p["skip"]), "inner_skip2": np.zeros_like(p["inner_skip"])}
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    p |= {"e": small(rows, WIDTH) * 3, "wq": small(WIDTH, WIDTH) * 2, "wk": small(WIDTH, WIDTH) * 2, "wv": small(WIDTH, WIDTH) * 2, "pq": small(WINDOW, WIDTH), "pk": small(WINDOW, WIDTH), "out": small(WIDTH, GROUPS) * 0.3, "inner": small(GROUPS, WIDTH, MEMBERS) * 0.3}
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    long = [t for t in texts if len(t)]
    lengths = np.cumsum([float(len(t)) for t in long]) / max(1, sum(map(len, texts)))
    steps = STEPS if steps is None else steps

    def add(name: str, row: np.ndarray | slice, slope: np.ndarray) -> None:
        """Slopes enter the means before these fade, all in one pass over the parameters; rows without a slope only fade."""
        for means, part, x in ((mean, 0.1 / 0.9, slope), (square, 0.01 / 0.99, slope * slope)):
            x = x * np.float32(part)
            flat = means[name].reshape(-1, means[name].shape[-1])
            flat[row] += x.reshape(-1, flat.shape[1])

    for step in range(1, steps * bool(long) + 1):
        pick = np.minimum(np.searchsorted(lengths, rng.random(BATCH)), len(long) - 1)
        token, target = np.zeros((BATCH, WINDOW), np.int32), np.full((BATCH, WINDOW), -1)
        for b, j in enumerate(pick):
            t = long[j]
            s = int(rng.integers(0, max(1, len(t) - WINDOW // 2)))
            part = t[s : s + WINDOW]
            token[b, : len(part)] = known[t[s - 1 : s - 1 + len(part)]] if s else np.concatenate(([1], known[part[:-1]]))
            target[b, : len(part)] = cls[part]
        before = np.concatenate([np.zeros((BATCH, 1), np.int32), token[:, :-1]], 1)
        g, sparse = slopes(p, token, before, target)
        for name, (row, d) in sparse.items():
            row, d = by_row(row, d)
            add(name, row, d)
        for name, x in g.items():
            add(name, slice(None), x)
        rate = RATE * min(1, step / 20) * (1 - step / (steps + 1))
        for name in p:
            r = rate * (SKIP_RATE if "skip" in name else 1) / (1 - 0.9**step)
            for x, m, v in zip(*(np.array_split(y[name].reshape(-1), -(-p[name].size // ADAM)) for y in (p, mean, square)), strict=True):
                m *= 0.9
                v *= 0.99
                far = np.sqrt(v * (1 / (1 - 0.99**step)))
                far += 1e-6
                x -= np.divide(m, far, out=far) * r
    del mean, square
    if passed and steps:
        p = passed(p, known, cls, int(count.sum()))
    return Attention(known, cls, share, p["e"] @ p["wq"], p["e"] @ p["wk"], p["e"] @ p["wv"], p["pq"], p["pk"], p["out"], p["skip"], p["skip2"], p["inner"], p["inner_skip"], p["inner_skip2"])
