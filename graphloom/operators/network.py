"""The graph network that scores a whole graph (L01-L05): its forward pass and gradients in numpy, one graph at a time.

Rooms are projected, then every layer adds the normalised, rectified sum of what the relations bring: a linear map of the
mean over a room's neighbours and one of the room itself. A relation takes part in a graph where it has edges, in
both directions with weights of their own. The mean over all rooms goes to one head a task. Environment nodes receive messages
but send none, so no head depends on them and they are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: The room-room relations, and the tasks that a trained scorer has heads for.
RELATIONS = ("physical", "acoustic", "sight")
TASKS = (
    "circulation_efficiency", "fire_safety_margin", "graph_robustness", "path_redundancy", "zone_cohesion", "stair_service_radius",
    "toilet_coverage", "local_evacuation_loop", "classroom_south_cluster", "overall_quality",
)
EPS = 1e-5


class Means:
    """Means over the sources of each destination's edges (repeated edges count again), and the way back for gradients."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        by, back = np.argsort(dst, kind="stable"), np.argsort(src, kind="stable")
        self.n, self.src, self.dst = n, src[by], dst[back]
        self.to, self.first, count = np.unique(dst[by], return_index=True, return_counts=True)
        self.origin, self.start = np.unique(src[back], return_index=True)
        self.share = np.zeros((n, 1))
        self.share[self.to, 0] = 1 / count

    def forward(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros_like(h)
        out[self.to] = np.add.reduceat(h[self.src], self.first, axis=0)
        return out * self.share

    def backward(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(g)
        out[self.origin] = np.add.reduceat((g * self.share)[self.dst], self.start, axis=0)
        return out


def directed(n: int, links: dict[str, tuple[np.ndarray, np.ndarray]], relations: tuple[str, ...] = RELATIONS) -> dict[str, Means]:
    """Both directions of the relations that have edges; links: relation -> (source positions, destination positions)."""
    out = {}
    for rel in relations:
        s, d = links.get(rel, ((), ()))
        if len(s):
            out[rel] = Means(np.asarray(s, np.int64), np.asarray(d, np.int64), n)
            out[f"rev_{rel}"] = Means(np.asarray(d, np.int64), np.asarray(s, np.int64), n)
    return out


class Network:
    """Weights as one vector with named views, so that a step adds gradients as vectors."""

    def __init__(self, tasks: tuple[str, ...] = TASKS, relations: tuple[str, ...] = RELATIONS, dims: int = 27, hidden: int = 128, layers: int = 3, head: int = 64, dropout: float = 0.2, seed: int = 1):
        self.tasks, self.relations, self.layers, self.hidden, self.dropout = tuple(tasks), tuple(relations), layers, hidden, dropout
        shapes: dict[str, tuple[int, ...]] = {"room.w": (dims, hidden), "room.b": (hidden,)}
        for k in range(layers):
            for rel in [x for r in self.relations for x in (r, f"rev_{r}")]:
                shapes |= {f"{k}.{rel}.near": (hidden, hidden), f"{k}.{rel}.b": (hidden,), f"{k}.{rel}.own": (hidden, hidden)}
            shapes |= {f"{k}.norm.w": (hidden,), f"{k}.norm.b": (hidden,)}
        for t in self.tasks:
            shapes |= {f"{t}.a": (hidden, head), f"{t}.c": (head,), f"{t}.b": (head, 1), f"{t}.d": (1,)}
        self.shapes = shapes
        self.size = sum(int(np.prod(s)) for s in shapes.values())
        rng, parts = np.random.default_rng(seed), []
        for name, s in shapes.items():
            reach = 1 / np.sqrt(s[0]) if len(s) == 2 else 0.0
            parts.append(np.ones(s) if name.endswith("norm.w") else rng.uniform(-reach, reach, s) if reach else np.zeros(s))
        self.load(np.concatenate([p.ravel() for p in parts]))

    def views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, s in self.shapes.items():
            n = int(np.prod(s))
            out[name] = vector[at : at + n].reshape(s)
            at += n
        return out

    def load(self, vector: np.ndarray) -> Network:
        self.vector = np.asarray(vector, np.float64)
        self.p = self.views(self.vector)
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "p"}  # views would be pickled as copies

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.load(self.vector)

    def embed(self, x: np.ndarray, means: dict[str, Means], rng: np.random.Generator | None = None, keep: list | None = None) -> np.ndarray:
        """Room embeddings. rng: dropout for training; keep: receives what `backward` needs."""
        p = self.p
        h = x @ p["room.w"] + p["room.b"]
        for k in range(self.layers if means else 0):
            near = {r: m.forward(h) for r, m in means.items()}
            own = sum(p[f"{k}.{r}.own"] for r in means)
            out = h @ own + sum(p[f"{k}.{r}.b"] for r in means)
            for r, m in near.items():
                out += m @ p[f"{k}.{r}.near"]
            c = out - out.mean()  # normalised over all rooms and columns of the graph
            s = np.sqrt((c * c).mean())
            z = c / (s + EPS)
            y = z * p[f"{k}.norm.w"] + p[f"{k}.norm.b"]
            gate = (y > 0).astype(np.float64)
            if rng is not None and self.dropout:
                gate *= (rng.random(y.shape) >= self.dropout) / (1 - self.dropout)
            if keep is not None:
                keep.append((h, near, own, c, s, z, gate))
            h = h + y * gate
        return h

    def forward(self, x: np.ndarray, means: dict[str, Means], rng: np.random.Generator | None = None, keep: list | None = None) -> np.ndarray:
        """One score in (0, 1) a task."""
        m = self.embed(x, means, rng, keep).mean(0)
        out = np.zeros(len(self.tasks))
        heads = []
        for i, t in enumerate(self.tasks):
            u = m @ self.p[f"{t}.a"] + self.p[f"{t}.c"]
            gate = (u > 0).astype(np.float64)
            if rng is not None and self.dropout:
                gate *= (rng.random(u.shape) >= self.dropout) / (1 - self.dropout)
            v = (u * gate) @ self.p[f"{t}.b"] + self.p[f"{t}.d"]
            out[i] = 1 / (1 + np.exp(-v[0]))
            heads.append((u * gate, gate))
        if keep is not None:
            keep.append((x, m, heads, out))
        return out

    def scorer(self, x: np.ndarray, means: dict[str, Means]) -> Callable[[np.ndarray], np.ndarray]:
        """`forward` for many masks (n rows of 0 or 1) of one graph's features: what does not depend on the mask is computed once."""
        p, n, count = self.p, len(x), len(means)
        first = x @ p["room.w"]
        layers = []
        if means:
            # Row src * count + r of a layer's messages is what relation r brings from src; all relations' edges are added in one pass.
            row = np.concatenate([m.src * count + r for r, m in enumerate(means.values())])
            into = np.concatenate([np.repeat(m.to, np.diff(np.append(m.first, len(m.src)))) for m in means.values()])
            share = np.concatenate([np.repeat(m.share[m.to], np.diff(np.append(m.first, len(m.src))), axis=0) for m in means.values()])
            by = np.argsort(into, kind="stable")
            row, share = row[by], share[by]
            to, at = np.unique(into[by], return_index=True)
            for k in range(self.layers):
                near = np.hstack([p[f"{k}.{r}.near"] for r in means])
                own, bias = sum(p[f"{k}.{r}.own"] for r in means), sum(p[f"{k}.{r}.b"] for r in means)
                layers.append((near, own, bias, p[f"{k}.norm.w"], p[f"{k}.norm.b"]))
        a, c = np.hstack([p[f"{t}.a"] for t in self.tasks]), np.concatenate([p[f"{t}.c"] for t in self.tasks])
        b, d = np.vstack([p[f"{t}.b"].T for t in self.tasks]), np.concatenate([p[f"{t}.d"] for t in self.tasks])

        def score(kept: np.ndarray) -> np.ndarray:
            h = first * kept + p["room.b"]
            for near, own, bias, w, shift in layers:
                out = h @ own
                out += bias
                out[to] += np.add.reduceat((h @ near).reshape(n * count, -1)[row] * share, at, axis=0)
                out -= out.mean()
                out *= w / (np.sqrt(np.vdot(out, out) / out.size) + EPS)
                out += shift
                h += np.maximum(out, 0, out=out)
            u = np.maximum(h.mean(0) @ a + c, 0).reshape(b.shape)
            return 1 / (1 + np.exp(-((u * b).sum(1) + d)))

        return score

    def backward(self, means: dict[str, Means], kept: list, slope: np.ndarray, into: np.ndarray | dict[str, np.ndarray]) -> None:
        """Add the gradient of sum(slope * scores) to `into`, a vector of `size` or its views; kept comes from `forward`."""
        p, g = self.p, into if isinstance(into, dict) else self.views(into)
        x, m, heads, out = kept[-1]
        dm = np.zeros_like(m)
        for i, t in enumerate(self.tasks):
            if slope[i] == 0:
                continue
            r, gate = heads[i]
            dv = slope[i] * out[i] * (1 - out[i])
            g[f"{t}.b"][:, 0] += dv * r
            g[f"{t}.d"][0] += dv
            du = dv * p[f"{t}.b"][:, 0] * gate
            g[f"{t}.a"] += np.outer(m, du)
            g[f"{t}.c"] += du
            dm += p[f"{t}.a"] @ du
        dh = np.broadcast_to(dm / len(x), (len(x), self.hidden)).copy()
        for k in reversed(range(len(kept) - 1)):
            h, near, own, c, s, z, gate = kept[k]
            dy = dh * gate
            g[f"{k}.norm.w"] += (dy * z).sum(0)
            g[f"{k}.norm.b"] += dy.sum(0)
            dz = dy * p[f"{k}.norm.w"]
            dc = dz / (s + EPS)
            if s > 0:
                dc -= c * ((dz * c).sum() / ((s + EPS) ** 2 * s * c.size))
            do = dc - dc.mean()
            down, db = h.T @ do, do.sum(0)
            dh = dh + do @ own.T
            for r, mean in near.items():
                g[f"{k}.{r}.own"] += down
                g[f"{k}.{r}.b"] += db
                g[f"{k}.{r}.near"] += mean.T @ do
                dh += means[r].backward(do @ p[f"{k}.{r}.near"].T)
        g["room.w"] += x.T @ dh
        g["room.b"] += dh.sum(0)


def ranking(scores: np.ndarray, targets: np.ndarray, margin: float = 0.05) -> tuple[float, np.ndarray]:
    """(loss, its slope in the scores) of rows of graphs by columns of tasks; targets may hold NaN.

    Per task the mean of max(0, margin - (better - worse)) over pairs of different targets, then the mean over tasks.
    """
    loss, slope, tasks = 0.0, np.zeros_like(scores), max(1, int((~np.isnan(targets)).any(0).sum()))
    for t in range(scores.shape[1]):
        i, j = np.nonzero(targets[:, t][:, None] - targets[:, t][None] > 1e-6)
        if len(i):
            short = margin - (scores[i, t] - scores[j, t])
            loss += np.maximum(0, short).mean() / tasks
            share = (short > 0) / (len(i) * tasks)
            slope[:, t] += np.bincount(j, share, len(scores)) - np.bincount(i, share, len(scores))
    return loss, slope
