"""Clustering and decomposition in NumPy, for matrices that fit one task; seeds make every run repeatable.

A row may stand for several equal ones: w holds how many (or how much) each row counts, and every figure is that of the
rows written out. Memory grows with rows times columns only; Ward and spectral clustering, and the silhouette, compare all
pairs of rows, block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Pairs of rows that a method which compares them all takes on: minutes of one task.
MAX_PAIRS = 10_000_000_000
#: Rows up to which the affinity of spectral clustering is one matrix.
DENSE = 2000


def pairs_fit(x: np.ndarray) -> None:
    if len(x) ** 2 > MAX_PAIRS:
        raise ValueError(f"{len(x)} rows are too many for a method that compares all pairs of them")


def _ones(x: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    return np.ones(len(x)) if w is None else np.asarray(w, float)


def squared_distances(a: np.ndarray, b: np.ndarray, columns: int = 12) -> np.ndarray:
    """Of all rows of a to all of b. Few columns are taken one by one; of more by products, and where these would lose
    digits (rows that nearly agree) again by differences."""
    out = np.zeros((len(a), len(b)))
    if a.shape[1] <= columns:
        for j in range(a.shape[1]):
            d = a[:, j, None] - b[None, :, j]
            d *= d
            out += d
        return out
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
    np.matmul(a, -2 * b.T, out=out)
    out += size
    i, j = np.nonzero(out < 1e-6 * size)
    for at in range(0, len(i), 100_000):
        p, q = i[at : at + 100_000], j[at : at + 100_000]
        out[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return np.maximum(out, 0, out=out)


def blocks(rows: int, of: int, cells: int = 4_000_000) -> list[slice]:
    """Slices of rows whose products with all of the others have some millions of cells."""
    step = max(1, cells // max(1, of))
    return [slice(i, min(rows, i + step)) for i in range(0, rows, step)]


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    chols: np.ndarray
    loglik: float
    converged: bool

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.chols)):
            z = np.linalg.solve(c, (x - m).T)
            out[:, k] = np.log(max(w, 1e-300)) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + (z * z).sum(0)) - np.log(np.diag(c)).sum()
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels, and the largest posterior of each row."""
        j = self.log_joint(x)
        top = j.max(1)
        return j.argmax(1), 1 / np.exp(j - top[:, None]).sum(1)

    def bic(self, n: float) -> float:
        """Of n rows."""
        k, d = self.means.shape
        return float(-2 * self.loglik + (k * d + k * d * (d + 1) / 2 + k - 1) * np.log(n))


def kmeans(x: np.ndarray, k: int, seed: int = 0, n_init: int = 10, max_iter: int = 300, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, centres and inertia of the best of n_init starts by k-means++."""
    best, w = None, _ones(x, w)
    for start in range(n_init):
        rng = np.random.default_rng((seed, start))
        centres = x[[rng.choice(len(x), p=w / w.sum())]]
        for _ in range(1, k):
            d2 = squared_distances(x, centres).min(1) * w
            p = d2 / d2.sum() if d2.sum() > 0 else w / w.sum()
            centres = np.vstack([centres, x[[rng.choice(len(x), p=p)]]])
        labels = None
        for _ in range(max_iter):
            d2 = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None])
            new = d2.argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            for j in range(k):
                if (labels == j).any():
                    centres[j] = w[labels == j] @ x[labels == j] / w[labels == j].sum()
                else:
                    centres[j] = x[d2.min(1).argmax()]
        inertia = float(w @ ((x - centres[labels]) ** 2).sum(1))
        if best is None or inertia < best[2]:
            best = labels, centres, inertia
    return best


def gmm(x: np.ndarray, k: int, seed: int = 0, n_init: int = 10, reg: float = 1e-6, max_iter: int = 100, tol: float = 1e-3, w: np.ndarray | None = None) -> Mixture:
    """Full covariances with reg on the diagonal; starts from k-means; the best log-likelihood of n_init starts."""
    d, w = x.shape[1], _ones(x, w)
    n, best = w.sum(), None
    for start in range(n_init):
        r = np.eye(k)[kmeans(x, k, seed * 1009 + start, n_init=1, w=w)[0]]
        last, done, model = -np.inf, False, None
        for _ in range(max_iter):
            r = r * w[:, None]
            nk = r.sum(0) + 10 * np.finfo(float).eps
            means = r.T @ x / nk[:, None]
            chols = np.empty((k, d, d))
            for j in range(k):
                y = x - means[j]
                chols[j] = np.linalg.cholesky((r[:, j, None] * y).T @ y / nk[j] + reg * np.eye(d))
            model = Mixture(nk / n, means, chols, -np.inf, False)
            joint = model.log_joint(x)
            top = joint.max(1, keepdims=True)
            norm = top[:, 0] + np.log(np.exp(joint - top).sum(1))
            r = np.exp(joint - norm[:, None])
            model.loglik = float(w @ norm)
            if abs(model.loglik - last) / n < tol:
                done = True
                break
            last = model.loglik
        model.converged = done
        if best is None or model.loglik > best.loglik:
            best = model
    return best


def ward(x: np.ndarray, k: int, w: np.ndarray | None = None) -> np.ndarray:
    """Agglomerative clustering by the smallest growth of the sum of squares, by nearest-neighbour chains. A cluster is its
    centre and its size, from which distances are worked out, so that no matrix of pairs is held."""
    pairs_fit(x)
    n = len(x)
    parent, merges, chain = list(range(n)), [], []
    # The clusters that are left, in the order of their smallest rows, with places for those that are gone until half are.
    own, c, size, alive = np.arange(n), np.array(x, float), _ones(x, w).copy(), np.ones(n, bool)
    place, left = np.arange(n), n  # of a row's cluster in those arrays
    while left > 1:
        if left * 2 < len(own):
            own, c, size = own[alive], c[alive], size[alive]
            place[own], alive = np.arange(left), np.ones(left, bool)
        if not chain:
            chain = [int(own[alive.argmax()])]
        a = place[chain[-1]]
        d = squared_distances(c[[a]], c)[0] * (2 * size[a] * size / (size[a] + size))
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(d.argmin())
        if len(chain) > 1 and d[place[chain[-2]]] <= d[b]:
            b = place[chain[-2]]
            chain = chain[:-2]
            a, b = min(a, b), max(a, b)
            merges.append((d[b] if np.isfinite(d[b]) else d[a], int(own[a]), int(own[b])))
            c[a] = (size[a] * c[a] + size[b] * c[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
            left -= 1
        else:
            chain.append(int(own[b]))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def spectral(x: np.ndarray, k: int, seed: int = 0, gamma: float = 1.0, w: np.ndarray | None = None) -> np.ndarray:
    """k-means on the leading eigenvectors of the normalised rbf affinity."""
    pairs_fit(x)
    w = _ones(x, w)
    rows = blocks(len(x), len(x))
    times = lambda v: np.vstack([np.exp(-gamma * squared_distances(x[b], x)) @ v for b in rows])
    root = 1 / np.sqrt(np.maximum(times(w[:, None])[:, 0], 1e-12))
    side = root * np.sqrt(w)
    if len(x) <= DENSE:
        v = np.linalg.eigh(times(np.eye(len(x))) * side[:, None] * side[None])[1][:, -k:]
    else:
        v = _leading(lambda v: side[:, None] * times(side[:, None] * v), len(x), k, seed)
    return kmeans(v / np.sqrt(w)[:, None] * root[:, None], k, seed, w=w)[0]


def _leading(times, n: int, k: int, seed: int, tol: float = 1e-8, max_iter: int = 200) -> np.ndarray:
    """The k leading eigenvectors, ascending, of a matrix without negative eigenvalues that is only multiplied with: the
    space of the last vectors, their products and the last step."""
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, k + 8)))[0]
    before = v[:, :0]
    for _ in range(max_iter):
        mv = times(v)
        values, u = np.linalg.eigh(v.T @ mv)
        v, mv = v @ u, mv @ u
        if np.abs(mv - v * values)[:, -k:].max() < tol * max(values[-1], 1e-300):
            break
        q = np.linalg.qr(np.hstack([mv, before]))[0] if before.size else np.linalg.qr(mv)[0]
        mq = times(q)
        u = np.linalg.eigh(q.T @ mq)[1][:, -(k + 8) :]
        before, v = v, q @ u
    return v[:, -k:]


def pca(x: np.ndarray, k: int, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, components and variance ratios; the largest loading of a component is positive."""
    w = _ones(x, w)
    c = x - w @ x / w.sum()
    _, s, vt = np.linalg.svd(c * np.sqrt(w)[:, None], full_matrices=False)
    vt = vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])[:, None]
    total = (s * s).sum()
    return c @ vt[:k].T, vt[:k], s[:k] ** 2 / total if total else s[:k]


def nmf(x: np.ndarray, k: int, iterations: int = 500, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors by multiplicative updates, from singular vectors whose zeros are filled with the mean."""
    x, many = np.maximum(x, 0), _ones(x, w)
    x = np.where(x == 0, 1e-10, x)
    u, s, vt = np.linalg.svd(x * np.sqrt(many)[:, None], full_matrices=False)
    u = u / np.sqrt(many)[:, None]  # the entries of rows written out
    w, h = np.zeros((len(x), k)), np.zeros((k, x.shape[1]))
    for j in range(min(k, len(s))):
        a, b = u[:, j], vt[j]
        plus, minus = (np.maximum(a, 0), np.maximum(b, 0)), (np.maximum(-a, 0), np.maximum(-b, 0))
        norm = lambda p: np.sqrt(many @ (p * p))
        size = [norm(p) * np.linalg.norm(q) for p, q in (plus, minus)]
        (p, q), m = (plus, size[0]) if size[0] >= size[1] else (minus, size[1])
        if m > 0:
            w[:, j], h[j] = np.sqrt(s[j] * m) * p / norm(p), np.sqrt(s[j] * m) * q / np.linalg.norm(q)
    mean = many @ x.mean(1) / many.sum()
    w[w == 0], h[h == 0] = mean, mean
    for _ in range(iterations):
        counted = (w * many[:, None]).T
        h *= (counted @ x) / np.maximum(counted @ w @ h, 1e-12)
        w *= (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
    return w, h


def distance_sums(x: np.ndarray, of: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The sums of the distances of each row of x to the rows of ``of``, by the columns of one, which tell how much each of
    them counts for a label."""
    out = np.zeros((len(x), one.shape[1]))
    for b in blocks(len(x), 4096):
        for c in range(0, len(of), 4096):
            out[b] += np.sqrt(squared_distances(x[b], of[c : c + 4096])) @ one[c : c + 4096]
    return out


def silhouettes(sums: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of rows with these sums of distances by label; own is each one's label, size how many rows a label has."""
    rows = np.arange(len(own))
    a = sums[rows, own] / np.maximum(size[own] - 1, 1)
    other = sums / np.maximum(size, 1)
    other[rows, own] = np.inf
    b = other.min(1)
    return np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)


def quality(x: np.ndarray, labels: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """Silhouette, Calinski-Harabasz, Davies-Bouldin; (0, 0, inf) without two clusters or with one for each row."""
    w = _ones(x, w)
    names, y = np.unique(labels, return_inverse=True)
    k, n = len(names), w.sum()
    if k < 2 or k >= n:
        return 0.0, 0.0, float("inf")
    one = np.eye(k)[y] * w[:, None]
    size = one.sum(0)
    silhouette = w @ silhouettes(distance_sums(x, x, one), y, size) / n
    centres = one.T @ x / size[:, None]
    spread = ((x - centres[y]) ** 2).sum(1)
    between = (size * ((centres - w @ x / n) ** 2).sum(1)).sum()
    ch = between / (k - 1) / max(w @ spread / (n - k), 1e-300)
    s = np.bincount(y, w * np.sqrt(spread)) / size
    gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    ratio = np.divide(s[:, None] + s[None], gap, out=np.zeros_like(gap), where=gap > 0)
    return float(silhouette), float(ch), float(ratio.max(1).mean())


ALGORITHMS = ("gmm", "kmeans", "hierarchical", "spectral")


def cluster(x: np.ndarray, k: int, algorithm: str = "gmm", seed: int = 0, n_init: int = 10, w: np.ndarray | None = None) -> tuple[np.ndarray, float | None, bool]:
    """Labels, BIC (of a mixture) and whether it converged."""
    if algorithm == "gmm":
        m = gmm(x, k, seed, n_init, w=w)
        return m.predict(x)[0], m.bic(_ones(x, w).sum()), m.converged
    if algorithm == "kmeans":
        return kmeans(x, k, seed, n_init, w=w)[0], None, True
    if algorithm == "hierarchical":
        return ward(x, k, w), None, True
    if algorithm == "spectral":
        return spectral(x, k, seed, w=w), None, True
    raise ValueError(f"unknown algorithm {algorithm}")
