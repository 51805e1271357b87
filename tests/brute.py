"""Plain versions of the operators for small inputs."""

from __future__ import annotations

from collections import Counter


def rc(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def counts(s: str, k: int, canonical: bool = True) -> Counter:
    words = (s[i : i + k] for i in range(len(s) - k + 1))
    return Counter(min(w, rc(w)) if canonical else w for w in words)


def squared(a: Counter, b: Counter) -> int:
    return sum((a[w] - b[w]) ** 2 for w in a.keys() | b.keys())


def greedy(seqs: list[tuple[str, int]], k: int, threshold: float, min_count: int) -> tuple[list[tuple[str, int]], list[int], list[int]]:
    """Distinct sequences in order, accepted places, and the place in that list for each."""
    total: Counter = Counter()
    for s, n in seqs:
        total[s] += max(n, 1)
    order = sorted(total.items(), key=lambda x: (-x[1], len(x[0]), x[0]))
    c = [counts(s, k) for s, _ in order]
    taken: list[int] = []
    for i, (_, n) in enumerate(order):
        if n >= min_count and not any(squared(c[i], c[t]) <= threshold * 2 * k for t in taken):
            taken.append(i)
    taken = taken or [0]
    return order, taken, [min(range(len(taken)), key=lambda t: (squared(x, c[taken[t]]), t)) for x in c]


def align(a: str, b: str, match: int, mismatch: int, gap: int, band: int = -1, free: bool = True, gap_a: list[int] | None = None, gap_b: list[int] | None = None) -> tuple[str, str, int]:
    """Cell by cell; up before left before diagonal."""
    n, m = len(a), len(b)
    down, right = (band + max(0, n - m), band + max(0, m - n)) if band >= 0 else (n + m, n + m)
    far = -(10**9)
    ga, gb = gap_a or [gap] * n, gap_b or [gap] * m
    inside = lambda i, j: i - j <= down and j - i <= right
    d, p = {(0, 0): 0}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            if not inside(i, j) or (i, j) == (0, 0):
                continue
            if i == 0 or j == 0:
                d[i, j] = 0 if free else sum(ga[:i]) + sum(gb[:j])
                p[i, j] = 3 if j == 0 else 2
                continue
            up = d.get((i - 1, j), far) + (0 if free and j == m else ga[i - 1])
            left = d.get((i, j - 1), far) + (0 if free and i == n else gb[j - 1])
            diag = d.get((i - 1, j - 1), far) + (match if a[i - 1] == b[j - 1] else mismatch)
            d[i, j] = max(up, left, diag)
            p[i, j] = 3 if up >= diag and up >= left else 2 if left >= diag else 1
    i, j, x, y = n, m, "", ""
    while i or j:
        k = p[i, j]
        x, y = ("-" if k == 2 else a[i - 1]) + x, ("-" if k == 3 else b[j - 1]) + y
        i, j = i - (k != 2), j - (k != 3)
    return x, y, d[n, m]


def consensus(reads: list[str], draft: str, fraction: float, band: int) -> str:
    base: Counter = Counter()
    gone: Counter = Counter()
    inserted: Counter = Counter()
    for r in reads:
        x, y, _ = align(draft, r, 2, -2, -3, band)
        at = col = 0
        for p, q in zip(x, y, strict=True):
            if p == "-":
                inserted[at, col, q] += 1
                col += 1
            else:
                (gone.update([at]) if q == "-" else base.update([(at, q)]))
                at, col = at + 1, 0
    need = -(-len(reads) * fraction // 1)
    out = ""
    for i in range(len(draft) + 1):
        col = 0
        while any((i, col, b) in inserted for b in "ACGT"):
            b = max("ACGT", key=lambda b: (inserted[i, col, b], -ord(b)))  # noqa: B023
            out += b if inserted[i, col, b] >= need else ""
            col += 1
        if i < len(draft):
            b = max("ACGT", key=lambda b: (base[i, b], -ord(b)))
            out += b if base[i, b] >= max(gone[i], max(need - 1, 0)) else ""
    return out


def dp_means(vectors: list[list[float]], radius: float, max_iter: int, distance) -> list[int]:
    centroids, label = [list(vectors[0])], [-1] * len(vectors)
    for _ in range(max_iter):
        new, opened = [], []
        for v in vectors:
            d = [distance(c, v) for c in centroids]
            best = min(range(len(d)), key=lambda i: (d[i], i))
            if d[best] > radius:
                best = len(centroids) + len(opened)
                opened.append(list(v))
            new.append(best)
        centroids += opened
        changed, label = new != label, new
        for c in range(len(centroids)):
            held = [v for v, x in zip(vectors, label, strict=True) if x == c]
            if held:
                centroids[c] = [sum(col) * (1 / len(held)) for col in zip(*held, strict=True)]
        if not changed:
            break
    names = sorted(set(label))
    return [names.index(x) for x in label]
