"""Plain reference versions of the operators, for small inputs."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np

from helicase.llm import text

BLANK = " \t\n\x0b\x0c\r"
_UP = {c: c + 32 for c in range(65, 91)}


def lower(t: str) -> str:
    return t.translate(_UP)


def shingle_set(t: str | None, n: int) -> set[tuple[str, ...]]:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(corpus, n: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    sets = {i: shingle_set(t, n) for i, t in corpus}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def lines(corpus, chars: int = 40, docs: int = 5) -> dict[int, tuple[int, int, str]]:
    key = lambda x: lower(x.strip(BLANK))
    held: dict[str, set[int]] = {}
    for i, t in corpus:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                held.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = {}
    for i, t in corpus:
        every = (t or "").split("\n")
        stay = [x for x in every if gone.get(key(x), i) == i]
        out[i] = (len(every), len(every) - len(stay), "\n".join(stay))
    return out


def repeats(corpus, size: int) -> dict[int, tuple[int, int, int, bytes]]:
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in corpus):
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            s = t[p : p + size]
            if s in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(s)
        runs = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def thue_morse(size: int) -> tuple[str, str]:
    """Two texts of letters a and b that complement each other; sums of powers can't tell them apart."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(size))
    return one, one.translate({97: 98, 98: 97})


def fingerprint(t: str) -> str:
    """Chunk ends, levels and characters one byte and one chunk at a time; only the two hash functions are the operator's own."""
    raw = t.encode()
    padded = bytes(6) + raw
    levels = []
    for i in range(len(raw)):
        h = _window(padded[i : i + 7])
        levels.append(-1 if h % 3 else 39 if h == 0 else min(39, (h // 3 & -(h // 3)).bit_length() - 1))
    k = 0
    while 3 * 64 << k < len(raw):
        k += 1
    while k and sum(x >= k for x in levels) < 32:
        k -= 1

    def signature(level: int, most: int) -> str:
        ends = [i + 1 for i, x in enumerate(levels) if x >= level][: most - 1]
        chunks = [raw[a:b] for a, b in zip([0, *ends], [*ends, len(raw)])]
        return "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[whole(c, 9)[0] % 64] for c in chunks if c)

    return f"{3 << k}:{signature(k, 64)}:{signature(k + 1, 32)}"


def likeness(x: str, y: str) -> float:
    if x == y:
        return 1.0
    (n, a, b), (m, c, d) = x.split(":"), y.split(":")
    n, m = int(n), int(m)
    pairs = [(a, c), (b, d)] if n == m else [(a, d)] if n == 2 * m else [(b, c)] if m == 2 * n else []
    best = 0.0
    for p, q in pairs:
        grams = {p[i : i + 4] for i in range(len(p) - 3)} & {q[i : i + 4] for i in range(len(q) - 3)}
        if grams or (p == q and p):
            best = max(best, 1 - distance(p, q) / max(len(p), len(q)))
    return best


@functools.cache
def _window(b: bytes) -> int:
    return int(text.rolling(np.frombuffer(b, np.uint8), len(b))[0])


@functools.cache
def whole(b: bytes, seed: int) -> tuple[int, int]:
    return tuple(int(h[0]) for h in text.hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), seed))


def _mixed(h: int, seed: int) -> int:
    return int(text.mix(np.array([h % (1 << 64)], np.uint64), seed)[0])


def features(t: str | None) -> set[int]:
    """Places of trigrams, words and one to three successive word shapes, one at a time."""
    raw = (t or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    out = {_window(low[i : i + 3]) >> 46 for i in range(len(low) - 2)}
    shapes: list[tuple[int, int, int]] = []
    before = None
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        w = m[0]
        up, small, digit, high = (sum(f(b) for b in w) for f in (lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b >= 128))
        held = (up > 0) | (up > 1) << 1 | (small > 0) << 2 | (digit > 0) << 4 | (high > 0) << 6 | min(len(w) - up - small - digit - high, 3) << 10 | min(len(w) // 4, 7) << 14
        name = low[m.start() : m.end()]
        one = _mixed(held | (name == before) << 20, 31)
        two = _mixed(shapes[-1][0] ^ one * 3 % (1 << 64), 32) if shapes else 0
        three = _mixed(shapes[-1][1] ^ one * 3 % (1 << 64), 33) if shapes else 0
        out |= {_mixed(whole(name, 1)[0], 30) >> 46, one >> 46} | ({two >> 46} if shapes else set()) | ({three >> 46} if len(shapes) > 1 else set())
        shapes.append((one, two, three))
        before = name
    return out


def support_vectors(rows: list[set[int]], y: list[int], places: int, cost: float = 4.0, epochs: int = 15):
    """Margins of any rows: dense vectors of log-count ratios at unit length, and textbook dual coordinate descent with the weights kept as such."""
    names = sorted(set().union(*rows))
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r]] = 1
    label = np.array(y)
    counts = np.stack([1 + x[label == c].sum(0) for c in (0, 1)])
    unseen = [places + x[label == c].sum() for c in (0, 1)]
    ratio = np.log(counts[1] / unseen[1] / (counts[0] / unseen[0]))
    rest = np.log(unseen[0] / unseen[1])  # of a place that no row holds

    def vector(r: set[int]) -> tuple[np.ndarray, float]:
        v = np.zeros(len(names))
        v[[at[f] for f in r if f in at]] = 1
        v *= ratio
        length = max(np.sqrt((v * v).sum() + sum(f not in at for f in r) * rest * rest), 1e-12)
        return v / length, length

    unit = [vector(r)[0] for r in rows]
    w, bias, alpha = np.zeros(len(names)), 0.0, np.zeros(len(rows))
    most = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) * cost
    sign, rng = np.where(label == 1, 1.0, -1.0), np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (w @ unit[i] + bias) - 1
            new = min(max(alpha[i] - slope / (unit[i] @ unit[i] + 1), 0.0), most[i])
            moved = max(moved, abs(new - alpha[i]))
            w, bias, alpha[i] = w + (new - alpha[i]) * sign[i] * unit[i], bias + (new - alpha[i]) * sign[i], new
        if moved < 1e-3:
            break
    return lambda r: float(w @ vector(r)[0]) + bias
