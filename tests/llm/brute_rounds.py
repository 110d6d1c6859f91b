"""Plain versions of the operators on conversations, vectors and tokens."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

SPACE, NEXT = " \t\n\x0b\x0c\r", {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    """rows: (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """rows: (initial, must go, truncated) -> (cost, edits), by whole strings in every state."""
    now = {"": (0, "")}

    def insert(now):
        for _ in range(4):
            for s, (c, e) in list(now.items()):
                for t in NEXT[s]:
                    if t != "s":
                        now[t] = min(now.get(t, (math.inf, "")), (c + 5, e + "I"))
        return now

    insert(now)
    for initial, gone, cut in rows:
        new = {}
        for s, (c, e) in now.items():
            ways = [(s, c + 2, "D")]
            if not gone:
                ways += [(t, c + 5 * cut + (t != initial), "K" if t == initial else "R") for t in NEXT[s] if t == initial or t != "s"]
            for t, cost, letter in ways:
                new[t] = min(new.get(t, (math.inf, "")), (cost, e + letter))
        now = insert(new)
    return min(now.get(s, (math.inf, "")) for s in ("", "a"))


def op11(rows):
    ids, by = {r[0] for r in rows}, defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    return [(conv, *repaired(by[conv])) for conv in ids]


def repaired(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest())
    rows, seen, faults = sorted(rows, key=order), set(), []
    for _, _, role, text in rows:
        left = text.strip(SPACE)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    cost, edits = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)])
    out, left = [], iter(rows)
    for e in edits:
        last = out[-1][0][:1] if out else ""
        role, text = ("assistant" if last == "u" else "user"), ""
        if e != "I":
            _, _, own, text = next(left)
            role = own if e == "K" else role
        if e != "D":
            out.append((role, text))
    turns = {r[1] for r in rows} - {None}
    gaps = min(max(turns) - min(turns) + 1 - len(turns), (1 << 63) - 1) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def op12(rows, k=8, rounds=10, size=64):
    """rows: (vec_id, vector)."""
    most = 1 << 27
    kept = [(i, [math.floor(max(min(x * 1024, most), -most)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[nearest(v)[1]].append(v)
        for j, own in by.items():
            centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in found:
        inertia[j] += d
    whole = sum(inertia.values())
    return [(i, j, d, inertia[j], whole, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found]


def op7(docs, labels, rounds=150, rate=0.2, decay=2e-4, bias=-9.0):
    """docs: (doc_id, text), labels: (doc_id, toxic); fewer than the bounds on what is learnt from. Returns id -> (held out, score, worst sentence)."""

    def held(i):
        return zlib.crc32(str(i).encode()) % 4 == 2

    def sentences(text):
        """Features of each sentence that has words."""
        out = []
        for part in re.split(rb"[.!?\n]", (text or "").encode()):
            words = re.findall(rb"[a-z0-9\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in part))
            if words:
                out.append([f for w in words for f in [("word", w), *(("start", w[:n]) for n in range(4, 10) if len(w) >= n)]])
        return out

    toxic = {}
    for i, y in labels:
        if y is not None and i is not None and not held(i):
            toxic[i] = max(y, toxic.get(i, 0))
    learnt = sorted((toxic[i], (t or "").encode()) for i, t in set(docs) if i in toxic)
    bags, target = [sentences(t.decode()) for _, t in learnt], [y for y, _ in learnt]
    n, seen = [target.count(0), target.count(1)], defaultdict(lambda: [0, 0])
    for y, bag in zip(target, bags, strict=True):
        for f in {f for s in bag for f in s}:
            seen[f][y] += 1

    def strong(good, bad):
        odds = math.log((bad + 0.5) / (n[1] - bad + 0.5)) - math.log((good + 0.5) / (n[0] - good + 0.5))
        return bad >= 3 and odds > 4 * math.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))

    weights = {f: 1.0 for f, c in seen.items() if strong(*c)} if all(n) else {}

    def chances(bag):
        out = []
        for s in bag:
            own = [weights[f] for f in s if f in weights]
            out.append(1 / (1 + math.exp(-max(-30, min(30, bias + sum(own))))) if own else 0.0)
        return out

    def either(p):
        return -math.expm1(sum(math.log1p(-min(x, 1 - 1e-12)) for x in p))

    kept = [[[f for f in s if f in weights] for s in bag] for bag in bags]
    squares = dict.fromkeys(weights, 1e-8)
    for _ in range(rounds if weights else 0):
        grad = {f: decay * len(bags) * w / len(weights) for f, w in weights.items()}
        for y, bag in zip(target, kept, strict=True):
            p = chances(bag)
            whole = max(either(p), 1e-9)
            for s, x in zip(bag, p, strict=True):
                for f in s:
                    grad[f] += -(1 - whole) / whole * x if y else 3 * x
        for f, g in grad.items():
            squares[f] += g * g
            weights[f] -= rate * g / math.sqrt(squares[f])
    out = {}
    for i, t in docs:
        p = chances(sentences(t))
        out[i] = (held(i), abs(either(p)), p.index(max(p)) if p else None)
    return out
