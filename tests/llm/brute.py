"""Plain versions of the operators, for comparison."""

import hashlib
import re
from collections import defaultdict

FOLD = {c: c + 32 for c in range(65, 91)}


def op1(docs, bench, window=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for item, text in bench:
        w = word.findall((text or "").translate(FOLD))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, items = word.findall((text or "").translate(FOLD)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit |= set(range(k, k + n))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def op3(docs, n=100):
    """docs: (doc_id, text) with doc_ids that differ."""
    seen, out = set(), []
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            s = raw[k : k + n]
            if s in seen:
                gone[k : k + n] = b"\x01" * n
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def op9(docs, gram=4, least=85):
    sets, parent = [], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for doc, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
        s = {tuple(w[k : k + gram]) for k in range(max(1, len(w) - gram + 1))} if w else set()
        sets.append((doc, s))
    for k, (_, s) in enumerate(sets):
        shared = defaultdict(int)
        for t in s:
            for j in where[t]:
                shared[j] += 1
            where[t].append(k)
        for j, n in shared.items():
            if 100 * n >= least * (len(s) + len(sets[j][1]) - n):
                parent[root(k)] = root(j)
    least_id = {}
    for k, (doc, _) in enumerate(sets):
        least_id[root(k)] = min(doc, least_id.get(root(k), doc))
    return [(doc, len(s), least_id[root(k)]) for k, (doc, s) in enumerate(sets)]


def stretches(sizes, headings, window, rise=0.2, steep=86):
    """[first, end) of the stretches of lines, from the definition: every line is looked at with its whole window."""
    sums = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    least = min(steep, rise * max(sums, default=0))
    inside, open_ = [False] * len(sizes), False
    for i, n in enumerate(sizes):
        if n and (open_ or sums[i] > least):
            open_ = True
        elif not n and sums[i] <= least:
            open_ = False
        inside[i] = open_
    out = []
    for i, now in enumerate(inside):
        if now and (not i or not inside[i - 1]):
            s = i
            low = out[-1][1] if out else 0
            while s > low and sizes[s - 1]:
                s -= 1
            before = [k for k in range(max(low, s - 1 - window), s) if sizes[k]]
            if before and headings[before[-1]]:
                s = before[-1]
            while s > low and sizes[s - 1]:
                s -= 1
            e = next((k for k in range(i, len(sizes)) if not inside[k]), len(sizes))
            out.append((s, e))
    return out


def op10(page):
    """The main text of a page of plain structure, with the library's HTML parser."""
    from html.parser import HTMLParser

    blocks, skipped, main, block = [], [], [], []

    class Reader(HTMLParser):
        def close_block(self):
            text = " ".join("".join(block).split())
            if text and not skipped:
                blocks.append((text, bool(main)))
            block.clear()

        def handle_starttag(self, tag, attrs):
            if tag in ("b", "a", "i"):
                return
            self.close_block()
            if tag in ("nav", "footer", "script", "style", "title", "aside", "header") or dict(attrs).get("class") == "ad" or skipped:
                if tag not in ("br", "meta", "img"):
                    skipped.append(tag)
            elif tag == "article":
                main.append(tag)

        def handle_endtag(self, tag):
            if tag in ("b", "a", "i"):
                return
            self.close_block()
            if skipped and skipped[-1] == tag:
                skipped.pop()
            elif tag == "article" and main:
                main.pop()

        def handle_data(self, data):
            block.append(data)

    r = Reader()
    r.feed(page)
    r.close()
    r.close_block()
    return "\n".join(t for t, m in blocks if m)


def op6_edits(docs):
    """(doc_id, n_chars, edited_sha256, edited text, next text) of distinct doc_ids, null last."""
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), changed, following))
    return out


def phrases(text, level=3):
    """The set of phrases of a text by locally consistent parsing, each spelled out, from the definition."""
    symbols = [bytes([b]) for b in text.encode()]
    codes = {}
    for depth in range(level):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        values = [codes[x] if depth else x[0] for x, _ in runs]
        width = 64 if depth else 8
        for _ in range(3):
            after = []
            for k, v in enumerate(values):
                left = values[k - 1] if k else ~v & ((1 << width) - 1)
                bit = next(i for i in range(width) if (v ^ left) >> i & 1)
                after.append(bit << 1 | (v >> bit & 1))
            values, width = after, 8
        n = len(values)
        starts = [k for k in range(n) if not k or (values[k] > values[k - 1] and (k + 1 == n or values[k] > values[k + 1]) and k + 1 < n)]
        yield_, parts = [], [*starts, n]
        for s, e in zip(parts[:-1], parts[1:]):
            yield_.append(b"|".join(x * c if not depth else x + b"*%d" % c for x, c in runs[s:e]))
        symbols = yield_
        codes = {x: name(depth, x) for x in set(symbols)}
    return set(symbols)


def name(depth, x):
    """64 bits for a phrase; any hash serves, so this one is not the operator's."""
    return int.from_bytes(hashlib.blake2b(bytes([depth]) + x, digest_size=8).digest(), "big")


def op2(docs, least=2):
    """(kept lines, removed) by doc_id, from the definition: a run of `least` lines that also starts earlier goes."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        every = (text or "").split("\n")
        solid = [k for k, x in enumerate(every) if x.strip()]
        lines, gone = [every[k] for k in solid], set()
        for p in range(len(lines) - least + 1):
            run = tuple(lines[p : p + least])
            if run in seen:
                gone |= set(range(p, p + least))
            seen.add(run)
        left = [x for k, x in enumerate(every) if k not in {solid[g] for g in gone}]
        out[doc] = ("\n".join(left), len(gone))
    return out


def op2_runs(docs, least=2, wider=8):
    """(doc, start, stop, first doc, first start) of the maximal runs, by comparing every suffix with every earlier one."""
    lines = {doc: [x for x in (text or "").split("\n") if x.strip()] for doc, text in docs}
    places = [(d, p) for d in sorted(lines) for p in range(len(lines[d]))]
    deepest = {}
    for at in places:
        depth = least
        while True:
            d, p = at
            run = lines[d][p : p + depth]
            if len(run) < depth:
                break
            first = next(x for x in places if lines[x[0]][x[1] : x[1] + depth] == run)
            if first < at:
                deepest[at] = (depth, first)
            depth *= wider
    out = []
    for d in lines:
        spans, lanes = [], {}
        for p in range(len(lines[d])):
            if (d, p) in deepest:
                depth, first = deepest[d, p]
                lane = lanes.setdefault((first[0], p - first[1]), [])
                if lane and p <= lane[-1][1]:
                    lane[-1][1] = max(lane[-1][1], p + depth)
                else:
                    lane.append([p, p + depth])
        for (of, apart), found in lanes.items():
            spans += [(s, e, of, s - apart) for s, e in found]
        out += [(d, *x) for x in spans if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in spans)]
    return sorted(out)
