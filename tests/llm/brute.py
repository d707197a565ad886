"""Plain single-machine versions of the contracts, for small inputs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low_words(text):
    return WORD.findall((text or "").translate(LOWER))


def op1(rows, rules):
    out = []
    for page_id, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
            host = host.translate(LOWER)
        fits = [
            r for r in rules
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
        ]
        best = max(fits, key=lambda r: len(r.text), default=None)
        out.append((page_id, host, path, best and best.text, best and best.verdict))
    return out


def op2(docs, items, size=10):
    found = {}
    for item, text in items:
        own = low_words(text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            found.setdefault(tuple(own[i : i + size]), set()).add(item)
    lengths = sorted({len(w) for w in found})
    out = []
    for doc_id, text in docs:
        own = low_words(text)
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(own) - n + 1):
                window = tuple(own[i : i + n])
                if window in found:
                    hit.update(range(i, i + n))
                    ids |= found[window]
        names = ",".join(sorted(str(i) for i in ids if i is not None))
        digest = hashlib.sha256(names.encode()).hexdigest()
        n_ids = len([i for i in ids if i is not None])
        out.append((doc_id, len(own), len(hit), n_ids, digest, bool(hit)))
    return out


def op3_base(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        own = PLAIN.findall(text)
        lines = [line for line in text.split("\n") if PLAIN.search(line)]
        windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
        repeated = set()
        for i in range(len(own) - 2):
            if windows[tuple(own[i : i + 3])] > 1:
                repeated.update(range(i, i + 3))
        n, r = len(own), len(repeated)
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        failed = n < 50 or 100 * r > 50 * n
        out.append(
            (doc_id, n, sum(map(len, own)), symbols, len(lines) - len(set(lines)), r, failed)
        )
    return out


def op5(pages):
    payloads = {}
    rows = [(p, (html or "").encode()) for p, html in pages]
    order = lambda p: (p is None, p or 0)
    for page_id, data in rows:
        first = payloads.get(data, page_id)
        payloads[data] = min(first, page_id, key=order)
    out = []
    for page_id, data in rows:
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = payloads[data]
        kind = "response" if first == page_id else "revisit"
        out.append((page_id, len(data), digest, kind, None if first == page_id else first))
    return out


def op6(docs, min_lines=3, min_words=50):
    """Removed lines by windows that start earlier; rows are (doc_id, text), ids distinct."""
    seen, drops = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        lines = [line.strip(" \t\n\v\f\r") for line in (text or "").split("\n")]
        lines = [line for line in lines if line]
        drop = set()
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(PLAIN.findall(lines[j]))
                if j - i + 1 >= min_lines or n >= min_words:
                    window = tuple(lines[i : j + 1])
                    if window in seen:
                        drop.update(range(i, j + 1))
                    seen.add(window)
                    break
        drops[doc_id] = drop
    out = []
    for doc_id, text in docs:
        kept, i, total = [], 0, 0
        for piece in (text or "").split("\n"):
            if piece.strip(" \t\n\v\f\r"):
                if i not in drops[doc_id]:
                    kept.append(piece)
                i += 1
                total += 1
            else:
                kept.append(piece)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, total, len(drops[doc_id]), digest))
    return out


def op7_targets(docs, weights=(5, 2, 1), times=3):
    sizes = Counter()
    for _, source, text in docs:
        sizes[source] += len(PLAIN.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        level = left / (sum(weight[s] for s in rest) or 1)
        above = [s for s in rest if weight[s] * level > times * sizes[s]]
        if not above:
            break
        for s in above:
            target[s] = float(times * sizes[s])
            left -= target[s]
            capped.add(s)
    for s in rest:
        target[s] = weight[s] * level
    return sizes, target


def op10(docs, length=100):
    """rows are (doc_id, text), ids distinct."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(window)
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=5):
    own = low_words(text)
    if not own:
        return frozenset()
    size = min(size, len(own))
    return frozenset(tuple(own[i : i + size]) for i in range(len(own) - size + 1))


def op8(docs, low=0.8):
    """doc_id -> (class id, links) by all pairs; rows are (doc_id, text), ids distinct."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = Counter()
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 10 * len(s & t) >= 10 * low * len(s | t):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d, _ in sets}


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def op11_leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _climb(nodes, paths):
    """The last node above ``nodes``; every path gains its siblings level by level."""
    at = list(range(len(paths)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            start = at[k] // 16 * 16
            run = nodes[start : start + 16]
            paths[k].append((run[: at[k] - start], run[at[k] - start + 1 :]))
            at[k] //= 16
        nodes = [_h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0]


def op11(rows):
    """rows are (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    trees, subroots = [], []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        leaves = [(r[0] is not None, r[0] or 0, op11_leaf(r), r) for r in by_source[source]]
        leaves.sort(key=lambda leaf: leaf[:3])
        paths = [[] for _ in leaves]
        subroots.append(_climb([leaf[2] for leaf in leaves], paths))
        trees.append((leaves, paths))
    upper = [[] for _ in subroots]
    root = _climb(subroots, upper) if subroots else None
    out = []
    for i, (leaves, paths) in enumerate(trees):
        for (_, _, leaf, row), path in zip(leaves, paths, strict=True):
            path = path + upper[i]
            proof = _h(*("".join(left) + "".join(right) for left, right in path))
            digest = leaf
            if row[0] is not None and row[4] and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                digest = op11_leaf((*row[:4], row[4].translate(LOWER)))
            for left, right in path:
                digest = _h(*left, digest, *right)
            out.append((row[0], leaf, subroots[i], root, proof, digest, digest == root))
    return out


def op12(docs, support=100, top=2000):
    """rows are (lang, text)."""
    counts, words = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for k in range(1, 6):
                own.update(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, own in counts.items():
        phrases = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        dropped = set()
        for p, a in phrases.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 100 * own[p[i : i + k]]:
                        dropped.add(p[i : i + k])
        rows = []
        for p, a in phrases.items():
            n = words[lang]
            score, k = min(
                (1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))
            )
            if p not in dropped:
                name = " ".join(p)
                rows.append((-score, -a, name.encode(), name, own[p[:k]], own[p[k:]], n))
        rows.sort()
        for rank, (score, a, _, name, left, right, n) in enumerate(rows[:top], 1):
            out.append((lang, rank, name, -a, left, right, n, -score))
    return out


def _pad(text, depth):
    return bytes(depth) + (text or "").translate(LOWER).encode() + b"\xff"


def op13_held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def op13_base(docs):
    """rows are (doc_id, text)."""
    cut = {  # the end is None
        i: [*PLAIN.findall((text or "").translate(LOWER)), None] for i, (_, text) in enumerate(docs)
    }
    counts = Counter()
    for i, (doc_id, _) in enumerate(docs):
        if not op13_held_out(doc_id):
            counts.update(cut[i])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        own = [counts[t] for t in cut[i]]
        score = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in own)
        out.append((doc_id, op13_held_out(doc_id), len(own), sum(c > 0 for c in own), n, score))
    return out


def op13_score(train, text, depth):
    """log10 probability of a text: the mixture of all trees with and without each decision."""

    def decisions(text):
        data = _pad(text, depth)
        for i in range(depth, len(data)):
            for k in range(8):
                node = (1 << k) | (data[i] >> (8 - k))
                yield node, data[i - depth : i], data[i] >> (7 - k) & 1

    seen = {}
    for one in train:
        for node, context, bit in decisions(one):
            seen.setdefault(node, []).append((context, bit))

    def mixture(rows, d):
        if not rows:
            return 0.0
        a = sum(bit for _, bit in rows)
        b = len(rows) - a
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1)
        own -= math.log(math.pi)
        if d == depth:
            return own
        children = {}
        for context, bit in rows:
            children.setdefault(context[-d - 1], []).append((context, bit))
        below = sum(mixture(part, d + 1) for part in children.values())
        top = max(own, below)
        return math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(below - top))

    total = 0.0
    for node, context, bit in decisions(text):
        rows = seen.get(node, [])
        total += mixture([*rows, (context, bit)], 0) - mixture(rows, 0)
    return total / math.log(10)
