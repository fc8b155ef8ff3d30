"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def substring_dedup(rows, window):
    """rows (id, text) -> list of (id, n_words, n_removed, kept), in the order of rows."""
    first = {}
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if i is not None and first[key] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def line_dedup(rows, min_chars, min_docs):
    holders = defaultdict(set)
    split = [(i, (text or "").split("\n")) for i, text in rows]
    for i, lines in split:
        for line in lines:
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= min_chars and i is not None:
                holders[key].add(i)
    out = []
    for i, lines in split:
        keep = []
        for line in lines:
            held = holders.get(line.strip(SPACE).translate(LOWER), ())
            if len(held) < min_docs or i == max(held):
                keep.append(line)
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def benchmark_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def decontaminate(rows, items, window):
    patterns = defaultdict(set)
    for item, text in items:
        w = benchmark_words(text)
        if item is None or not w:
            continue
        n = min(window, len(w))
        for s in range(len(w) - n + 1):
            patterns[tuple(w[s : s + n])].add(item)
    lengths = {len(p) for p in patterns}
    out = []
    for i, text in rows:
        w, hit, found = benchmark_words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (owners := patterns.get(tuple(w[s : s + n]))):
                    hit |= set(range(s, s + n))
                    found |= owners
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[s : s + width]) for s in range(len(w) - width + 1)}


def near_duplicates(rows, percent=80):
    """rows (id, text) with distinct ids -> {id: (n_shingles, component)}."""
    sets = {i: shingles(text) for i, text in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def word_counts(texts):
    counts = Counter()
    for text in texts:
        counts.update(words((text or "").translate(LOWER)))
        counts["\0end"] += 1
    return counts


def hard_negatives(rows, anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    """rows (id, vector, label) -> list of (anchor, positive, rank, negative, positive score, negative score)."""
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(scale * x) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(good):
        if not anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, b) for k, (j, w, b) in enumerate(good) if k != a and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted(s[:2] for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(inside[:negatives])]
    return out


def prefix_trie(rows, heads=lambda c: zlib.crc32(str(c).encode()) % 6, base=lambda c: c - int(math.fmod(c, 100))):
    """rows (conv, turn, role, text) -> set of node rows, in the order of the result's columns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {c: tuple(turns.get(base(c), [])[: heads(c)] + t[heads(c) :]) for c, t in turns.items()}
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if built[c] == path)
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path],
            sum(not children[p] for p in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def quality(rows, limits, min_docs=50):
    """rows (id, text, lang, source) -> list of (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    ``limits`` are (name, part, whole, least, width, below).
    """
    counted = []
    for i, text, lang, source in rows:
        w, text = words(text), text or ""
        lines = [x for x in text.split("\n") if words(x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        c = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(s) for s in "#*$%&|<>"),
             "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}
        c["failed"] = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        counted.append((i, c, lang, source))

    def rounded(v):
        drop = max(v.bit_length() - 8, 0)
        return v >> drop << drop

    def value(c, rule):
        return c[rule[1]] * 1000 // max(c[rule[2]], 1)

    out = []
    for i, c, lang, source in counted:
        kept = not c["failed"]
        for rule in limits if kept else ():
            for member in (lambda a, b: (a, b) == (lang, source)), (lambda a, b: a == lang), (lambda a, b: True):
                seen = sorted(rounded(value(x, rule)) for _, x, a, b in counted if not x["failed"] and member(a, b))
                if len(seen) >= min_docs:
                    break
            q1, q2, q3 = (seen[-(-len(seen) * k // 4) - 1] for k in (1, 2, 3))
            v = value(c, rule)
            kept &= v <= q2 + max(rule[4] * (q3 - q2), rule[3]) and not (rule[5] and v < q2 - max(rule[4] * (q2 - q1), rule[3]))
        out.append((i, *[c[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed")], kept))
    return out
