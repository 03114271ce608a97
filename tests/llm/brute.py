"""Plain single-process versions of the operators, written for clarity."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def shingles(text):
    w = words(text, True)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jaccard_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def remove_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def luhn(d):
    total = 0
    for k, ch in enumerate(d[::-1]):
        v = int(ch) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m[0])) <= 15),
]


def spans(kinds, text):
    return sorted((m.start(), k, m.end()) for k, (_, p, holds) in enumerate(kinds) for m in p.finditer(text or "") if holds(m))


def digest(kinds, found):
    return hashlib.sha256(",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in found).encode()).hexdigest()


GENERIC = re.compile(r"[A-Za-z0-9+_=-]{24,}")


def secrets(rows):
    """``doc_id, base, all spans, n_live`` by plain loops over all rows and values."""
    import math

    seen = []
    for i, t, owner in rows:
        base = [(s, k, e, m) for k, (_, p, holds) in enumerate(SECRETS) for m in p.finditer(t or "") if holds(m) for s, e in [m.span()]]
        base = sorted((s, k, e, m[2] if k == 0 else m[0]) for s, k, e, m in base)
        extra = [(m.start(), 3, m.end(), m[0]) for m in GENERIC.finditer(t or "") if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
        extra = [x for x in extra if not any(b[0] < x[2] and x[0] < b[2] for b in base)]
        seen.append((i, owner, (i is None, i if i is not None else t or ""), base, extra))
    size = {o: len({r for _, w, r, _, _ in seen if w == o}) for o in {x[1] for x in seen}}
    held = {}
    for _, owner, repo, base, extra in seen:
        for x in base + extra:
            held.setdefault(x[3], set()).add((owner, repo))
    live = {v for v, h in held.items() if len({o for o, _ in h}) == 1 and len(h) <= 2 + math.log2(size[next(iter(h))[0]])}
    name = lambda xs: ",".join(f"{(*[k for k, _, _ in SECRETS], 'generic')[k]}:{s}:{e}" for s, k, e, _ in sorted(xs))
    return [(i, name(base), name(base + [x for x in extra if x[3] in live]), sum(x[3] in live for x in base)) for i, _, _, base, extra in seen]


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """Water-filling by repeated shares; ``None`` last."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if epochs * sizes[s] <= level * w[s]}
        for s in full or open_:
            out[s] = epochs * sizes[s] if full else level * w[s]
        left -= sum(out[s] for s in full)
        open_ -= full or set(open_)
    return out


def fair_mix(rows, epochs=3):
    """Times each of ``(doc_id, src, u, size)`` is taken: all entries by virtual finish time until the budget is spent."""
    sizes = {}
    for _, src, _, n in rows:
        sizes[src] = sizes.get(src, 0) + n
    goal = targets({None if s == "n" else s: v for s, v in sizes.items()}, epochs=epochs)
    entries, taken, spent = [], {i: 0 for i, *_ in rows}, {}
    for i, src, u, n in sorted(rows, key=lambda r: r[2]):
        spent[src] = spent.get(src, 0) + n
        if n:
            entries += [((spent[src] + e * sizes[src]) / goal[None if src == "n" else src], src, e, spent[src], i, n) for e in range(epochs)]
    left = sum(sizes.values())
    for _, _, _, _, i, n in sorted(entries):
        if n > left:
            break
        left -= n
        taken[i] += 1
    return taken


def personal(rows, rounds=3, support=5, accept=0.8):
    """``doc_id, all spans`` (kind 4: context) by plain loops over the pattern-instance graph."""
    found, edges = [], {}
    for i, t, _ in rows:
        t = t or ""
        base = spans(PERSONAL, t)
        other = []
        for m in re.finditer(r"[A-Za-z0-9._-]+", t):
            body = m[0].strip("._-")
            s = m.start() + m[0].index(body) if body else m.start()
            e = s + len(body)
            if len(body) >= 6 and len(digits(body)) >= 4 and not any(a < e and s < b for a, _, b in base):
                other.append((s, 4, e))
        for s, k, e in base + other:
            before = t[:s].lower().split()
            for n in (1, 2):
                if len(before) >= n:
                    key = (" ".join(before[-n:]), t[s:e])
                    edges[key] = edges.get(key, False) or k < 4
        found.append((i, t, base, other))
    score = {}
    for _ in range(rounds):
        total, count = {}, {}
        for (p, v), seed in edges.items():
            total[p] = total.get(p, 0) + (1 if seed else score.get(v, 0))
            count[p] = count.get(p, 0) + 1
        good = {p: total[p] / (count[p] + 0.5) for p in total if total[p] >= support}
        score = {}
        for (p, v), seed in edges.items():
            if not seed and p in good:
                score[v] = max(score.get(v, 0), good[p])
    return [(i, sorted(base + [x for x in other if score.get(t[x[0] : x[2]], 0) >= accept])) for i, t, base, other in found]


def passes_quality(text):
    w, t = words(text), text or ""
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    copies, chars = len(lines) - len(set(lines)), sum(map(len, w))
    symbols = len(re.findall("[#*$%&|<>]", t))
    return not (len(w) < 20 or 100 * len(covered) > 30 * len(w) or 2 * symbols > len(w) or (2 * copies > len(lines) and len(lines) > 3) or chars < 2 * len(w) or chars > 25 * len(w))


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelling(rows, min_chars=6, min_count=5):
    """``(word, form, root, n, n_near, form_n)`` from all pairs of words."""
    import zlib

    n = {}
    for i, t, _ in rows:
        for r in RUN.findall(t or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 199 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            n[r] = n.get(r, 0) + 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    near = {w: [] for w in n}
    for a, b in combinations(sorted(n), 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def merkle(nodes):
    """Root of ``nodes`` and, for each, its proof: (left, right) digests a level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            proofs[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
            at[k] = i // 3
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], proofs


def manifest(rows):
    """``(doc_id, leaf, subroot, root, proof)`` of rows of doc_id, source, lang, n_chars, text."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0], leaf(*r)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    out, subs = [], []
    for s in names:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, proofs = merkle([h for _, h in trees[s]])
        subs.append(root)
        out += [(i, h, s, root, p) for (i, h), p in zip(trees[s], proofs)]
    if not out:
        return []
    top, over = merkle(subs)
    return [(i, h, root, top, p + over[names.index(s)]) for i, h, s, root, p in out]


def drop_shared_lines(rows, min_docs=10):
    """``(doc_id, kept text, lines, dropped lines)`` by one dictionary of lines."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    out = []
    for i, t, _ in rows:
        found = (t or "").split("\n")
        kept = [x for x in found if not key(x) or len(held[key(x)]) < min_docs]
        out.append((i, "\n".join(kept), len(found), len(found) - len(kept)))
    return out
