"""Plain versions of the operators' results, for small tables."""

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def similar(rows):
    """(doc_id, size, linked, component) of (doc_id, text) rows, in order."""
    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((key, len(sets[i]), len(near[i]), min(ids) if ids else None))
    return out


def deduped(rows, min_words):
    """Texts of (doc_id, text) rows, sorted by id, without later copies of runs of ``min_words`` words or more."""
    at = [(d, i, line) for d, (_, t) in enumerate(rows) if t is not None for i, line in enumerate(t.split("\n"))]
    size = [len(WORD.findall(line)) for _, _, line in at]
    gone = set()
    for p in range(len(at)):
        for q in range(p):
            n = words = 0
            while p + n < len(at) and at[p + n][0] == at[p][0] and at[q + n][0] == at[q][0] and at[p + n][2] == at[q + n][2] and q + n < len(at):
                words += size[p + n]
                n += 1
            if words >= min_words:
                gone |= {at[p + k][:2] for k in range(n)}
    return [(key, None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if (d, i) not in gone)) for d, (key, t) in enumerate(rows)]


def top(rows, queries, k):
    """(query, rank, id, score) over (id, vector) rows, largest inner product first."""
    out = []
    for q, v in rows:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def mixed(rows, epochs, entropy, closing, repeats, seed):
    """((doc_id, source, epoch, order, weight) rows, exponent) of (doc_id, text, source) rows."""
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    size, block, tokens, sizes = {}, {}, {}, {}
    for i, text, source in rows:
        block[i] = int(md5(i, text or "")[:8], 16) % 1024
        size[i] = len(WORD.findall(text or ""))
        tokens[source] = tokens.get(source, 0) + size[i]
        sizes[source, block[i]] = sizes.get((source, block[i]), 0) + size[i]
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())
    budget = min(math.floor(epochs * total + 0.5), math.floor(repeats * total))

    def weights(a):
        w = {s: (n / total) ** a for s, n in tokens.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    spread = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    wanted = entropy * math.log(len(tokens)) if entropy is not None else spread(1) + closing * (math.log(len(tokens)) - spread(1))
    over = lambda a: max(w * budget / tokens[s] for s, w in weights(a).items()) > repeats + 1e-12

    def largest(fine):
        """Of the multiples of 2**-25 up to 1."""
        low, high = 0, 1 << 25
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if fine(mid / (1 << 25)) else (low, mid - 1)
        return low / (1 << 25)

    alpha = largest(lambda a: spread(a) >= wanted - 1e-12)
    if over(0):
        alpha = max(alpha, min(1.0, largest(over) + 2.0**-25))
    out, weight = [], weights(alpha)
    for source, n in tokens.items():
        due = math.floor(weight[source] * budget + 0.5)
        passes, rest = divmod(due, n)
        name = "null" if source is None else f"={source}"
        order = lambda b, e: md5(name, b, e, seed)[:16] + f"{b:04d}"  # noqa: B023, E731
        taken, upto = set(), 0
        for b in sorted((b for s, b in sizes if s == source), key=lambda b: order(b, passes)):
            upto += sizes[source, b]
            if rest and rest >= upto - sizes[source, b] / 2:
                taken.add(b)
        out += [(i, source, e, order(block[i], e), weight[source]) for i, _, s in rows if s == source for e in range(passes + (block[i] in taken))]
    return out, alpha
