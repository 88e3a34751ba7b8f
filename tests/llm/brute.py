"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, percent=80):
    """docs: {id: text} -> {id: (set size, smallest id of the component)}"""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def without_repeats(rows, window=35):
    """rows: [(id, text)] -> [(id, words, removed, sha256)]"""
    count = collections.Counter()
    split = [words(t) for _, t in rows]
    for w in split:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def rule_counts(text):
    text = text or ""
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=20):
    """docs: [(id, text)], items: [(id, text)] -> [(item, rank, doc, score)]"""
    import math

    split = [(d, collections.Counter(TERM.findall((t or "").translate(LOW)))) for d, t in docs]
    size = [sum(c.values()) for _, c in split]
    n_docs, n_terms = sum(n > 0 for n in size), sum(size)
    df = collections.Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOW))
        found = []
        for (d, c), n in zip(split, size, strict=True):
            if n:
                m = 100 - 25 + 25 * n * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked)
                if score > 0:
                    found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return out


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_base(text):
    text = text or ""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [s for _, _, s in sorted(out)]


def alignment(rows, first, second, bytes_of):
    """rows: [text]; first, second: text -> ids; bytes_of: (side, id) -> bytes. -> [(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)]"""
    groups = []
    for text in rows:
        own = []
        a, b = (first(text), second(text)) if text else ([], [])
        spelled = [[bytes_of(s, i) for i in ids] for s, ids in ((0, a), (1, b))]
        if text and all(b"".join(x) == (" " + text).encode() for x in spelled):
            ends = []
            for x in spelled:
                at, e = 0, []
                for t in x:
                    at += len(t)
                    e.append(at)
                ends.append(e)
            i = j = 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                own.append((a[i:p], b[j:q]))
                i, j = p, q
        groups.append(own)
    links = [collections.Counter((x, y) for a, b in own for x in a for y in b) for own in groups]
    count = collections.Counter(pair for c in links for pair in c)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for own, c in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append((sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), sum(c.values()), sum(n for (x, y), n in c.items() if count[x, y] == best[x]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if own else ""))
    return out


def template_lines(texts, similarity=0.75, contexts=8):
    """texts without near copies -> for each the worded lines that a recurring template drops, by their numbers."""
    token = lambda w: "#" if re.search("[0-9@]", w) else w
    held = [[(k, tuple(map(token, words(x)))) for k, x in enumerate((t or "").split("\n")) if words(x)] for t in texts]
    texts_of = collections.defaultdict(set)
    for i, own in enumerate(held):
        for _, line in own:
            texts_of[line].add(i)
    support = collections.Counter()
    for line, who in texts_of.items():
        for p, w in enumerate(line):
            support[len(line), line[:3], p, w] += len(who)
    template = {}
    for line in texts_of:
        shape = tuple(w if support[len(line), line[:3], p, w] >= contexts else None for p, w in enumerate(line))
        template[line] = (line[:3], shape) if sum(w is not None for w in shape) >= similarity * len(line) else line
    found = collections.defaultdict(set)
    for line, who in texts_of.items():
        found[template[line]] |= who
    return [[k for k, line in own if len(found[template[line]]) >= contexts] for own in held]


def triples(text):
    """Word triples that don't reach over a line, shorter ones at its start."""
    out = set()
    for line in (text or "").split("\n"):
        w = words(line)
        out |= {tuple(w[max(0, i - 2) : i + 1]) for i in range(len(w))}
    return out
