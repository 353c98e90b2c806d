"""Plain versions of the operators, for small inputs."""

import math
import random
import re
from collections import Counter, defaultdict

import regex

from diffloom.llm import line_dedup, pii, quality

WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text):
    w = re.findall(WORD, lower(text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


class Union:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def similar(a, b, percent=80):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def near_classes(texts):
    """Of each text the place of the first one that links lead to."""
    sets, out = [shingles(t) for t in texts], Union(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            if similar(a, sets[j]):
                out.join(i, j)
    return [out.find(i) for i in range(len(texts))]


def repeats(words):
    seen = defaultdict(list)
    for k in range(len(words) - 2):
        seen[tuple(words[k : k + 3])].append(k)
    return len({k + d for v in seen.values() if len(v) > 1 for k in v for d in range(3)})


def _histograms(text):
    rest, classes = re.sub(r"[\x20\x09-\x0D]+", "", text), []
    for p in quality.CLASSES:
        left = regex.sub(p, "", rest)
        classes.append(len(rest) - len(left))
        rest = left
    words = [w for w in regex.split(r"[^\p{L}]+", text.lower()) if w]
    n = Counter(words)
    common = [n[w] for w in quality.WORDS]
    return [*classes, len(rest)], [*common, len(words) - sum(common)]


def _distance(a, b):
    n, m = sum(a), sum(b)
    if not n or not m:
        return 0.0
    part = lambda p, q: p * math.log2(2 * p / (p + q)) if p > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(x / n, y / m) + part(y / m, x / n) for x, y in zip(a, b, strict=True)) / 2))


def verdicts(rows):
    """(base_failed, kept) of each (text, lang)."""
    told, means = [], defaultdict(list)
    for text, lang in rows:
        text = text or ""
        w = re.findall(WORD, text)
        failed = len(w) < quality.MIN_WORDS or 100 * repeats(w) > 50 * len(w)
        h = _histograms(text)
        told.append((lang or "", len(w), failed, h))
        if not failed:
            means[lang or ""].append([[x / sum(c) if sum(c) else 0.0 for x in c] for c in h])
    out = []
    for lang, n, failed, h in told:
        if not means[lang]:
            far = [0.0, 0.0]
        else:
            mean = [[sum(m[k][i] for m in means[lang]) / len(means[lang]) for i in range(len(h[k]))] for k in (0, 1)]
            far = [round(_distance(h[k], mean[k]), 6) for k in (0, 1)]
        strange = far[1] > quality.WORD_LIMIT + math.sqrt(quality.BINS / (8 * math.log(2) * max(n, 1)))
        out.append((failed, not failed and not (far[0] > quality.CLASS_LIMIT or strange and far[0] > quality.CLASS_DOUBT)))
    return out


def grams(line, width):
    return frozenset(line[k : k + width] for k in range(max(1, len(line) - width + 1)))


def line_links(a, b):
    return similar(grams(a, line_dedup.SHINGLE), grams(b, line_dedup.SHINGLE))


def left_lines(rows):
    """Per (doc_id, text) the text that line dedup leaves, None if it goes. Ids are distinct and not null."""
    units = [(d, no, x) for d, t in sorted(rows) for no, x in enumerate(y for y in (t or "").split("\n") if re.search(WORD, y))]
    lines = list(dict.fromkeys(x for _, _, x in units))
    union = Union(len(lines))
    for i, a in enumerate(lines):
        for j in range(i):
            if line_links(a, lines[j]):
                union.join(i, j)
    seen, kept = set(), defaultdict(list)
    for d, _, x in units:
        c = union.find(lines.index(x))
        if c not in seen:
            seen.add(c)
            kept[d].append(x)
    out = {}
    for d, t in rows:
        n = sum(bool(re.search(WORD, y)) for y in (t or "").split("\n"))
        out[d] = t if not n or len(kept[d]) == n else "\n".join(kept[d]) if kept[d] else None
    return out


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return 12 <= len(digits) <= 19 and total % 10 == 0


def identifiers(text):
    """(start, end, kind) of the base kinds."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], list(BASE).index(x[2])))


def disclosed(texts):
    """Per text the (start, end) of terms that give an identifier away."""
    near, every = [], Counter()
    for t, text in enumerate(texts):
        begin = 0
        found = identifiers(text)
        for no, line in enumerate((text or "").split("\n")):
            every.update({m[0].lower() for m in regex.finditer(pii.TERM, line)})
            terms = [(begin + m.start(), begin + m.end(), m[0].lower()) for m in regex.finditer(pii.TERM, line)]
            for a, z, kind in found:
                if begin <= a < begin + len(line):
                    # places among the terms: those that begin before the entity stand before it
                    at = sum(s < a for s, _, _ in terms)
                    for k in range(at - pii.REACH, at + 2 * pii.REACH + 1):
                        if 0 <= k < len(terms) and (terms[k][1] <= a or terms[k][0] >= z):
                            near.append((t, no, line, f"{kind}:{text[a:z].lower()}", terms[k][2], terms[k][0], terms[k][1]))
            begin += len(line) + 1
    places, lines = defaultdict(set), defaultdict(set)
    for t, no, line, entity, term, _, _ in near:
        places[term, entity].add((t, no))
        lines[term, entity].add(line)
    told = {k for k in places if len(lines[k]) >= pii.SUPPORT and len(places[k]) >= pii.SHARE * every[k[0]]}
    out = [set() for _ in texts]
    for t, _, _, entity, term, a, z in near:
        if (term, entity) in told:
            out[t].add((a, z))
    return out


def junk(seed, n, alphabet):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))
