"""Plain Python versions of the corpus operators' contracts."""

import hashlib
import re
import zlib

WORD3 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD9 = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(text):
    return zlib.crc32(text.encode()) if text is not None else 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def pii(text):
    spans = base_spans(text)
    counts = [sum(s[3] == k for s in spans) for k in BASE]
    return (*counts, sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)))


def contamination(texts, items):
    """texts: list; items: list of (item_id, text).  n_words, n_hit, n_items, sha of each text."""
    windows = {}
    for i, t in items:
        w = WORD3.findall(lower(t or ""))
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, ids = WORD3.findall(lower(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    ids |= windows[x]
        ids = {str(i) for i in ids if i is not None}
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids)))))
    return out


def shingles(text, k=5):
    w = WORD9.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(n, links):
    """Least index reachable of each of n nodes."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def near_duplicates(texts):
    """n_shingles and component (an index) of each text, all pairs compared through an inverted index."""
    sets = [shingles(t) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    links = []
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        links += [(i, j) for j, c in common.items() if 100 * c >= 75 * (len(s) + len(sets[j]) - c)]
    return [len(s) for s in sets], components(len(texts), links)


TERM11 = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows, least=10, top=10):
    """rows: (lang, source, text); the audit's rows."""
    groups, docs, counts = {}, {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        ws = TERM11.findall(lower(text or ""))
        groups.setdefault(lang, set()).add(source)
        for w in set(ws):
            docs[lang, w] = docs.get((lang, w), 0) + 1
        for w in ws:
            counts[lang, source, w] = counts.get((lang, source, w), 0) + 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for (x, w), n in docs.items() if x == lang and n >= least)

        def shares(of, lang=lang, kept=kept):
            n = [sum(counts.get((lang, s, w), 0) for s in of) for w in kept]
            return n, [1 + 10**9 * (k + 2) // (sum(n) + 2 * len(kept)) for k in n]

        p = {s: shares([s]) for s in sources}
        q = shares(sources)[1]
        for s in sources:
            n, own = p[s]
            pairs = [(o, sum((a - b) ** 2 // (a + b) for a, b in zip(own, p[o][1], strict=True))) for o in sources if o != s]
            terms = [(w, (a - b) ** 2 // (a + b)) for w, k, a, b in zip(kept, n, own, q, strict=True) if k and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(found[:most], 1)]
    return sorted(out)


def repeated_bytes(texts, span=400):
    """n_bytes, n_removed, n_spans and the digest of what is left, of each text."""
    raw, seen = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(raw):
        for a in range(len(b) - span + 1):
            seen.setdefault(b[a : a + span], []).append((i, a))
    gone = [set() for _ in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                gone[i].update(range(a, a + span))
    out = []
    for b, g in zip(raw, gone, strict=True):
        spans = sum(x - 1 not in g for x in g)
        out.append((len(b), len(g), spans, hashlib.sha256(bytes(c for x, c in enumerate(b) if x not in g)).hexdigest()))
    return out


def resampled(rows, targets, longest=1, percent=10, least=20, seed=2024, buckets=10000):
    """rows: (doc_id, text); n_features, weight, score and rank of each."""
    import math

    def found(text):
        w = WORD3.findall(lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for b in found(text)[1]:
            s[b] += 1
    for text in targets:
        for b in found(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    out, able = [], []
    for k, (i, text) in enumerate(rows):
        n, f = found(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append([len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
        if n >= least:
            able.append(k)
    able.sort(key=lambda k: (-out[k][2], rows[k][0] is None, rows[k][0] or 0))
    for rank, k in enumerate(able[: percent * len(able) // 100], 1):
        out[k][3] = rank
    return out
