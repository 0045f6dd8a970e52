"""Plain single-process versions of the operators, straight from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(text or "")


def luhn(digits):
    odd = sum(int(x) for x in digits[-1::-2])
    even = sum(sum(map(int, str(2 * int(x)))) for x in digits[-2::-2])
    return (odd + even) % 10 == 0


def pii(rows):
    out = []
    for doc_id, text in rows:
        text, found = text or "", []
        email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
        card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
                if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                 if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        for kind, spans in zip(("email", "ip", "card", "phone"), (email, ip, card, phone)):
            found += [f"{kind}:{a}:{b}" for a, b in spans]
        out.append((doc_id, len(email), len(ip), len(card), len(phone), sha(",".join(found))))
    return out


def suffixes(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def passages(rows, size=13):
    last = 1 << 63
    least = {}
    for doc_id, t in rows:
        w, key = words(t), last if doc_id is None else doc_id
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            least[k] = min(least.get(k, last), key)
    out = []
    for doc_id, t in rows:
        w, key = words(t), last if doc_id is None else doc_id
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if least[tuple(w[i:i + size])] < key:
                gone[i:i + size] = [True] * size
        out.append((doc_id, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def base_rules(rows):
    out = []
    for doc_id, t in rows:
        t = t or ""
        w = words(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        times = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if times[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again),
                    len(w) < 10 or 100 * len(again) > 20 * len(w)))
    return out


def contamination(rows, items, size=13):
    windows = defaultdict(set)
    for item, t in items:
        w = BENCH_WORD.findall(lower(t or ""))
        for i in range(max(1, len(w) - size + 1)):
            if w:
                windows[tuple(w[i:i + size])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, t in rows:
        w = BENCH_WORD.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in windows:
                    hit[i:i + n] = [True] * n
                    found |= windows[k]
        n_hit = sum(hit)
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), n_hit, len(names), sha(",".join(names)), n_hit > 0 and 20 * n_hit >= len(w)))
    return out


def shingles(text, size=5):
    w = words(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))}


def jaccard_components(rows, size=5):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(find(i))) for i, (doc_id, _) in enumerate(rows)]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))
