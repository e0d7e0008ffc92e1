"""Plain single-process versions that the operators are held against."""

import hashlib
import re

BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE_PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles5(text):
    """Set of five-word shingles (fewer words: the whole text)."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard5(a, b):
    """Similarity of the sets of five-word shingles."""
    a, b = shingles5(a), shingles5(b)
    return len(a & b) / max(1, len(a | b))


def similar_components(rows):
    """Component (least position) of each of the rows (id, text): equal word sequences, or a Jaccard similarity of 0.8 or more."""
    sets, alike = {}, []
    for k, (_, text) in enumerate(rows):
        words = " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        if words in sets:
            alike.append((sets[words][0], k))
        else:
            sets[words] = (k, shingles5(text))
    seen, common = {}, {}
    for k, s in sets.values():
        for g in s:
            for j in seen.setdefault(g, []):
                common[j, k] = common.get((j, k), 0) + 1
            seen[g].append(k)
    size = {k: len(s) for k, s in sets.values()}
    links = [(a, b) for (a, b), n in common.items() if n * 9 >= 4 * (size[a] + size[b])]  # n / (a + b - n) >= 4 / 5
    return components(range(len(rows)), alike + links), links
