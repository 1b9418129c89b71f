"""Plain, whole-table versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from datetime import date, timedelta
from itertools import combinations

import regex
import xxhash


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def simhash(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict) -> dict:
    """doc_id -> least doc_id that links of 2 or fewer bits reach."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def without_repeats(docs: list[tuple], window: int) -> dict:
    """doc_id -> (words, removed, kept text)."""
    first: dict[tuple, int] = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def kept_lines(docs: list[tuple], run: int = 3, min_words: int = 50) -> dict:
    """doc_id -> text without later repeats of runs of lines, or of fewer lines of min_words words; docs in order of doc_id."""
    norm = lambda line: " ".join(line.lower().split())
    seen: set[tuple] = set()
    out = {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        keys = [norm(lines[i]) for i in at]
        gone = set()
        for s in range(len(keys)):
            for size in range(1, run + 1):
                k = tuple(keys[s : s + size])
                if len(k) == size and (size == run or sum(len(x.split()) for x in k) >= min_words):
                    if k in seen:
                        gone |= {at[j] for j in range(s, s + size)}
                    seen.add(k)
                    break
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def lz_phrases(data: bytes) -> set[bytes]:
    found, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in found:
            found.add(data[start:end])
            start = end
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- pseudonyms, one value at a time ---


def _round(key: str, tweak: str, i: int, x) -> int:
    return int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)


def feistel(key: str, tweak: str, left: int, right: int, a: int, b: int) -> tuple[int, int]:
    for i in range(10):
        if i % 2 == 0:
            left = (left + _round(key, tweak, i, right)) % a
        else:
            right = (right + _round(key, tweak, i, left)) % b
    return left, right


def digits_permuted(key: str, tweak: str, d: str) -> str:
    n, la = len(d), len(d) // 2
    x, y = feistel(key, f"{tweak}:{n}", int(d[:la] or 0), int(d[la:]), 10**la, 10 ** (n - la))
    return (str(x).zfill(la) if la else "") + str(y).zfill(n - la)


def filled(layout: str, chars: str, slot: str) -> str:
    rest = iter(chars)
    return "".join(next(rest) if re.match(slot, c) else c for c in layout)


def text_permuted(key: str, s: str) -> str:
    left, right = s[: len(s) // 2], s[len(s) // 2 :]

    def shifted(part: str, other: str, i: int) -> str:
        stream = hashlib.sha256(f"{key}|email|{len(s)}|{i}|{other}".encode()).hexdigest()
        out = []
        for j, c in enumerate(part):
            add = int(stream[j % 30 * 2 : j % 30 * 2 + 4], 16)
            for first, n in (("a", 26), ("A", 26), ("0", 10)):
                if ord(first) <= ord(c) < ord(first) + n:
                    c = chr(ord(first) + (ord(c) - ord(first) + add) % n)
                    break
            out.append(c)
        return "".join(out)

    for i in range(10):
        if i % 2 == 0:
            left = shifted(left, right, i)
        else:
            right = shifted(right, left, i)
    return left + right


def mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def pseudonym(key: str, kind: str, m: str) -> str | None:
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        name, host = m.split("@")
        return text_permuted(key, name) + "@" + host
    if kind == "card":
        if not luhn(d):
            return None
        body = d[0] + digits_permuted(key, "card", d[1:-1])
        return filled(m, body + next(c for c in "0123456789" if luhn(body + c)), "[0-9]")
    if kind == "iban":
        s = m.replace(" ", "")
        body = s[4:]
        own = re.sub("[^0-9]", "", body)
        if mod97(body + s[:4]) != 1 or not 15 <= len(s) <= 34 or not own:
            return None
        body = filled(body, digits_permuted(key, "iban", own), "[0-9]")
        return filled(m, s[:2] + str(98 - mod97(body + s[:2] + "00")).zfill(2) + body, "[A-Z0-9]")
    if kind == "phone":
        head, ten = d[:-10], d[-10:]
        area, exchange, line = int(ten[:3]), int(ten[3:6]), int(ten[6:])
        if area < 200 or exchange < 200:
            return None
        x, y = feistel(key, "phone", (area - 200) * 800 + exchange - 200, line, 640_000, 10_000)
        return filled(m, f"{head}{x // 800 + 200:03}{x % 800 + 200:03}{y:04}", "[0-9]")
    if kind == "ssn":
        area, group, serial = (int(x) for x in m.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        x, y = feistel(key, "ssn", (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        area = x // 99 + 1
        return f"{area + (area >= 666):03}-{x % 99 + 1:02}-{y + 1:04}"
    if kind == "ip":
        p = m.split(".")
        if any(int(x) > 255 or (x[0] == "0" and len(x) > 1) for x in p):
            return None
        a, b, c, e = map(int, p)
        x, y = feistel(key, "ip", a * 256 + b, c * 256 + e, 65_536, 65_536)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    sep = next(c for c in "-/." if c in m)
    p = m.split(sep)
    order = {"-": (0, 1, 2), "/": (2, 0, 1), ".": (2, 1, 0)}[sep]
    try:
        n = (date(*(int(p[i]) for i in order)) - date(1800, 1, 1)).days
    except ValueError:
        return None
    if not 0 <= n < 146_097:
        return None
    x, y = feistel(key, "date", n // 773, n % 773, 189, 773)
    day = date(1800, 1, 1) + timedelta(days=x * 773 + y)
    out = [""] * 3
    for i, v in zip(order, (day.year, day.month, day.day), strict=True):
        out[i] = str(v).zfill(len(p[i]))
    return sep.join(out)


def pseudonyms(key: str, text: str | None, pattern: str, kinds: dict[str, str]) -> tuple[str | None, list[str]]:
    """The text with its values replaced, and their kinds; which stretches count as values is told by the patterns."""
    found = []
    ascii_digits = lambda p: p.replace(r"\d", "[0-9]")  # noqa: E731  as Spark's expressions take them

    def one(m) -> str:
        kind = next(k for k, p in kinds.items() if regex.fullmatch(ascii_digits(p), m[0]))
        new = pseudonym(key, kind, m[0])
        if new is None:
            return m[0]
        found.append(kind)
        return new

    return (None if text is None else regex.sub(ascii_digits(pattern), one, text)), found


# --- language ---


def fused(pages: list[dict]) -> list[list[float]]:
    """Log posteriors of pages (ll, declared, suffix, domain, host), normalised."""
    import math

    k = range(len(pages[0]["ll"]))
    for p in pages:
        e = [math.exp(x) for x in p["ll"]]
        p["p"] = [x / sum(e) for x in e]
    every = [sum(p["p"][i] for p in pages) for i in k]
    out = []
    for p in pages:
        others = lambda *names: [sum(q["p"][i] for q in pages if q is not p and all(q[n] == p[n] for n in names)) for i in k]  # noqa: B023, E731
        total = lambda *names: [sum(q["p"][i] for q in pages if all(q[n] == p[n] for n in names)) for i in k]  # noqa: B023, E731
        domain, host = others("domain"), others("domain", "host")
        domain = [(x + 20 * every[i] / sum(every)) / (sum(domain) + 20) for i, x in enumerate(domain)]
        host = [(x + 5 * domain[i]) / (sum(host) + 5) for i, x in enumerate(host)]
        score = [p["ll"][i] + math.log(max(host[i], 1e-12)) for i in k]
        for mark in ("declared", "suffix"):
            own, share = others(mark), sum(total(mark)) / sum(every)
            score = [s + math.log((own[i] + 10 * share) / (every[i] - p["p"][i] + 10)) for i, s in enumerate(score)]
        norm = max(score) + math.log(sum(math.exp(s - max(score)) for s in score))
        out.append([s - norm for s in score])
    return out


def lower_az(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, items, longest matches) by trying every window at every place."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(t))
    tests = [("" if i is None else str(i), split(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        w, hit, found, matches = split(text), set(), set(), set()
        for name, t in tests:
            n = min(window, len(t))
            for a in range(len(t) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == t[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(name)
                        if not (a and b and w[b - 1] == t[a - 1] and n == window):
                            k = n
                            while a + k < len(t) and b + k < len(w) and w[b + k] == t[a + k]:
                                k += 1
                            matches.add((name, a, b, k))
        out.append((doc_id, len(w), len(hit), sorted(found), sorted(matches)))
    return out


def merkle(rows: list[tuple]) -> list[tuple]:
    """(id, leaf, subroot, root, proof_sha256, folded_root) of rows (group, id, leaf, found)."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()

    def climb(leaves):
        ways, level = [[] for _ in leaves], list(leaves)
        places = list(range(len(leaves)))
        while len(level) > 1:
            for i, p in enumerate(places):
                a = p // 8 * 8
                ways[i].append(("".join(level[a:p]), "".join(level[p + 1 : a + 8])))
            level = [h(*level[a : a + 8]) for a in range(0, len(level), 8)]
            places = [p // 8 for p in places]
        return level[0], ways

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        subs[g] = climb([r[2] for r in groups[g]])
    root, over = climb([subs[g][0] for g in names])
    out = []
    for g, up in zip(names, over, strict=True):
        for (_, i, leaf, found), way in zip(groups[g], subs[g][1], strict=True):
            node = found
            for a, b in way + up:
                node = h(a, node, b)
            out.append((i, leaf, subs[g][0], root, h(*(a + b for a, b in way + up)), node))
    return out


def audit(docs: list[tuple]) -> list[tuple]:
    """(lang, source, part, item, value, rank) of documents (lang, source, text)."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower_az(t))) for a, b, t in docs]
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = [t for d in mine for t in set(d[2])]
        kept = sorted({t for t in seen if seen.count(t) >= 3})
        share = lambda ws: {t: 1 + 10**9 * (ws.count(t) + 1) // (len(ws) + len(kept)) for t in kept}
        words = {s: [w for d in mine if d[1] == s for w in d[2] if w in kept] for s in {d[1] for d in mine}}
        p, q = {s: share(ws) for s, ws in words.items()}, share([w for ws in words.values() for w in ws])
        for s in words:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in words if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(p[s][t], q[t]), t) for t in kept if t in words[s] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:200]
            for part, rows in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(rows)]
    return out
