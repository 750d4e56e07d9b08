"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def pii_row(text: str | None) -> tuple:
    spans = pii_spans(text)
    written = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*[sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(written.encode()).hexdigest())


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_row(url: str | None) -> tuple:
    """(host, path, rule, the rule's verdict)."""
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def removed_bytes(texts: list[str | None], length: int = 200, keep_first: bool = False) -> list[list[bool]]:
    """For each text, which of its bytes a repeated string of that length covers; with keep_first, one that also starts earlier."""
    seen: dict[bytes, int] = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    before: set[bytes] = set()
    for d in data:
        flags = [False] * len(d)
        for i in range(len(d) - length + 1):
            window = d[i : i + length]
            if seen[window] > 1 and (not keep_first or window in before):
                flags[i : i + length] = [True] * length
            if keep_first and seen[window] > 1:
                before.add(window)
        out.append(flags)
    return out


def removal_row(text: str | None, flags: list[bool]) -> tuple:
    """(n_bytes, n_removed, n_spans, kept_sha256)."""
    data = (text or "").encode()
    spans = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
    return len(data), sum(flags), spans, hashlib.sha256(bytes(c for c, f in zip(data, flags, strict=True) if not f)).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def shingles(text: str | None, n: int = 5) -> list[tuple[str, ...]]:
    w = words(text)
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def least_reachable(nodes: list, links: set[tuple]) -> dict:
    near = {v: {v} for v in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for v in sorted(nodes):
        if v in out:
            continue
        stack = [v]
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = v
                stack += near[x]
    return out


def url_segments(path: str) -> tuple[str, ...]:
    out = []
    for x in [p for p in path.split("/") if p][: 6 + 1]:
        if len(out) == 6:
            out.append("{deep}")
        elif re.search("^[0-9]+$", x):
            out.append("{n}")
        elif m := re.search(r"^[0-9]+(\.[A-Za-z]{1,5})$", x):
            out.append("{n}" + m[1])
        elif re.search("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", x):
            out.append("{date}")
        elif re.search("^(?=.*[0-9])[0-9A-Fa-f-]{8,}$", x):
            out.append("{hex}")
        elif len(x) > 40 or re.search("^(?=(?:.*[0-9]){3})[A-Za-z0-9_-]{12,}$", x):
            out.append("{id}")
        else:
            out.append(x)
    return tuple(out)


def url_verdicts(urls: list[str | None]) -> list[str]:
    """The rules' verdicts, and for other urls those of templates: variable segments, wide levels, merged siblings, smoothed purity."""
    rows = [url_row(u) for u in urls]
    raw = [(host, url_segments(path)) for host, path, _, _ in rows]
    leaf: dict[tuple, list] = {}  # (host, raw segments) -> n, labelled, bad
    for key, (_, _, _, verdict) in zip(raw, rows, strict=True):
        cell = leaf.setdefault(key, [0, 0, 0])
        cell[0] += 1
        cell[1] += verdict is not None
        cell[2] += verdict == "block"
    name = {key: key[1] for key in leaf}
    deepest = max((len(t) for t in name.values()), default=0)

    def sums(of):
        out: dict[tuple, list] = {}
        for key, cell in leaf.items():
            group = of(key)
            if group is not None:
                out[group] = [a + b for a, b in zip(out.get(group, [0, 0, 0]), cell, strict=True)]
        return out

    for level in range(deepest):
        children: dict[tuple, list] = {}
        for (host, above, _), cell in sums(lambda k, v=level: (k[0], name[k][:v], name[k][v]) if len(name[k]) > v else None).items():
            children.setdefault((host, above), []).append(cell[0])
        wide = {k for k, ns in children.items() if len(ns) >= 30 and sum(ns) < 3.0 * len(ns)}
        name = {k: (*t[:level], "*", *t[level + 1 :]) if len(t) > level and (k[0], t[:level]) in wide else t for k, t in name.items()}
    for level in reversed(range(deepest)):
        own = sums(lambda k, v=level: (k[0], name[k]) if len(name[k]) > v else None)
        pools: dict[tuple, list] = {}
        like = lambda t, v=level: (*t[:v], "{like}", *t[v + 1 :])
        for (host, t), cell in own.items():
            pools.setdefault((host, like(t)), []).append(cell)
        joined = set()
        for (host, t), (_, labelled, bad) in own.items():
            pool = pools[host, like(t)]
            all_, all_bad = sum(c[1] for c in pool), sum(c[2] for c in pool)
            if len(pool) > 1 and all_ > 0:
                share = all_bad / all_
                error = (max(share * (1 - share), 0.25 / all_) / max(labelled, 1)) ** 0.5
                if labelled == 0 or abs(bad / labelled - share) <= 1.96 * error:
                    joined.add((host, t))
        name = {k: like(t) if (k[0], t) in joined else t for k, t in name.items()}
    own = sums(lambda k: (k[0], name[k]))
    prior = (sum(c[2] for c in leaf.values()) + 1) / (sum(c[1] for c in leaf.values()) + 2)
    reject = {k for k, (_, labelled, bad) in own.items() if labelled >= 3 and (bad + 4 * prior) / (labelled + 4) >= 0.5}
    return [verdict or ("block" if (key[0], name[key]) in reject else "allow") for key, (_, _, _, verdict) in zip(raw, rows, strict=True)]


def language_scores(train: list[tuple[str | None, str | None]], texts: list[str | None], buckets: int = 1 << 15) -> list[tuple[str, float]]:
    """Multinomial naive Bayes over hashed runs of one to three characters, one text at a time."""

    def grams(text: str | None) -> tuple[Counter, int]:
        codes = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()]
        out, letters = Counter(), sum(c != 32 for c in codes)
        for n in (1, 2, 3):
            for i in range(len(codes) - n + 1):
                h = 0
                for c in codes[i : i + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                g = (h + n) * 0x9E3779B1 & 0xFFFFFFFF
                g = (g ^ (g >> 15)) * 0x85EBCA77 & 0xFFFFFFFF
                out[g >> 17] += 1
        return out, letters

    counts, docs = {}, Counter()
    for text, lang in train:
        if text is not None and lang is not None:
            got, letters = grams(text)
            if letters:
                counts.setdefault(lang, Counter()).update(got)
                docs[lang] += 1
    names = sorted(counts)
    base = {x: math.log(sum(counts[x].values()) + 0.5 * buckets) for x in names}
    out = []
    for text in texts:
        got, letters = grams(text)
        if not letters or not names:
            out.append(("und", 0.0))
            continue
        total = [math.log(docs[x] / sum(docs.values())) + sum(n * (math.log(counts[x][b] + 0.5) - base[x]) for b, n in got.items()) for x in names]
        best = max(range(len(names)), key=lambda i: total[i])
        out.append((names[best], 1 / sum(math.exp(min(t - total[best], 0)) for t in total)))
    return out
