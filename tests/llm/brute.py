"""Plain versions of the contracts, over small lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: str | bytes) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def op2(rows):
    holders = defaultdict(list)
    for i, text in rows:
        for key in {x.strip(BLANK).translate(LOWER) for x in (text or "").split("\n")}:
            if i is None or i not in holders[key]:
                holders[key].append(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for x in lines:
            k = x.strip(BLANK).translate(LOWER)
            own = holders[k]
            if len(k) >= 40 and len(own) >= 5 and i != max((o for o in own if o is not None), default=None):
                continue
            kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def op4(rows, n=400):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for s in range(len(b) - n + 1):
            seen[b[s : s + n]] += 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                gone[s : s + n] = b"\x01" * n
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingle_set(text, n=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def op5(rows, n=3, num=90, den=100):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            at[x].add(k)
    done = set()
    for held in at.values():
        for a in held:
            for b in held:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    both = len(x & y)
                    if den * both >= num * (len(x) + len(y) - both):
                        p, q = find(sets[a][0]), find(sets[b][0])
                        if p != q:
                            parent[max(p, q)] = min(p, q)
    return [(i, len(s), find(i)) for i, s in sets]


def op6(rows):
    out = []
    for i, text in rows:
        text = text or ""
        words = WORD.findall(text)
        grams = defaultdict(list)
        for k in range(len(words) - 7):
            grams[tuple(words[k : k + 8])].append(k)
        hit = {j for ks in grams.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)))
    return out


def op7_base(rows):
    import math

    docs = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, ws in docs if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, held[i], len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in docs]


def op8(rows, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for name, text in items:
        ws = word.findall((text or "").translate(LOWER))
        if ws:
            m = min(window, len(ws))
            for k in range(len(ws) - m + 1):
                windows[tuple(ws[k : k + m])].add(name)
    sizes = sorted({len(w) for w in windows})
    out = []
    for i, text in rows:
        ws = word.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for m in sizes:
            for k in range(len(ws) - m + 1):
                if found := windows.get(tuple(ws[k : k + m])):
                    names |= found
                    hit.update(range(k, k + m))
        out.append((i, len(ws), len(hit), len(names), sha(",".join(sorted(map(str, names)))), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def op10(rows):
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
    )
    out = []
    for i, text in rows:
        found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds) for m in p.finditer(text or "") if len(m[g]) >= least]
        counts = Counter(k for _, k, _ in found)
        out.append((i, counts[0], counts[1], counts[2], sha(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found)))))
    return out


BLANK_TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def op11(rows):
    out = []
    for i, t in rows:
        t = t or ""
        units = BLANK_TOKENS.findall(t)
        h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            out.append((i, n, "plain", None, None, sha(t), sha(t)))
        elif h[3] % 100 < 80:
            out.append((i, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)))
        else:
            out.append((i, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)))
    return out


def op12(rows, encoding):
    out = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids))), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()))
    return out


def op13(rows, labels):
    """rows: id, text, source; labels: id, quality, toxic."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
        docs.append((s or "", {c for c, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own, share, mine = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, c in enumerate(order):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                share[c] += len(gone)
                mine.append((c, part, "".join(order), step + 1, len(left), len(gone), sum(c in d[1] for d in own) - len(gone), sum(d[1] == {c} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*r[1:], share[r[0]]) for r in mine]
    return out
