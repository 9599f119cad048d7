"""Plain versions of the operators, one document at a time, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def grams(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def near_duplicates(docs, threshold=0.8):
    """doc index -> (class, links) for (id, text) pairs."""
    sets = [grams(t) for _, t in docs]
    parent = list(range(len(docs)))
    links = [0] * len(docs)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i + 1, len(docs)):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [(docs[top(i)][0], links[i]) for i in range(len(docs))]


def dedup_lines(docs, least=50):
    """doc index -> (text, deleted runs) for (id, text) pairs in order."""
    lines = [(t or "").split("\n") for _, t in docs]
    seen, out = set(), []
    for at in range(len(docs)):
        filled = [(p, len(TOKEN.findall(x))) for p, x in enumerate(lines[at]) if TOKEN.search(x)]
        gone, here = set(), []
        for i in range(len(filled)):
            for j in range(i, len(filled)):
                if sum(w for _, w in filled[i : j + 1]) >= least:
                    here.append((i, j))
        for i, j in here:  # every run of enough words, in order of its start
            key = tuple(lines[at][p] for p, _ in filled[i : j + 1])
            if key in seen:
                gone.update(range(filled[i][0], filled[j][0] + 1))
            seen.add(key)
        out.append(None if docs[at][1] is None else "\n".join(x for p, x in enumerate(lines[at]) if p not in gone))
    return out


def base_spans(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def statistics(text):
    w = TOKEN.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    filled = [x for x in (text or "").split("\n") if TOKEN.search(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(filled) - len(set(filled)), len(covered)]


def encode(tokenizer, text, end_id=1):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def mix(docs, weights=(5, 2, 1), share=1.5, cap=2, seed=17):
    """doc index -> (size, source size, target, taken) for (id, text, source)."""
    sizes = [len(TOKEN.findall(t or "")) for _, t, _ in docs]
    total = defaultdict(int)
    for (_, _, s), n in zip(docs, sizes):
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + ([None] if None in total else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, clamped = share * sum(sizes), set()
    while True:
        free = [s for s in order if s not in clamped]
        left = budget - sum(cap * total[s] for s in clamped)
        level = left / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > cap * total[s]}
        if not more:
            break
        clamped |= more
    target = {s: cap * total[s] if s in clamped else min(cap * total[s], weight[s] * level) for s in order}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    out = [None] * len(docs)
    for s in order:
        mine = sorted((i for i in range(len(docs)) if docs[i][2] == s), key=lambda i: (md5(f"{seed}:{'' if docs[i][0] is None else docs[i][0]}:{md5(docs[i][1] or '')}"), sizes[i]))
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        extra, upto = target[s] - whole * total[s], 0
        for i in mine:
            upto += sizes[i]
            out[i] = (sizes[i], total[s], target[s], (whole + (sizes[i] > 0 and upto - sizes[i] / 2 <= extra)) * sizes[i])
    return out
