"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def spaced(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def alnum(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def contamination(docs, items) -> dict:
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = alnum(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = alnum(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def shingles(text: str | None, k: int = 3) -> frozenset:
    w = spaced(lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, k: int = 3, over: int = 90, under: int = 100) -> dict:
    """doc -> (set size, smallest doc reachable by links)."""
    distinct: dict[frozenset, list] = {}
    for d, t in docs:
        distinct.setdefault(shingles(t, k), []).append(d)
    keys = [k for k in distinct if k]
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index: dict = {}
    for i, k in enumerate(keys):
        both: dict[int, int] = {}
        for g in k:
            for j in index.get(g, ()):
                both[j] = both.get(j, 0) + 1
            index.setdefault(g, []).append(i)
        for j, n in both.items():
            if under * n >= over * (len(k) + len(keys[j]) - n):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, k in enumerate(keys):
        least[root(i)] = min([least.get(root(i), 10**18), *distinct[k]])
    out = {d: (len(k), least[root(i)]) for i, k in enumerate(keys) for d in distinct[k]}
    return out | {d: (0, d) for d in distinct.get(frozenset(), ())}


def removals(docs) -> dict:
    first: dict[tuple, int] = {}
    words = [(d, spaced(t)) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words:
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def remainder(doc_id, parts: int) -> int:
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % parts


def trie(rows) -> list[tuple]:
    """Rows (conv_id, turn, role, text) to the nodes of the trie of the rebuilt conversations."""
    import zlib

    own: dict[int, list] = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members: dict[tuple, list] = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = lambda x: sum(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children(node), sum(not children(x) for x in under), sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x), sha(ends)))
    return out


def merkle(rows) -> list[tuple]:
    """Rows (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    import zlib

    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    hashed = lambda r, text: sha("".join(map(part, (r[0], r[1], r[2], r[3], text))))

    def tree(nodes):
        """The top, and for each node the (left, right) siblings on each level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, a in enumerate(at):
                run, j = nodes[a // 16 * 16 : a // 16 * 16 + 16], a % 16
                paths[i].append((run[:j], run[j + 1 :]))
                at[i] = a // 16
            nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        return nodes[0], paths

    by: dict = {}
    for r in rows:
        by.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    order, trees = sorted(by), {}
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, hashed(r, r[4])))
        trees[s] = own, *tree([hashed(r, r[4]) for r in own])
    if not order:
        return []
    root, upper = tree([trees[s][1] for s in order])
    out = []
    for s, above in zip(order, upper):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            path = path + above
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = hashed(r, lower(r[4]) if bad and r[4] is not None else r[4])
            for a, b in path:
                node = sha("".join([*a, node, *b]))
            out.append((r[0], hashed(r, r[4]), subroot, root, sha("".join("".join(a + b) for a, b in path)), node, node == root))
    return out


def mixture(rows, weights=(5, 2, 1), most=3) -> tuple[dict, dict]:
    """Rows (doc_id, source, text): each source's size and target, by sharing again and again what is over."""
    sizes: dict = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(spaced(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left, free = total - sum(most * sizes[s] for s in full), [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return sizes, {s: float(most * sizes[s]) if s in full else share[s] for s in order}
        full |= over
