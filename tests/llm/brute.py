"""The operators' results by the plainest means, for small tables."""

import hashlib
import math
from collections import Counter, defaultdict

import regex
import tiktoken
import xxhash


def words(text):
    return (text or "").encode().split()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- op1 --------------------------------------------------------------------------------------

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base_scan(text):
    """(n_words, n_base, first_word, last_word, base_labels)."""
    found = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split(" ")
        for k in range(len(found) - len(want) + 1):
            if found[k : k + len(want)] == want:
                places.append(k)
                labels.add(label)
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


# --- op3 --------------------------------------------------------------------------------------


def removed(texts, window=35):
    """Per text (n_words, n_removed, words left joined)."""
    counts = Counter(tuple(w[k : k + window]) for w in map(words, texts) for k in range(len(w) - window + 1))
    out = []
    for text in texts:
        w = words(text)
        gone = {k + j for k in range(len(w) - window + 1) if counts[tuple(w[k : k + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


# --- op7 --------------------------------------------------------------------------------------


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(values, radius=3):
    """The index of the first value of each value's component."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


# --- op10 -------------------------------------------------------------------------------------


def targets(sizes, weights=(1, 2, 3), most=3):
    """sizes: words of each source -> target of each source, by filling up sources until none is above its cap."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, unsettled = sum(sizes.values()), {}, set(names)
    while unsettled:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in unsettled) for s in unsettled}
        over = {s for s in unsettled if share[s] > most * sizes[s]}
        target |= {s: float(most * sizes[s]) for s in over} if over else share
        unsettled = unsettled - over if over else set()
    return weight, target


def mixed(rows, weights=(1, 2, 3), most=3):
    """rows (source, size, place): how often each is taken, by finish times in one queue."""
    sizes = Counter()
    for source, size, _ in rows:
        sizes[source] += size
    weight, _ = targets(sizes, weights, most)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or "", rows[k][2]))
    upto, queue = Counter(), []
    for turn, k in enumerate(order):
        source, size, _ = rows[k]
        upto[source] += size
        queue += [((upto[source] + p * sizes[source]) / weight[source], turn, k) for p in range(most) if size]
    taken, total = Counter(), 0
    for _, _, k in sorted(queue):
        total += rows[k][1]
        if total > sum(sizes.values()):
            break
        taken[k] += 1
    return [taken[k] for k in range(len(rows))]


# --- op6 --------------------------------------------------------------------------------------


def encoding(files):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(files[0], "rb"))}
    return tiktoken.Encoding("plain", pat_str=files[1], mergeable_ranks=ranks, special_tokens={})


def token_digests(own, text):
    """(n_tokens, ids_sha256, decoded_sha256)."""
    ids = own.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


# --- op5 --------------------------------------------------------------------------------------


def style_tree(pages, blend, floor):
    """pages: (host, [(place, prior, style, text), ...]) -> importance of (host, place), place by place."""
    size = Counter(host for host, _ in pages)
    seen = defaultdict(Counter)  # (host, place, kind) -> value -> pages
    prior = {}
    for host, rows in pages:
        for place, p, style, text in set(rows):
            prior[place] = p
        for place, style in {(r[0], r[2]) for r in rows}:
            seen[host, place, 0][style] += 1
        for place, text in {(r[0], r[3]) for r in rows}:
            seen[host, place, 1][text] += 1
    own, whole = {}, defaultdict(list)
    for host, place, kind in seen:
        if kind:
            log_m = math.log(max(2, size[host]))
            n = sum(seen[host, place, 0].values())
            entropy = -sum(k / n * math.log(k / n) for k in seen[host, place, 0].values()) / log_m
            worth = [1 - math.log(k) / log_m for k in seen[host, place, 1].values()]
            own[host, place] = max(entropy, sum(worth) / len(worth))
            whole[host] += worth
    near = lambda x, n, far: (x * n + far * blend) / (n + blend)

    def pooled(values, default=1.0):
        n = sum(size[h] - 1 for h, _ in values)
        return near(sum(x * (size[h] - 1) for h, x in values) / max(n, 1), n, default)

    elsewhere = {place: pooled([(h, x) for (h, q), x in own.items() if q == place], min(1.0, prior[place] ** 2)) for _, place in own}
    average = pooled([(h, sum(x) / len(x)) for h, x in whole.items()])
    out = {}
    for (host, place), x in own.items():
        root = near(sum(whole[host]) / len(whole[host]), size[host] - 1, average)
        out[host, place] = prior[place] * min(1.0, (near(x, size[host] - 1, elsewhere[place]) + floor) / (root + floor))
    return out
