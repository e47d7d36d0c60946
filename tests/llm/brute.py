"""What the operators compute, once more in plain Python; nothing here is taken from the operators but their constants."""

import math
import re

import zstandard

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def base_failed(counts):
    return counts[0] < 20 or 100 * counts[4] > 30 * counts[0]


def band_reason(text, bands, chunk, low, high, low_share, high_share):
    """The reason of the compression bands."""
    data = (text or "").encode()
    if not data:
        return None
    size = lambda x: len(zstandard.compress(x, 3))
    limits = max((b for b in bands if b.bytes <= len(data)), key=lambda b: b.bytes)
    ratio = size(data) / len(data)
    if ratio < limits.low:
        return "repetitive"
    if ratio > limits.high:
        return "incompressible"
    pieces = [data[i : i + chunk] for i in range(0, len(data) - chunk + 1, chunk)]
    if len(data) >= chunk and len(data) % chunk:
        pieces.append(data[len(data) - chunk :])
    ratios = [size(x) / chunk for x in pieces]
    if ratios and sum(r < low for r in ratios) > low_share * len(ratios):
        return "repetitive chunks"
    if ratios and sum(r > high for r in ratios) > high_share * len(ratios):
        return "incompressible chunks"
    return None


ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sentences(text):
    """Lists of words without the punctuation around them; a sentence ends at . ! ? and, with words or without, at a line's end."""
    out, lines = [], lower_ascii(text or "").split("\n")
    for k, line in enumerate(lines):
        now = []
        for w in WORD.findall(line):
            now.append(w.strip(ASCII_PUNCTUATION))
            if w.rstrip("\"')]}").endswith((".", "!", "?")):
                out.append(now)
                now = []
        if k < len(lines) - 1 or now or not out:
            out.append(now)
    return out


def toxicity(text, bias, weights):
    """Noisy-or over sentences."""
    clean = 1.0
    for s in sentences(text):
        clean *= 1 / (1 + math.exp(bias + sum(weights.get(w.encode(), 0.0) for w in s if w)))
    return 1 - clean


def best_path_value(z, penalty):
    """The value of the best path of labels, by dynamic programming over all pairs."""
    total = list(z[0])
    for row in z[1:]:
        total = [max(t - (penalty if i != j else 0) for i, t in enumerate(total)) + row[j] for j in range(len(row))]
    return max(total)


def connected(pairs, names):
    root = {n: n for n in names}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[top(a)] = top(b)
    return {n: top(n) for n in names}


def shingles(text, n):
    words = [lower_ascii(w) for w in WORD.findall(text or "")]
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def near_copies(texts, n, percent):
    """For each text the number of its group, by all pairs."""
    sets = [shingles(t, n) for t in texts]
    sizes = list(map(len, sets))
    may = ((i, j) for i in range(len(sets)) for j in range(i) if sizes[i] and sizes[j] and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]))
    pairs = [(i, j) for i, j in may if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return connected(pairs, range(len(texts)))


def shares(sizes, weights=(1, 2, 3), most=3):
    """Target words of each source: what is above a source's limit is shared again, round by round."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped = {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = sum(sizes.values()) - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: most * sizes[s] for s in rest if share[s] > most * sizes[s]}
        if not over:
            return {**stopped, **share}
        stopped |= over
