"""Plain versions of the operators' contracts, for comparison on small fixtures."""

import hashlib
import re


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UP)) if w]


def space_words(text, lower=False):
    text = text or ""
    return [w for w in re.split("[\x20\x09-\x0d]+", text.translate(UP) if lower else text) if w]


def licenses(text):
    words = alnum_words(text)
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def contamination(text, items):
    words = alnum_words(text)
    hit, ids = set(), set()
    for item, said in items:
        w = alnum_words(said)
        if not w:
            continue
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                ids.add(str(item))
    return len(words), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)


def shingles(text, k):
    w = space_words(text, lower=True)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near_duplicates(docs, k, percent):
    """{doc_id: (n, component)} for distinct non-null ids."""
    sets = {i: shingles(t, k) for i, t in docs}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def substring_dedup(docs, window=20):
    """{doc_id: (n_words, n_removed, sha)} for distinct ids in any order."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        w = space_words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out[i] = len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def base_secrets(text):
    text, spans = text or "", []
    key = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def quality_measures(text):
    text = text or ""
    w = space_words(text)
    lines = [x for x in text.split("\n") if space_words(x)]
    seen, where = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                where.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(where) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(where), failed
