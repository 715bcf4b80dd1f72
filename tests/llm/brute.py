"""Plain, slow versions of the operators, and small tables with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, `__row` string, d string"


def documents(spark, texts):
    """texts: (doc_id, text); the extra columns have names that operators might use themselves."""
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "src0", len(t or ""), "x", "y", "z")
                                  for i, t in texts], DOCS)


def prose(rng, words, stock=400):
    return [f"w{rng.randrange(stock)}" for _ in range(words)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_components(docs, percent=85):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def line_dedup(docs, min_words):
    """(doc_id -> text) after deleting, from every place, the longest run of
    lines that occurs earlier, if it has min_words words."""
    seq = []
    for i, t in sorted(docs):
        if t is not None:
            lines = t.split("\n")
            seq.append((i, lines))
    places = [(a, k) for a, (_, lines) in enumerate(seq) for k in range(len(lines))]
    gone = set()
    for n, (a, k) in enumerate(places):
        best = 0
        for b, j in places[:n]:
            m, x, y = 0, seq[a][1], seq[b][1]
            while k + m < len(x) and j + m < len(y) and x[k + m] == y[j + m]:
                m += 1
            best = max(best, m)
        if sum(len(words_of(x)) for x in seq[a][1][k:k + best]) >= min_words:
            gone |= {(a, q) for q in range(k, k + best)}
    out = {i: None for i, t in docs}
    for a, (i, lines) in enumerate(seq):
        out[i] = "\n".join(x for k, x in enumerate(lines) if (a, k) not in gone)
    return out


def best_fit_rooms(lengths, capacity):
    """Remaining rooms of all sequences, by placing one document at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def quality(text):
    t = text or ""
    w = words_of(t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    again = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    dup = len(lines) - len(set(lines))
    base = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in "#*$%&|<>" for c in t), n_dup_lines=dup,
                n_repeat_words=len(again))
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    kept = not (failed or 100 * base["n_symbols"] > 50 * len(w) or 100 * dup > 30 * len(lines)
                or base["word_chars"] < 2 * len(w) or base["word_chars"] > 15 * len(w))
    return base | {"base_failed": failed, "kept": kept}


def secret_bases(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    joined = ",".join(x for *_, x in sorted(out))
    return [sum(k == n for _, k, _ in out) for n in range(3)], hashlib.sha256(joined.encode()).hexdigest(), joined


def warc_rows(pages):
    groups = defaultdict(list)
    for p, _, html in pages:
        groups[(html or "").encode()].append(p)
    out = []
    for p, _, html in pages:
        body = (html or "").encode()
        first = min(groups[body])
        again = len(body) >= 100 and p != first
        out.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out)
