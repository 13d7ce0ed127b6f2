"""Plain versions of the operators and a table of awkward documents."""

import hashlib
import random
import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ("h", "th", "id", "n", "node", "size", "kept", "n_words", "score", "gone", "pos", "bits", "keep_id", "pieces")


def awkward(seed=3):
    """Nulls, empty and long texts, ties, repeated rows, near and exact copies, odd white space."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    base = [prose(rng.randint(5, 120)) for _ in range(12)]
    line = "Read  this LINE in every document."
    texts = [None, "", " \n\t", "one", "one", "One two three", base[0], base[0].upper(), base[0] + " tail", "a" * 500, "ab " * 700, prose(9000)]
    for b in base:
        texts += [b, b, b.replace("a", "o", 1), f"{b}\n{line}\n{prose(30)}", f"{line.lower()} \n{b}"]
    rows = [(i * 3 % 997, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "s2", "s3", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, base[1], "en", "s1", 1), (None, "unseen words stand here alone", "en", None, 1)]


def table(spark, rows=None, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if clash else df


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    """(doc_id, n_shingles, component_id), null ids last."""
    key = lambda i: (i is None, i)
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            k = len(sets[a] & sets[b])
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d, key=key)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def suffix_dedup(rows, length=100):
    seen, out = {}, []
    order = lambda r: (r[0] is None, r[0] or 0)
    for d, t in sorted(rows, key=order):
        raw, place = (t or "").encode(), (d is None, d or 0)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            seen[w] = min(seen.get(w, (place, i)), (place, i))
    for d, t in rows:
        raw, place = (t or "").encode(), (d is None, d or 0)
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] < (place, i):
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
