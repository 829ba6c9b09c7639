"""Documents that every operator has to bear, and brute-force versions of what the operators do."""

import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return words((text or "").translate({c: c + 32 for c in range(65, 91)}))


def prose(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"v{i}" for i in range(60_000))
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "  \n\t ", "en", "a", 5),
        (4, "one two", None, "a", 7),
        (5, "one two", "de", None, 7),
        (5, "one two", "de", None, 7),
        (None, "null id with a few words in it", "en", "a", None),
        (6, long, "en", "b", len(long)),
        (7, "x" * 300_000, "en", "b", 300_000),
        (8, "é ü ñ 1234 ▁ \x00 <|turn|> 4111111111111111", "es", "c", 40),
    ]


def crowded(df):
    """``df`` with further columns whose names operators use for their own results."""
    from pyspark.sql import functions as F

    for name in ("Kept", "score", "ids", "node", "key", "finds", "n_words", "d", "c", "rule", "component_id", "target_"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def jaccard(rows, width, percent):
    """{doc_id: (set size, component)} by comparing all pairs that share a shingle."""
    sets, holders = {}, defaultdict(set)
    for key, text in rows:
        w = lowered(text)
        sets[key] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        for s in sets[key]:
            holders[s].add(key)
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in sets.items():
        for other, both in Counter(j for s in own for j in holders[s] if j < k).items():
            if 100 * both >= percent * (len(own) + len(sets[other]) - both):
                a, b = top(k), top(other)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), top(k)) for k in sets}
