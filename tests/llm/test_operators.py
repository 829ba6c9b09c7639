"""Each operator against a brute-force version, and on the cases that every operator has to bear."""

import collections
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ravelin.llm import chat_format, co_training, decontaminate, language_id, piece_codec, pseudo_likelihood, pseudonyms, quality_trees, sketch_join, suffix_dedup
from ravelin.llm.components import components
from ravelin.llm.wordhash import WordHasher
from tests.llm import cases, plain_pseudonyms

MODEL = public_tokenizers.path("piece_bpe_32k.model")
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return cases.crowded(spark.createDataFrame(cases.odd_rows(), cases.SCHEMA)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.crowded(spark.createDataFrame([], cases.SCHEMA))


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{D}/documents.parquet").cache()


def counted(rows):
    return sorted(map(repr, rows))


# ── 1: quality rules ──────────────────────────────────────────────


def brute_counts(text):
    w, text = cases.words(text), text or ""
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if cases.words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return [len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(marked)]


@pytest.mark.parametrize("text", [None, "", "\n\n", " a\n a\n\n", "é ü\x85x y\x1cz " * 9, "a " * 8, "a " * 9, "x\r\nx\r\n", "a b c d e f g h i a b c d e f g h"])
def test_counts(text):
    assert quality_trees.measures(text)[0] == brute_counts(text)


def test_quality_rules_on_all_documents(spark, real):
    forest = quality_trees.train(real, spark.read.parquet(f"{D}/labels.parquet"))
    rows = quality_trees.judge(real, forest).collect()
    for r in rows:
        counts = brute_counts(r.text)
        assert counts == [r[c] for c in quality_trees.COUNTS]
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert r.kept == (not r.base_failed and r.quality_score >= 0.5)
    assert len(rows) == real.count()


def test_forest_learns_and_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.3 * rng.random(2000) < 0.6) & (x[:, 1] > 0.2)).astype(float)
    forest = quality_trees.fit_forest(x, y, falling=(0,))
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.93
    grid = rng.random((50, 3))
    scores = []
    for v in np.linspace(0, 1, 40):
        grid[:, 0] = v
        scores.append(forest.probability(grid))
    assert (np.diff(np.array(scores), axis=0) <= 1e-12).all()


def test_quality_rules_bear_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 0), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_trees.train(odd, labels) is None
    rows = quality_trees.judge(odd, None).collect()
    assert len(rows) == odd.count() and {r.doc_id for r in rows if r.kept} == {6}
    assert rows[0].score == "own score"
    forest = quality_trees.fit_forest(np.random.default_rng(1).random((50, len(quality_trees.FEATURES))), np.arange(50) % 2.0)
    assert quality_trees.judge(odd, forest).count() == odd.count()
    assert quality_trees.judge(none, forest).count() == 0 and quality_trees.train(none, labels) is None


# ── 2: decontamination ────────────────────────────────────────────


def test_overlaps_survive_substitutions_and_spare_clean_texts(spark):
    rng = random.Random(5)
    items = [(i, cases.prose(rng, 14 + 5 * i, 5000)) for i in range(8)]
    docs, expected = [], set()
    for k in range(80):
        body = cases.prose(rng, 200, 5000).split()
        if k % 2:
            i = k % 8
            passage = items[i][1].split()
            for _ in range(len(passage) // 8):
                passage[rng.randrange(len(passage))] = "other"
            at = rng.randrange(200)
            body[at:at] = passage
            expected.add((k, i))
        docs.append((k, " ".join(body).upper() if k % 3 else " ".join(body)))
    found = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    for r in found:
        run = cases.lowered(dict(docs)[r.doc_id])[r.start : r.start + r.n_words]
        assert r.n_words >= 10 and len(run) == r.n_words


def test_masks_hold_in_every_pattern_within_the_thresholds():
    for length in range(10, 22):
        changed = length - max(8, -(-70 * length // 100))
        patterns = (1 << length) - 1 - np.array([sum(1 << k for k in c) for c in itertools.combinations(range(length), changed)], np.int64)
        held = np.zeros(len(patterns), bool)
        for mask in decontaminate.MASKS:
            own = sum(1 << k for k in mask)
            for at in range(length - mask[-1]):
                held |= patterns & (own << at) == own << at
        assert held.all()


def brute_stretch(same, least, equal, percent):
    sizes = [(y - x, x) for x in range(len(same)) for y in range(x + least, len(same) + 1) if sum(same[x:y]) >= equal and 100 * sum(same[x:y]) >= percent * (y - x)]
    ends = [n for n, x in sizes if same[x] and same[x + n - 1]]
    return max(ends, default=least) if sizes else None


def test_stretches_against_brute_force():
    rng = random.Random(7)
    for _ in range(3000):
        same = np.array([rng.random() < rng.choice((0.5, 0.7, 0.8)) for _ in range(rng.randrange(30))], bool)
        for limits in ((10, 8, 70), (5, 5, 70), (12, 3, 40)):
            found = decontaminate.longest_stretch(same, *limits)
            assert (found and found[1] - found[0]) == brute_stretch(same.tolist(), *limits)
            for x, y in decontaminate.stretches(same, *limits):
                assert y - x >= limits[0] and same[x:y].sum() >= limits[1] and 100 * same[x:y].sum() >= limits[2] * (y - x)


def test_overlaps_within_the_thresholds_are_found(spark):
    changed = {0: (40, range(3, 40, 4)), 1: (15, (2, 12)), 2: (12, (9,)), 3: (20, (9, 10, 11, 14, 18)), 4: (14, range(1, 14, 4)), 5: (11, (2, 5, 8)), 6: (60, (*range(9, 40), 43, 47))}
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, (n, _) in changed.items()]
    docs = [(k, " ".join([*(f"d{j}" for j in range(30)), *(f"x{j}" if j in places else f"i{k}w{j}" for j in range(n)), *(f"e{j}" for j in range(30))])) for k, (n, places) in changed.items()]
    found = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, k) for k in changed}
    assert {(r.start, r.n_words, r.n_equal) for r in found if r.doc_id in (1, 2)} == {(30, 15, 13), (30, 12, 11)}
    assert {(r.start, r.n_words) for r in found if r.doc_id == 6} >= {(70, 20)}


def test_overlaps_on_documents(spark, real):
    items = spark.read.parquet(f"{D}/benchmark.parquet")
    whole = {(d.doc_id, i.item_id) for d in real.collect() for i in items.collect() if i.text in d.text}
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(real, items).collect()}
    assert whole <= found


def longest_by_trying(same, least=10, equal=8, percent=70):
    """The length of the longest stretch between two equal words, or filled up to ``least``, by trying all."""
    sums = np.concatenate([[0], np.cumsum(same)])
    for n in range(len(same), least - 1, -1):
        own = sums[n:] - sums[:-n]
        fits = np.flatnonzero((own >= equal) & (100 * own >= percent * n))
        if any(same[x] and same[x + n - 1] for x in fits) or (n == least and len(fits)):
            return n
    return None


def test_overlaps_match_brute_force(spark, real):
    rng = random.Random(11)
    items = {r.item_id: cases.lowered(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()}
    docs = {r.doc_id: cases.lowered(r.text) for r in real.collect()}
    long = [f"q{k}" for k in range(160)]
    items |= {900: long, 901: long, 902: ["tiny"] * 9}
    bad = list(long)
    bad[60:85] = [f"other{k}" for k in range(25)]  # more words in a row than any mask spans
    docs |= {10**6: ["x"] * 30 + bad + ["y"] * 30, 10**6 + 1: long[:9] + ["z"] + long[10:14], 10**6 + 2: [w for k, w in enumerate(long) if rng.random() < 0.9]}
    expected = {}
    for d, a in docs.items():
        for i, b in items.items():
            at = collections.defaultdict(list)
            for k, w in enumerate(b):
                at[w].append(k)
            diagonals = collections.Counter(k - j for j, w in enumerate(a) for k in at.get(w, ()))
            for shift, n in diagonals.items():
                if n >= 8:
                    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
                    best = longest_by_trying(np.array([a[j] == b[j + shift] for j in range(lo, hi)]))
                    if best:
                        expected[d, i] = max(best, expected.get((d, i), 0))
    made = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    found = decontaminate.find_overlaps(made, spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"))
    longest = {(r.doc_id, r.item_id): r.n for r in found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n")).collect()}
    assert longest == expected and longest[10**6, 900] == longest[10**6, 901] == 160
    query = {(r.doc_id, r.item_id): r.n_words for r in decontaminate.op2_decontaminate(spark, D).collect()}
    assert query == {k: n for k, n in expected.items() if k[0] < 10**6 and k[1] < 900}


def test_overlaps_bear_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (None, ""), (2, "one two"), (None, "null id with a few words in it"), (3, "v5 " * 30)], "item_id long, text string")
    found = decontaminate.find_overlaps(odd, items, least=5, equal=5).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(None, None)}
    empty = items.limit(0)
    assert decontaminate.find_overlaps(none, items).count() == decontaminate.find_overlaps(odd, empty).count() == 0


# ── 3: Jaccard join ───────────────────────────────────────────────


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, width, percent):
    rng = random.Random(width)
    base, rows = cases.prose(rng, 220, 5000).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
        rows.append((3 * i + 7, " ".join(w[: rng.choice([220, 215, 190, 30, 12, 6, 3])])))
    rows += [(5000, None), (5001, ""), (5002, " "), (5003, "one two"), (5004, "ONE two"), (5005, "one two three")]
    found = sketch_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == cases.jaccard(rows, width, percent)


@pytest.mark.parametrize(("small", "block"), [(0, 16), (0, 512), (10**6, 512)])
def test_both_ways_through_buckets_find_the_same(spark, monkeypatch, small, block):
    monkeypatch.setattr(sketch_join, "SMALL", small)
    monkeypatch.setattr(sketch_join, "BLOCK", block)
    rng = random.Random(8)
    rows = []
    for g in range(6):
        base = cases.prose(rng, 60, 4000).split()
        for i in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(40, 60)] = f"z{rng.randrange(9999)}"
            rows.append((1000 * g + i, " ".join(w[: rng.choice([60, 58, 50])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch_join.jaccard_components(df).collect()}
    assert found == cases.jaccard(rows, 4, 85)


def test_components_on_documents(real):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch_join.jaccard_components(real).collect()}
    assert found == cases.jaccard([(r.doc_id, r.text) for r in real.collect()], 4, 85)


def test_components_bear_odd_rows(odd, none):
    rows = sketch_join.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r.component_id for r in rows if r.doc_id in (4, 5)) == [4, 4, 4]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert sketch_join.jaccard_components(none).count() == 0


def test_part_keys_of_linked_sets_meet():
    rng = np.random.default_rng(2)
    bands = sketch_join.Bands(85)
    for n in (7, 8, 20, 40, 147, 500, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            drop, put = int(rng.integers(0, 15 * len(a) // 100 + 1)), int(rng.integers(0, 8 * len(a) // 100 + 1))
            b = np.union1d(a[drop:], rng.integers(0, 2**63, put, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            both = len(np.intersect1d(a, b))
            if both < max(len(a), len(b)) and 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(np.intersect1d(sketch_join.part_keys(a, bands), sketch_join.part_keys(b, bands))) >= sketch_join.SHARED


def test_graph_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: top(k) for k in parent}


def test_word_hashes():
    texts = ["a b  a", "", None, "ÀB c\tàb", " x " * 5, "A\nB\x0cC", "w" * 2_000_000 + " end", "q " * 700_000]
    hashes, counts = WordHasher().words(texts)
    plain = [w for t in texts for w in cases.lowered(t)]
    assert counts.tolist() == [len(cases.words(t)) for t in texts] and len(hashes) == len(plain)
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(plain, hashes.tolist(), strict=True)) and len(set(of.values())) == len(of)


# ── 4: pseudonyms ─────────────────────────────────────────────────


def luhn(s):
    d = [int(x) for x in s if x.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_feistel_is_a_permutation(spark):
    pair = pseudonyms.feistel(F.col("id") / 13, F.col("id") % 13, (F.lit(7), F.lit(13)), "k", "t")
    rows = spark.range(91).select(pair.alias("p")).collect()
    assert sorted((r.p.l, r.p.r) for r in rows) == [(a, b) for a in range(7) for b in range(13)]
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert digits.select(pseudonyms.permuted_digits(F.col("d"), "k", "t").alias("p")).distinct().count() == 1000
    days = spark.range(0, pseudonyms.CYCLE[0] * pseudonyms.CYCLE[1], 97).select(F.date_format(F.expr("date_add(date'1800-01-01', cast(id AS int))"), "yyyy-MM-dd").alias("d"))
    assert days.select(pseudonyms._date(F.col("d"), "k").alias("p")).distinct().count() == days.count()


def test_pseudonyms_keep_formats_and_links(spark):
    card, bad = "4111 1111 1111 1111", "4111111111111112"
    texts = [f"pay {card}, or 4111-1111-1111-1111; not {bad}", "from 97.51.17.173. not 999.1.1.1 nor 1.2.3.4.5", "on 2024-02-29 and 31.12.1999, never 2023-02-29", "to und.34@mail7.example.com or +1 (017) 555-7713", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "ssn 123-45-6789, not 000-12-3456"]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "key").collect()}
    assert all(rows[i].text == rows[i + 6].text for i in range(6))
    finds = rows[0].finds
    assert [f.kind for f in finds] == ["card", "card"] and bad in rows[0].text
    assert all(luhn(f.pseudonym) and f.pseudonym != f.value for f in finds)
    assert finds[0].pseudonym.replace(" ", "") == finds[1].pseudonym.replace("-", "")
    assert [f.kind for f in rows[1].finds] == ["address"] and "999.1.1.1 nor 1.2.3.4.5" in rows[1].text
    assert [f.kind for f in rows[2].finds] == ["date", "date"] and "never 2023-02-29" in rows[2].text
    assert [f.kind for f in rows[3].finds] == ["email", "phone"] and "@mail7.example.com" in rows[3].text and "+1 (" in rows[3].text
    assert [f.kind for f in rows[4].finds] == ["secret"] and [f.kind for f in rows[5].finds] == ["social"]
    for k, r in rows.items():
        again = (texts * 2)[k]
        for f in r.finds:
            again = again.replace(f.value, f.pseudonym, 1)
        assert again == r.text
    other = pseudonyms.pseudonymise(df, "another key").where("doc_id = 0").first()
    assert other.text != rows[0].text


def test_pseudonyms_bear_odd_rows(odd, none):
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(odd, "key").collect()}
    before = {r.doc_id: r for r in odd.collect()}
    assert all(rows[k].text == before[k].text for k in before if k != 8) and rows[1].text is None
    assert [f.kind for f in rows[8].finds] == ["card"]
    assert pseudonyms.pseudonymise(none, "key").count() == 0
    plan = pseudonyms.pseudonymise(odd, "key")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pseudonyms_of_cards_beside_numbers_and_of_texts_without_digits(spark):
    card, amex, secret = "4111 1111 1111 1111", "3782 822463 10005", "deadbeef" * 4
    runs = [f"{card} 12/27", f"{card} 123", f"12 {card}", f"27 {card} 123 5500-0000-0000-0004 99", f"{amex} 1234", f"{card} {amex}", "7 4111111111111111 09 30", f"{card} 2024-01-05", f"{card} 123-45-6789", f"{card} 10.1.2.3", f"{card} 12ann@example.com"]
    texts = ["paid with " + r + " today" for r in runs] + ["write to ann.lee@example.com", "write to ann.lee@example.com 2 times", f"key {secret}", f"key {secret} 2"]
    rows = [r for r in pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    kinds = [[f.kind for f in r.finds] for r in rows]
    assert kinds == [["card"]] * 3 + [["card"] * 2, ["card"], ["card"] * 2, ["card"], ["card", "date"], ["card", "social"], ["card", "address"], ["card", "email"]] + [["email"]] * 2 + [["secret"]] * 2
    assert len({f.pseudonym.replace("-", " ") for r in rows for f in r.finds if f.value == card}) == 1
    for r, t in zip(rows, texts, strict=True):
        assert all(f.value not in r.text for f in r.finds)
        for f in r.finds:
            t = t.replace(f.value, f.pseudonym, 1)
        assert t == r.text
    assert rows[11].finds[0].pseudonym == rows[12].finds[0].pseudonym and rows[13].finds[0].pseudonym == rows[14].finds[0].pseudonym


def test_pseudonyms_match_a_plain_version(spark, real):
    hard = ["call +49 30 1234567 or +49301234567, +1 555 123 4567 4111 1111 1111 1111", "on 1/2/2020, 5/25/2020, 25.12.1999, 31/02/2020, 2020-05-25, 12.1.1799", "899-99-9999 666-01-0001 001-01-0001", "+44 20 7946 0958 2024-01-05", "1 2 3 4111111111111111 5 6 7 8 9 10 11 12 13 14", "+1 555 123 4567 2020 2021 2022", "(017) 555-7713 +1 (017) 555-7713", "DEADBEEF" * 4 + " é@x.de a@b.c", "", None]
    docs = real.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(hard, 10**6)), "doc_id long, text string"))
    spark.conf.set(pseudonyms.KEY_SETTING, "a key")
    found = pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark)).collect()
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        text, finds = plain_pseudonyms.replaced(before[r.doc_id] or "", "a key")
        assert (r.text or "", [tuple(f) for f in r.finds]) == (text, finds), r.doc_id
    query = {r.doc_id: r for r in pseudonyms.op4_pseudonyms(spark, D).collect()}
    for r in found:
        if r.doc_id in query:
            kinds = collections.Counter(f.kind for f in r.finds)
            q = query[r.doc_id]
            assert (q.text, q.n_dates, q.n_hidden, q.n_finds) == (r.text, kinds["date"], kinds["email"] + kinds["secret"], len(r.finds))


def test_pseudonyms_stay_valid_and_linked(spark):
    social = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws("-", F.lpad((F.col("id") % 665 + 1).cast("string"), 3, "0"), F.lpad((F.col("id") % 99 + 1).cast("string"), 2, "0"), F.lpad((F.col("id") * 3 + 1).cast("string"), 4, "0")).alias("text"))
    once = pseudonyms.pseudonymise(social, "key")
    assert once.select("text").distinct().count() == 3000
    assert pseudonyms.pseudonymise(once.select("doc_id", "text"), "key").where("size(finds) = 1").count() == 3000
    phones = ["+49 30 1234567", "+49301234567", "+49 (30) 123-4567", "+1 (017) 555-7713", "(017) 555-7713"]
    dates = ["5/25/2020", "25/5/2020", "2020-05-25", "25.05.2020"]
    rows = [r.finds[0].pseudonym for r in pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(phones + dates)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    bare = [plain_pseudonyms.digits_of(x) for x in rows]
    assert bare[0] == bare[1] == bare[2] and bare[0].startswith("49") and bare[3] == "1" + bare[4]
    days = [plain_pseudonyms.read_date(x) for x in rows[6:]]
    assert days[0] == days[1] and rows[5].split("/") == [str(days[0].month), str(days[0].day), str(days[0].year)]
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(social, "")


def test_pseudonyms_of_timestamps_and_short_names(spark):
    letters = [chr(97 + k) for k in range(26)]
    texts = ["at 2024-03-05T12:00:00Z, 2024-03-05 12:00 and on 2024-03-05.", "2024-03-05Tx 2024-13-05T1 x2024-03-05T1", " ".join(f"{x}@a.org" for x in letters)]
    rows = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()
    assert [f.kind for f in rows[0].finds] == ["date"] * 3 and len({f.pseudonym for f in rows[0].finds}) == 1
    assert rows[0].text == texts[0].replace("2024-03-05", rows[0].finds[0].pseudonym) != texts[0]
    assert not rows[1].finds and rows[1].text == texts[1]
    assert len({f.pseudonym for f in rows[2].finds}) == 26
    names = [f"{x}{y}" for x in letters for y in letters] + ["ann.lee", "Ann.Lee", "a.nnlee", "..x..", "0123456789abcdef", "0123456789abcdefg", "ünal", "u" * 65, "_+-%", "Z9" * 8]
    found = pseudonyms.pseudonymise(spark.createDataFrame([(f"{x}@b.org",) for x in names], "text string"), "key").collect()
    new = [f.finds[0].pseudonym.split("@")[0] for f in found]
    assert new == [plain_pseudonyms.email_name(x, "key") for x in names] and len(set(new)) == len(names)


def test_no_plan_holds_the_key(spark, real):
    secret = "0123-a-key-that-no-plan-may-hold"
    found = pseudonyms.pseudonymise(real, secret)
    found.count()
    assert secret not in found._jdf.queryExecution().toString()
    clash = pseudonyms.pseudonymise(real.selectExpr("text", "1 AS key_", "2 AS KEY__"), secret)
    assert clash.columns == ["text", "key_", "KEY__", "finds"] and clash.where("key_ = 1 AND KEY__ = 2").count() == real.count()


def test_pseudonyms_of_very_long_texts(spark):
    texts = ["1 a@b" + ".c" * 100_000, "mail a@b" + ".com" * 100_000, "9" * 300_000, "1-" * 100_000, "a@" * 50_000, "+12 " * 50_000, "7 " * 20_000]
    rows = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()
    assert [len(r.text) for r in rows] == [len(t) for t in texts] and [f.kind for f in rows[1].finds] == ["email"]


# ── 5: chats ──────────────────────────────────────────────────────


def test_chats_round_trip(spark):
    nasty = ["", "<|", "<|turn|>", "\\", "\\s", "\\b<|\\", "<|text|><|end|>", "é😀", "a<", "|>", "\\<|end|>"]
    rows = [(c, t, r, nasty[(c + 3 * t) % len(nasty)]) for c in range(30) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][c % 2 :])]
    rows += [(100, None, None, None), (100, 0, "us<|er\\", "x"), (100, 0, "us<|er\\", "x"), (None, 0, "user", "lost"), (101, 0, "assistant", "early")]
    turns = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    chats = chat_format.format_chats(turns)
    found = chats.select("*", chat_format.read_back(F.col("formatted")).alias("read"), chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((-1 if t is None else t, r or "", x or ""))
    assert len(found) == len(own)
    for f in found:
        expected = [(r, x) for _, r, x in sorted(own[f.conv_id])]
        assert [(x.role, x.text) for x in f.read] == expected and f.n_turns == len(expected)
        assert f.loss == [x for r, x in expected if r == "assistant" and x]
        assert "".join(s.text for s in f.segments) == f.formatted
        assert f.valid == (f.conv_id is not None and f.conv_id < 30)
    assert chat_format.format_chats(turns.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_format.Template(close="end")


# ── 6: co-training ────────────────────────────────────────────────


def test_co_training_learns_from_both_views():
    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.5).astype(float)
    text, meta = y[:, None] * 1.2 + rng.normal(size=(3000, 2)), y[:, None] * 1.2 + rng.normal(size=(3000, 2))
    gathered = lambda senders, now, sure: co_training.pushes(text[60:2000], meta[60:2000], senders, now, sure)
    views = co_training.co_train(text[:60], meta[:60], y[:60], gathered)
    a, b, both = (((s > 0.5) == y)[2000:].mean() for s in views(text, meta))
    assert both > max(a, b) - 0.01 and both > 0.82


def test_pushes_are_gradients():
    rng = np.random.default_rng(5)
    text, meta = rng.normal(size=(80, 3)), rng.normal(size=(80, 2))
    model = lambda n: co_training.Linear(rng.normal(size=n), np.full(n, 1.5), rng.normal(size=n + 1))
    senders, now = [model(3), model(2)], [model(3), model(2)]
    expected = []
    for k, own, other in ((0, text, meta), (1, meta, text)):
        for label in (0, 1):
            n, slope = 0, np.zeros(own.shape[1] + 1)
            for x, z in zip(own, other, strict=True):
                s = senders[1 - k]
                told = 1 / (1 + np.exp(-(((z - s.mean) / s.scale) @ s.weights[:-1] + s.weights[-1])))
                if (told >= 0.8) if label else (told <= 0.2):
                    u = np.append((x - now[k].mean) / now[k].scale, 1)
                    n, slope = n + 1, slope + (label - 1 / (1 + np.exp(-u @ now[k].weights))) * u
            expected += [n, *slope]
    assert np.allclose(co_training.pushes(text, meta, senders, now, 0.8), expected)


def test_co_training_matches_a_plain_version(spark, real):
    labels = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows = real.select("*", F.xxhash64("doc_id", "text").alias("row_"), *co_training.meta_places()).orderBy("row_").collect()
    views = [co_training.text_view([r.text for r in rows], WordHasher()), co_training.meta_view(np.array([r.s_ for r in rows]), np.array([r.l_ for r in rows]))]
    own = np.array([k for k, r in enumerate(rows) if r.doc_id in labels])
    pool = np.array([k for k, r in enumerate(rows) if r.doc_id not in labels])
    small = views[0].astype(np.float16).astype(float)

    def one_by_one(senders, now, sure):
        return sum(co_training.pushes(small[k : k + 1], views[1][k : k + 1], senders, now, sure) for k in pool)

    model = co_training.co_train(views[0][own], views[1][own], np.array([labels[rows[k].doc_id] for k in own]), one_by_one)
    plain = {r.doc_id: x for r, x in zip(rows, zip(*model(*views), strict=True), strict=True)}
    found = {r.doc_id: r for r in co_training.op6_co_training(spark, D).collect()}
    assert found.keys() == plain.keys()
    for k, r in found.items():
        assert np.allclose((r.p_text, r.p_meta, r.score), plain[k], atol=1e-4) and r.kept == (plain[k][2] >= 0.5)


def test_co_training_on_documents(spark, real):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    rows = co_training.classify(real, co_training.train(real, labels)).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.9


def test_co_training_bears_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else "bad " * 9, "en", "s", 10) for i in range(60)], cases.SCHEMA)
    views = co_training.train(docs, labels)
    rows = co_training.classify(odd, views).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert co_training.train(none, labels) is None and co_training.classify(none, views).count() == 0
    assert {r.kept for r in co_training.classify(odd, None).collect()} == {True}


# ── 7: pieces ─────────────────────────────────────────────────────


def test_pieces_as_the_library(spark, real, odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd_texts = [None, "", " ", "  ", "a ", "a  ", " a", "▁", "▁▁a ▁", "\n", "a\n\nb  c\t", "\x00a", "<s>x</s>", "é😀 ﬁ Ａ ２", " " * 70 + "b" + " " * 40, "ｶﾞ ㍿"]
    docs = real.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd_texts, 10**6)), "doc_id long, text string"))
    for r in piece_codec.encode_decode(docs, MODEL).collect():
        ids = sp.encode(r.text or "")
        assert (r.ids, r.decoded) == (ids, sp.decode(ids)), r.doc_id
    assert piece_codec.encode_decode(odd, MODEL).count() == odd.count()
    assert piece_codec.encode_decode(none, MODEL).count() == 0


def test_word_table_forgets(spark):
    with open(MODEL, "rb") as f:
        table = piece_codec.WordTable(f.read(), most=3)
    for _ in range(3):
        ids, sizes = table.ids_of([" a", " b", " c", " d", " a"])
        assert ids.tolist()[0] == ids.tolist()[-1] and len(sizes) == 5


# ── 8: languages ──────────────────────────────────────────────────


def test_language_on_held_out_documents(real):
    docs = real.withColumn("out", language_id.held_out(F.col("doc_id")))
    rows = language_id.identify(docs, language_id.train(docs.where("NOT out"))).where("out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_bears_odd_rows(odd, none):
    model = language_id.train(odd)
    rows = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[5].lang_pred == "de"
    assert language_id.train(none) is None and language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_unseen_words_back_off(spark):
    docs = spark.createDataFrame([(0, "the thing", "en"), (1, "der ding", "de")] * 5, "doc_id long, text string, lang string")
    rows = language_id.identify(spark.createDataFrame([("xthx",), ("xderx",)], "text string"), language_id.train(docs)).collect()
    assert [r.lang_pred for r in rows] == ["en", "de"]


def test_languages_match_a_plain_version(spark, real):
    import regex

    words = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    out = {r.doc_id for r in real.where(language_id.held_out(F.col("doc_id"))).collect()}
    rows = [r for r in real.collect() if r.doc_id not in out and r.lang is not None and r.text is not None]
    languages = sorted({r.lang for r in rows})
    counts = [collections.defaultdict(collections.Counter) for _ in range(5)]  # by size, words first
    for r in rows:
        for w in words(r.text):
            counts[0][w][r.lang] += 1
            for n in range(1, 5):
                for i in range(len(w) + 3 - n):
                    counts[n][f"^{w}$"[i : i + n]][r.lang] += 1
    totals = [{x: sum(c[x] + 0.5 for c in own.values()) for x in languages} for own in counts]

    def says(n, gram):
        logs = np.array([np.log((counts[n][gram][x] + 0.5) / totals[n][x]) for x in languages])
        return logs - logs.mean()

    def word(w):
        if w in counts[0]:
            return says(0, w)
        for n in range(min(4, len(w) + 2), 0, -1):
            own = [says(n, g) for i in range(len(w) + 3 - n) if (g := f"^{w}$"[i : i + n]) in counts[n]]
            if own:
                return np.mean(own, 0)
        return np.zeros(len(languages))

    for r in language_id.op8_language_id(spark, D).collect():
        text = next(x.text for x in real.where(F.col("doc_id") == r.doc_id).collect()) if r.doc_id % 7 == 0 else None
        if text is not None and words(text):
            total = sum(map(word, words(text)))
            odds = np.exp(total - total.max())
            assert r.held_out == (r.doc_id in out) and r.lang_pred == languages[int(total.argmax())] and abs(r.score - odds.max() / odds.sum()) < 1e-5


def test_letters_are_those_of_unicode(spark):
    docs = spark.createDataFrame([(0, "नमस्ते दुनिया", "hi"), (1, "hello world", "en")] * 3, "doc_id long, text string, lang string")
    rows = language_id.identify(spark.createDataFrame([("½",), ("² ① 12",), ("दुनिया",), ("1hello2",)], "text string"), language_id.train(docs)).collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "hi", "en"] and rows[0].score == 0


def test_rare_languages_are_learned(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "einzig artig").otherwise(F.concat(F.lit("common w"), F.col("id"))).alias("text"), F.when(F.col("id") == 7, "de").otherwise("en").alias("lang"))
    model = language_id.train(docs, max_rows=50)
    assert model.languages == ["de", "en"] and set(model.grams[0]) == {"common", "w", "einzig", "artig"}


# ── 9: suffixes ───────────────────────────────────────────────────


def test_deep_shallow_sorts():
    rng = random.Random(3)
    for trial in range(120):
        n, length = rng.randrange(40, 400), rng.choice([33, 40, 100])
        data = bytes(rng.choice(b"ab" if trial % 2 else b"\x00\xff\x80ab") for _ in range(n + length))
        data = (data[:30] * 40)[: n + length] if trial % 3 == 0 else bytes([255]) * (n + length) if trial % 5 == 0 else data
        starts = np.array(rng.sample(range(n), rng.randrange(1, n)))
        order, same = suffix_dedup.deep_shallow(np.frombuffer(data, np.uint8), starts, length)
        own = [data[starts[i] : starts[i] + length] for i in order]
        assert sorted(order) == list(range(len(starts))) and own == sorted(own)
        assert same.tolist() == [False] + [own[i] == own[i - 1] for i in range(1, len(own))]


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - length + 1):
            if data[j : j + length] in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(data[j : j + length])
        out[key] = (sum(gone), hashlib.sha256(bytes(x for x, y in zip(data, gone, strict=True) if not y)).hexdigest())
    return out


def test_repeats_match_brute_force(spark, real):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(30)]
    shared = [" ".join(rng.choice(pool) for _ in range(60)) for _ in range(5)]
    piece = lambda: rng.choice([rng.choice(pool), rng.choice(shared)[: rng.randrange(10, 250)], "x" * rng.randrange(300)])
    rows = [(i, " ".join(piece() for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(500, "ab" * 400), (501, "q" * 99), (502, "q" * 100), (503, None), (504, ""), (505, "ab" * 200), (506, rows[3][1]), (507, "zq" * 300_000 + shared[0])]
    rows += [(10_000 + r.doc_id, r.text) for r in real.collect()]
    df = spark.createDataFrame([*rows, rows[0], rows[-1]], "doc_id long, text string")
    found = {r.doc_id: (r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()}
    assert found == brute_repeats(rows)


@pytest.mark.parametrize("hot", [0, 2])
def test_repeats_around_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(6)
    line = "This line stands in every text of this corpus, word by word, and it is long enough to hold a whole window by itself."
    tail = lambda: " ".join(rng.choice("abc") * 3 for _ in range(12))
    rows = [(i, f"{tail()} {line} {tail()}" if i % 3 else f"{line[:40]}{tail()}{line[20:]}") for i in range(90)]
    rows += [(None, "no id " * 40), (None, "other " * 40), (7, line * 3)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    numbered = [(k if k is not None else 1 << 62, t) for k, t in rows]
    names = {(k if k is not None else 1 << 62, t): h for k, t, h in [(r.doc_id, r.text, r.h) for r in spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 7)).collect()]}
    order = sorted(numbered, key=lambda r: (r[0], names[r]))
    expected = brute_repeats([(k, t) for k, (_, t) in enumerate(order)])
    place = {r: k for k, r in enumerate(order)}
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) == expected[place[r.doc_id if r.doc_id is not None else 1 << 62, r.text]]


def test_stretches_of_hot_anchors_are_dealt_in_few_parts():
    rng = random.Random(7)
    line = "This line stands in every text of this corpus, word by word."
    texts = [f"{''.join(rng.choice('ab') for _ in range(90))}{line * rng.randrange(1, 3)}{''.join(rng.choice('ab') for _ in range(90))}".encode() for _ in range(40)]
    texts += [b"q" * 300, line.encode() * 6, texts[0]]
    finder, rows = suffix_dedup.Stretches(100), []
    for d, text in enumerate(texts):
        key, _, start, count = finder.of(np.frombuffer(text, np.uint8), np.arange(len(text) - 99))
        rows += [(k, d, 0, int(s) << 7 | int(n) - 1, text[s : s + n + 99]) for k, s, n in zip(key.view(np.int64).tolist(), start, count, strict=True)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "d", "th", "place", "stretch"), r, strict=True)) for r in rows])
    parts = [r for b in suffix_dedup._dealt(iter([batch]), 100) for r in b.to_pylist()]
    assert len(parts) <= 9 * len(rows) and len(parts) < sum((r[3] & 127) + 1 for r in rows) / 4
    found, cells = [], collections.defaultdict(set)
    for r in parts:
        start, n = r["place"] >> 7, (r["place"] & 127) + 1
        assert n <= suffix_dedup.PART and r["stretch"] == texts[r["d"]][start : start + n + 99] and len(r["told"]) >= 92
        for k in range(n):
            assert r["told"] in r["stretch"][k : k + 100]
            cells[r["stretch"][k : k + 100]].add((r["key"], r["told"]))
        found += [(r["d"], start + k) for k in range(n)]
    assert sorted(found) == [(d, j) for d, text in enumerate(texts) for j in range(len(text) - 99)]
    assert max(map(len, cells.values())) == 1


def test_repeats_bear_odd_rows(odd, none):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and {r.key for r in rows} == {"own key"}
    assert suffix_dedup.remove_repeats(none).count() == 0


# ── 10: pseudo-likelihood ─────────────────────────────────────────


def test_network_is_a_distribution_and_learns(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"{a} {a}b {a}c" for a in rng.choices("pqrst", k=80))) for i in range(80)], "doc_id long, text string")
    model = pseudo_likelihood.train(docs, side=5, turns=3, rate=0.3)
    context = np.array([[3], [25], [1], [2]]).repeat(25, 1)
    assert abs(np.exp(model.network.log_probability(context, np.arange(25))).sum() - 1) < 1e-4
    new = spark.createDataFrame([(0, "p pb pc q qb qc " * 20), (1, "p qb rc pb sc tb " * 20), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pseudo_likelihood.score(new, model).collect()}
    assert rows[0].mean_log > rows[1].mean_log + 0.5
    assert rows[2].n_words == 0 and rows[2].log_likelihood == 0 and rows[3].mean_log is None


def test_network_follows_its_gradient():
    rng = np.random.default_rng(1)
    net = pseudo_likelihood.Network.new(rng.random(9) * 100, 3, 4)
    net = net.like(net.flat() + rng.normal(0, 0.2, len(net.flat())))
    context, target = rng.integers(0, 10, (4, 1)), np.array([5])
    start = net.flat().astype(np.float64)
    after = net.like(start)
    after.learn(context, target, 1e-3)
    moved = (after.flat() - start) / 1e-3
    for k in rng.choice(np.flatnonzero(moved), 40):
        step = np.zeros(len(start))
        step[k] = 1e-2
        slope = (net.like(start + step).log_probability(context, target)[0] - net.like(start - step).log_probability(context, target)[0]) / 2e-2
        assert abs(slope - moved[k]) < 2e-2


@pytest.mark.parametrize("size", [0.1, 60.0])
def test_scores_within_and_beyond_what_is_safe_match_plain_sums(size):
    rng = np.random.default_rng(5)
    net = pseudo_likelihood.Network.new(rng.random(36) * 100, 6, 4)
    net = net.like(net.flat() + rng.normal(0, size, len(net.flat())))
    assert (max(net._bounds()) < pseudo_likelihood.SAFE) == (size == 0.1)
    context, target = rng.integers(0, 37, (4, 500)), rng.integers(0, 36, 500)
    plain = []
    for around, own in zip(context.T, target, strict=True):
        h = np.append(np.tanh(sum(net.vectors[p][c].astype(float) for p, c in enumerate(around))), 1)
        a, b = divmod(own, 6)
        plain.append(sum(x[k] - x.max() - np.log(np.exp(x - x.max()).sum()) for x, k in ((h @ net.groups, a), (h @ net.classes[a], b))))
    assert np.allclose(net.log_probability(context, target), plain, rtol=1e-3, atol=1e-4)
    net.learn(context, target, 0.01)
    assert np.isfinite(net.flat()).all() and not len(net.log_probability(context[:, :0], target[:0]))


def test_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(8)
    crowd = np.arange(50, dtype=np.uint64) + np.uint64(7 << 40)  # all with the same first bits
    often = rng.permutation(np.unique(np.concatenate([rng.integers(0, 2**64, 500, np.uint64), crowd, np.array([0, 2**64 - 1], np.uint64)])))
    reader = pseudo_likelihood.Reader(often, 64)
    asked = np.concatenate([often, crowd + np.uint64(1000), rng.integers(0, 2**64, 300, np.uint64), np.array([1, 2**64 - 2], np.uint64)])
    place = {int(w): k for k, w in enumerate(often)}
    classes, places = reader.classes_of(asked)
    assert places.tolist() == [place.get(int(w), -1) for w in asked]
    assert all(c == p if 0 <= p < 56 else 56 <= c < 64 for c, p in zip(classes, places, strict=True))
    around = reader.contexts(np.arange(6), np.array([0, 4, 0, 1, 1]))
    assert around.T.tolist() == [[64, 64, 1, 2], [64, 0, 2, 3], [0, 1, 3, 64], [1, 2, 64, 64], [64] * 4, [64] * 4]
    assert pseudo_likelihood.Reader(often[:0], 16).classes_of(asked)[1].max() == -1


@pytest.mark.parametrize("sent", [1 << 17, 300])
def test_scores_match_a_plain_version(spark, monkeypatch, real, sent):
    monkeypatch.setattr(pseudo_likelihood, "SENT", sent)
    docs = real.select("doc_id", "text")
    model = pseudo_likelihood.train(docs)
    n, texts = collections.Counter(), {r.doc_id: cases.lowered(r.text) for r in docs.collect()}
    for w in texts.values():
        n.update(w)
    hashes = dict(zip(n, WordHasher().words(list(n))[0], strict=True)) if n else {}
    assert {r.word: r.n for r in model.counts.collect()} == {int(h.view(np.int64)): n[w] for w, h in hashes.items()}
    assert model.network.side == pseudo_likelihood.side_of(sum(n.values())) and abs(np.exp(model.totals).sum() / sum(n.values()) - 1) < 1e-6
    size = model.network.side**2
    own = model.often[: pseudo_likelihood.known_of(size)]
    place = {h: k for k, h in enumerate(own.tolist())}
    known = sorted((n[w] for w, h in hashes.items() if int(h) in place), reverse=True)
    assert len(known) == size - size // 8 and known[-1] >= max(n[w] for w, h in hashes.items() if int(h) not in place)
    reader = pseudo_likelihood.Reader(own, size)
    of = {w: int(reader.classes_of(np.array([h]))[0][0]) for w, h in hashes.items()}
    net = model.network
    for r in pseudo_likelihood.op10_pseudo_likelihood(spark, D).collect()[:25]:
        w, total = texts[r.doc_id], 0.0
        assert r.n_words == len(w)
        for i, word in enumerate(w):
            around = [of[w[i + k]] if 0 <= i + k < len(w) else size for k in (-2, -1, 1, 2)]
            h = np.append(np.tanh(sum(net.vectors[p][c].astype(float) for p, c in enumerate(around))), 1)
            a, b = divmod(of[word], net.side)
            for x, k in ((h @ net.groups, a), (h @ net.classes[a], b)):
                total += x[k] - np.log(np.exp(x - x.max()).sum()) - x.max()
            if int(hashes[word]) not in place:
                total += np.log(n[word]) - model.totals[of[word]]
        assert abs(r.log_likelihood - total) < 0.02 + 1e-5 * abs(total), r.doc_id


def test_frequent_words_are_cut_by_count(spark):
    counts = spark.range(5000).select(F.col("id").alias("word"), F.when(F.col("id") < 20, 100 - F.col("id")).otherwise(1).alias("n"))
    rows = pseudo_likelihood._frequent(counts, 10).collect()
    assert [r.word for r in rows] == list(range(10))
    rows = pseudo_likelihood._frequent(counts, 70).collect()
    assert len(rows) == 70 and [r.word for r in rows[:20]] == list(range(20))
    assert pseudo_likelihood._frequent(counts, 9000).count() == 5000


def test_pseudo_likelihood_bears_odd_rows(odd, none):
    model = pseudo_likelihood.train(odd)
    rows = pseudo_likelihood.score(odd, model).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r.log_likelihood) for r in rows)
    untrained = pseudo_likelihood.train(none)
    assert pseudo_likelihood.score(none, model).count() == 0
    assert pseudo_likelihood.score(odd, untrained).count() == odd.count()
