"""Filter audit, periodic runs and toxicity against brute-force versions, and on the cases that every operator has to bear."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from ravelin.llm import filter_audit, periodic_runs, toxicity
from tests.llm import cases

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return cases.crowded(spark.createDataFrame(cases.odd_rows(), cases.SCHEMA)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.crowded(spark.createDataFrame([], cases.SCHEMA))


# ── 11: filter interaction audit ──────────────────────────────────


def brute_fails(rows):
    """For each row the letters of the filters that it fails."""
    first = {}
    for key, text, *_ in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    out = []
    for key, text, *_ in rows:
        text = text or ""
        w = cases.words(text)
        fails = ["A"] * (len(w) < 200) + ["B"] * (100 * len(set(w)) < 50 * len(w)) + ["C"] * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        out.append({*fails, *(["D"] * any(c in "#$%&*|" for c in text)), *(["E"] * (key is not None and first[text] < key))})
    return out


def brute_audit(rows, labels, filters="ABCDE"):
    """One row of ``rows`` (doc_id, text, lang, source, ..) after the other through each order of the filters."""
    parts, out = {r[3] or "" for r in rows}, {}
    good, toxic = ({k for k, q, t in labels if k is not None and (q, t)[i] == 1} for i in (0, 1))
    orders = ["".join(o) for o in itertools.permutations(filters)]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for part, order, step in itertools.product(parts, orders, range(1, len(filters) + 1)):
        out[part, order, step] = dict.fromkeys(names, 0)
    for r, fails in zip(rows, brute_fails(rows), strict=True):
        for order in orders:
            gone = False
            for step, f in enumerate(order, 1):
                o = out[r[3] or "", order, step]
                o["unique_fails"] += fails == {f}
                o["redundant"] += gone and f in fails
                now = not gone and f in fails
                o["removed"] += now
                o["good_lost"] += now and r[0] in good
                o["toxic_lost"] += now and r[0] in toxic
                gone |= now
                o["kept"] += not gone
    for (part, order, step), o in out.items():
        f = order[step - 1]
        o["shapley"] = sum(x["removed"] for (p, q, s), x in out.items() if p == part and q[s - 1] == f)
    return out


def audited(frame, labels):
    return {(r.part, r.filter_order, r.step): {k: r[k] for k in r.asDict() if k not in ("part", "filter_order", "step")} for r in filter_audit.audit(filter_audit.text_counts(frame, labels), "ABCDE").collect()}


def audit_rows():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "Cd", "e#", "word", "x", "é", "Ü"]) + (str(rng.randrange(500)) if k % 3 else "") for _ in range(rng.choice([3, 199, 200, 260]))) for k in range(60)]
    rows = [(k, rng.choice(texts) if k % 4 else texts[0], "en", rng.choice(["a", "b", None, "one of few"]), None) for k in range(160)]
    return rows + [(7, rows[7][1], "en", "a", None), (None, rows[4][1], "en", "a", None), (3, rows[4][1], None, "b", 1)]


LABELS = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 160, 3)] + [(None, 1, 1), (6, 1, 0), (9, None, None)]


def test_audit_matches_brute_force(spark):
    rows = audit_rows()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert audited(spark.createDataFrame(rows, cases.SCHEMA), labels) == brute_audit(rows, LABELS)


def test_audit_bears_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert audited(odd, labels) == brute_audit(cases.odd_rows(), LABELS)
    assert audited(odd, labels.limit(0)) == brute_audit(cases.odd_rows(), [])
    assert audited(none, labels) == {}


def test_survivors_of_every_subset():
    counts = np.random.default_rng(0).integers(0, 9, (3, 16))
    z = filter_audit.survivors(counts)
    for s in range(16):
        assert (z[:, s] == sum(counts[:, m] for m in range(16) if not m & s)).all()


def test_audit_of_other_filters(spark):
    rows = [("p", 0, 5, 1, 0), ("p", 1, 2, 0, 1), ("p", 2, 1, 0, 0), ("p", 3, 4, 2, 2), ("p", 3, 1, 0, 0), (None, 1, 1, None, None)]
    found = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, n long, good long, toxic long"), "XY").collect()}
    assert len(found) == 8
    r = found["p", "XY", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == (5, 1, 5, 1, 0, 0, 7)
    r = found["p", "XY", 1]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == (6, 7, 0, 2, 2, 3, 9)
    assert found[None, "YX", 2].removed == 1
    with pytest.raises(ValueError):
        filter_audit.audit(None, "")


# ── 12: periodic runs ─────────────────────────────────────────────


def brute_runs(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_collapsed(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def tailed(key, w):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.randrange(60), rng.choice([1, 2, 3, 5, 30])
            w = [rng.randrange(k) for _ in range(n)]
            a, p = rng.randrange(n + 1), rng.randrange(1, 9)
            texts.append([x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)])
        of, *run = periodic_runs.find_runs(texts)
        assert [[(int(s), int(n), int(p)) for o, s, n, p in zip(of, *run, strict=True) if o == k] for k in range(len(texts))] == [brute_runs(w) for w in texts]


def test_grids_in_blocks():
    sizes = np.array([0, 1, 2, 7, 40, 3])
    whole = [np.concatenate(x) for x in zip(*periodic_runs.grid(sizes), strict=True)]
    assert all((a == np.concatenate(b)).all() for a, b in zip(whole, zip(*periodic_runs.grid(sizes, 10), strict=True), strict=True))
    pairs = [(t, p, j * p) for t, n in enumerate(sizes) for p in range(1, n // 2 + 1) for j in range((n - 1) // p)]
    assert list(zip(*(x.tolist() for x in whole), strict=True)) == pairs


def test_runs_bear_odd_rows(odd, none):
    rows = periodic_runs.periodic_runs(odd).collect()
    assert len(rows) == len(cases.odd_rows())
    for r in rows:
        w = cases.words(r.text)
        runs = brute_runs(w) if len(w) < 1000 else []
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == " ".join(brute_collapsed(w, runs))
        assert r.ids == "own ids"
    assert periodic_runs.periodic_runs(none).collect() == []


def test_runs_of_long_and_repeated_texts(spark):
    words = ["a b " * 30_000, " ".join(f"w{k % 900}" for k in range(20_000)), "x " * 11, "x " * 12, "q " + "x\ty\n" * 6 + "q"]
    found = periodic_runs.periodic_runs(spark.createDataFrame([(k, w) for k, w in enumerate(words * 2)], "doc_id long, text string")).orderBy("doc_id").collect()
    expected = [[(0, 60_000, 2)], [(0, 20_000, 900)], [], [(0, 12, 1)], [(1, 12, 2)]] * 2
    assert [[tuple(x) for x in r.runs] for r in found] == expected
    assert found[4].collapsed == "q x y q"


def test_registered_runs_match_brute_force(spark):
    from ravelin.llm.common import table

    found = {r.doc_id: r for r in periodic_runs.op12_periodic_runs(spark, D).collect()}
    docs = table(spark, D, "documents").collect()
    assert len(found) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        w = tailed(d.doc_id, cases.words(d.text))
        runs, r = brute_runs(w), found[d.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r.collapsed_sha256 == sha(" ".join(brute_collapsed(w, runs)))


def test_tails_of_null_and_empty(spark):
    rows = [(k, t) for k in range(60) for t in (None, "", " \n", "one", "a b c d e f g h i j k l m n o p")] + [(None, "a b c")]
    found = periodic_runs.with_planted_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (key, text), r in zip(rows, found, strict=True):
        assert cases.words(r.text) == (cases.words(text) if key is None else tailed(key, cases.words(text)))


# ── 13: toxicity ──────────────────────────────────────────────────


def plain_negative(texts, weights):
    """``negative`` with one Python number at a time."""
    loss, gradient = 0.0, np.zeros(len(weights))
    for own in texts:
        odds = weights[-1] + sum(weights[k] for k in own)
        loss += np.log1p(np.exp(odds))
        for k in (*own, -1):
            gradient[k] += 1 / (1 + np.exp(-odds))
    return [len(texts), loss, *gradient]


def test_sums_of_texts():
    rng = np.random.default_rng(2)
    texts = [sorted(set(rng.integers(0, 6, rng.integers(0, 5)).tolist())) for _ in range(40)]
    weights = rng.normal(size=7)
    ids, counts = np.array([k for t in texts for k in t], np.int64), np.array([len(t) for t in texts])
    assert np.allclose(toxicity.negative(ids, counts, weights), plain_negative(texts, weights))


def test_reader_knows_words_and_stems():
    known = {f: k for k, f in enumerate(["abc", "abcd", "x$", "ünd$"])}
    reader = toxicity.Reader(known, most=3)
    for _ in range(2):  # the second time after it forgot its words
        ids, counts = reader.read(["Abcde abc1abcx x", None, "", "xx ünd", "abc, abc"])
        assert (ids.tolist(), counts.tolist()) == ([0, 1, 2, 3, 0], [3, 0, 0, 1, 1])


def spoiled(rng, n=600, rate=0.2):
    """Texts of which some hold marked words, and whether they do."""
    toxic = [rng.random() < rate for _ in range(n)]
    return toxic, [cases.prose(rng, 30) + (f" zork{rng.choice('abcdef')} " * rng.randrange(1, 3) + cases.prose(rng, 10) if t else "") for t in toxic]


def test_learns_from_confirmed_and_unlabelled_texts(spark):
    toxic, texts = spoiled(random.Random(3))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(toxic[k])) for k in range(300)], "doc_id long, toxic int")
    model, rows = toxicity.learn(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score_features(rows, model).collect()}
    assert len(found) == len(texts) and all(0 <= s <= 1 for s in found.values())
    assert np.mean([(found[k] >= 0.3) == toxic[k] for k in range(300, 600)]) > 0.97
    assert "zor" in model.known  # endings that no confirmed text has still count
    again = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(abs(found[k] - again[k]) < 1e-5 for k in found)


def test_a_prior_too_high_does_not_run_away():
    rng = random.Random(4)
    toxic, _ = spoiled(rng)
    texts = [[0] if t else [rng.randrange(1, 20)] for t in toxic]
    own = [t for t, x in zip(texts, toxic, strict=True) if x][:50]
    pack = lambda rows: (np.array([k for t in rows for k in t], np.int64), np.array([len(t) for t in rows]))
    usual = np.bincount(pack(texts)[0], minlength=20) / len(texts)
    for prior in (0.2, 0.45):
        w = toxicity.fit(*pack(own), prior, lambda w: toxicity.negative(*pack(texts), w), usual)
        total, mine = toxicity.negative(*pack(texts), w), toxicity.negative(*pack(own), w)
        assert total[1] / total[0] - prior * mine[1] / len(own) > -0.05
        assert w[0] > w[1:-1].max()


def test_toxicity_bears_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 1), (6, 1), (8, 1), (8, 1), (2, 0), (3, None), (None, 1), (7, 0), (7, 1)], "doc_id long, toxic int")
    model, rows = toxicity.learn(odd, labels)
    scored = toxicity.score_features(rows, model).collect()
    assert len(scored) == len(cases.odd_rows()) and all(0 <= r.score <= 1 and r.ids == "own ids" for r in scored)
    assert len({r.score for r in scored if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(none, model).collect() == []
    assert toxicity.learn(odd, labels.limit(0)) == (None, None) == toxicity.learn(odd, labels.where("toxic = 0"))
    assert toxicity.learn(none, labels) == (None, None)
    assert [r.score for r in toxicity.score(odd, None).collect()] == [None] * len(cases.odd_rows())


def test_registered_toxicity(spark):
    rows = toxicity.op13_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len({r.doc_id for r in rows}) == len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([(s >= 0.3) == t for s, t in held]) > 0.9


# ── tests that earlier operators lacked ───────────────────────────


def walked(forest, x):
    """Each tree from its root to a leaf, one node at a time."""
    total = forest.start
    for t in range(len(forest.feature)):
        node = 0
        while forest.left[t, node] != node:
            node = forest.left[t, node] if x[forest.feature[t, node]] <= forest.cut[t, node] else forest.right[t, node]
        total += forest.value[t, node]
    return 1 / (1 + np.exp(-total))


def test_trees_walked_one_node_at_a_time(spark):
    from ravelin.llm import quality_trees

    docs = spark.read.parquet(f"{D}/documents.parquet")
    forest = quality_trees.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    rows = quality_trees.op1_quality_rules(spark, D).collect()
    scores = {r.doc_id: walked(forest, quality_trees.measures(r.text)[1]) for r in docs.collect()}
    assert all(abs(scores[r.doc_id] - r.quality_score) < 1e-6 and r.kept == (not r.base_failed and scores[r.doc_id] >= 0.5) for r in rows)
    assert len(rows) == len(scores) and 0 < sum(r.kept for r in rows) < len(rows)


def test_registered_digests_are_those_of_the_library(spark):
    import public_tokenizers
    import sentencepiece

    from ravelin.llm import piece_codec

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = piece_codec.op7_sentencepiece(spark, D).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_chats_with_long_texts_and_many_turns(spark):
    from pyspark.sql import functions as F

    from ravelin.llm import chat_format

    rows = [(1, 0, "user", "x" * 400_000), (1, 1, "assistant", "<|" * 100_000)] + [(2, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(3000)]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r.conv_id: r for r in chats.select("conv_id", "n_turns", chat_format.read_back(F.col("formatted")).alias("read")).collect()}
    assert (found[1].n_turns, found[2].n_turns) == (2, 3000)
    for key in (1, 2):
        assert [(x.role, x.text) for x in found[key].read] == [(r, t) for c, _, r, t in rows if c == key]
