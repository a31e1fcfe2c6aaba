"""Near dedup, components and decontamination against brute force."""

import json
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from modelward.llm import decontamination, near_dedup
from modelward.llm.components import connected_components


FOLDER = os.environ.get("MODELWARD_TEST_DATA", "/root/testdata/sf0.001")


def least(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(5, i) for i in range(40)] + [(100, 101), (101, 39)], [(7, 7), (3, 2), (2, 3)]])
def test_components(corpus, links):
    got = {r.node: r.component for r in connected_components(corpus.createDataFrame(links, "a long, b long")).collect()}
    real = [p for p in links if p[0] != p[1]]
    assert got == least(real, {n for p in real for n in p})


def near_group(rnd, base, n, most):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, most)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_by_brute_force(corpus, k):
    rnd = random.Random(k)
    word = lambda: "w" + str(rnd.randrange(4000))
    texts = []
    for _ in range(3):  # groups whose copies are partly too far from each other
        texts += near_group(rnd, [word() for _ in range(60)], 90, 9)
    chain = [word() for _ in range(50)]
    for i in range(20):
        chain = [*chain[2:], word(), word()]
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    texts += ["The Same", "the  same", "one", "ONE", "", None, " "]
    rnd.shuffle(texts)
    docs = corpus.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = {i: shingles(t, k) for i, t in enumerate(texts)}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = least(pairs, sets)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, words=k).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    wrong = {i for i in want if got[i].component_id != want[i]}
    assert not wrong and all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_all_rows_of_open_buckets_meet(corpus):
    """Two rows of a family in different components are in one cell, however large the components are."""
    rows = [(f, i, 1 if i < 30 else i) for f in (1, 2) for i in range(40)]
    cells = near_dedup.cells(corpus.createDataFrame(rows, "family long, id long, component long"), 8).collect()
    met = set()
    groups = {}
    for c in cells:
        groups.setdefault((c.family, c.x, c.y), []).append(c)
    for (f, _, _), members in groups.items():
        assert len(members) <= 3 * 8
        both = any(m.side for m in members)
        met |= {(f, a.id, b.id) for a in members for b in members if a.id < b.id and a.component != b.component and (not both or a.side != b.side)}
    assert met == {(f, i, j) for f in (1, 2) for i in range(40) for j in range(i + 1, 40) if j >= 30}


def test_near_duplicates_of_odd_rows(odd, none):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd, words=2).collect()}
    assert len(got) == 9 and got[5][1:] == (1, False) and got[8][1] == 7
    assert got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[4] == (0, 4, True)
    assert near_dedup.near_duplicates(none).count() == 0


def test_null_and_repeated_ids(corpus):
    """Every text of an id counts, and null ids don't make rows one document."""
    t = [" ".join(f"t{n}w{k}" for k in range(40)) for n in range(6)]
    near = lambda n: t[n] + " more"
    rows = [(None, t[0]), (None, near(0)), (None, t[1]), (None, t[2]), (5, t[3]), (5, t[4]), (6, near(3)), (7, near(4)), (8, t[5]), (9, near(2)), (4, None), (4, near(5))]
    docs = corpus.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(docs, words=2).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id} == {(4, 4, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 4, False), (9, 9, True)}
    assert sorted((r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [(0, False), (0, True), (0, True), (9, False)]
    clean = pipeline.without_near_copies(corpus, docs, FOLDER).collect()
    left = sorted((r.text or "").removesuffix(" more") for r in clean)
    assert left == sorted(["", *t]) and {(r.doc_id, r.text) for r in clean} <= set(rows)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_contaminated_documents_are_found_and_clean_ones_are_not(corpus, odd, none):
    rnd = random.Random(3)
    word = lambda: f"w{min(int(rnd.paretovariate(0.35)), 9000)}"
    items = [(100 + i, " ".join(word() for _ in range(rnd.randint(15, 50))) + ". " + " ".join(f"a{rnd.randrange(900)}" for _ in range(5))) for i in range(25)]
    docs, holds = [], set()
    for d in range(400):
        words = [word() for _ in range(rnd.randint(5, 250))]
        if d % 4 == 0:
            item, text = rnd.choice(items)
            part = text.split()
            if d % 8 == 0:  # a paraphrase: a sixth of the words are others
                part = [f"p{rnd.randrange(9000)}" if rnd.random() < 1 / 6 else w for w in part]
            at = rnd.randint(0, len(words))
            words[at:at] = part
            holds.add((d, item))
        docs.append((d, " ".join(words)))
    found = decontamination.contaminated(corpus.createDataFrame(docs, "doc_id long, text string"), corpus.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(got & holds) >= 0.95 * len(holds) and not {d for d, _ in got} - {d for d, _ in holds}
    texts, known = dict(docs), dict(items)
    for r in found:
        assert r.lcs_words <= lcs(known[r.item_id].split(), texts[r.doc_id].split()) and r.lcs_words >= 0.45 * r.item_words
    bench = corpus.createDataFrame([(1, None), (2, ""), (3, "alpha beta gamma delta epsilon zeta.")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.contaminated(odd, bench).collect()) == [1, 1, 5]
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(odd, bench.where("false")).count() == 0
    assert decontamination.common_subsequence(*[__import__("numpy").array(x) for x in ([1, 2, 3, 4, 2], [2, 9, 3, 2, 4])]) == 3


def test_common_words_and_short_items_amid_unknown_words(corpus):
    """What is sought of an item doesn't depend on how many words around it, or documents, the benchmark knows nothing of."""
    rnd = random.Random(8)
    word = lambda: f"c{rnd.randrange(60)}"
    unknown = lambda n: [f"u{rnd.randrange(10**9)}" for _ in range(n)]
    items = [(i, [word() for _ in range(24)]) for i in range(12)] + [(100 + i, [word() for _ in range(6 + i % 6)]) for i in range(24)]
    docs = [(1000 + d, " ".join(word() for _ in range(15))) for d in range(3000)]
    for i, words in items:
        part = [w if i >= 100 or k % 3 else unknown(1)[0] for k, w in enumerate(words)]
        docs.append((i, " ".join(unknown(15) + part + unknown(15))))
    bench = corpus.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontamination.contaminated(corpus.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {i for i, _ in items} <= {r.doc_id for r in found if r.doc_id == r.item_id}


def test_items_whose_words_the_fitted_sample_lacks(corpus, monkeypatch):
    """Recall holds when the sample is far smaller than the corpus and has none of an item's words."""
    monkeypatch.setattr(decontamination, "FIT_DOCUMENTS", 20)
    rnd = random.Random(4)
    word = lambda: f"c{min(int(rnd.paretovariate(0.5)), 3000)}"
    rare = lambda i, k: f"z{i}q{k}"
    # Half the items are in words of their own, half have common words between them.
    items = [(i, [rare(i, k) if i % 2 or k % 2 else word() for k in range(30)]) for i in range(40)]
    docs = [(1000 + d, " ".join(word() for _ in range(rnd.randint(20, 80)))) for d in range(3000)]
    for i, words in items:
        part = words if i % 4 < 2 else [w if k % 4 else f"p{rnd.randrange(10**9)}" for k, w in enumerate(words)]
        docs.append((i, " ".join([word() for _ in range(40)] + part + [word() for _ in range(40)])))
    bench = corpus.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontamination.contaminated(corpus.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {i for i, _ in items} == {r.doc_id for r in found} and all(r.doc_id == r.item_id for r in found)


def test_latent_space_is_fitted_on_all_documents(corpus, monkeypatch):
    """The basis holds as much of all documents' and items' passages as singular vectors can; copies count once."""
    monkeypatch.setattr(decontamination, "FIT_DOCUMENTS", 20)
    rnd, window, weight = random.Random(6), decontamination.WINDOW, 0.1
    topics = [[f"t{t}w{k}" for k in range(5)] for t in range(40)]
    texts = [rnd.choices(topics[d % 40], k=rnd.randint(5, 45)) + [f"u{d}"] * (d % 2) + rnd.choices(topics[d % 7], k=3) for d in range(600)]
    texts += [["t1w1", "u1", "t2w2"], ["t1w1", "u2", "t2w2"], ["t1w1", "u2"] * 90, ["u3"]]
    rows = [(d, " ".join(t)) for d, t in enumerate(texts + texts[:200])] + [(None, None), (7, "")]
    every = [w for t in topics for w in t]
    rnd.shuffle(every)
    items = decontamination.items_of([(bytes([k]), " ".join(every[20 * k : 20 * k + 20])) for k in range(10)])
    names = {decontamination.hashed(w)[0]: w for w in every}
    vocabulary = np.array(sorted(names))
    place = {names[h]: k for k, h in enumerate(vocabulary)}
    docs = corpus.createDataFrame(rows, "doc_id long, text string").repartition(5)
    frequency, n, fitted = decontamination.corpus_pass(docs, vocabulary, "text")
    held = Counter(w for _, text in rows for w in set((text or "").split()))
    assert n == len(rows) and frequency.tolist() == [held[names[h]] for h in vocabulary] and fitted.count() == len(texts) - 1
    idf = np.log((n + 1) / (frequency + 0.5)).clip(0.05)
    basis = decontamination.fitted_basis(fitted, decontamination.Index(items, vocabulary, idf, frequency=frequency), weight)
    passages = []
    own = [[place.get(w) for w in t] for t in texts] + [np.searchsorted(vocabulary, i.words).tolist() for i in items]
    for k, words in enumerate(own):
        for a in range(0, len(words), window):
            row = np.zeros(len(vocabulary))
            np.add.at(row, known := [w for w in words[a : a + window] if w is not None], idf[known])
            passages.append(row / max(np.sqrt((idf[known] ** 2).sum()), 1e-6) * (np.sqrt(weight) if k < len(texts) else 1))
    whole = np.array(passages).T @ np.array(passages)
    best = np.sort(np.linalg.eigvalsh(whole))[::-1][: decontamination.RANK].sum()
    assert np.allclose(basis.T @ basis, np.eye(decontamination.RANK), atol=1e-3) and np.trace(basis.T @ whole @ basis) > 0.98 * best
    # many texts at once, in small parts
    monkeypatch.setattr(decontamination, "FIT_WORDS", 30)
    total, flat = np.zeros(basis.shape), [len(vocabulary) if w is None else w for words in own for w in words]
    sizes, end = np.array([len(words) for words in own]), sum(map(len, texts))
    decontamination.add_passages(total, basis * weight, idf, np.array(flat[:end], np.uint8), sizes[: len(texts)])
    decontamination.add_passages(total, basis, idf, np.array(flat[end:], np.uint8), sizes[len(texts) :])
    assert np.allclose(total, whole @ basis, rtol=1e-4, atol=1e-3)


def test_crowded_buckets_are_cut_without_losing_near_pairs(corpus):
    """A bucket of singletons that share one chunk and no more doesn't grow with its square; pairs at the distance meet."""
    rng = np.random.default_rng(12)
    n, width = 6000, near_dedup.WIDTH
    signs = rng.integers(0, 1 << 16, (n, near_dedup.POSITIONS), dtype=np.uint16)
    signs[:, :width] = signs[0, :width]
    planted = []
    for a in range(0, 200, 2):
        signs[a + 1] = signs[a]
        # as far apart as may be, with two errors at least in every other chunk where there are enough
        where = np.concatenate([[rng.integers(width)], *[width * c + rng.permutation(width)[:2] for c in range(1, near_dedup.CHUNKS)]])[: near_dedup.DISTANCE]
        signs[a + 1, where] ^= np.uint16(1)
        planted.append((a, a + 1))
    signed = corpus.createDataFrame([(i, s.tobytes()) for i, s in enumerate(signs)], "id long, signature binary")
    families = near_dedup.chunk_keys(signed).groupBy("key").count().where("count > 1000").select(F.col("key").alias("family"))
    rows = near_dedup.chunk_keys(signed).withColumnRenamed("key", "family").join(families, "family").select("family", "id", F.col("id").alias("component"))
    found = near_dedup.second_level(rows, signed).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.family, set()).add(r.id)
    assert all(any(a in g and b in g for g in groups.values()) for a, b in planted)
    assert len(found) < 20 * len(planted) * 9 * 6


def test_crowded_buckets_give_the_same_components(corpus, monkeypatch):
    rnd = random.Random(31)
    line = [f"boiler{i}" for i in range(12)]
    texts = []
    for _ in range(60):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(8)]
        texts += [" ".join(line + own), " ".join(line + own[:-1] + ["end"])]
    docs = corpus.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plain = sorted(near_dedup.near_duplicates(docs, words=2).collect())
    monkeypatch.setattr(near_dedup, "CROWD", 2)
    assert sorted(near_dedup.near_duplicates(docs, words=2).collect()) == plain
    assert len({r.component_id for r in plain}) <= 60


ALONE = """
import random, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from modelward.llm import near_dedup

here = sys.argv[2]
conf = {"spark.ui.enabled": "false", "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{here}/events", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false",
        "spark.sql.shuffle.partitions": "4", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.driver.memory": "1g", "spark.driver.host": "127.0.0.1", "spark.local.dir": here}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
spark.sparkContext.setCheckpointDir(f"{here}/kept")
rnd = random.Random(17)
texts = [" ".join(f"{rnd.getrandbits(32):08x}" for _ in range(3000)) for _ in range(400)]
spark.createDataFrame(list(enumerate(texts + [t + " end" for t in texts[:5]])), "doc_id long, text string").write.parquet(f"{here}/docs")
near_dedup.near_duplicates(spark.read.parquet(f"{here}/docs")).write.parquet(f"{here}/found")
spark.stop()
"""


def test_only_texts_with_a_near_partner_are_shuffled(corpus, tmp_path):
    """Disk goes by the texts that are compared, not by the corpus; nothing is broadcast, as on large tables."""
    (tmp_path / "events").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", ALONE, root, str(tmp_path)], check=True, timeout=300, capture_output=True)
    events = [json.loads(line) for log in (tmp_path / "events").iterdir() for line in log.read_text().splitlines()]
    written = sum(e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"] for e in events if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"))
    got = {r.doc_id: r.component_id for r in corpus.read.parquet(f"{tmp_path}/found").collect()}
    assert got == {i: i - 400 if i >= 400 else i for i in range(405)}
    assert 0 < written < 405 * 3000 * 9 / 4


def test_texts_are_found_whatever_the_filter_lets_pass(corpus, monkeypatch):
    """A full filter shuffles more and loses nothing; equal rows of an id and text give a row once."""
    texts = corpus.createDataFrame([(i, 10 + i, f"t{i}") for i in range(50)] + [(3, 13, "t3"), (3, 99, "other")], "doc long, mark long, text string")
    wanted = corpus.createDataFrame([(100 + i, i, 10 + i) for i in range(0, 50, 3)], "id long, doc long, mark long")
    rows = corpus.createDataFrame([(103, "x"), (103, "y"), (148, "z")], "id long, place string")
    want = [(103, "x", "t3"), (103, "y", "t3"), (148, "z", "t48")]
    for least, most in ((near_dedup.LEAST_BITS, near_dedup.MOST_BITS), (64, 64)):
        monkeypatch.setattr(near_dedup, "LEAST_BITS", least)
        monkeypatch.setattr(near_dedup, "MOST_BITS", most)
        assert sorted(map(tuple, near_dedup.with_texts(rows, wanted, texts).select("id", "place", "text").collect())) == want
    assert near_dedup.with_texts(rows, wanted.where("false"), texts).count() == 0
