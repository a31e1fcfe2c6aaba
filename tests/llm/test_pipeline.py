"""The pipeline's stages on odd rows, and a run against the stages' own results."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from modelward.llm import decontamination, near_dedup, toxicity

FOLDER = os.environ.get("MODELWARD_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("place", range(len(pipeline.STAGES)))
def test_stages_on_odd_rows(corpus, odd, none, place):
    name, stage = pipeline.STAGES[place]
    for docs in (odd, none):
        out = stage(corpus, docs, FOLDER)
        out.collect()
        if place < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns


def test_stages_keep_clean_rows_only(corpus):
    docs, labels, bench = (corpus.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(pipeline.STAGES)
    scores = toxicity.toxicity_scores(docs, toxicity.trained(docs, labels))
    clean = stages["toxicity"](corpus, docs, FOLDER)
    assert ids(clean) == ids(scores.where("predicted = 0")) and len(ids(clean)) < len(ids(docs))
    single = stages["near_dedup"](corpus, docs, FOLDER)
    assert ids(single) == ids(near_dedup.near_duplicates(docs).where("kept")) and single.count() == len(ids(single))
    found = ids(decontamination.contaminated(docs, bench))
    assert ids(stages["decontamination"](corpus, docs, FOLDER)) == ids(docs) - found


def test_run_places_every_document(corpus):
    rows = pipeline.run(corpus, FOLDER).orderBy("start").collect()
    assert rows and all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:]))


def test_decontamination_goes_by_rows(corpus):
    """A null id keeps no contaminated row, and a shared id takes no clean one."""
    items = [r.text for r in corpus.read.parquet(f"{FOLDER}/benchmark.parquet").limit(2).collect()]
    rows = [(None, items[0]), (None, "clean words here"), (1, items[1]), (1, "other clean words"), (2, None), (3, "third clean text")]
    docs = corpus.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.text) for r in pipeline.without_benchmark(corpus, docs, FOLDER).collect()}
    assert got == {r for r in rows if r[1] not in items}


def test_decontamination_fits_on_all_documents(corpus, monkeypatch):
    """However many documents there are, all that share a word with the benchmark are fitted; copies count once."""
    monkeypatch.setattr(decontamination, "FIT_DOCUMENTS", 5)
    seen, fitted = [], decontamination.fitted_basis
    monkeypatch.setattr(decontamination, "fitted_basis", lambda texts, *rest: seen.append(texts.count()) or fitted(texts, *rest))
    words = corpus.read.parquet(f"{FOLDER}/benchmark.parquet").first().text.split()
    rows = [(d, f"{words[d % len(words)]} unknown{d % 60}") for d in range(120)] + [(None, None), (1, ""), (2, "\t")]
    docs = corpus.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert pipeline.without_benchmark(corpus, docs, FOLDER).count() == len(rows)
    assert seen == [len({text for _, text in rows[:120]})]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_near_stage_against_brute_force(corpus):
    docs = corpus.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i, s in sets.items() if s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if min(len(sets[a]), len(sets[b])) * 10 >= 8 * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    kept = pipeline.without_near_copies(corpus, docs, FOLDER).collect()
    assert sorted(kept) == sorted(r for r in rows if top(r.doc_id) == r.doc_id)


def mixed_by_hand(rows):
    """How often each document comes, by rounds of sharing and then by the seeded order."""
    size = {i: len(words_of(t)) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight, full = {s: k % 3 + 1 for k, s in enumerate(names)}, {}
    while True:
        open_ = [s for s in names if s not in full]
        level = (sum(total.values()) - sum(full.values())) / (sum(weight[s] for s in open_) or 1)
        over = {s: 3.0 * total[s] for s in open_ if level * weight[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    copies = {}
    for s in names:
        goal = math.floor(full.get(s, level * weight[s]) + 0.5) if total[s] else 0
        whole, rest = divmod(goal, total[s]) if total[s] else (0, 0)
        mine = sorted((hashlib.md5(f"17:{i}".encode()).hexdigest(), size[i], i) for i, _, x in rows if x == s)
        for _, n, i in mine:
            taken = whole * n + max(0, min(n, rest))
            rest -= n
            copies[i] = math.floor(taken / n + 0.5) if n else 1
    return copies


def test_mixing_stage_by_hand(corpus):
    docs = corpus.read.parquet(f"{FOLDER}/documents.parquet")
    want = mixed_by_hand([(r.doc_id, r.text, r.source) for r in docs.collect()])
    got = Counter(r.doc_id for r in pipeline.mixed_sources(corpus, docs, FOLDER).select("doc_id").collect())
    assert got == {i: n for i, n in want.items() if n}
    rows = [(1, "a b c", "x"), (2, "d", "y"), (3, None, "y"), (4, " ", None), (5, "e f g h i j k l", None), (6, "m n", "x")]
    small = corpus.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in pipeline.mixed_sources(corpus, small, FOLDER).collect())
    assert got == {i: n for i, n in mixed_by_hand(rows).items() if n}


def test_token_stage_against_the_library(corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = corpus.read.parquet(f"{FOLDER}/documents.parquet").repartition(5)
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in pipeline.token_files(corpus, docs, FOLDER).collect()) == want
