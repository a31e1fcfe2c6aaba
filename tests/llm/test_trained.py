"""Held-out accuracy of the trained models, and their odd cases."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modelward.llm import html_text, quality, toxicity
from modelward.llm.labels import held_out, labelled_sample


@pytest.fixture(scope="module")
def made(corpus):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["th", "er", "an", "on", "in", "re", "st"]) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(1200):
        sentences = [" ".join(word() for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 40))]
        toxic, good = int(rnd.random() < 0.2), int(rnd.random() > 0.2)
        if toxic:
            k = rnd.randrange(len(sentences))
            sentences[k] += " " + rnd.choice(["Vilezz" + word(), "scumm"])
        text = ". ".join(sentences) + "."
        if not good:
            text = text.replace(" ", rnd.choice(["%% ", " | "]))
        docs.append((i, text))
        labels.append((i, good, toxic))
    return corpus.createDataFrame(docs, "doc_id long, text string").repartition(3), corpus.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(made):
    docs, labels = made
    scored = toxicity.toxicity_scores(docs, toxicity.trained(docs, labels)).join(labels, "doc_id").join(docs, "doc_id")
    rows = scored.where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    for r in rows:
        for s in r.offending:
            assert re.search("vilezz|scumm", r.text[s.start : s.end].lower())


def test_quality_on_held_out_rows(made):
    docs, labels = made
    rows = quality.quality_scores(docs, quality.trained(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_sample_is_bounded_and_leaves_the_fold_out(made):
    docs, labels = made
    assert len(labelled_sample(docs, labels, "toxic", 100, 10_000)) == 100
    held = docs.where(held_out(F.col("doc_id")))
    assert len(labelled_sample(held, labels, "toxic", 100, 10_000)) == 0


def test_models_on_odd_rows(odd, none, labels):
    for scores, model in ((toxicity.toxicity_scores, toxicity.trained(odd, labels)), (quality.quality_scores, quality.trained(odd, labels))):
        rows = scores(odd, model).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert scores(none, model).count() == 0
    empty = labels.where("false")
    assert toxicity.trained(odd, empty).constant == quality.trained(odd, empty).constant == 0.5
    assert toxicity.filtered(odd, toxicity.trained(odd, empty)).columns == odd.columns


def test_sample_takes_ids_with_texts_and_long_texts(made):
    docs, labels = made
    beyond = labels.union(labels.selectExpr("doc_id + 1000000", "quality", "toxic"))
    assert len(labelled_sample(docs, beyond, "toxic", 300, 10_000)) == 300
    long = docs.selectExpr("doc_id", "if(doc_id % 2 = 0, repeat(text, 40), text) AS text")
    got = labelled_sample(long, labels, "toxic", 200, 1000)["text"].to_pylist()
    assert 0 < sum(map(len, got)) <= 200_000 and max(map(len, got)) > 1000
    assert len(labelled_sample(docs.selectExpr("doc_id", "repeat(text, 2000) AS text"), labels, "toxic", 50, 16_000)) > 0
    # Long texts that take all the room still leave the next short ones.
    assert len(labelled_sample(long, labels, "toxic", 100, 4000)) == 100


def test_nothing_to_learn_from_keeps_all_rows(odd, labels):
    for few in (labels.where("false"), labels.where("toxic = 1")):
        assert toxicity.filtered(odd, toxicity.trained(odd, few)).count() == 11


def test_score_of_a_long_text_in_parts():
    """A text of several blocks scores as its responses taken at once would."""
    network = quality.started()
    data = np.random.default_rng(2).integers(32, 120, 700_001).astype(np.uint8)
    whole = quality.patches(network.params["embed"][data]) @ network.params["filters"]
    want = np.maximum.reduceat(whole, np.arange(0, len(whole), quality.PIECE))
    assert np.allclose(quality.piece_peaks(network.params, data), want, atol=1e-4)


def test_slopes_are_the_loss_slopes():
    rng = np.random.default_rng(1)
    network = quality.started()
    network.params = {k: v.astype(np.float64) for k, v in network.params.items()}
    texts, y = [rng.integers(40, 60, n).astype(np.uint8) for n in (5, 90, 400)], np.array([1, 0, 1])

    def loss():
        p = [np.clip(quality.document_score(network, t), 1e-9, 1 - 1e-9) for t in texts]
        return -np.mean(y * np.log(p) + (1 - y) * np.log1p(-np.array(p)))

    got = quality.slopes(network.params, texts, y)
    for name in network.params:
        flat = network.params[name].reshape(-1)
        for k in rng.choice(len(flat), min(6, len(flat)), replace=False):
            kept, step = flat[k], 1e-5
            flat[k] = kept + step
            above = loss()
            flat[k] = kept - step
            below = loss()
            flat[k] = kept
            assert got[name].reshape(-1)[k] == pytest.approx((above - below) / (2 * step), abs=2e-3)


def test_viterbi_is_the_best_path():
    from itertools import product

    field = html_text.Field({"a": 0.7, "b": -1.1}, np.array([[0.2, -0.9], [-0.3, 0.5]]))
    seen = [(("a",), ()), (("b",), ()), (("b",), ("a",)), (("a",), ("a",)), (("b",), ())]
    lean = [field.sum(x) + field.sum(y) for x, y in seen]
    value = lambda s: sum(x for x, on in zip(lean, s) if on) + sum(field.turns[i, j] for i, j in zip(s, s[1:]))
    assert [int(x) for x in field.decoded(seen)] == list(max(product((0, 1), repeat=5), key=value))


def test_pages_made_with_another_seed():
    import html

    rng, model = np.random.default_rng(77), html_text.trained()
    pages = [html_text.labelled_page(rng) for _ in range(150)]
    right = [html_text.main_text(p, model) == "\n".join(" ".join(html.unescape(t).split()) for t in good) for p, good in pages]
    assert np.mean(right) > 0.9


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""), ("<a", ""), ("<article><p>x &amp y &lt;b&gt; &#8364;&nbsp;z</article", "x & y <b> € z"),
        ('<nav><ul><li><a href="/a">a</a></ul></nav><article><h1>T</h1><p><b>One  two.<br><p>Three\n four. <i>Fi</i>ve.</article><footer>&copy; x</footer>', "T\nOne two.\nThree four. Five."),
        ('<script>var t="</p><article><p>no</p>";</script><article><p>Yes it is.</p><!-- <p>no</p> --></article>', "Yes it is."),
        ("<article><p>One two three.</p><form><p>Name here.</p></form><p>Four five.</p></article><section id=comments><p>I think so. Yes.</p></section>", "One two three.\nFour five."),
    ],
)
def test_pages_by_hand(page, want):
    assert html_text.main_text(page, html_text.trained()) == want


def test_odd_pages(corpus):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "<article><p>Long text. " + "word " * 200_000 + "</article>", 2)]
    got = html_text.extracted_text(corpus.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and max(r.n_chars for r in got) > 900_000
    assert html_text.extracted_text(corpus.createDataFrame([], "page_id long, url string, html string")).count() == 0


def noisy_or_by_hand(text, weights, bias):
    """A document's score from its sentences, word by word."""
    clean = 1.0
    words, sentences = 0, []
    for part in re.split(r"[.!?\n]", "".join(c.lower() if c.isascii() else c for c in text)):
        found = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", part)
        sentences += [found[k : k + toxicity.LONGEST] for k in range(0, len(found), toxicity.LONGEST)]
    for words in sentences:
        logit = bias + sum(max([weights.get(w, 0.0)] + [weights.get(w.encode()[:n], 0.0) for n in toxicity.PREFIXES if len(w.encode()) > n]) for w in words)
        clean *= 1 - 1 / (1 + np.exp(-logit))
    return 1 - clean


def test_scores_are_the_noisy_or_of_sentences(corpus):
    words = {"vile": 6.0, "scum": 3.5, "nasty": 2.0, "bös": 4.0}
    stems = {b"hate": 5.0, b"scumb": 4.5}
    from modelward.llm.arrays import FOLDED, word_blocks

    def of(word, prefix=None):
        (_, _, h, *_), = word_blocks(pa.array([word]), FOLDED, toxicity.GAPS, toxicity.PREFIXES)
        return h[0, 0 if prefix is None else 1 + toxicity.PREFIXES.index(prefix)]

    keys = {of(w): v for w, v in words.items()} | {of(s.decode() + "zzzz", len(s)): v for s, v in stems.items()}
    order = sorted(keys)
    model = toxicity.Model(np.array(order, np.uint64), np.array([keys[k] for k in order], np.float32), -4.0)
    texts = ["Vile scum! Nasty, nasty day.", "hateful words " * 60, "clean. text\nhere", "", "böse BÖS bös", "scumbag " + "x " * 31 + "vile", "vile" * 9, "a.b!c?d " * 50 + "nasty scum hateful"]
    got = toxicity.toxicity_scores(corpus.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert r.score == pytest.approx(noisy_or_by_hand(t, words | stems, -4.0), abs=1e-6), t


@pytest.mark.parametrize("share", [0.05, 0.45, 0.55, 0.9])
def test_toxicity_is_learnt_at_any_share_of_toxic_labels(share):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts, labels = [], []
    for _ in range(800):
        toxic = rnd.random() < share
        texts.append(" ".join([word() for _ in range(40)] + (["vilezz"] if toxic else []) + [word() for _ in range(10)]) + ".")
        labels.append(int(toxic))
    model = toxicity.fitted(pa.array(texts), np.array(labels))
    right = []
    for first, last, hashes, heads, sentences, _, _ in toxicity.instances(pa.array(texts)):
        scores = -np.expm1(toxicity.clean_odds(toxicity.sentence_logits(model, hashes, heads), sentences))
        right += [(s >= 0.5) == bool(y) for s, y in zip(scores, labels[first:last])]
    assert np.mean(right) > 0.97


def test_training_runs_in_a_task(made):
    docs, labels = made
    own = toxicity.fitted(*(lambda t: (t["text"].combine_chunks(), t["label"].to_numpy()))(labelled_sample(docs, labels, "toxic", toxicity.TRAIN_ROWS, toxicity.TRAIN_BYTES)))
    far = toxicity.trained(docs, labels)
    assert far.bias == own.bias and (far.keys == own.keys).all() and (far.weights == own.weights).all()
    assert toxicity.trained(docs.where("false"), labels).constant == 0.5


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><div><p>One two three four. Five six.</p><p>Seven eight nine ten eleven.</p></div></body>", "One two three four. Five six.\nSeven eight nine ten eleven."),
        ('<article><h1>Title here</h1><p>One two three four five. Six seven.</p><p><a href="/x">All of this sentence is a link. And this one too.</a></p><p>The end of it is here.</p></article>',
         "Title here\nOne two three four five. Six seven.\nAll of this sentence is a link. And this one too.\nThe end of it is here."),
        ("<article><p class='a\"b' title=\"it's\">One two three four. Five.</p><a 'x\">Six seven eight nine.</a></article>", "One two three four. Five.\nSix seven eight nine."),
    ],
)
def test_plain_containers_and_linked_paragraphs(page, want):
    assert html_text.main_text(page, html_text.trained()) == want


@pytest.mark.parametrize("page", [
    "<div><p>" * 100_000 + "deep text", "<span><div>" * 100_000, "<a 'x\">" * 100_000, '<a x="y>' * 100_001, "".join(f"<t{i} class=c{i}>x" for i in range(100_000)), "<span>" * 100_000 + "<div></div>" * 100_000,
    "<span>" * 100_000 + "</div>" * 100_000, "<" * 1_000_000, "<a " + "class" * 200_000, "<p>" + "<!--" * 200_000, "<td><li>" * 100_000,
])
def test_deep_and_broken_pages_take_seconds(page):
    model = html_text.trained()
    began = time.time()
    html_text.main_text(page, model)
    assert time.time() - began < 20


def convolved_by_hand(params, text):
    """The network's score, filter by filter and byte by byte."""
    data = list(text.encode()) + [0] * max(0, quality.WIDTH - len(text.encode()))
    places = [[params["embed"][b].tolist() for b in data[a : a + quality.WIDTH]] for a in range(0, len(data) - quality.WIDTH + 1, quality.STRIDE)]
    filters = params["filters"].reshape(quality.WIDTH, quality.EMBED, quality.FILTERS)
    best, mean = [], []
    for f in range(quality.FILTERS):
        own = filters[:, :, f].tolist()
        response = [sum(x * w for byte, row in zip(place, own) for x, w in zip(byte, row)) for place in places]
        pieces = [max(response[a : a + quality.PIECE]) for a in range(0, len(response), quality.PIECE)]
        chunks = [max(x) for x in zip(pieces, pieces[1:])] or pieces
        act = [math.tanh(c + params["shift"][f]) for c in chunks]
        best.append(max(act))
        mean.append(sum(act) / len(act))
    return 1 / (1 + math.exp(-(sum(x * w for x, w in zip(best + mean, params["out"].tolist())) + params["bias"][0])))


def test_quality_scores_by_hand(corpus):
    network = quality.started(4)
    network.params["shift"] += 0.1
    network.params["out"] *= 5
    texts = ["", "a", "seven b", "Exactly8", "some words, böse %% | and more. " * 3, "x" * 300, "chunk after chunk of text; " * 40]
    got = quality.quality_scores(corpus.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), network).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert r.score == pytest.approx(convolved_by_hand(network.params, t), abs=1e-5)
        assert r.predicted == int(r.score >= 0.3)
