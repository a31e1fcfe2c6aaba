"""Hard negatives, url filters and the Merkle manifest against plain Python."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modelward.llm import hard_negatives, merkle_manifest, url_filters

HEX = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (5, 2), (2, 1)])
def test_hilbert_curve_goes_from_neighbour_to_neighbour(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), axis=-1).reshape(-1, axes)
    keys = [k.tobytes() for k in hard_negatives.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    anchors, block = rng.integers(-300, 300, (20, 8)).astype(float), rng.integers(-300, 300, (50, 8)).astype(float)
    least, most = hard_negatives.bounds(anchors, block.min(axis=0), block.max(axis=0))
    scores = anchors @ block.T
    assert (least <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most).all()


def negatives_by_hand(rows, positives=5, negatives=3):
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in dict.fromkeys((i, lab, tuple(v)) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v))]
    out = []
    for a, lab, v in (r for r in rows if r[0] % 50 == 0):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in rows)
        near = [(-s, i) for s, i, m in scored if m == lab and i != a][:positives]
        for ps, p in near:
            fits = [(-s, i) for s, i, m in scored if m != lab and 50 * ps <= -100 * s <= 95 * ps][:negatives]
            out += [(a, p, k + 1, n, ps, s) for k, (s, n) in enumerate(fits)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, anchor string, slot int, score double, key string, shard int").repartition(3)


def extra(rows):
    return [(i, lab, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2.0, "k", 7) for i, lab, v in rows]


def searched(df, **more):
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **more)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_in_small_blocks_and_rounds(corpus):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(3)), np.float32(centres[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in rng.permutation(1500)]
    want = negatives_by_hand(rows)
    assert len(want) > 100
    assert searched(vectors(corpus, extra(rows))) == want
    # blocks of 16 rows; rounds of 4 anchors
    assert searched(vectors(corpus, extra(rows)), block_rows=16, anchor_bytes=8 * 8 * 4) == want


def test_zone_maps_pass_over_far_blocks(corpus):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, ((np.eye(8)[i % 8] * 10 + rng.normal(size=8) * 0.1)).tolist()) for i in range(1600)]
    ids = np.array([r[0] for r in rows])
    x = np.floor(256 * np.float32([r[2] for r in rows]).astype(float))
    search = hard_negatives.Search(x[:1], ids[:1], np.zeros(1, np.int64), np.full((1, 1), (x[:1] @ x.T).max() / 2), np.full((1, 1), np.inf), True, 5)
    best, passed = hard_negatives.Best(search), 0
    order = np.argsort([k.tobytes() for k in hard_negatives.hilbert_keys(np.clip(np.floor(x / 700) + 1, 0, 3), 2)], kind="stable")
    for at in np.array_split(order, 32):
        passed += not len(best.open(x[at].min(axis=0), x[at].max(axis=0)))
    assert passed >= 24
    assert searched(vectors(corpus, extra(rows)), block_rows=32) == negatives_by_hand([(i, m, np.float32(v).tolist()) for i, m, v in rows])


def test_hard_negatives_with_odd_rows(corpus):
    one = [0.5, 0.25]
    rows = [(0, 1, one), (0, 1, one), (1, 1, one), (2, 1, one), (3, 2, [0.25, 0.25]), (4, 2, [0.25, 0.25]), (5, 3, [0.3, 0.1]), (6, 2, None), (None, 1, one), (7, None, one),
            (8, 1, [None, 1.0]), (9, 1, [float("nan"), 1.0]), (10, 1, [float("inf"), 1.0]), (50, 9, one), (100, 2, [-0.5, -0.5])]
    rows = [(i, m, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, m, v in rows]
    assert searched(vectors(corpus, extra(rows))) == negatives_by_hand(rows)
    equal = [(i, i % 2, one) for i in range(3000)]
    assert searched(vectors(corpus, extra(equal)), block_rows=64) == negatives_by_hand(equal) == []
    assert searched(vectors(corpus, extra(rows)).where("false")) == []
    assert searched(vectors(corpus, extra([(0, 1, []), (1, 1, []), (2, 2, [])]))) == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError, match="2\\*\\*53"):
        searched(vectors(corpus, extra([(0, 1, [1e6]), (1, 1, [1e6])])))
    with pytest.raises(TypeError, match="whole numbers"):
        searched(vectors(corpus, extra(rows)).withColumn("vec_id", F.col("vec_id").cast("string")))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def verdict_by_hand(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [
    None, "", "no scheme/es/", "http://example.org", "http://example.org/", "HTTP://EXAMPLE.ORG/es/", "http://www.Example.org/en/12?x=/es/", "http://notexample.org/en/1", "http://a.com/fr/x", "http://a.com/de", "http://a.com/de/#/fr/",
    "http://a.com?u=http://b.org/", "x://y://example.org/es/", "http://org/", "http://example.org:80/es/", "http://example.org./es/", "http://É.org/ü", "http:///es/", "http://example.org/\nes/", "http://example.org//es/", "http://com/de/" + "a/" * 50_000,
]


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "h", "p", "r", "v", "b") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, verdict string, _best string")
    found = url_filters.url_verdicts(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), **more)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}


def test_verdicts_by_hand(corpus):
    want = {i: verdict_by_hand(u, RULES) for i, u in enumerate(URLS)}
    assert judged(corpus, URLS, RULES) == want
    # a trie for each rule
    assert judged(corpus, URLS, RULES, trie_chars=1) == want
    assert set(v[3] for v in judged(corpus, URLS, [(None, "org", "/"), ("allow", None, "/")], default="block").values()) == {"block"}
    assert judged(corpus, [], RULES) == {}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.sampled_from(["", "b", "a.b", "c.a.b", "aa"]), st.text("a/", max_size=5)), max_size=8), st.sampled_from(["b", "a.b", "x.a.b", "c.a.b", "aa", "a..b", ""]), st.text("a/", max_size=7))
def test_trie_finds_the_longest_rule(rules, host, path):
    found = url_filters.Trie(rules).longest(host, path)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    assert found == max(fits, default=None)


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grown(row, fan):
    """All levels of the tree over a row of nodes."""
    out = [row]
    while len(out[-1]) > 1:
        out.append([HEX(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def manifest_by_hand(rows, fan=2):
    order = lambda v: (v is not None, v if v is not None else 0)
    leaf = lambda r: HEX(*[field(v) for v in r])
    groups = {}
    for r in sorted(rows, key=lambda r: (order(r[0]), leaf(r))):
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: grown([leaf(r) for r in groups[n]], fan) for n in names}
    top = grown([trees[n][-1][0] for n in names], fan)
    out = []
    for g, n in enumerate(names):
        for i, r in enumerate(groups[n]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h, proof = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r), ""
            for levels, at in ((trees[n], i), (top, g)):
                for level in levels[:-1]:
                    run = level[at // fan * fan : at // fan * fan + fan]
                    before, after = "".join(run[: at % fan]), "".join(run[at % fan + 1 :])
                    h, proof, at = HEX(before, h, after), proof + before + after, at // fan
            out.append((r[0], leaf(r), trees[n][-1][0], top[-1][0], HEX(proof), h, h == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars int, text string, hash string, rank long, `group` string, block long, tree string, depth int, `above` string, part int"


def manifested(spark, rows, **more):
    df = spark.createDataFrame([(*r, *[None] * 8) for r in rows], DOCS).repartition(5)
    found = merkle_manifest.merkle_manifest(df, **more)
    return sorted([tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


@pytest.mark.parametrize("sizes,fan,levels", [([1], 2, 3), ([2], 2, 3), ([9, 1], 2, 3), ([8, 17, 1], 2, 2), ([65, 3, 4, 5, 2], 2, 2), ([30, 1, 9], 3, 2), ([5, 5], 2, 1)])
def test_manifest_by_hand(corpus, sizes, fan, levels):
    langs = [None, "", "é", "a", "=x"]
    rows = [(k * 1000 + i, "s" if i % 3 else None, langs[k], None if i % 5 == 0 else i, f"tёxt {i}" if i % 4 else None) for k, n in enumerate(sizes) for i in range(n)]
    assert manifested(corpus, rows, fan=fan, levels=levels) == manifest_by_hand(rows, fan)


def test_manifest_with_odd_rows(corpus):
    rows = [(1, None, None, None, None)] * 3 + [(None, "s", "x", 3, ""), (None, "s", "x", 4, "long " * 100_000), (7, "a", "x", 2**31 - 1, "t"), (7, "b", "x", 1, "t"), (-5, "a", "y", -1, "t")]
    rows += [(i, "s", "x", i, "t") for i in range(100, 140)]
    assert manifested(corpus, rows) == manifest_by_hand(rows)
    assert manifested(corpus, rows, levels=2) == manifest_by_hand(rows)
    assert manifested(corpus, [(1, "s", "x", 1, "t")]) == manifest_by_hand([(1, "s", "x", 1, "t")])
    assert manifested(corpus, []) == []


def test_altered_rows_are_told_apart(corpus):
    rows = [(i, "s", "x", i, "t") for i in range(300)]
    found = {r[0]: r[-1] for r in manifested(corpus, rows, levels=3)}
    assert {i for i, ok in found.items() if not ok} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 0}
