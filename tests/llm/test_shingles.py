"""Near copies by Jaccard similarity against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from hearthmark.llm import shingles

SF = "/root/testdata/sf0.01"


def plain_set(text, k=5):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def plain_links(rows, least=0.8):
    """Pairs of ids at least ``least`` alike; ids are unique."""
    held = {i: plain_set(t) for i, t in rows}
    by = defaultdict(list)
    for i, s in held.items():
        for x in s:
            by[x].append(i)
    common = Counter(p for ids in by.values() for p in combinations(sorted(ids), 2))
    return {(a, b) for (a, b), n in common.items() if n >= least * (len(held[a]) + len(held[b]) - n) - 1e-9}


def plain_components(ids, links):
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def edited(words, share, rng):
    return [f"n{rng.random()}" if rng.random() < share else w for w in words]


def test_sets_are_those_of_plain_words():
    texts = ["", None, "a", "A b  c\td", "a b c d", "a b c d e f a b c d e", "É é x y z w", "x\n" * 30]
    got = shingles.shingle_sets(texts)
    assert [len(s) for s in got] == [len(plain_set(t)) for t in texts]
    for (s, t), (u, v) in combinations(zip(got, texts), 2):
        assert (s.tolist() == u.tolist()) == (plain_set(t) == plain_set(v))
        assert abs(shingles.similarity(s, u) - len(plain_set(t) & plain_set(v)) / len(plain_set(t) | plain_set(v))) < 1e-9


def test_all_near_copies_of_a_table_are_linked(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    links = plain_links(rows)
    got = {r.doc_id: r.component_id for r in shingles.classes(docs).collect()}
    recall = sum(got[a] == got[b] for a, b in links) / len(links)
    print(len(links), "pairs, recall", recall)
    assert recall == 1.0 and got == plain_components([i for i, _ in rows], links)


def test_a_large_group_and_its_fringe(spark):
    rng = random.Random(10)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    rows = [(k, " ".join(edited(base, rng.choice([0.01, 0.02, 0.03]), rng))) for k in range(400)]
    fringe = edited(base, 0.06, rng)
    rows += [(400 + k, " ".join(edited(fringe, 0.01, rng))) for k in range(40)]
    rows += [(500, " ".join(rng.sample(base, len(base)))), (501, ""), (502, None), (503, "a b c"), (504, "A  b c")]
    links = plain_links(rows)
    got = {r.doc_id: r.component_id for r in shingles.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain_components([i for i, _ in rows], links)


def test_sketches_never_differ_more_than_sets():
    rng = random.Random(5)
    for n in (1, 20, 300, 3000):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
        one, other = shingles.shingle_sets([" ".join(edited(base, share, rng)) for share in (0.02, 0.05)])
        apart = len(np.setxor1d(one, other))
        bits = int(np.bitwise_count(shingles.odd_sketch(one) ^ shingles.odd_sketch(other)).sum())
        assert bits <= apart and (apart - bits) % 2 == 0 and (apart > 100 or bits >= 0.7 * apart)


def _crowd(n):
    """Near copies of one text, most of them too far from each other to be linked."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    out = [(0, " ".join(base))]
    for k in range(1, n):
        words = list(base)
        for at in rng.sample(range(5, 145), 2 if k % 9 == 0 else 6):
            words[at] = f"n{k}x{at}"
        out.append((k, " ".join(words)))
    return out


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    made, plain = [], shingles.verified

    def counted(docs, pairs, *rest):
        made.append(pairs.count())
        return plain(docs, pairs, *rest)
    monkeypatch.setattr(shingles, "verified", counted)
    rows = _crowd(600)
    got = {r.doc_id: r.component_id for r in shingles.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain_components([i for i, _ in rows], plain_links(rows))
    assert sum(made) < 20 * len(rows)


def test_links_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    """Documents of one edit are near copies of all others, those of two edits of no other: a third of all pairs are links."""
    came, plain = [], shingles.components

    def counted(links):
        came.append(links.count())
        return plain(links)
    monkeypatch.setattr(shingles, "components", counted)
    monkeypatch.setattr(shingles, "close_fingerprints", lambda d: d.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    rng = random.Random(8)
    rows = []
    for k in range(300):
        words = [f"w{i}" for i in range(150)]
        for at in rng.sample(range(5, 145, 5), 1 if k % 5 == 0 else 2):
            words[at] = f"n{k}x{at}"
        rows.append((k, " ".join(words)))
    links = plain_links(rows)
    got = {r.doc_id: r.component_id for r in shingles.classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    print(len(links), "links, came to components:", came)
    assert got == plain_components([i for i, _ in rows], links)
    assert len(links) > 50 * len(rows) and max(came) < 20 * len(rows)


def test_fingerprints_propose_links(spark, monkeypatch):
    monkeypatch.setattr(shingles, "shared_keys", lambda d: plain(d.limit(0)))
    plain = _plain_keys
    rows = _crowd(60)
    got = {r.doc_id: r.component_id for r in shingles.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = plain_components([i for i, _ in rows], plain_links(rows))
    assert any(c != i for i, c in got.items()) and all(held[i] == held[c] for i, c in got.items())


_plain_keys = shingles.shared_keys


def test_stage_drops_copies_beyond_four_bits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()}
    assert not [p for p in plain_links(rows) if kept.issuperset(p)]
    odd = spark.createDataFrame([(None, "a b", 1), (9, "a b", 2), (9, "c d e f g h", 3), (9, "c d e f g h", 3), (None, "x", 4), (None, "x", 5), (2, None, 6), (3, "", 7)],
                                "doc_id long, text string, copies int")
    left = corpus_pipeline.near_copies(spark, odd, SF)
    assert left.columns == odd.columns and sorted((str(r.doc_id), r.text) for r in left.collect()) == [("2", None), ("9", "a b"), ("9", "c d e f g h"), ("None", "x")]
    assert corpus_pipeline.near_copies(spark, odd.limit(0), SF).collect() == []
