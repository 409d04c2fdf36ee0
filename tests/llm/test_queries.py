"""Registered queries on whole small tables, and every operator on awkward rows."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_shingles
from compare import compare, duck
from pyspark.sql import functions as F
from test_units import PAGE, plain_base, plain_fingerprint

import __spark_entry__
import corpus_pipeline
from hearthmark.llm import exact_dedup, html_text, licenses, mixing, pii, quality, sentencepiece_codec, simhash, substring_dedup, token_files
from hearthmark.llm.queries import BYTE_BPE, ORACLES, PIECE_MODEL, QUERIES
from hearthmark.session import shared_folder

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
BLANK = "[\x20\x09-\x0d]+"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
PASSAGE = " ".join(f"p{k}" for k in range(60))
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, fp string, anchors int, __row int, row int, size int, copies int"
ROWS = [(1, "The quick brown fox of the hill and the dog is in the yard to sleep", "s0"), (2, None, "s0"), (3, "", None), (4, " \n\t ", "s1"), (5, LONG, "s1"),
        (6, f"a b {PASSAGE} c", "s0"), (7, f"x {PASSAGE}", None), (8, "the of and to in is that for with was be at", "s2"),
        (9, "The  quick brown fox of the hill and the dog is in the yard to sleep", "s0"), (9, "The  quick brown fox of the hill and the dog is in the yard to sleep", "s0"),
        (None, "Licensed under the Apache License, Version 2.0.\nmail a@b.org or +1 (386) 555-5294", "s3"), (10, "MIT License CC BY", "s3"), (11, f"{PASSAGE} {PASSAGE}", "s0"),
        (12, "The quick brown fox of the hill and the dog is in the yard to sleep", "s2")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, 1, 2, "k", "f", 3, 4, 5, 6, 7) for i, t, s in ROWS]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    ok, message = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name])
    assert ok, message


def table(spark, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def words_of(text):
    return [w for w in re.split(BLANK, text or "") if w]


def plain_removed(rows, window):
    words = [words_of(r["text"]) for r in rows]
    count = Counter(tuple(ws[k:k + window]) for ws in words for k in range(len(ws) - window + 1))
    out = []
    for ws in words:
        gone = set()
        for k in range(len(ws) - window + 1):
            if count[tuple(ws[k:k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [substring_dedup.MAX_PASSAGES, 1])
def test_substring_dedup(spark, docs, none, most):
    rows = table(spark)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(spark.read.parquet(f"{SF}/documents.parquet"), most=most).collect()}
    assert got == dict(zip((r["doc_id"] for r in rows), plain_removed(rows, 35))) and sum(g[1] for g in got.values()) > 0
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(docs, most=most, with_text=True).collect())
    small = [{"text": t} for _, t, _ in ROWS]
    assert got == sorted((i or -1, *x) for (i, *_), x in zip(ROWS, plain_removed(small, 35)))
    assert substring_dedup.removed(none, most=most).collect() == []


def plain_components(rows):
    fps = [plain_fingerprint(r["text"]) for r in rows]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = defaultdict(list)
    for r, k in zip(rows, label):
        least[k].append(r["doc_id"])
    return {r["doc_id"]: (f"{f:016x}", min(least[k])) for r, f, k in zip(rows, fps, label)}


def test_simhash(spark, docs, none):
    rows = table(spark)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_neardup"](spark, SF).collect()}
    assert got == plain_components(rows)
    found = simhash.classes(docs).collect()
    assert len(found) == len(ROWS) and {r.component_id for r in found if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in found if r.doc_id in (1, 9, 12)} == {1}
    assert simhash.classes(none).collect() == [] and simhash.keep_one(none).collect() == []
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect() if r.doc_id in (1, 2, 3, 4, 9, 12)) == [1, 2]


def test_components_of_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(100, 160)] + [(k, 1) for k in range(2, 40)] + [(900, 800), (901, 800), (901, 700)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 40)}, 900: 700, 901: 700, 800: 700, 700: 700}


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    assert got[None].labels == "apache" and got[None].score == 1.0 and (got[None].first_word, got[None].last_word) == (3, 3)
    assert (got[10].n_base, got[10].base_labels, got[10].first_word, got[10].last_word) == (2, "cc-by,mit", 0, 2)
    assert got[2].n_words == 0 and got[2].labels == "" and got[2].first_word is None
    assert licenses.scanned(none).collect() == []


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(ROWS)
    assert all(r.taken <= 2 * r.size for r in got)
    total = sum(r["size"] for r in got)
    assert abs(sum({r.source_size: r.target for r in got}.values()) - 1.5 * total) < 1e-6
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sum(len(words_of(r.text)) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []


def test_mix_comes_near_its_targets(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source_size", "target").agg(
        F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in rows)


def plain_targets(sizes):
    """Targets by sources in order, by resharing the excess until no source is above twice its size."""
    left, share, out = 1.5 * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while share:
        level = left / sum((5, 2, 1)[k % 3] for k in share)
        over = {k for k in share if level * (5, 2, 1)[k % 3] >= 2 * sizes[k]}
        for k in over or share:
            out[k] = 2.0 * sizes[k] if over else level * (5, 2, 1)[k % 3]
        left, share = left - sum(out[k] for k in over), share - over if over else set()
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [7, 100, 90, 80, 300, 1], [50, 0, 30, 1000, 20, 10, 60], [5], [0, 0], [1, 1000, 1000, 1]])
def test_targets_are_those_of_resharing(spark, sizes):
    rows = [(k, "w " * n, None if k and k == len(sizes) - 1 else f"s{k}") for k, n in enumerate(sizes)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[k].source_size for k in range(len(sizes))] == sizes
    assert [got[k].target for k in range(len(sizes))] == pytest.approx(plain_targets(sizes))


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[11].n_repeat_words == 120 and got[11].base_failed
    assert got[8].kept and got[1].kept and not got[5].kept
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and {8, 1} <= {r.doc_id for r in out.collect()}
    assert quality.report(none).collect() == []


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTE_BPE)

    def want(rows):
        at, out = 0, []
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            out.append((i, at, len(ids), zlib.crc32(ids)))
            at += len(ids)
        return out
    rows = [(r["doc_id"], r["text"]) for r in table(spark)]
    assert sorted(tuple(r) for r in QUERIES["op6_token_files"](spark, SF).collect()) == want(rows)
    got = [tuple(r) for r in token_files.round_trip(docs, BYTE_BPE).collect()]
    assert sorted(got, key=lambda r: r[1]) == want([(i, t) for i, t, _ in ROWS])
    assert token_files.round_trip(none, BYTE_BPE).collect() == []


def test_exact_dedup(spark, docs, none):
    got = [r for r in exact_dedup.classes(docs).collect()]
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].keep_id == by[12].keep_id == by[9].keep_id == 9 and by[1].group_size == 4 and not by[1].kept
    assert by[4].keep_id == by[2].keep_id == by[3].keep_id == 4   # the longest original of the empty ones
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    for share in (0.0, 1.0):
        assert sorted(map(str, exact_dedup.classes(docs, share).collect())) == sorted(map(str, got))
    out = exact_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert exact_dedup.classes(none).collect() == [] and exact_dedup.drop_repeats(none).collect() == []


def test_exact_dedup_where_ids_repeat(spark):
    rows = [(1, "long text"), (1, "other"), (2, "other  "), (3, "x"), (3, "x"), (None, "n"), (None, "n "), (None, None), (4, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    left = exact_dedup.drop_repeats(table).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == [("1", "long text"), ("2", "other  "), ("3", "x"), ("None", ""), ("None", "n ")]
    assert sorted((str(r.doc_id), r.kept) for r in exact_dedup.classes(table).collect() if r.doc_id in (3, 4)) == [("3", False), ("3", True), ("4", False)]


def test_exact_dedup_writes_its_answer_and_the_winners_only(spark, docs):
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    written = lambda: {d for d in os.listdir(at) if d.startswith("rdd-")}
    kept = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before, held = written(), kept()
    left = exact_dedup.drop_repeats(docs)
    assert len(written() - before) == 2   # other frames were read twice, but need no files that all executors see
    assert not kept() - held
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in exact_dedup.classes(docs).collect() if r.kept)


def test_pii(spark, docs, none):
    rows = table(spark)
    got = {r.doc_id: r for r in QUERIES["op8_pii"](spark, SF).collect()}
    for r in rows:
        base, mine = plain_base(r["text"] or ""), got[r["doc_id"]]
        spelled = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]]
        assert [mine.n_email, mine.n_ip, mine.n_card, mine.n_phone] == [len(base[k]) for k in pii.KINDS]
        assert mine.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest() and set(spelled) <= set(mine.spans.split(",")) | {""}
    got = {r.doc_id: r for r in pii.marked(docs).collect()}
    assert (got[None].n_email, got[None].n_phone) == (1, 1) and got[2].spans == "" and got[4].spans == ""
    assert pii.marked(none).collect() == []


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (None, "v", "", 1), (1, "u", PAGE, 1), (3, "w", "<p>" + LONG, 1)], "page_id long, url string, html string, text int")
    got = html_text.extracted(pages).collect()
    assert len(got) == 5 and {(r.page_id, r.n_chars) for r in got} == {(1, len(html_text.main_text(PAGE))), (2, 0), (None, 0), (3, len(LONG))}
    assert html_text.extracted(pages.limit(0)).collect() == []
    assert QUERIES["op9_html_text"](spark, SF).where("n_chars = 0").count() == 0


def test_sentencepiece(spark, docs, none):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), docs):
        d = sorted((str(r.doc_id), r.text or "") for r in frame.collect())
        got = sorted(sentencepiece_codec.encoded(frame, PIECE_MODEL).collect(), key=lambda r: str(r.doc_id))
        assert [r.token_ids for r in got] == [sp.encode(t) for _, t in d] and all(r.agrees and r.round_trip for r in got)
        back = sentencepiece_codec.decoded(sentencepiece_codec.encoded(frame, PIECE_MODEL), PIECE_MODEL).collect()
        assert sorted((str(r.doc_id), r.text) for r in back) == d
    assert sentencepiece_codec.encoded(none, PIECE_MODEL).collect() == []


def plain_pipeline(spark):
    """The pipeline's rows by the operators' definitions, for the stages that filter; the mix by its query."""
    kept = {r.doc_id for r in QUERIES["op5_quality_rules"](spark, SF).collect() if r.kept}
    rows = [r for r in table(spark) if r["doc_id"] in kept]
    best = {}
    for r in rows:
        key = re.sub(BLANK, "", r["text"])
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r["text"]), r["doc_id"]))
    rows = [r for r in rows if best[re.sub(BLANK, "", r["text"])][1] == r["doc_id"]]
    texts = [(r["doc_id"], r["text"]) for r in rows]
    comp = test_shingles.plain_components([i for i, _ in texts], test_shingles.plain_links(texts))
    rows = [r for r in rows if comp[r["doc_id"]] == r["doc_id"]]
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix(frame).collect()}
    return sorted(r["doc_id"] for r in rows for _ in range(taken[r["doc_id"]]))


def test_pipeline(spark, docs, none):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == plain_pipeline(spark) and all(r.agrees for r in got)
    for frame in (docs, none):
        d = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == frame.columns
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()} == {r.doc_id for r in d.collect()}


def test_entry_has_one_query_for_each_operator():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
