"""Url rules, vector codes and fill-in-the-middle: against brute force, and on awkward rows."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthmark.llm import fill_middle, url_rules, vector_codes
from hearthmark.llm.vector_codes import SumOrdered

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


# url rules

def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^/?#]*([^?#]*)", rest).group(1)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, default)


NESTED = [("net", "/", "block"), ("a.net", "/x", "allow"), ("b.a.net", "/", "block"), ("a.net", "/", "allow"), ("a.net", "/", "block"), ("c-d.net", "", "allow"),
          ("net", "/ab", "allow"), ("org", "/é", "block"), ("a.net", "/x/y", "block"), ("", "/", "block"), ("net:80", "/", "block"), (None, "/", "block"), ("net", None, "block")]
AWKWARD = [None, "", "no scheme", "http://", "http:///", "://net/", "http://NET/", "http://net", "http://a.net?x", "http://a.net/x#f", "http://.a.net/", "http://a..net/x/y/z", "http://net./",
           "http://u@net:80/ab", "http://x.net:80/", "http://x/?u=http://net/", "http://\n.net/\n/x", "http://org/é", "http://aé.org/é/", "http://c-d.net", "http://c.net/x", "http://a-b.net/",
           "http://anet/", "http://net/" + "a" * 100_000, "HTTP://net/ab", "http://İ.net/"]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_urls_against_brute_force(spark, ranges):
    draw = random.Random(ranges)
    hosts = ["net", "a.net", "b.a.net", "c.b.a.net", "ab.net", "org", "x.org", "c-d.net", "b.c-d.net", "com"]
    urls = AWKWARD + [f"http://{draw.choice(hosts)}{draw.choice(['', '/', '/x', '/x/y/', '/ab', '/é', '/q'])}{draw.choice(['', '?q', '#f'])}" for _ in range(400)]
    pages = spark.createDataFrame([(k, u, "h", 1, 2, "r") for k, u in enumerate(urls)], "page_id long, url string, host string, range int, nth int, row string").repartition(3)
    rules = url_rules.rules_table(spark, NESTED)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judged(pages, rules, ranges=ranges).collect()}
    assert got == {k: plain_verdict(u, NESTED) for k, u in enumerate(urls)}


def test_many_rules_and_few_urls(spark):
    draw = random.Random(5)
    labels = ["a", "b", "c", "d"]

    def host():
        return ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))
    rules = sorted({(host(), "/" + draw.choice(labels) * draw.randint(0, 2)): draw.choice(["block", "allow"]) for _ in range(300)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{host()}/{draw.choice(labels) * 3}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judged(pages, url_rules.rules_table(spark, rules), ranges=16).collect()}
    assert got == {k: plain_verdict(u, rules) for k, u in enumerate(urls)}


def test_a_crowded_host_and_url_are_parted(spark):
    """A third of the rows with one url: they lie in several ranges, and every rule that holds them is in each."""
    pages = spark.range(6_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://www.a.net/x/1").otherwise(
        F.concat(F.lit("http://h"), F.col("id"), F.lit(".org/x"))).alias("url"))
    judged = url_rules.judged(pages, url_rules.rules_table(spark, NESTED), ranges=12)
    assert judged.where("host = 'www.a.net'").select("rule", "verdict").distinct().collect() == [("a.net/x", "allow")]
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "Join" not in plan
    host, path = url_rules.host_and_path(F.col("url"))
    keys = pages.select(F.concat(url_rules.reversed_host(host), path, F.lit("\x01"), F.hex(F.xxhash64("page_id"))).alias("key"))
    cuts = url_rules.cut_points(keys, 12)
    assert keys.select(url_rules.range_of(F.col("key"), cuts).alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] < 1.3 * 6_000 / 12


def test_urls_of_rows_that_repeat_and_of_none(spark):
    pages = spark.createDataFrame([(None, "http://net/"), (None, "http://net/"), (1, None), (1, "http://org/fr/")], "page_id long, url string")
    rules = url_rules.rules_table(spark)
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in url_rules.judged(pages, rules).collect() if r.rule)
    assert got == [("1", "org/fr/", "allow"), ("None", "net/", "block"), ("None", "net/", "block")]
    assert url_rules.judged(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_rules.judged(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert sorted(r.page_id for r in url_rules.kept(pages, rules).collect()) == [1, 1]


# vector codes

def plain_nearest(entries, vectors):
    out = []
    for v in vectors:
        far = [sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)) for e in entries]
        out.append((far.index(min(far)), min(far)))
    return out


@pytest.mark.parametrize("reach", [2, 300, 1 << 20, 1 << 40])
def test_search_by_sums_is_exact(reach):
    draw = np.random.default_rng(reach)
    for width, count in ((1, 5), (3, 40), (16, 256), (7, 1)):
        entries = [tuple(int(x) for x in e) for e in draw.integers(-reach, reach + 1, (count, width))]
        entries += entries[:3]
        vectors = draw.integers(-reach, reach + 1, (200, width))
        index, far = SumOrdered(entries).nearest(vectors)
        assert list(zip(index.tolist(), [int(f) for f in far])) == plain_nearest(entries, vectors)


def plain_codes(rows, entries=256, rounds=4):
    """[(vec_id, label, vector)] -> [(vec_id, code, error, label_error, digest)] of a common dimension."""
    kept = [(i, la, [int(np.floor(1024 * float(x))) for x in v]) for i, la, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2])
    at = [d * p // 4 for p in range(5)]
    books = [[v[at[p]:at[p + 1]] for _, _, v in kept[:entries]] for p in range(4)]

    def assigned():
        return [[plain_nearest(books[p], [v[at[p]:at[p + 1]]])[0] for p in range(4)] for _, _, v in kept]
    for _ in range(rounds):
        near = assigned()
        for p in range(4):
            for e in range(len(books[p])):
                mine = [v[at[p]:at[p + 1]] for (_, _, v), n in zip(kept, near) if n[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    near = assigned()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(f for _, f in n) for n in near]
    by_label = {}
    for (_, la, _), e in zip(kept, errors):
        by_label[la] = by_label.get(la, 0) + e
    return [(i, "".join(f"{k:02x}" for k, _ in n), e, by_label[la], digest) for (i, la, _), n, e in zip(kept, near, errors)]


def test_codes_against_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(k, int(draw.integers(0, 3)) if k % 5 else None, [float(np.float32(x)) for x in draw.normal(0, 0.3, 12)]) for k in range(400)]
    rows += [(400, 1, None), (401, 1, [float("nan")] * 12), (402, 1, [float("inf")] + [0.0] * 11), (403, 1, [None] + [0.0] * 11), (404, None, [0.25] * 12), (404, None, [0.25] * 12),
             (None, 2, [-0.5] * 12), (405, 2, [1e6, -1e6] * 6)]
    schema = "vec_id long, embedding array<float>, label int, codes int, error string, vector int"
    table = spark.createDataFrame([(i, v, la, 1, "e", 2) for i, la, v in rows], schema).repartition(4)
    got = sorted((tuple(r) for r in vector_codes.compressed(table).collect()), key=str)
    assert got == sorted(plain_codes(rows), key=str) and len(got) == len(rows) - 4
    assert vector_codes.compressed(table.limit(0)).collect() == []


def test_codes_of_other_dimensions_and_back(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 0), (2, [1.0], 0), (3, [9.0, 9.0, 9.0, 9.0, 9.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.compressed(table).collect()}
    assert got == {1: ("00000000", 0, 0), 2: (None, None, 0), 3: ("01010101", 0, 0)}
    kept = vector_codes.kept_vectors(table)
    dimension, books = vector_codes.trained(kept)
    back = {r.vec_id: r.vector for r in vector_codes.decoded(vector_codes.coded(kept, dimension, books), books).collect()}
    assert back == {1: [1.0, 2.0, 3.0, 4.0, 5.0], 2: None, 3: [9.0] * 5}
    hollow = spark.createDataFrame([(1, [], 0), (2, [], 0)], "vec_id long, embedding array<float>, label int")
    assert [(r.code, r.error) for r in vector_codes.compressed(hollow).collect()] == [("00000000", 0)] * 2
    huge = spark.createDataFrame([(1, [1e14] * 4, 0), (2, [-1e14] * 4, 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(r.code for r in vector_codes.compressed(huge).collect()) == ["00000000", "01010101"]


# fill in the middle

def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    cut = form != "plain"
    return (n, form, len(prefix) if cut else None, len(middle) if cut else None, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


TEXTS = [None, "", " ", "\n", "a", "\x00b\x00", "é", "日本 語 text", "a<P>b", "<", "<P", ">x<", "<S<P<M", "M>S>P>", "😀a😀", "\r\n\t x", "A" * 200_000, "ab " * 40_000, "ÿÿ�", "<p>"]


def test_middle_against_brute_force(spark):
    draw = random.Random(1)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, "".join(draw.choice("ab <>PSMé😀\n\x00") for _ in range(draw.randint(0, 60)))) for k in range(600)]
    rows += [(None, "null id"), (-7, "negative id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, prefix string, n int").repartition(3)
    got = sorted((str(r.doc_id), *r[1:]) for r in fill_middle.report(docs).collect())
    assert [x[-1] for x in got] and got == sorted((str(i), *plain_middle(i, t)) for i, t in rows)
    assert fill_middle.report(docs.limit(0)).collect() == [] and {x[2] for x in got} == {"plain", "psm", "spm"}


def test_middle_pieces_make_up_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = fill_middle.rearranged(docs).join(docs.select("doc_id", "text"), "doc_id")
    assert out.where("form <> 'plain' AND concat(prefix, middle, suffix) <> text").count() == 0
    assert out.where(fill_middle.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0


def test_units_are_code_points():
    lists = fill_middle.unit_lists(pa.array(["ab, é😀c", ""])).to_pylist()
    assert lists == [[b"ab", b",", b" ", "é".encode(), "😀".encode(), b"c", b""], [b""]]
