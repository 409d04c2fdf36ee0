"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive tokens of the whole text, as long as the template and a quarter more (SLACK), so that it
does not matter where lines break. A template meets a block if at least THRESHOLD of its distinct tokens stand in it, those
that name the license (REQUIRED) among them. Tokens that tell of another license (BARRED) part blocks: no block holds one.
Tokens are ordered by how many documents hold them, rare ones first. A block can only meet a template of t tokens, a of
them needed, if it holds one of the template's t - a + 1 rarest tokens (prefix), so only the surroundings of those are
looked at; if they hold at least a of its tokens (length), and enough of them behind the first common one (position),
a window slides over them and its tokens are compared in full.

Templates are a short list that comes with the code, and its size is checked, so every task gets a copy of it.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import map_batches, text_or_empty

THRESHOLD = 0.8
SLACK = 0.25   # tokens that a block may have beyond those of the template, as a share of them
MAX_TEMPLATE_TOKENS = 100_000   # of all templates together; more would need a shuffled join

# Fixed phrases of the contract: their label holds wherever the words stand in a row.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices by which licenses are commonly declared.
TEMPLATES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
)

# Tokens of a label's templates that no notice lacks: what names the license.
REQUIRED = {
    "gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "apache": "apache license", "mit": "mit license", "mpl": "mozilla public license",
    "cc-by": "creative commons attribution", "cc-by-nc": "cc by nc creative commons attribution noncommercial", "cc-by-sa": "cc by sa creative commons attribution sharealike",
}
# Tokens that make another license of a label's notice.
_TERMS = "noncommercial nc sharealike sa noderivatives noderivs nd non share no"
BARRED = {
    "gpl": "lesser affero library", "lgpl": "affero", "cc-by": _TERMS,
    "cc-by-nc": "sharealike sa noderivatives noderivs nd", "cc-by-sa": "noncommercial nc noderivatives noderivs nd",
}

# ASCII letters in lower case, digits and all other bytes of UTF-8 stay; every other ASCII character parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class Ordered:
    """Templates with tokens by rank of frequency, and where each prefix token stands."""
    rank: dict[bytes, int]
    ranks: list[tuple[int, ...]]
    needed: list[int]
    labels: list[str]
    width: list[int]
    required: list[frozenset[int]]
    barred: list[frozenset[bytes]]
    prefix: dict[int, list[tuple[int, int]]]
    prefix_words: frozenset[bytes]


def ordered(templates, frequency: dict[bytes, int], threshold: float = THRESHOLD) -> Ordered:
    sets = [sorted({*tokens(t.encode())}) for _, t in templates]
    if sum(map(len, sets)) > MAX_TEMPLATE_TOKENS:
        raise ValueError("too many template tokens to give every task a copy")
    words = sorted({w for s in sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: k for k, w in enumerate(words)}
    ranks = [tuple(sorted(rank[w] for w in s)) for s in sets]
    needed = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
    prefix = defaultdict(list)
    for k, (r, a) in enumerate(zip(ranks, needed)):
        for i, x in enumerate(r[:len(r) - a + 1]):
            prefix[x].append((k, i))
    width = [math.ceil((1 + SLACK) * len(tokens(t.encode()))) for _, t in templates]
    required = [frozenset(rank[w] for w in tokens(REQUIRED.get(label, "").encode()) if w in s) for (label, _), s in zip(templates, sets)]
    barred = [frozenset(tokens(BARRED.get(label, "").encode())) for label, _ in templates]
    return Ordered(rank, ranks, needed, [label for label, _ in templates], width, required, barred, dict(prefix), frozenset(words[x] for x in prefix))


def most_in_window(places: list[tuple[int, int]], width: int, required: frozenset[int], stops: list[int]) -> int:
    """Most distinct tokens in ``width`` places next to each other that hold all ``required`` ones and no stop; 0 if there are none.

    ``places``: (place, token) in order; ``stops``: places in order. Of the windows that end at a place only the longest matters.
    """
    held: Counter[int] = Counter()
    most = first = bar = 0
    last_stop = -1
    for at, x in places:
        held[x] += 1
        while bar < len(stops) and stops[bar] < at:
            last_stop, bar = stops[bar], bar + 1
        while places[first][0] <= max(at - width, last_stop):
            gone = places[first][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            first += 1
        if len(held) > most and required <= held.keys():
            most = len(held)
    return most


def text_matches(words: list[bytes], o: Ordered) -> list[tuple[int, float]]:
    """(template, best containment) of every template that some block of the text meets."""
    held = [(at, o.rank[w]) for at, w in enumerate(words) if w in o.rank]
    present = {x for _, x in held}
    spots = defaultdict(list)   # template -> places of its prefix tokens
    for at, x in held:
        for k, _ in o.prefix.get(x, ()):
            spots[k].append(at)
    found = []
    for k, places in sorted(spots.items()):
        r, a, width = o.ranks[k], o.needed[k], o.width[k]
        if not o.required[k] <= present:
            continue
        stops = [at for at, w in enumerate(words) if w in o.barred[k]] if o.barred[k] else []
        mine, most, at = set(r), 0, 0
        while at < len(places):
            # surroundings of prefix tokens that lie close together
            low = high = places[at]
            while at < len(places) and places[at] < high + 2 * width:
                high, at = places[at], at + 1
            near = held[bisect_left(held, (low - width + 1,)):bisect_left(held, (high + width,))]
            near = [(i, x) for i, x in near if x in mine]
            common = {x for _, x in near}
            if len(common) < a or len(r) - bisect_left(r, min(common)) < a:
                continue
            most = max(most, most_in_window(near, width, o.required[k], stops[bisect_left(stops, low - width + 1):bisect_left(stops, high + width)]))
        if most >= a:
            found.append((k, most / len(r)))
    return found


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(index of its first word, label) of all places of all phrases."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        sought = b" " + phrase.encode() + b" "
        at = line.find(sought)
        while at >= 0:
            found.append((line.count(b" ", 0, at), label))
            at = line.find(sought, at + 1)
    return found


def token_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each template token stands; as many numbers as the templates have tokens."""
    vocabulary = {w for _, t in templates for w in tokens(t.encode())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(tokens(text.encode())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = docs.select(text_or_empty("text").alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r.token): r.n for r in rows.collect()}


def scanned(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per document: doc_id, n_words, n_base (places of phrases), first_word, last_word, base_labels, labels, score.

    labels adds those of the templates that a block meets. score: the best containment of a template met, 1 where a
    phrase stands, else 0. Null and empty texts have no words and no labels, an empty table gives none. Texts are read whole,
    however long. Repeated rows get equal results; other columns are not looked at.
    """
    o = ordered(templates, token_frequencies(docs, templates), threshold)

    def one(text: str) -> tuple:
        words = tokens(text.encode())
        places = phrase_places(words, phrases)
        met = [] if o.prefix_words.isdisjoint(words) else text_matches(words, o)
        base = {label for _, label in places}
        labels = base.union(o.labels[k] for k, _ in met)
        starts = [at for at, _ in places]
        score = max([1.0 if places else 0.0, *(share for _, share in met)])
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*map(one, batch.column(1).to_pylist())))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(rows, kinds))],
                                          ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")), run, schema)


def oracle_sql() -> str:
    """Every window of every text against every template, without prefix, length and position filters."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    names = " UNION ALL ".join(f"SELECT {p.split()!r} AS p, '{label}' AS label" for p, label in PHRASES.items())

    def row(label: str, t: str) -> str:
        ws = t.split()
        needs, bars = [w for w in REQUIRED.get(label, "").split() if w in ws], BARRED.get(label, "").split()
        return (f"SELECT '{label}' AS label, {sorted(set(ws))!r} AS ts, {needs!r}::VARCHAR[] AS req, {bars!r}::VARCHAR[] AS bar, "
                f"CAST(ceil({1 + SLACK} * {len(ws)}) AS BIGINT) AS width, CAST(greatest(1, ceil({THRESHOLD} * {len(set(ws))} - 1e-9)) AS BIGINT) AS a")
    sets = " UNION ALL ".join(row(*t) for t in TEMPLATES)
    return f"""
    WITH w AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS ws FROM documents),
    names AS ({names}), sets AS ({sets}),
    hits AS (SELECT doc_id, label, unnest(list_filter(range(1, len(ws) - len(p) + 2), lambda i: ws[i:i + len(p) - 1] = p)) - 1 AS i FROM w, names),
    base AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word FROM hits GROUP BY doc_id),
    near AS (SELECT doc_id, ws, list_filter(range(1, len(ws) + 1), lambda i: list_contains(ts, ws[i])) AS starts,
                    list_filter(range(1, len(ws) + 1), lambda i: list_contains(bar, ws[i])) AS stops, sets.* FROM w, sets
             WHERE len(list_intersect(ws, ts)) >= a AND list_has_all(ws, req)),
    runs AS (SELECT doc_id, label, ts, req, a, unnest(list_transform(starts, lambda i: ws[i:least(i + width - 1, coalesce(list_min(list_filter(stops, lambda s: s >= i)) - 1, len(ws)))])) AS run FROM near),
    met AS (SELECT doc_id, label, len(list_intersect(run, ts)) / len(ts) AS share FROM runs WHERE len(list_intersect(run, ts)) >= a AND list_has_all(run, req)),
    best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id),
    bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM hits) GROUP BY doc_id),
    al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT doc_id, label FROM hits UNION SELECT doc_id, label FROM met) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.first_word, base.last_word,
           coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels,
           CAST(greatest(CASE WHEN base.n > 0 THEN 1 ELSE 0 END, coalesce(best.share, 0)) AS DOUBLE) AS score
    FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)"""
