"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate segments of up to MAX_TOKENS tokens by features of the span (its shape, characters,
length, checks, and the words before it), and dynamic programming over segments picks boundaries and types of a region
at once. Regions are the tokens around digits, at signs and equals signs; everything else is outside by construction.

The field is fitted here by gradient ascent on the likelihood of segmentations, with forward and backward sums over
segments, on TRAIN_LINES generated lines: a bounded set, the same at any size of input. Spans of the fixed patterns
always stay; the field's spans are added where they meet none of them.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import map_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")                  # of the fixed patterns
ADDED = ("secret",)                                       # kinds that only the field knows: keys, tokens, passwords
TYPES = (*KINDS, *ADDED)
MAX_TOKENS = 5
CONTEXT = 2          # tokens on either side of a region
TRAIN_LINES = 240
EPOCHS = 6
RATE = 0.3
SEED = 42

# Fixed patterns of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Maximal runs that can hold a match; a pattern is tried inside of these only, which keeps long runs of digits linear.
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-@")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        a, b = at, at + 1
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        while b < len(text) and text[b] in _LOCAL:
            b += 1
        yield from ((m.start(), m.end()) for m in EMAIL.finditer(text, a, b))
        done, at = b, text.find("@", b)


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in IP.finditer(text, run.start(), run.end()):
                parts = [p.lstrip("0") for p in m[0].split(".")]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    yield m.start(), m.end()


def _numbers(text: str, pattern: re.Pattern, least: int, most: int, check=None):
    for m in pattern.finditer(text):
        digits = "".join(_DIGIT.findall(m[0]))
        if least <= len(digits) <= most and (check is None or check(digits)):
            yield m.start(), m.end()


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    has_digit = bool(_DIGIT.search(text))
    return {
        "email": list(_emails(text)) if "@" in text else [],
        "ip": list(_ips(text)) if has_digit else [],
        "card": list(_numbers(text, CARD, 13, 19, luhn)) if has_digit else [],
        "phone": list(_numbers(text, PHONE, 9, 15)) if "+" in text else [],
    }


# --- the field ---

_EDGE = ".,;:!?\"'()[]{}<>"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CUES = {"token": "cue secret", "password": "cue secret", "passwd": "cue secret", "secret": "cue secret", "key": "cue secret", "api": "cue secret", "pwd": "cue secret",
         "tel": "cue phone", "phone": "cue phone", "call": "cue phone", "mobile": "cue phone", "fax": "cue phone", "mail": "cue email", "email": "cue email",
         "card": "cue card", "visa": "cue card", "host": "cue ip", "ip": "cue ip", "server": "cue ip"}
_HEX = frozenset("0123456789abcdef")


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Span without the punctuation at its edges, but with an opening bracket that is closed inside."""
    while end > start and text[end - 1] in _EDGE and not (text[end - 1] == ")" and "(" in text[start:end]):
        end -= 1
    while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    return start, end


def span_features(text: str, toks: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the segment of tokens i to j - 1 as a whole."""
    start, end = trimmed(text, toks[i][0], toks[j - 1][1])
    span = text[start:end]
    digits = sum(c in "0123456789" for c in span)
    letters = sum(c.isalpha() for c in span)
    parts = span.split(".")
    out = [f"tokens {j - i}", f"digits {min(digits, 20) // 3}", f"letters {min(letters, 30) // 5}", f"length {min(len(span), 60) // 6}"]
    out += [f"has {c}" for c in "@+=_-()/\"" if c in span]
    if len(parts) == 4 and all(p.isdecimal() for p in parts):
        out.append("four numbers" if all(len(p) < 4 and int(p) < 256 for p in parts) else "four large numbers")
    if "@" in span and "." in span.rpartition("@")[2] and j - i == 1:
        out.append("name at host")
    if not letters and 13 <= digits <= 19:
        only = "".join(c for c in span if c in "0123456789")
        out.append("luhn" if only.isascii() and luhn(only) else "long number")
    if span.startswith("+") and not letters and 9 <= digits <= 15:
        out.append("dialled")
    value = re.split(r"[=:]\s*[\"']?", span)[-1].strip("\"'")
    if len(value) >= 12 and digits and letters and value.isalnum():
        lower = value.lower()
        out.append("long hex" if _HEX.issuperset(lower) else "long mixed")
        out.append("one case" if value in (lower, value.upper()) else "two cases")
    words = [text[a:b].strip(_EDGE).lower() for a, b in toks[max(0, i - 2):i]]
    out += [f"before {_CUES[w]}" for w in words if w in _CUES]
    head = re.split(r"[^a-z]", span.lower(), maxsplit=1)[0]
    if head in _CUES:
        out.append(f"starts {_CUES[head]}")
    if span.isalpha() or not span:
        out.append("plain word")
    # the edges: what would be cut off or cut through
    if i and text[toks[i - 1][0]:toks[i - 1][1]][-1:] in "=+(":
        out.append("cut before")
    if j < len(toks) and text[toks[j][0]:toks[j][1]][:1] in "=)" or span.endswith("="):
        out.append("cut after")
    if not digits and "@" not in span and "=" not in span:
        out.append("no sign")
    return out


Weights = dict[tuple[str, str], float]


def _scores(text: str, toks: list[tuple[int, int]], weights: Weights):
    """(i, j, type, features, score) of every candidate segment; tokens outside of entities score 0."""
    for j in range(1, len(toks) + 1):
        for i in range(max(0, j - MAX_TOKENS), j):
            feats = span_features(text, toks, i, j)
            for kind in TYPES:
                yield i, j, kind, feats, sum(weights.get((kind, f), 0.0) for f in feats) + weights.get((kind, "bias"), 0.0)


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def train(lines: int = TRAIN_LINES, epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Weights by stochastic gradient ascent on the log-likelihood of the true segmentations."""
    weights: Weights = defaultdict(float)
    data = [(text, [(m.start(), m.end()) for m in _TOKEN.finditer(text)], gold) for text, gold in examples(lines, seed)]
    for epoch in range(epochs):
        rate = RATE / (1 + epoch)
        for text, toks, gold in data:
            segs = list(_scores(text, toks, weights))
            n = len(toks)
            into, out_of = defaultdict(list), defaultdict(list)
            for k, (i, j, *_, score) in enumerate(segs):
                into[j].append((i, score)), out_of[i].append((j, score))
            ahead = [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _logsum([ahead[j - 1], *(ahead[i] + s for i, s in into[j])])
            behind = [0.0] * (n + 1)
            for i in range(n - 1, -1, -1):
                behind[i] = _logsum([behind[i + 1], *(s + behind[j] for j, s in out_of[i])])
            true = {(i, j): kind for i, j, kind in gold}
            for i, j, kind, feats, score in segs:
                push = (true.get((i, j)) == kind) - math.exp(ahead[i] + score + behind[j] - ahead[n])
                if abs(push) > 1e-3:
                    for f in (*feats, "bias"):
                        weights[kind, f] += rate * push
    return {k: round(w, 4) for k, w in weights.items() if abs(w) > 1e-3}


def decode(text: str, toks: list[tuple[int, int]], weights: Weights) -> list[tuple[str, int, int]]:
    """Best segmentation of the tokens: (kind, start, end) of its entities in characters."""
    best: list[tuple[float, int, str]] = [(0.0, -1, "")]
    at = 0
    for i, j, kind, _, score in _scores(text, toks, weights):
        while at < j:
            at += 1
            best.append((best[at - 1][0], at - 1, ""))
        if best[i][0] + score > best[j][0]:
            best[j] = (best[i][0] + score, i, kind)
    found, j = [], len(toks)
    while j > 0:
        _, i, kind = best[j]
        if kind:
            found.append((kind, *trimmed(text, toks[i][0], toks[j - 1][1])))
        j = i
    return found[::-1]


def examples(lines: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated lines with entities and look-alikes, and their true segments in tokens."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: pick("aeinorst", rng.randint(2, 9)).capitalize() if rng.random() < 0.2 else pick("aeinorst", rng.randint(2, 9))

    def card() -> str:
        body = "4" + pick(string.digits, 14)
        number = next(body + d for d in string.digits if luhn(body + d))
        return number if rng.random() < 0.7 else " ".join(number[k:k + 4] for k in range(0, 16, 4))

    hexa, caps, mixed = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    makers = {
        "email": lambda: f"{word().lower()}{rng.choice(['', '.', '_'])}{rng.randint(1, 99)}@{word().lower()}.{rng.choice(['com', 'org', 'example.net'])}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice([f"+{rng.randint(1, 99)} ({pick(string.digits, 3)}) {pick(string.digits, 3)}-{pick(string.digits, 4)}",
                                     f"+{rng.randint(1, 99)} {pick(string.digits, 3)} {pick(string.digits, 7)}", f"({pick('23456789', 3)}) {pick(string.digits, 3)}-{pick(string.digits, 4)}"]),
        "secret": lambda: rng.choice([f"password={pick(hexa, 18)}", f'token = "{pick(hexa, 40)}"', "AKIA" + pick(caps, 16), f"api_key={pick(mixed, 24)}",
                                      f"secret: {pick(mixed, 20)}", f'key = "{pick(mixed, 32)}"', pick(hexa, 40)]),
    }
    alike = [lambda: str(rng.randint(0, 99_999)), lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 99)}", lambda: f"{rng.randint(1900, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}",
             lambda: f"{rng.randint(1, 9)}.{rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(1, 9)}", lambda: f"x = {rng.randint(1, 99)}", lambda: f"{rng.randint(1, 9)}%",
             lambda: f"Version {rng.randint(1, 9)}.0.", lambda: f"{rng.randint(100, 999)} {rng.randint(100, 999)}", lambda: f"@{word()}", lambda: f"a={rng.randint(1, 9)}"]
    out = []
    for k in range(lines):
        toks: list[str] = [word() for _ in range(rng.randint(1, 4))]
        gold = []
        if k % 4 == 3:
            toks += rng.choice(alike)().split()
        else:
            kind = TYPES[k % len(TYPES)]
            entity = makers[kind]().split()
            gold.append((len(toks), len(toks) + len(entity), kind))
            toks += entity
            if rng.random() < 0.3:
                toks[-1] += rng.choice(".,;")
        toks += [word() for _ in range(rng.randint(1, 3))]
        out.append((" ".join(toks), gold))
    return out


_SIGN = re.compile("[0-9@=]")


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Tokens around signs, in runs: CONTEXT tokens on either side, runs that touch are one."""
    marks = []
    m = _SIGN.search(text)
    while m:
        a = b = m.start()
        while a and text[a - 1] not in " \t\n\v\f\r":
            a -= 1
        token = _TOKEN.match(text, a)
        b = token.end()
        marks.append((a, b))
        m = _SIGN.search(text, b)
    found: list[list[tuple[int, int]]] = []
    for a, b in marks:
        left, at = [], a
        for _ in range(CONTEXT):
            while at and text[at - 1] in " \t\n\v\f\r":
                at -= 1
            stop = at
            while at and text[at - 1] not in " \t\n\v\f\r":
                at -= 1
            if stop > at:
                left.append((at, stop))
        right, at = [], b
        for _ in range(CONTEXT):
            token = _TOKEN.search(text, at)
            if token:
                right.append(token.span())
                at = token.end()
        run = [*left[::-1], (a, b), *right]
        if found and run[0][0] <= found[-1][-1][1]:
            found[-1] += [t for t in run if t[0] >= found[-1][-1][1]]
        else:
            found.append(run)
    return found


LONGEST_RUN = 400   # tokens decoded at once; longer runs are decoded in windows that overlap by 2 * MAX_TOKENS


def added_spans(text: str, weights: Weights) -> list[tuple[str, int, int]]:
    found = []
    for run in regions(text):
        for at in range(0, max(1, len(run) - 2 * MAX_TOKENS), LONGEST_RUN - 2 * MAX_TOKENS):
            found += decode(text, run[at:at + LONGEST_RUN], weights)
    return found


def spans_of(text: str, weights: Weights) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Spans of the fixed patterns by kind, and the field's spans that meet none of them, leftmost first, none overlapping."""
    base = base_spans(text)
    taken = sorted(s for spans in base.values() for s in spans)
    more, k, last = [], 0, 0
    for kind, a, b in sorted(added_spans(text, weights), key=lambda s: (s[1], -s[2])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= last and not any(x < b and a < y for x, y in taken[max(0, k - 4):k + 8]):
            more.append((kind, a, b))
            last = b
    return base, more


def marked(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the spans of the fixed patterns), spans (all), n_added.

    A span is kind:start:end in code points, end exclusive; by kind (email, ip, card, phone, secret), then start. Null and
    empty texts have no spans. Repeated rows get equal results.
    """
    weights = train() if weights is None else weights

    def one(text: str) -> tuple:
        base, more = spans_of(text, weights)
        fixed = [(kind, a, b) for kind in KINDS for a, b in base[kind]]
        spell = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        everything = sorted([*fixed, *more], key=lambda s: (TYPES.index(s[0]), s[1], s[2]))
        return *(len(base[k]) for k in KINDS), hashlib.sha256(spell(fixed).encode()).hexdigest(), spell(everything), len(more)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*map(one, batch.column(1).to_pylist())))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(rows, kinds))],
                                          ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")), run, schema)
