"""Quality rules: a table of thresholds compiled into Spark projections, without user functions.

Every measure is a built-in column expression over one row, so the scan is the only stage. Rules are data:
``(name, measure, least, most)``; ``verdict`` turns the table into one boolean expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import BLANKS, split_words, text_or_empty

# Frequent function words of English, French, German and Spanish, as they stand inside a sentence.
STOP_WORDS = ("the of and to in is that for with was be at by from this or on as it an he are not "
              "le la les de des du et un une en est que qui pour dans par sur pas au ce il avec plus "
              "der die das und zu den von mit ist im auf nicht ein eine des dem für sich auch als "
              "el los las y del que un una por con para se su no es lo como más al").split()

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A text passes while ``least <= measure <= most``; a bound of None is open."""
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


# Base rules fix what must go; the others are the verdict of this module. Measures are SQL over the columns of `measured`.
BASE_RULES = (
    Rule("words", "n_words", least=10),
    Rule("repeated words", "100 * n_repeat_words - 20 * n_words", most=0),
)
RULES = (
    Rule("mean word length", "word_chars / greatest(n_words, 1)", 2.0, 14.0),
    Rule("symbols per character", "n_symbols / greatest(word_chars, 1)", most=0.10),
    Rule("stop words per word", "n_stop_words / greatest(n_words, 1)", least=0.02),
    Rule("repeated lines per line", "n_dup_lines / greatest(n_lines, 1)", most=0.30),
)


def _window_hashes(hashes: str) -> Column:
    """Hash of each run of WINDOW words, from the hashes of the words."""
    all_at = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(F.col(hashes), i + k) for k in range(1, WINDOW)]))
    return F.slice(all_at, 1, F.greatest(F.size(hashes) - WINDOW + 1, F.lit(0)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as column ``row`` (a struct), and the measures of their texts.

    n_words, word_chars (code points in words), n_symbols, n_lines and n_dup_lines (lines with a word; those equal to
    an earlier one), n_repeat_words (words in 5-word windows that occur twice or more), n_stop_words. Null: empty text.
    """
    t = F.col("__text")
    d = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("__text"))
    d = d.select("row", "__text", split_words(t).alias("__words"),
                 F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"))
    d = d.select(
        "row", "__words", F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"))
    # the hashes of the words are there already, and a set of longs is quicker to look into than one of strings
    stops = [xxhash.xxh64_intdigest(w, 42) for w in sorted(set(STOP_WORDS))]
    stops = [h - (h >> 63 << 64) for h in stops]
    d = d.withColumn("n_stop_words", F.size(F.filter("__hashes", lambda h: h.isin(*stops))).cast("long"))
    done = ["row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    d = d.select(*done, "__words", _window_hashes("__hashes").alias("__windows"))
    # Only texts with two equal window hashes go on to the exact comparison; neighbours in hash order are compared word by word.
    in_order = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select(*done, "__words", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), in_order).otherwise(none).alias("__order"))

    def same(a: Column, b: Column) -> Column:
        equal = (a["h"] == b["h"]) & (F.slice("__words", a["i"] + 1, WINDOW) == F.slice("__words", b["i"] + 1, WINDOW))
        return F.coalesce(equal, F.lit(False))

    twice = F.filter("__order", lambda x, k: same(x, F.get(F.col("__order"), k - 1)) | same(x, F.get(F.col("__order"), k + 1)))
    d = d.select(*done, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__starts"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("__starts", start,
                          lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
                          lambda a: a["n"].cast("long"))
    return d.select(*done, covered.alias("n_repeat_words"))


def passes(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression for a table of rules."""
    sides = [f"({r.measure}) {op} {bound!r}D" for r in rules for op, bound in ((">=", r.least), ("<=", r.most)) if bound is not None]
    return F.expr(" AND ".join(sides) or "true")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, text: str = "text") -> DataFrame:
    """``measured`` with base_failed and kept (false if a base rule failed, else whether all ``rules`` hold)."""
    # The partition id makes no difference to the value, but keeps filters above the measures: pushed below them, a filter
    # would repeat every measure in itself, level by level, and the plan would grow without end.
    here = F.spark_partition_id() >= 0
    failed = ~passes(base)
    return measured(docs, text).select("*", (failed & here).alias("base_failed"), (~failed & passes(rules) & here).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return judged(docs, rules, base, text).where("kept").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the measures, base_failed, kept."""
    return judged(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept")


_NUMBERS = "([0-9.]+)D"


def oracle_sql() -> str:
    """The report as DuckDB SQL, from the same tables of rules."""
    import re
    words = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    plain = {k: re.sub(_NUMBERS, r"\1", " AND ".join(f"({r.measure}) {op} {b!r}" for r in rs for op, b in ((">=", r.least), ("<=", r.most)) if b is not None))
             for k, rs in (("base", BASE_RULES), ("own", RULES))}
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{BLANKS}+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
    p AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + {WINDOW - 1}]) AS c FROM p),
    r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(0, {WINDOW}) o(k) WHERE c >= 2 GROUP BY doc_id),
    m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
                 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
                 CAST(len(list_filter(ws, lambda x: x IN ({words}))) AS BIGINT) AS n_stop_words
          FROM w LEFT JOIN r ON r.doc_id IS NOT DISTINCT FROM w.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
           NOT ({plain['base']}) AS base_failed, ({plain['base']}) AND ({plain['own']}) AS kept FROM m"""
