"""Which texts contain or are LIKE which patterns, for whole tables of patterns: postings of three-letter grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(c: Column, size: int | Column) -> Column:
    """Distinct runs of ``size`` characters; none of a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(size)))
    return F.when(F.length(c) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def containing(patterns: DataFrame, texts: DataFrame, pattern: str = "pattern", text: str = "text") -> DataFrame:
    """Pairs (pattern, text), each once, where the text contains the pattern; case counts, empty and NULL patterns meet nothing.

    Every pattern is looked up by its rarest gram (patterns shorter than a gram by themselves), so that only texts with that
    gram are compared, and the plan does not depend on the number of patterns. Both sides are reduced to distinct values
    first. A pattern that most texts contain meets most texts: that is its result.
    """
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    t = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
    postings = t.select("text", F.explode(_postings(F.col("text"))).alias("gram"))
    wanted = p.select("pattern", F.explode(F.when(F.length("pattern") < GRAM, F.array("pattern")).otherwise(_grams(F.col("pattern"), GRAM))).alias("gram"))
    return _by_rarest(wanted, postings).where(F.contains("text", "pattern")).select("pattern", "text")


def matching(patterns: DataFrame, texts: DataFrame, pattern: str = "pattern", text: str = "text") -> DataFrame:
    """Pairs (pattern, text), each once, where the text is LIKE the pattern, ignoring case; NULL patterns and texts meet nothing.

    As ``containing``, by the rarest gram of the letters between wildcards. Shorter grams serve patterns without three letters
    in a row; a pattern of wildcards alone is compared with every text, as its result is every text of some length.
    """
    p = patterns.select(F.col(pattern).alias("pattern")).dropna().distinct()
    t = texts.select(F.col(text).alias("text")).dropna().distinct()
    runs = F.split(F.lower("pattern"), r"\\.|[%_]")
    p = p.withColumn("runs", runs).withColumn("size", F.least(F.array_max(F.transform("runs", F.length)), F.lit(GRAM)))
    wanted = p.select("pattern", F.explode(F.array_distinct(F.flatten(F.transform("runs", lambda r: _grams(r, F.col("size")))))).alias("gram"))
    postings = t.select("text", F.explode(F.concat(F.array(F.lit("")), _postings(F.lower("text")))).alias("gram"))
    return _by_rarest(wanted, postings).where(F.ilike("text", "pattern")).select("pattern", "text")


def _postings(text: Column) -> Column:
    return F.concat(*[_grams(text, n) for n in range(1, GRAM + 1)])


def _by_rarest(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """(pattern, text) that share the gram of ``wanted`` (pattern, gram) that fewest ``postings`` (text, gram) have."""
    used = postings.join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = used.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    return rarest.join(used, "gram")
