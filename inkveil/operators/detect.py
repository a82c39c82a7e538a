"""Detection, replacement and re-verification, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import Pattern
from ..functions.checks import CHECKS, blocks, line_of, min_digits, occurrences, squeeze, strip
from ..functions.config import Config

MATCHES = "array<struct<category:string,matched:string>>"
_HITS = "array<struct<category:string,matched:string,n:int,line:int>>"


def hits(text: Column, p: Pattern) -> Column:
    """What one pattern finds in a text: its group, stripped, not empty, and valid."""
    found = F.transform(F.regexp_extract_all(text, F.lit(p.java), F.lit(p.group)), strip)

    def valid(x: Column) -> Column:
        ok = F.length(x) > 0
        if p.digits:
            ok = ok & min_digits(x, p.digits)
        return ok & CHECKS[p.check](x) if p.check else ok

    return F.filter(found, valid)


def longest_first(matches: Column) -> Column:
    """Stable: equal lengths keep their order."""
    keyed = F.transform(matches, lambda x, i: F.struct((-F.length(x.matched)).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s.x)


def matches(text: Column, config: Config) -> Column:
    """Distinct (category, matched) of a text and of its copy with white space squeezed, longest first.

    Every built-in pattern needs a digit or an @, so texts without either skip
    the scans unless there are custom patterns. Null text: no matches.
    """
    none = F.array().cast(MATCHES)

    def of(p: Pattern, texts: Column, low: Column) -> Column:
        found = F.flatten(F.transform(texts, lambda t: hits(t, p)))
        found = F.transform(found, lambda x: F.struct(F.lit(p.category).alias("category"), x.alias("matched")))
        signs = [F.contains(low, F.lit(s)) for s in p.signs]
        return F.when(reduce(Column.__or__, signs), found).otherwise(none) if signs else found

    def scan(x: Column) -> Column:
        every = F.array_distinct(F.concat(*[of(p, x.texts, x.low) for p in config.patterns])) if config.patterns else none
        if config.exclude:
            every = F.filter(every, lambda x: ~F.greatest(*[F.contains(F.lower(x.matched), F.lit(t)) for t in config.exclude], F.lit(False)))
        return longest_first(every)

    # Letters that ignoring case makes equal to plain ones, but lower() does not.
    low = F.lower(F.translate(text, "ſıİK", "siIk"))
    once = F.struct(F.array_distinct(F.array(text, squeeze(text))).alias("texts"), low.alias("low"))
    found = F.element_at(F.transform(F.array(once), scan), 1)
    custom = any(p.category == "custom" for p in config.patterns)
    worth = text.isNotNull() if custom else F.coalesce(text.rlike(r"(?U)[\d@]"), F.lit(False))
    return F.when(worth, found).otherwise(none)


def detect(units: DataFrame, config: Config, text: str = "text") -> DataFrame:
    """``units`` with a column ``matches``."""
    return units.withColumn("matches", matches(F.col(text), config))


def fold(text: Column, found: Column) -> Column:
    """Replace match after match; struct(text, hits) with the number and first line of each that still occurred.

    Matches are replaced in order in the text as it then is, so one that was
    part of a longer one no longer counts.
    """
    start = F.struct(text.alias("text"), F.array().cast(_HITS).alias("hits"))

    def step(acc: Column, m: Column) -> Column:
        hit = F.struct(m.category.alias("category"), m.matched.alias("matched"), occurrences(acc.text, m.matched).alias("n"), line_of(acc.text, m.matched).alias("line"))
        after = F.struct(F.replace(acc.text, m.matched, blocks(m.matched)).alias("text"), F.concat(acc.hits, F.array(hit)).cast(_HITS).alias("hits"))
        return F.when(F.contains(acc.text, m.matched), after).otherwise(acc)

    return F.aggregate(found, start, step)


def redact(units: DataFrame, config: Config, text: str = "text") -> DataFrame:
    """Adds matches, redacted and hits. Null text stays null."""
    found = detect(units, config, text)
    folded = found.withColumn("_fold", F.when(F.size("matches") > 0, fold(F.col(text), F.col("matches"))))
    return folded.withColumn("redacted", F.coalesce("_fold.text", text)).withColumn("hits", F.coalesce("_fold.hits", F.array().cast(_HITS))).drop("_fold")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of few bytes but much work, dealt out to all cores: a reader makes one task of a small file, or of each of its row groups, and a small shuffle is read as few."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def exploded(rows: DataFrame, *keys: str, **of: str | Column) -> DataFrame:
    """Keys and a row for each element of an array of no nulls, given as name=array.

    Below a plain explode Spark filters on the array's size, before what makes
    the array, and so scans and replaces in every text several times over.
    """
    ((name, array),) = of.items()
    return rows.select(*keys, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def counts(redacted: DataFrame, *keys: str) -> DataFrame:
    """Occurrences replaced, by keys and category."""
    return exploded(redacted, *keys, h="hits").groupBy(*keys, F.col("h.category").alias("category")).agg(F.sum("h.n").alias("n"))


def distinct_counts(found: DataFrame, *keys: str) -> DataFrame:
    """Distinct matches a unit, as spreadsheets count them."""
    return exploded(found, *keys, m="matches").groupBy(*keys, F.col("m.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def verify(redacted: DataFrame, config: Config, *keys: str) -> DataFrame:
    """What the same detectors still find in the output: no rows is a pass."""
    return distinct_counts(redacted.select(*keys, matches(F.col("redacted"), config).alias("matches")), *keys).withColumnRenamed("n", "remaining")


def outcome(remaining: Column, chars: Column) -> Column:
    """Exit code: 3 where matches remain, 2 where there was no text to read, else 0."""
    return F.when(remaining > 0, 3).when(chars == 0, 2).otherwise(0)


def outcomes(units: DataFrame, config: Config, key: str, text: str = "text") -> DataFrame:
    """One row a unit: total replaced, remaining, exit_code."""
    done = redact(units, config, text).select(key, text, "hits", "redacted")
    total = F.aggregate("hits", F.lit(0), lambda s, h: s + h.n)
    left = F.size(matches(F.col("redacted"), config))
    return done.select(key, total.cast("long").alias("total"), left.cast("long").alias("remaining"), F.length(F.trim(F.coalesce(text, F.lit("")))).alias("_chars")).select(key, "total", "remaining", outcome(F.col("remaining"), F.col("_chars")).alias("exit_code"))
