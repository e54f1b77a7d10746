"""Checking of texts against computed values: numbers, links, constraints, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.functions.scalars import display

NUMBER = r"^[(\[\"']*(-?[0-9]+(?:[.][0-9]+)?)[.,;:!?)\]\"']*$"
BLANK = r"[\t\n\x0B\f\r ]+"
LINK = r"https?://[^\s<>\"')\]]+"
SENTENCE = r"(?<=[.!?])\s+|\n+"
NEGATION_REACH = 4


def close(a: Column, b: Column, relative: float = C.CLAIM_RELATIVE, absolute: float = C.CLAIM_ABSOLUTE) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def numbers(texts: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, place, token, value)``: every word outside links that is a number, but for brackets, quotes and marks
    around it; place counts words from 0."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), LINK, " ")
    words = texts.select(ident, F.posexplode(F.split(bare, BLANK)).alias("place", "word")).withColumn("token", F.regexp_extract("word", NUMBER, 1))
    return words.where("token <> ''").select(ident, F.col("place").cast("long").alias("place"), "token", F.col("token").cast("double").alias("value"))


def normal_link(url: Column) -> Column:
    """A link as it is compared: without white space around it and slashes at its end, what stands before the path in lower
    case. Ports, queries and fragments count, so that doubtful links are unequal."""
    bare = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(bare, "/+$", "")
    head = F.regexp_extract(bare, "(?s)^(.*?://[^/]*|[^/]*(?:/(?!/)[^/]*)*)", 1)
    with_path = F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))
    return F.when(F.contains(bare, F.lit("://")), with_path).otherwise(F.lower(bare))


def allowed_link(url: Column, hosts: Sequence[str]) -> Column:
    """A link over https to exactly one of the hosts, whatever its port, user, query and fragment."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(url)), r"^https://(?:[^/?#]*@)?([^/?#:@]*)", 1).isin(*hosts), F.lit(False))


def verify_numbers(claims: DataFrame) -> DataFrame:
    """Adds ``verdict`` and ``rewritten`` to claims ``(value, prescriptive, echo, canonical)``.

    Without a value: ungrounded. A prescriptive claim may only echo the request. Without a canonical value: an echo, or
    ungrounded. Within tolerance: grounded, else contradicted; both are rewritten to the canonical value as it is shown.
    """
    echo = F.coalesce(F.col("echo"), F.lit(False))
    or_echo = F.when(echo, "echo").otherwise("ungrounded")
    known = F.col("canonical").isNotNull()
    verdict = (
        F.when(F.col("value").isNull(), "ungrounded").when(F.coalesce("prescriptive", F.lit(False)), or_echo).when(~known, or_echo)
        .when(close(F.col("value"), F.col("canonical")), "grounded").otherwise("contradicted")
    )
    return claims.withColumn("verdict", verdict).withColumn("rewritten", F.when(F.col("verdict").isin("grounded", "contradicted"), display(F.col("canonical"))))


def decision(claims: DataFrame, on: Sequence[str]) -> DataFrame:
    """What to do with each answer: any contradiction regenerates; nothing publishable replans where a number is missing and
    abstains otherwise; an ungrounded claim beside grounded ones regenerates; else proceed."""
    is_ = lambda v: F.col("verdict") == v
    sums = claims.groupBy(*on).agg(F.bool_or(is_("contradicted")).alias("bad"), F.bool_or(is_("grounded") | is_("echo")).alias("good"), F.bool_or(is_("ungrounded")).alias("open"), F.bool_or(is_("ungrounded") & F.col("value").isNotNull() & ~F.col("prescriptive")).alias("gap"), F.count(F.lit(1)).alias("n"))
    what = F.when(F.col("bad"), "regenerate").when(~F.col("good"), F.when(F.col("gap"), "replan").otherwise("abstain")).when(F.col("open"), "regenerate").otherwise("proceed")
    return sums.select(*on, what.alias("decision"), "n")


def sentences(texts: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, place, sentence)``: parts between sentence ends or line breaks that aren't blank."""
    cut = texts.select(ident, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE)).alias("place", "sentence"))
    return cut.where(F.trim("sentence") != "").select(ident, F.col("place").cast("long").alias("place"), "sentence")


def constraint_gate(texts: DataFrame, ident: str, text: str, hard: Sequence[str], soft: Sequence[str], negations: Sequence[str]) -> DataFrame:
    """``(ident, place, action)`` of every sentence that names a constrained word: ``remove`` for a hard one, ``caution`` for a
    soft one; a word with a negation among the four words before or after it doesn't count."""
    words = F.filter(F.split(F.lower("sentence"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = sentences(texts, ident, text).withColumn("w", words)

    def named(vocabulary: Sequence[str]) -> Column:
        near = F.expr(f"exists(sequence(0, size(w) - 1), i -> array_contains(array({', '.join(repr(v) for v in vocabulary)}), w[i]) and not arrays_overlap(slice(w, greatest(i + 1 - {NEGATION_REACH}, 1), {2 * NEGATION_REACH + 1} - greatest({NEGATION_REACH} - i, 0)), array({', '.join(repr(v) for v in negations)})))")
        return (F.size("w") > 0) & near

    action = F.when(named(hard), "remove").when(named(soft), "caution")
    return rows.withColumn("action", action).where("action IS NOT NULL").select(ident, "place", "action")
