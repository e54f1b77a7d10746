"""Numbers in texts as rows: where each one stands, which are covered, and texts rebuilt from what may stay.

A text is cut into numbers and the pieces between them; places are running lengths over those rows, in characters from
0, ends exclusive. Ranges (links, dates, verified numbers) and numbers meet in one ordered pass over each text's rows, and
a text is put together again from its rows. Every ``texts`` is ``(id, text)`` with one row for each id; a null text is
empty, and so a null id's is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strideframe.functions import constants as C

# The forms of a number, of a chain of numbers, and of what holds numbers that are no measurements.
NUMBER = r"\d+(?:\.\d+)?"
PHRASE = r"-?\d+(?:\.\d+)?(?:\s*[-–—]\s*\d+(?:\.\d+)?)*"
PLAIN = r"https?://[^\s)>\]]+|\d{4}-\d{2}-\d{2}|\d+\s*x\s*\d+"
#: A number with commas between thousands, which is one figure.
FIGURE = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
UNIT = rf"(?:(?:{'|'.join(C.PLAIN_UNITS)})(?![A-Za-z])|%)"
DASH = "[-–—]"


def _in_text(so_far: bool = False) -> WindowSpec:
    rows = Window.partitionBy("id").orderBy("n")
    return rows.rowsBetween(Window.unboundedPreceding, Window.currentRow) if so_far else rows


def _any_script(pattern: str) -> str:
    return "(?iU)" + pattern


def pieces(texts: DataFrame, pattern: str) -> DataFrame:
    """``(id, n, before, match, start, end, after)``: each match of ``pattern``, which matches no empty text, with the pieces
    around it; the last row of a text has its last piece and no match."""
    t, p = F.coalesce("text", F.lit("")), _any_script(pattern)
    both = F.arrays_zip(F.split(t, p, -1).alias("before"), F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("match"))
    rows = texts.select("id", F.posexplode(both).alias("n", "p")).select("id", "n", "p.before", "p.match")
    length = F.coalesce(F.length("match"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.length("before") + length).over(_in_text(True))).withColumn("after", F.lead("before").over(_in_text()))
    return rows.select("id", "n", "before", "match", (F.col("end") - length).alias("start"), "end", "after")


def plain_context(before: Column, after: Column) -> Column:
    """A unit of time or road or a per cent sign is attached, or the last word before counts parts of a plan."""
    word = F.lower(F.regexp_extract(before, r"(?U)([A-Za-z]+)\W*$", 1))
    return F.coalesce(after, F.lit("")).rlike(f"(?iU)^{UNIT}") | word.isin(*C.STRUCTURE_WORDS)


def judged(texts: DataFrame, covers: DataFrame) -> DataFrame:
    """``(id, n, before, match, start, end, after, open)``: the chains of numbers of each text and whether they are open.

    A chain is closed if it begins inside a link, a date or an interval like 4x8, stands in a plain context, or has each of
    its numbers, without the sign, inside one of the text's ranges ``covers(id, start, end)``. The last row of a text is
    closed.
    """
    dealt = texts.select("id", "text").repartition("id")
    chains = pieces(dealt, PHRASE)
    kinds = [
        pieces(dealt, PLAIN).where("match IS NOT NULL").select("id", "start", F.lit(0).alias("kind"), "end"),
        covers.select("id", F.col("start").cast("long").alias("start"), F.lit(1).alias("kind"), F.col("end").cast("long").alias("end")),
        pieces(dealt, NUMBER).where("match IS NOT NULL").select("id", "start", F.lit(3).alias("kind"), "end"),
    ]
    events = chains.withColumn("kind", F.lit(2))
    for rows in kinds:
        events = events.unionByName(rows, allowMissingColumns=True)
    swept = Window.partitionBy("id").orderBy("start", "kind", F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A number's sign stands before it and belongs to the chain, so a chain comes before its first number.
    reach = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("end"))).over(swept)
    events = events.withColumns({"plain_to": reach(0), "covered_to": reach(1), "chain": F.max(F.when(F.col("kind") == 2, F.col("n"))).over(swept)})
    row = F.struct("before", "match", "start", "end", "after", (F.coalesce(F.col("plain_to") > F.col("start"), F.lit(False)) | plain_context(F.col("before"), F.col("after"))).alias("plain"))
    covered = F.coalesce(F.col("covered_to") >= F.col("end"), F.lit(False))
    found = events.where("kind >= 2").groupBy("id", F.col("chain").alias("n")).agg(F.max(F.when(F.col("kind") == 2, row)).alias("r"), F.min(F.when(F.col("kind") == 3, covered)).alias("covered"))
    live = F.col("r.match").isNotNull() & ~F.col("r.plain") & ~F.coalesce("covered", F.lit(False))
    return found.select("id", "n", "r.before", "r.match", "r.start", "r.end", "r.after", live.alias("open"))


def _without_unit(piece: Column) -> Column:
    return F.regexp_replace(piece, rf"(?iU)^\s*{UNIT}", "")


def _without_dash(piece: Column, first: Column) -> Column:
    at_start = F.regexp_replace(piece, rf"(?U)(^|(?<=\s)){DASH}\s*$", "")
    return F.when(first, at_start).otherwise(F.regexp_replace(piece, rf"(?U)(?<=\s){DASH}\s*$", ""))


def swept_texts(texts: DataFrame, covers: DataFrame) -> DataFrame:
    """``(id, text, n_removed)``: texts without their open chains of numbers.

    A dash that led to a removed chain and a unit behind it go too. Where something goes, white space is collapsed over the
    whole text, and none stays before a mark or at the ends; other texts stay as they are.
    """
    rows = judged(texts, covers)
    gone_before = F.coalesce(F.lag("open").over(_in_text()), F.lit(False))
    piece = F.when(gone_before, _without_unit(F.col("before"))).otherwise(F.col("before"))
    piece = F.when(F.col("open"), _without_dash(piece, F.col("n") == 0)).otherwise(piece)
    rows = rows.select("id", "n", F.concat(piece, F.when(F.col("open"), "").otherwise(F.coalesce("match", F.lit("")))).alias("part"), "open")
    whole = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("parts"), F.count_if("open").alias("n_removed"))
    text = F.array_join("parts.part", "")
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)\s{2,}", " "), r"(?U)\s+([.,;:!?])", "$1"), r"(?U)^\s+|\s+$", "")
    return whole.select("id", F.when(F.col("n_removed") > 0, tidy).otherwise(text).alias("text"), "n_removed")


def whole_figures(texts: DataFrame) -> DataFrame:
    """The pieces of each text that have a figure with no digits and no dot right before it, and none that go on behind it."""
    # A dot may end a sentence, but not lead to another figure; a line's end behind a dot parts it from the figure.
    touches = F.col("before").rlike(r"\.\z") | ((F.col("before") == "") & (F.col("n") > 0)) | (F.col("after").isin("", ".") & F.lead("match").over(_in_text()).isNotNull())
    return pieces(texts, FIGURE).withColumn("touches", touches).where("match IS NOT NULL AND NOT touches").drop("touches")


def placed_claims(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """``(id, claim, value, start, end)``: the place in its text of the figure of each of ``claims(id, claim, said, value)``;
    claims without a place have no row.

    A claim's figure is the first in ``said``, or all of it. Places are where the text has this figure and no longer one.
    Those inside an occurrence of ``said`` come first, then the others, and a claim takes its first place that none of a
    smaller number has taken. A claim that says nothing but its figure takes a place only while there is one alone.
    """
    figure = F.regexp_extract("said", _any_script(FIGURE), 0)
    asked = claims.select("id", "claim", "said", "value", F.when(figure == "", F.col("said")).otherwise(figure).alias("figure")).where("figure <> ''")
    dealt = texts.select("id", "text").repartition("id")
    # One list for each figure of a text, no longer than the text.
    places = whole_figures(dealt).groupBy("id", F.col("match").alias("figure")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("places"))
    says = asked.join(dealt, "id").select("id", "claim", "value", "figure", "said", _occurrences(F.col("text"), F.col("said")).alias("spans"))
    met = says.join(places, ["id", "figure"])
    inside = F.filter("places", lambda p: F.exists("spans", lambda s: (s["start"] <= p["start"]) & (p["end"] <= s["end"])))
    alone = F.col("said") == F.col("figure")
    wishes = F.struct("claim", "value", alone.alias("alone"), F.when(alone, F.col("places")).otherwise(F.array_union(inside, F.col("places"))).alias("wishes"))
    turns = met.groupBy("id", "figure").agg(F.array_sort(F.collect_list(wishes)).alias("turns"))

    def take(state: Column, turn: Column) -> Column:
        free = F.filter(turn["wishes"], lambda p: ~F.exists(state, lambda s: s["at"] == p))
        chosen = F.when((F.size(free) > 0) & ~(turn["alone"] & (F.size(free) > 1)), F.array(F.struct(turn["claim"].alias("claim"), turn["value"].alias("value"), F.element_at(free, 1).alias("at")))).otherwise(F.array())
        return F.concat(state, chosen.cast(state_type))

    kinds = dict(claims.dtypes)
    state_type = f"array<struct<claim: {kinds['claim']}, value: {kinds['value']}, at: struct<start: bigint, end: bigint>>>"
    taken = turns.select("id", F.explode(F.aggregate("turns", F.array().cast(state_type), take)).alias("t"))
    return taken.select("id", "t.claim", "t.value", "t.at.start", "t.at.end")


def _occurrences(text: Column, said: Column) -> Column:
    """Spans of the places where a text has ``said``, one after the other."""
    cut = F.split(F.coalesce(text, F.lit("")), F.concat(F.lit("\\Q"), F.replace(said, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    lengths = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda p: F.length(p).cast("long"))
    n = F.length(said).cast("long")
    add = lambda done, p: F.struct((done["at"] + p + n).alias("at"), F.concat(done["spans"], F.array(F.struct((done["at"] + p).alias("start"), (done["at"] + p + n).alias("end")))).alias("spans"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))
    return F.when(F.length(said) > 0, F.aggregate(lengths, none, add)["spans"]).otherwise(none["spans"])


def restated_texts(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """``(id, text, covered array<struct<start, end>>)``: each placed claim's figure replaced by its value, and the ranges of
    the values in the new text.

    A null or empty value removes the figure with its unit, closes the seam, and covers nothing. A signed value takes the
    place of a minus before the figure that doesn't join it to another number.
    """
    dealt = texts.select("id", "text").repartition("id")
    placed = placed_claims(texts, claims).select("id", F.col("start").alias("p_start"), F.coalesce("value", F.lit("")).alias("value"))
    cut = pieces(dealt, FIGURE)
    rows = cut.join(placed, (cut["id"] == placed["id"]) & (cut["start"] == placed["p_start"]), "left").select(cut["id"], "n", "before", "match", "value")
    gone = F.coalesce(F.col("value") == "", F.lit(False))
    rows = rows.withColumns({"gone": gone, "gone_before": F.coalesce(F.lag(gone).over(_in_text()), F.lit(False)), "more": F.lead("before").over(_in_text())})
    signed = F.col("value").rlike("^-") & F.col("before").rlike(rf"{DASH}\z") & ~((F.length("before") == 1) & (F.col("n") > 0))
    piece = F.when(F.col("gone_before"), F.regexp_replace(_without_unit(F.col("before")), r"(?U)^\s+", "")).otherwise(F.col("before"))
    piece = F.when(F.col("gone"), F.regexp_replace(_without_dash(piece, F.col("n") == 0), r"(?U)\s+$", "")).when(signed, F.regexp_replace(piece, rf"{DASH}\z", "")).otherwise(piece)
    behind = _without_unit(F.coalesce("more", F.lit("")))
    apart = F.col("before").rlike(r"(?U)\s$") | behind.rlike(r"(?U)^\s")
    at_edge = ((F.col("n") == 0) & (F.trim("before") == "")) | (F.trim(behind) == "") & F.col("last") | behind.rlike(r"(?U)^\s*[.,;:!?]")
    rows = rows.withColumn("last", F.lead("match").over(_in_text()).isNull())
    said = F.when(F.col("gone"), F.when(apart & ~at_edge, " ").otherwise("")).otherwise(F.coalesce("value", "match", F.lit("")))
    rows = rows.select("id", "n", piece.alias("piece"), said.alias("said"), (F.col("value").isNotNull() & ~F.col("gone")).alias("stated"))
    upto = F.sum(F.length("piece") + F.length("said")).over(_in_text(True))
    rows = rows.withColumn("end", upto).withColumn("start", F.col("end") - F.length("said"))
    out = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat("piece", "said").alias("part")))).alias("parts"), F.array_sort(F.collect_list(F.when(F.col("stated"), F.struct("start", "end")))).alias("covered"))
    return out.select("id", F.array_join("parts.part", "").alias("text"), "covered")
