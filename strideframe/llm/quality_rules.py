"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a sample of the input; the rules then run in descending order
of rejections per second, and a document leaves the cascade at the first rule that rejects it. The order changes what
is computed, never the verdict.

Words are maximal runs of bytes other than ASCII white space (space, tab to carriage return).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import as_bytes, mapped_whole, slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
SAMPLE_FRACTION = 0.01


class Measures:
    """Counts of one text, each made when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [line for line in self.text.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(set(windows)) == len(windows):
            return 0
        often = Counter(windows)
        total, covered = 0, 0  # words up to `covered` are counted
        for start, window in enumerate(windows):
            if often[window] > 1:
                total += start + WINDOW - max(start, covered)
                covered = start + WINDOW
        return total

    @cached_property
    def n_upper(self) -> int:
        return len(self.text) - len(self.text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def n_lower(self) -> int:
        return len(self.text) - len(self.text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))


def too_short(m: Measures) -> bool:
    return m.n_words < 10


def repeats_itself(m: Measures) -> bool:
    return 100 * m.n_repeat_words > 20 * m.n_words


def symbols_for_words(m: Measures) -> bool:
    return 4 * m.n_symbols > max(1, m.n_words)


def repeated_lines(m: Measures) -> bool:
    return 2 * m.n_dup_lines > len(m.lines)


def odd_word_length(m: Measures) -> bool:
    return not 2 * m.n_words <= m.word_chars <= 30 * m.n_words


def shouting(m: Measures) -> bool:
    return m.n_upper > 2 * m.n_lower and m.n_upper > 20


Rule = Callable[[Measures], bool]

#: name -> rule; a rule is true for a document that it rejects.
RULES: dict[str, Rule] = {
    "too_short": too_short,
    "repeats_itself": repeats_itself,
    "symbols_for_words": symbols_for_words,
    "repeated_lines": repeated_lines,
    "odd_word_length": odd_word_length,
    "shouting": shouting,
}
BASE_RULES = ("too_short", "repeats_itself")


def rule_statistics(docs: DataFrame, rules: dict[str, Rule] | None = None, fraction: float = SAMPLE_FRACTION, seed: int = 11) -> list[tuple[str, int, int, float]]:
    """(rule, documents, rejected, seconds) over a Bernoulli sample, summed on the executors: as many rows as rules."""
    rules = rules or RULES

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rejected, spent = 0, Counter(), Counter()
        for part in slices(batches):
            for text in as_bytes(part.column(0)):
                n += 1
                for name, rule in rules.items():  # each rule with measures of its own, so that its full cost counts
                    began = time.perf_counter()
                    rejected[name] += rule(Measures(text))
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "n": [n] * len(rules), "rejected": [rejected[x] for x in rules], "seconds": [float(spent[x]) for x in rules]})

    rows = docs.select("text").sample(fraction, seed).mapInArrow(measured, "rule string, n long, rejected long, seconds double")
    return [tuple(r) for r in rows.groupBy("rule").agg(F.sum("n"), F.sum("rejected"), F.sum("seconds")).collect()]


def cascade_order(statistics: list[tuple[str, int, int, float]], rules: dict[str, Rule] | None = None) -> list[str]:
    """Rules by rejections per second, best first; a rule without figures keeps its listed place after the others."""
    listed = list(rules or RULES)
    rate = {name: rejected / max(seconds, 1e-9) for name, n, rejected, seconds in statistics if n}
    return sorted(listed, key=lambda name: (-rate.get(name, -1.0), listed.index(name)))


def _run(order: list[str], rules: dict[str, Rule], m: Measures) -> str | None:
    return next((name for name in order if rules[name](m)), None)


def quality_cascade(docs: DataFrame, rules: dict[str, Rule] | None = None, fraction: float = SAMPLE_FRACTION) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    A null or empty text has no words and is rejected as too short; repeated rows are judged each by itself; an empty
    table gives an empty table. Columns other than ``text`` pass through untouched, whatever their names.
    """
    rules = rules or RULES
    order = cascade_order(rule_statistics(docs, rules, fraction), rules)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            stays = [_run(order, rules, Measures(text)) is None for text in as_bytes(part.column(at))]
            yield part.filter(pa.array(stays, pa.bool_()))

    return mapped_whole(docs, kept)


DIGEST = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_report(docs: DataFrame, rules: dict[str, Rule] | None = None, fraction: float = SAMPLE_FRACTION) -> DataFrame:
    """One row per row of ``docs``: its counts, whether a base rule rejects it, and the cascade's verdict.

    Null and empty texts have zero of everything and fail; a null doc_id stays null.
    """
    rules = rules or RULES
    order = cascade_order(rule_statistics(docs, rules, fraction), rules)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in as_bytes(part.column("text")):
                m = Measures(text)
                verdict = _run(order, rules, m)
                base = too_short(m) or repeats_itself(m)
                rows.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, base, verdict is None))
            columns = [part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]), *(pa.array(c, pa.bool_()) for c in list(zip(*rows))[5:])]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(report, DIGEST)
