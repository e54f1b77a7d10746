"""Secret scans: fixed patterns, and strings that a primed compressor finds new in a sensitive context.

Base spans are the leftmost non-overlapping matches of three patterns (whole match, code points, end exclusive).
The method adds ``novel`` spans: a run of 16 or more key-like characters with a sensitive word before it on its
line, or within ``REACH`` bytes of it, is a candidate, and so are the runs that continue it and all in a key block. Its novelty is the number of bytes it adds to the zstandard frame of the text
around it, under a dictionary of the identifiers that stand around candidates all over the corpus. A candidate that
stays nearly incompressible is reported. Base spans are never dropped; a run that reaches beyond the base spans in it is
a candidate as a whole, so that no part of a key is left, and one that lies inside them is not repeated.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import as_bytes, mapped_whole, slices

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(rb"[0-9a-f]{16,}")  # runs of 16 or more: a shorter run fails whole

SENSITIVE = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"cred", b"bearer", b"private", b"salt")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}(?:[.:~][A-Za-z0-9+/_=-]+)*")  # a key's further parts may be short
SENSITIVE_WORD = re.compile(b"(?=(" + b"|".join(SENSITIVE) + b"))")
WORD = re.compile(rb"[A-Za-z0-9]")
BLOCK = re.compile(rb"-----BEGIN ([A-Z0-9 ]+)-----(.*?)(?=-----END |-----BEGIN |\Z)", re.S)
TAIL = re.compile(rb"\s([A-Za-z0-9+/=]{1,15})\s*\Z")
IDENTIFIER = re.compile(rb"[A-Za-z_][A-Za-z0-9_]{2,23}")
REACH = 48
AROUND = 96
#: The dictionary holds at most so many identifiers, so its size has a bound of 25 times as many bytes.
DICTIONARY_WORDS = 2000
LEAST_NOVELTY = 0.6
LEAST_JUDGED = 8

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: bytes) -> list[Span]:
    """Base spans in bytes, by start and kind."""
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _key_like(run: bytes) -> bool:
    """Digits beside letters, or letters that change case more than a name does."""
    digits, letters = any(48 <= c < 58 for c in run), run.translate(None, b"0123456789+/_=-")
    changes = sum(a.islower() and b.isupper() for a, b in zip(letters.decode(), letters.decode()[1:]))
    return (digits and bool(letters)) or changes >= 3


def _blocks(text: bytes) -> list[tuple[int, int]]:
    """Bodies of BEGIN/END blocks whose label has a sensitive word; one without an end runs to the text's end."""
    if b"-----BEGIN " not in text:
        return []
    return [m.span(2) for m in BLOCK.finditer(text) if any(word in m[1].lower() for word in SENSITIVE)]


def _beyond(text: bytes, start: int, end: int, inside: list[Span]) -> int | None:
    """Where a run's candidate begins if it holds letters or digits outside the base spans in it, else None. A name before
    an assigned word is no part of a key."""
    first, at = start, start
    for s, kind, e in inside:
        if s > at and kind == 0 and at == start:
            first = s
        elif s > at and WORD.search(text, at, s):
            return first
        at = max(at, e)
    return first if at < end and WORD.search(text, at, end) else None


def candidates(text: bytes, base: list[Span]) -> list[tuple[int, int]]:
    """Key-like runs beside a sensitive word: before the run on its line, or within REACH bytes before or after it.

    The context holds for a whole BEGIN/END block, and is carried on over runs with no letter or digit between them. An
    access key is a context by itself.
    """
    low = text.lower()
    if not any(word in low for word in SENSITIVE) and not any(kind == 1 for _, kind, _ in base):
        return []
    blocks = _blocks(text)
    # The last line of a block may be short.
    tails = [m.span(1) for s, e in blocks if (m := TAIL.search(text, max(s, e - REACH), e))]
    runs = sorted([(*m.span(), True) for m in CANDIDATE.finditer(text)] + [(s, e, False) for s, e in tails])
    words = [m.span(1) for m in SENSITIVE_WORD.finditer(low)] if runs else []
    starts, ends = [s for s, _ in words], sorted(e for _, e in words)
    found, k, block, line, before, carried = [], 0, 0, 0, 0, False
    for start, end, long in runs:
        while k < len(base) and base[k][2] <= start:
            k += 1
        while block < len(blocks) and blocks[block][1] <= start:
            block += 1
        line = max(line, text.rfind(b"\n", before, start) + 1)
        near = carried and not WORD.search(text, before, start)
        near = near or (block < len(blocks) and blocks[block][0] <= start)
        at = bisect_right(ends, start) - 1
        near = near or (at >= 0 and ends[at] > min(line, start - REACH))
        at = bisect_left(starts, end)
        near = near or (at < len(starts) and starts[at] < end + REACH)
        inside, i = [], k
        while i < len(base) and base[i][0] < end:
            inside += [base[i]] if base[i][2] > start else []
            i += 1
        near = near or any(kind == 1 for _, kind, _ in inside)
        first = _beyond(text, start, end, inside) if inside else start
        if near and first is not None and (_key_like(text[first:end]) or not long):
            found.append((first, end))
        carried, before = near or bool(inside), end
    return found


def _around(text: bytes, span: tuple[int, int]) -> tuple[bytes, bytes]:
    return text[max(0, span[0] - AROUND) : span[0]], text[span[1] : span[1] + AROUND]


def identifier_dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> bytes:
    """The identifiers that most often stand around candidates or base spans in the whole corpus, the commonest last."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for part in slices([batch]):
                for text in as_bytes(part.column(0)):
                    base = base_spans(text)
                    keys = candidates(text, base)
                    # What stands around a base span inside a candidate is a part of the key.
                    apart = [(s, e) for s, _, e in base if not any(a <= s and e <= b for a, b in keys)] if keys else [(s, e) for s, _, e in base]
                    for span in apart + keys:
                        n.update(set(IDENTIFIER.findall(b" ".join(_around(text, span)))))
            yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in n], "n": list(n.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    words = docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(most).collect()
    return b" ".join(r.word.encode() for r in reversed(top))


class Novelty:
    """Marginal compressed bytes under a dictionary."""

    def __init__(self, dictionary: bytes):
        primed = {"dict_data": zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(dictionary) >= 8 else {}
        self.compress = zstandard.ZstdCompressor(level=9, write_content_size=False, write_dict_id=False, **primed).compress

    def __call__(self, text: bytes, span: tuple[int, int]) -> float:
        """Bytes added by the span for each of its own."""
        before, after = _around(text, span)
        return (len(self.compress(before + text[slice(*span)] + after)) - len(self.compress(before + after))) / (span[1] - span[0])


def _remainder(start: int, end: int, kinds: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The parts of a candidate outside the base spans in it, given by kind; none where it holds no base span."""
    inside = []
    for of in kinds:  # spans of a kind don't overlap
        at = max(0, bisect_left(of, (start, 0)) - 1)
        while at < len(of) and of[at][0] < end:
            inside += [of[at]] if of[at][1] > start else []
            at += 1
    inside.sort()
    cuts = [start, *(x for span in inside for x in span), end]
    return [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if a < b] if inside else []


def spans(text: bytes, novelty: Novelty) -> list[Span]:
    """Base spans, and candidates that are novel by themselves or, inside a block, together with the run before them. One
    that holds a base span is novel too where a part outside it is, or where all such parts are too short to be judged."""
    base = base_spans(text)
    found, blocks = candidates(text, base), _blocks(text)
    novel, kinds = [], [[(s, e) for s, k, e in base if k == kind] for kind in range(3)] if found and base else []
    for i, (s, e) in enumerate(found):
        new = novelty(text, (s, e)) >= LEAST_NOVELTY
        if not new and base and (rest := _remainder(s, e, kinds)):
            long = [part for part in rest if part[1] - part[0] >= LEAST_JUDGED]
            new = not long or any(novelty(text, part) >= LEAST_NOVELTY for part in long)
        if not new and i and any(x <= found[i - 1][0] and e <= y for x, y in blocks):
            new = novelty(text, (found[i - 1][0], e)) >= LEAST_NOVELTY
        if new:
            novel.append((s, 3, e))
    return sorted(base + novel)


def in_code_points(text: bytes, found: list[Span]) -> list[Span]:
    if not found or text.isascii():
        return found
    at, chars, place = 0, 0, {}
    for cut in sorted({x for s, _, e in found for x in (s, e)}):
        chars += len(text[at:cut].decode("utf-8", "replace"))
        at, place[cut] = cut, chars
    return [(place[s], k, place[e]) for s, k, e in found]


def _digest(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


REPORT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with counts of spans by kind, the digest of the base spans, and all spans.

    A null text counts as empty and has no spans; a null doc_id stays null; repeated rows are reported each.
    """
    dictionary = identifier_dictionary(docs)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for part in slices(batches):
            rows = []
            for text in as_bytes(part.column("text")):
                found = in_code_points(text, spans(text, novelty))
                base = _digest([x for x in found if x[1] < 3])
                n = Counter(k for _, k, _ in found)
                rows.append((*(n[k] for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), _digest(found)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, REPORT.field(i + 1).type) for i, c in enumerate(zip(*rows)))], schema=REPORT)

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(report, f"doc_id long, {kinds}, base_sha256 string, spans string")


def masked(text: bytes, found: list[Span], mask: bytes = b"<secret>") -> bytes:
    """The text with each stretch that spans cover replaced by the mask."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return b"".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text``, and ``n_chars``, where there is such a column, counted anew for the
    rows that changed. Other rows and columns pass through; a null text stays null."""
    dictionary = identifier_dictionary(docs)
    counts = dict(docs.dtypes).get("n_chars") in ("bigint", "int")
    at = docs.columns.index("text")
    n_at = docs.columns.index("n_chars") if counts else -1

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for part in slices(batches):
            column = part.column(at)
            found = [spans(text, novelty) for text in as_bytes(column)]
            if any(found):
                new = [masked(t, f) if f else t for t, f in zip(column.cast(pa.binary()).to_pylist(), found)]
                part = part.set_column(at, part.schema.field(at), pa.array(new, pa.binary()).cast(column.type))
                if counts:
                    n = [len(t.decode("utf-8", "replace")) if f else old for t, f, old in zip(new, found, part.column(n_at).to_pylist())]
                    part = part.set_column(n_at, part.schema.field(n_at), pa.array(n, part.schema.field(n_at).type))
            yield part

    return mapped_whole(docs, rewritten)
