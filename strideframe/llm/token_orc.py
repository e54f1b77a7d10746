"""Token ids as ORC files: documents in ascending doc_id order, one row each, in integer run-length encoded stripes.

Texts are dealt by doc_id range, so that each file holds one range in order. A file's rows carry its part number and
the document's offset inside the part; a document starts at the sum of all earlier parts plus that offset. Row indexes
and a Bloom filter on doc_id let a reader skip stripes and row groups by metadata; stripes can be read in parallel.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.llm.common import as_text, scratch, slices, text_portions

END = 0
#: Bytes of text that are encoded at a time, and texts that the library gets at a time.
TEXT_AT_ONCE = 6 << 20
TEXTS_AT_ONCE = 64
#: Units that a worker keeps with their ids, and their longest in bytes.
CACHE = 700_000
LONGEST = 64
#: The characters with the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f"
MARK = "!-&(-/:-@\\[-`{-~"
#: Kinds of the characters below U+4000: all white space and the commonest letters, digits and marks. The others, with the
#: apostrophe, which begins 's and the like, have kind 0.
BLANK = 4
KIND = np.zeros(0x4000, np.uint8)
for _kind, _characters in enumerate((LETTER, "0-9", MARK, WHITE), 1):
    KIND[[c for c in range(len(KIND)) if re.match(f"[{_characters}]", chr(c))]] = _kind
_OF_BYTE = np.r_[KIND[:128], np.zeros(128, np.uint8)]
#: Whether a unit begins between characters of two kinds: where white space begins, and where letters, digits and marks meet.
BEGINS = np.array([b == BLANK != a or 0 < a != b > 0 and BLANK not in (a, b) for a in range(5) for b in range(5)])


def _parts(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the texts within their bytes, and these bytes."""
    borders = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    return borders - borders[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]


def _cut(data: np.ndarray, borders: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders.astype(np.int32, copy=False)), pa.py_buffer(data))


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte's character in UTF-8."""
    kind = _OF_BYTE[data]
    if len(data) and data.max() > 127:
        two, three = np.flatnonzero((data >= 0xC2) & (data < 0xE0)), np.flatnonzero((data >= 0xE0) & (data < 0xE4))
        for at, more, first in ((two, 1, 31), (three, 2, 15)):
            code = data[at].astype(np.int32) & first
            for i in range(1, more + 1):
                code = code << 6 | data[at + i] & 63
            found = KIND[code]
            for i in range(more + 1):
                kind[at + i] = found
    return kind


def _units(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Borders of the units of texts that stand in ``data``.

    White space belongs to the unit of what follows it. The byte-level pre-tokeniser never lets a token cross the border
    between two units, and parts a unit as it parts it in its text: it looks ahead in white space only, which no unit of
    other things ends with.
    """
    kind = _kinds(data)
    begins = np.empty(len(data) + 1, bool)
    begins[1:-1] = BEGINS[kind[:-1] * np.uint8(5) + kind[1:]]
    begins[borders] = True
    return np.flatnonzero(begins).astype(np.int32)


class Encoder:
    """The tokenizers library over a bounded table of units: a repeated unit is encoded once.

    New units are handed to the library side by side: the pre-tokeniser parts them as it parts them in their own texts, and
    every id stands for a known number of bytes, so that the ids fall back to their units. A file with another pre-tokeniser
    has no such units; its texts are encoded whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        #: The library finds these strings in a whole text, before units; a text that holds one is encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.in_units = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and parts["normalizer"] is None and parts["model"]["type"] == "BPE" and not any(re.search(f"[{WHITE}]", a) for a in self.added)
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a character of the byte alphabet is a byte
        #: Units, their ids and how often they were met; what was met earlier counts half as much with each portion of text.
        self.known, self.ids, self.weight = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())), np.zeros(0, np.float32)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self._by_library(texts)]

    def _by_library(self, texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + TEXTS_AT_ONCE], add_special_tokens=False))

    def ids_of(self, units: Iterable[str]) -> pa.ListArray:
        """Ids of distinct units, by the library."""
        units = pa.array(units, pa.string())
        borders, data = _parts(units)
        kind = _kinds(data)
        first, last = kind[borders[:-1]] == BLANK, kind[borders[1:] - 1] == BLANK
        spaced, bare, blank = np.flatnonzero(first & ~last), np.flatnonzero(~first), np.flatnonzero(last)
        # A unit without white space of its own follows a line feed, which is a token by itself there.
        texts = pa.concat_arrays([units.take(pa.array(spaced)), pc.binary_join_element_wise("\n", units.take(pa.array(bare)), "")])
        borders, data = _parts(texts)
        ids = np.fromiter(chain.from_iterable(self._by_library(_cut(data, np.r_[borders[:-1:64], borders[-1:]]).to_pylist())), np.int32)
        ends = np.cumsum(self.n_bytes[ids])
        upto = np.r_[0, np.searchsorted(ends, borders[1:]) + 1]
        feeds = upto[len(spaced) : -1]
        if len(texts) and (upto[-1] != len(ids) or (ends[upto[1:] - 1] != borders[1:]).any() or (self.n_bytes[ids[feeds]] != 1).any()):
            raise ValueError("the tokenizer file's ids don't add up to its units' bytes")
        before = np.r_[np.zeros(len(spaced) + 1, np.int64), np.arange(1, len(bare) + 1)]
        found = pa.ListArray.from_arrays(pa.array(upto - before, pa.int32()), pa.array(np.delete(ids, feeds)))
        alone = pa.array(list(self._by_library(units.take(pa.array(blank)).to_pylist())), found.type)
        return pa.concat_arrays([found, alone]).take(pa.array(np.argsort(np.r_[spaced, bare, blank])))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        return [np.array(ids[:-1], "<i4").tobytes() for ids in self.ended(pa.array(texts, pa.string())).to_pylist()]

    def ended(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of each text and END."""
        apart = np.full(len(texts), not self.in_units)
        for token in self.added:
            apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not apart.any():
            return self._ended_by_units(texts)
        others = pa.array([[*ids, END] for ids in self._by_library(texts.filter(pa.array(apart)).to_pylist())], pa.list_(pa.int32()))
        found = pa.concat_arrays([self._ended_by_units(texts.filter(pa.array(~apart))), others])
        return found.take(pa.array(np.argsort(np.argsort(apart, kind="stable"))))

    def _ended_by_units(self, texts: pa.StringArray) -> pa.ListArray:
        """Texts are parted into units, and each different one is looked up once, or encoded."""
        borders, data = _parts(texts)
        starts = _units(data, borders)
        coded = pa.concat_arrays([self.known, _cut(data, starts)]).dictionary_encode()
        units, index = coded.dictionary, coded.indices.to_numpy()[len(self.known) :]
        lists = pa.concat_arrays([self.ids, self.ids_of(units[len(self.known) :]), pa.array([[END]], self.ids.type)])
        first = np.searchsorted(starts[:-1], borders)
        found = lists.take(pa.array(np.insert(index, first[1:], len(units))))
        self._keep(units, lists[:-1], np.bincount(index, minlength=len(units)))
        return pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[first + np.arange(len(first))]), found.flatten())

    def _keep(self, units: pa.StringArray, ids: pa.ListArray, met: np.ndarray) -> None:
        weight = met.astype(np.float32)
        weight[: len(self.weight)] += self.weight / 2
        kept = np.diff(_parts(units)[0]) <= LONGEST
        if np.count_nonzero(kept) > CACHE:
            kept[np.argpartition(np.where(kept, -weight, np.inf), CACHE)[CACHE:]] = False
        if not kept.all():
            units, ids, weight = units.filter(pa.array(kept)), ids.filter(pa.array(kept)), weight[kept]
        self.known, self.ids, self.weight = units, ids, weight


@lru_cache(maxsize=2)
def encoder_for(tokenizer_file: str) -> Encoder:
    """One encoder for each worker process, so that its table outlives a task."""
    return Encoder(tokenizer_file)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def whole_text(column: pa.Array) -> pa.StringArray:
    """A string column of valid UTF-8 without nulls, as :func:`as_text` reads it."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        column = pa.array(as_text(column), pa.string())
    return pc.fill_null(column.cast(pa.string()), "")


STORED = "part int, at long, doc_id long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str | None = None, partitions: int | None = None) -> None:
    """Encode every text and write it to ``path``. A null text counts as empty and is the end id alone; rows with a null
    doc_id come first; rows that repeat a doc_id are stored each, by a hash of the text and by text, and may fill several
    files. An empty table writes no row."""
    tokenizer_file = tokenizer_file or default_tokenizer()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = encoder_for(tokenizer_file), 0
        for part in text_portions(batches, TEXT_AT_ONCE):
            ids = encoder.ended(whole_text(part.column("text")))
            offsets = ids.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("part"), pa.array(at + offsets[:-1]), part.column("doc_id"), ids], names=["part", "at", "doc_id", "ids"])
            at += int(offsets[-1])

    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(encoded, STORED)
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20)}
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with each document's global ``start``; a filter on doc_id reaches the files' metadata."""
    stored = spark.read.schema(STORED).orc(path)
    parts = stored.groupBy("part").agg(F.sum(F.size("ids")).alias("n"))
    # One row for each file.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return stored.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")


def token_report(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Write ``docs`` and read it back: doc_id, start, n_tokens and crc32 of the ids as little-endian unsigned integers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column("ids")
            values, offsets = ids.flatten().to_numpy().astype("<u4", copy=False), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file)
    return read_tokens(docs.sparkSession, path).mapInArrow(summed, "doc_id long, start long, n_tokens long, ids_crc32 long")
