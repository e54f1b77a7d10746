"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network over them.

Every token has a sparse ternary index vector by its hash. The VOCABULARY commonest tokens of the corpus have a context
vector besides, the normalised sum of the index vectors of their neighbours (WINDOW to each side) over all documents; a
rarer token is its index vector alone. Tokens stand in two streams: words in lower case, and as an addition their shapes
(runs of letters and of digits, and marks). A document is the mean of its word vectors, that of its distinct words' vectors,
the mean of its shape vectors, and as an addition what these means are over: the number of words (its logarithm) and the
shares of distinct words and of distinct pairs of words.

Counts and contexts come from all documents, and no label enters them. The network is fitted on at most FIT_ROWS
labelled rows, those of least hash among the rows that may be learnt from; a fifth of them sets the temperature of its
probabilities. What is collected is bounded by FIT_ROWS and VOCABULARY.

Some megabytes of text are worked at a time: Arrow parts them into words, and each different word of them is lowered,
shaped and looked up once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import crc_mod, hash_sample, saved, text_portions

DIMENSIONS = 64
NONZERO = 4
WINDOW = 2
#: Tokens of each stream that have a context vector.
VOCABULARY = 16_384
#: Index vectors of the other tokens are made once for each of so many hashes.
BUCKETS = 65_536
#: Bytes of text that are parted into words at a time, and of counts that are held before they are summed.
TEXT_AT_ONCE = 4 << 20
COUNTS_AT_ONCE = 32 << 20
FIT_ROWS = 20_000
HIDDEN = 32
THRESHOLD = 0.7
HELD_OUT = (4, 2)
LONGEST = 64  # bytes of a token of the vocabulary
#: Bits of a token's id in the keys of distinct tokens of texts.
ID_BITS = 20
_SHAPES = np.frombuffer(bytes.maketrans(bytes(range(97, 123)) + bytes(range(65, 91)) + bytes(range(48, 58)) + bytes(range(128, 256)), b"x" * 26 + b"X" * 26 + b"9" * 10 + b"x" * 128), np.uint8)


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of all texts, the place of each word among them, and that of its text. A null text has none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words, owner = split.flatten(), pc.list_parent_indices(split)
    filled = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(filled).dictionary_encode()
    return coded.dictionary.view(pa.binary()), coded.indices.to_numpy(), owner.filter(filled).to_numpy()


def lowered(words: pa.Array) -> pa.Array:
    return pc.ascii_lower(words.view(pa.string())).view(pa.binary())


def shaped(words: pa.Array) -> pa.Array:
    """The shape of each word: its letters, digits and marks by kind, a run of letters or digits as a single one."""
    if not len(words):
        return words
    borders = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    kinds = _SHAPES[np.frombuffer(words.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]]
    borders = borders - borders[0]
    stays = np.ones(len(kinds) + 1, bool)
    stays[1:-1] = (kinds[1:] != kinds[:-1]) | ~np.isin(kinds[1:], np.frombuffer(b"xX9", np.uint8))
    stays[borders[:-1]] = True
    stays = stays[:-1]
    ends = np.concatenate([[0], np.cumsum(stays)])[borders].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(kinds[stays])])


def shape(word: bytes) -> bytes:
    return shaped(pa.array([word], pa.binary()))[0].as_py()


def index_symbols(tokens: list[bytes]) -> np.ndarray:
    """Seven bits of each token's hash for each of its index vector's nonzero components: whether it is positive, and its place."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    return (hashes[:, None] >> np.arange(0, 7 * NONZERO, 7, dtype=np.uint64) & np.uint64(2 * DIMENSIONS - 1)).astype(np.int64)


def dense(tokens: list[bytes]) -> np.ndarray:
    out = np.zeros((len(tokens), DIMENSIONS))
    symbols = index_symbols(tokens)
    np.add.at(out, (np.arange(len(tokens))[:, None], symbols % DIMENSIONS), np.where(symbols >= DIMENSIONS, 1.0, -1.0))
    return out


class Stream:
    """Ids of one stream's tokens: the vocabulary, then hashes."""

    def __init__(self, vocabulary: list[bytes]):
        self.vocabulary = pa.array(vocabulary, pa.binary())

    def ids(self, tokens: pa.Array) -> np.ndarray:
        found = pc.fill_null(pc.index_in(tokens, value_set=self.vocabulary), -1).to_numpy().astype(np.int64)
        rest = np.nonzero(found < 0)[0]
        hashes = map(zlib.crc32, tokens.take(pa.array(rest)).to_numpy(zero_copy_only=False))
        found[rest] = len(self.vocabulary) + np.fromiter(hashes, np.int64, len(rest)) % BUCKETS
        return found

    def names(self) -> list[bytes]:
        return self.vocabulary.to_pylist() + [b"\n%d" % i for i in range(BUCKETS)]


def read(words: Stream, shapes: Stream, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, the word id and the shape id of each word of all texts, one after another."""
    tokens, index, owner = parted(texts)
    return owner, words.ids(lowered(tokens))[index], shapes.ids(shaped(tokens))[index]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in ascending order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.nonzero(np.diff(keys, prepend=-1))[0]
    return keys[first], np.diff(first, append=len(keys))


@dataclass(frozen=True)
class Pooler:
    words: Stream
    shapes: Stream
    word_vectors: np.ndarray
    shape_vectors: np.ndarray

    def pool(self, texts: pa.Array) -> np.ndarray:
        """A row for each text."""
        owner, words, shapes = read(self.words, self.shapes, texts)
        rows = len(texts)
        out = np.zeros((rows, 3 * DIMENSIONS + 3))
        n = np.bincount(owner, minlength=rows)
        filled = np.nonzero(n)[0]
        if not len(filled):
            return out
        different = np.ones(rows, np.int64)
        for ids, vectors, at, means in ((words, self.word_vectors, 0, 2), (shapes, self.shape_vectors, 2, 1)):
            keys, times = distinct(owner << ID_BITS | ids)
            cuts = np.searchsorted(keys >> ID_BITS, np.arange(rows + 1))
            weights, keys = np.stack([times, np.ones_like(times)][:means]).astype(np.float32), keys & (1 << ID_BITS) - 1
            for i in filled.tolist():
                one = slice(cuts[i], cuts[i + 1])
                out[i, at * DIMENSIONS : (at + means) * DIMENSIONS] = (weights[:, one] @ vectors[keys[one]]).ravel()
            if ids is words:
                different = np.diff(cuts)
        next_to = np.nonzero(owner[1:] == owner[:-1])[0]
        pairs = np.bincount(distinct(owner[next_to] << 2 * ID_BITS | words[next_to] << ID_BITS | words[next_to + 1])[0] >> 2 * ID_BITS, minlength=rows)
        of, n = n[filled, None], n[filled]
        out[filled, :DIMENSIONS] /= of
        out[filled, DIMENSIONS : 2 * DIMENSIONS] /= different[filled, None]
        out[filled, 2 * DIMENSIONS : 3 * DIMENSIONS] /= of
        out[filled, 3 * DIMENSIONS :] = np.stack([np.log(n), different[filled] / n, (pairs[filled] + 1) / n], 1)
        return out


def _vocabularies(docs: DataFrame) -> tuple[Stream, Stream]:
    """The commonest words and shapes of all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            sums = pa.concat_tables(held).group_by(["stream", "token"], use_threads=False).aggregate([("n", "sum")])
            return pa.table({"stream": sums.column("stream"), "token": sums.column("token"), "n": sums.column("n_sum")})

        for part in text_portions(batches, TEXT_AT_ONCE):
            raw, index, _ = parted(part.column("text"))
            n = np.bincount(index, minlength=len(raw))
            for stream, tokens in enumerate((lowered(raw), shaped(raw))):
                held.append(pa.table({"stream": pa.array(np.full(len(raw), stream), pa.int32()), "token": tokens, "n": n}))
            if sum(t.nbytes for t in held) > COUNTS_AT_ONCE:
                held = [summed()]
                if held[0].nbytes > COUNTS_AT_ONCE // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from summed().to_batches()

    counts = docs.select("text").mapInArrow(counted, "stream int, token binary, n long").groupBy("stream", "token").agg(F.sum("n").alias("n"))
    counts = saved(counts.where(f"n > 1 AND length(token) <= {LONGEST}"), "token-counts")
    tops = [counts.where(F.col("stream") == k).orderBy(F.desc("n"), "token").limit(VOCABULARY).select("token").toArrow().column(0).to_pylist() for k in (0, 1)]
    return Stream(sorted(tops[0])), Stream(sorted(tops[1]))


def context_vectors(docs: DataFrame, words: Stream, shapes: Stream) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the neighbours' index vectors for the vocabularies of both streams, over all documents."""
    known = [len(s.vocabulary) for s in (words, shapes)]
    shared = docs.sparkSession.sparkContext.broadcast((words, shapes))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = shared.value
        symbols = [index_symbols(s.names()) for s in streams]
        total = [np.zeros(2 * n * DIMENSIONS, np.int64) for n in known]
        for part in text_portions(batches, TEXT_AT_ONCE):
            owner, *read_ids = read(*streams, part.column("text"))
            for step in range(1, WINDOW + 1):
                same = owner[:-step] == owner[step:]
                for ids, k, index, t in zip(read_ids, known, symbols, total):
                    for a, b in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
                        near = np.nonzero(same & (a < k))[0]
                        t += np.bincount((2 * DIMENSIONS * a[near, None] + index[b[near]]).ravel(), minlength=len(t))
        rows = np.concatenate([t[1::2] - t[::2] for t in (t.reshape(-1, DIMENSIONS) for t in total)]).astype(np.float32)
        used = np.nonzero(rows.any(1))[0]
        for start in range(0, len(used), 4_096):
            some = used[start : start + 4_096]
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows[some].ravel()), DIMENSIONS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(some), values], names=["id", "v"])

    parts = docs.select("text").mapInArrow(gathered, "id long, v array<float>")
    # At most twice VOCABULARY rows.
    sums = parts.groupBy("id").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(DIMENSIONS))).alias("v")).toArrow()
    out = np.zeros((sum(known), DIMENSIONS))
    if sums.num_rows:
        out[sums.column("id").to_numpy()] = np.stack(sums.column("v").to_numpy())
    return out[: known[0]], out[known[0] :]


def fit_pooler(docs: DataFrame) -> Pooler:
    words, shapes = _vocabularies(docs)
    vectors = []
    for stream, context in zip((words, shapes), context_vectors(docs, words, shapes)):
        made = dense(stream.names()) / NONZERO**0.5
        made[: len(context)] += context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
        vectors.append(made.astype(np.float32))
    return Pooler(words, shapes, *vectors)


@dataclass(frozen=True)
class Network:
    """Two layers over standardised inputs, and the temperature of its log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network:
        """Adam on the log loss over mini-batches of 128."""
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = (x - mean) / scale
        p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for start in range(0, len(z), 128):
                rows = order[start : start + 128]
                a, t = z[rows], y[rows]
                h = np.maximum(a @ p[0] + p[1], 0)
                wrong = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t) / len(rows)
                back = wrong[:, None] * p[2] * (h > 0)
                step += 1
                for k, g in enumerate((a.T @ back, back.sum(0), h.T @ wrong, wrong.sum(keepdims=True))):
                    g = g + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / ((v[k] / (1 - 0.999**step)) ** 0.5 + 1e-8)
        return cls(mean, scale, p[0], p[1], p[2], float(p[3][0]))

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> Network:
        """With the temperature of least log loss on rows that weren't fitted."""
        logits = self.logits(x)
        loss = lambda t: np.logaddexp(0, -np.where(y > 0.5, 1, -1) * logits / t).mean()
        best = min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss) if len(y) else 1.0
        return Network(self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, float(best))


def fitting_sample(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, text, quality)`` of at most ``most`` labelled documents outside the held-out fold. Of several labels of
    one document the least counts; null labels and labels other than 0 and 1 don't."""
    modulus, remainder = HELD_OUT
    may = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != remainder))
    chosen = hash_sample(may.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", most)
    # At most `most` rows of two numbers. Of several texts of one doc_id the least counts.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null or empty text has the zero vector and is scored like any other. A null doc_id stays null and counts as the
    empty id for the fold; repeated rows are scored each. Without usable labels every score is 0.5.
    """
    modulus, remainder = HELD_OUT
    sample = saved(fitting_sample(docs, labels, most), "fitting-sample")
    shared = docs.sparkSession.sparkContext.broadcast(fit_pooler(docs))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_portions(batches, TEXT_AT_ONCE):
            x = list(shared.value.pool(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    fit = sample.mapInArrow(pooled, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    network = None
    if len(fit):
        x, y = np.stack(fit["x"]), fit["quality"].to_numpy(float)
        aside = np.array([zlib.crc32(b"aside%d" % i) % 5 == 0 for i in fit["doc_id"]])
        network = Network.fit(x[~aside] if (~aside).any() else x, y[~aside] if (~aside).any() else y).calibrated(x[aside], y[aside])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_portions(batches, TEXT_AT_ONCE):
            x = shared.value.pool(part.column("text"))
            score = network.probability(x) if network else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    marked = docs.select("doc_id", (crc_mod("doc_id", modulus) == remainder).alias("held_out"), "text")
    return marked.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
