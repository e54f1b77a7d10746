"""Language-model scoring with a hidden Markov model.

Words are drawn in two steps: latent states emit word classes, and a class emits a word by its add-one count within
the class. The FREQUENT commonest training words are classes of their own, other words share a class by their ending,
and the end of a text is a class. Baum-Welch counts come from all training texts, each taken whole, summed across
partitions round by round until the likelihood hardly grows. A text is scored whole too, by the scaled forward
recursion, so its score is the exact log10 probability of all its tokens and its end.

Counts of all training words are a Spark table. The at most KNOWN commonest words of at most LONGEST bytes go to every
task; the other words of a document meet their counts in a join. A word that training never saw adds log10(0 + 1) = 0
to the sum of log10(c + 1) that both scores need, so an inner join suffices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import crc_mod, saved, slices, text_portions

STATES = 8
FREQUENT = 4_000
ENDINGS = 1_024
END = FREQUENT + ENDINGS
CLASSES = END + 1
#: At most so many words are sent to every task.
KNOWN = 200_000
LONGEST = 64
#: Training stops once a round raises the mean log10 likelihood of a token by less, or after ROUNDS.
LEAST_GAIN = 0.002
ROUNDS = 6
#: Bytes of text that are parted into words at a time, and of counts that are held before they are summed.
TEXT_AT_ONCE = 8 << 20
COUNTS_AT_ONCE = 32 << 20
#: Tokens of the texts that are worked side by side.
TOKENS_AT_ONCE = 1 << 19
#: Tokens of the pieces that long texts are worked in.
PIECE = 1_024
#: Steps of time between two rescalings: a step's factor is far above 1e-35, so that doubles don't underflow.
RESCALE = 8
HELD_OUT = (7, 2)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER_CASE = bytes.maketrans(_UPPER, _UPPER.lower())


def tokens(text: bytes) -> list[bytes]:
    """Words of the text in lower case, without its end."""
    return text.translate(_LOWER_CASE).split()


def ending_class(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-2:]) % ENDINGS


@lru_cache(maxsize=1)
def _ending_tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes of all endings of one byte and of two bytes."""
    return np.array([ending_class(bytes([a])) for a in range(256)], np.uint16), np.array([ending_class(bytes([a, b])) for a in range(256) for b in range(256)], np.uint16)


def ending_classes(words: pa.BinaryArray) -> np.ndarray:
    """:func:`ending_class` of words that are not empty."""
    if not len(words):
        return np.zeros(0, np.uint16)
    one, two = _ending_tables()
    borders = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data, ends = np.frombuffer(words.buffers()[2], np.uint8), borders[1:]
    last = data[ends - 1]
    return np.where(np.diff(borders) > 1, two[data[np.maximum(ends - 2, 0)].astype(np.int64) * 256 + last], one[last])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return text_portions(batches, TEXT_AT_ONCE)


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """:func:`tokens` of all texts one after another, and the place of each word's text. A null text has none."""
    parted = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, owner = parted.flatten(), pc.list_parent_indices(parted)
    filled = pc.greater(pc.binary_length(words), 0)
    return words.filter(filled), owner.filter(filled).to_numpy()


def word_counts(training: DataFrame) -> DataFrame:
    """``(word binary, c)`` over the texts of ``training(text)``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"word": sums.column("word"), "n": sums.column("n_sum")})

        for part in _portions(batches):
            found = text_words(part.column("text"))[0].value_counts()
            held.append(pa.table({"word": found.field("values").cast(pa.binary()), "n": found.field("counts")}))
            if sum(t.nbytes for t in held) > COUNTS_AT_ONCE:
                held = [summed()]
                if held[0].nbytes > COUNTS_AT_ONCE // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from summed().to_batches()

    return training.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    """What tasks need to know of the training counts, of bounded size."""

    words: pa.BinaryArray  # the commonest ones
    log_count: np.ndarray  # log10(c + 1) of each of them
    word_class: np.ndarray
    class_log_size: np.ndarray  # log10(N_k + V_k + 1) of each class
    total: int  # N
    distinct: int  # V
    end_log_count: float


def commonest(counts: DataFrame, most: int) -> tuple[int, list[bytes], np.ndarray]:
    """The least count t that at most ``most`` words of at most LONGEST bytes reach, those words in order, and their counts."""
    counts = counts.where(F.length("word") <= LONGEST)
    by_count = counts.groupBy("c").count().orderBy(F.desc("c"))
    least, n = 1 << 62, 0
    for row in by_count.toLocalIterator():
        n += row["count"]
        if n > most:
            break
        least = row["c"]
    found = counts.where(F.col("c") >= least).select("word", "c").toArrow()
    words, c = found.column("word").to_pylist(), found.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    return least, [words[i] for i in order], c[order].astype(np.int64)


def _places(words: pa.BinaryArray, among: pa.BinaryArray) -> np.ndarray:
    """Place of each word among others, -1 for none."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy().astype(np.int64)


def lexicon(counts: DataFrame, training_texts: int, most: int = KNOWN) -> tuple[Lexicon, int]:
    least, words, c = commonest(counts, most)
    words = pa.array(words, pa.binary())
    own = words.slice(0, FREQUENT)
    classes = np.r_[np.arange(len(own), dtype=np.uint16), ending_classes(words.slice(FREQUENT))]

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            found = batch.column(0).cast(pa.binary())
            k = _places(found, own)
            k = np.where(k < 0, ending_classes(found), k)
            n += np.bincount(k, batch.column(1).to_numpy(), CLASSES).astype(np.int64)
            v += np.bincount(k, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    sizes = counts.select("word", "c").mapInArrow(sized, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sizes:
        n[r.k], v[r.k] = r.n, r.v
    n[END], v[END] = training_texts, int(training_texts > 0)
    made = Lexicon(words, np.log10(c + 1.0), classes, np.log10(n + v + 1.0), int(n.sum()), int(v.sum()), float(np.log10(training_texts + 1.0)))
    return made, least


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, classes binary, rest array<struct<word:binary,tf:int>>"


def encoded(docs: DataFrame, shared) -> DataFrame:
    """Class sequences of whole texts with what the lexicon knows of them; ``rest`` has the words that it doesn't."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        for part in _portions(batches):
            rows = part.num_rows
            words, owner = text_words(part.column("text"))
            coded = words.dictionary_encode()
            distinct, index = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
            at = _places(distinct, lex.words)
            known, classes, log_count = at >= 0, ending_classes(distinct), np.zeros(len(distinct))
            classes[known], log_count[known] = lex.word_class[at[known]], lex.log_count[at[known]]
            size, other = np.bincount(owner, minlength=rows), ~known[index]
            laid = np.full(len(owner) + rows, END, "<u2")
            laid[np.arange(len(owner)) + owner] = classes[index]
            borders = np.r_[0, np.cumsum(size + 1)] * laid.itemsize
            pairs, tf = np.unique(owner[other] * len(distinct) + index[other], return_counts=True)
            whose, which = np.divmod(pairs, max(len(distinct), 1))
            rest = pa.StructArray.from_arrays([distinct.take(pa.array(which)), pa.array(tf, pa.int32())], names=["word", "tf"])
            columns = [
                part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(size + 1),
                pa.array(size - np.bincount(owner[other], minlength=rows) + int(lex.end_log_count > 0)),
                pa.array(np.bincount(owner, log_count[index], rows) + lex.end_log_count),
                pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(laid)]),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(rows + 1)), pa.int32()), rest),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "classes", "rest"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(encode, ENCODED)


@dataclass(frozen=True)
class Model:
    first: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # states x classes

    @classmethod
    def start(cls, states: int = STATES, seed: int = 9) -> Model:
        rng = np.random.default_rng(seed)
        step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), step, rng.dirichlet(np.full(CLASSES, 2.0), states))

    @classmethod
    def from_counts(cls, first: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        share = lambda x, add: (x + add) / (x + add).sum(-1, keepdims=True)
        return cls(share(first, 0.1), share(step, 0.1), share(emit, 0.01))


def _side_by_side(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences laid out by time: their order (longest first), how many are alive at each time, and all their tokens, those
    of time 0 first, in that order."""
    order = np.array(sorted(range(len(sequences)), key=lambda i: -len(sequences[i])))
    size = np.array([len(sequences[i]) for i in order])
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    flat = np.concatenate([sequences[i] for i in order])
    time = np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
    laid = np.empty(len(flat), np.int64)
    laid[np.r_[0, np.cumsum(alive)[:-1]][time] + np.repeat(np.arange(len(size)), size)] = flat
    return order, alive, laid


def _cut(sequences: list[np.ndarray]) -> tuple[list[np.ndarray], list[list[int]]]:
    """Pieces of all sequences, and the places of each sequence's pieces in order."""
    pieces, chains = [], []
    for s in sequences:
        chains.append(list(range(len(pieces), len(pieces) - (-len(s) // PIECE))))
        pieces += [s[i : i + PIECE] for i in range(0, len(s), PIECE)]
    return pieces, chains


def _passed(turn: np.ndarray, emit: np.ndarray, now: np.ndarray, pieces: list[np.ndarray]) -> np.ndarray:
    """What becomes of the states ``now`` (states by pieces, or states by starts by pieces) over all tokens of each piece, up
    to a factor for each piece."""
    order, alive, tokens_ = _side_by_side(pieces)
    now, out, at, k = now[..., order], np.empty_like(now), 0, len(turn)
    for t, w in enumerate(alive.tolist()):
        if now.shape[-1] > w:
            out[..., order[w : now.shape[-1]]] = now[..., w:]
            now = now[..., :w]
        if t:
            now = turn @ now if now.ndim == 2 else (turn @ now.reshape(k, -1)).reshape(k, k, w)
        likely = np.take(emit, tokens_[at : at + w], 1, mode="clip")
        now *= likely if now.ndim == 2 else likely[:, None]
        if t % RESCALE == RESCALE - 1:
            now /= now.sum(0) if now.ndim == 2 else now.sum((0, 1))
        at += w
    out[..., order[: now.shape[-1]]] = now
    return out


def _messages(model: Model, pieces: list[np.ndarray], chains: list[list[int]], backwards: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """What each piece of a cut sequence takes over, states by pieces: the distribution of its first state given all tokens
    before it, and the relative likelihoods of all tokens after it given its last state (ones unless ``backwards``).

    A first piece starts from the model and a last one is left without more to come, so that states pass through them as
    they are. The tokens of a piece between act on states as one matrix; the matrices of all such pieces are made side by
    side, and only they are passed through in order.
    """
    k = len(model.first)
    before, after = np.tile(model.first[:, None], (1, len(pieces))), np.ones((k, len(pieces)))
    cut = sorted((c for c in chains if len(c) > 1), key=len, reverse=True)
    if not cut:
        return before, after
    turn = np.ascontiguousarray(model.step.T)
    between = [i for c in cut for i in c[1:-1]]
    place = np.empty(len(pieces), np.int64)
    place[between] = np.arange(len(between))
    if between:
        acts = _passed(turn, model.emit, np.repeat(np.eye(k)[:, :, None], len(between), 2), [pieces[i] for i in between])  # state at the end, state at the start, piece
        acts /= acts.sum((0, 1))
    ends = _passed(turn, model.emit, before[:, [c[0] for c in cut]], [pieces[c[0]] for c in cut])
    for rank in range(1, len(cut[0])):
        there, here = [c[rank] for c in cut if len(c) > rank], [c[rank] for c in cut if len(c) > rank + 1]
        before[:, there] = turn @ (ends / ends.sum(0))[:, : len(there)]
        if here:
            ends = np.einsum("jkn,kn->jn", acts[:, :, place[here]], before[:, here])
    if backwards:
        starts = _passed(model.step, model.emit, after[:, [c[-1] for c in cut]], [pieces[c[-1]][::-1] for c in cut])
        for rank in range(2, len(cut[0]) + 1):
            there, here = [c[-rank] for c in cut if len(c) >= rank], [c[-rank] for c in cut if len(c) > rank]
            comes = model.step @ starts[:, : len(there)]
            after[:, there] = comes / comes.sum(0)
            if here:
                starts = np.einsum("jkn,jn->kn", acts[:, :, place[here]], after[:, here])
    return before, after


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of whole sequences (first states, steps, emissions) and their log10 likelihood.

    Long sequences are cut into pieces that are worked side by side; what crosses a cut is taken over exactly. Each step of
    time has an array of its own, states by tokens, that lies in one run of memory.
    """
    pieces, chains = _cut(sequences)
    order, alive, tokens_ = _side_by_side(pieces)
    before, after = (x[:, order] for x in _messages(model, pieces, chains))
    last = np.empty(len(pieces), np.int64)  # place of the piece before, -1 for a first one
    place = np.empty(len(pieces), np.int64)
    place[order] = np.arange(len(pieces))
    for c in chains:
        last[place[c]] = [-1, *place[c[:-1]]]
    at, alive = np.r_[0, np.cumsum(alive)].tolist(), alive.tolist()
    k = len(model.first)
    turn = np.ascontiguousarray(model.step.T)
    # Of each token in each state, by time: likelihoods (relative to their scale after the forward pass) and the recursion.
    ahead, alpha = ([x[k * a : k * b].reshape(k, b - a) for a, b in zip(at, at[1:])] for x in np.empty((2, k * at[-1])))
    likely, ends = 0.0, np.empty((k, len(pieces)))
    for t, w in enumerate(alive):
        now = alpha[t]
        np.take(model.emit, tokens_[at[t] : at[t + 1]], 1, out=ahead[t], mode="clip")
        np.multiply(turn @ alpha[t - 1][:, :w] if t else before, ahead[t], out=now)
        if t % RESCALE == RESCALE - 1:
            scale = now.sum(0)
            now /= scale
            ahead[t] /= scale
            likely += np.log10(scale).sum()
        goes_on = alive[t + 1] if t + 1 < len(alive) else 0
        ends[:, goes_on:w] = now[:, goes_on:]
    likely += np.log10(ends.sum(0)).sum()
    after /= (ends * after).sum(0)
    ends /= ends.sum(0)
    step, beta = np.zeros((k, k)), after[:, : alive[-1]]
    for t in range(len(alive) - 1, 0, -1):
        arrives, w = ahead[t], alive[t]
        arrives *= beta
        step += alpha[t - 1][:, :w] @ arrives.T
        alpha[t] *= beta
        beta = model.step @ arrives
        if alive[t - 1] > w:
            beta = np.concatenate([beta, after[:, w : alive[t - 1]]], 1)
    arrives = ahead[0] * beta
    crossing = last >= 0
    step += ends[:, last[crossing]] @ arrives[:, crossing].T
    alpha[0] *= beta
    emit = np.zeros((k, CLASSES))
    for a in range(0, len(alive), 64):
        some = alpha[a : a + 64]
        of = tokens_[at[a] : at[a + len(some)]]
        for total, x in zip(emit, np.concatenate(some, 1)):
            total += np.bincount(of, x, CLASSES)
    return alpha[0][:, ~crossing].sum(1), step * model.step, emit, float(likely)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Class sequences in lists of about TOKENS_AT_ONCE tokens."""
    held, n = [], 0
    for part in slices(batches):
        for x in part.column(0).to_pylist():
            held.append(np.frombuffer(x, "<u2"))
            n += len(held[-1])
            if n >= TOKENS_AT_ONCE:
                yield held
                held, n = [], 0
    if held:
        yield held


def baum_welch(table: DataFrame, rounds: int = ROUNDS, states: int = STATES, least_gain: float = LEAST_GAIN) -> Model:
    """Train on the class sequences of ``table(classes)``; each round is one pass and a grouped sum of the counts."""
    model = Model.start(states)
    before = -np.inf

    def counting(now: Model):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(states + states * states + states * CLASSES + 2)
            for sequences in _blocks(batches):
                *counts, likely = expected_counts(now, sequences)
                total += np.concatenate([*(x.ravel() for x in counts), [likely, sum(map(len, sequences))]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "x"])

        return count

    for _ in range(rounds):
        # As many rows as the model has numbers.
        sums = table.select("classes").mapInArrow(counting(model), "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(states + states * states + states * CLASSES + 2)
        flat[sums.column("place").to_numpy()] = sums.column("x").to_numpy()
        first, step, emit, (likely, n) = np.split(flat, [states, states + states * states, len(flat) - 2])
        model = Model.from_counts(first, step.reshape(states, states), emit.reshape(states, CLASSES))
        if not n or likely / n - before < least_gain:
            break
        before = likely / n
    return model


def log10_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each class sequence, by the scaled forward recursion; pieces of long sequences are worked
    side by side, as in training."""
    pieces, chains = _cut(sequences)
    order, alive, tokens_ = _side_by_side(pieces)
    now = _messages(model, pieces, chains, False)[0][:, order]
    turn = np.ascontiguousarray(model.step.T)
    total, start = np.zeros(len(pieces)), 0
    for t, w in enumerate(alive.tolist()):
        if now.shape[1] > w:
            total[w : now.shape[1]] += np.log10(now[:, w:].sum(0))
        likely = np.take(model.emit, tokens_[start : start + w], 1, mode="clip")
        now = np.multiply(turn @ now[:, :w] if t else now, likely, out=likely)
        if t % RESCALE == RESCALE - 1:
            scale = now.sum(0)
            now /= scale
            total[:w] += np.log10(scale)
        start += w
    total[: now.shape[1]] += np.log10(now.sum(0))
    of_piece = np.empty(len(pieces))
    of_piece[order] = total
    return np.array([of_piece[c].sum() for c in chains])


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, class_score double"


def hmm_scores(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone. A null doc_id stays null and counts as the empty id for the split. Repeated
    rows are learnt from and scored each. Without training texts every count is zero and the states stay as started.
    """
    spark = docs.sparkSession
    modulus, remainder = HELD_OUT
    marked = docs.select("doc_id", "text", (crc_mod("doc_id", modulus) == remainder).alias("held_out"))
    training = marked.where(~F.col("held_out"))
    counts = saved(word_counts(training), "counts")
    lex, least = lexicon(counts, training.count(), known)
    shared = spark.sparkContext.broadcast(lex)
    table = saved(encoded(marked, shared).withColumn("rid", F.monotonically_increasing_id()), "encoded")
    model = baum_welch(table.where(~F.col("held_out")), rounds)
    sizes = lex.class_log_size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            sequences = [np.frombuffer(x, "<u2") for x in part.column("classes").to_pylist()]
            within = np.array([sizes[s].sum() for s in sequences])
            out = pa.array(log10_likelihoods(model, sequences) - within)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "n_known", "log_counts")), out], names=[x.split()[0] for x in SCORED.split(", ")])

    scored = table.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "classes").mapInArrow(score, SCORED)
    rest = table.select("rid", F.explode("rest").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    found = rest.join(counts.where((F.col("c") < least) | (F.length("word") > LONGEST)), "word")
    sums = found.groupBy("rid").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum(F.col("tf").cast("long")).alias("seen"))
    every = scored.join(sums, "rid", "left").withColumn("all_counts", F.col("log_counts") + F.coalesce("more", F.lit(0.0)))
    per_token = float(np.log10(lex.total + lex.distinct + 1.0))
    return every.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("all_counts") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), (F.col("class_score") + F.col("all_counts")).alias("score"),
    )
