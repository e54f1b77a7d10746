"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file and composed with each input. Weights add along a path, and of the
paths to one place the least counts (the tropical semiring):

* the normaliser reads the longest stretch that its charsmap rewrites, or one character as it is, at weight 0; it can
  drop superfluous blanks, and writes one dummy prefix and the visible space for each blank;
* the piece machine has a state for each piece. An arc that reads a piece leads to that piece's state at weight 1 plus
  the weight of the border between the two pieces: 0, or infinity where the model's merges would join or cut across it;
* byte fallback reads one character that is in no piece, writes its UTF-8 bytes at weight 1 each, and leads to the start
  state.

The arcs of the piece machine share their beginnings in a trie. The shortest path through the composition is the
encoding: under the border weights at most one path of finite weight reaches each position, so the relaxation keeps
one state for each. Blanks never follow another character inside a piece, so the composition splits before each run
of blanks, and the paths of such stretches are found once and kept in a bounded cache.

Some megabytes of text are worked at a time: Arrow parts them, and the relaxation runs over all their new stretches side
by side, place by place; only long ones are worked one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from strideframe.llm.common import as_text, text_portions, tidied

SPACE = "▁"
START = -1
INFINITE = float("inf")
#: Stretches kept in each of the two generations of a worker's cache, which stays beside the executor's heap in later stages.
CACHE = 50_000
#: Longer stretches are worked one by one and not kept.
LONGEST = 64
#: Bytes of text that are worked at a time.
TEXT_AT_ONCE = 3 << 20
#: Stretches that are worked side by side.
STRETCHES_AT_ONCE = 16_384
#: Letters that have a column in the table of arcs; the arcs of the others are searched for.
COMMON = 128
#: Bits of a place in the table of borders that were weighed.
BORDER_BITS = 21
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def normaliser_of(model: bytes) -> dict[str, object]:
    """Name, charsmap and flags of the model file's normaliser (its third field)."""
    names = {1: "name", 2: "charsmap", 3: "dummy_prefix", 4: "remove_extra", 5: "escape"}
    spec: dict[str, object] = {"name": b"", "charsmap": b"", "dummy_prefix": 1, "remove_extra": 1, "escape": 1}
    at = 0
    while at < len(model):
        key, at = varint(model, at)
        size, body = varint(model, at)
        if key == (3 << 3 | 2):
            end, at = body + size, body
            while at < end:
                inner, at = varint(model, at)
                value, at = varint(model, at)
                if inner & 7 == 2:
                    value, at = model[at : at + value], at + value
                if inner >> 3 in names:
                    spec[names[inner >> 3]] = value
        at = body + size if key & 7 == 2 else body
    return spec


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """What the charsmap rewrites to what: the keys of its double-array trie, with the strings that their leaves point to."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    trie, strings = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    offset = (trie >> 10) << ((trie & 512) >> 6)
    label = trie & (1 << 31 | 255)
    letters = np.arange(1, 256)
    found, open_ = {}, [(0, b"")]
    while open_:
        node, key = open_.pop()
        if trie[node] >> 8 & 1 and key:
            at = int(trie[node ^ offset[node]] & (1 << 31) - 1)
            found[key.decode()] = strings[at : strings.index(b"\0", at)].decode()
        below = node ^ offset[node] ^ letters
        below = below[below < len(trie)]
        open_ += [(int(x), key + bytes([label[x]])) for x in below[label[below] == (node ^ offset[node] ^ below)]]
    return found


class Normaliser:
    """Text to piece alphabet."""

    def __init__(self, spec: dict[str, object]):
        if not spec["escape"]:
            raise ValueError("a normaliser that leaves blanks as they are")
        self.prefix = SPACE if spec["dummy_prefix"] else ""
        self.squeeze = bool(spec["remove_extra"])
        self.rules = charsmap_rules(spec["charsmap"])
        longest_first = sorted(self.rules, key=len, reverse=True)
        self.arcs = re.compile("|".join(map(re.escape, longest_first))) if self.rules else None

    def __call__(self, text: str) -> str:
        if self.arcs:
            text = self.arcs.sub(lambda m: self.rules[m[0]], text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return self.prefix + text.replace(" ", SPACE) if text else ""


class PieceMachine:
    """The compiled transducer of one model file."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.normalise = Normaliser(normaliser_of(model.serialized_model_proto()))
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.ids = {self.text[i]: i for i in range(n) if not special[i]}
        self.silent = {i for i in range(n) if model.is_control(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a blank after another character")
        # The order of merges: by score, and among equal scores the longer first, as the leftmost run then grows on.
        ordered = sorted(self.ids.values(), key=lambda i: (-model.get_score(i), -len(self.text[i]), i))
        self.rank = {i: r for r, i in enumerate(ordered)}
        self.halves: dict[int, tuple[int, int]] = {}
        #: Arcs that read pieces: character -> (the piece read so far or START, the arcs that go on from there).
        self.arcs: dict[str, list] = {}
        for i in ordered:
            piece = self.text[i]
            if len(self._merged(piece)) == 1:
                node = self.arcs
                for c in piece[:-1]:
                    node = node.setdefault(c, [START, {}])[1]
                node.setdefault(piece[-1], [START, {}])[0] = i
        self.borders: dict[int, float] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._tabulate(n)

    def _tabulate(self, n: int) -> None:
        """The arcs, merges and pieces as arrays."""
        inner, nodes, tips, arcs = [self.arcs], [START], [], []
        for k, node in enumerate(inner):  # grows as it goes on
            for c, (piece, below) in node.items():
                into, pieces = (inner, nodes) if below else (tips, tips)
                arcs.append((k, c, len(into), not below))
                pieces.append(piece)
                if below:
                    inner.append(below)
        times = Counter(c for _, c, _, _ in arcs)
        letters = {c: k for k, c in enumerate(sorted(times, key=lambda c: (-times[c], c)), 1)}
        #: Letter of each code point; 0 is one in no piece.
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[list(map(ord, letters))] = list(letters.values())
        #: Whether a letter is a piece.
        self.single = np.array([False, *(c in self.ids for c in letters)])
        #: State that an arc leads to, -1 without one; states from ``n_inner`` on have no arcs.
        self.n_inner = len(inner)
        self.next = np.full((self.n_inner, COMMON + 1), -1, np.int32)
        self.piece_of = np.array(nodes + tips, np.int32)
        self.n_letters = len(letters) + 1
        rare = [(self.n_inner * self.n_letters, -1)]
        for k, c, at, tip in arcs:
            at += self.n_inner * tip
            if letters[c] < COMMON:
                self.next[k, letters[c]] = at
            else:
                rare.append((k * self.n_letters + letters[c], at))
        self.rare, self.rare_to = np.array(sorted(rare), np.int64).T.copy()
        self.n = n
        #: Of each piece: when its last merge came, -1 without one, and the halves that it joins.
        self.late, self.left_half, self.right_half = np.full((3, n), -1, np.int64)
        for i, (a, b) in self.halves.items():
            self.late[i], self.left_half[i], self.right_half[i] = self.rank[i], a, b
        pairs = sorted((a * n + b, self.rank[i]) for i in self.ids.values() for t in [self.text[i]] for k in range(1, len(t)) if (a := self.ids.get(t[:k])) is not None and (b := self.ids.get(t[k:])) is not None)
        #: Pairs of pieces that join, and when they do.
        self.pairs, self.pair_rank = np.array([*pairs, (n * n, 0)], np.int64).T.copy()
        #: Borders that were weighed, each with whether its weight is finite, at a place by their hash.
        self.weighed = np.full(1 << BORDER_BITS, -1, np.int64)
        self.spelt = pa.array([b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.text)], pa.binary())

    def _merged(self, text: str) -> list[int]:
        """Merges of one piece from its characters; remembers the two halves that its last merge joins."""
        path = [self.ids.get(c, START) for c in text]
        while len(path) > 1:
            best, where = None, 0
            for k in range(len(path) - 1):
                if path[k] >= 0 and path[k + 1] >= 0:
                    joined = self.ids.get(self.text[path[k]] + self.text[path[k + 1]])
                    if joined is not None and (best is None or self.rank[joined] < self.rank[best]):
                        best, where = joined, k
            if best is None:
                break
            if len(path) == 2:
                self.halves[best] = (path[0], path[1])
            path[where : where + 2] = [best]
        return path

    def border(self, left: int, right: int) -> float:
        """The weight between two pieces, infinite unless, undoing the merges of both from the last back to the first, no
        earlier merge joins what then stands at the border."""
        a, b = left, right
        limit = len(self.rank)  # merges ranked before this one came first
        weight = None
        while weight is None:
            joined = self.ids.get(self.text[a] + self.text[b])
            # Of two merges of one rank the left one comes first, so the right one is undone first.
            late_a = self.rank[a] if a in self.halves else -1
            late_b = self.rank[b] if b in self.halves else -1
            if joined is not None and self.rank[joined] < limit:
                weight = INFINITE
            elif late_a < 0 and late_b < 0:
                weight = 0.0
            elif late_a > late_b:
                limit, a = late_a, self.halves[a][1]
            else:
                limit, b = late_b + 1, self.halves[b][0]
        if len(self.borders) >= 2 * CACHE:
            self.borders.clear()
        self.borders[left << 32 | right] = weight
        return weight

    def open_borders(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether :meth:`border` is finite, for many pairs."""
        finite, undecided, limit = np.zeros(len(left), bool), np.arange(len(left)), np.full(len(left), len(self.rank))
        while len(undecided):
            key = left * self.n + right
            at = np.searchsorted(self.pairs, key)
            joins = (self.pairs[at] == key) & (self.pair_rank[at] < limit)
            late_a, late_b = self.late[left], self.late[right]
            whole = (late_a < 0) & (late_b < 0)
            finite[undecided[whole & ~joins]] = True
            on = ~(whole | joins)
            left, right, late_a, late_b, undecided = left[on], right[on], late_a[on], late_b[on], undecided[on]
            undo_left = late_a > late_b
            limit = np.where(undo_left, late_a, late_b + 1)
            left, right = np.where(undo_left, self.right_half[left], left), np.where(undo_left, right, self.left_half[right])
        return finite

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`open_borders` by the table of those that were weighed; of two at one place the later stays."""
        key = left.astype(np.int64) * self.n + right
        place = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BORDER_BITS)).astype(np.int64)
        known = self.weighed[place]
        new = np.nonzero(known >> 1 != key)[0]
        if len(new):
            known[new] = key[new] << 1 | self.open_borders(left[new].astype(np.int64), right[new].astype(np.int64))
            self.weighed[place[new]] = known[new]
        return (known & 1).astype(bool)

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """States that arcs lead to, -1 without one."""
        to = self.next[node, np.minimum(letter, COMMON)]
        seldom = np.nonzero(letter >= COMMON)[0]
        if len(seldom):
            key = node[seldom].astype(np.int64) * self.n_letters + letter[seldom]
            at = np.searchsorted(self.rare, key)
            to[seldom] = np.where(self.rare[at] == key, self.rare_to[at], -1)
        return to

    def shortest_paths(self, stretches: list[str]) -> list[bytes]:
        """:meth:`shortest_path` of many stretches, as little-endian 32-bit integers."""
        paths: list[bytes] = [b""] * len(stretches)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        for i in np.nonzero(sizes > LONGEST)[0].tolist():
            paths[i] = np.array(self.shortest_path(stretches[i]), "<i4").tobytes()
        by_size = np.argsort(-sizes, kind="stable")
        by_size = by_size[(sizes[by_size] > 0) & (sizes[by_size] <= LONGEST)].tolist()
        for at in range(0, len(by_size), STRETCHES_AT_ONCE):
            some = by_size[at : at + STRETCHES_AT_ONCE]
            for i, path in zip(some, self._side_by_side([stretches[i] for i in some])):
                paths[i] = path
        return paths

    def _side_by_side(self, stretches: list[str]) -> list[bytes]:
        """Shortest paths of stretches in falling order of their size, so that those beyond a place come before the others."""
        count, n = len(stretches), np.fromiter(map(len, stretches), np.int64, len(stretches))
        longest = int(n[0])
        owner, inside = np.repeat(np.arange(count), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = np.zeros((longest, count), np.int32)
        code[inside, owner] = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4")
        letters = self.letter[code]
        beyond = np.searchsorted(-n, -np.arange(longest + 1), side="left")
        none = np.iinfo(np.int16).max
        weight = np.full((longest + 1, count), none, np.int16)
        weight[0] = 0
        state, back = np.full((longest + 1, count), START, np.int32), np.zeros_like(weight)
        spelt: dict[int, list[int]] = {}  # code points that are no pieces, as byte pieces
        for start in range(longest):
            rows = np.nonzero(weight[start, : beyond[start]] < none)[0]
            alone = rows[~self.single[letters[start, rows]]]
            before, step, node, end = state[start, rows], weight[start, rows] + np.int16(1), np.zeros(len(rows), np.int32), start
            while len(rows):
                node = self._step(node, letters[end, rows])
                end += 1
                piece = self.piece_of[node]
                may = np.nonzero((node >= 0) & (piece >= 0) & (step < weight[end, rows]))[0]
                bound = before[may] >= 0
                bound[bound] = ~self.fits(before[may[bound]], piece[may[bound]])
                may = may[~bound]
                to = rows[may]
                weight[end, to], state[end, to], back[end, to] = step[may], piece[may], start
                on = np.nonzero((node >= 0) & (node < self.n_inner) & (rows < beyond[end]))[0]
                rows, node, before, step = rows[on], node[on], before[on], step[on]
            if len(alone):
                points, which = np.unique(code[start, alone], return_inverse=True)
                for c in points.tolist():
                    spelt[c] = [self.byte[b] for b in chr(c).encode("utf-8", "replace")]
                step = weight[start, alone] + np.array([len(spelt[c]) for c in points.tolist()], np.int16)[which]
                less = step < weight[start + 1, alone]
                to = alone[less]
                weight[start + 1, to], state[start + 1, to], back[start + 1, to] = step[less], START, start
        total = weight[n, np.arange(count)].astype(np.int64)
        if (total == none).any():
            raise ValueError("a stretch without a path")
        ends = np.cumsum(total)
        ids = np.zeros(ends[-1], "<i4")
        rows, place, at = np.arange(count), n, ends
        while len(rows):
            got, before = state[place, rows], back[place, rows].astype(np.int64)
            ids[at - 1] = got
            for k in np.nonzero(got == START)[0].tolist():
                of_bytes = spelt[int(code[before[k], rows[k]])]
                ids[at[k] - len(of_bytes) : at[k]] = of_bytes
            at = at - (weight[place, rows] - weight[before, rows])
            on = before > 0
            rows, place, at = rows[on], before[on], at[on]
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def shortest_path(self, stretch: str) -> tuple[int, ...]:
        """Output of the path of least weight through the composition with one stretch."""
        n = len(stretch)
        weight = [0.0] + [INFINITE] * n  # of the least path to a position
        state = [START] * (n + 1)  # the piece that path ends in
        back = [0] * (n + 1)
        arcs, border, ids = self.arcs, self.borders.get, self.ids
        for start in range(n):
            so_far = weight[start]
            if so_far == INFINITE:
                continue
            before, step, node = state[start], so_far + 1, arcs
            for end in range(start, n):
                arc = node.get(stretch[end])
                if arc is None:
                    break
                piece, node = arc
                if piece < 0 or step >= weight[end + 1]:
                    continue
                if before >= 0:
                    between = border(before << 32 | piece)
                    if between is None:
                        between = self.border(before, piece)
                    if step + between >= weight[end + 1]:
                        continue
                weight[end + 1], state[end + 1], back[end + 1] = step, piece, start
            if stretch[start] not in ids:
                step = so_far + len(stretch[start].encode("utf-8", "replace"))
                if step < weight[start + 1]:
                    weight[start + 1], state[start + 1], back[start + 1] = step, START, start
        out: list[int] = []
        end = n
        while end:
            start = back[end]
            if state[end] == START:
                out += [self.byte[b] for b in reversed(stretch[start:end].encode("utf-8", "replace"))]
            else:
                out.append(state[end])
            end = start
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self._paths(_STRETCH.findall(self.normalise(text)))), "<i4").tolist()

    def _paths(self, stretches: list[str]) -> list[bytes]:
        """The shortest paths, kept in the young generation; a full one becomes the old one, so that common stretches stay."""
        paths = list(map(self.young.get, stretches))
        if None in paths:
            new = {s: self.old.get(s) for s, path in zip(stretches, paths) if path is None}
            unknown = [s for s, path in new.items() if path is None]
            new.update(zip(unknown, self.shortest_paths(unknown)))
            paths = [new[s] if path is None else path for s, path in zip(stretches, paths)]
            if len(self.young) + len(new) > CACHE:
                self.old, self.young = self.young, {}
            self.young.update(islice(((s, path) for s, path in new.items() if len(s) <= LONGEST), CACHE))
        return paths

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin, with the end of the last."""
        normal = list(map(self.normalise, texts))
        # A character that no text has marks the beginnings of stretches.
        mark = next(c for c in map(chr, range(1, 0x110000)) if not any(c in t for t in normal))
        marked = [t.replace(SPACE, mark + SPACE).replace(SPACE + mark, SPACE).removeprefix(mark) for t in normal]
        parted = pc.split_pattern(pa.array(marked, pa.string()), mark)
        coded = parted.flatten().dictionary_encode()
        paths = self._paths(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum(np.fromiter(map(len, paths), np.int64, len(paths)) // 4)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.frombuffer(b"".join(paths), "<i4")))
        found = lists.take(coded.indices)
        return found.flatten().to_numpy(), found.offsets.to_numpy()[parted.offsets.to_numpy()]

    def decode_all(self, ids: np.ndarray, borders: np.ndarray) -> list[str]:
        """:meth:`decode` of each text's ids."""
        parts = self.spelt.take(pa.array(ids))
        data = (parts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        at = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1)[borders].tolist()
        return [self._plain(data[a:b]) for a, b in zip(at, at[1:])]

    def decode(self, ids: list[int]) -> str:
        """The inverse composition; bytes that are not UTF-8 become U+FFFD."""
        parts: list[bytes] = []
        for i in ids:
            if i in self.byte_of:
                parts.append(bytes([self.byte_of[i]]))
            elif i not in self.silent:
                parts.append(self.text[i].encode())
        return self._plain(b"".join(parts))

    def _plain(self, data: bytes) -> str:
        text = data.decode("utf-8", "replace")
        prefix = self.normalise.prefix
        if prefix and text.startswith(prefix):
            text = text[len(prefix) :]
        return text.replace(SPACE, " ")


@lru_cache(maxsize=2)
def machine_for(model_file: str) -> PieceMachine:
    """One machine for each worker process, so that its caches outlive a task."""
    return PieceMachine(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


SCHEMA = "doc_id long, n_pieces long, pieces_crc32 long, round_trip boolean, decoded_chars long"


def piece_report(docs: DataFrame, model_file: str | None = None, with_pieces: bool = False) -> DataFrame:
    """One row per row of ``docs``: number of pieces, crc32 of the ids as little-endian unsigned 32-bit integers, whether
    decoding gives the text back, and the decoded text's length; ``pieces array<int>`` on request.

    Null and empty texts have no pieces and decode to the empty text. A text that holds U+2581 itself decodes with a
    blank in its place and is not given back. A null doc_id stays null; repeated rows get a row each.
    """
    model_file = model_file or default_model()

    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["pieces"] * with_pieces

    def reported(machine: PieceMachine, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_text(part.column("text"))
        ids, borders = machine.encode_all(texts)
        decoded = machine.decode_all(ids, borders)
        n, chars, same = np.diff(borders), list(map(len, decoded)), [a == b for a, b in zip(decoded, texts)]
        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(borders, borders[1:])]
        out = [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.array(chars, pa.int64())]
        if with_pieces:
            out.append(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32())))
        return pa.RecordBatch.from_arrays(out, names=names)

    @tidied
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_for(model_file)
        for part in text_portions(batches, TEXT_AT_ONCE):
            yield reported(machine, part)

    return docs.select("doc_id", "text").mapInArrow(report, SCHEMA + (", pieces array<int>" if with_pieces else ""))
