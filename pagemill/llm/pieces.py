"""SentencePiece encoding and decoding of whole texts by suffix-array matching.

The distinct segments of a batch are laid end to end and indexed by a suffix array. Every piece of the
vocabulary is looked up by binary search, which gives all its occurrences as one range. Each occurrence
is an edge of a lattice; edges are sorted by where they end and relaxed from left to right.

Relaxing follows from how merges work: merging adjacent symbols, best score first, yields pieces
t1..tn exactly if every neighbouring pair (ti, ti+1) stays apart when merged alone. So of all edges that
end at one place, one fits the piece that ends where it starts, and the result equals that of merging.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, text_slices

SPACE = "▁"  # what stands for a space inside pieces
UNKNOWN = -2  # a character without a piece: spelled in byte pieces
START, UNREACHED = -1, -3


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with their scores; ``usable`` ones can occur in text, ``bytes_at`` spells other characters."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    usable: tuple[bool, ...]
    control: frozenset[int]
    bytes_at: tuple[int, ...]
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model of the merging kind with byte pieces and no character rewriting."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = [p.type for p in model.pieces]
        normal, of_byte, control = 1, 6, (2, 3)
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or kinds.count(of_byte) != 256:
            raise ValueError("only merging models with 256 byte pieces are read")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that leave characters and white space as they are")
        return cls(
            tuple(p.piece for p in model.pieces),
            tuple(p.score for p in model.pieces),
            tuple(k == normal for k in kinds),
            frozenset(i for i, k in enumerate(kinds) if k in control),
            tuple(i for i, k in enumerate(kinds) if k == of_byte),
            rules.add_dummy_prefix,
        )

    @cached_property
    def rank(self) -> dict[str, float]:
        return {p: -s for p, s, u in zip(self.pieces, self.scores, self.usable) if u}

    @cached_property
    def segment(self) -> re.Pattern:
        """Stretches that no piece crosses: where no piece has a space mark behind another character, words."""
        inside = any(SPACE in p.lstrip(SPACE) for p, u in zip(self.pieces, self.usable) if u)
        return re.compile("(?s).+" if inside else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def apart(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` alone, best piece first and leftmost among equals, leaves the two pieces."""
        rank, symbols, border = self.rank, [*left, *right], len(left)
        while len(symbols) > 1:
            best, at = None, 0
            for i in range(len(symbols) - 1):
                r = rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            if at + 1 == border:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            border -= at + 1 < border
        return border == (1 if left else 0) and len(symbols) - border == (1 if right else 0)


class Encoder:
    """Encodes blocks of texts. Memory per task: the vocabulary's tables, one block, the lattice of one step of new
    segments (or of one longer segment), and a cache of pairs of fixed size."""

    CACHE_BITS = 20
    REMEMBERED = 250_000
    #: Characters of new segments whose lattice is held at once: its edges take about 100 bytes a character.
    STEP_CHARS = 1 << 17

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.v = vocabulary
        ids = [i for i, u in enumerate(v.usable) if u and v.pieces[i] and v.apart(v.pieces[i], "")]
        self.ids = np.array(ids, np.int32)
        self.lengths = np.array([len(v.pieces[i]) for i in ids], np.int32)
        self.piece_length = np.zeros(len(v.pieces) + 1, np.int32)
        self.piece_length[self.ids] = self.lengths
        alphabet = sorted({c for i in ids for c in v.pieces[i]})
        self.class_of = np.zeros(0x11_0001, np.int32)  # 0: in no piece
        self.class_of[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.longest = int(self.lengths.max(initial=1))
        self.spelled = np.zeros((len(ids), self.longest), np.int32)
        for row, i in enumerate(ids):
            self.spelled[row, : len(v.pieces[i])] = self.class_of[[ord(c) for c in v.pieces[i]]]
        self.cached = np.full(1 << self.CACHE_BITS, -1, np.int64)
        self.verdict = np.zeros(1 << self.CACHE_BITS, bool)
        self._forget()

    def _suffix_array(self, classes: np.ndarray) -> np.ndarray:
        """Positions in the order of the suffixes, compared as far as the longest piece.

        Prefix doubling that starts with as many characters as one word holds.
        """
        present = np.flatnonzero(np.bincount(classes, minlength=1))
        narrow = np.zeros(int(present.max(initial=0)) + 1, np.int64)
        narrow[present] = np.arange(1, len(present) + 1)
        bits = int(len(present)).bit_length()
        width = max(1, min(62 // bits, self.longest))
        rank = np.zeros(len(classes) + width, np.int64)
        padded = np.concatenate((narrow[classes], np.zeros(width, np.int64)))
        for i in range(width):
            rank[: len(classes)] = rank[: len(classes)] << bits | padded[i : i + len(classes)]
        rank = rank[: len(classes)]
        while width < self.longest:
            rank = np.unique(rank, return_inverse=True)[1]
            ahead = np.zeros_like(rank)
            ahead[:-width] = rank[width:]
            rank, width = rank * (int(rank.max(initial=0)) + 1) + ahead, width * 2
        return np.argsort(rank)

    def _ranges(self, classes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one place of every piece in the suffix array, all pieces searched at once."""
        n = len(order)
        padded = np.concatenate((classes, np.zeros(self.longest, classes.dtype)))
        lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
        for depth in range(self.longest):
            some = np.flatnonzero((self.lengths > depth) & (lo < hi))
            if not len(some):
                break
            want = self.spelled[some, depth]
            ends = []
            for side in (0, 1):
                a, b = lo[some].copy(), hi[some].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    below = padded[order[np.minimum(mid, n - 1)] + depth] < want + side
                    a, b = np.where(open_ & below, mid + 1, a), np.where(open_ & ~below, mid, b)
                ends.append(a)
            lo[some], hi[some] = ends
        return lo, np.maximum(lo, hi)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary.apart`` for arrays of piece ids, through the cache."""
        code = left.astype(np.int64) * len(self.v.pieces) + right
        slot = (code * 0x9E3779B97F4A7C1 >> 20) & ((1 << self.CACHE_BITS) - 1)
        missing = self.cached[slot] != code
        out = self.verdict[slot]
        if missing.any():
            new, inverse = np.unique(code[missing], return_inverse=True)
            pieces, size = self.v.pieces, len(self.v.pieces)
            verdict = np.fromiter((self.v.apart(pieces[c // size], pieces[c % size]) for c in new.tolist()), bool, len(new))
            out[missing] = verdict[inverse]
            self.cached[slot[missing]] = code[missing]
            self.verdict[slot[missing]] = out[missing]
        return out

    def _encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all segments, end of each segment's ids), by steps of about ``STEP_CHARS`` characters."""
        if not segments:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        step = (np.cumsum(sizes + 1) - sizes - 1) // self.STEP_CHARS  # by where a segment starts
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True])
        ids, widths = zip(*(self._encode_step(segments[a:b], sizes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])))
        return np.concatenate(ids), np.cumsum(np.concatenate(widths))

    def _encode_step(self, segments: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all segments, number of ids of each)."""
        codes = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        classes = self.class_of[codes]
        classes[begin + sizes] = 0
        order = self._suffix_array(classes)
        lo, hi = self._ranges(classes, order)
        found = hi - lo
        piece = np.repeat(self.ids, found)
        start = order[np.repeat(lo, found) + np.arange(len(piece)) - np.repeat(np.cumsum(found) - found, found)]
        inside = np.ones(len(codes), bool)
        inside[begin + sizes] = False
        covered = np.zeros(len(codes), bool)
        covered[start[self.piece_length[piece] == 1]] = True
        lone = np.flatnonzero(inside & ~covered)  # characters without a piece of their own
        piece = np.concatenate((piece, np.full(len(lone), UNKNOWN, np.int32)))
        start = np.concatenate((start, lone))
        end = start + np.where(piece >= 0, self.piece_length[piece], 1)
        local = end - np.repeat(begin, sizes + 1)[start]
        by_end = np.argsort(local.astype(np.uint16) if local.max(initial=0) < 1 << 16 else local, kind="stable")
        piece, start, end, local = piece[by_end], start[by_end], end[by_end], local[by_end]
        last = np.full(len(codes) + 1, UNREACHED, np.int32)
        last[begin] = START
        cuts = np.flatnonzero(np.r_[True, local[1:] != local[:-1], True]) if len(local) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            before, here = last[start[a:b]], piece[a:b]
            fits = (before == START) | (before == UNKNOWN) | ((here == UNKNOWN) & (before != UNREACHED))
            check = np.flatnonzero((before >= 0) & (here >= 0))
            fits[check] = self._apart(before[check], here[check])
            last[end[a:b][fits]] = here[fits]
        # Walk back from the ends, all segments at once.
        at, owner, steps = begin + sizes, np.arange(len(segments)), []
        while len(at):
            going = at > begin[owner]
            at, owner = at[going], owner[going]
            token = last[at]
            at = at - np.where(token >= 0, self.piece_length[token], 1)
            steps.append((owner, token, at))
        owner, token, at = (np.concatenate(x) for x in zip(*reversed(steps)))
        back = np.argsort(owner, kind="stable")
        owner, token, at = owner[back], token[back], at[back]
        width = np.ones(len(token), np.int64)
        unknown = np.flatnonzero(token == UNKNOWN)
        if len(unknown):
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes[at[unknown]].tolist()]
            width[unknown] = [len(x) for x in spelled]
            ends = np.cumsum(width)
            token = np.repeat(token, width)
            table = np.array(self.v.bytes_at, np.int32)
            for i, x in zip(unknown.tolist(), spelled):
                token[ends[i] - len(x) : ends[i]] = table[list(x)]
        return token.astype(np.int32), np.bincount(owner, width, len(segments)).astype(np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, number of ids of each). Segments of earlier blocks are remembered, up to a limit."""
        if len(self.known) > self.REMEMBERED:
            self._forget()
        occurs = []
        for text in texts:
            if text and self.v.dummy_prefix:
                text = " " + text
            parts = self.v.segment.findall(text.replace(" ", SPACE))
            occurs.append(np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts)))
        new, ends = self._encode_segments(list(islice(self.known, len(self.ends), None)))
        ids = self.flat = np.concatenate((self.flat, new))
        ends = self.ends = np.concatenate((self.ends, ends + (self.ends[-1] if len(self.ends) else 0)))
        sizes = np.diff(np.concatenate(([0], ends)))
        every = np.concatenate(occurs) if occurs else np.empty(0, np.int64)
        each = sizes[every]
        begin = np.repeat((ends - sizes)[every], each)
        flat = ids[begin + np.arange(len(begin)) - np.repeat(np.cumsum(each) - each, each)]
        bounds = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum([len(o) for o in occurs])))]
        return flat, np.diff(bounds)

    def _forget(self) -> None:
        self.known: _Numbered = _Numbered()
        self.flat, self.ends = np.empty(0, np.int32), np.empty(0, np.int64)


class _Numbered(dict):
    """Gives every new key the next number."""

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        return value


class Decoder:
    """Ids to text: byte pieces become the characters they spell (broken ones U+FFFD), control pieces nothing."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.v = vocabulary
        self.plain = ["" if i in v.control else p for i, p in enumerate(v.pieces)]
        self.raw = [x.encode("utf-8", "surrogatepass") for x in self.plain]
        self.is_byte = np.zeros(len(v.pieces), bool)
        self.is_byte[list(v.bytes_at)] = True
        for value, i in enumerate(v.bytes_at):
            self.raw[i] = bytes([value])

    def __call__(self, ids: np.ndarray) -> str:
        if self.is_byte[ids].any():
            text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        else:
            text = "".join(map(self.plain.__getitem__, ids.tolist()))
        text = text.replace(SPACE, " ")
        return text[1:] if self.v.dummy_prefix and text[:1] == " " else text


def encode(docs: DataFrame, vocabulary: Vocabulary, block_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with token_ids (array<int>) added, from the whole column ``text``; a column of that name is replaced.

    A null text has null ids, an empty one none. Texts are taken in blocks of about ``block_bytes``, so
    a task holds one block or one longer text. A narrow job, one row for each row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.drop("token_ids").withColumn("text", F.col("text").cast("string"))

    def make():
        encoder = Encoder(shared.value)  # the task's own: a worker that goes on to other stages must not hold its memory

        def one(batch: pa.RecordBatch):
            for a, b in text_slices(batch, "text", block_bytes):
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                ids, sizes = encoder([t or "" for t in texts])
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "token_ids"])

        return one

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, f"{fields}, token_ids array<int>", make)


def decode(rows: DataFrame, vocabulary: Vocabulary, block_ids: int = 1 << 18) -> DataFrame:
    """``rows`` with decoded (string) added from ``token_ids``; null ids decode to null. Rows go out by ``block_ids``."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    rows = rows.drop("decoded")

    def make():
        decoder = Decoder(shared.value)

        def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("token_ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            known = lists.is_valid().to_pylist()
            texts = [decoder(values[offsets[i] : offsets[i + 1]]) if k else None for i, k in enumerate(known)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

        def one(batch: pa.RecordBatch):
            for a, b in text_slices(batch, "token_ids", block_ids):
                yield decoded(batch.slice(a, b - a))

        return one

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_batches(rows, f"{fields}, decoded string", make)
