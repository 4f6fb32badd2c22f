"""SentencePiece encoding and decoding through a relational lattice.

Text is cut where no piece of the vocabulary spans the cut, so that the parts ("words") can be encoded apart and each distinct one
only once. A distinct word's substrings up to the longest piece are exploded and equi-joined to the piece table; the
matches are the edges of the word's lattice, grouped by word and folded with a higher-order ``aggregate``.

* A unigram model is folded by Viterbi, at any length: best[i] = max over edges (s, i) of best[s] + score; of equal ones the least s, as in the library.
* A BPE model's segmentation isn't a shortest path: it applies merges in order of rank. Its fold keeps the set of cuts between
  symbols as a bit mask and takes, step by step, the best-ranked edge (the leftmost on ties) that spans exactly one cut. That gives the
  library's own ids; Viterbi over the scores wouldn't. Words above ``FOLD_CHARS`` characters, too wide for
  the mask, go through the same merges with a heap, with the same ids.

Documents aren't shuffled by word. Each is packed, in blocks of about ``BLOCK_CHARS`` of text, as numbers into its
block's own word list; the lists ask for their words' ids, and the answers meet the documents by block. What moves is little more than a
byte for each word of text, and compressed lists. Both meetings are streams sorted within a partition, so that no task holds more than one bucket's
words, or one block's answers and some documents. Texts are read once: lists and numbers go through one shuffle, which is then read for the words, for the
lists and for the documents. A block is named by its scan partition and its place there and carries a digest of its content, so blocks of equal content stay
apart and a task that is run again makes the same blocks; an input that isn't a plain scan is written to the shared folder first. A block
without all its answers, or with another reading's, is an error.

Defined cases. A null text has null ids; an empty one has none. Texts are encoded whole, at any length: a long one is cut into words
some ``SLICE_CHARS`` at a time. Repeated rows are encoded alike, each for itself. A null ``doc_id`` is kept. Characters outside the vocabulary become byte
pieces (or the unknown id in a model without
them). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textkit
from quarry.llm.common import bucket_labels, materialize, small_side

MARK = "▁"
#: Text packed into one block, at least one document; cut into words, and packed as numbers, in smaller parts.
BLOCK_CHARS, SLICE_CHARS, CHUNK_WORDS = 8 << 20, 1 << 17, 1 << 16
#: Bytes that a worker sends at once.
BATCH_BYTES = 1 << 19
#: Words of so many characters at most are folded in Spark.
FOLD_CHARS = 60
NORMAL, UNK, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    bpe: bool
    dummy_prefix: bool

    @property
    def unk(self) -> int:
        return self.kinds.index(UNK)

    @property
    def longest(self) -> int:
        return max(len(p) for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER))


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            value = struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n
        yield tag >> 3, value


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file; only the identity normaliser is handled."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, bpe, dummy = [], [], [], False, True
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(float(own.get(2, 0.0)))
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            spec = dict(_fields(value))
            dummy = bool(spec.get(3, 1))
            if spec.get(1, b"") not in (b"", b"identity") or spec.get(2, b"") or spec.get(4, 1):
                raise ValueError("only models with the identity normaliser, which keep all blanks, are handled")
    return Vocabulary(tuple(pieces), tuple(scores), tuple(kinds), bpe, dummy)


def piece_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """(piece, id, rank, place): the pieces that text can become. A lower rank is better; ``place`` counts the ranks from the best, equal ones alike."""
    if len(v.pieces) >= 1 << 20:
        raise ValueError("an edge has room for a million pieces")
    places = {r: n for n, r in enumerate(sorted({-s for s in v.scores}))}
    rows = [(p, i, -float(s), places[-s]) for i, (p, s, k) in enumerate(zip(v.pieces, v.scores, v.kinds)) if k in (NORMAL, USER)]
    return spark.createDataFrame(rows, "piece string, id int, rank double, place long")


class Cutter:
    """Cuts text where no piece spans: a table of the pairs of characters that are neighbours in some piece."""

    def __init__(self, v: Vocabulary):
        chars = sorted({c for p, k in zip(v.pieces, v.kinds) if k in (NORMAL, USER) for c in p})
        self.number = np.zeros(0x110000, dtype=np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for p, k in zip(v.pieces, v.kinds):
            if k in (NORMAL, USER):
                n = self.number[[ord(c) for c in p]]
                self.joined[n[:-1], n[1:]] = True
        self.prefix = MARK if v.dummy_prefix else ""

    def words(self, text: str, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code points of normalised text; start of each word and the end of the last); texts begin at ``begin``, which the end is part of."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        n = self.number[points]
        cut = np.ones(len(points) + 1, dtype=bool)
        if len(points) > 1:
            cut[1:-1] = ~self.joined[n[:-1], n[1:]]
        cut[begin] = True
        return points, np.flatnonzero(cut) if len(points) else np.zeros(1, dtype=np.int64)

    def parts(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, its code points, starts of its words and the end of the last, words of each of ``texts`` in it), in order.

        Short texts are taken together; a long one comes in parts that end between words, a word that isn't complete going to the next.
        """
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE_CHARS):
                size += len(texts[b])
                b += 1
            counts = np.zeros(len(texts), dtype=np.int64)
            if size <= SLICE_CHARS:
                whole = [(self.prefix + t.replace(" ", MARK)) if t else "" for t in texts[a:b]]
                begin = np.concatenate(([0], np.cumsum([len(t) for t in whole]))).astype(np.int64)
                joined = "".join(whole)
                points, starts = self.words(joined, begin)
                counts[a:b] = np.diff(np.searchsorted(starts, begin))
                yield joined, points, starts, counts
            else:
                left, text = self.prefix, texts[a]
                for at in range(0, len(text), SLICE_CHARS):
                    own = left + text[at : at + SLICE_CHARS].replace(" ", MARK)
                    points, starts = self.words(own, np.array([0, len(own)]))
                    if at + SLICE_CHARS < len(text):
                        left, starts = own[starts[-2] :], starts[:-1]
                    counts[a] = len(starts) - 1
                    yield own, points, starts, counts
            a = b


def _hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial."""
    textkit._grow(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * textkit._powers[: len(points)], out=sums[1:])
    return textkit.mix((sums[starts[1:]] - sums[starts[:-1]]) * textkit._inverse[starts[:-1]])


def _number(hashes: np.ndarray, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's text, a word of each number): equal texts have equal numbers. Hashes find them; characters are compared, so collisions do no harm."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(hashes)
    own = hashes[order]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    first, at = order[new], np.empty(len(order), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    length, model = np.diff(starts), first[at]
    same = bool((length[model] == length).all())
    for a in range(0, len(length) if same else 0, 50_000):
        b = min(a + 50_000, len(length))
        shift = np.repeat(starts[model[a:b]] - starts[a:b], length[a:b])
        if not (points[np.arange(starts[a], starts[b]) + shift] == points[starts[a] : starts[b]]).all():
            same = False
            break
    if same:
        return at, first
    numbers: dict[bytes, int] = {}
    at = np.array([numbers.setdefault(points[a:b].tobytes(), len(numbers)) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], dtype=np.int64)
    return at, np.unique(at, return_index=True)[1]


def _characters(points: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the characters of these words in a row, the length of each)."""
    n = starts[which + 1] - starts[which]
    return points[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


@lru_cache(maxsize=4)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed run of bytes; whole numbers of four bytes go by planes, which pack best."""
    parts = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() if x.itemsize == 4 else x.tobytes() for x in arrays]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + _compressor(3).compress(b"".join(parts))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = struct.unpack(f"<{len(kinds)}I", data[: 4 * len(kinds)])
    plain, at, out = zstandard.ZstdDecompressor().decompress(data[4 * len(kinds) :]), 0, []
    for kind, n in zip(kinds, sizes):
        own = np.frombuffer(plain, dtype=np.uint8, count=n, offset=at)
        at += n
        out.append(np.ascontiguousarray(own.reshape(4, -1).T).view(kind).ravel() if np.dtype(kind).itemsize == 4 else own.view(np.uint8).copy().view(kind))
    return out


def _list(words: list[str]) -> bytes:
    text = "\x00".join(words)
    if "\x01" in text or text.count("\x00") != len(words) - 1:
        text = "\x00".join(w.replace("\x01", "\x01b").replace("\x00", "\x01a") for w in words)
    return _compressor(9).compress(text.encode())


def _unlist(data: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(data).decode()
    words = text.split("\x00")
    return [w.replace("\x01a", "\x00").replace("\x01b", "\x01") for w in words] if "\x01" in text else words


#: Rows of a block: kind 0 answers, by bucket; kind 1 its head; kind 2 documents, in order.
_BLOCKS = "block long, kind int, place int, data binary"
_ASKS = "block long, bucket int, data binary"
#: Kind 3, lists of words, at home in their bucket; rows of a block, at home where the block is.
_PACKED = "home long, block long, kind int, place int, data binary"
ASK = 3
_names = lambda schema: [c.split(" ")[0] for c in schema.split(", ")]


class _Block:
    """What is known of the block that is being packed: each slice's distinct words, and where the text has them."""

    def __init__(self):
        self.hashes: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)]
        self.points: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)]
        self.lengths: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        self.known = 0
        self.digest = hashlib.blake2b(digest_size=8)
        self.size = 0
        self.ordered: tuple | None = None
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.texts: list[bytes] = []
        self.words: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, cutter: Cutter, ids: list, texts: list, keep: bool) -> None:
        first = len(self.counts)
        self.ids += ids
        self.counts += [0 if t is not None else -1 for t in texts]
        if keep:
            self.texts += [_digest((t or "").encode()) for t in texts]
        self.digest.update(repr(ids).encode())
        for _, points, starts, counts in cutter.parts([t or "" for t in texts]):
            self.digest.update(points)
            for i in np.flatnonzero(counts).tolist():
                self.counts[first + i] += int(counts[i])
            if len(starts) > 1:
                hashes = _hashes(points, starts)
                at, which = _number(hashes, points, starts)
                own, lengths = _characters(points, starts, which)
                self.hashes.append(hashes[which])
                self.points.append(own)
                self.lengths.append(lengths)
                if keep:
                    self.words.append((at + self.known).astype(np.uint32))
                    self.times.append(np.bincount(at, minlength=len(which)))
                self.known += len(which)
        self.size += sum(len(t or "") for t in texts)

    def order(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each slice's word in the block; by number, in the order in which they are asked for, by bucket and text: bucket, characters in a row and lengths; that order)."""
        if self.ordered is not None:
            return self.ordered
        hashes, points, lengths = (np.concatenate(x) for x in (self.hashes, self.points, self.lengths))
        self.hashes, self.points, self.lengths = [], [], []
        starts = np.concatenate(([0], np.cumsum(lengths)))
        at, which = _number(hashes, points, starts)
        home = labels[hashes[which] % np.uint64(len(labels))]
        # by the first eight characters, which is enough for lists that pack well; equal ones as they are numbered
        keys, n = [], lengths[which]
        for a in (4, 0):
            key = np.zeros(len(which), dtype=np.uint64)
            for i in range(a, a + 4):
                there = n > i
                key[there] |= np.minimum(points[starts[which[there]] + i], 65_535).astype(np.uint64) << np.uint64(16 * (a + 3 - i))
            keys.append(key)
        order = np.lexsort((*keys, home))
        self.ordered = at, home[order], *_characters(points, starts, which[order]), order
        return self.ordered

    def asks(self, labels: np.ndarray) -> Iterator[tuple[int, bytes]]:
        _, home, points, lengths, _ = self.order(labels)
        own, text = self.digest.digest(), points.tobytes().decode("utf-32-le")
        ends = np.cumsum(lengths)
        words = [text[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
        edge = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True]))) if len(home) else [0]
        for a, b in zip(edge[:-1], edge[1:]):
            yield int(home[a]), own + _list(words[a:b])

    def rows(self, labels: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(kind, place, data): the words' counts, in the order asked for, then the documents in chunks. Frequent words get small numbers, which pack best."""
        at, *_, order = self.order(labels)
        asked = np.bincount(at, np.concatenate([np.zeros(0), *self.times]), minlength=len(order)).astype(np.int64)[order]
        rank = np.zeros(len(order), dtype=np.uint32)
        rank[order] = _ranks(asked)
        rank = rank[at]
        yield 1, 0, self.digest.digest() + _pack(asked.astype(np.uint32))
        counts = np.array(self.counts, dtype=np.int32)
        ends = np.cumsum(np.maximum(counts, 0))
        left: list[np.ndarray] = []
        self.words.reverse()
        a = place = 0
        while a < len(counts):
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + CHUNK_WORDS, "right")))
            n, got = int(ends[b - 1]) - before, sum(map(len, left))
            while got < n:
                left.append(self.words.pop())
                got += len(left[-1])
            own = np.concatenate(left) if left else np.zeros(0, dtype=np.uint32)
            left = [own[n:]]
            ids = self.ids[a:b]
            yield 2, place, _pack(np.array([x is None for x in ids]), np.array([x or 0 for x in ids], dtype=np.int64), counts[a:b], np.frombuffer(b"".join(self.texts[a:b]), dtype=np.uint8), rank[own[:n]])
            a, place = b, place + 1


def _ranks(times: np.ndarray) -> np.ndarray:
    """The number of each word: frequent ones first, ties as they stand."""
    rank = np.empty(len(times), dtype=np.uint32)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(times), dtype=np.uint32)
    return rank


def _together(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows whose last column has some ``BATCH_BYTES`` together, at least one."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _packer(cutter: Cutter, labels: np.ndarray, asks: bool | None = None):
    """A block's distinct words by bucket (``asks``), or its rows of kinds 1 and 2; by default both, each with its home."""

    def flush(block: _Block, name: int) -> Iterator[pa.RecordBatch]:
        if asks is None:
            both = chain(((home, ASK, 0, data) for home, data in block.asks(labels)), ((name, *row) for row in block.rows(labels)))
            for rows in _together(both):
                home, kind, place, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), pa.array([name] * len(rows), pa.int64()), pa.array(kind, pa.int32()), pa.array(place, pa.int32()), pa.array(data, pa.binary())], _names(_PACKED))
            return
        for rows in _together(block.asks(labels) if asks else block.rows(labels)):
            *head, data = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), *(pa.array(x, pa.int32()) for x in head), pa.array(data, pa.binary())], _names(_ASKS if asks else _BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name = _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            at, size = 0, np.asarray(pc.fill_null(pc.utf8_length(batch.column(1)), 0)).astype(np.int64)
            while at < batch.num_rows:
                # as many rows as a slice holds, and no more than still go into the block
                room = min(SLICE_CHARS, BLOCK_CHARS - block.size)
                n = int(np.searchsorted(np.cumsum(size[at : at + 2000]), room, "right"))
                if not n and block.ids:
                    if block.size + size[at] > BLOCK_CHARS:
                        yield from flush(block, name)
                        block, name = _Block(), name + 1
                        continue
                n = max(n, 1)
                part = batch.slice(at, n)
                block.add(cutter, part.column(0).to_pylist(), part.column(1).to_pylist(), not asks)
                at += n
        if block.ids:
            yield from flush(block, name)

    return run


def _all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of the lists in a batch."""
    for batch in batches:
        words: dict[int, dict[str, None]] = {}
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            words.setdefault(bucket, {}).update(dict.fromkeys(_unlist(data[8:])))
        for bucket, own in words.items():
            each = list(own)
            for a in range(0, len(each), 20_000):
                part = each[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(part), pa.int64()), pa.array(part, pa.string())], ["bucket", "word"])


def _long_encoder(v: Vocabulary, by_score: bool = False):
    """Merges with a heap, for words that are too wide for the mask; Viterbi for a unigram model, or ``by_score``, to compare with."""
    normal = {p: (-s, i) for i, (p, s, k) in enumerate(zip(v.pieces, v.scores, v.kinds)) if k in (NORMAL, USER)}
    byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == BYTE}

    def singles(text: str) -> list[int]:
        found = normal.get(text)
        return [found[1]] if found else [byte[b] for b in text.encode()] if byte else [v.unk]

    def merges(word: str) -> list[int]:
        n = len(word)
        parts, after, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := normal.get(parts[i] + parts[j])):
                heapq.heappush(heap, (found[0], i, len(parts[i]), len(parts[j])))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or len(parts[i]) != a or len(parts[j]) != b:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for p in parts if p for x in singles(p)]

    def viterbi(word: str) -> list[int]:
        longest, worst = v.longest, max(r for r, _ in normal.values()) + 10
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            best.append(min((best[s][0] + (normal[p][0] if (p := word[s:e]) in normal else worst), s) for s in range(max(0, e - longest), e) if e - s == 1 or word[s:e] in normal))
        out, e = [], len(word)
        while e:
            out.append(word[best[e][1] : e])
            e = best[e][1]
        return [x for p in reversed(out) for x in singles(p)]

    return merges if v.bpe and not by_score else viterbi


def word_ids(words: DataFrame, v: Vocabulary) -> DataFrame:
    """(bucket, word, ids) of the distinct ``words(bucket, word)``, by lattice and fold; ids are null above ``FOLD_CHARS`` characters of a BPE model."""
    spark = words.sparkSession
    pieces = piece_table(spark, v)
    # a word that is too wide for the mask goes along with its first character only, so that ``words`` isn't made twice
    n = f"if(length(word) <= {FOLD_CHARS}, length(word), 1)" if v.bpe else "length(word)"
    spans = words.selectExpr("bucket", "word", f"{n} as n").selectExpr("bucket", "word", "n", "explode(sequence(0, n - 1)) as s").selectExpr("bucket", "word", "n", "s", f"explode(sequence(s + 1, least(n, s + {v.longest}))) as e")
    spans = spans.selectExpr("bucket", "word", "n", "s", "e", "substring(word, s + 1, e - s) as piece")
    # a single character always has an edge, if only one without a piece; all stays where ``distinct`` put the word
    found = spans.join(small_side(pieces, len(v.pieces), 64), "piece", "left").where("id is not null or e - s = 1")
    bytes_at = v.kinds.index(BYTE) if BYTE in v.kinds else None
    at = "substring(word, {s} + 1, 1)"
    # for the place ``{s}`` of a character without a piece
    fallback = f"array({v.unk})" if bytes_at is None else f"transform(sequence(1, octet_length({at})), k -> {bytes_at} + cast(conv(substring(hex(encode({at}, 'UTF-8')), 2 * k - 1, 2), 16, 10) as int))"
    if v.bpe:
        # an edge is one number, in the order of merging: place of the rank, start, length, piece (0 for none)
        edge = "coalesce(place, 0L) * 4294967296 + s * 67108864L + (e - s) * 1048576L + coalesce(id + 1, 0)"
        edges = found.selectExpr("bucket", "word", "n", f"{edge} as edge", "e - s > 1 as wide").groupBy("bucket", "word", "n").agg(F.collect_list(F.expr("if(wide, null, edge)")).alias("chars"), F.sort_array(F.collect_list(F.expr("if(wide, edge, null)"))).alias("merges"))
        start, length = (lambda x: f"cast(shiftright({x}, 26) & 63 as int)"), (lambda x: f"cast(shiftright({x}, 20) & 63 as int)")
        # The cuts: bit i is set if a symbol begins at i. ``seen`` are those from an edge's start on, up to its end; it merges if they
        # are its two ends and one between.
        seen = lambda cuts, x: f"(shiftright({cuts}, {start(x)}) & (shiftleft(2L, {length(x)}) - 1))"
        ends = lambda x: f"(shiftleft(1L, {length(x)}) + 1)"
        both = lambda cuts, x: f"(shiftright({cuts}, {start(x)}) & {ends(x)}) = {ends(x)}"
        one = lambda cuts, x: f"bit_count({seen(cuts, x)}) = 3 and {both(cuts, x)}"
        without = lambda cuts, x: f"{cuts} & ~shiftleft(shiftleft(1L, {length(x)} - 1) - 1, {start(x)} + 1)"
        # Edges come in rank order. One that spans a single cut merges; one that spans more would wait, and be looked at again after
        # every later merge, since merging may have brought it to a single cut. Few words have any that waits: their first fold sets bit
        # 62, which is no cut, and they are folded again with the edges that wait.
        first = f"aggregate(merges, shiftleft(1L, n + 1) - 1, (a, x) -> case when bit_count({seen('a', 'x')}) < 3 or not ({both('a', 'x')}) then a when bit_count({seen('a', 'x')}) = 3 then {without('a', 'x')} else a | shiftleft(1L, 62) end)"
        settle = f"aggregate(a.wait, {without('a.cuts', 'x')}, (m, _i) -> coalesce(get(transform(filter(a.wait, y -> {one('m', 'y')}), y -> {without('m', 'y')}), 0), m))"
        step = f"case when bit_count({seen('a.cuts', 'x')}) < 3 or not ({both('a.cuts', 'x')}) then a when bit_count({seen('a.cuts', 'x')}) = 3 then named_struct('cuts', {settle}, 'wait', a.wait) else named_struct('cuts', a.cuts, 'wait', concat(a.wait, array(x))) end"
        again = f"aggregate(merges, named_struct('cuts', shiftleft(1L, n + 1) - 1, 'wait', slice(merges, 1, 0)), (a, x) -> {step}, a -> a.cuts)"
        cuts = edges.selectExpr("bucket", "word", "n", "chars", "merges", f"{first} as once").selectExpr("bucket", "word", "n", "chars", "merges", f"if(once >= shiftleft(1L, 62), {again}, once) as cuts")
        # without its rank an edge stands in the order of the text
        used = cuts.selectExpr("bucket", "word", "n", f"sort_array(transform(filter(concat(merges, chars), x -> {seen('cuts', 'x')} = {ends('x')}), x -> x & 4294967295)) as used")
        piece = "cast((x & 1048575) - 1 as int)"
        return used.selectExpr("bucket", "word", f"case when n < length(word) then null when exists(used, x -> (x & 1048575) = 0) then flatten(transform(used, x -> if((x & 1048575) > 0, array({piece}), {fallback.format(s=start('x'))}))) else transform(used, x -> {piece}) end as ids")
    else:
        worst = max(-s for s, k in zip(v.scores, v.kinds) if k in (NORMAL, USER)) + 10
        # the edges by their end, so that each is looked at once
        ends = found.groupBy("bucket", "word", "e").agg(F.collect_list(F.struct("rank", "s", "id")).alias("edges"))
        ends = ends.groupBy("bucket", "word").agg(F.array_sort(F.collect_list(F.struct("e", "edges"))).alias("ends"))
        best = f"array_min(transform(x.edges, y -> struct(acc[y.s].cost + coalesce(y.rank, {worst}D) as cost, y.s as s, y.id as id)))"
        folded = ends.selectExpr("bucket", "word", f"aggregate(ends, array(struct(0D as cost, 0 as s, cast(null as int) as id)), (acc, x) -> concat(acc, array({best}))) as best")
        folded = folded.selectExpr("bucket", "word", "aggregate(sequence(1, length(word)), named_struct('at', length(word), 'path', cast(array() as array<struct<cost:double,s:int,id:int>>)), (a, _i) -> if(a.at = 0, a, named_struct('at', best[a.at].s, 'path', concat(array(best[a.at]), a.path)))).path as path")
        return folded.selectExpr("bucket", "word", f"flatten(transform(path, x -> if(x.id is not null, array(x.id), {fallback.format(s='x.s')}))) as ids")


class _Words:
    """The ids of words (numbered as they come), and of lists of them."""

    def __init__(self):
        self.lengths, self.values, self.place = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], {}

    def add(self, words: list[str], lengths: np.ndarray, values: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.lengths.append(lengths.astype(np.int64))
        self.values.append(values.astype(np.int32))

    def close(self) -> None:
        self.size, self.ids = np.concatenate(self.lengths), np.concatenate(self.values)
        self.offset = np.cumsum(self.size) - self.size
        self.lengths, self.values = [], []

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in each word, the ids) of the words with these numbers."""
        n = self.size[at]
        return n, self.ids[np.repeat(self.offset[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _answer(wide):
    """Each block's list for a bucket, answered in its order: lengths and ids. A bucket's words (kind 0) come before its lists; words that have no ids yet are encoded here."""

    def answers(known: _Words, part: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        for block, data in zip(part.column(2).to_pylist(), part.column(5).to_pylist()):
            words = _unlist(data[8:])
            n, ids = known.of(np.fromiter(map(known.place.__getitem__, words), dtype=np.int64, count=len(words)))
            yield block, data[:8] + _pack(n.astype(np.uint32), ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known, listed = None, _Words(), False
        for batch in batches:
            buckets, kinds = (np.asarray(batch.column(i)) for i in (0, 1))
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(buckets) != 0) | (np.diff(kinds) != 0), [True]))) if len(buckets) else [0]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if buckets[a] != bucket:
                    bucket, known, listed = buckets[a], _Words(), False
                part = batch.slice(a, b - a)
                if not kinds[a]:
                    words, ids = part.column(3).to_pylist(), part.column(4)
                    if ids.null_count:
                        ids = pa.array([wide(w) if x is None else x for w, x in zip(words, ids.to_pylist())], pa.list_(pa.int32()))
                    known.add(words, np.asarray(pc.list_value_length(ids)), np.asarray(pc.list_flatten(ids)))
                    continue
                if not listed:
                    known.close()
                    listed = True
                for rows in _together(answers(known, part)):
                    blocks, data = zip(*rows)
                    yield pa.RecordBatch.from_arrays([*[pa.array(blocks, pa.int64())] * 2, pa.array([0] * len(rows), pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array(data, pa.binary())], _names(_PACKED))

    return run


def _unblock(v: Vocabulary):
    """The documents of each block with their ids, and whether these decode to the text; rows come sorted by block, kind and place."""
    table = _bytes_of(v)
    piece_size = np.array([len(x) for x in table], dtype=np.int32)
    piece_at = (np.cumsum(piece_size) - piece_size).astype(np.int32)
    pieces = np.frombuffer(b"".join(table), dtype=np.uint8)
    skip = int(v.dummy_prefix)

    def documents(words: _Words, data: bytes) -> pa.RecordBatch:
        missing, doc_ids, counts, digests, seq = _unpack(data, np.bool_, np.int64, np.int32, np.uint8, np.uint32)
        lengths, ids = words.of(seq.astype(np.int64))
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(np.maximum(counts, 0))))]
        text = []
        for at in range(0, len(ids), CHUNK_WORDS):
            own = ids[at : at + CHUNK_WORDS]
            n = piece_size[own]
            text.append(pieces[np.repeat(piece_at[own] - (np.cumsum(n, dtype=np.int32) - n), n) + np.arange(n.sum(), dtype=np.int32)])
        text = memoryview(np.concatenate(text)) if text else memoryview(b"")
        to = np.concatenate(([0], np.cumsum(piece_size[ids], dtype=np.int64)))[ends].tolist()
        digests = digests.tobytes()
        same = [_digest(text[min(a + skip, b) : b]) == digests[8 * i : 8 * i + 8] for i, (a, b) in enumerate(zip(to[:-1], to[1:]))]
        null = counts < 0
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(null, False)), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=missing), lists, pa.array(same, pa.bool_(), mask=null)], ["doc_id", "ids", "round_trip"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, marks, ready = None, _Words(), set(), False
        for batch in batches:
            for i in range(batch.num_rows):
                name, kind, data = (batch.column(k)[i].as_py() for k in (1, 2, 4))
                if name != block:
                    block, words, marks, ready = name, _Words(), set(), False
                if kind == 0:
                    lengths, ids = _unpack(data[8:], np.uint32, np.int32)
                    words.add([], lengths, ids)
                    marks.add(data[:8])
                elif kind == 1:
                    (times,) = _unpack(data[8:], np.uint32)
                    size, ids = np.concatenate(words.lengths), np.concatenate(words.values)
                    if len(size) != len(times) or marks - {data[:8]}:
                        raise RuntimeError("a block lacks answers, or has another's: its input changed while it was read")
                    words.close()
                    order = np.argsort(_ranks(times.astype(np.int64)))
                    words.size, words.offset = words.size[order], words.offset[order]
                    ready = True
                elif not ready:
                    raise RuntimeError("a block lacks its head")
                else:
                    yield documents(words, data)

    return run


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is only a projection or filter of files, so that reading it again gives the same rows in the same order."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.child()
    return node.nodeName() in ("LogicalRelation", "RelationV2", "DataSourceV2ScanRelation") or node.nodeName().startswith("Relation")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, round_trip) of every row; ``round_trip`` tells whether the ids decode to the very text."""
    v = load(model_path)
    cutter = Cutter(v)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not _is_scan(slim):
        slim = materialize(slim, "piece-input")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = bucket_labels(docs.sparkSession, buckets, "long")
    # everything about words stays where the bucket is: only lists and distinct words move
    packed = slim.mapInArrow(textkit.releasing(_packer(cutter, labels)), _PACKED).repartition(buckets, "home")
    # The condition is one that isn't moved below the shuffle, and every column is used: else there would be a shuffle, and a reading of the texts, for each use.
    asks, rows = (packed.where(f"(kind + cast(rand(0) as int) = {ASK}) = {x}") for x in ("true", "false"))
    words = asks.mapInArrow(textkit.releasing(_all_words), "bucket long, word string").repartition(buckets, "bucket").distinct()
    known = word_ids(words, v).selectExpr("bucket", "0 as kind", "cast(null as long) as block", "word", "ids", "cast(null as binary) as data", "0 as place")
    lists = asks.selectExpr("home as bucket", "kind", "block", "cast(null as string) as word", "cast(null as array<int>) as ids", "data", "place")
    met = known.unionAll(lists).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    answers = met.mapInArrow(textkit.releasing(_answer(_long_encoder(v))), _PACKED)
    # each side is shuffled before they meet: a block's name is its partition's number, which a union would change
    blocks = answers.repartition(buckets, "home").unionAll(rows).repartition(buckets, "home").sortWithinPartitions("home", "kind", "place")
    return blocks.mapInArrow(textkit.releasing(_unblock(v)), "doc_id long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): pieces and byte pieces in a row, the mark as a blank, the leading one dropped. Null ids give null."""
    v = load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decode_ids(v, x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


@lru_cache(maxsize=4)
def _bytes_of(v: Vocabulary) -> tuple[bytes, ...]:
    return tuple(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNK else p.replace(MARK, " ").encode() for p, k in zip(v.pieces, v.kinds))


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    table = _bytes_of(v)
    data = b"".join([table[i] for i in ids])
    return (data[1:] if v.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")
