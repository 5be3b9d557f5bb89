"""Byte-level BPE: encode and decode whole texts with a public vocabulary.

Every match of the split pattern is merged by itself. A segment tree over its byte positions holds
the rank of each neighbouring pair, with the position as tie-break, so its root is the leftmost
pair of least rank. A merge changes three leaves and the logarithmic path above each. The trees of
many pieces are rows of one array and take their next merge together; narrow trees get all their
levels anew, which is cheaper in an array than three paths.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barworks.llm.arrow import as_bytes, prepared
from barworks.llm.shingles import mix

GROUP_PIECES = 250_000  # pieces of texts that are encoded together, about
PIECE_CHARS = 4  # of a piece, about
CACHED_PIECES = 500_000  # distinct pieces that a Python worker remembers
TREE_CELLS = 1 << 16  # leaves of all trees that merge together
NARROW = 32  # leaves of a tree that gets all its levels anew
NONE = np.int64(1) << np.int64(62)
# The split pattern whose matches are runs of one class of characters.
RUNS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, DIGIT, OTHER, SPACE, STOP = range(5)
# Bits of the first and second eight bytes that belong to a piece, by its length up to 16.
KEPT = np.array([[(1 << 8 * min(max(n - 8 * i, 0), 8 - i)) - 1 for n in range(17)] for i in range(2)], dtype=np.uint64)


class Vocabulary:
    """Token ids by bytes, and the merges they imply. ``path`` names a rank file: base64 bytes and
    rank per line, every single byte among them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32) | right)
                    merged.append(rank)
        # Pairs of single bytes are looked up for every position, so they have a table of their own.
        self.of_bytes = np.full((256, 256), -1, dtype=np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.of_bytes[token[0], token[1]] = rank
        order = np.argsort(np.array(pairs, dtype=np.int64))
        self.pairs = np.append(np.array(pairs, dtype=np.int64)[order], NONE)
        self.merged = np.append(np.array(merged, dtype=np.int64)[order], -1)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair is no token."""
        pair = (left << 32) | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.merged[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out = [b"" if whole is None else whole.to_bytes(4, "little") for whole in map(self.ranks.get, pieces)]
        left = np.array([i for i, ids in enumerate(out) if not ids and pieces[i]], dtype=np.int64)
        lengths = np.array([len(pieces[i]) for i in left], dtype=np.int64)
        widths = np.frexp(np.maximum(lengths - 1, 0).astype(float))[1]  # bits of length - 1
        for bit in np.unique(widths).tolist():
            # Pieces of like length need like numbers of merges.
            members = left[widths == bit]
            members = members[np.argsort(lengths[widths == bit], kind="stable")].tolist()
            step = max(1, TREE_CELLS >> bit)
            for start in range(0, len(members), step):
                some = members[start : start + step]
                for i, ids in zip(some, self._merge([pieces[i] for i in some], 1 << bit)):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        count, lengths = len(pieces), np.array([len(p) for p in pieces])
        raw = np.zeros((count, width), dtype=np.uint8)
        inside = np.arange(width) < lengths[:, None]
        raw[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        # Cell (row, position) of these is at row * width + position.
        token = self.of_byte[raw].ravel()
        after = np.tile(np.arange(1, width + 1), count)
        before = np.tile(np.arange(-1, width - 1), count)
        # Leaf: rank of the pair that begins here, then its position; inner node: least of its two.
        tree = np.full((count, 2 * width), NONE, dtype=np.int64)
        if width > 1:
            rank = self.of_bytes[raw[:, :-1], raw[:, 1:]]
            good = (rank >= 0) & inside[:, 1:]
            tree[:, width : 2 * width - 1] = np.where(good, (rank << 32) | np.arange(width - 1), NONE)
        self._levels(tree, width)
        flat = tree.ravel()
        alive = inside.ravel().copy()
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            best, cell, node = tree[rows, 1], rows * width, rows * 2 * width + width
            at, rank = best & 0xFFFFFFFF, best >> 32
            gone = after[cell + at]
            right, left = after[cell + gone], before[cell + at]
            token[cell + at] = rank
            alive[cell + gone] = False
            after[cell + at] = right
            has_right, has_left = right < lengths[rows], left >= 0
            before[(cell + right)[has_right]] = at[has_right]
            flat[node + gone] = NONE
            flat[node + at] = self._leaf(rank, token[np.where(has_right, cell + right, cell)], at, has_right)
            flat[(node + left)[has_left]] = self._leaf(token[cell + np.where(has_left, left, 0)], rank, left, has_left)[has_left]
            if width <= NARROW:
                self._levels(tree, width)
            else:
                paths = [width + at, width + gone, width + np.where(has_left, left, at)]
                for _ in range(width.bit_length() - 1):
                    paths = [p >> 1 for p in paths]
                    for p in paths:
                        tree[rows, p] = np.minimum(tree[rows, 2 * p], tree[rows, 2 * p + 1])
            rows = rows[tree[rows, 1] < NONE]
        ids = token[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.reshape(count, width).sum(axis=1)) * 4
        starts = np.concatenate(([0], ends[:-1]))
        return [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    @staticmethod
    def _levels(tree: np.ndarray, width: int) -> None:
        """All inner nodes from the leaves."""
        level = width
        while level > 1:
            half = level // 2
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
            level = half

    def _leaf(self, first, second, at, ok) -> np.ndarray:
        rank = self.rank_of(first, second)
        return np.where(ok & (rank >= 0), (rank << 32) | at, NONE)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary_size(path: str) -> int:
    """One above the largest id of a rank file."""
    with open(path, "rb") as lines:
        return 1 + max(int(line.split()[1]) for line in lines if line.strip())


class Splitter:
    """All matches of a split pattern. The standard library has no property classes but is faster,
    so texts of characters on which its own classes are the same go through it."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern).findall
        same = [(r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")]
        common = [c for c in map(chr, range(0x250)) if all(bool(regex.match(a, c)) == bool(re.match(b, c)) for a, b in same)]
        # Classes as lists of the common characters, which are one look-up in a table of bits.
        listed = {a: "".join(re.escape(c) for c in common if regex.match(a, c)) for a, _ in same}
        other = "".join(re.escape(c) for c in common if regex.match(r"[^\s\p{L}\p{N}]", c))
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[{other}]")
        for a in (r"\p{L}", r"\p{N}"):
            plain = plain.replace(a, f"[{listed[a]}]")
        self.plain = None if r"\p" in plain else re.compile(plain).findall
        self.rare = re.compile(f"[^{''.join(map(re.escape, common))}]").search

    def __call__(self, text: str) -> list[str]:
        return self.full(text) if self.plain is None or self.rare(text) else self.plain(text)


class Cutter:
    """Where the matches of a split pattern lie in the UTF-8 bytes of many texts.

    Matches of :data:`RUNS` follow from the classes of neighbouring characters: they are runs of one
    class, a run takes a blank before it along, and white space leaves its last character to the run
    after it. So they are found in arrays; other patterns are matched text by text."""

    def __init__(self, pattern: str):
        self.split = Splitter(pattern)
        self.kinds = None
        if pattern == RUNS:
            every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "\uffff" for i in range(0x110000))
            self.kinds = np.full(len(every), OTHER, dtype=np.uint8)
            for kind, of in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
                for m in regex.finditer(of, every):
                    self.kinds[m.start() : m.end()] = kind

    def __call__(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, start and end of each match in them, number of matches up to the end of each text."""
        if self.kinds is None:
            found = [[p.encode() for p in self.split(t)] for t in texts]
            ends = np.cumsum(np.array([0, *(len(p) for f in found for p in f)], dtype=np.int64))
            return b"".join(p for f in found for p in f), ends[:-1], ends[1:], np.cumsum([len(f) for f in found])
        joined = "\0".join(texts) + "\0"  # a character after each text, where it stops
        stops = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
        raw = joined.encode()
        plain = len(raw) == len(joined)
        chars = np.frombuffer(raw, "u1") if plain else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = self.kinds[chars]
        kind[stops] = STOP
        begins = np.ones(len(kind), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))  # of white space, before a run
        begins[last] = True
        begins[last[chars[last] == ord(" ")] + 1] = False
        quote = np.flatnonzero(chars == ord("'"))
        quote = quote[begins[quote] & (kind[quote] == OTHER)]
        one, two = chars[quote + 1], chars[np.minimum(quote + 2, len(chars) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", "u1"))
        long = (np.isin(one, np.frombuffer(b"rv", "u1")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begins[quote[short | long] + 1] = False
        begins[quote[short] + 2] = True
        begins[quote[long] + 3] = True
        begins[stops] = True
        bounds = np.flatnonzero(begins)
        inside = kind[bounds] != STOP
        starts, ends = bounds[inside], bounds[1:][inside[:-1]]
        upto = np.searchsorted(starts, stops)
        if not plain:
            places = np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), dtype=np.int64)
            starts, ends = places[starts - 1] * (starts > 0), places[ends - 1]
        return raw, starts, ends, upto


class Numbers:
    """Numbers of pieces in the order they are first given. Up to 15 bytes and the length are the key of
    a hash table in arrays, which is searched for many pieces at once; longer pieces are in a dictionary."""

    def __init__(self):
        self.held, self.slots = 0, 1 << 12
        self.long: dict[bytes, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.low, self.high = np.zeros(self.slots, dtype=np.uint64), np.zeros(self.slots, dtype=np.uint64)
        self.number = np.full(self.slots, -1, dtype=np.int32)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) & np.uint64(self.slots - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is new."""
        at = self._home(low, high)
        out = self.number[at]
        open_ = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (self.slots - 1)
            out[open_] = self.number[at]
            more = (out[open_] >= 0) & ((self.low[at] != low[open_]) | (self.high[at] != high[open_]))
            open_, at = open_[more], at[more]
        return out

    def _put(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that are not held."""
        at = self._home(low, high)
        while len(at):
            free = np.flatnonzero(self.number[at] < 0)
            self.number[at[free]] = numbers[free]
            lost = self.number[at] != numbers
            self.low[at[~lost]], self.high[at[~lost]] = low[~lost], high[~lost]
            low, high, numbers, at = low[lost], high[lost], numbers[lost], (at[lost] + 1) & (self.slots - 1)

    def of(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Number of each piece, and the pieces that are new, in the order of their numbers."""
        words = np.frombuffer(raw + bytes(24 + -len(raw) % 8), "<u8")
        lengths, word, bits = ends - starts, starts >> 3, ((starts & 7) << 3).astype(np.uint64)
        rest = np.uint64(63) - bits
        some = [words[word + i] for i in range(3)]
        # The bits of the next word move up by 64 less ``bits``, in two steps as 64 is no shift.
        low, high = (((some[i] >> bits) | (some[i + 1] << rest << np.uint64(1))) & KEPT[i][np.minimum(lengths, 16)] for i in range(2))
        high |= lengths.astype(np.uint64) << np.uint64(56)
        short = lengths < 16
        out = np.empty(len(starts), dtype=np.int64)
        fresh: list[bytes] = []
        for i in np.flatnonzero(~short).tolist():
            piece = raw[starts[i] : ends[i]]
            found = self.long.setdefault(piece, self.held)
            if found == self.held:
                self.held += 1
                fresh.append(piece)
            out[i] = found
        some = np.flatnonzero(short)
        low, high = low[some], high[some]
        found = self._find(low, high)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
            found[order] = self.held + np.cumsum(first) - 1
            firsts = order[first]
            fresh += [raw[a:b] for a, b in zip(starts[some[firsts]].tolist(), ends[some[firsts]].tolist())]
            self.held += len(firsts)
            if 2 * self.held > self.slots:
                kept = np.flatnonzero(self.number >= 0)
                held = self.low[kept], self.high[kept], self.number[kept]
                self.slots = 1 << (4 * self.held).bit_length()
                self._empty()
                self._put(*held)
            self._put(low[firsts], high[firsts], found[firsts])
        out[some] = found
        return out, fresh


class Encoder:
    """Encodes texts piece by piece and remembers pieces up to a bound. A piece has a number, under
    which its ids are kept, so that pieces are looked up and their ids gathered for many texts at once."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.cut = vocabulary, Cutter(pattern)
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.ids, self.ends = np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text. Texts are taken in groups, so new pieces are merged together."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_PIECES * PIECE_CHARS:
                yield from self._encoded(group)
                group, size = [], 0
        if group:
            yield from self._encoded(group)

    def _encoded(self, group: list[str]) -> Iterator[bytes]:
        raw, starts, ends, upto = self.cut(group)
        pieces, fresh = self.numbers.of(raw, starts, ends)
        if fresh:
            found = self.vocabulary.encode_pieces(fresh)
            counts = np.array([len(ids) // 4 for ids in found])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), dtype="<u4")])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        first, n = self.ends[pieces], self.ends[pieces + 1] - self.ends[pieces]
        behind = np.cumsum(n)
        ids = self.ids[np.repeat(first - behind + n, n) + np.arange(n.sum())].tobytes()
        cuts = np.append(0, 4 * np.append(0, behind)[upto]).tolist()
        if self.numbers.held > CACHED_PIECES:
            self._forget()
        yield from (ids[a:b] for a, b in zip(cuts, cuts[1:]))


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> Encoder:
    """The encoder that all tasks of a Python worker share."""
    return Encoder(Vocabulary(path), pattern)


def encode_texts(
    docs: DataFrame, path: str, pattern: str, then: Callable | None = None, schema: str = "ids binary", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, columns of ``keep``, columns of ``schema``) per document, in one pass without a shuffle.

    ``then(ids, vocabulary)`` makes the columns from the ids of a text, which are little-endian
    unsigned 32-bit integers; by default they are returned as they are. Null texts count as empty
    and give no ids. Rows are independent: repeated ones give repeated results, columns that are not
    in ``keep`` are ignored, an empty table gives an empty result. Texts of any length are encoded whole.
    """
    make = then or (lambda ids, _: (ids,))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        vocabulary = encoder.vocabulary
        for batch in batches:
            texts = (t or "" for t in batch.column("text").to_pylist())
            rows = [make(ids, vocabulary) for ids in encoder.encode(texts)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            along = [batch.column(c) for c in passed]
            yield pa.RecordBatch.from_arrays([*along, *columns], [*passed, *names])

    prepared(docs.sparkSession)
    passed = ["doc_id", *keep]
    fields = docs.sparkSession.createDataFrame([], schema).schema.fields
    names = [f.name for f in fields]
    known = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [known[f.dataType.simpleString()] for f in fields]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    return source.mapInArrow(encoded, StructType([*source.schema.fields[:-1], *fields]))


def digests(ids: bytes, vocabulary: Vocabulary) -> tuple[int, str, str]:
    """Number of ids, and SHA-256 of the ids and of what they decode to."""
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(vocabulary.decode(ids)).hexdigest()


def encode_and_decode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns of ``keep``, n_tokens, ids_sha256, decoded_sha256) per document; see
    :func:`encode_texts`."""
    return encode_texts(docs, path, pattern, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep)


def decode_ids(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from rows (doc_id, ids); ids that are cut inside a character decode with
    replacement characters. Null ids give an empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            texts = [vocabulary.decode(ids).decode("utf-8", "replace") for ids in as_bytes(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")
