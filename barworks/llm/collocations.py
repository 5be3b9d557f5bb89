"""Phrase collocations by Misra-Gries summaries of hash partitions and a second pass that counts exactly.

First pass: windows of one to four words are hashed, combined in the task and dealt to hash
partitions as blocks of 32-bit keys. A partition first learns its mass, then merges its blocks into
one summary whose capacity exceeds mass / threshold: what the summary loses is less than the
threshold, so every phrase that is frequent survives. Clashing keys only add candidates.

Second pass: a Bloom filter of the survivors, of bounded size, goes to the tasks. They read the texts
again and send the phrases that pass it as text with their counts, compared word by word; the sums
are exact. All parts of a frequent phrase are frequent, so the same table has every count a score
needs.
"""

from __future__ import annotations

import itertools
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barworks.llm.arrow import as_bytes, prepared
from barworks.llm.shingles import mix
from barworks.operators.ordered import join_per_key
from barworks.session import materialize

LONGEST = 4  # words in a phrase
THRESHOLD = 30  # occurrences of a frequent phrase
PORTION = 4 << 20  # bytes of text that a task counts at a time
COUNTERS = 1 << 18  # of a summary, where the masses of the hash partitions are even
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 22
BLOCK_KEYS = 4096  # keys in a row of the shuffle
MERGE_KEYS = 1 << 20  # keys that are gathered before they are merged into the summary
KEY_BITS, PROBES = 16, 4  # of the Bloom filter
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28  # 32 MB are broadcast at most
SALTS = 8  # copies of the counts, so that cuts with a frequent part meet it in several tasks
SPREAD = 64  # preliminary rankings of a language
DROP_SHARE = 80  # a phrase goes if a longer one has so many hundredths of its occurrences
BREAK = b"\xff"  # between pieces; never part of UTF-8
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(
    string.ascii_uppercase.encode() + _SEPARATORS + b"\t", string.ascii_lowercase.encode() + BREAK * len(_SEPARATORS) + b" "
)
_GAP = re.compile(b"[ \xff]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_CAP = 1 << 31  # counters stop here, far beyond what a summary loses


def slices(data: bytes, size: int = PORTION) -> Iterator[tuple[bytes, int]]:
    """Parts of a plain text with the number of words at their head that were counted before.

    Cuts lie between pieces; in a longer piece they lie between words, and the next part repeats the
    last words, so that every window of words lies in one part.
    """
    start, lead = 0, b""
    while len(data) - start > size:
        stop = data.rfind(BREAK, start + 1, start + size)
        inside = stop < 0
        if inside:
            gap = _GAP.search(data, start + size)
            if gap is None:
                break
            stop = gap.start()
        part = lead + data[start:stop]
        yield part, len(lead.split())
        lead = b" ".join(part.rpartition(BREAK)[2].split()[1 - LONGEST :]) + b" " if inside else b""
        start = stop
    yield lead + data[start:], len(lead.split())


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
    """(language, plain texts, words counted before): texts in lower case, pieces set apart."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
            plain = text.translate(_PLAIN)
            if len(plain) > PORTION:
                yield from ((lang, part, again) for part, again in slices(plain))
                continue
            held[lang].append(plain)
            size += len(plain)
            if size >= PORTION:
                yield from ((name, BREAK.join(texts), 0) for name, texts in held.items())
                held.clear()
                size = 0
    yield from ((name, BREAK.join(texts), 0) for name, texts in held.items())


class Words:
    """The words of a portion as codes in order, 0 between pieces, and the hash of every window."""

    def __init__(self, lang: str, plain: bytes, again: int):
        code_of: dict[bytes, int] = defaultdict(itertools.count().__next__)
        code_of[BREAK]  # is given code 0
        words = plain.replace(BREAK, b" \xff ").split()
        self.codes = np.fromiter(map(code_of.__getitem__, words), dtype=np.int64, count=len(words))
        self.words = list(code_of)
        self.again = again
        seed = zlib.crc32(lang.encode())
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], dtype=np.uint64)

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, starts, hashes) of the windows inside pieces, for each number of words."""
        each = self.hashes[self.codes]
        inner = self.codes != 0
        whole, key = inner, mix(each)
        for size in range(1, LONGEST + 1):
            if size > 1:
                whole = whole[:-1] & inner[size - 1 :]
                key = mix(key[:-1] * _ODD + each[size - 1 :])
            starts = np.flatnonzero(whole)
            if self.again:
                starts = starts[starts + size > self.again]
            yield size, starts, key[starts]


def _place(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Hash partition in the high and key in the low half."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) & ~_LOW) | (keys & _LOW)


def _blocks(places: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, kind, mass, keys, counts) of sorted places: a row of mass per bucket, and rows
    of distinct keys with counts of a byte; a key with more is there several times."""
    first = np.flatnonzero(np.diff(places, prepend=places[:1] + np.uint64(1)))
    counts = np.diff(first, append=len(places))
    keys = places[first]
    times = (counts + 254) // 255
    if len(times) and times.max() > 1:
        last = np.cumsum(times) - 1
        keys = np.repeat(keys, times)
        small = np.full(len(keys), 255, dtype=np.uint8)
        small[last] = counts - 255 * (times - 1)
    else:
        small = counts.astype(np.uint8)
    bucket = (keys >> np.uint64(32)).astype(np.int32)
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    masses = np.add.reduceat(small.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(keys))
    cuts = np.concatenate([np.arange(a, b, BLOCK_KEYS) for a, b in zip(heads, ends)]) if len(heads) else heads
    edges = np.append(cuts, len(keys)).astype(np.int32)

    def binary(values: np.ndarray) -> pa.Array:
        offsets = pa.py_buffer(edges * values.itemsize)
        return pa.Array.from_buffers(pa.binary(), len(cuts), [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])

    n, m = len(heads), len(cuts)
    none = pa.array([b""] * n, pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((bucket[heads], bucket[cuts]))), pa.array(np.repeat(np.array([0, 1], np.int32), [n, m])),
            pa.array(np.concatenate((masses, np.zeros(m, np.int64)))),
            pa.concat_arrays([none, binary(keys.astype(np.uint32))]), pa.concat_arrays([none, binary(small)]),
        ],
        ["bucket", "kind", "mass", "keys", "counts"],
    )


class Summary:
    """Misra-Gries counters over the blocks of a hash partition of known mass.

    ``lost`` is what any key may have lost; it stays below the threshold, because each unit of it
    takes one from more than mass / threshold counters.
    """

    def __init__(self, mass: int, threshold: int = THRESHOLD):
        self.threshold = threshold
        self.capacity = mass // threshold + 1
        self.counters = np.empty(0, dtype=np.uint64)  # key in the high and count in the low half
        self.lost = 0
        self._held: list[np.ndarray] = []
        self._count = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._held.append(keys.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64))
        self._count += len(keys)
        if self._count >= MERGE_KEYS:
            self.merge()

    def merge(self) -> None:
        if not self._held:
            return
        both = np.sort(np.concatenate((self.counters, *self._held)))
        self._held, self._count = [], 0
        keys = both >> np.uint64(32)
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
        counts = np.minimum(np.add.reduceat((both & _LOW).astype(np.int64), first), _CAP)
        keys = keys[first]
        if len(keys) > self.capacity:
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.lost += cut
            keys, counts = keys[counts > cut], counts[counts > cut] - cut
        self.counters = keys << np.uint64(32) | counts.astype(np.uint64)

    def survivors(self) -> np.ndarray:
        """Keys that may have reached the threshold."""
        self.merge()
        counts = (self.counters & _LOW).astype(np.int64)
        return (self.counters[counts + self.lost >= self.threshold] >> np.uint64(32)).astype(np.uint32)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surviving keys of each bucket, from rows sorted by bucket and kind."""

    def rows(bucket: int, summary: Summary) -> Iterator[pa.RecordBatch]:
        keys = summary.survivors()
        for start in range(0, len(keys), BLOCK_KEYS):
            some = keys[start : start + BLOCK_KEYS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([len(some)], pa.int64()), pa.array([some.tobytes()], pa.binary())], ["bucket", "n", "keys"]
            )

    at, mass, summary = None, 0, None
    for batch in batches:
        parts = [batch.column(c).to_pylist() for c in ("bucket", "kind", "mass", "keys", "counts")]
        for bucket, kind, amount, keys, counts in zip(*parts):
            if bucket != at:
                if summary:
                    yield from rows(at, summary)
                at, mass, summary = bucket, 0, None
            if kind == 0:
                mass += amount
                continue
            summary = summary or Summary(mass)
            summary.add(np.frombuffer(keys, dtype=np.uint32), np.frombuffer(counts, dtype=np.uint8))
    if summary:
        yield from rows(at, summary)


def surviving_keys(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, keys): what the summary of every hash partition keeps."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, plain, again in portions(batches):
            places = np.concatenate([_place(keys, buckets) for _, _, keys in Words(lang, plain, again).windows()])
            if len(places):
                yield _blocks(np.sort(places))

    blocks = texts.mapInArrow(dealt, "bucket int, kind int, mass long, keys binary, counts binary")
    return blocks.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_summaries, "bucket int, n long, keys binary")


class Filter:
    """A Bloom filter with a slice of its own for every bucket."""

    def __init__(self, buckets: int, keys: int):
        bits = min(MOST_BITS, max(LEAST_BITS, KEY_BITS * keys))
        self.buckets = buckets
        self.slice = max(64, bits // buckets // 64 * 64)

    def bits(self, places: np.ndarray, probe: int) -> np.ndarray:
        """Bit of each place (bucket, key) for one of the probes."""
        spread = mix((places & _LOW) + np.uint64((probe + 1) << 32)) >> np.uint64(16)
        return (places >> np.uint64(32)) * np.uint64(self.slice) + spread % np.uint64(self.slice)

    def may_hold(self, table: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Indices of the places that the filter does not rule out."""
        left = np.arange(len(places))
        for probe in range(PROBES):
            bit = self.bits(places[left], probe)
            left = left[(table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return left

    def build(self, survivors: DataFrame) -> np.ndarray:
        """All slices; tasks fill them, and the driver puts up to 32 MB of them together."""

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist()):
                    marks = np.zeros(self.slice, dtype=np.uint8)
                    for probe in range(PROBES):
                        marks[self.bits(np.frombuffer(keys, dtype=np.uint32).astype(np.uint64), probe).astype(np.int64)] = 1
                    row = np.packbits(marks, bitorder="little").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([row], pa.binary())], ["bucket", "bits"])

        table = np.zeros(self.buckets * self.slice // 8, dtype=np.uint8)
        merged = survivors.groupBy("bucket").agg(F.collect_list("keys").alias("k")).select("bucket", F.expr("aggregate(k, binary(''), (x, y) -> concat(x, y))").alias("keys"))
        for batch in merged.mapInArrow(filled, "bucket int, bits binary").toArrow().to_batches():
            for bucket, bits in zip(batch.column("bucket").to_pylist(), batch.column("bits").to_pylist()):
                start = bucket * self.slice // 8
                table[start : start + self.slice // 8] = np.frombuffer(bits, dtype=np.uint8)
        return table


def _counted(words: Words, size: int, starts: np.ndarray, keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct phrases among windows, with their numbers.

    Equal hashes bring equal windows together, and neighbours are told apart by their words; where
    phrases with one hash alternate, a phrase is listed more than once.
    """
    starts = starts[np.argsort(keys)]
    new = np.ones(len(starts), dtype=bool)
    if len(starts):
        new[1:] = False
        for i in range(size):
            code = words.codes[starts + i]
            new[1:] |= code[1:] != code[:-1]
    first = np.flatnonzero(new)
    heads = starts[first]
    columns = [[words.words[c] for c in words.codes[heads + i].tolist()] for i in range(size)]
    return list(map(b" ".join, zip(*columns))), np.diff(first, append=len(starts))


def phrase_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(lang, words, phrase, f): exact numbers of all phrases of up to four words that occur at
    least as often as the threshold; with 0 words, the number of words of a language."""
    survivors = materialize(surviving_keys(texts, buckets))
    kept = survivors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sieve = Filter(buckets, kept)
    table = texts.sparkSession.sparkContext.broadcast(sieve.build(survivors))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, plain, again in portions(batches):
            words = Words(lang, plain, again)
            for size, starts, keys in words.windows():
                if size == 1 and len(starts):
                    yield _rows(lang, 0, [b""], np.array([len(starts)]))
                hits = sieve.may_hold(table.value, _place(keys, buckets))
                if len(hits):
                    yield _rows(lang, size, *_counted(words, size, starts[hits], keys[hits]))

    found = texts.mapInArrow(counted, "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(f"words = 0 OR f >= {THRESHOLD}")


def _rows(lang: str, size: int, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n), pa.array([size] * n, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))],
        ["lang", "words", "phrase", "f"],
    )


def _wide(value: str) -> str:
    """SQL: a long with room for products."""
    return f"CAST({value} AS DECIMAL(20, 0))"


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words and more, at their weakest cut."""
    f_of = counts.where("words > 0").select("lang", "phrase", "f")
    cuts = counts.where("words > 1").selectExpr(
        "lang", "phrase", "words", "f AS a", "explode(sequence(1, words - 1)) AS k", "split(phrase, ' ') AS w"
    ).selectExpr("lang", "phrase", "words", "a", "k", "array_join(slice(w, 1, k), ' ') AS head", "array_join(slice(w, k + 1, words - k), ' ') AS tail")
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = join_per_key(cuts, f_of.toDF("lang", part, name), ["lang", part], salts=SALTS)
    cuts = cuts.withColumn("score", F.expr(f"({_wide('a')} * 2000000) div ({_wide('l')} + {_wide('r')})"))
    weakest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def outermost(found: DataFrame) -> DataFrame:
    """Phrases that no longer phrase with most of their occurrences contains."""
    inner = found.where("words > 2").selectExpr("lang", "words", "a", "split(phrase, ' ') AS w").selectExpr(
        "lang", "a",
        "explode(flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))) AS phrase",
    )
    outer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_outer"))
    covered = F.expr(f"100 * {_wide('_outer')} >= {DROP_SHARE} * {_wide('a')}")
    return found.join(outer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("_outer")


def collocations(docs: DataFrame, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of every language.

    Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``, A-Z
    in lower case. Phrases have two to four words and 30 occurrences ``a``; cut in two parts that
    occur ``l`` and ``r`` times, their score is floor(2000000 a / (l + r)) at the cut where it is
    least. Phrases inside a longer one with 80 hundredths of their occurrences are left out. ``n`` is
    the number of words of the language. Ties go to the larger ``a``, then to the smaller phrase by
    bytes. Null texts have no words, null languages are ``und``; repeated rows count each time;
    other columns are ignored; an empty table gives an empty result.
    """
    prepared(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A word takes two bytes at least, and begins up to four windows.
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-LONGEST * size // (2 * THRESHOLD * COUNTERS))))
    counts = materialize(phrase_counts(texts, buckets))
    found = outermost(materialize(scored(counts)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First rankings of parts of a language, then one of what they leave: 64 times the limit at most.
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    some = found.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
