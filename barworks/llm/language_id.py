"""Language identification by error-correcting output codes over byte n-grams.

Every learned language has a codeword. A bit of the code splits the languages in two sides, and a
binary classifier tells the sides apart: its weight of an n-gram is the log of how much more frequent
it is on one side, where each language counts alike. The mean weight of a text's n-grams is its
margin for the bit. Decoding adds up a loss of every margin, weighted by how far the bit's classifier
is to be trusted on the language, and takes the language with the least; where the runner-up is close
the text is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import math
import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barworks.llm.arrow import as_bytes, prepared
from barworks.session import materialize

ORDERS = (2, 3, 4)  # bytes of an n-gram
FEATURES = 1 << 16  # n-grams are hashed to so many weights a bit
SMOOTHING = 0.5
MOST_LANGUAGES = 1 << 14  # learned, those with most documents first: bounds weights and codewords
EXHAUSTIVE = 7  # languages up to which the code has every possible split
CODE_DRAWS = 32  # random codes of which the one with the largest distance is taken
FIT_ROWS = 2000  # expected documents a language from which the trust in its bits is measured
PORTION = 1 << 20  # bytes whose n-grams are held at a time
HELD_LANGUAGES = 64  # whose counts a task holds at a time
AMBIGUOUS = 0.7  # a score below this is ambiguous
UNKNOWN = "und"
_TAIL = max(ORDERS) - 1
_ASCII_LETTERS = string.ascii_letters.encode()
_PLAIN = bytes(
    c if c >= 0x80 else ord(chr(c).lower()) if c in _ASCII_LETTERS else 0x20 for c in range(256)
)
_LETTER = regex.compile(r"\p{L}")
_ODD = np.uint32(0x9E3779B1)


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def plain(text: bytes) -> bytes:
    """Words of letters and bytes beyond ASCII, A-Z in lower case, one space around each."""
    return b" " + b" ".join(text.translate(_PLAIN).split()) + b" "


def features(data: np.ndarray) -> list[np.ndarray]:
    """Per order the feature of the n-gram that begins at each byte but the last few."""
    count = len(data) - _TAIL
    key = data[:count].astype(np.uint32)
    out = []
    for back in range(1, _TAIL + 1):
        key = key | data[back : back + count].astype(np.uint32) << np.uint32(8 * back)
        if back + 1 in ORDERS:
            mixed = (key ^ (key >> np.uint32(15)) ^ np.uint32(back * 0x2545F491)) * _ODD
            out.append((mixed ^ (mixed >> np.uint32(13))) * _ODD >> np.uint32(32 - FEATURES.bit_length() + 1))
    return out


def segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """(numbers of texts, their positions, bytes) of about PORTION bytes of plain texts at a time.

    Every text is padded, so that an n-gram of every order begins at each of its bytes. Long texts
    come in several parts that look ahead into the next one.
    """
    numbers, sizes, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        padded = plain(text) + b" " * _TAIL
        for start in range(0, len(padded) - _TAIL, PORTION):
            part = padded[start : start + PORTION + _TAIL]
            numbers.append(i)
            sizes.append(len(part) - _TAIL)
            parts.append(part)
            held += len(part)
            if held >= PORTION:
                yield numbers, sizes, np.frombuffer(b"".join(parts), dtype=np.uint8)
                numbers, sizes, parts, held = [], [], [], 0
    if numbers:
        yield numbers, sizes, np.frombuffer(b"".join(parts), dtype=np.uint8)


def own_features(sizes: list[int], data: np.ndarray) -> list[np.ndarray]:
    """:func:`features` of a portion without those that begin in the padding of a text."""
    own = np.ones(len(data) - _TAIL, dtype=bool)
    ends = np.cumsum(np.array(sizes) + _TAIL)[:-1]
    for back in range(1, _TAIL + 1):
        own[ends - back] = False
    return [f[own] for f in features(data)]


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, feature, c), combined in the task."""
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            some = np.flatnonzero(counts)
            columns = [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "feature", "c"])
        held.clear()

    for batch in batches:
        by_lang = defaultdict(list)
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
            by_lang[lang].append(text)
        for lang, texts in by_lang.items():
            if lang not in held and len(held) >= HELD_LANGUAGES:
                yield from rows()
            counts = held.setdefault(lang, np.zeros(FEATURES, dtype=np.int64))
            for _, sizes, data in segments(texts):
                for found in own_features(sizes, data):
                    counts += np.bincount(found, minlength=FEATURES)
    yield from rows()


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language. Few languages get every split into two sides; more get a
    random code of 10 log2 bits, the best of several by the least distance between two codewords."""
    if languages < 2:
        return np.zeros((languages, 0), dtype=np.int8)
    if languages <= EXHAUSTIVE:
        splits = itertools.product((1, -1), repeat=languages - 1)
        return np.array([(1, *rest) for rest in splits if -1 in rest], dtype=np.int8).T
    bits = math.ceil(10 * math.log2(languages))
    rng = np.random.default_rng(languages)
    best, reach = None, -1
    for _ in range(CODE_DRAWS):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(languages, bits))
        code[0, (code == code[0]).all(axis=0)] *= -1  # both sides of a split have a language
        if languages > 512:
            return code  # of so many a random code is good enough, and its distances are not measured
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(languages, dtype=int)
        if apart.min() > reach:
            best, reach = code, apart.min()
    return best


@dataclass
class Model:
    """Everything a prediction needs; its size is bounded by MOST_LANGUAGES."""

    languages: list[str]
    code: np.ndarray  # languages by bits, +1 and -1
    weights: np.ndarray  # bits by features
    scale: np.ndarray  # per bit, the usual size of a margin
    trust: np.ndarray  # languages by bits, adds up to 1 for a language

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Per text and bit the mean weight of the n-grams of all its bytes."""
        total = np.zeros((len(texts), len(self.weights)))
        count = np.zeros(len(texts))
        for numbers, sizes, data in segments(texts):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            np.add.at(count, numbers, np.array(sizes) * len(ORDERS))
            for found in own_features(sizes, data):
                for bit, weights in enumerate(self.weights):
                    np.add.at(total[:, bit], numbers, np.add.reduceat(weights[found], starts, dtype=np.float64))
        return total / np.maximum(count, 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Distance of every text to every codeword: the logistic loss of its margins, weighted."""
        away = np.logaddexp(0, -2 * margins / self.scale)  # of bits that are +1
        near = np.logaddexp(0, 2 * margins / self.scale)
        positive = np.where(self.code > 0, self.trust, 0)
        negative = np.where(self.code < 0, self.trust, 0)
        return away @ positive.T + near @ negative.T

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language with the nearest codeword and its share of all, the losses of the bits taken as
        if they were independent."""
        losses = self.losses(margins) * self.code.shape[1]
        best = losses.argmin(axis=1)
        share = np.exp(losses.min(axis=1, keepdims=True) - losses)
        return best, 1 / share.sum(axis=1)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learn(docs: DataFrame) -> Model:
    """The model of all rows (lang, text) that have a language.

    N-grams of all of them are counted. Only the trust in a classifier, which weights the losses, is
    measured on a sample of about FIT_ROWS documents a language, drawn by the hash of the text.
    """
    spark = docs.sparkSession
    docs = docs.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = docs.mapInArrow(count_features, "lang string, feature int, c long").groupBy("lang", "feature").agg(F.sum("c").alias("c"))
    counts = materialize(counts)
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"))
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    known = totals.join(sizes, "lang").orderBy(F.desc("docs"), "lang").limit(MOST_LANGUAGES).collect()
    known = sorted(known, key=lambda r: r.lang)
    names = [r.lang for r in known]
    code = codewords(len(names))
    bits = code.shape[1]
    if not bits:
        return Model(names, code, np.zeros((0, FEATURES), np.float32), np.ones(0), np.ones(code.shape))
    mass = np.array([r.total for r in known], dtype=np.float64) + SMOOTHING * FEATURES
    # Every language has the same say on its side, however many documents it has.
    sides = [np.where(code.T == side, 1.0, 0.0) for side in (1, -1)]
    sides = [s / s.sum(axis=1, keepdims=True) for s in sides]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column("found").to_pylist():
                share = np.full(len(mass), SMOOTHING)
                for entry in found:
                    share[entry["i"]] += entry["c"]
                share /= mass
                rows.append((np.log(sides[0] @ share) - np.log(sides[1] @ share)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(rows, pa.binary())], ["feature", "weights"])

    table = [(i, r.lang, min(1.0, FIT_ROWS / r.docs)) for i, r in enumerate(known)]
    index = F.broadcast(spark.createDataFrame(table, "i int, lang string, part double"))
    grouped = counts.join(index, "lang").groupBy("feature").agg(F.collect_list(F.struct("i", "c")).alias("found"))
    weights = np.zeros((FEATURES, bits), dtype=np.float32)
    for batch in grouped.mapInArrow(weighed, "feature int, weights binary").toArrow().to_batches():
        for feature, row in zip(batch.column("feature").to_pylist(), batch.column("weights").to_pylist()):
            weights[feature] = np.frombuffer(row, dtype=np.float32)
    model = Model(names, code, np.ascontiguousarray(weights.T), np.ones(bits), np.full(code.shape, 1 / bits))
    return _trusted(model, docs, index)


def _trusted(model: Model, docs: DataFrame, index: DataFrame) -> Model:
    """The model with scales and trust from a sample of the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("i").to_numpy()
            margins = shared.value.margins(as_bytes(batch.column("text")))
            right = margins * shared.value.code[at] > 0
            for i in np.unique(at):
                bits = range(margins.shape[1])
                whole = [[i] * len(bits), bits, [(at == i).sum()] * len(bits), right[at == i].sum(axis=0)]
                columns = [pa.array(c, pa.int64()) for c in whole] + [pa.array(np.abs(margins[at == i]).sum(axis=0))]
                yield pa.RecordBatch.from_arrays(columns, ["i", "bit", "n", "hits", "size"])

    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    sample = docs.withColumn("_draw", draw).join(index, "lang").where("_draw < part").select("i", "text")
    sums = sample.mapInArrow(tried, "i long, bit long, n long, hits long, size double").groupBy("i", "bit").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("size").alias("size")
    )
    n, hits, size = (np.zeros(model.code.shape) for _ in range(3))
    for r in sums.collect():
        n[r.i, r.bit], hits[r.i, r.bit], size[r.i, r.bit] = r.n, r.hits, r["size"]
    accuracy = (hits + 1) / (n + 2)
    model.trust = accuracy / accuracy.sum(axis=1, keepdims=True)
    typical = (size / np.maximum(n, 1)).mean(axis=0)
    model.scale = np.where(typical > 0, typical, 1.0)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) from the texts alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            legible = [i for i, t in enumerate(texts) if shared.value.languages and t is not None and has_letter(t)]
            names, scores, flags = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            best, share = shared.value.decode(shared.value.margins([texts[i].encode() for i in legible])) if legible else ((), ())
            for i, language, score in zip(legible, best, share):
                names[i], scores[i], flags[i] = shared.value.languages[language], float(score), bool(score < AMBIGUOUS)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores), pa.array(flags)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(told, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) per document.

    Learned from the documents with a language whose crc32 of doc_id leaves another remainder than 2
    by 4; those with 2 are held out. ``score`` is the share of the nearest codeword, from 0 to 1, and
    ``ambiguous`` says that it is below 0.7. A text that is null or has no letter is ``und`` with
    score 0, and so is every text where nothing was learned. A row without doc_id is neither learned
    nor held out. Repeated rows get one answer each; a text that several languages claim goes to the
    nearest codeword, ties to the first language by name. Other columns are ignored; an empty table
    gives an empty result.
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return predict(rows, learn(rows.where(remainder(F.col("doc_id")) != 2)))
