"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of bytes.

The model holds byte 4-grams of trusted texts, one model per language. Its counts are dealt into
shards by (language, second and third byte): all that the model needs about the orders 4 and 3 of
such a 4-gram meets in one shard, while the orders 2 and 1 of a language are a few tens of thousand
numbers at most. Blocks of documents send the distinct 4-grams that they hold to the shards, get
their log probabilities back and add them up per document. A document is rejected when its
perplexity lies beyond a high quantile of trusted documents, which are scored for that by models
that have not seen them. Texts in a language without a trusted one are judged by a model of all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barworks.llm.arrow import as_bytes, prepared
from barworks.session import materialize

ORDER = 4
PAD = b"\xff" * (ORDER - 1)  # never part of UTF-8
BLOCK_DOCS = 8000
TEXT_BYTES = 1 << 20  # of texts scored at a time
BROADCAST_IDS = 1_000_000  # trusted ids that may be broadcast: 8 MB
BINS = 10_000  # per unit of bits a byte, for quantiles
FOLDS = 2  # parts of the trusted texts; a part is scored by a model of the others
TOP = 0.99  # quantile of trusted documents at which the limit is
PRIOR = 20  # documents that the coarser quantile counts for
POOL = zlib.crc32(b"\xff")  # in place of a language: the model of all trusted texts
WITHOUT = [zlib.crc32(b"\xff" + bytes([i])) for i in range(FOLDS)]  # flips a code to the model without a part
_LOW24, _LANG = np.uint64(0xFFFFFF), np.uint64(0xFFFFFFFF00000000)


def language_code(lang: str | None) -> int:
    return zlib.crc32((lang or "").encode())


def grams(texts: list[bytes], codes: list[int]) -> np.ndarray:
    """Key of the 4-gram that ends at each byte of the texts, in order: language, then bytes."""
    data = np.frombuffer(b"".join(PAD + t for t in texts), dtype=np.uint8)
    key = data[ORDER - 1 :].astype(np.uint64)
    for back in range(1, ORDER):
        key |= data[ORDER - 1 - back : len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    key = key[data[ORDER - 1 :] != 0xFF]
    return key | (np.repeat(np.array(codes, dtype=np.uint64), [len(t) for t in texts]) << np.uint64(32))


def _portions(texts: list[bytes]) -> Iterator[slice]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) + len(PAD)
        if held >= TEXT_BYTES:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def fold_of(text: Column) -> Column:
    """Part of a trusted text; copies of a text are in one part."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def _high(code: int) -> Column:
    """A code where a gram has its language."""
    return F.lit(((code << 32) + 2**63) % 2**64 - 2**63)


def count_grams(trusted: DataFrame) -> DataFrame:
    """(gram, c): occurrences of every 4-gram in texts (lang, text), combined before the shuffle:
    per language and in all of them, and both again without each part of the texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            codes = [language_code(v) for v in batch.column("lang").to_pylist()]
            folds = batch.column("fold").to_pylist()
            for fold in set(folds):
                some, its = zip(*((t, c) for t, c, f in zip(texts, codes, folds) if f == fold))
                for part in _portions(list(some)):
                    key, count = np.unique(grams(some[part], its[part]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([fold] * len(key), pa.int32()), pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], ["fold", "gram", "c"]
                    )

    rows = trusted.select("lang", "text", fold_of(F.col("text")).alias("fold")).mapInArrow(counted, "fold int, gram long, c long")
    rows = rows.groupBy("fold", "gram").agg(F.sum("c").alias("c"))
    of_all = F.col("gram").bitwiseAND(F.lit((1 << 32) - 1)).bitwiseOR(_high(POOL))
    whole = [F.col("gram"), of_all]
    rest = [F.when(F.col("fold") != i, g.bitwiseXOR(_high(w))) for i, w in enumerate(WITHOUT) for g in whole]
    spread = rows.select(F.explode(F.array_compact(F.array(*whole, *rest))).alias("gram"), "c")
    return spread.groupBy("gram").agg(F.sum("c").alias("c"))


def _keep_low(gram: Column, size: int) -> Column:
    """The last ``size`` bytes of a gram, with its language."""
    return gram.bitwiseAND(F.lit(~((1 << 32) - (1 << (8 * size)))))


def _occurrences(counts: DataFrame, order: int) -> DataFrame:
    """Per language how many grams of an order occur once, twice, three and four times."""
    each = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(1, 5)]
    return counts.groupBy(F.shiftrightunsigned("gram", 32).alias("code")).agg(*each).withColumn("o", F.lit(order))


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more; where a count of counts is missing, 1/2, 1 and 3/2
    stand in, so that probabilities stay positive on tiny corpora."""
    base = [0.5, 1.0, 1.5]
    if min(n1, n2, n3, n4) <= 0:
        return base
    y = n1 / (n1 + 2 * n2)
    exact = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [e if 0 < e < i + 1 else b for i, (e, b) in enumerate(zip(exact, base))]


def _interpolated(key: np.ndarray, count: np.ndarray, discount: np.ndarray, lower: np.ndarray):
    """Probability of each gram from its count and its shorter form's probability, and the contexts
    with their back-off weights. ``discount`` has a row of three per gram."""
    context, at = np.unique(key >> np.uint64(8), return_inverse=True)
    total = np.bincount(at, weights=count)
    taken = discount[np.arange(len(key)), np.minimum(count, 3).astype(np.int64) - 1]
    weight = np.bincount(at, weights=taken) / total
    return (count - taken) / total[at] + weight[at] * lower, context, weight


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(np.asarray(missing, dtype=float), wanted.shape).copy()
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _lower_orders(c2: np.ndarray, count: np.ndarray, d2: list[float], d1: list[float]):
    """Orders 2 and 1 of one language: seen pairs with probabilities, back-off weight per first
    byte, probability per byte."""
    seen, c1 = np.unique(c2 & np.uint64(0xFF), return_counts=True)
    taken = np.array(d1)[np.minimum(c1, 3) - 1]
    p1 = np.full(256, taken.sum() / c1.sum() / 256)
    p1[seen.astype(np.int64)] += (c1 - taken) / c1.sum()
    low = p1[(c2 & np.uint64(0xFF)).astype(np.int64)]
    p2, context, weight = _interpolated(c2, count, np.tile(d2, (len(c2), 1)), low)
    back = np.ones(256)
    back[context.astype(np.int64)] = weight
    return p2, back, p1


def lower_model(counts: DataFrame) -> DataFrame:
    """One row per language: discounts of the orders 4 and 3 and all of the orders 2 and 1."""
    c3 = counts.groupBy(_keep_low(F.col("gram"), 3).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    c3 = materialize(c3)
    c2 = c3.groupBy(_keep_low(F.col("gram"), 2).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    times = _occurrences(counts, 4).union(_occurrences(c3, 3)).withColumns(
        {"gram": F.lit(None).cast("long"), "c": F.lit(None).cast("long")}
    )
    pairs = c2.select(
        F.shiftrightunsigned("gram", 32).alias("code"), *[F.lit(None).cast("long").alias(f"n{i}") for i in range(1, 5)],
        F.lit(2).alias("o"), "gram", "c",
    )

    def lowered(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        pairs = sorted((r["gram"] & 0xFFFF, r["c"]) for r in rows if r["o"] == 2)
        key = np.array([p[0] for p in pairs], dtype=np.uint64)
        count = np.array([p[1] for p in pairs], dtype=float)
        higher = {r["o"]: discounts(r["n1"], r["n2"], r["n3"], r["n4"]) for r in rows if r["o"] > 2}
        firsts = np.unique(key & np.uint64(0xFF), return_counts=True)[1]
        d2 = discounts(*[float((count == i).sum()) for i in range(1, 5)])
        d1 = discounts(*[float((firsts == i).sum()) for i in range(1, 5)])
        p2, back, p1 = _lower_orders(key, count, d2, d1)
        code = rows[0]["code"]
        return pa.table({
            "code": pa.array([code], pa.int64()),
            "high": pa.array([np.array(higher[4] + higher[3]).tobytes()], pa.binary()),
            "pairs": pa.array([key.tobytes()], pa.binary()), "p2": pa.array([p2.tobytes()], pa.binary()),
            "back": pa.array([back.tobytes()], pa.binary()), "p1": pa.array([p1.tobytes()], pa.binary()),
        })

    schema = "code long, high binary, pairs binary, p2 binary, back binary, p1 binary"
    return times.unionByName(pairs).groupBy("code").applyInArrow(lowered, schema)


def log_probabilities(key: np.ndarray, count: np.ndarray, lower: list[dict], wanted: np.ndarray) -> np.ndarray:
    """Bits of each wanted 4-gram, from the counts of a shard and the lower orders of its languages.

    ``key`` is sorted. A language without a model gives every byte the same probability.
    """
    bits = np.full(len(wanted), 8.0)
    code_of, code_wanted = key >> np.uint64(32), wanted >> np.uint64(32)
    for low in lower:
        mine, ask = code_of == np.uint64(low["code"]), code_wanted == np.uint64(low["code"])
        if not ask.any():
            continue
        high = np.frombuffer(low["high"])
        pairs, p2 = np.frombuffer(low["pairs"], np.uint64), np.frombuffer(low["p2"])
        back, p1 = np.frombuffer(low["back"]), np.frombuffer(low["p1"])

        def of_pair(gram: np.ndarray) -> np.ndarray:
            other = back[((gram >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)] * p1[(gram & np.uint64(0xFF)).astype(np.int64)]
            return _look(pairs, p2, gram & np.uint64(0xFFFF), other)

        four, times = key[mine] & np.uint64(0xFFFFFFFF), count[mine].astype(float)
        three, c3 = np.unique(four & _LOW24, return_counts=True)
        p3, context3, weight3 = _interpolated(three, c3.astype(float), np.tile(high[3:], (len(three), 1)), of_pair(three))

        def of_three(gram: np.ndarray) -> np.ndarray:
            return _look(three, p3, gram, _look(context3, weight3, gram >> np.uint64(8), 1.0) * of_pair(gram))

        p4, context4, weight4 = _interpolated(four, times, np.tile(high[:3], (len(four), 1)), of_three(four & _LOW24))
        gram = wanted[ask] & np.uint64(0xFFFFFFFF)
        short = of_three(gram & _LOW24)
        bits[ask] = -np.log2(_look(four, p4, gram, _look(context4, weight4, gram >> np.uint64(8), 1.0) * short))
    return bits


def _shard(gram: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a 4-gram: all that share the language and the two middle bytes go together."""
    middle = (gram & _LANG) | ((gram >> np.uint64(8)) & np.uint64(0xFFFF))
    return ((middle * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


def score(docs: DataFrame, counts: DataFrame, lower: DataFrame, total: int) -> DataFrame:
    """(doc_id, lang, n_bytes, bits) of documents (doc_id, lang, text, codes): bits per byte under
    the model of each of its codes (null without a byte).

    Texts are shuffled once, into blocks; both uses of the blocks read the same shuffle. Where
    there are many blocks the shards are repeated, so that a frequent 4-gram is asked for in
    several tasks.
    """
    blocks = max(1, math.ceil(total / BLOCK_DOCS))
    copies, shards = max(1, blocks // 512), min(max(8, blocks), 4096)
    parts = max(2, blocks)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.array(batch.column("block").to_pylist(), dtype=np.int64)
            texts = as_bytes(batch.column("text"))
            codes = batch.column("codes").to_pylist()
            for block in np.unique(at).tolist():
                rows = np.flatnonzero(at == block).tolist()
                some, its = [texts[i] for i in rows for _ in codes[i]], [c for i in rows for c in codes[i]]
                for part in _portions(some):
                    new = np.unique(grams(some[part], its[part]))
                    need[block] = np.union1d(need[block], new) if block in need else new
        for block, gram in need.items():
            shard = _shard(gram, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            groups = [g for g in np.split(gram[order], cuts) if len(g)]
            if groups:
                names = [int(_shard(g[:1], shards)[0]) * copies + block % copies for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array([block] * len(groups), pa.int32()), pa.array([g.tobytes() for g in groups], pa.binary())],
                    ["shard", "block", "grams"],
                )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = np.array(batch.column("gram").to_pylist(), dtype=np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_shard(gram, shards).astype(np.int32)), batch.column("gram"), batch.column("c")], ["shard", "gram", "c"]
            )

    def answered(request: pa.Table, model: pa.Table) -> pa.Table:
        rows = model.to_pylist()
        lower_rows = [r for r in rows if r["gram"] is None]
        pairs = sorted((r["gram"] & (2**64 - 1), r["c"]) for r in rows if r["gram"] is not None)
        key = np.array([p[0] for p in pairs], dtype=np.uint64)
        count = np.array([p[1] for p in pairs], dtype=np.int64)
        bits = []
        for wanted in request.column("grams").to_pylist():
            bits.append(log_probabilities(key, count, lower_rows, np.frombuffer(wanted, np.uint64)).astype(np.float32).tobytes())
        return pa.table({"block": request.column("block"), "grams": request.column("grams"), "bits": pa.array(bits, pa.binary())})

    def added(block: pa.Table, answers: pa.Table) -> pa.Table:
        if answers.num_rows:
            key = np.concatenate([np.frombuffer(b, np.uint64) for b in answers.column("grams").to_pylist()])
            value = np.concatenate([np.frombuffer(b, np.float32) for b in answers.column("bits").to_pylist()])
            order = np.argsort(key)
            key, value = key[order], value[order].astype(float)
        out: list[list[float | None]] = []
        sizes: list[int] = []
        for chunk in block.to_batches():
            texts = as_bytes(chunk.column("text"))
            codes = chunk.column("codes").to_pylist()
            some, its = [t for t, c in zip(texts, codes) for _ in c], [c for cs in codes for c in cs]
            bits: list[float | None] = []
            for part in _portions(some):
                lengths = np.array([len(t) for t in some[part]])
                each = value[np.searchsorted(key, grams(some[part], its[part]))] if lengths.sum() else np.zeros(0)
                sums = np.diff(np.concatenate(([0.0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(lengths)))])
                bits += [float(s / n) if n else None for s, n in zip(sums, lengths)]
            each_doc = iter(bits)
            out += [[next(each_doc) for _ in c] for c in codes]
            sizes += [len(t) for t in texts]
        return pa.table({"doc_id": block.column("doc_id"), "lang": block.column("lang"), "n_bytes": pa.array(sizes, pa.int64()), "bits": pa.array(out, pa.list_(pa.float64()))})

    placed = docs.select(
        F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", "codes",
    ).repartition(parts, "block")
    requests = placed.mapInArrow(asked, "shard int, block int, grams binary")
    empty = {n: F.lit(None).cast("binary").alias(n) for n in ("high", "pairs", "p2", "back", "p1")}
    copied = lambda rows: rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    name = (F.col("shard") * copies + F.col("copy")).cast("int").alias("shard")
    of_counts = copied(counts.mapInArrow(dealt, "shard int, gram long, c long")).select(
        name, "gram", "c", F.lit(None).cast("long").alias("code"), *empty.values()
    )
    of_lower = copied(lower.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))).select(
        name, F.lit(None).cast("long").alias("gram"), F.lit(None).cast("long").alias("c"), "code", *empty
    )
    model = of_counts.unionByName(of_lower)
    answers = requests.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(answered, "block int, grams binary, bits binary")
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        added, "doc_id long, lang string, n_bytes long, bits array<double>"
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled as good and not toxic, each once."""
    return labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def with_trusted(docs: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of trusted documents. Their ids are broadcast while they are few, and shuffled beyond."""
    few = ids.count() <= BROADCAST_IDS
    return docs.select(*columns).join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi")


def length_class(n_bytes: Column) -> Column:
    """Short texts vary more: classes of doubling length up to 1024 bytes and one beyond."""
    return F.least(F.floor(F.log2(F.greatest(n_bytes, F.lit(1)))), F.lit(10)).cast("int")


def quantiles(scores: DataFrame, keys: list[str], points: list[float]) -> DataFrame:
    """Quantiles of ``bits`` per key, to a bin of 1/10,000 bit, from counts of bins."""
    bins = scores.where("bits IS NOT NULL").groupBy(*keys, F.floor(F.col("bits") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    series = Window.partitionBy(*keys)
    running = bins.select(
        *keys, "bin", F.sum("n").over(series.orderBy("bin")).alias("upto"), F.sum("n").over(series).alias("all")
    )
    return running.groupBy(*keys).agg(
        F.max("all").alias("n"),
        *[F.min(F.when(F.col("upto") >= F.col("all") * p, (F.col("bin") + 1) / BINS)).alias(f"q{i}") for i, p in enumerate(points)],
    )


def _shrunk(own: str, n: str, coarser: Column) -> Column:
    """A quantile of n documents, drawn to a coarser one; the coarser one where there are none."""
    count = F.coalesce(n, F.lit(0))
    return (count * F.coalesce(own, F.lit(0.0)) + PRIOR * coarser) / (count + PRIOR)


def _limited(scores: DataFrame, known: DataFrame, point: float) -> DataFrame:
    """``scores`` (pooled, series, length and others) with limit_bits, from the held-out ``bits`` of
    ``known`` (pooled, series, length, bits).

    The limit is the series' median and a distance from there: the quantile of the documents of its
    series and length, drawn to that of its series with what its length adds in all series, each of
    which is drawn to that of all.
    """
    middle = quantiles(known, ["pooled", "series"], [0.5]).select("pooled", "series", F.col("q0").alias("median"))
    far = materialize(known.join(F.broadcast(middle), ["pooled", "series"]).withColumn("bits", F.col("bits") - F.col("median")))
    rows = scores.join(F.broadcast(middle), ["pooled", "series"], "left")
    for name, keys in (("all", ["pooled"]), ("length", ["pooled", "length"]), ("series", ["pooled", "series"]), ("cell", ["pooled", "series", "length"])):
        found = quantiles(far, keys, [point]).select(*keys, F.col("q0").alias(f"q_{name}"), F.col("n").alias(f"n_{name}"))
        rows = rows.join(F.broadcast(found), keys, "left")
    every = F.col("q_all")
    of_series = _shrunk("q_series", "n_series", every) + _shrunk("q_length", "n_length", every) - every
    return rows.withColumn("limit_bits", F.when(F.col("n_bytes") > 0, F.col("median") + _shrunk("q_cell", "n_cell", of_series)))


def classify(docs: DataFrame, labels: DataFrame, point: float = TOP) -> DataFrame:
    """(doc_id, lang, n_bytes, bits, perplexity, limit_bits, kept) per document.

    ``bits`` is the mean number of bits per byte under the model of the document's language and
    ``perplexity`` two to that power. ``limit_bits`` is the ``point`` quantile of trusted documents
    of the language and of like length, each scored by a model without its own part of them;
    where these are few it is drawn to that of the language and of all documents, see
    :func:`_limited`. A document in a language without a trusted text is judged by its bits under
    the model of all trusted texts, against the limit of that model. A document is kept unless it
    lies beyond the limit. Null texts count as empty; only a document without a byte has no limit
    and is kept, or all where no trusted text has a byte. Null languages are one language. Repeated
    rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    prepared(docs.sparkSession)
    ids = materialize(trusted_ids(labels))
    counts = materialize(count_grams(with_trusted(docs, ids, ["doc_id", "lang", "text"])))
    lower = materialize(lower_model(counts))
    own = F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary"))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", own.alias("code"))
    few = ids.count() <= BROADCAST_IDS
    trusted = ids.withColumn("trusted", F.lit(True))
    marked = marked.join(F.broadcast(trusted) if few else trusted.hint("merge"), "doc_id", "left")
    marked = marked.join(F.broadcast(lower.select("code", F.lit(True).alias("modelled"))), "code", "left")
    without = F.element_at(F.array(*[F.lit(w) for w in WITHOUT]), fold_of(F.col("text")) + 1)
    pool = F.lit(POOL).cast("long")
    codes = (
        F.when(F.col("trusted"), F.array("code", F.col("code").bitwiseXOR(without), pool.bitwiseXOR(without)))
        .when(F.col("modelled"), F.array("code"))
        .otherwise(F.array("code", pool))
    )
    scores = materialize(score(marked.select("doc_id", "lang", "text", codes.alias("codes")), counts, lower, docs.count()))
    models = F.size("bits")  # 1: own, 2: and that of all, 3: own and both without the document
    scores = scores.withColumns({
        "length": length_class(F.col("n_bytes")), "pooled": models == 2,
        "series": F.when(models == 2, "").otherwise(F.coalesce("lang", F.lit(""))),
    })
    held = [
        scores.where(models == 3).select(F.lit(at == 2).alias("pooled"), F.lit("").alias("series") if at == 2 else "series", "length", F.col("bits")[at].alias("bits"))
        for at in (1, 2)
    ]
    out = _limited(scores, materialize(held[0].union(held[1]).where("bits IS NOT NULL")), point)
    bits, judged = F.col("bits")[0], F.when(F.col("pooled"), F.col("bits")[1]).otherwise(F.col("bits")[0])
    return out.select(
        "doc_id", "lang", "n_bytes", bits.alias("bits"), F.pow(F.lit(2.0), bits).alias("perplexity"), "limit_bits",
        F.coalesce(judged <= F.col("limit_bits"), F.lit(True)).alias("kept"),
    )


def keep_fluent(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that :func:`classify` keeps, with their own columns. Rows that share a
    doc_id stay or go together, by the best of them; rows without doc_id stay."""
    gone = classify(docs, labels).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
