"""Places in the mix, and work and memory that stay bounded where groups or tables are large."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barworks.llm import filter_audit, jaccard, shingles, topk


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_tokens_carry_the_place_in_the_mix(spark):
    rows = [(i % 90, f"text {i} of many", "en", [None, "src0", "src3", "other"][i % 4], 1) for i in range(300)]
    rows += [rows[7], (None, "without id", "en", "src0", 1), (None, None, None, None, None)]
    docs = documents(spark, rows)
    written = [r.text for r in corpus_pipeline.source_mix(spark, docs, "").collect()]
    read_otherwise = docs.repartition(5, "text")
    found = sorted(corpus_pipeline.tokens(spark, read_otherwise, "").collect(), key=lambda r: (r.mix_slot, r.mix_pos))
    digest = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    assert [r.decoded_sha256 for r in found] == [digest(t) for t in written]
    assert len({(r.mix_slot, r.mix_pos) for r in found}) == len(rows)
    blocks = collections.Counter(r.mix_slot for r in found)
    assert sorted(blocks) == list(range(len(blocks)))
    assert {r.mix_source for r in found} == {"src0", "src3", "(rest)"}


def test_audit_broadcasts_no_table_that_grows(spark, tmp_path):
    spark.range(2000).selectExpr("id AS doc_id", "int(id % 2) AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels"))
    docs = documents(spark, [(i, f"text {i % 40}", "en", None, 1) for i in range(50)])
    marked = filter_audit.failures(docs, spark.read.parquet(str(tmp_path / "labels")))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    good, copy = 1 << filter_audit.GOOD, 1 << filter_audit.FILTERS.index("E")
    found = {r.doc_id: r.bits for r in marked.collect()}
    assert all(bool(bits & good) == bool(i % 2) and bool(bits & copy) == (i >= 40) for i, bits in found.items()) and len(found) == 50


def classes_by_force(texts, words, percent):
    sets = [set(shingles.shingle_set((t or "").encode(), words).tolist()) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    return {i: least[r] for i, r in enumerate(root)}


def near_copies(seed, count, length, changed, chain):
    """Texts that differ from the first in some words each, or from the one before."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(changed):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
        base = words if chain else base
    return out


@pytest.mark.parametrize("words, percent", [(5, 80), (3, 90)])
def test_large_groups_are_compared_whole_without_all_pairs_of_parts(spark, monkeypatch, words, percent):
    together = near_copies(1, 70, 200, 1, False)
    texts = together + near_copies(2, 60, 150, 1, True) + near_copies(3, 25, 120, 4, False) + near_copies(4, 12, 9, 1, True) + [None, "one word"]
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 10)
    monkeypatch.setattr(jaccard, "SKETCH_SETS", 20)
    sent, links = [], jaccard.verified_links

    def counted(docs, ref, members, blocks, join):
        big = members.where(F.col("ref") < len(together)).select(F.size(F.expr(blocks)).alias("n"))
        sent.append(big.agg(F.sum("n")).first()[0] or 0)
        return links(docs, ref, members, blocks, join)

    monkeypatch.setattr(jaccard, "verified_links", counted)
    docs = documents(spark, [(i, t, "en", None, 1) for i, t in enumerate(texts)])
    found = jaccard.similarity_classes(docs, jaccard.Join(words, percent)).collect()
    assert {r.doc_id: r.component_id for r in found} == classes_by_force(texts, words, percent)
    # All pairs of 7 parts would send each of the 70 texts 7 times in every band.
    assert 0 < sum(sent) <= 3 * len(together)


def test_sketches_never_keep_linked_sets_apart():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        for size in (3, 40, 130, 700):
            for drop in range(0, max(1, size // 8)):
                a = rng.integers(0, 2**63, size).astype(np.uint64)
                b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, drop // 2).astype(np.uint64))))
                a = np.unique(a)
                tokens, left = [a, b], np.array([0, 1])
                linked = jaccard._links_in(tokens, left, False, percent)
                sizes = np.array([len(a), len(b)])
                maybe = jaccard._may_be_linked([jaccard.sketch(a), jaccard.sketch(b)], sizes, left, False, percent)
                assert len(maybe) >= len(linked)
    a, b = (np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2))
    assert not jaccard._may_be_linked([jaccard.sketch(a), jaccard.sketch(b)], np.array([300, 300]), np.array([0, 0]), True, 80)


def test_top_k_moves_no_vector_per_block_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = np.floor(1024 * rng.normal(size=(2500, 8)).astype(np.float32).astype(float)).astype(int)
    rows = [(i, (v / 1024).tolist()) for i, v in enumerate(vectors)]
    stored, keep = [], topk.materialize

    def watched(df):
        held = {"values": F.octet_length("values") / 64, "v": F.lit(1), "v_values": F.octet_length("v_values") / 64}
        out = keep(df)
        stored.extend(out.agg(F.sum(held[c])).first()[0] or 0 for c in out.columns if c in held)
        return out

    monkeypatch.setattr(topk, "materialize", watched)
    monkeypatch.setattr(topk, "LANE_LEAST", 700, raising=False)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=4).collect()
    scores = vectors[::4] @ vectors.T
    want = {}
    for n, s in enumerate(scores):
        best = sorted((-int(x), j) for j, x in enumerate(s) if j != 4 * n)[:5]
        want |= {(4 * n, r + 1): (j, -x) for r, (x, j) in enumerate(best)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == want
    assert max(stored) <= len(rows)


@pytest.mark.parametrize("scale", [1, 2**11, 2**20])
def test_top_k_of_a_lane_in_blocks(monkeypatch, scale):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(topk, "VECTOR_ROWS", 7)
    for n in (1, 5, 7, 8, 60):
        q, v = rng.integers(-90, 90, (4, 6)) * scale, rng.integers(-90, 90, (n, 6)) * scale
        best, place, least = topk._tops_of(q, topk._narrow(v), 10)
        full = q @ v.T
        assert (least == full.min(axis=1)).all() and (np.take_along_axis(full, place, 1) == best).all()
        assert (np.sort(best, axis=1) == np.sort(full, axis=1)[:, -10:]).all()
        assert all(len(set(row)) == min(n, 10) for row in place.tolist())
