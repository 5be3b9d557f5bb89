"""Filter audit, collocations and language identification on small inputs, against brute force."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest

from barworks.llm import collocations, filter_audit, language_id
from barworks.llm.arrow import prepared

DOCS = "doc_id long, text string, lang string, part string, words string, filter long, _first long, bucket int"
PROSE = " ".join(f"word{i % 37} and{i % 11} of{i % 5}" for i in range(80))
PHRASES = "New York is big, the new york of old. A b c d! a B c\td\n" * 40
TEXTS = [
    None, "", " \n\t", "one", "CAPS ONLY HERE", PROSE, PROSE, PROSE + " 5% off", PROSE.upper(), "x" * 30000, "é" * 3000, PHRASES, PHRASES.upper(),
    " ".join(f"u{i}" for i in range(5000)), "#tag", "la la " * 200, "  .;.  ",
]


@pytest.fixture(scope="module")
def docs(spark):
    prepared(spark)
    rows = [(i, t, [None, "en", "fr", ""][i % 4], "clash", "x", 3, 1, 2) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, PROSE, "en", None, None, None, None, None), (2, "another text for id two", None, "", "", 0, 0, 0), (40, PROSE, "en", "", "", 0, 0, 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 17)] + [(4, 1, None), (None, 1, 1), (5, None, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def audit_by_force(rows, marks):
    good = {r.doc_id for r in marks if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in marks if r.toxic == 1 and r.doc_id is not None}
    fails, parts = [], collections.defaultdict(list)
    for k, r in enumerate(rows):
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(o.doc_id is not None and r.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == t for o in rows)
        rules = len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller
        fails.append({c for c, bad in zip("ABCDE", rules) if bad})
        parts[r.lang or ""].append(k)
    out = set()
    for part, members in parts.items():
        removed = {}
        for order in itertools.permutations("ABCDE"):
            left = set(members)
            for step, c in enumerate(order):
                failing = {k for k in members if c in fails[k]}
                here = failing & left
                left -= here
                removed["".join(order), step] = c, len(left), len(here), len(failing) - len(here), sum(fails[k] == {c} for k in members), sum(
                    rows[k].doc_id in good for k in here), sum(rows[k].doc_id in toxic for k in here)
        total = collections.Counter()
        for c, _, n, *_ in removed.values():
            total[c] += n
        out |= {(part, order, step + 1, *v[1:], total[v[0]]) for (order, step), v in removed.items()}
    return out


@pytest.mark.parametrize("width", [1 << 16, 3])
def test_audit(docs, labels, none, width, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE_IDS", width)
    got = filter_audit.audit(docs, labels).collect()
    assert {tuple(r) for r in got} == audit_by_force(docs.collect(), labels.collect())
    assert len(got) == 600 * 3
    assert filter_audit.audit(none, labels).count() == 0
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit.audit(docs, labels.where("false")).collect())


def test_galloping():
    rng = np.random.default_rng(3)
    for n, m in itertools.product((0, 1, 2, 50, 3000), repeat=2):
        a, b = (np.unique(rng.integers(0, 4000, k)) for k in (n, m))
        assert (filter_audit.gallop(a, b) == np.searchsorted(b, a)).all()
        assert (filter_audit.difference(a, b) == np.setdiff1d(a, b)).all()
        assert (filter_audit.union([a, b, a + 1]) == np.union1d(np.union1d(a, b), a + 1)).all()


def test_words_of_long_texts(monkeypatch):
    text = " ".join(f"a{i % 300}\tb{i}" for i in range(4000)).encode()
    whole = filter_audit.word_counts(text)
    monkeypatch.setattr(filter_audit, "PIECE", 100)
    assert filter_audit.word_counts(text) == whole == (8000, 4300)


def collocations_by_force(rows, top):
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            counts[r.lang if r.lang is not None else "und"].update(tuple(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= 30}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in often.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])}
    return out


@pytest.mark.parametrize("portion,top", [(4 << 20, 2000), (200, 3)])
def test_collocations(docs, none, portion, top, monkeypatch):
    monkeypatch.setattr(collocations, "PORTION", portion)
    monkeypatch.setattr(collocations.slices, "__defaults__", (portion,))
    want = collocations_by_force(docs.collect(), top)
    assert len(want) > 3 and {tuple(r) for r in collocations.collocations(docs, top).collect()} == want
    assert collocations.collocations(none).count() == 0


def test_every_window_is_in_one_slice():
    words = [f"w{i}" + (b"\xff".decode("latin1") if i % 97 == 0 else "") for i in range(400)]
    data = " ".join(words).encode("latin1")
    for size in (10, 33, 5000):
        seen = collections.Counter()
        for part, again in collocations.slices(data, size):
            w = collocations.Words("en", part, again)
            seen.update(tuple(w.codes[s + i] and w.words[w.codes[s + i]] for i in range(m)) for m, starts, _ in w.windows() for s in starts)
        whole = collocations.Words("en", data, 0)
        assert seen == collections.Counter(tuple(whole.words[whole.codes[s + i]] for i in range(m)) for m, starts, _ in whole.windows() for s in starts)


def test_summary_keeps_every_frequent_key(monkeypatch):
    monkeypatch.setattr(collocations, "MERGE_KEYS", 500)
    rng = np.random.default_rng(1)
    for spread in (50, 3000, 200000):
        keys = np.minimum(rng.zipf(1.2, 30000), spread).astype(np.uint32) * np.uint32(2654435761)
        true = collections.Counter(keys.tolist())
        summary = collocations.Summary(len(keys))
        for block in np.array_split(keys, 40):
            summary.add(*np.unique(block, return_counts=True))
        kept = set(summary.survivors().tolist())
        assert {k for k, c in true.items() if c >= 30} <= kept and summary.lost < 30 and len(kept) <= summary.capacity


def test_filter_has_no_misses(spark):
    prepared(spark)
    keys = np.unique(np.random.default_rng(2).integers(0, 2**32, 5000, dtype=np.uint64))
    buckets = keys % np.uint64(64)
    rows = [(int(b), int((buckets == b).sum()), (keys[buckets == b]).astype(np.uint32).tobytes()) for b in range(64)]
    sieve = collocations.Filter(64, len(keys))
    table = sieve.build(spark.createDataFrame(rows, "bucket int, n long, keys binary"))
    assert len(sieve.may_hold(table, buckets << np.uint64(32) | keys)) == len(keys)
    others = np.arange(20000, dtype=np.uint64) << np.uint64(17) | np.uint64(12345)
    assert len(sieve.may_hold(table, (others % np.uint64(64)) << np.uint64(32) | others)) < 400


def test_codewords():
    for n in (1, 2, 3, 4, 7, 8, 30, 600):
        code = language_id.codewords(n)
        assert len(code) == n and (n == 1 or len({tuple(r) for r in code.tolist()}) == n)
        assert all(set(c) == {1, -1} for c in code.T.tolist())


def test_language_of_long_and_split_texts(monkeypatch):
    model = language_id.Model(
        ["a", "b", "c"], language_id.codewords(3), np.random.default_rng(4).normal(size=(3, language_id.FEATURES)).astype(np.float32), np.ones(3), np.full((3, 3), 1 / 3)
    )
    texts = ["Ein Satz, zwei.".encode(), b"x", " ".join(f"w{i}" for i in range(3000)).encode(), "éé 12 ü".encode()]
    whole = model.margins(texts)
    force = np.zeros_like(whole)
    for i, t in enumerate(texts):
        data = np.frombuffer(language_id.plain(t) + b" " * 3, dtype=np.uint8)
        force[i] = np.mean([model.weights[:, f] for f in language_id.features(data)], axis=(0, 2))
    assert np.allclose(whole, force)
    monkeypatch.setattr(language_id, "PORTION", 50)
    assert np.allclose(model.margins(texts), whole)
    best, share = model.decode(whole)
    losses = [[sum(np.log1p(np.exp(-2 * m * s)) for m, s in zip(row, word)) / 3 for word in model.code] for row in whole]
    assert best.tolist() == np.argmin(losses, axis=1).tolist() and (share > 1 / 3 - 1e-9).all() and (share <= 1).all()


def test_identify_made_languages(spark, docs, none):
    prepared(spark)
    words = {"aa": "bano keto limu", "bb": "schtrumpf gnarz wolkt", "cc": "čeřy žluťo ěda"}
    rows = [(i, " ".join(w.split()[(i + k) % 3] for k in range(i % 9 + 1)), lang) for lang, w in words.items() for i in range(ord(lang[0]) * 100, ord(lang[0]) * 100 + 60)]
    rows += [(1, "123 ... !", "aa"), (2, None, "bb"), (3, "", "cc"), (None, "bano keto", "aa"), (4, "gnarz", None), (5, "½ ² 9", "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert len(got) == len(rows)
    for doc_id, text, lang in rows:
        r = got[doc_id]
        legible = any(c.isalpha() for c in text or "")
        assert r.held_out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred == ((lang or "bb") if legible else "und") and (legible or r.score == 0)
    assert language_id.identify(none).count() == 0
    found = language_id.identify(docs).collect()
    assert len(found) == docs.count() and {r.lang_pred for r in found} <= {"", "en", "fr", "und"}
    alone = language_id.identify(table.where("lang = 'aa'")).collect()
    assert {r.lang_pred for r in alone} == {"aa", "und"}
    assert {r.lang_pred for r in language_id.identify(table.where("lang IS NULL")).collect()} == {"und"}


def test_held_out_accuracy_on_given_documents(spark):
    table = prepared(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
