"""Repeated passages against brute force, over windows as short as 12 bytes."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from furlong.llm import repeats
from tests.llm.conftest import SMALL, messy_rows


def brute(docs, least=200):
    texts = [(t or "").encode() if not isinstance(t, bytes) else t for _, t in docs]
    seen = Counter(t[s : s + least] for t in texts for s in range(len(t) - least + 1))
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - least + 1):
            if seen[t[s : s + least]] > 1:
                gone[s : s + least] = True
        runs = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(t), int(gone.sum()), int((runs == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


def test_repeats_match_brute_force(spark, small_docs):
    got = Counter(tuple(r) for r in repeats.q_repeats(spark, SMALL).collect())
    assert got == brute(small_docs) and sum(r[2] for r in got) > 0


def test_repeats_in_odd_rows(spark, folder, messy, no_docs):
    docs = [r[:2] for r in messy_rows()]
    long = docs[12][1]
    few = [(i, t[:3000] if t == long else t) for i, t in docs]
    frame = spark.createDataFrame(few, "doc_id long, text string").selectExpr("*", "'x' AS uid", "1 AS seed", "2 AS spans", "3 AS sha256")
    assert Counter(tuple(r) for r in repeats.q_repeats(spark, folder(documents=frame)).collect()) == brute(few)
    assert repeats.find_repeats(no_docs).documents.count() == 0


def test_short_windows_over_small_alphabets(spark):
    """Dense, overlapping and periodic repeats of all lengths."""
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("ab"), 60)) for _ in range(6)]
    docs = [(k, "".join(rng.choice(list("abcd" if k % 2 else "ab"), int(rng.integers(0, 160))))) for k in range(160)]
    docs += [(200 + k, docs[k][1][:30] + parts[k % 6][int(rng.integers(0, 20)) :] + docs[k + 1][1][:30]) for k in range(60)]
    docs += [(300, "abc" * 40), (301, "a" * 90), (302, "é" * 30 + parts[0])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for least, seed in ((12, 4), (20, 8)):
        found = repeats.find_repeats(frame, least, seed)
        assert Counter(tuple(r)[1:] for r in found.documents.collect()) == brute(docs, least)


def test_groups_hold_all_occurrences(spark):
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    shared = text(300)
    part = shared[40:290]
    docs = [(k, text(150) + (shared if k < 3 else part) + text(150)) for k in range(7)]
    found = repeats.find_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    ids = {r.uid: r.doc_id for r in found.documents.collect()}
    assert all(300 <= r.n_removed < 310 for r in found.documents.collect() if r.doc_id < 3)
    sizes = Counter((r.length, r.first_uid, r.first_start) for r in found.groups.collect())
    assert max(sizes.values()) == 7 and {ids[r.uid] for r in found.groups.collect()} == set(range(7))


def check_groups(found, docs, least):
    """Each group is one string, at all the places that have it, and varied to its left."""
    ids = {r.uid: r.doc_id for r in found.documents.collect()}
    texts = {i: t.encode() for i, t in docs}
    groups = defaultdict(list)
    for r in found.groups.collect():
        groups[r.length, r.first_uid, r.first_start].append((ids[r.uid], r.start))
    for (length, uid, start), places in groups.items():
        body = texts[ids[uid]][start : start + length]
        every = {(i, s) for i, t in texts.items() for s in range(len(t) - length + 1) if t[s : s + length] == body}
        assert length >= least and len(places) == len(set(places)) and set(places) == every
    return groups


@pytest.mark.parametrize("hot", [1 << 12, 4])
def test_copies_of_a_sample_are_in_its_group(spark, hot):
    """A context that repeats is sent once; its other copies are occurrences all the same."""
    rng = np.random.default_rng(12)
    text = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    passage, other = text(900), text(200)
    docs = [(k, text(120) + passage + text(120)) for k in range(12)]                       # contexts in 12 copies
    docs += [(20 + k, text(80) + passage[300:640] + other + text(80)) for k in range(5)]   # and part of them in 5 more
    docs += [(30 + k, docs[k][1]) for k in range(3)]                                       # exact copies of whole texts
    found = repeats.find_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot)
    groups = check_groups(found, docs, 200)
    assert Counter(tuple(r)[1:] for r in found.documents.collect()) == brute(docs)
    assert max(map(len, groups.values())) == 20


def test_texts_may_come_in_another_order(spark):
    """A second read of other columns deals and numbers the rows otherwise; repeated rows, null ids and null texts are found again."""
    rng = np.random.default_rng(13)
    text = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    shared = text(260)
    docs = [(k, text(90) + shared + text(k)) for k in range(30)] + [(5, shared)] * 3 + [(None, shared), (None, shared + "x"), (None, None), (7, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(tuple(r)[1:] for r in repeats.find_repeats(frame.repartition(7)).documents.collect()) == brute(docs)


def test_hot_seeds_are_split_by_window(spark, monkeypatch):
    """One passage in many surroundings: no task gathers its seeds, and the results are the same."""
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    shared = text(420)
    docs = [(k, text(100) + shared[: 420 - k % 5 * 40] + text(100)) for k in range(60)] + [(60 + k, "ab" * 130 + "x" * k) for k in range(4)] + [(70, shared), (71, shared)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = lambda f: Counter((r.seed, r.length, r.uid, r.start) for r in f.groups.collect())
    calm = repeats.find_repeats(frame)
    compare = repeats._compare

    def few(least, seed):
        def run(batches):
            for batch in batches:
                assert not batch.num_rows or max(Counter(batch.column("seed").to_pylist()).values()) <= 10
                yield from compare(least, seed)(iter([batch]))
        return run

    monkeypatch.setattr(repeats, "_compare", few)
    split = repeats.find_repeats(frame, hot=10)
    assert Counter(tuple(r)[1:] for r in split.documents.collect()) == brute(docs) == Counter(tuple(r)[1:] for r in calm.documents.collect())
    assert rows(split) == rows(calm) and max(Counter(k[:2] for k in rows(split)).values()) > 10
    every = repeats.find_repeats(frame, hot=0)
    assert rows(every) == rows(calm)


def test_interval_tree():
    # suffixes of banana$: common prefixes 0 1 3 0 0 2
    got = set(repeats.lcp_intervals(np.array([0, 1, 3, 0, 0, 2]), 1))
    assert got == {(3, 2, 3), (1, 1, 3), (2, 5, 6)}
