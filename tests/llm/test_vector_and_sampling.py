"""Top-k search, whitening and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from furlong.llm import importance, topk, whitening
from tests.llm.conftest import CLASHES, SMALL, messy_rows
from tests.oracle_check import check, duck

VECTORS = "vec_id long, embedding array<float>"
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("key", ["op11_pivot_top_k", "op13_importance_resampling"])
def test_query_matches_sql(spark, key):
    assert check(spark, duck(SMALL), key, SMALL, entry.queries()[key], entry.oracle_sql()[key])["ok"]


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(0, 0.2, 6)]) for k in range(1, 120)]
    rows += [(200 + k, [0.1, -0.2, 0.3, 0.4, 0.0, 0.5]) for k in range(60)]  # more copies than ranks
    rows += [(0, [0.1, -0.2, 0.3, 0.4, 0.0, 0.5])] * 2 + [(None, [0.9, -0.9, 0.9, 0.9, 0.0, 0.9])] * 2
    rows += [(300, None), (301, [0.1, None]), (302, [NAN] * 6), (303, [INF, 0.0, 0.0, 0.0, 0.0, 0.0]), (320, []), (321, [0.5]), (340, [0.0] * 6), (341, [0.3] * 9), (360, [-0.0] * 6)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in CLASHES})


def best_by_hand(rows, k):
    """Every query row against every other row, shorter vectors padded with zeros, scores held to a long."""
    held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows]
    out = []
    for a, (i, q) in enumerate(whole):
        if i is not None and i % topk.EVERY == 0:
            hits = sorted((-held(sum(x * y for x, y in zip(q, v))), j is None, j or 0) for b, (j, v) in enumerate(whole) if b != a)  # noqa: B905
            out += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(hits[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("settings", [{}, {"pivots": 5, "rings": 3, "block": 7, "chunk": 2, "first": 1, "growth": 2}])
def test_top_k_of_odd_rows(spark, settings):
    rows = odd_vectors()
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % topk.EVERY == 0, **settings).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == best_by_hand(rows, topk.TOP)


def test_top_k_with_few_rows_and_huge_components(spark):
    far = 3.0e38
    rows = [(0, [far, -far, 1.0]), (1, [far, far, 2.0]), (20, [1.5, 0.25, -3.0])]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % topk.EVERY == 0).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == best_by_hand(rows, topk.TOP)
    assert topk.top_k(frame(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(frame(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_prunes_clustered_vectors(spark):
    """Well-separated clusters: far annuli are never visited, and nothing is lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (8, 6))
    rows = [(k, [float(np.float32(c)) for c in centres[k % 8] + rng.normal(0, 0.05, 6)]) for k in range(1600)]
    rows = [(k, [c / math.sqrt(sum(x * x for x in v)) for c in v]) for k, v in rows]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in rows]
    points = topk.distinct_points(topk.integer_vectors(frame(spark, rows)), 20)
    index = topk.Index(points, pivots=16)
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows[::20]], float)
    bound = index.bounds((x * x).sum(axis=1), topk.distances(x, index.pivots))
    all_x = np.array([[math.floor(64 * c) for c in v] for _, v in rows], float)
    least = np.sort(x @ all_x.T, axis=1)[:, -21]
    assert (bound >= least[:, None]).mean() < 0.5
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, pivots=16, first=2, growth=2).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == best_by_hand(rows, 20)


# whitening

def whitened_by_hand(rows):
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in x)
    x = [(i, (*v, *[0] * (width - len(v)))) for i, v in x]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit, float) - np.array(sums) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, e[::-1], u[:, ::-1], float((y * y).sum() / n)


def check_whitened(got, rows):
    x, n, sums, e, u, trace = whitened_by_hand(rows)
    k = int((e[:4] > 1e-9 * e[0]).sum())
    assert len(got) == k * len(x) and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in x)
    assert all(0 <= r.identity_error < 1e-9 for r in got)
    for c in range(k):
        mine = sorted(r.whitened for r in got if r.component == c + 1)
        want = (np.array([v for _, v in x], float) - np.array(sums) / n) @ u[:, c] / math.sqrt(e[c])
        assert min(np.abs(np.sort(want) - mine).max(), np.abs(np.sort(-want) - mine).max()) < 1e-8
        assert all(r.explained == pytest.approx(e[c] / trace, rel=1e-9) for r in got if r.component == c + 1)


def test_whitening_of_odd_rows(spark):
    rows = odd_vectors()
    check_whitened(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_whitening_by_iteration(spark):
    """Wider than the block: the whole recurrence; a flat spectrum with close eigenvalues."""
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitened(whitening.q_whitening(spark, SMALL).collect(), rows)


def test_whitening_of_few_ranks_and_steep_spectra(spark):
    rng = np.random.default_rng(9)
    flat = [(k, [float(np.float32(c)) for c in rng.normal(0, 1, 2) @ rng.normal(0, 1, (2, 40))]) for k in range(3)]
    check_whitened(whitening.whiten(frame(spark, flat)).collect(), flat)  # two ranks, forty columns
    steep = [(k, [float(np.float32(c)) for c in rng.normal(0, 1, 48) * 3.0 ** -np.arange(48.0) * 1e4]) for k in range(300)]
    check_whitened(whitening.whiten(frame(spark, steep)).collect(), steep)


def test_whitening_without_spread(spark):
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5])] * 5)).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [NAN]), (3, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5])]).limit(0)).count() == 0
    far = whitening.whiten(frame(spark, [(1, [3e13]), (2, [-3e13]), (3, [3e30])])).collect()
    assert [r.vec_id for r in far] == [1, 2] and all(r.deviation is None for r in far)


def test_uncertified_components_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="not certified"):
        whitening.q_whitening(spark, SMALL)


# importance resampling

def resampled_by_hand(docs, items, size=2, buckets=10_000):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, size + 1) for i in range(len(words) - n + 1)]
    per = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in per for b in f), Counter(b for _, x in items for b in features(x)[1])
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(buckets)]
    out = []
    for i, n, f in per:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[5] = k
    return Counter(map(tuple, out))


def rows_of(found):
    return Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect())


def test_resampling_of_odd_rows(spark, messy, no_docs, monkeypatch):
    items = [(1, "The quick brown fox, jumps over"), (2, None), (3, "Größe und Maß")]
    target = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in (*CLASHES, "doc_id")})
    docs = [r[:2] for r in messy_rows()]
    assert rows_of(importance.resample(messy, target)) == resampled_by_hand(docs, items)
    assert rows_of(importance.resample(messy, target, size=1, buckets=97)) == resampled_by_hand(docs, items, 1, 97)
    assert rows_of(importance.resample(messy, target, size=3)) == resampled_by_hand(docs, items, 3)
    monkeypatch.setattr(importance, "CHUNK", 50)
    few = importance.count_features(("Ab-c " * 333).encode(), importance.span_pattern(2), 10_000)
    assert few[0] == 2 * 666 - 1 and few[2].sum() == few[0]
    assert importance.resample(no_docs, target).count() == 0
    none = target.limit(0)
    assert rows_of(importance.resample(messy, none)) == resampled_by_hand(docs, [])


def test_drawn_documents_are_the_best(spark):
    docs = spark.createDataFrame([(k, " ".join(["target" if k % 10 == 0 else f"other{k}"] * 25)) for k in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(1, "target " * 5000)], "item_id long, text string")
    ranks = importance.resample(docs, target, percent=10)
    drawn = importance.drawn_documents(docs, ranks)
    assert drawn.columns == docs.columns and drawn.count() == 40
    assert drawn.filter("doc_id % 10 = 0").count() >= 36


def test_numbering_runs_over_all_partitions(spark):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 7, F.lit(5)).alias("key"), "id")
    got = importance.number_in_order(rows.repartition(7), [F.col("key").desc(), F.col("id")], "nth").collect()
    assert [(r.key, r.id) for r in sorted(got, key=lambda r: r.nth)] == sorted(((r.key, r.id) for r in got), key=lambda r: (-r[0], r[1]))
    assert sorted(r.nth for r in got) == list(range(1, 1001))
