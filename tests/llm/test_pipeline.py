"""Pipeline stages against brute force, and the entry point's names."""

from collections import Counter

import corpus_pipeline
from furlong.llm.common import read_table, store
from tests.llm.conftest import MEDIUM, groups_of
from tests.llm.test_text_operators import contamination, simple_fingerprint


def test_stages_match_brute_force(spark):
    docs = read_table(spark, MEDIUM, "documents")
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, MEDIUM), f"test-{name}")
        outs.append(docs)
    assert all(o.columns == columns for o in outs[:-1])
    rows = [[(r.doc_id, r.text) for r in o.collect()] for o in outs[:-1]]
    start = [(r.doc_id, r.text) for r in read_table(spark, MEDIUM, "documents").collect()]
    assert Counter(rows[0]) == Counter((i, t) for i, t in start if any(c.isalpha() for c in t or ""))
    fps = [simple_fingerprint(t) for _, t in rows[0]]
    of = groups_of(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {}
    for k, (i, t) in zip(of, rows[0], strict=True):
        least[k] = min(least.get(k, (i, t)), (i, t))
    assert Counter(rows[1]) == Counter(least.values())
    items = [(r.item_id, r.text) for r in read_table(spark, MEDIUM, "benchmark").collect()]
    clean = {r[0] for r in contamination(rows[1], items) if not r[5]}
    assert Counter(rows[2]) == Counter((i, t) for i, t in rows[1] if i in clean) and len(rows[2]) < len(rows[1])
    times = Counter(rows[3])
    assert set(times) <= set(rows[2]) and set(times.values()) <= {1, 2}
    last = outs[-1].collect()
    assert Counter(r.doc_id for r in last) == Counter(i for i, _ in rows[3])
    load = Counter()
    for r in last:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 0.05 * max(load.values())


def test_language_stage_uses_its_prediction(spark):
    """Texts without a label get the language that they are in, and a wrong label is put right."""
    rows = [(r.doc_id, r.text, r.lang) for r in read_table(spark, MEDIUM, "documents").collect() if r.lang and len(r.text or "") > 400]
    hidden = [(i, t, None if i % 5 == 1 else "xx" if i % 97 == 2 else lang) for i, t, lang in rows] + [(None, None, "en"), (-1, "12 34", "en"), (-2, "", None)]
    docs = spark.createDataFrame(hidden, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "'clash' AS row", "1 AS score")
    out = corpus_pipeline.STAGES[0][1](spark, docs, MEDIUM)
    assert out.columns == docs.columns
    got = {r.doc_id: r.lang for r in out.collect()}
    assert set(got) == {i for i, _, _ in rows}
    blank = [(got[i], lang) for i, _, lang in rows if i % 5 == 1]
    assert len(blank) > 50 and sum(a == b for a, b in blank) >= 0.97 * len(blank)
    wrong = [(got[i], lang) for i, _, lang in rows if i % 5 != 1 and i % 97 == 2]
    assert sum(a == b for a, b in wrong) >= 0.5 * len(wrong)


def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_empty_and_odd_documents_pass_through(spark, folder, messy, no_docs):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and then")], "item_id long, text string")
    assert corpus_pipeline.run(spark, folder(documents=no_docs, benchmark=bench)).count() == 0
    out = corpus_pipeline.run(spark, folder(documents=messy, benchmark=bench)).collect()
    ids = {r.doc_id for r in out}
    assert 13 in ids and not ids & {1, 2, 3, 4, 5, 6}
