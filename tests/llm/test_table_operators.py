"""Sharding, mixing, WARC, embeddings, language and quality."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import bytesops, embeddings, language, mixing, quality, sharding, warc
from tests.llm.conftest import MEDIUM, SMALL, groups_of, messy_rows

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


# sharding

def check_shards(rows, docs, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [sum(r.size for r in rows if r.shard == s) for s in range(shards)]


def test_shards_have_near_equal_bytes(spark, small_docs):
    rows = sharding.q_sharding(spark, SMALL).collect()
    load = check_shards(rows, small_docs)
    assert max(load) - min(load) <= 0.02 * sum(load) / 8
    assert {(r.doc_id, r.shard) for r in rows} == {(r.doc_id, r.shard) for r in sharding.q_sharding(spark, SMALL).collect()}


def test_shards_of_odd_rows(spark, folder, messy, no_docs):
    rows = sharding.q_sharding(spark, folder(documents=messy)).collect()
    check_shards(rows, [r[:2] for r in messy_rows()])
    assert sharding.shard(no_docs).count() == 0


def test_hot_records_are_spread(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("other words")).otherwise(F.lit("same words here")).alias("text"))
    load = [r.b for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 8 and max(load) < 1.1 * min(load)


def test_slot_map_is_versioned_and_edited(spark, folder):
    path = folder()
    records = sharding.record_slots(spark.read.parquet(f"{MEDIUM}/documents.parquet"))
    sizes = sharding.slot_sizes(records)
    first = sharding.place(sizes, 8)
    sharding.write_map(sharding.map_table(spark, sizes, first, 1), path, 1)
    grown = sharding.rebalance(sizes, first, 9)
    sharding.write_map(sharding.map_table(spark, sizes, grown, 2), path, 2)
    assert {r.vslot: r.shard for r in sharding.read_map(spark, path, 1).collect()} == first
    bytes_of = {s: b for s, b, _ in sizes}
    moved = sum(b for s, b in bytes_of.items() if grown[s] != first[s])
    load = Counter()
    for s, b in bytes_of.items():
        load[grown[s]] += b
    assert moved < 0.2 * sum(bytes_of.values()) and max(load.values()) < 1.05 * sum(load.values()) / 9
    fewer = sharding.rebalance(sizes, grown, 8)
    assert set(fewer.values()) <= set(range(8))


def test_slots_do_not_depend_on_shards_or_partitions(spark):
    """Virtual slots are the same for any shard count, in any partitioning, hot records included."""
    docs = spark.range(2000).select(F.when(F.col("id") % 2 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 > 0, F.concat(F.lit("t"), "id")).otherwise(F.lit("same")).alias("text"))
    seen = [Counter((r.doc_id, r.virtual_slot) for r in sharding.shard(d, n).collect()) for d, n in ((docs, 8), (docs, 16), (docs.repartition(5), 8))]
    assert seen[0] == seen[1] == seen[2]
    assert len({s for i, s in seen[0] if i is None}) > 800
    twice = spark.createDataFrame([(None, None, 1)] * 5 + [(1, "a", 1)] * 3, "k long, t string, x int").repartition(3)
    from furlong.llm.common import store, with_uid
    got = sharding.number_equals(store(with_uid(twice), "equals"), ["k", "t"]).collect()
    assert sorted(r.nth for r in got if r.k is None) == [1, 2, 3, 4, 5] and sorted(r.nth for r in got if r.k) == [1, 2, 3]


# mixing

def mixed(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    return con.execute(mixing.ORACLE_MIXING).fetchall()


def test_mix_of_odd_rows(spark, folder, messy, no_docs):
    d = folder(documents=messy)
    rows = mixing.q_mixing(spark, d).collect()
    assert Counter(tuple(r) for r in rows) == Counter(tuple(r) for r in mixing.q_mixing(spark, d).collect())
    source = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        source[(r.source_size, r.target)].append(r.taken)
    assert sum(r.size for r in rows) == sum(len(SIZE.findall(t or "")) for _, t, _, _ in messy_rows())
    # sources a, b, c, d, e, é, null weigh 3 1 2 3 1 2 3; all but c are held at twice their size
    assert all(abs(sum(t) - target) < 1 for (_, target), t in source.items() if len({x for x in source if x == (_, target)}) == 1 and target > 100)
    assert mixing.mix(no_docs).documents.count() == 0


def test_mix_takes_the_target_of_each_source(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = Counter((i, n, s, t) for i, n, s, _, t in mixed(docs))
    m = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), block_words=64)
    assert Counter((r.doc_id, r.size, r.source_size, r.taken) for r in m.documents.collect()) == want
    per = m.documents.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(0 <= r.g - r.t < 1 for r in per)
    # slots of a source are spread evenly over the schedule
    slots = [(r.i, r.sid) for r in m.schedule.collect()]
    n, half = Counter(s for _, s in slots), max(i for i, _ in slots) // 2
    first = Counter(s for i, s in slots if i <= half)
    assert all(abs(first[s] - n[s] / 2) <= 2 + 0.02 * n[s] for s in n)
    assert sorted(r.rank for r in m.schedule.filter("sid = 0").collect()) == list(range(n[0]))


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), ("d", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # 3030 words for weights 3 1 2 3 1: a and c stop at 20, d at 2000, b takes the rest
    assert got == {"a": 20, "b": pytest.approx(990), "c": 20, "d": 2000, None: 0}


def test_mixing_stage_repeats_and_drops(spark, folder, messy):
    out = mixing.stage_mixing(spark, messy, "")
    assert out.columns == messy.columns and 0 < out.count() <= 2 * len(messy_rows())
    assert out.filter("text is null or trim(text) = ''").count() == 0


# warc

def pages_want(rows):
    best = {}
    for i, _, html in rows:
        p = (html or "").encode()
        best[p] = max(best.get(p, -math.inf), -math.inf if i is None else i)
    return {p: None if b == -math.inf else b for p, b in best.items()}


PAGES = [(1, "http://a.org/x", "same"), (2, "http://www.a.org:80/x#y", "same"), (2, "http://www.a.org:80/x#y", "same"), (None, None, None), (4, "http://b.a.org:81/\r\ny\t1", ""), (5, "http://[bad", "z\r\n\r\nWARC/1.1\r\n\r\n"),
         (None, "http://n.org", "n"), (None, "http://n.org", "n"), (6, "http://a.org/big", "q" * 20_000_000 + "é"), (7, "not a url", "é" * 10)]


def test_archives_round_trip(spark, folder):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    best = pages_want(rows)
    got = {r.page_id: r for r in warc.q_warc(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        p, r = html.encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if best[p] == i else ("revisit", best[p]))


def test_archives_of_odd_pages(spark, folder):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS uid", "2 AS digest", "3 AS top", "4 AS payload")
    rows = warc.q_warc(spark, folder(pages=frame)).collect()
    best = pages_want(PAGES)
    assert Counter((r.page_id, r.payload_bytes) for r in rows) == Counter((i, len((h or "").encode())) for i, _, h in PAGES)
    assert sum(r.record_type == "response" for r in rows) == len(best)
    for r in rows:
        if r.record_type == "response":
            assert r.refers_to is None
    assert warc.scan_index(warc.archive_pages(frame.limit(0))).count() == 0


def test_lookups_read_ranges(spark):
    index = warc.archive_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    hits = warc.lookup(index, "https://A.org/x")
    assert sorted(h["page_id"] for h in hits) == ["1", "2", "2"] and {h["record_type"] for h in hits} == {"response", "revisit"}
    for h in hits:
        headers, block = warc.read_record(spark, h["archive"], h["offset"], h["length"])
        assert headers["WARC-Type"] == h["record_type"] and block.endswith(b"same" if h["record_type"] == "response" else b"\r\n\r\n")
    (big,) = warc.lookup(index, "http://a.org/big")
    assert warc.read_record(spark, big["archive"], big["offset"], big["length"])[1].endswith("qé".encode())
    assert warc.lookup(index, "http://nowhere.org/") == []
    odd = "http://odd.org/a\tb\x01c"    # control characters are percent-encoded in a record
    stored = warc.archive_pages(spark.createDataFrame([(1, odd, "x"), (2, "http://odd.org/ab", "y")], "page_id long, url string, html string"))
    assert [h["page_id"] for h in warc.lookup(stored, odd)] == ["1"]


@pytest.mark.parametrize("part_blocks", [1, 3, 1000])
def test_many_urls_are_looked_up_at_once(spark, folder, part_blocks):
    urls = [None, "", "http://hot.org/"] + [f"http://s{k % 9}.org/p{k % 40}" for k in range(150)] + ["http://hot.org/"] * 60 + ["http://odd.org/a\tb"]
    pages = spark.createDataFrame([(k, u, "x" * k) for k, u in enumerate(urls)], "page_id long, url string, html string")
    path = folder()
    warc.write_archives(pages, path + "/warc", records_per_file=50)
    index = warc.build_index(warc.read_captures(spark, path + "/warc"), block_lines=5)
    every = sorted(warc.lookup_all(index, pages.repartition(5), part_blocks).collect(), key=str)
    assert every == sorted(warc.scan_index(index).collect(), key=str) and len(every) == len(urls)
    some = [u for u in urls[::7]] + ["http://aaa.org/", "http://nowhere.org/", "zzz", "http://odd.org/a\tb"]
    asked = spark.createDataFrame([(u,) for u in some * 2], "url string")
    got = sorted(int(r.page_id) for r in warc.lookup_all(index, asked, part_blocks).collect())
    assert got == [k for k, u in enumerate(urls) if warc.surt(u and warc._header_text(u)) in {warc.surt(x and warc._header_text(x)) for x in some}]
    empty = warc.archive_pages(pages.limit(0))
    assert warc.lookup_all(empty, pages).count() == 0 and warc.lookup_all(index, asked.limit(0)).count() == 0


def test_directory_finds_every_key_in_small_blocks(spark, folder):
    keys = [f"http://h{k % 7}.org/{k % 40}" for k in range(300)]
    pages = spark.createDataFrame([(k, u, str(k % 150)) for k, u in enumerate(keys)], "page_id long, url string, html string")
    path = folder()
    warc.write_archives(pages, path + "/warc", records_per_file=50)
    index = warc.build_index(warc.read_captures(spark, path + "/warc"), block_lines=7)
    assert index.directory.count() > 40
    for u in set(keys[:25]):
        assert {h["page_id"] for h in warc.lookup(index, u)} == {str(k) for k, x in enumerate(keys) if x == u}


# embeddings

def linked(rows, threshold=0.95):
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in ok}
    links = [(a, b) for x, a in enumerate(ok) for b in ok[x + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    return links


def test_embeddings_reach_every_link(spark):
    """Copies, scaled copies, near copies and random vectors; recall is 1 here, 0.9 is asked."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 48)).astype(np.float32)
    near = base[:60] + rng.standard_normal((60, 48)).astype(np.float32) * 0.15
    rows = [(k, v.tolist()) for k, v in enumerate([*base, *near, *base[:5], *(base[5:10] * 4), *np.repeat(base[:1], 30, 0)])]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    links = linked(rows)
    n = Counter(x for link in links for x in link)
    of = groups_of(len(rows), links)
    assert len(links) > 500
    assert sum(r.n_links for r in got.values()) >= 0.95 * 2 * len(links)
    assert all(got[k].n_links <= n[k] for k in n)
    assert np.mean([got[k].component_id == of[k] for k in range(len(rows))]) >= 0.95


@pytest.mark.parametrize("common", [0.0, 0.5, 0.7])
def test_embeddings_keep_their_links_when_vectors_share_a_direction(spark, common):
    """700 pairs at cosine 0.955; all vectors lean towards one direction, so that
    the mean cosine of any two is ``common``."""
    rng = np.random.default_rng(8)
    lean = embeddings.unit(rng.standard_normal((1, 64)))
    def turned(m):
        free = rng.standard_normal((m, 64))
        free = embeddings.unit(free - (free @ lean.T) * lean)
        return np.sqrt(common) * lean + np.sqrt(1 - common) * free
    x = turned(4000)
    to = rng.standard_normal((700, 64))
    to = embeddings.unit(to - (to * x[:700]).sum(axis=1, keepdims=True) * x[:700])
    x = np.concatenate([x, 0.955 * x[:700] + np.sqrt(1 - 0.955**2) * to]).astype(np.float32)
    d = embeddings.unit(x.astype(np.float64))
    want = (d @ d.T >= 0.95).sum(axis=1) - 1
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame).collect()}
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[k] <= n for k, n in enumerate(want.tolist()))
    if common == 0.7:
        exact = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame, exact=True).collect()}
        assert [exact[k] for k in range(len(x))] == want.tolist()


def test_embeddings_over_the_given_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()]
    links = linked(rows)
    of = groups_of(len(rows), links)
    got = {r.vec_id: r for r in embeddings.q_embeddings(spark, MEDIUM).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(links)
    assert all(got[rows[k][0]].component_id == rows[of[k]][0] for k in range(len(rows)) if of[k] == k)


def test_embeddings_of_odd_vectors(spark, folder):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, nan, 0.0]), (5, [inf, 1.0, 0.0]), (6, [1.0, None, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [2.0, 4.0, 6.0]), (9, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.0]),
            (None, [1.0, 2.0, 3.0]), (10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [-0.0, 1.0, 0.0]), (13, [0.0, 1.0, 0.0]), (14, [1e-30, 2e-30, 3e-30])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS cid", "3 AS root", "4 AS vec", "5 AS n")
    got = Counter(tuple(r) for r in embeddings.q_embeddings(spark, folder(embeddings=frame)).collect())
    want = Counter({(k, 0, k, True): 1 for k in range(1, 7)})
    want.update({(7, 5, 7, True): 1, (8, 5, 7, False): 1, (9, 5, 7, False): 2, (None, 5, 7, False): 1, (14, 5, 7, False): 1, (10, 1, 10, True): 1, (11, 1, 10, False): 1, (12, 1, 12, True): 1, (13, 1, 12, False): 1})
    assert got == want
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


# language

def code_lengths(trained, text):
    """Bits of each byte by language, through all parts of the model."""
    data = np.frombuffer(text, np.uint8)
    code, order = language.grams(data, np.array([0, len(text)])), np.full(len(text), language.ORDER, np.int8)
    bits = sum(part.value.add_bits(code, order) for part in trained.parts)
    assert not order.any()
    return bits


def plain_tree(texts):
    tree = {x: defaultdict(Counter) for x in texts}
    for x, ts in texts.items():
        for t in ts:
            p = bytes([language.PAD] * 3) + t
            for k in range(3, len(p)):
                for o in range(4):
                    tree[x][p[k - o : k]][p[k]] += 1

    def bits(x, context, byte):
        seen = tree[x].get(context)
        if seen is None:
            return bits(x, context[1:], byte) if context else 8.0
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return -math.log2(seen[byte] / (total + kinds))
        return -math.log2(kinds / (total + kinds)) + (bits(x, context[1:], byte) if context else 8.0)

    def lengths(text):
        p = bytes([language.PAD] * 3) + text
        return [[bits(x, p[k - 3 : k], p[k]) for x in sorted(texts)] for k in range(3, len(p))]

    return lengths


@pytest.mark.parametrize("cells", [language.MODEL_CELLS, 2000, 600])
def test_code_lengths_match_a_plain_context_tree(spark, monkeypatch, cells):
    """Whole, and cut into parts in the middle of languages and orders."""
    monkeypatch.setattr(language, "MODEL_CELLS", cells)
    rng = np.random.default_rng(9)
    texts = {f"l{k}": ["".join(rng.choice(list("abcdef é日"), 60)) for _ in range(3)] for k in range(3)} | {"aa": ["abracadabra", "aaab"], "bb": ["bananaé", "b"], "none": [""]}
    trained = language.train(spark.createDataFrame([(t, x) for x, ts in texts.items() for t in ts], "text string, lang string"))
    assert trained.langs == sorted(texts) and (len(trained.parts) == 1) == (cells > 10_000)
    lengths = plain_tree({x: [t.encode() for t in ts] for x, ts in texts.items()})
    for text in (b"abra", b"banana", b"zebra \xc3\xa9", b"\n\n\nab", "日本é日a\uffffé".encode(), bytes(range(256)), texts["l1"][0].encode()):
        assert np.allclose(code_lengths(trained, text), lengths(text), atol=1e-4)


@pytest.mark.parametrize("cells", [language.MODEL_CELLS, 20_000])
def test_scores_are_those_of_the_code_lengths(spark, monkeypatch, cells):
    """Of one part or many, over slices of a batch."""
    monkeypatch.setattr(language, "MODEL_CELLS", cells)
    rng = np.random.default_rng(9)
    docs = [(k, "".join(rng.choice(list("abcdefgh é"), 300)), f"l{k % 6}") for k in range(40)] + [(40, "", "a-none"), (41, "", "l9")]
    texts = defaultdict(list)
    for _, t, x in docs:
        texts[x].append(t.encode())
    lengths = plain_tree(texts)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    trained = language.train(frame)
    assert (len(trained.parts) == 1) == (cells > 20_000)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame.select("doc_id", "text"), trained).select("row.doc_id", "lang_pred", "score").collect()}
    for k, t, _ in docs[:-2]:
        bits = np.sum(lengths(t.encode()), axis=0)
        assert got[k][0] == sorted(texts)[bits.argmin()] and math.isclose(got[k][1], 1 / np.exp2(bits.min() - bits).sum(), rel_tol=1e-3)
    assert got[40] == got[41] == ("und", 0.0)


def test_parts_cover_all_codes(monkeypatch):
    monkeypatch.setattr(language, "MODEL_CELLS", 100)
    sizes = [(3, 0, 10), (3, 5, 60), (3, 9, 30), (3, 60_000, 90), (2, 7, 5), (2, 200, 40)]
    parts = language.cut_parts(sizes, 1)
    for order in (3, 2):
        ranges = [x[1:] for part in parts for x in part if x[0] == order]
        assert ranges[0][0] == 0 and ranges[-1][1] == (1 << 8 * (order + 1)) - 1
        assert all(a[1] + 1 == b[0] for a, b in zip(ranges[:-1], ranges[1:], strict=True))
    held = [sum(n for order, prefix, n in sizes for x in part if x[0] == order and x[1] <= prefix << 16 <= x[2]) for part in parts]
    assert sum(held) == 235 and max(held) <= 100 and language.cut_parts([], 3) == [[(3, 0, 2**32 - 1), (2, 0, 2**24 - 1)]]


def test_languages_are_told_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = language.q_language(spark, MEDIUM).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert len(rows) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_languages_of_odd_rows(spark, folder, messy, no_docs):
    rows = language.q_language(spark, folder(documents=messy)).collect()
    letter = {i: any(c.isalpha() for c in t or "") for i, t, _, _ in messy_rows() if i is not None}
    assert len(rows) == len(messy_rows())
    for r in rows:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not letter[r.doc_id]) and (r.score == 0) == (r.lang_pred == "und")
    assert {r.lang_pred for r in rows} <= {"en", "de", "ja", "und"}
    assert language.train(no_docs) is None
    assert {tuple(r) for r in language.identify(messy.select("doc_id", "text"), None).select("lang_pred", "score").collect()} == {("und", 0.0)}
    kept = language.stage_language(spark, messy, "")
    assert kept.columns == messy.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, _, _ in messy_rows())


# quality

def area(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_quality_of_held_out_rows(spark):
    rows = quality.q_quality(spark, MEDIUM).toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert area(held.score.to_numpy(), held.quality.to_numpy()) > 0.97
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_quality_of_odd_rows(spark, folder, messy, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (7, 1), (None, 1), (10, None), (9, 1), (12, 1), (13, 1)], "doc_id long, quality int")
    rows = quality.q_quality(spark, folder(documents=messy, labels=labels)).collect()
    assert len(rows) == len(messy_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    none = quality.score_quality(messy, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert quality.score_quality(no_docs, labels).count() == 0


def frame_of(spark, x, trusted):
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, x array<double>")
    return rows, spark.createDataFrame([(int(k),) for k in np.flatnonzero(trusted)], "doc_id long")


def test_risk_is_non_negative_and_separates(spark):
    rng = np.random.default_rng(8)
    good = lambda n: np.exp(rng.normal(1.5, 1, (n, len(quality.FEATURES))))
    bad = lambda n: np.exp(rng.normal(-1.5, 1, (n, len(quality.FEATURES))))
    x = np.concatenate([good(1800), bad(1200)])
    m = quality.fit(*frame_of(spark, x, np.arange(3000) < 900))
    assert 0.5 < m.prior < 0.75
    assert (m.logit(good(500)) > 0).mean() > 0.98 and (m.logit(bad(500)) < 0).mean() > 0.98


@pytest.mark.parametrize("bounded", [True, False])
def test_risk_of_all_rows_matches_plain_sums(spark, bounded):
    rng = np.random.default_rng(5)
    idx = rng.integers(0, quality.BINS, (300, len(quality.FEATURES)))
    trusted = rng.random(300) < 0.3
    rows = spark.createDataFrame([(bytes(v.astype(np.uint8)), bool(t)) for v, t in zip(idx, trusted, strict=True)], "cells binary, trusted boolean")
    risk = quality.Risk(rows, 0.6, bounded)
    wide = np.zeros((300, quality._CELLS + 1))
    wide[np.arange(300)[:, None], idx + np.arange(0, quality._CELLS, quality.BINS)] = 1
    wide[:, -1] = 1

    def plain(w):
        z = wide @ w
        loss = (lambda t: 1 / (1 + np.exp(t))) if bounded else (lambda t: np.log1p(np.exp(-t)))
        return 0.6 * loss(z[trusted]).mean(), loss(-z).mean() - 0.6 * loss(-z[trusted]).mean()

    w = rng.normal(0, 0.3, quality._CELLS + 1)
    for at in (w, np.full_like(w, 0.4) * (wide[trusted].mean(0) - wide.mean(0) > 0)):
        got = risk.parts(at)
        assert np.allclose([got[0], got[2]], plain(at))
        for k in (3, 200, quality._CELLS):  # gradients, by differences
            step = np.zeros_like(at)
            step[k] = 1e-5
            assert np.allclose([got[1][k], got[3][k]], (np.array(plain(at + step)) - plain(at - step)) / 2e-5, atol=1e-7)


def test_descent_ends_where_a_plain_one_does():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, 8)), rng.integers(0, 2, 40)
    calls = []

    def risk(w):
        calls.append(1)
        z = a @ w
        return np.logaddexp(0, z).mean() - (b * z).mean() + 0.005 * w @ w, a.T @ (1 / (1 + np.exp(-z)) - b) / 40 + 0.01 * w

    got, plain = quality.minimise(risk, np.zeros(8)), np.zeros(8)
    assert len(calls) < 60
    for _ in range(20_000):
        plain -= 0.1 * risk(plain)[1]
    assert np.allclose(got, plain, atol=2e-3)


def test_quantiles_cover_all_rows(spark):
    rng = np.random.default_rng(7)
    x = np.exp(rng.normal(0, 2, (5000, len(quality.FEATURES))))
    x[:4000, 2] = 0
    edges = quality.quantile_edges(frame_of(spark, x, [])[0].repartition(7))
    want = np.quantile(x, np.arange(1, quality.BINS) / quality.BINS, axis=0, method="inverted_cdf").T
    assert (edges <= want).all() and (edges * (1 + 2**-8) >= want).all()


def test_features_of_a_slice_do_not_depend_on_its_neighbours():
    texts = ["Und Und Und", "", "One line.\nOne line.\nTwo | three !!", "ÉÈ abc 123", "x" * 40 + " yy"]
    whole = quality.features(np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    for t, row in zip(texts, whole, strict=True):
        data = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(quality.features(data, np.array([0, len(data)]))[0], row)


def test_slices_cover_all_rows():
    import pyarrow as pa
    texts = pa.array(["a" * 50, None, "", "é" * 30, "b" * 500, "c"])
    got = [(i, j, bytes(d)) for i, j, d, _ in bytesops.slices(texts, 100)]
    assert b"".join(d for *_, d in got) == "".join(t or "" for t in texts.to_pylist()).encode()
    assert got[0][0] == 0 and got[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(got[:-1], got[1:], strict=True))


def test_reversed_host_keys():
    assert warc.surt("http://www.A.org:80/x?q=1#f") == "org,a)/x?q=1" and warc.surt("https://b.a.org:81") == "org,a,b:81)/"
    assert warc.surt(None) == "" and warc.surt("http://[bad") == "http://[bad"
