"""Operators over groups of rows against brute force, odd rows and empty tables."""

import heapq
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import bottomk, graph, mixing, neighbours, queries, warc
from pagemill.llm.shingles import STEP_BYTES, shingle_set

from .conftest import SMALL


def joined(n, linked):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        a, b = top(i), top(j)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = joined(361, [(a, b) for a, b in edges if a is not None])
    assert all(got.get(i, i) == want[i] for i in range(361))
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_shingles(text, width):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def test_shingle_sets():
    long = "x" * (STEP_BYTES * 2)
    texts = [None, "", " \n", "a", "A\tb\x0bc a b C", "é\x1cö É x", f"{long} y {long} Y", "ab " * STEP_BYTES, f"{'b ' * STEP_BYTES}tail"]
    for width in (1, 2, 5):
        for text in texts:
            found = shingle_set(text, width)
            assert len(found) == len(plain_shingles(text, width)) and sorted(set(found.tolist())) == found.tolist()
        assert set(shingle_set("x Y z u v w", width)) <= set(shingle_set(f"{'b ' * STEP_BYTES} X y Z u v w", width))


def test_near_duplicate_documents(spark, documents, odd):
    base = documents.where("doc_id < 120").select("doc_id", "text")
    words = base.orderBy(F.length("text").desc()).first()["text"].split()[:150]
    rng = random.Random(1)
    copies = []  # a group whose members are near to the first and not all to each other
    for i in range(60):
        text = list(words)
        for _ in range(i % 9):
            text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
        copies.append((1000 + i, " ".join(text)))
    rows = base.union(spark.createDataFrame(copies, "doc_id long, text string"))
    data = rows.collect()
    sets = [plain_shingles(r["text"], 2) for r in data]
    linked = [
        (i, j) for i in range(len(data)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    order = sorted(range(len(data)), key=lambda i: data[i]["doc_id"])
    place = {i: k for k, i in enumerate(order)}
    want = joined(len(data), [(place[i], place[j]) for i, j in linked])
    got = {r["doc_id"]: r for r in bottomk.near_duplicates(rows, bottomk.Sketching(long_list=8, block=16)).collect()}
    for k, i in enumerate(order):
        r = got[data[i]["doc_id"]]
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), data[order[want[k]]]["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_short_supersets_in_template_text(spark):
    rng, rows = random.Random(4), []
    template = [f"t{i}" for i in range(400)]
    for i in range(100):
        held = rng.sample(template, 36) + [f"own{i}x{j}" for j in range(4)]
        more = [f"more{i}x{j}" for j in range(10)]
        rows += [(3 * i, " ".join(held)), (3 * i + 1, " ".join(held + more)), (3 * i + 2, " ".join(more + [f"other{i}x{j}" for j in range(30)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [plain_shingles(text, 1) for _, text in rows]
    want = joined(300, [(i, j) for i in range(300) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    got = {r["doc_id"]: r["component_id"] for r in bottomk.near_duplicates(docs, bottomk.Sketching(width=1)).collect()}
    assert [got[i] for i in range(300)] == want


def test_lists_follow_shared_values_at_any_size(spark):
    """Values of one class alone make no rows, however many there are: up to 1.3 million beside 200 that two classes share."""
    p = bottomk.Sketching(slack=0.1)
    # Each two of the first 40 classes share ten values; the rest of a sketch is its own.
    value = lambda i: F.xxhash64(F.when((F.col("rep") < 40) & (i < 10), F.floor(F.col("rep") / 2)).otherwise(F.col("rep") + 1000), i)
    for n in (4_000, 20_000):
        classes = spark.range(n).select(F.col("id").alias("rep"), F.lit(300).cast("long").alias("n"), F.xxhash64("id").alias("d1"))
        classes = classes.withColumn("sketch", F.transform(F.sequence(F.lit(0), F.lit(63)), value))
        rows = bottomk._postings(classes, p).collect()
        # 61 values are listed: 54 of the class alone and seven that are shared, which make six pairs of neighbours.
        assert p.listed(300) == 61 and len(rows) == 40 * 6 and {r["rep"] for r in rows} == set(range(40))
        assert Counter(Counter(r["value"] for r in rows).values()) == {2: 20 * 6}


def test_lists_hold_the_rarest_values_of_each_set(spark):
    """Against plain counting; two classes share a rep, sets are cut and uncut."""
    rng, p = random.Random(8), bottomk.Sketching(k=16)
    sets = [sorted(rng.sample(range(400), n) if i % 3 else rng.sample(range(60), n)) for i, n in enumerate([1, 2, 5, 9, 16, 18, 20, 21, 40, 55] * 6)]
    rows = [(i // 2 if i < 20 else i, len(s), i, s[: p.k]) for i, s in enumerate(sets)]
    got = bottomk._postings(spark.createDataFrame(rows, "rep long, n long, d1 long, sketch array<long>"), p).collect()
    times = Counter(v for r in rows for v in r[3])
    pairs = []
    for rep, n, _, sketch in rows:
        rare = [v for v in sorted(sketch, key=lambda v: (times[v], v))[: p.listed(n)] if times[v] > 1]
        pairs += [(pair, rep, n) for pair in zip(rare, rare[1:])]
    assert Counter((r["rep"], r["n"]) for r in got) == Counter((rep, n) for _, rep, n in pairs)
    lists = lambda found: sorted(sorted(held) for held in found.values())
    want, have = {}, {}
    for pair, rep, n in pairs:
        want.setdefault(pair, []).append((rep, n))
    for r in got:
        have.setdefault(r["value"], []).append((r["rep"], r["n"]))
    assert lists(have) == lists(want)


def test_near_duplicate_documents_odd_rows(odd):
    got = sorted(map(tuple, bottomk.near_duplicates(odd).collect()), key=str)
    by_id = {r[0]: r for r in got}
    assert len(got) == odd.count()
    assert by_id[2] == (2, 5, 1, False) and by_id[11] == (11, 1, 10, False) and by_id[8][2] == 7
    assert by_id[3] == (3, 0, 3, True) and by_id[5] == (5, 0, 5, True) and by_id[None][2:] == (None, True)
    assert bottomk.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    vectors = [(i, (centres[i % 40] + rng.standard_normal(16) * (0.05 if i % 5 else 0.6)).tolist(), 0) for i in range(400)]
    vectors += [(400 + i, vectors[3][1], 1) for i in range(30)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1)]
    vectors += [(503, [None] + [1.0] * 15, 1), (504, [1.0] * 3, 1), (505, [], 1), (None, [1.0] * 16, 1), (506, [1e300] * 16, 1), (507, [1e-300] * 16, 1)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash"))
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(rows, params=neighbours.Descent(block=16)).collect()}
    fine = vectors[:430] + [v for v in vectors if v[0] in (506, 507)]
    x = np.array([v[1] for v in fine])
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = joined(len(fine), zip(*np.nonzero(near)))
    assert sum(got[v[0]]["n_links"] for v in fine) >= 0.95 * near.sum()
    assert all(got[v[0]]["n_links"] <= n for v, n in zip(fine, near.sum(1)))
    assert sum(got[v[0]]["component_id"] == fine[w][0] for v, w in zip(fine, want)) >= 0.95 * len(fine)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (500, 501, 502, 503, 504, 505, None))
    assert len(got) == len({v[0] for v in vectors})
    assert neighbours.near_duplicates(rows.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.merge(runs, lambda x: x)) == list(heapq.merge(*runs))


def test_archives(spark):
    html = "<p>é\r\n\r\nWARC/1.1\r\n</p>" + "x" * 90
    rows = [(5, "http://B.example.com:80/x?Q#f", html), (3, "https://a.example.com/", html), (4, None, html), (1, "x\r\ny", "short"), (2, "::", "short")]
    rows += [(6, "http://b.example.com/x?q", None), (7, "http://b.example.com/x?q", ""), (None, "http://n/", html), (9, "http://n/", html + "z" * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("captured", F.lit(None).cast("timestamp"))
    found = warc.archive(pages.withColumn("digest", F.lit("clash")), warc.Archiving(file_records=2, range_entries=3)).collect()
    by_id = {r["page_id"]: r for r in found}
    assert len(found) == len(rows)
    for i, url, text in rows:
        raw = (text or "").encode()
        assert by_id[i]["payload_bytes"] == len(raw)
        again = text == html and i in (4, 5)
        assert (by_id[i]["record_type"], by_id[i]["refers_to"]) == (("revisit", 3) if again else ("response", None))
    ordered = sorted(found, key=lambda r: (r["range_no"], r["place"]))
    assert ordered == sorted(found, key=lambda r: (r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]))
    assert by_id[5]["url_key"] == by_id[6]["url_key"] == "com,example,b)/x?q"
    assert warc.archive(pages.limit(0)).count() == 0


def test_schedule_is_pfair(spark):
    weights = {"a": 50, "b": 25, "c": 19, "d": 1, "e": 5}
    rows = sorted(mixing.schedule(spark, weights).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(100))
    done = dict.fromkeys(weights, 0)
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"] and r["k"] == done[r["source"]]
        done[r["source"]] += 1
        assert all(abs(done[s] - w * (r["slot"] + 1) / 100) < 1 for s, w in weights.items())


def test_mix(spark, odd):
    rows = [(i, "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    p = mixing.Mix(period=1000, buckets=8)
    mixed = mixing.mix(docs, "source", "doc_id", mixing.supply_weights(docs, "source", p), p).collect()
    assert len(mixed) == 3000 and len({r["mix_slot"] for r in mixed}) == 3000
    kept = sorted((r for r in mixed if r["mixed"]), key=lambda r: r["mix_slot"])
    assert [r["mix_slot"] for r in kept] == list(range(len(kept)))
    assert abs(sum(r["source"] == "big" for r in kept) / len(kept) - 0.25) < 0.01
    weights = mixing.supply_weights(odd, "source", p)
    assert sum(weights.values()) == p.period
    assert mixing.mix(odd, "source", "doc_id", weights, p).count() == odd.count()
    assert mixing.mix(odd.limit(0), "source", "doc_id", mixing.supply_weights(odd.limit(0), "source", p), p).count() == 0
    assert mixing.mix(odd.limit(0), "source", "doc_id", {"s": 3}, p).count() == 0


def test_mix_holds_a_rare_tail(spark):
    rows = [(i, f"s{i % 20}" if i % 2999 else None) for i in range(1, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    for p in (mixing.Mix(period=1000, buckets=8), mixing.Mix(period=970, least=0.0, buckets=8)):
        weights = mixing.supply_weights(docs, "source", p)
        mixed = sorted(mixing.mix(docs, "source", "doc_id", weights, p).collect(), key=lambda r: r["mix_slot"])
        assert [r["mix_slot"] for r in mixed] == list(range(5999)) and all(r["mixed"] for r in mixed)
        assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in mixed)
        total, done = Counter(r["mix_source"] for r in mixed), Counter()
        for r in mixed:
            done[r["mix_source"]] += 1
            assert all(abs(done[s] - n * (r["mix_slot"] + 1) / 5999) < 3 for s, n in total.items())


def test_pipeline_mixing_loses_no_document(spark):
    rows = [(i, "t", "en", "big" if i % 3 else f"s{i % 7}" if i > 3 else None, 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in found) == list(range(3000))
    assert abs(sum(r["source"] == "big" for r in found[:1000]) / 1000 - 0.25) < 0.01


def test_blocks_find_supersets():
    rng, one, other = np.random.default_rng(3), [], []
    for i in range(600):
        held, whole = ((200, 250), (800, 1000), (210, 250))[i % 3]
        values = rng.integers(0, 2**62, whole)
        one.append((i, i, np.sort(values[:held])))
        other.append((1000 + i, 1000 + i, np.sort(values)))
    p = bottomk.Sketching()
    found = [x for at in range(0, 600, 100) for x in bottomk._block_links(one[at : at + 100], other[at : at + 100], p)]
    assert sorted(found) == [(i, 1000 + i) for i in range(600)]


def test_shared_passages_reach_no_block(spark, monkeypatch):
    """Texts that share half of their words are in long lists, but not among the rarest values of each other."""
    rng, rows = random.Random(6), []
    passage = " ".join(f"p{i}" for i in range(40))
    for i in range(80):
        rows.append((i, " ".join([passage, *(f"own{i}x{j}" for j in range(30))])))
    rows += [(100 + i, f"{rows[i][1]} end") for i in range(0, 80, 7)]
    words = [f"w{i}" for i in range(120)]
    for i in range(60):  # a group whose members are near to some and not to all others
        rows.append((200 + i, " ".join(f"new{rng.randrange(10**6)}" if rng.random() < 0.01 * (i % 12) else w for w in words)))
    sets = [plain_shingles(text, 2) for _, text in rows]
    want = joined(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    met, blocks = [], bottomk._met_in_blocks
    monkeypatch.setattr(bottomk, "_met_in_blocks", lambda members, p: (met.extend(members.collect()), blocks(members, p))[1])
    found = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bottomk.Sketching(long_list=8, block=16))
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert [got[i] for i, _ in rows] == [rows[k][0] for k in want]
    assert met and min(r["rep"] for r in met) >= 200


def test_rarest_values_of_linked_sets_meet(spark):
    """Against plain counting: what the fewest components hold comes first, values of one component alone are not listed."""
    rng, p = random.Random(9), bottomk.Sketching()
    base = [rng.sample(range(300), 25) for _ in range(4)]
    sets = [sorted({v if rng.random() < 0.9 else rng.randrange(300, 10**6) for v in base[i % 4]}) for i in range(60)]
    rows = [(i, len(s), i % 40, s) for i, s in enumerate(sets)]
    got = {}
    for r in bottomk._rarest(spark.createDataFrame(rows, "rep long, n long, component long, set array<long>"), p).collect():
        got.setdefault(r["rep"], set()).add(r["value"])
    holders = {}
    for rep, _, component, s in rows:
        for v in s:
            holders.setdefault(v, set()).add(component)
    for rep, n, _, s in rows:
        first = sorted(s, key=lambda v: (len(holders[v]), v))[: n + 1 - -(-n * 4 // 5)]
        assert got.get(rep, set()) == {v for v in first if len(holders[v]) > 1}
    for a, na, ca, x in rows:
        for b, nb, cb, y in rows:
            if ca != cb and len({*x} & {*y}) * 100 >= len({*x} | {*y}) * p.percent:
                assert got[a] & got[b]


def test_blocks_bounded_by_values(spark):
    rng, base = random.Random(3), list(range(100))
    sets = [sorted({v if rng.random() < 0.9 else rng.randrange(100, 10**6) for v in base}) for _ in range(40)]
    rows = [(i, len(s), i, s, i % 2) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "rep long, n long, component long, set array<long>, clump long")
    found = bottomk._met_in_blocks(members, bottomk.Sketching(block_values=500)).collect()
    linked = lambda i, j: 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})
    assert all((r["u"] - r["v"]) % 2 == 0 and linked(r["u"], r["v"]) for r in found)
    want = joined(40, [(i, j) for i in range(40) for j in range(i) if (i - j) % 2 == 0 and linked(i, j)])
    assert joined(40, [(r["u"], r["v"]) for r in found]) == want and len(set(want)) < 40


def test_common_values_are_counted_exactly(monkeypatch):
    rng = np.random.default_rng(5)
    for dense, pairs in ((bottomk.DENSE, bottomk.PAIRS), (2.0, 50), (0.0, 50)):
        monkeypatch.setattr(bottomk, "DENSE", dense)
        monkeypatch.setattr(bottomk, "PAIRS", pairs)
        for span in (45, 500, 10**6):
            one, other = ([(i, i, np.sort(rng.choice(span, rng.integers(1, 40), replace=False))) for i in range(k)] for k in (30, 47))
            assert (bottomk._common(one, other) == [[len(np.intersect1d(x[2], y[2])) for y in other] for x in one]).all()
            own = np.array([[len(np.intersect1d(x[2], y[2])) for y in one] for x in one])
            assert (np.triu(bottomk._common(one, one), 1) == np.triu(own, 1)).all()


@pytest.mark.parametrize("name", ["stages", "empty"])
def test_pipeline(spark, documents, odd, tmp_path, name):
    docs = odd if name == "stages" else odd.limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if name == "empty":
        assert rows == []
        return
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "pieces"]
    assert all(r["round_trip"] for r in rows)
    ids = [r["doc_id"] for r in rows]
    assert not {2, 3, 4, 5, 8, 12, 13} & set(ids) and len(set(ids)) == len(ids)
    assert set(queries.QUERIES) >= {"pipeline"} and documents.count() and SMALL
