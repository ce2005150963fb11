"""Operators for training data: brute force, round trips, held-out labels, odd inputs."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlrisk.llm import language, line_rules, mixing, near_dedup, packing, quality, queries, scratch, texts, topk, toxicity, url_filter, warc
from urlrisk.llm.components import components, merged

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, _text string"


def doc(i, text, source="a", lang="en"):
    return (i, text, lang, source, None if text is None else len(text), 7, "clash")


def odd(spark):
    """Null, empty, blank, very long, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))
    rows = [doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, long), doc(5, "a b c d e f"), doc(5, "a b c d e f"),
            doc(None, "a b c d e f"), doc(6, "A B c d e f", None), doc(7, "x y"), doc(8, long + " tail")]
    return spark.createDataFrame(rows, DOCS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_url_filter_rules_paths_and_odd_urls(spark):
    pages = spark.createDataFrame(
        [(1, "https://A.b.Example.NET/en/x?q=/de/"), (1, "https://A.b.Example.NET/en/x?q=/de/"), (2, None), (3, "no scheme"), (4, "http://net"),
         (5, "http://x.net/"), (6, "http://xexample.com/de/"), (7, "http://example.com/de/a#/"), (8, "http://q.org/fr/"), (None, "http://q.org/en"),
         (9, "http://h.net?x"), (10, "http://" + "a." * 60 + "net/" + "b/" * 60)], "page_id long, url string")
    got = url_filter.judge(pages.withColumn("RULE", F.lit(1)), url_filter.rules_table(spark, queries.URL_RULES))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    found = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert got.count() == 12
    assert found == {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("net/", "block"),
                     6: (None, "allow"), 7: ("example.com/de/", "block"), 8: ("org/fr/", "allow"), None: (None, "allow"),
                     9: (None, "allow"), 10: ("net/", "block")}


def test_url_filter_rules_within_a_segment(spark):
    rules = url_filter.rules_table(spark, [("x.y", "/ab", "block"), ("x.y", "", "allow"), (None, "/", "block")])
    pages = spark.createDataFrame([(1, "u://x.y/abc/d"), (2, "u://z.x.y/a"), (3, "u://x.y")], "page_id long, url string")
    assert [r.rule for r in url_filter.judge(pages, rules).orderBy("page_id").collect()] == ["x.y/ab", "x.y", "x.y"]
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_url_filter_of_very_long_urls(spark):
    """A URL of a megabyte: many labels, many segments, and rules that fit it deep down."""
    labels, segments = "a." * 20_000, "s/" * 480_000
    rules = url_filter.rules_table(spark, [("net", "/", "block"), ("a.net", "/s/s/s/", "allow"), ("net", "/" + "s/" * 300 + "s", "block"), ("a.net", "/x/", "allow")])
    pages = spark.createDataFrame([(1, f"http://{labels}net/{segments}"), (2, "http://b.net/" + segments), (3, f"http://{labels}org/")], "page_id long, url string")
    got = {r.page_id: (len(r.rule or ""), r.verdict) for r in url_filter.judge(pages, rules).select("page_id", "rule", "verdict").collect()}
    assert got == {1: (3 + 1 + 601, "block"), 2: (605, "block"), 3: (0, "allow")}


@pytest.mark.parametrize("least", [0, 3])
def test_warc_round_trip_with_separators_in_payloads(spark, least):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n"
    data = [(3, "http://a", tricky), (1, "http://b\r\nX: y", tricky), (2, None, None), (4, "u", ""), (5, "u", "é\r\n"), (5, "u", "é\r\n"),
            (None, "u", "é\r\n"), (6, "u", "\r\n"), (7, "u", "x" * 300_000), (8, "v", "x" * 300_000), (9, "u", "é\r\n")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("clash"))
    path = scratch.Scratch(spark, "warc-test").path("archives")
    warc.write_archives(pages, path, min_payload=least)
    back = warc.read_archives(spark, path, payloads=True).collect()
    assert len(back) == len(data)
    first = {}
    for i, _, html in data:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    want = collections.Counter()
    for i, _, html in data:
        f = first.get(html or "")
        again = i is not None and f is not None and i > f
        want[i, len((html or "").encode()), "revisit" if again else "response", f if again else None, None if again else (html or "").encode()] += 1
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back)
    assert got == want
    path = scratch.Scratch(spark, "warc-test").path("none")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_tokens_equal_those_of_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "don't, it's. WE'LL (x).", "Été, ÇA va? İI Σς.", "<|startoftext|> A<|endoftext|>,b <|ENDOFTEXT|>", "a\u0301b \u0085 \x1c ١٣ 漢字🙂", "z. z.. z ." * 500, "plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in packing.pieces(df, capacity=100).orderBy("doc_id", "piece").collect():
        assert r.start == 100 * r.piece and r.length == len(r.ids) // 4 <= 100
        got[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert [got[i] for i in range(len(texts))] == [own.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_packing_is_gapless_and_close_to_the_bound(spark):
    packed = packing.pack(packing.pieces(odd(spark), 64), 64, group_rows=500).collect()
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = 0
        for offset, length in sorted(b):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert {r.doc_id for r in packed if r.length == 1} >= {1, 2, 3}
    whole = packing.sequences(packing.pack(packing.pieces(odd(spark), 64), 64)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in packed)
    assert packing.pack(packing.pieces(odd(spark).limit(0))).count() == 0


def test_packing_in_place_shuffles_nothing_and_packs_as_well(spark):
    pieces = packing.pieces(odd(spark).repartition(3), 64)
    placed = packing.pack(pieces, 64, group_rows=50, in_place=True)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    packed = placed.collect()
    key = lambda r: (r.doc_id or 0, r.piece, r.start, r.length, bytes(r.ids))
    assert sorted(map(key, packed)) == sorted(map(key, pieces.collect()))
    fill = collections.defaultdict(list)
    for r in packed:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        ends = [0, *(at + n for at, n in sorted(parts))]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
    groups = 3 + len(packed) // 50
    assert len(fill) <= -(-sum(r.length for r in packed) // 64) + groups
    assert packing.pack(packing.pieces(odd(spark).limit(0)), in_place=True).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # Greedy takes 6, 3 and leaves a gap of 1; 2 + 2 fill the 4 that 3 gives free.
    bins = packing.best_two_fit([6, 3, 2, 2], 10)
    assert sorted([sorted(b) for b in bins]) == [[0, 2, 3], [1]]
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 600, 3000).tolist()
    bins = packing.best_two_fit(lengths, 1000)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sum(lengths[i] for i in b) <= 1000 for b in bins)
    assert len(bins) <= math.ceil(sum(lengths) / 1000) * 1.01


def brute_near(docs, k):
    sets, ids = {}, []
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set())
        ids.append(i)
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return least


@pytest.mark.parametrize("crowd", [1024, 8])
def test_near_duplicates_equal_brute_force(spark, crowd):
    rng = np.random.default_rng(3)
    docs = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(60)]
        for c in range(8):
            docs.append((len(docs), " ".join(words)))
            if c % 3 == 1:
                continue  # an exact copy follows
            words = list(words)
            words[int(rng.integers(60))] = f"n{len(docs)}"
    docs += [(500, "a b"), (501, "A  b"), (502, "a b c"), (503, None), (504, ""), (505, " ")]
    forest = near_dedup.Forest(words=4, crowd=crowd)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(0)), forest).collect()
    want = brute_near(docs, 4)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def crowded_pairs(pairs=150, seed=5):
    """Documents that share a passage (similarity about 0.7), far too many for a `crowd` of
    8; document i and i + `pairs` are linked at about 0.81 and nothing else is."""
    rng = np.random.default_rng(seed)
    draw = lambda name, n: " ".join(f"{name}{x}" for x in rng.integers(0, 10**9, n))
    passage, own = draw("p", 264), [draw(f"g{i}w", 22) for i in range(pairs)]
    return [(k * pairs + i, f"{passage} {own[i]} {draw(f'd{k}w{i}x', 33)}") for k in range(2) for i in range(pairs)]


@pytest.mark.parametrize("words", [4, 5])
def test_crowded_regions_equal_brute_force_with_the_shipped_forest(spark, words):
    docs = crowded_pairs()
    want = brute_near(docs, words)
    assert len(docs) > 4 * 8 and len(set(want.values())) == len(docs) // 2
    forest = near_dedup.Forest(words=words, crowd=8)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), forest).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("most_pairs", [40, 0])
def test_deeper_forests_take_what_crowded_regions_leave(spark, most_pairs):
    docs = crowded_pairs(pairs=60, seed=8)
    forest = near_dedup.Forest(words=4, crowd=8, most_pairs=most_pairs)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), forest).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_near(docs, 4)


def test_deeper_forests_miss_a_pair_as_rarely():
    forest, seen = near_dedup.Forest(), []
    while forest:
        seen.append((forest.min_depth, forest.trees, (1 - 0.8**forest.min_depth) ** forest.trees))
        forest = forest.deeper()
    assert [x[:2] for x in seen] == [(3, 16), (5, 29), (8, 63)] and all(x[2] < 1.2e-5 for x in seen)


def test_a_large_group_of_near_copies_with_the_shipped_forest(spark):
    """3,000 different copies of one text with one or two words changed, and 3,000 texts
    that share a passage with it; links by exact counts of common shingles."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(6_000):
        words = list(base) if i % 2 else base[:80] + [f"o{i}x{j}" for j in range(40)]
        for at in rng.integers(0, 120, int(rng.integers(1, 3))):
            words[at] = f"n{i}x{at}"
        docs.append((i, " ".join(words)))
    shared, cells = {}, []
    for i, text in docs:
        w = text.split()
        cells.append({shared.setdefault(tuple(w[j : j + 4]), len(shared)) for j in range(117)})
    common = [x for x, n in collections.Counter(x for c in cells for x in c).items() if n > 1]
    place = {x: k for k, x in enumerate(common)}
    has = np.zeros((len(docs), len(common)), np.float32)
    for i, c in enumerate(cells):
        has[i, [place[x] for x in c if x in place]] = 1
    size = np.array([len(c) for c in cells], np.float32)
    least = np.arange(len(docs))
    links = [np.flatnonzero(100 * (both := has[i] @ has.T) >= 80 * (size[i] + size - both)) for i in range(len(docs))]
    while True:
        low = np.array([least[x].min() if len(x) else least[i] for i, x in enumerate(links)])
        if (low == least).all():
            break
        least = low
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), near_dedup.Forest(words=4)).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(least.tolist()))
    assert len(set(least.tolist())) > 3_000 and collections.Counter(least.tolist()).most_common(1)[0][1] > 2_900


def brief_pairs(n, union, common):
    """Briefs of n pairs of random sets with `union` members, `common` of them in both."""
    rng, forest, one, two = np.random.default_rng(union), near_dedup.Forest(), [], []
    for _ in range(n):
        values = rng.integers(0, 2**64, union, dtype=np.uint64)
        half = common + (union - common) // 2
        one.append(near_dedup.brief(np.sort(values[:half]), forest))
        two.append(near_dedup.brief(np.sort(np.concatenate([values[:common], values[half:]])), forest))
    return [np.frombuffer(b"".join(x), np.uint8).reshape(n, -1) for x in (one, two)]


@pytest.mark.parametrize("union", [1, 2, 5, 10, 45, 150, 500, 3000, 20_000])
def test_briefs_lose_no_pair_at_the_threshold_and_drop_distant_ones(union):
    forest, n = near_dedup.Forest(), 400
    for width in (forest.bins // 4, forest.bins):
        common = -(-8 * union // 10)
        x, y = (b[:, :width] for b in brief_pairs(n, union, common))
        assert near_dedup._near(x, y, np.full(n, union + common), forest)[1].sum() >= n - 1
    if union >= 150:
        common = union * 65 // 100
        x, y = brief_pairs(n, union, common)
        similar, near = near_dedup._near(x, y, np.full(n, union + common), forest)
        assert not near.any() and abs(similar.mean() - 6500) < 100


def test_merged_renames_only_touched_components(spark):
    known = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, component long")
    more = spark.createDataFrame([(6, 2), (20, 9), (30, 31), (1, 2)], "a long, b long")
    out = merged(known, more, scratch.Scratch(spark, "t")).collect()
    assert {r.node: r.component for r in out} == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}
    assert len(out) == 9
    assert merged(known, more.limit(0), scratch.Scratch(spark, "t")).count() == 6


def test_near_duplicates_of_odd_rows(spark):
    got = near_dedup.near_duplicates(odd(spark), near_dedup.Forest(words=4)).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert len(got) == 10
    assert by == {1: {(1, True)}, 2: {(2, True)}, 3: {(3, True)}, 4: {(4, True)}, 5: {(5, True)}, None: {(None, True)}, 6: {(5, False)},
                  7: {(7, True)}, 8: {(4, False)}}
    assert near_dedup.near_duplicates(odd(spark).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = components(spark.createDataFrame(links, "a long, b long"), scratch.Scratch(spark, "cc")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)} | {(200, 200), (201, 200)}


def test_toxicity_and_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for query, label in ((queries.op5_toxicity, "toxic"), (queries.op7_quality, "quality")):
        scored = query(spark, folder)
        assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
        held = scored.where("held_out").join(labels, "doc_id").select("predicted", label, "score").collect()
        assert sum(r.predicted == r[label] for r in held) > 0.95 * len(held)
        assert all(0 <= r.score <= 1 for r in held)


def test_classifiers_of_odd_rows_and_without_labels(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        for some in (labels, labels.limit(0)):
            model = module.train(docs, some, F.lit(True))
            got = toxicity.score(docs, model).collect()
            assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
            assert toxicity.score(docs.limit(0), model).count() == 0


def test_risk_is_corrected_by_the_prior():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    x = np.stack([truth ^ (rng.random(4000) < 0.02), rng.random(4000) < 0.5], axis=1).astype(float)
    positive = truth & (rng.random(4000) < 0.3)
    w, b = toxicity.fit_nnpu(x, positive, truth[~positive].mean(), toxicity.Settings())
    assert ((x @ w + b > 0) == truth)[~positive].mean() > 0.95


def test_language_on_held_out_rows_and_odd_ones(spark):
    folder = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = queries.op6_language(spark, folder).where("held_out").join(truth, "doc_id").where("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    docs = odd(spark)
    profiles = language.prototypes(docs, F.lit(True))
    got = language.identify(docs, profiles, carry=["doc_id", "_text", "lang"]).collect()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and {r.lang_pred for r in got if r.doc_id == 5} == {"en"}
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(docs.limit(0), profiles).count() == 0 and language.prototypes(docs.limit(0), F.lit(True)) == {}


def test_trigram_vectors_bind_and_bundle():
    space = language.Space(dimensions=64)
    e = language.Encoder(space)
    got = e.encode(["Ab, ", None, "12"])
    t = {c: e.tables[0][e.places[ord(c) if c != " " else 0]].astype(int) for c in "ab "}
    one = np.roll(t[" "], 2) * np.roll(t["a"], 1) * t["b"] + np.roll(t["a"], 2) * np.roll(t["b"], 1) * t[" "]
    assert (got[0] == one).all() and not got[1:].any()


@pytest.mark.parametrize("index", [topk.Index(), topk.Index(shard_values=300, query_rows=3, levels=3, step=5, few=0.1)])
def test_top_k_equals_brute_force(spark, index):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(150)] + [(200 + i, [0.3] * 8) for i in range(60)]
    data += [(1000, None), (1020, [None] * 8), (1040, [float("nan")] * 8), (None, [9.0] * 8), (1060, [float("inf")] * 8), (1080, [0.5, 0.5]), (3, [0.9] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in data
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in {i: v for i, v in reversed(usable) if i % 20 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in usable if i != q)[:20]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20, 64.0, index).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_targets_epochs_and_order(spark):
    data = [(i, " ".join(["w"] * (1 + i % 5)), s) for i, s in enumerate(["big"] * 300 + ["small"] * 4 + [None] * 30 + ["ä"] * 50 + ["empty"] * 2 + ["zz"] * 40)]
    data = [(i, "" if s == "empty" else t, s) for i, t, s in data] + [(None, "a b", "zz"), (5, "w", "big"), (5, None, "big")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit(9)).withColumn("target", F.lit("x"))
    got = mixing.mix(docs, partitions=5).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
    want = brute_targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
    assert len(got) == len(data)
    assert all(abs(taken[s] - want[s]) <= 5 for s in sizes)
    assert rows(mixing.mix(docs, partitions=3)) == rows(mixing.mix(docs, partitions=7))
    # Within a source, one more copy goes to the smallest keys.
    keys = docs.select("doc_id", "source", mixing.exponential_key(17, [F.col("doc_id"), F.col("text")], mixing.cleanliness(F.col("text"))).alias("k"))
    key = {r.doc_id: r.k for r in keys.where("source = 'zz'").collect()}
    times = {r.doc_id: r.times for r in got if r.source == "zz"}
    ordered = [times[i] for i in sorted(key, key=key.get)]
    assert ordered == sorted(ordered, reverse=True)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_line_rules_remove_lines_then_documents(spark):
    good = "This is a plain sentence with some words in it, about nothing much at all.\n" * 1
    body = "\n".join(f"Line{i} tells{i} of{i} matter{i} and{i} of{i} others{i}, as{i} ever{i}." for i in range(12))
    docs = [doc(1, body + "\nHome | News | Sport | Contact"), doc(2, good), doc(3, "a | b | c\n" * 40 + body), doc(4, "same words here " * 40),
            doc(5, body + "\n" + body.splitlines()[0]), doc(6, " ".join(f"w{i}###" for i in range(80)))]
    got = {r.doc_id: r for r in line_rules.clean_lines(spark.createDataFrame(docs, DOCS), carry=["doc_id", "_text"]).collect()}
    assert got[1].kept and got[1].clean_text == body and got[1].lost_chars > 0
    assert got[2].base_failed and not got[2].kept
    assert got[4].base_failed and got[4].n_repeat_words == 120
    assert got[5].n_dup_lines == 1 and got[5].kept
    assert not got[6].kept and not got[6].base_failed and got[6].n_symbols == 240
    rules = line_rules.LineRules()
    fails = lambda line: line_rules.line_fails(line.encode(), line.encode().split(), rules)
    assert all(map(fails, ["-----", "= = = = =", "wow!! so!! loud!!", "what?? why?? ok", "| --- | --- |", "~~~ *** ~~~", "a - b - c"]))
    clean = ["- buy milk", "* two words", "• one", "});", "He said: \"no...\" (twice).", "wait... what?", "x = f(a, b) + g(c)", "Ça va? Oui!", "-", "5%"]
    assert not any(map(fails, clean))
    many = line_rules.clean_lines(odd(spark)).collect()
    assert len(many) == 10 and {r.kept for r in many if r.doc_id in (1, 2, 3)} == {False}
    assert line_rules.clean_lines(odd(spark).limit(0)).count() == 0


def test_line_rules_equal_sql_on_marks(spark, tmp_path):
    import duckdb

    pieces = ["-----", "= = = = =", "wow!! so!! loud!!", "- buy milk", "* two words", "});", "a [[ b ]] c^^", "x\\\\ y'' z\"\"", "•  été !!", "a - b - c", "», «"]
    words = " ".join(f"word{i}" for i in range(60))
    docs = [doc(i, words + "\n" + "\n".join(pieces[: i + 1] * (1 + 7 * (i % 2)))) for i in range(len(pieces))]
    docs += [doc(100 + i, words + "\n" + (x + "\n") * 60) for i, x in enumerate(pieces)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op10_line_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.SQL["op10_line_rules"]).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want)
    assert 0 < sum(r[columns.index("kept")] for r in want) < len(want)


def test_rows_are_dealt_evenly_whatever_their_partitions(spark):
    from urlrisk.llm.texts import dealt

    rows = spark.range(64 * 400, numPartitions=64).select(dealt(16).alias("g"))
    sizes = [r["count"] for r in rows.groupBy("g").count().collect()]
    assert len(sizes) == 16 and min(sizes) > 1400 and max(sizes) < 1800


def test_samples_stay_bounded_when_an_id_repeats(spark):
    made = scratch.Scratch(spark, "bound-test")
    rows = made.put(spark.range(20_000).selectExpr("7L AS doc_id", "id AS x"), "rows")
    some = toxicity.bounded_rows(rows, 1000, 5, made)
    assert 800 < some.count() < 1200
    assert sorted(r.x for r in some.collect()) == sorted(r.x for r in toxicity.bounded_rows(rows, 1000, 5, made).collect())
    assert toxicity.bounded_rows(rows, 10_000, 5, made) is rows


def test_language_vectors_do_not_depend_on_the_texts_beside_them(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 9000))), "", "abc abd " * 50, "été à la plage", None]
    encoder = language.Encoder(language.Space())
    together = encoder.encode(texts)
    alone = np.concatenate([encoder.encode([t]) for t in texts])
    assert np.allclose(together, alone, rtol=1e-5, atol=1e-2) and not together[[1, 4]].any() and together[0].any()


def test_folds(spark):
    from urlrisk.llm.texts import fold

    got = spark.createDataFrame([(12,), (None,)], "doc_id long").select(fold(F.col("doc_id"), 5).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(b"12") % 5, None]


def test_mixing_in_place_repeats_rows_as_the_plan_does(spark, tmp_path):
    texts = ["w", "w", "a b c", "", None, "# $ x", "long " * 9]
    data = [(i % 40 if i % 9 else None, texts[i % 7], ["big", "small", None, "zz"][i % 4 if i % 5 else 0], i) for i in range(900)]
    data += [(3, "same text", "zz", i) for i in range(200)] + [(4, "", "empty", 0)]  # one large group of copies
    spark.createDataFrame(data, "doc_id long, text string, source string, n long").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = mixing.times(docs, partitions=5)
    assert got.columns == [*docs.columns, "times"] and sorted(r.n for r in got.collect()) == sorted(r[3] for r in data)
    count = lambda df: collections.Counter(map(tuple, df.select("doc_id", "source", mixing.word_count(F.col("text")), "times").collect()))
    planned = mixing.mix(docs, partitions=5, carry=("text",))
    assert count(got) == count(planned)
    assert mixing.times(docs.limit(0)).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # a row per source fits, a row per document does not
    try:
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_doubtful_rows_hold_all_ids_and_few_others(spark):
    rows_ = spark.range(20_000).selectExpr("id - 50 as doc_id", "'t' as text").union(spark.sql("select cast(null as long), 'n'"))
    ids = rows_.where("doc_id % 10 = 0").select("doc_id")
    got = texts.doubtful(rows_, ids, "doc_id", scratch.Scratch(spark, "test"))
    assert got.columns == ["doc_id", "text", "_doubtful"] and got.count() == 20_001
    assert got.where("doc_id % 10 = 0 and not _doubtful").count() == 0
    assert got.where("doc_id % 10 <> 0 and _doubtful").count() < 50
    assert texts.doubtful(rows_, ids.limit(0), "doc_id", scratch.Scratch(spark, "test")).where("_doubtful").count() == 0


def test_texts_that_are_looked_up_together_get_their_own_ids(spark, monkeypatch):
    import pyarrow as pa

    calls = []
    load = packing._Words._load
    monkeypatch.setattr(packing._Words, "_load", lambda self, words: (calls.append(len(words)), load(self, words))[1])
    monkeypatch.setattr(packing, "_loaded", {})
    given = ["Ab c, d.", "", None, " \n", "ab é, Ü! x&&&", "<|endoftext|> A", "c, " * 3000, "q" * 50] * 40
    ids = list(range(len(given)))
    batch = pa.record_batch([pa.array(ids), pa.array(given, pa.string())], names=["doc_id", "text"])
    got = collections.defaultdict(bytes)
    for part in packing._tokenize(iter([batch]), 64, None, "word_bpe_49k.json"):
        for r in part.to_pylist():
            assert r["start"] == len(got[r["doc_id"]]) // 4 and r["length"] == len(r["ids"]) // 4
            got[r["doc_id"]] += r["ids"]
    tokenizer = next(iter(packing._loaded.values())).tokenizer
    for i, text in zip(ids, given, strict=True):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert list(memoryview(got[i]).cast("I")) == want
    assert len(calls) < 20  # not once per text
