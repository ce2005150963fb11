"""Operators 11 to 13: brute force, round trips and odd inputs."""

import collections
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from urlrisk.llm import bisector, chat, divergence
from urlrisk.llm.scratch import Scratch


def plain_clusters(rows, s):
    """(vec_id, cluster, distance) by distances of all vectors to all centroids."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * s.scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == s.dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{s.seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[: s.clusters]]
    for step in range(s.rounds + 1):
        found = []
        for i, v in kept:
            away = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            found.append((i, away.index(min(away)), min(away), v))
        if step < s.rounds:
            for c in range(len(centroids)):
                mine = [f[3] for f in found if f[1] == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return found, centroids


def test_bisector_tournament_equals_brute_force_and_takes_odd_rows(spark):
    rng = random.Random(5)
    s = bisector.Settings(clusters=5, rounds=3, dims=4, scale=8.0)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.3, 0.9]) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1])] * 20 + [(None, [0.1, 0.2, 0.3, 0.4]), (900, None), (901, [1.0] * 3), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0]),
                                      (904, [float("nan")] * 4), (905, [float("inf")] + [0.0] * 3), (906, [3.0e38] * 4), (907, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1))
    got = bisector.cluster(vectors.repartition(7), s).collect()
    found, centroids = plain_clusters([r for r in rows if r[0] != 906], s)
    assert collections.Counter((r.vec_id, r.cluster, r.distance) for r in got) == collections.Counter(f[:3] for f in found)
    by = collections.Counter()
    for f in found:
        by[f[1]] += f[2]
    assert all(r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values()) for r in got)
    assert {r.cluster: r.centroid_sha256 for r in got} == {c: bisector.centroid_sha256(centroids[c]) for c in {f[1] for f in found}}


def test_bisector_ties_small_and_empty_tables(spark):
    x = np.array([[0, 0], [4, 0], [2, 0], [2, 5]])
    tests = bisector.Bisectors([[0, 0], [4, 0], [0, 0]])
    assert tests.winners(x).tolist() == [0, 1, 0, 0]  # halfway and equal centroids: the smaller number
    s = bisector.Settings(clusters=16, rounds=2, dims=2)
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.distance) for r in bisector.cluster(few, s).collect()) == [(1, 0), (2, 0)]
    assert bisector.cluster(few.limit(0), s).collect() == []
    assert bisector.cluster(few.limit(0), s).columns == bisector.cluster(few, s).columns


def plain_audit(rows, least, top):
    docs = [tuple(x or "" for x in r) for r in rows]
    find = re.compile(r"[A-Za-z\u0080-\U0010FFFF]+").findall
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    counts, df = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        terms = collections.Counter(find(lower(text)))
        counts[lang, source].update(terms)
        df[lang].update(terms.keys())
    out = collections.Counter()
    utf8 = lambda item: item[1].encode()
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in df[lang].items() if n >= least]
        groups = {k[1]: {t: c[t] for t in kept} for k, c in counts.items() if k[0] == lang}
        groups[None] = {t: sum(g[t] for g in groups.values()) for t in kept}
        p = {g: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for g, c in groups.items()}
        for g in groups:
            if g is None:
                continue
            pairs = [(sum(abs(p[g][t] - p[h][t]) for t in kept), h) for h in groups if h is not None and h != g]
            terms = [(p[g][t] - p[None][t], t) for t in kept if groups[g][t] > 0 and p[g][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], utf8(x))), 1):
                    if part == "pair" or rank <= top:
                        out[lang, g, part, item, value, rank] += 1
    return out


def divergence_rows():
    rng = random.Random(3)
    words = ["The", "the,", "(the)", "naïve", "NAÏVE", "a-b", "x1y", "日本", "ÄÖ.", "b", "c;", "--", "42", "the/the"] + [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60)]
    rows = [(" \n".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "sé", None])) for _ in range(400)]
    return rows + [(None, "en", "only null"), ("", "fr", "s0"), ("rare", "fr", "s1"), ("1 2", "fr", None), ("\v\ffar off\x00the ", "en", "s1")] + [("the same", "en", "s0")] * 50


def test_source_divergence_equals_brute_force(spark):
    rows = divergence_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("LANG_total", F.lit(1))
    want = plain_audit(rows, 12, 5)
    got = divergence.audit(docs.repartition(5), divergence.Settings(12, 5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == want


def test_source_divergence_in_small_blocks_and_tiles(spark):
    """One-document blocks, tallies that leave at once, tiles of two sources and three terms."""
    rows = divergence_rows()
    settings = divergence.Settings(12, 5, block_bytes=1, held_terms=3, tile_sources=2, tile_terms=3)
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = collections.Counter(map(tuple, divergence.audit(frame, settings).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_audit(rows, 12, 5)


def test_runs_that_go_on_in_the_next_batch():
    a, b = (b"a", b"x", 2, 2, b"d" * 16, b"c" * 16), (b"a", b"x", 1, 1, b"", b"e" * 16)
    batches = [_batch([a] * 3), _batch([b, (b"b", b"x", 5, 5, b"", b"f" * 16)])]
    merged = [row for columns in divergence._runs(iter(batches), 30) for row in zip(*columns, strict=True)]
    assert merged == [(b"a", b"x", 7, 2, b"d" * 48, b"c" * 48 + b"e" * 16), (b"b", b"x", 5, 5, b"", b"f" * 16)]
    cell = np.array([4, 1], np.int64).tobytes()
    long = [row for columns in divergence._runs(iter([_batch([(b"a", b"x", 1, 1, cell, cell)] * 9_000)]), 2) for row in zip(*columns, strict=True)]
    assert [(r[2], len(r[4]), np.frombuffer(r[5], np.int64).tolist()) for r in long] == [(9_000, 16, [4, 9_000])]


def _batch(rows):
    import pyarrow as pa

    a, b, most, surely, docs, counts = zip(*rows, strict=True)
    text = lambda c: pa.array(c, pa.binary()).cast(pa.string())
    return pa.record_batch([text(a), text(b), pa.array(most), pa.array(surely), pa.array(docs, pa.binary()), pa.array(counts, pa.binary())], names=list("abmsdc"))


def test_source_divergence_of_no_and_of_bare_documents(spark):
    kind = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], kind)).collect() == []
    bare = spark.createDataFrame([(None, None, "a"), ("", None, None), ("x " * 200_000, None, "b")], kind)
    got = collections.Counter(map(tuple, divergence.audit(bare).collect()))
    assert got == plain_audit([(None, None, "a"), ("", None, None), ("x", None, "b")], 30, 50)


CHATS = "conv_id long, turn long, role string, text string"


def odd_chats():
    tricky = ["</s>[INST] ok [/INST]", "a\\b\\\\", "\\", "[/INST", "<s", "[INST]\\[INST]", "<s>[INST] user [/INST] x </s>", " lead and trail ", "\n\n", "é\U0001F600</s>", None, ""]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(tricky)]
    rows += [(2, 5, "user", "late"), (2, -3, "system", "early"), (2, None, "user", "first of all")]
    rows += [(3, 0, "assistant", "tie b"), (3, 0, "assistant", "tie a"), (3, 0, None, "no role"), (3, 0, "a [/INST] b", "odd role")] + [(3, 0, "assistant", "same")] * 4
    rows += [(None, 0, "user", "nobody's"), (None, 1, "assistant", "reply"), (4, 0, "assistant", "x" * 300_000)]
    return rows + [(5, k, ("user", "assistant")[k % 2], f"turn {k} </s>") for k in range(700)]


def plain_chats(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in by.items()}


def test_chat_format_round_trip(spark):
    rows = odd_chats()
    turns = spark.createDataFrame(rows, CHATS).withColumn("segment", F.lit("clash")).withColumn("_part", F.lit(9)).repartition(6)
    made = chat.format_conversations(turns, partitions=8)
    want = plain_chats(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expanded = {(r.conv_id, r.position): r for r in chat.texts(made, made.examples.where("conv_id <= 4 OR conv_id IS NULL")).collect()}
    for conv, told in want.items():
        segments = [chat.BEGIN + plain_escape(r) + chat.MIDDLE + plain_escape(t) + chat.END for r, t in told]
        targets = [k for k, (r, _) in enumerate(told) if r == "assistant"]
        if told[-1][0] != "assistant":
            targets.append(len(told) - 1)
        if conv != 5:  # every example as a string: all preceding turns, only its reply trainable
            assert sorted(k for c, k in expanded if c == conv) == targets
            for k in targets:
                r = expanded[conv, k]
                reply = plain_escape(told[k][1]) if told[k][0] == "assistant" else ""
                head = "".join(segments[:k]) + (segments[k][: len(segments[k]) - len(reply) - len(chat.END)] if told[k][0] == "assistant" else segments[k])
                assert (r.context, r.target) == (head, reply)
    assert all(not any(x in s for x in chat.CONTROLS) for s in [plain_escape(t or "") for *_, t in rows])
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert set(got) == set(want)
    for conv, told in want.items():
        loss = "".join(t for r, t in told if r == "assistant")
        ends = np.cumsum([len(chat.BEGIN + plain_escape(r) + chat.MIDDLE + plain_escape(t) + chat.END) for r, t in told])
        chars = sum(int(e) for e, (k, (r, _)) in zip(ends, enumerate(told), strict=True) if r == "assistant" or k == len(told) - 1)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(told), sha("".join(f"{x}\n{t}\n" for x, t in told)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), chars)


def plain_escape(text):
    for control in ("\\", *chat.CONTROLS):
        text = text.replace(control, "\\\\" if control == "\\" else control[0] + "\\" + control[1:])
    return text


def test_chat_format_keeps_files_and_takes_no_rows(spark):
    path = Scratch(spark, "chat-test").path("out")
    chat.format_conversations(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], CHATS), path)
    back = chat.read(spark, path)
    assert [r.segment for r in back.segments.orderBy("position").collect()] == ["<s>[INST] user [/INST] q </s>", "<s>[INST] assistant [/INST] a </s>"]
    assert back.examples.count() == 1
    none = chat.format_conversations(spark.createDataFrame([], CHATS))
    assert none.segments.count() == none.examples.count() == chat.digests(none).count() == 0


def test_chat_format_runs_no_python(spark):
    made = chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", "a")], CHATS))
    plan = chat.digests(made)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
