import dataclasses
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plain_features import url_features
from urlrisk.functions import catalog
from urlrisk.functions.matching import contains_any, prefix_pattern, without_redundant
from urlrisk.functions.urlparts import add_url_parts, query_map
from urlrisk.functions.wordlists import (
    FREE_HOSTS, GREEK, LOOKALIKES, URL_SHORTENERS, Dictionaries, homograph_class,
)
from urlrisk.operators.features import add_features

EDGE = [
    "http://a.b.c.example.com:8080/p/x.exe;v=1?q=1&r=%20z&bad=%zz&blank=&noeq#frag",
    "ladiesfirst-privileges[.]com/656465/d5678h9.exe",
    "example.com/a//b?u=http://x.y/",
    "foo/bar?x=http://z",
    "HTTP://User:pw@Ex.com/",
    "http://xn--80ak6aa92e.com/é²",
    "http://bücher.example/😀",
    "http:///x",
    "https://google.com",
    "",
    "  \t http://x.com/a\tb\nc",
    "http://[::1]:80/x", "http://[::ffff:1.2.3.4]/", "http://[1:2:3:4:5:6:7::]/", "http://[v1.a]/",
    "http://[1::2:3:4:5:6:7:8]/", "http://[::1%eth0]/", "http://[1.2.3.4]/", "http://]a[/", "http://[/",
    "http://u@[fe80::1]x/", "http://a℀b.com/", "http://a／b.com/", "http://ⅷ.com/①②³½",
    "http://x/a;b/c;d;e?x=1;y=2", "ws://h/p;q", "mailto:a@b?x=://", "http:foo?u=a://b",
    "http:/abcdefghijabcdefgh?x=a://", "http://h?#", "http://h/p?#f", "http://h/p;",
    "http://1.2.3.4/", "http://1.2.3.4:80/", "http://١.٢.٣.٤/", "a.b.c.d.e.f.g.h/x.js",
    "http://h/javascript:alert(1)", "HTTP://H/SCRIPT", "http://Ωmega.com/", "http://xΣ.com/", "http://Ωx/",
    "http://h/?q=view&q=2&blank=&noeq&s=a+b%20c", "http://h/?a=1&bad=%zz", "http://h/?a=%E2%82%AC&a=x=y",
    "http://h/?%61=1&a=2", "http://h/?k=%ff", "http://h/?=v&a=1", "http://h/?a=100%&b=2",
    "http://h/?a=%20%zz%%41+&a=%C3a&b=%e2%82", "http://h/?b=1&a=22&b=333&c=4&a=55555", "http://h/?a=\r\n1",
    "abcdefgh", "abcdefghabcdefgh", "http://aaaaaaaabbbbbbbb.com/", "xk7qz9wv3mtr1.tk/login",
    "http://user:pw@Example.com:4444/a/b;v=1?x=1#frag", "t.co", "http://microsoft.com/",
    "http://h/%41%zz/" + "A" * 25, "x" * 101, "http://İstanbul.com/", "http://K.com/", "a\x00b://c",
    "https://example.com/test",
]


def same(got, want):
    return got == want or math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9)


def compare(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    rows = add_features(df, apply_weights=False).collect()
    assert len(rows) == len(urls)
    for row in rows:
        try:
            want = url_features(row["url"])
        except ValueError:
            want = None
        assert row["is_valid_url"] == (want is not None), row["url"]
        for name in catalog.FEATURES:
            expected = want[name] if want else 0.0
            assert same(row[name], expected), (row["url"], name, row[name], expected)


def test_edge_urls_match_plain_python(spark):
    compare(spark, EDGE)


def test_corpus_matches_plain_python(spark, small):
    from urlrisk.plans.corpus import url_corpus

    compare(spark, [r["url"] for r in url_corpus(spark, small).select("url").collect()])


def test_random_urls_match_plain_python(spark):
    rng = random.Random(7)
    alphabet = "abcXYZ019-._~:/?#[]@!$&'()*+,;=%é²½①😀αѕ \t" + "//::??&&==%%"
    heads = ["http://", "https://", "", "ftp://", "//", "http:", "h@t://"]
    urls = [
        rng.choice(heads) + "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        for _ in range(4000)
    ]
    compare(spark, urls)


def test_invariants_on_arbitrary_text(spark):
    samples = []

    @settings(max_examples=200, database=None, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
    def gather(text):
        samples.append(text)

    gather()
    df = spark.createDataFrame([(t,) for t in samples], "url string")
    for row in add_features(df, apply_weights=False).collect():
        for group in catalog.GROUPS.values():
            for name, kind in group:
                if kind == "binary":
                    assert row[name] in (0.0, 1.0)
                elif kind == "ratio":
                    assert 0.0 <= row[name] <= 1.0
        if row["is_valid_url"]:
            distinct = len(set(row["url"])) or 1
            assert -1e-9 <= row["url_entropy"] <= math.log2(distinct) + 1e-9
            assert row["longest_digit_sequence"] <= row["url_length"]


def test_url_parts(spark):
    from urllib.parse import parse_qs, urlparse

    df = spark.createDataFrame([(u,) for u in EDGE], "url string")
    rows = add_url_parts(df).withColumn("map", query_map(F.col("query"))).collect()
    for r in rows:
        u = r["url"]
        try:
            p = urlparse(u if "://" in u else "http://" + u)
        except ValueError:
            assert not r["is_valid_url"]
            continue
        assert r["is_valid_url"]
        got = tuple(r[c] for c in ("scheme", "netloc", "path", "params", "query", "fragment"))
        assert got == tuple(p), u
        assert {k: list(v) for k, v in r["map"].items()} == parse_qs(p.query), u


def test_null_url_is_invalid_and_zero(spark):
    df = spark.createDataFrame([(None,)], "url string")
    row = add_features(df).first()
    assert row["is_valid_url"] is False
    assert all(row[n] == 0.0 for n in catalog.FEATURES)
    row = add_features(df, zero_invalid=False).first()
    assert all(row[n] is None for n in catalog.FEATURES)


def test_catalog_shape():
    sizes = {g: len(m) for g, m in catalog.GROUPS.items()}
    assert sizes == {"url_level": 16, "url_level_thresholds": 5, "domain_level": 25,
                     "path_level": 11, "query_level": 13, "pattern_features": 3}
    assert len(catalog.FEATURES) == len(set(catalog.FEATURES)) == 73
    weights = catalog.default_weights()
    assert len(weights) == 21 and sum(w == 2.0 for w in weights.values()) == 19


def test_group_selection_weights_and_errors(spark):
    df = spark.createDataFrame([("http://1.2.3.4/a.exe",)], "url string")
    only = add_features(df, groups=["pattern_features"])
    assert only.columns == ["url", "is_valid_url", "mixed_token_flag", "hex_encoding_flag",
                            "obfuscation_pattern_flag"]
    assert "url_length" not in add_features(df, disabled=["url_level"]).columns
    row = add_features(df).first()
    assert row["http_token"] == 2.0 and row["ip_address_flag"] == 2.0 and row["low_entropy"] == 0.0
    assert add_features(df, weights={"http_token": 7.0}).first()["http_token"] == 7.0
    soft = add_features(df, soft_class="malicious").first()
    assert soft["http_token"] == pytest.approx(2.4)
    with pytest.raises(ValueError):
        add_features(df, groups=["no_such_group"])
    with pytest.raises(ValueError):
        catalog.check_declared(["url_length", "made_up"])


def test_optional_groups(spark):
    df = spark.createDataFrame([("a_b.example.com/x-1/yy?k=1&key=22#z",)], "url string")
    row = add_features(df, groups=["structural_ratios", "suspicious_keywords", "extended"],
                       apply_weights=False).first()
    full = len("http://a_b.example.com/x-1/yy?k=1&key=22#z")
    want = {
        "domain_url_ratio": 15 / full, "path_url_ratio": 7 / full, "query_url_ratio": 10 / full,
        "suspicious_keywords_flag": 0, "underscore_count": 1, "question_mark_count": 1,
        "equal_count": 2, "ampersand_count": 1, "hashtag_count": 1, "digit_count": 4,
        "letter_count": 20, "tld_length": 3, "digit_count_domain": 0, "dot_count_domain": 2,
        "special_char_domain": 3, "max_domain_token_length": 7, "min_domain_token_length": 3,
        "slash_count_path": 2, "digit_count_path": 1, "hyphen_count_path": 1,
        "max_path_token_length": 3, "min_path_token_length": 2, "digit_count_query": 3,
        "min_parameter_length": 2, "repeated_character_flag": 0,
    }
    for name, value in want.items():
        assert same(row[name], value), (name, row[name], value)


def test_word_matching(spark):
    words = [f"w{i:03d}x" for i in range(150)] + ["w001xyz", "a.b", "(c)"]
    assert "w001xyz" not in without_redundant(words)
    texts = ["..w149x..", "w15", "a.b", "aXb", "((c))", "", "w001"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for chosen in (words, words[:20] + ["a.b"]):
        got = [r[0] for r in df.select(contains_any(F.col("t"), chosen)).collect()]
        assert got == [any(w in t for w in chosen) for t in texts]
    assert prefix_pattern(["ab", "ac"]) == "a(?:b|c)"


def test_homograph_class_covers_every_case_variant():
    base = LOOKALIKES + GREEK
    want = {chr(i) for i in range(0x110000) if chr(i).lower() in base and not 0xD800 <= i <= 0xDFFF}
    assert set(homograph_class()[1:-1]) == want


def test_dictionary_tables_equal_inline_lists(spark, small):
    from urlrisk.plans.corpus import url_corpus

    corpus = url_corpus(spark, small)
    as_table = lambda words: spark.createDataFrame([(w.upper(),) for w in words], "value string")
    d = Dictionaries(free_hosting=as_table(FREE_HOSTS), sorted_url=as_table(URL_SHORTENERS))
    names = ["row_id", "free_hosting_domain_flag", "shortening_service_flag"]
    joined = add_features(corpus, dictionaries=d).select(names)
    inline = add_features(corpus).select(names)
    assert joined.exceptAll(inline).isEmpty() and inline.exceptAll(joined).isEmpty()


def test_all_six_dictionaries_as_tables_equal_inline_lists(spark, small):
    """Lists above any inline size, with words of the default lists among them."""
    from urlrisk.plans.corpus import url_corpus

    corpus = url_corpus(spark, small).select("row_id", "url").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "http://h.tk:8081/?Download=1&x=2"), (-4, "http://a.tk:81"), (-5, "http://h/?" + "q" * 5_000)],
                              "row_id long, url string")
    )
    filler = spark.range(150_000).select(F.concat(F.lit("zq"), F.hex("id"), F.lit("jx")).alias("value"))
    defaults = Dictionaries()
    as_table = lambda words: filler.unionByName(spark.createDataFrame([(w.upper(),) for w in (*words, words[0], "")], "value string"))
    d = Dictionaries(**{f.name: as_table(getattr(defaults, f.name)) for f in dataclasses.fields(Dictionaries)})
    names = ["row_id", "url", "free_hosting_domain_flag", "shortening_service_flag", "brand_keyword_flag", "tld_suspicious_flag",
             "non_standard_port_flag", "auto_download_param_flag", "url_length"]
    joined, inline = add_features(corpus, dictionaries=d).select(names), add_features(corpus).select(names)
    assert joined.columns == inline.columns
    assert joined.exceptAll(inline).isEmpty() and inline.exceptAll(joined).isEmpty()
    assert inline.agg(*[F.sum(n) for n in names[2:8]]).first()[4] > 0
