import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from urlrisk.functions.wordlists import BRAND_KEYWORDS
from urlrisk.sources import registry as rg
from urlrisk.sources.archives import read_archives, unpack_archives
from urlrisk.sources.dictionaries import load_dictionaries, migrate_store
from urlrisk.sources.readers import (
    merged_dataset, read_csv, read_labelled, read_test_urls, read_url_lines, split_urls, unique_urls,
)
from urlrisk.sources.scan_feed import read_scan_feed
from urlrisk.sources.sinks import read_report, write_features, write_report


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_separator_and_bad_lines(spark, tmp_path):
    comma = put(tmp_path, "a.csv", 'url,label\nx.com,0\n"y,z.com",spam\nshort.com\nlong.com,1,2\n')
    rows = [(r["url"], r["label"]) for r in read_csv(spark, comma).orderBy("src_row").collect()]
    assert rows == [("x.com", "0"), ("y,z.com", "spam"), ("short.com", None)]
    semi = put(tmp_path, "b.csv", "input;type\nq.com;phishing\nr.com;safe\nbad;1;2\n")
    assert [(r["input"], r["type"]) for r in read_csv(spark, semi).orderBy("src_row").collect()] == [
        ("q.com", "phishing"), ("r.com", "safe")]


def test_directory_merge_and_reuse(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    put(raw, "a.csv", "url,label\nx.com,0\ny.com,1\nz.com,benign\n")
    put(raw, "b.csv", "target;class\nx.com;benign\ny.com;safe\nw.com;\n")
    put(raw, "notes.txt", "ignored")
    both = read_labelled(spark, str(raw), ["raw"])
    assert both.count() == 6
    assert read_labelled(spark, str(raw), ["a.csv", "missing.csv"]).count() == 3
    with pytest.raises(ValueError):
        read_labelled(spark, str(raw), ["missing.csv"])
    out = str(tmp_path / "merged")
    want = {("x.com", "benign"), ("z.com", "benign"), ("w.com", "malicious")}
    assert {tuple(r) for r in merged_dataset(spark, str(raw), ["raw"], out).collect()} == want
    put(raw, "c.csv", "url,label\nnew.com,0\n")
    assert {tuple(r) for r in merged_dataset(spark, str(raw), ["raw"], out, reuse=True).collect()} == want
    assert merged_dataset(spark, str(raw), ["raw"], out).count() == 4


def test_url_sources(spark, tmp_path):
    lines = put(tmp_path, "urls.txt", " a.com \n\n\tb.com\na.com\n")
    assert [r["url"] for r in read_url_lines(spark, lines).collect()] == ["a.com", "b.com", "a.com"]
    df = spark.createDataFrame([(" a.com, ,b.com,",)], "s string")
    assert df.select(split_urls(F.col("s"))).first()[0] == ["a.com", "b.com"]
    test = put(tmp_path, "test.csv", "id,URL\n1,b.com\n2,\n3,a.com\n4,b.com\n")
    urls = read_test_urls(spark, test)
    assert [r["url"] for r in unique_urls(urls).orderBy("src_row").collect()] == ["b.com", "a.com"]
    other = put(tmp_path, "other.csv", "address,n\nz.com,1\n")
    assert read_test_urls(spark, other).first()["url"] == "z.com"


def test_archives(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    one, two = "url,label\na.com,0\nb.com,phishing\n", "text;output\nc.com;1\n"
    with zipfile.ZipFile(store / "My  Set-1.zip", "w") as z:
        z.writestr("in/one.csv", one)
        z.writestr("two.csv", two)
        z.writestr("readme.txt", "no")
    for name, mode in (("pack.tar.gz", "w:gz"), ("pack2.tgz", "w:gz"), ("plain.tar", "w")):
        with tarfile.open(store / name, mode) as t:
            info = tarfile.TarInfo("d/one.csv")
            info.size = len(one)
            t.addfile(info, io.BytesIO(one.encode()))
    with gzip.open(store / "single.csv.gz", "wb") as g:
        g.write(b'input\n"x,1.com"\n"multi\nline.com"\n')
    rows = read_archives(spark, str(store)).collect()
    got = {(r["dataset"], r["clean_name"], r["url"], r["label"]) for r in rows}
    assert got == {
        ("My  Set-1", "my_set_1", "a.com", "benign"), ("My  Set-1", "my_set_1", "b.com", "malicious"),
        ("My  Set-1", "my_set_1", "c.com", "malicious"),
        ("single.csv", "single_csv", "x,1.com", "malicious"),
        ("single.csv", "single_csv", "multi\nline.com", "malicious"),
        *{(d, d, u, l) for d in ("pack", "pack2", "plain") for u, l in (("a.com", "benign"), ("b.com", "malicious"))},
    }
    report = {r["clean_name"]: (r["members"], r["n_rows"]) for r in unpack_archives(
        spark, str(store), str(tmp_path / "unpacked")).collect()}
    assert report["my_set_1"] == (2, 3) and report["single_csv"] == (1, 2) and len(report) == 5


def test_scan_feed(spark, tmp_path):
    def scan(task, page, verdict, time):
        return {"task": {"url": task, "time": time}, "page": {"url": page},
                **({"verdicts": {"malicious": verdict}} if verdict is not None else {})}

    doc = {"results": [
        scan("https://a/", "https://p/", True, "2026-02-25T22:29:10.879000+00:00"),
        scan(None, "https://b/", False, "2026-01-25T22:29:10"), scan("https://c/", None, None, "2026-02-01T00:00:00"),
        scan(None, None, True, "2026-02-01T00:00:00"), scan("", None, True, "2026-02-01T00:00:00")]}
    path = put(tmp_path, "feed.json", json.dumps(doc, indent=2))
    got = {tuple(r) for r in read_scan_feed(spark, path).collect()}
    assert got == {("https://a/", "malicious", "2026-02"), ("https://b/", "benign", "2026-01"),
                   ("https://c/", "malicious", "2026-02")}
    assert read_scan_feed(spark, path, since="2026-02", until="2026-02").count() == 2


def test_dictionaries(spark, tmp_path):
    store, out = tmp_path / "dict_store", tmp_path / "dict"
    store.mkdir()
    put(store, "brand_keyword.csv", "id,name\n1, Apple \n2,Banana\n3,apple\n4,\n5,Banana\n")
    put(store, "sorted_url.csv", "hosting\n# comment\nbit.ly\nt.co\n")
    put(store, "suspicious_tld.csv", "url_domain\tmetadata_tld\n*.icu\ticu\n*.tk\ttk\n")
    put(store, "non_standard_port.csv", "dest_port,metadata_comment\n666,first\n666,second\n80,\n")
    put(store, "free_hosting.csv", "wrong\nx\n")
    report = {r["dictionary"]: (r["status"], r["n"]) for r in migrate_store(spark, str(store), str(out)).collect()}
    assert report == {"brand_keyword": ("migrated", 3), "sorted_url": ("migrated", 2),
                      "suspicious_tld": ("migrated", 2), "non_standard_port": ("migrated", 2),
                      "free_hosting": ("skipped", 0)}
    rows = spark.read.option("header", True).csv(str(out / "brand_keyword.csv")).collect()
    assert {(r["id"], r["value"]) for r in rows} == {("0", "Apple"), ("1", "Banana"), ("2", "apple")}
    ports = spark.read.option("header", True).csv(str(out / "non_standard_port.csv")).orderBy("id").collect()
    assert [(r["id"], r["value"], r["description"]) for r in ports] == [("0", "666", "first"), ("1", "80", None)]
    d = load_dictionaries(spark, str(out))
    assert d.brand_keyword == ("apple", "banana") and d.suspicious_tld == ("icu", "tk")
    assert d.sorted_url == ("bit.ly", "t.co") and len(d.auto_download_params) == 4
    assert load_dictionaries(spark, str(tmp_path / "none")).brand_keyword == BRAND_KEYWORDS
    large = tmp_path / "large"
    large.mkdir()
    put(large, "suspicious_tld.csv", "id,value\n" + "".join(f"{i},*.t{i}\n" for i in range(5_000)))
    assert load_dictionaries(spark, str(large)).suspicious_tld.count() == 5_000


def test_sinks_and_registry(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("u", "benign", 1.0)], "url string, label string, f double")
    assert spark.read.parquet(write_features(df, root, "extracted_features")).count() == 1
    assert spark.read.option("header", True).csv(write_features(df, root, "csv", "csv")).count() == 1
    write_report(spark, {"a": [1, 2]}, root, "report")
    assert read_report(spark, root, "report") == {"a": [1, 2]}
    reg = rg.Registry(spark, f"{root}/registry")
    base = {"service_conf_id": 1, "run_id": "r1", "name": "m", "algorithm": "svm", "accuracy": 0.5,
            "recall": 0.4, "precision": 0.3, "f1": 0.2}
    assert reg.register(base) == 1
    assert reg.register({**base, "run_id": "r2", "accuracy": 0.9}) == 2
    assert reg.by_service(1).first()["run_id"] == "r2" and reg.by_run("r1").first()["accuracy"] == 0.5
    assert rg.aliased_models(reg.models()).first()["version"] == 2
    reg.log_metrics("r1", {"x": 1})
    assert reg.metrics().first()["value"] == "1"
    scored = spark.createDataFrame(
        [("success", 7, "u", "r2", 0.8, "t"), ("success", 7, "v", "other", 0.8, "t"),
         ("failed", 7, "w", "r2", None, None), ("success", None, "z", "r2", 0.8, "t")],
        "status string, user_id int, url string, model_id string, confidence double, suggested_desc string")
    reg.log_predictions(scored)
    log = {r["url"]: (r["accuracy_score"], r["f1_score"])
           for r in spark.read.parquet(f"{root}/registry/prediction").collect()}
    assert log == {"u": (0.9, 0.2), "v": (0.8, 0.0)}


def test_registrations_at_the_same_time_get_different_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    row = {"service_conf_id": 1, "name": "a/b model", "algorithm": "svm"}
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda i: rg.Registry(spark, str(tmp_path)).register({**row, "run_id": f"r{i}"}), range(12)))
    assert sorted(got) == list(range(1, 13))
    models = rg.Registry(spark, str(tmp_path)).models().collect()
    assert {r.run_id: r.version for r in models} == {f"r{i}": v for i, v in enumerate(got)}
    assert rg.Registry(spark, str(tmp_path)).register({**row, "name": "other", "run_id": "x"}) == 1
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: rg.Registry(spark, str(tmp_path)).log_metrics(f"r{i}", {"k": i}), range(8)))
    assert rg.Registry(spark, str(tmp_path)).metrics().count() == 8


def test_stored_uses_the_shared_folder(spark):
    from urlrisk.sources.paths import shared_dir, stored

    df = stored(spark.range(5), "numbers")
    assert df.inputFiles() and all(shared_dir(spark) in f for f in df.inputFiles())
    assert df.count() == 5
