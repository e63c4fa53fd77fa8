import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import decontaminate, language_id, line_templates, mixing, ngram_join, ordinal, quality_rules, queries, token_store, toxicity, url_filter
from llm.graph import components
from llm.words import NOT_ALNUM, SPACE, hash_spans, pieces

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hit string"
LONG = " ".join(f"w{i * i % 997}" for i in range(30_000))
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (None, "No id here", "en", "a", 9, None), (3, "\n\t ", None, "a", 3, None), (4, "same text " * 9, "en", "b", 1, None), (4, "same text " * 9, "en", "b", 1, None), (5, LONG, "en", None, 1, None), (6, "汉字 é <|endoftext|> 12 x", "zh", "b", 1, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_differ():
    text = " ".join({"".join(c) for c in __import__("itertools").product("abcxé", repeat=4)})
    p = next(pieces(pa.array([text]), SPACE))
    assert len(set(p.hashes().tolist())) == len(text.split())
    assert [len(x.starts) for x in pieces(pa.array([None, "", "a-b C"]), NOT_ALNUM)] == [3]


def linked(rows):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (n := len(sets[i] & sets[j])) and 100 * n >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_join_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        base = [f"b{i % 6}w{k}" for k in range(40)]
        for _ in range(rng.integers(0, 4)):
            base[rng.integers(40)] = f"n{rng.integers(1000)}"
        rows.append((int(i), " ".join(base[: rng.integers(3, 41)] if i % 3 == 0 else base)))
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == linked(rows)


def test_large_blocks_are_cut_without_losing_links(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(60)]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), block_ngrams=500)
    assert sorted(map(tuple, got.collect())) == linked(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (300, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[150] == got[200] == 100


def test_join_edge_cases(spark, odd):
    got = sorted(map(tuple, ngram_join.similar_components(odd).collect()), key=str)
    assert len(got) == len(ODD) and (1, 0, 1) in got and (2, 0, 2) in got and (None, 1, None) in got and got.count((4, 2, 4)) == 2
    assert ngram_join.similar_components(odd.limit(0)).count() == 0


def test_decontamination(spark, odd):
    ten = "the quick brown fox jumps over the lazy dog today"
    items = spark.createDataFrame([("i1", ten + " again"), ("i2", "Short One"), (None, "w1 w4 w9"), ("i3", None), ("i4", "")], "item_id string, text string")
    docs = odd.unionByName(spark.createDataFrame([(7, f"Start {ten}, again. short-one end " + "clean " * 40, "en", "a", 1, None), (8, "short and one", "en", "a", 1, None)], SCHEMA))
    r = {x["doc_id"]: x for x in decontaminate.find_copies(docs.drop("_hit"), items).collect() if x["doc_id"]}
    assert [list(s) for s in r[7]["_hit_spans"]] == [[1, 14]] and r[7]["_hit_items"] == ["i1", "i2"] and not r[8]["_hit_spans"]
    two = decontaminate.find_copies(docs.drop("_hit"), items, block_words=3).where("doc_id = 7").first()
    assert two["_hit_items"] == ["i1", "i2"]
    clean = {x["doc_id"]: x["text"] for x in decontaminate.decontaminate(docs.drop("_hit"), items).collect()}
    assert clean[7].startswith("Start ") and "fox" not in clean[7] and clean[8] == "short and one" and clean[5] is not None


@pytest.mark.parametrize("broadcast", [1 << 20, -1])
def test_decontamination_in_passes(spark, odd, broadcast, monkeypatch, tmp_path):
    """Many small blocks, a pass each, give the same as one pass; nearly full filter or not, joined either way; no pass writes the documents."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(decontaminate, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(decontaminate, "written", lambda df, name: (df.write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1])
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").cast("string"), "text").where("item_id % 4 = 0")
    items = items.unionByName(spark.createDataFrame([("i2", "Short One"), (None, "w1 w4 w9"), ("i3", None), ("i4", "")], "item_id string, text string"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").withColumn("_hit_key", F.lit("x"))
    docs = docs.unionByName(docs.limit(40)).unionByName(odd.select("doc_id", "text", F.lit("x").alias("_hit_key")))
    docs = docs.unionByName(spark.createDataFrame([(9_999, "a short-one end w1 w4 w9", "x")], docs.schema))
    words = sum(len((r["text"] or "").split()) for r in items.collect())
    rows = lambda df: sorted(map(str, df.collect()))
    one = rows(decontaminate.find_copies(docs, items, clean=True))
    many = decontaminate.find_copies(docs, items, clean=True, block_words=words // 5, pass_blocks=1, sieve_bits=1 << 16 if broadcast < 0 else 1 << 24)
    assert rows(many) == one and many.columns == ["doc_id", "text", "_hit_words", "_hit_spans", "_hit_items", "_hit_clean"]
    copies = list(tmp_path.glob("copies-*/pass=*"))
    assert len(copies) >= 3 and any("9999" in r and "w1" in r and "[0, 0]" not in r for r in one)
    bytes_of = lambda at: sum(f.stat().st_size for f in at.rglob("*.parquet"))
    docs.write.parquet(f"{tmp_path}/whole")
    if broadcast > 0:
        assert sum(map(bytes_of, [*copies, tmp_path / "copies", tmp_path / "sieved"])) < 0.5 * bytes_of(tmp_path / "whole")


def test_quality(spark, odd, labels):
    r = quality_rules.quality_rules(odd).collect()
    by = {x["doc_id"]: x for x in r}
    assert len(r) == len(ODD) and by[4]["n_words"] == 18 and by[4]["n_repeat_words"] == 18 and by[1]["base_failed"] and not by[2]["kept"]
    model = ordinal.train(odd, labels)
    assert ordinal.score(odd, model, 1).count() == len(ODD)
    assert set(ordinal.reject(odd, labels.limit(0)).columns) == set(odd.columns)
    x = np.array([[i / 10.0] for i in range(60)], np.float32)
    three = ordinal.fit(x, np.repeat([0, 1, 2], 20), steps=400)
    expected = three.expected(three.tails(x))
    assert (np.diff(three.thresholds) > 0).all() and expected[0] < 0.7 < 1.3 < expected[-1]


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/1?x"), (2, None), (3, "no scheme"), (4, "http://example.org/en/12"), (5, "https://x.com/fr/"), (6, "https://x.com#f"), (7, "http://badorg/x")]
    host, path = url_filter.host_and_path(F.col("url"))
    df = spark.createDataFrame(rows, "page_id long, url string").select("page_id", host.alias("host"), path.alias("path"))
    got = {r[0]: tuple(r)[1:] for r in df.withColumn("rule", url_filter.rule_of(F.col("host"), F.col("path"), list(queries.RULES))).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/") and got[2] == ("", "", None) == got[3] and got[4][2] == "example.org/en/1" and got[5][2] == "com/fr/" and got[6] == ("x.com", "", None) and got[7][2] is None
    bad = [(f"h{i % 2}", f"/spam/{i}", 1) for i in range(30)] + [("h0", f"/good/{i}x", 0) for i in range(30)] + [("h0", "/spam/999", None)]
    judged = url_filter.template_verdicts(spark.createDataFrame(bad, "host string, path string, bad int"))
    assert {r["rejected"] for r in judged.where("path like '/spam/%'").collect()} == {True} and {r["rejected"] for r in judged.where("path like '/good/%'").collect()} == {False}


def test_url_labels_reach_unrated_branches(spark):
    rows = [("h", f"/bad/s{i % 3}/x", 1) for i in range(12)] + [("h", f"/good/s{i % 3}/x", 0) for i in range(12)] + [("h", "/bad/new/deep/er", None), ("h", "/good/new/deep/er", None)]
    rows += [("allbad", "/a/b", 1)] * 9 + [("allbad", "/c/d", None), ("one", "/q/b/c/d/e/f", 1), ("none", "/else/s1/x", None), ("new", "/bad/s1/x", None)]
    judged = {(r["host"], r["path"]): r for r in url_filter.template_verdicts(spark.createDataFrame(rows, "host string, path string, bad int")).collect()}
    assert judged["h", "/bad/new/deep/er"]["rejected"] and judged["allbad", "/c/d"]["rejected"] and not judged["h", "/good/new/deep/er"]["rejected"]
    # one bad page is not more of them for being deep; a host without labels has the share over all
    assert judged["one", "/q/b/c/d/e/f"]["bad_share"] == pytest.approx((1 + 4 * 23 / 44) / 5) and judged["none", "/else/s1/x"]["bad_share"] == pytest.approx(23 / 44)
    # nor if its section is bad on another host: that counts as two pages at most for each level that adds any
    assert judged["new", "/bad/s1/x"]["bad_share"] > 0.6
    r, b = url_filter.merged(np.array([10, 10, 9, 12]), np.array([0, 10, 9, 1]), 0.4, 4.0, 2.0)
    assert r.tolist() == [22, 19, 19, 22] and b.tolist() == [1, 19, 19, 1]


def test_url_sections_stay_apart_at_any_size(spark):
    rare = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    for times in (1, 10):  # 10 and 100 rare sections beside a bad one
        rows = [("h", f"/spam/{i}", 1) for i in range(30 * times)] + [("h", f"/{s}/x", 0) for s in rare[: 10 * times]] + [("h", "/spam/new", None), ("h", "/zz/new", None)]
        judged = {r["path"]: r for r in url_filter.template_verdicts(spark.createDataFrame(rows, "host string, path string, bad int")).collect()}
        assert judged["/spam/new"]["template"].startswith("/spam/") and judged["/spam/new"]["rejected"] and not judged[f"/{rare[0]}/x"]["rejected"]
    assert judged["/zz/new"]["template"].startswith("/*/") and judged["/zz/new"]["bad_share"] < 0.1


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    for n in (0, 1, 70_000):
        ids = np.random.default_rng(n).integers(0, 1 << 17, n).astype(np.uint32)
        assert (token_store.unpack(token_store.pack(ids)) == ids).all() and (token_store.unpack(token_store.pack(ids, "bit")) == ids).all()
    token_store.write_tokens(odd, str(tmp_path / "t"), queries.tokenizer_path(), chunk_ids=5)
    got = sorted(map(tuple, token_store.read_tokens(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    tokenizer, at = Tokenizer.from_file(queries.tokenizer_path()), 0
    for row, (doc, text, *_) in zip(got, sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert row == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_store.write_tokens(odd.limit(0), str(tmp_path / "e"), queries.tokenizer_path())
    assert token_store.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_mixing(spark, odd):
    assert mixing.targets({"a": 100, "b": 10, None: 50}, [5, 2, 1], 1.5, 2) == pytest.approx({"a": 220 * 5 / 6, "b": 20, None: 220 / 6})
    flow = mixing.min_cost_flow({"ab": 10, "a": 10}, {("ab", "a"): 20, ("ab", "b"): 20, ("a", "a"): 20}, {"a": 10, "b": 10}, {"ab": 20, "a": 20})
    assert flow.get(("ab", "b")) == 10 and flow.get(("a", "a")) == 10  # nothing is repeated
    docs = odd.withColumns({"size": mixing.word_count(F.col("text")), "sources": F.array("source")})
    got, wanted = mixing.mix(docs, size="size", sources="sources", doc_id="doc_id", weights=[5, 2, 1], share=1.5)
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r["_copies"] in (0, 1, 2) for r in rows) and None in wanted
    assert mixing.mix(docs.limit(0), size="size", sources="sources", doc_id="doc_id", weights=[1], share=1)[0].count() == 0


def test_language(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 3 > 0"))
    held = language_id.identify(docs.where("doc_id % 3 = 0").select("lang", "text"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    got = {r["doc_id"]: r for r in language_id.identify(odd.select("doc_id", "text"), model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[6]["lang_pred"] in model.languages
    assert {r["lang_pred"] for r in language_id.identify(odd.select("doc_id", "text"), language_id.fit(odd.limit(0))).collect()} == {"und"}


def test_lines(spark, odd):
    rows = [(1, "Page 1 of 20 at the site\nonly here once in all\nend one two three"), (2, "Page 2 of 31 at the site\r\nother words stand on this line\n\nend one two three"), (3, "Page 1 of 20 at the site\nend one two"), (3, "x"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, line_templates.line_report(docs).collect()), key=str)
    assert (1, 3, 2, 0, []) in got and (2, 3, 2, 2, [0, 3]) in got and (3, 2, 1, 1, [0]) in got and (4, 0, 0, 0, []) in got
    cut = {r["text"] for r in line_templates.drop_recurring(docs).collect()}
    assert "other words stand on this line\n" in cut and rows[0][1] in cut and "x" in cut
    assert line_templates.line_report(odd).count() == len(ODD) and line_templates.line_report(odd.limit(0)).count() == 0


def test_toxicity(spark, odd, labels):
    rng = np.random.default_rng(0)
    y, texts = np.arange(400) % 5 == 0, []
    for bad in y:
        t = rng.integers(5, 400, 60)
        if bad:
            t[rng.integers(60, size=3)] = rng.integers(0, 5, 3)
        texts.append(t)
    sample = toxicity.Sample(rng.integers(0, toxicity.BUCKETS, (400, 2)).astype(np.int32), np.concatenate(texts), np.arange(0, 24001, 60), y.astype(float))
    net = toxicity.train_net(sample, np.arange(240), np.arange(240, 300))
    z = net.logits(net.tables(), *sample.part(np.arange(300, 400)))
    assert z[y[300:]].min() > z[~y[300:]].max()
    trained = toxicity.train(odd, labels)
    got = toxicity.score(odd, trained).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.train(odd, labels.limit(0)).out_bias < -6


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, DATA)
    groups = corpus_pipeline.near_duplicates(spark, kept, DATA)
    assert kept.columns == groups.columns == docs.columns and groups.count() < kept.count() < docs.count()
    mixed = corpus_pipeline.mixture(spark, groups, DATA)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
