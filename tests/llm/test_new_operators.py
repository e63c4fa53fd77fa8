"""Pages, source divergence and phrases against plain Python."""

import html
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from llm import collocations, common, divergence, html_extraction, queries, toxicity, words
from llm.html_extraction import main_text

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """The smallest documents and odd ones: nulls, empty and long texts, ties, repeated rows, a group without terms, clashing columns."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    long = " ".join(f"w{chr(97 + i * i % 23)}{chr(97 + i % 7)}" for i in range(30_000))
    docs += [(None, None, None, None), (1, "", "", ""), (2, "a b. a b\ta b  A B! é汉 é汉", None, "s"), (3, long, "en", None), (4, "12 34 ...", "xx", "p"), (5, "a b c", "xx", "q")]
    docs += [(6, "tie one two. tie one two. two\x1cx", None, "s")] * 20 + [(7, "one two three four, " * 40, None, "t")] * 3 + [(8, "zz", "yy", "only")]
    return docs


def of(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    return df.withColumns({"n": F.lit("x"), "term": F.lit(1), "rank": F.lit(2), "phrase": F.lit(None).cast("string"), "p": F.lit(0)})


def by_counting(docs, top=200):
    terms, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        found, lang, source = TERM.findall((text or "").translate(LOWER)), lang or "", source or ""
        terms[lang, source].update(found)
        seen[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        whole = Counter({t: sum(terms[lang, s][t] for s in sources) for t in kept})

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(terms[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            words = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if terms[lang, s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", words, top)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(rows[:most], 1)]
    return sorted(out)


def test_divergence(spark, odd_docs):
    got = divergence.divergence(of(spark, odd_docs)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == by_counting(odd_docs)


def test_divergence_ranks_by_slices(spark):
    docs = [(k, " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), "en", s) for k in range(3) for s in "ab"] + [(9, "zz zz zz", "en", "c")] * 3
    got = divergence.divergence(of(spark, docs), top=7).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == by_counting(docs, 7)


def phrases(docs, min_count=30, inside=80, top=2000, longest=4):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        held = {w: a for w, a in f.items() if len(w) > 1 and a >= min_count}
        for w, a in held.items():
            score, k = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w)))
            inner = any(len(x) > len(w) and 100 * b >= inside * a and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for x, b in held.items())
            if not inner:
                rows.append((-score, -a, " ".join(w), f[w[:k]], f[w[k:]]))
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode()))
        out += [(lang, i, p, -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", [{}, {"min_count": 3, "top": 40}, {"min_count": 5, "filter_bits": 1 << 20, "inside": 100}])
def test_collocations(spark, odd_docs, kind):
    got = collocations.collocations(of(spark, odd_docs), **kind).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = phrases(odd_docs, **{k: v for k, v in kind.items() if k != "filter_bits"})
    assert sorted(map(tuple, got)) == want and want


def test_a_full_bit_map_loses_nothing(spark, odd_docs, monkeypatch):
    want = sorted(map(tuple, collocations.frequent_phrases(of(spark, odd_docs), min_count=5).collect()))
    monkeypatch.setattr(collocations, "_bit_map", lambda pairs, most: np.full(1 << 10, 255, np.uint8))
    assert sorted(map(tuple, collocations.frequent_phrases(of(spark, odd_docs), min_count=5).collect())) == want
    monkeypatch.setattr(collocations, "_bit_map", lambda pairs, most: np.zeros(1 << 10, np.uint8))
    assert max(r["words"] for r in collocations.frequent_phrases(of(spark, odd_docs), min_count=5).collect()) == 2


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_collocations"])
def test_the_registered_queries(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert sorted(map(tuple, got.collect())) == (by_counting(docs) if "12" in name else phrases(docs))


def test_pages_of_the_table(spark):
    """All of the article's text and nothing else, on whole pages."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op11_html_extraction(spark, DATA).collect()}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        article = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", x)) for x in re.split(r"</?(?:h1|p|br)[^>]*>", article))
        assert got[k]["text"] == " ".join(want.split()) and got[k]["n_chars"] == len(got[k]["text"])


PAGE = """<html><body class="has-sidebar"><header class="site"><h1>Site</h1><a href=x>home</a></header><nav><a href=1>a</a></nav>
<div id=content class="main-content sidebar-right"><h1>Title</h1><div class="text"><p>One, two, three. This is a text that is long enough.<p>More &amp; more,&nbsp;here <b>bo</b>ld
<a href=z>link</a>.<div class="share-buttons">Share this</div><ul><li>item one<li>item two</ul><ul><li><a href=1>Other news</a><li><a href=2>Other 2</a><li><a href=3>Other 3</a></ul></div>
<div class=comments><p>Nice article, I like it, really, a lot of text, more than the article has, really, many, commas, here.</p></div></div>
<aside><p>Side, with, commas</p></aside><form><input><button>Go</button></form><div class="cookie-notice">We use cookies</div><footer>&copy;</footer><script>var a="<p>x</p>"</script></body></html>"""
CASES = {
    PAGE: "Title One, two, three. This is a text that is long enough. More & more, here bold link. item one item two",
    "": "", "   ": "", "plain text only": "plain text only", "<p>a<b>": "a", '<a href="x>unclosed <p>text': "unclosed text", "<!-- x": "", "a < b and c<d": "a < b and c<d",
    "<div hidden>no</div>yes": "yes", "<script>x": "", "<table><tr><td>a<td>b<tr><td>c</table>": "a b c", "<b>x</b>y<br>z": "xy z", "<h1>only title</h1>": "only title",
    "<p>tie, one<p>tie, two": "tie, one tie, two", "<div class=ad>only an advert</div>": "only an advert", "<p>&#x41;&eacute;&lt;b&gt; &bogus; &amp;amp;</p>": "Aé<b> &bogus; &amp;",
    '<div title="a>b" data-hidden="x">text</div>': "text", "<article><section><p>first, part</section><section><p>second, part, longer</section></article><p>x": "first, part second, part, longer",
}


@pytest.mark.parametrize("page", CASES, ids=range(len(CASES)))
def test_main_text(page):
    assert main_text(page) == CASES[page]


def test_pages_with_odd_rows(spark):
    rows = [(None, None, None), (1, "u", PAGE), (1, "u", PAGE), (2, "", ""), (3, "v", "<p>" + "long, text " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, text string, html string").withColumn("_page", F.lit(7))
    got = html_extraction.extract(df).collect()
    assert [(r["page_id"], r["_page"]) for r in got] == [(r[0], 7) for r in rows] and [r["text"] for r in got[:4]] == ["", CASES[PAGE], CASES[PAGE], ""] and len(got[4]["text"]) == 2_199_999


@pytest.mark.parametrize("part", ["<div>", "<p><b>", '<a href="x" ', "<li>", "<td>x", "<span class=ad>", "<i><div></i>", "</p>", "<p>a, b", "<ul><li>", '="', "<!-- ", "<table><tr><td>"])
def test_broken_pages_take_time_by_length(part):
    def took(n):
        begin = time.process_time()
        main_text(part * n)
        return time.process_time() - begin

    took(1000)
    assert took(40_000) < 20 * max(took(10_000), 0.05) and math.isfinite(took(10))


def test_toxicity_learns_from_every_label(spark):
    """More labels than were once sampled, those that say toxic only among the last of the former order; several tasks learn."""
    order = F.row_number().over(Window.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id"))
    docs = spark.range(9000).withColumnRenamed("id", "doc_id").withColumn("bad", order > 8000)
    docs = docs.withColumn("text", F.concat_ws(" ", F.concat(F.lit("word"), F.col("doc_id") % 50), F.when(F.col("bad"), "vile").otherwise("calm"), F.concat(F.lit("end"), F.col("doc_id") % 7))).cache()
    labels = docs.select("doc_id", F.col("bad").cast("int").alias("toxic"))
    nets = [toxicity.train(docs.select("doc_id", "text"), labels, task_bytes=60_000) for _ in range(2)]
    assert (nets[0].embedding == nets[1].embedding).all() and nets[0].threshold == nets[1].threshold
    got = toxicity.score(docs.select("doc_id", "bad", "text"), nets[0])
    assert got.where("bad != (predicted = 1)").count() == 0


def test_toxicity_reads_blocks_in_small_batches(spark, monkeypatch):
    """However much text a task trains on, its batches stay small; and how files are split doesn't change who trains on what."""
    docs = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("bad", F.col("doc_id") % 3 == 0)
    word = F.concat(F.lit(" word"), F.col("doc_id") % 50, F.when(F.col("bad"), " vile").otherwise(" calm"))
    docs = docs.withColumn("text", F.repeat(word, 300 + (F.col("doc_id") % 100).cast("int"))).cache()
    labels, seen, added = docs.select("doc_id", F.col("bad").cast("int").alias("toxic")), [], toxicity.added

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    def spy(df, *rest):
        seen.extend(r["size"] for r in df.mapInArrow(sizes, "size long").collect())
        return added(df, *rest)

    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    nets = [toxicity.train(docs.select("doc_id", "text"), labels)]
    monkeypatch.setattr(toxicity, "added", spy)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        nets.append(toxicity.train(docs.select("doc_id", "text"), labels))
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "512k"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(seen) > 4 and max(seen) < 6 << 20  # all of it is 8 MB
    assert (nets[0].embedding == nets[1].embedding).all()


def test_pieces_whatever_the_batches():
    rng = np.random.default_rng(1)
    texts = [None if n % 11 == 0 else "ab " * int(n) for n in rng.integers(0, 90, 400)] + ["x" * 900, "", None]
    whole = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["t", "i"])
    want = [whole.column("i").slice(p.first, p.n).to_pylist() for p in words.pieces(whole.column("t"), size=500)]
    for step in (1, 7, 150, 1000):
        parts = [whole.slice(a, step) for a in range(0, len(texts), step)]
        assert [b.column("i").to_pylist() for b in common.whole_pieces(iter(parts), "t", 500)] == want
    assert list(common.whole_pieces(iter([]), "t")) == []
