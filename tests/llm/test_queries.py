"""The registered queries and the pipeline's stages on the smallest tables and odd rows, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import mixing, ngram_join, ordinal, queries, url_filter

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i * i % 997}" for i in range(30_000))
ODD = [(None, None), (10_001, ""), (10_002, "\n\t "), (10_003, "same text " * 9), (10_004, "same text " * 9), (10_005, LONG), (10_006, "汉字 é <|endoftext|> 12 x"), (10_003, "same text " * 9), (10_007, "Page 1 of 20 at the site\nonly here"), (10_008, "Page 2 of 31 at the site\r\nother words")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with odd documents, which have a clashing column, too."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "en" if i else None, "a" if i and i % 2 else None, 0) for i, t in ODD], docs.schema)
    docs.unionByName(odd).withColumn("_hit", F.lit("x")).withColumn("score", F.lit(7)).withColumn("kept", F.lit(True)).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark", "pages"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark, tables):
    return [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in queries.table(spark, tables, "documents").collect()]


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages"):
        queries.table(spark, tables, name).limit(0).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, tables, name):
    got = queries.QUERIES[name](spark, empty)
    assert got.count() == 0 and got.columns[0] in ("doc_id", "page_id", "lang")  # op12 and op13 return rows of a language


def components(docs):
    sets, sizes = [], []
    for _, text, *_ in docs:
        w = [x.translate(LOWER) for x in WORD.findall(text or "")]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        sizes.append(len(sets[-1]))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j]) if docs[i][0] is not None and docs[j][0] is not None else 0
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(docs):
        least[find(i)] = d if d is None else min(least.get(find(i), d), d)
    return [(d, sizes[i], least[find(i)]) for i, (d, *_) in enumerate(docs)]


def test_join(spark, tables, docs):
    got = queries.op1_ngram_jaccard_join(spark, tables)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(components(docs), key=str)


def test_join_deals_in_two_steps_and_links_by_the_trie(spark, tables, docs, monkeypatch):
    named = [d for d in docs if d[0] is not None]
    df = spark.createDataFrame([d[:2] for d in named], "doc_id long, text string")
    got = ngram_join.similar_components(df, bucket_bytes=20_000, fan=3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(components(named), key=str)
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(300, 40, replace=False)) for _ in range(30)]
    sets += [np.sort(np.concatenate((s[2:], 300 + rng.choice(50, 2, replace=False)))) for s in sets[:15]]
    sizes = np.array([len(s) for s in sets])
    grams, df_of = [s.astype(np.uint64) for s in sets], [np.full(len(s), 2, np.uint32) for s in sets]
    links = {(i, j) for i in range(45) for j in range(i) for n in [len(set(sets[i]) & set(sets[j]))] if 100 * n >= 75 * (80 - n)}
    a, b = ngram_join.link_block(np.arange(45), sizes, np.full(45, 11), grams, df_of)
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == links and len(links) == 15
    monkeypatch.setattr(ngram_join.PrefixTree, "match", lambda self, *x: np.zeros(0, np.int64))
    a, _ = ngram_join.link_block(np.arange(45), sizes, np.full(45, 11), grams, df_of)
    assert not len(a)  # nothing else finds links


def test_join_of_a_large_block_with_several_groups(spark):
    """One block of all texts by a passage that they share, cut into many parts; groups and chains of near copies in it."""
    rng = np.random.default_rng(4)
    shared, rows = [f"s{k}" for k in range(12)], []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(60)]
        for i in range([60, 25, 12, 6, 3, 1][g]):
            at = (i * 3) % 50 if g == 1 else int(rng.integers(50))  # group 1 is a chain
            own = base[:at] + [f"x{g}y{i}z{k}" for k in range(int(rng.integers(1, 9)))] + base[at + 2 :]
            rows.append((len(rows), " ".join(shared + own)))
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), block_ngrams=400)
    assert sorted(map(tuple, got.collect())) == sorted(components(rows))


def copies(text, items):
    w = ALNUM.findall((text or "").translate(LOWER))
    at = defaultdict(list)
    for k in {k for _, k, _ in items}:
        for i in range(len(w) - k + 1):
            at[tuple(w[i : i + k])].append(i)
    hit, ids = set(), set()
    for name, k, windows in items:
        for x in windows & at.keys():
            ids.add(name)
            hit.update(p for i in at[x] for p in range(i, i + k))
    return w, hit, sorted(ids)


@pytest.fixture(scope="module")
def items(spark, tables):
    out = []
    for r in queries.table(spark, tables, "benchmark").collect():
        w = ALNUM.findall((r["text"] or "").translate(LOWER))
        k = min(10, len(w))
        if k:
            out.append((str(r["item_id"]), k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}))
    return out


def test_decontamination(spark, tables, docs, items):
    got = Counter(map(tuple, queries.op2_decontaminate(spark, tables).collect()))
    want = Counter()
    for d, text, *_ in docs:
        w, hit, ids = copies(text, items)
        want[d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    assert got == want and any(k[-1] for k in want)


def test_quality_rules(spark, tables, docs):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in queries.op3_quality_rules(spark, tables).collect())
    want = Counter()
    for d, text, *_ in docs:
        w = WORD.findall(text or "")
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        twice = {p for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(twice), len(w) < 20 or 100 * len(twice) > 30 * len(w)] += 1
    assert got == want


def test_quality_rules_agree_with_labels(spark):
    rows = queries.op3_quality_rules(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "labels").withColumnRenamed("quality", "label"), "doc_id").where("label is not null and not base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["label"] == q] for q in (1, 0))
    assert sum(good) >= 0.95 * len(good) and (not bad or sum(bad) <= 0.2 * len(bad))


def test_quality_classifier_on_held_out_labels(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, at, "documents"), queries.table(spark, at, "labels").where("quality is not null")
    held = queries.fold("doc_id", 4) == 0
    model = ordinal.train(docs, labels.where(~held))
    rows = ordinal.score(docs.select("doc_id", "text"), model, good_grade=1).join(labels.where(held), "doc_id").collect()
    good, bad = ([r["p_good"] >= 0.5 for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_ordinal_fit_is_the_likeliest(spark):
    """An independent fit: the gradient of the log likelihood, by differences, is nearly 0 at the result."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    y = np.digitize(x @ [1.0, -0.5, 0.2] + rng.logistic(size=300), [-1, 1])
    model = ordinal.fit(x, y.astype(float), steps=3000, rate=0.02, decay=0.0)

    def loss(w, t):
        ends = np.concatenate(([-np.inf], t, [np.inf]))
        p = 1 / (1 + np.exp(-(ends[y + 1] - x @ w))) - 1 / (1 + np.exp(-(ends[y] - x @ w)))
        return -np.log(p).mean()

    base = np.concatenate((model.weights.astype(float), model.thresholds))
    for i in range(5):
        step = np.eye(5)[i] * 1e-2
        assert loss(base[:3], base[3:]) <= min(loss((base + s)[:3], (base + s)[3:]) for s in (step, -step)) + 1e-6


def rule_of(host, path):
    fits = [r for r in queries.RULES for h, slash, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(slash + p)]
    return max(fits, key=lambda r: (len(r.partition("/")[0]), len(r)), default=None)


def test_urls(spark, tables):
    for r in queries.op5_url_filters(spark, tables).join(queries.table(spark, tables, "pages").select("page_id", "url"), "page_id").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule_of(host, path))
        assert r["verdict"] == (queries.RULES[r["rule"]] if r["rule"] else "block" if r["bad_share"] > 0.5 else "allow")


def tree_shares(counted, w=4.0, pool=2.0, z=2.0):
    """Smoothed shares of bad pages, node by node, for {(host, template): (rated, bad)}."""
    prior = (sum(b for _, b in counted.values()) + 1) / (sum(r for r, _ in counted.values()) + 10)
    nodes, children, everywhere = defaultdict(lambda: [0, 0]), defaultdict(set), defaultdict(lambda: [0, 0])
    way = lambda t: ["/".join(t.split("/")[: i + 1]) for i in range(len(t.split("/")))]
    for (h, t), (r, b) in counted.items():
        for above, n in zip([None, *way(t)], way(t), strict=False):
            nodes[h, n][0] += r
            nodes[h, n][1] += b
            children[h, above].add(n)
            if above is not None:
                everywhere[n][0] += r
                everywhere[n][1] += b
    branch = {}
    for (h, _), names in children.items():
        rated = sorted(n for n in names if nodes[h, n][0])
        groups = {}
        for n in rated:
            groups.setdefault(tuple(nodes[h, n]), []).append(n)
        kinds = sorted((len(g) * r, len(g) * b, g) for (r, b), g in groups.items())
        r, b = url_filter.merged(np.array([k[0] for k in kinds]), np.array([k[1] for k in kinds]), prior, w, z) if kinds else ((), ())
        for k, x, y in zip(kinds, r, b, strict=True):
            branch.update({(h, n): (int(x), int(y)) for n in k[2]})
    out = {}
    for h, t in counted:
        seen = [(nodes[h, n] if n == "" else branch.get((h, n), (0, 0)), [everywhere[n][i] - nodes[h, n][i] if n else 0 for i in (0, 1)]) for n in way(t)]
        share = prior
        for i, (own, other) in enumerate(seen):
            (r, b), (pr, pb) = seen[i + 1] if i + 1 < len(seen) else ((0, 0), (0, 0))
            mine, theirs = (own[0] - r, own[1] - b), (other[0] - pr, other[1] - pb) if i else (0, 0)
            much = min(theirs[0], pool)
            share = (mine[1] + w * share + much * theirs[1] / max(theirs[0], 1)) / (mine[0] + w + much)
        out[h, t] = share
    return out


def test_url_tree_by_hand(spark):
    counted = {("h1", "/a/*"): (9, 9), ("h1", "/b/*"): (8, 0), ("h1", "/c"): (0, 0), ("h1", "/a/x"): (3, 3), ("h2", "/a/*"): (0, 0), ("h2", "/b"): (1, 0), ("h3", "/z"): (0, 0), ("h4", "/a/*"): (2, 0), ("", ""): (0, 0)}
    got = {(r["host"], r["template"]): r["bad_share"] for r in url_filter.purity(spark.createDataFrame([(*k, *v) for k, v in counted.items()], "host string, template string, rated long, bad long")).collect()}
    assert got == pytest.approx(tree_shares(counted)) and got["h2", "/a/*"] > 0.5 > got["h1", "/b/*"]


def test_url_clashing_columns(spark):
    df = spark.createDataFrame([("h", "/a", 1, "mine", 1, 2, "s"), ("h", "/b", None, None, None, None, None)], "host string, path string, bad int, template string, rated int, n int, _shape string")
    got = url_filter.template_verdicts(df)
    assert got.columns == ["host", "path", "bad", "rated", "n", "_shape", "template", "bad_share", "rejected"] and got.count() == 2


def test_token_ids(spark, tables, docs):
    from tokenizers import Tokenizer

    tokenizer, at, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for d, text, *_ in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op6_token_ids(spark, tables).collect()), key=lambda r: r[1]) == want


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free, left = free - over, left - sum(2 * sizes[s] for s in over)
    return out


def test_mixing(spark, tables, docs):
    first, second = (sorted(map(tuple, queries.op7_mix_sources(spark, tables).collect()), key=str) for _ in range(2))
    assert first == second
    sizes, taken = Counter(), Counter()
    size_of, source_of = {}, {}
    for d, text, source, _ in docs:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        size_of[d], source_of[d] = n, source
    want = targets(sizes)
    for d, size, source_size, target, n in first:
        assert size == size_of[d] and source_size == sizes[source_of[d]] and target == pytest.approx(want[source_of[d]]) and 0 <= n <= 2 * size
        taken[source_of[d]] += n
    for s, t in want.items():
        longest = max(n for d, n in size_of.items() if source_of[d] == s)
        assert abs(taken[s] - t) <= longest / 2 + 1, s


def test_flow_is_cheapest(spark):
    """Against all ways to route a few words."""
    words, limits, quotas = {"ab": 2, "a": 2}, {("ab", "a"): 4, ("ab", "b"): 4, ("a", "a"): 4}, {"a": 3, "b": 2}

    def cost(used):
        return sum(math.floor(math.log2(k // w)) + 1 if k >= w else 0 for w, n in used for k in range(n))

    flow = mixing.min_cost_flow(words, limits, quotas)
    got = cost([(2, flow.get(("ab", "a"), 0) + flow.get(("ab", "b"), 0)), (2, flow.get(("a", "a"), 0))])
    best = min(cost([(2, x + 2), (2, 3 - x)]) for x in range(4))
    assert got == best and flow["ab", "b"] == 2 and flow.get(("ab", "a"), 0) + flow["a", "a"] == 3


def test_rare_patterns_keep_targets(spark):
    rows = [(i, f"s{i % 5}", [f"s{i % 5}", f"s{(i + i // 5 % 4) % 5}"], 10 + i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, sources array<string>, size long")
    for most in (3, 1000):
        got, wanted = mixing.mix(df, size="size", sources="sources", doc_id="doc_id", weights=[5, 2, 1], share=1.5, source="source", max_patterns=most)
        for r in got.groupBy("source").agg(F.sum(F.col("_copies") * F.col("size")).alias("n")).collect():
            assert abs(r["n"] - wanted[r["source"]]) <= 10


def least_cost(words, limits, flow, quotas):
    """No unit of a pattern that costs more (a second use) can be given up for one that costs less, along any way of rerouting."""
    used, fed, takes = Counter(), Counter(), defaultdict(list)
    for (p, s), n in flow.items():
        assert 0 <= n <= limits[p, s]
        used[p] += n
        fed[s] += n
        takes[s].append(p)
    assert all(fed[s] == quotas[s] for s in quotas)
    to = defaultdict(list)
    for (p, s), most in limits.items():
        if flow.get((p, s), 0) < most:
            to[p].append(s)
    ahead = [s for p in words if used[p] < words[p] for s in to[p]]
    seen = set()
    while ahead:
        s = ahead.pop()
        if s not in seen:
            seen.add(s)
            for p in takes[s]:
                if used[p] > words[p]:
                    return False
                ahead += to[p]
    return True


def test_flow_of_many_patterns_is_cheapest():
    """100,000 patterns in one flow: all quotas met at the least cost; and a flow that isn't cheapest is told apart."""
    rng = np.random.default_rng(4)
    words, limits, sizes = {}, {}, Counter()
    for i in range(100_000):
        of = sorted(set(rng.integers(0, 40, 1 + i % 4).tolist()))
        words[i] = int(rng.integers(1, 400))
        for s in of:
            limits[i, s] = 2 * words[i]
            sizes[s] += words[i]
    quotas = {s: int(x) for s, x in mixing.targets(sizes, [5, 2, 1], 0.7, 2).items()}
    flow = mixing.min_cost_flow(words, limits, quotas)
    assert least_cost(words, limits, flow, quotas) and len(flow) > 50_000
    assert not least_cost({0: 5, 1: 5}, {(0, "a"): 10, (1, "a"): 10}, {(0, "a"): 10}, {"a": 10})


@pytest.mark.parametrize("broadcast", [1 << 20, -1])
def test_batches_of_patterns(spark, monkeypatch, broadcast):
    """Patterns dealt to several batches: targets met within half a document as in one flow, rerun alike, few words repeated more than the cheapest flow repeats."""
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", broadcast)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        of = sorted({f"s{j}" for j in rng.integers(0, 7, 3)})
        size = int(rng.integers(1, 60))
        rows += [(10 * i + k, s, of, size, i) for k, s in enumerate(of)]
    rows += [(99_990, "s0", None, 5, 9_999), (99_991, None, [None, "s1"], 40, 9_998), (99_992, "s1", ["s1", None], 40, 9_998)]
    df = spark.createDataFrame(rows, "doc_id long, source string, sources array<string>, size long, key long")
    again = {}
    for most in (9, 1000):
        mixed = [mixing.mix(df, size="size", sources="sources", doc_id="doc_id", weights=[5, 2, 1], share=0.6, source="source", text_key="key", max_patterns=most) for _ in range(2)]
        first, second = (sorted(map(tuple, m[0].select("doc_id", "source", "size", "key", "_copies").collect()), key=str) for m in mixed)
        assert first == second and len(first) == len(rows)
        taken, text = Counter(), defaultdict(lambda: [0, 0])
        for d, s, n, key, copies in first:
            assert 0 <= copies <= 2 and not (d == 99_990 and copies)
            taken[s] += n * copies
            text[key] = [n, text[key][1] + copies]
        for s, t in mixed[0][1].items():
            assert abs(taken[s] - t) <= 31, (most, s)
        again[most] = sum(n * max(0, c - 1) for n, c in text.values())
    total = sum(taken.values())
    assert abs(again[9] - again[1000]) < 0.1 * total


def test_languages(spark, tables, docs):
    got = queries.op8_language_id(spark, tables).collect()
    assert len(got) == len(docs) and Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in docs)
    lang = {d: x for d, _, _, x in docs}
    text = {d: x for d, x, *_ in docs}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text[r["doc_id"]] or ""):
            assert r["lang_pred"] == "und"
    held = [r for r in got if r["held_out"] and r["doc_id"] < 10_000]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def templates(docs, lead=3, similar=0.8):
    """Lines by leaf in any order that recur exactly or in a clear pattern: a lower bound, and all lines that agree with none: an upper one."""
    lines = defaultdict(set)
    for d, text, *_ in docs:
        for line in (text or "").split("\n"):
            w = tuple("*" if re.search("[0-9]", x) else x.translate(LOWER) for x in WORD.findall(line))
            if w:
                lines[w].add(text)
    alike = defaultdict(set)
    by_leaf = defaultdict(list)
    for w in lines:
        by_leaf[len(w), w[:lead]].append(w)
    for group in by_leaf.values():
        for a in group:
            for b in group:
                if sum(x == y for x, y in zip(a, b, strict=True)) >= similar * len(a):
                    alike[a] |= lines[b]
    return {w for w in lines if len(lines[w]) > 1}, {w for w in lines if len(alike[w]) > 1}


def test_lines(spark, tables, docs):
    got = defaultdict(list)
    for r in queries.op9_line_dedup(spark, tables).collect():
        got[r["doc_id"]].append(r)
    exact, close = templates(docs)
    for d, text, *_ in docs:
        words = [tuple("*" if re.search("[0-9]", x) else x.translate(LOWER) for x in WORD.findall(line)) for line in (text or "").split("\n")]
        r = got[d][0]
        assert r["n_lines"] == sum(map(bool, words)) and sum(w in exact for w in words) <= r["n_recurring"] and r["n_dropped"] == len(r["dropped_lines"]) <= r["n_recurring"]
        assert all(words[i] for i in r["dropped_lines"])
        if not any(w in close for w in words):
            assert r["n_recurring"] <= sum(map(bool, words)) * 0.2 + 1  # what only a widened template holds
    page = got[10_008][0]
    assert page["dropped_lines"] == [0] and got[10_007][0]["n_recurring"] == 1


def word_hash(word):
    """The 32 bits that tell words of a place apart; 0 is variable."""
    import pyarrow as pa

    from llm.words import pieces

    (piece,) = pieces(pa.array([word]))
    return 0 if word == "*" else int((piece.hashes().astype(np.uint32)[0] or 1).view(np.int32))


def plain_line_report(docs, lead=3, similar=0.8):
    """Each row's id, n_lines, n_recurring, n_dropped and dropped lines, sorted."""
    parsed = [[tuple("*" if re.search("[0-9]", x) else x.translate(LOWER) for x in WORD.findall(line)) for line in (text or "").split("\n")] for _, text, *_ in docs]
    lines = {w for text in parsed for w in text if w}
    counts, in_place = Counter(), defaultdict(Counter)
    for w in lines:
        for place in range(lead, len(w)):
            counts[len(w), w[:lead], place, w[place]] += 1
            in_place[len(w), w[:lead], place][w[place]] += 1
    template = {}
    for w in lines:
        misses = min(math.floor(len(w) * (1 - similar) + 1e-9), len(w) - lead - 1)
        out = list(w)
        if misses > 0:
            n = {place: counts[len(w), w[:lead], place, w[place]] for place in range(lead, len(w))}
            least = sorted(n.values())[misses]
            for place in (p for p in n if n[p] < least):
                most = max(in_place[len(w), w[:lead], place].values())
                out[place] = max((x for x, k in in_place[len(w), w[:lead], place].items() if k == most), key=word_hash) if most >= least else "*"
        assert sum(x != y for x, y in zip(w, out, strict=True)) <= max(misses, 0)
        template[w] = tuple(out)
    texts, first = defaultdict(set), {}
    for (d, text, *_), rows in zip(docs, parsed, strict=True):
        for w in filter(None, rows):
            texts[template[w]].add(text)
            first[template[w]] = min(first.get(template[w], math.inf), math.inf if d is None else d)
    out = []
    for (d, *_), rows in zip(docs, parsed, strict=True):
        again = [i for i, w in enumerate(rows) if w and len(texts[template[w]]) > 1]
        cut = [i for i in again if first[template[rows[i]]] != (math.inf if d is None else d)]
        out.append((d, sum(map(bool, rows)), len(again), len(cut), cut))
    return sorted(out, key=str)


def test_lines_equal_plain_python(spark, tables, docs):
    assert sorted((tuple(r) for r in queries.op9_line_dedup(spark, tables).collect()), key=str) == plain_line_report(docs)


@pytest.fixture(scope="module")
def leaves():
    """Lines of large leaves: a variable field, near copies with a few odd words each, fields with few values, other lines with a common range."""
    rng = np.random.default_rng(5)
    vocabulary = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    base = ["copy", "of", "it", *rng.choice(vocabulary, 37)]
    rows = []
    for i in range(300):
        near = base.copy()
        for place in rng.choice(np.arange(3, 40), rng.integers(0, 4), replace=False):
            near[place] = rng.choice(vocabulary)
        apart = ["at", "the", "end", *"is this range of".split(), *rng.choice(vocabulary, 12)]
        city = ("rome", "oslo", "bonn")[i % 3]
        rows.append((i if i % 50 else None, "\n".join([f"at 1 2 the value of item {vocabulary[i % 100]} is high", " ".join(near), f"in the city {city} it is now warm", " ".join(apart), "a b", "a b c d", "A b c e"])))
    return rows + rows[:7] + [(9000, " \n\t"), (9001, ""), (9002, None), (9003, "in the city " + "x " * 70_000)]


@pytest.mark.parametrize("hot", [50_000, 20, 1])
def test_lines_of_large_leaves(spark, leaves, hot):
    """Whatever is broadcast or shuffled, no column differs; all planted near copies and fields are found."""
    from llm import line_templates

    got = sorted((tuple(r) for r in line_templates.line_report(spark.createDataFrame(leaves, "doc_id long, text string"), hot=hot).collect()), key=str)
    assert got == plain_line_report(leaves)
    planted = [r[4] for r in got if r[0] is not None and 2 <= r[0] < 300]
    assert all({0, 1, 2, 4}.issubset(x) for x in planted) and not any(3 in x for x in planted if x)


def test_toxicity_on_held_out_labels(spark):
    at = "/root/testdata/sf0.01"
    rows = queries.op10_toxicity(spark, at).join(queries.table(spark, at, "labels"), "doc_id").where("toxic is not null").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    toxic = [r["predicted"] for r in held if r["toxic"] == 1]
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert sum(toxic) >= 0.5 * len(toxic) and sum(clean) <= 0.1 * len(clean)


def test_toxicity_of_odd_rows(spark, tables, docs):
    got = queries.op10_toxicity(spark, tables).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)


# the pipeline


def test_stages(spark, tables, docs, items):
    df = queries.table(spark, tables, "documents")
    kept = corpus_pipeline.quality(spark, df, tables)
    model = ordinal.train(df, queries.table(spark, tables, "labels"))
    good = ordinal.score(df.select("doc_id", "text"), model, good_grade=1).where("p_good >= 0.5")
    assert kept.columns == df.columns and Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(r[0] for r in good.select("doc_id").collect())
    one = corpus_pipeline.near_duplicates(spark, df, tables)
    texts = [(r["doc_id"], r["text"]) for r in one.collect()]
    groups = {d: c for d, _, c in components(docs)}
    stay = {d for d, c in groups.items() if d is not None and d == c}
    named = Counter(d for d, _ in texts if d is not None)
    assert one.columns == df.columns and set(named) == stay and named[10_003] == 1 and sum(d is None for d, _ in texts) == 1
    clean = {r["doc_id"]: r for r in corpus_pipeline.clean_of_benchmark(spark, df, tables).collect()}
    for d, text, *_ in docs:
        w, hit, _ = copies(text, items)
        assert (d in clean) == (2 * len(hit) <= len(w))
        if d in clean:
            assert clean[d]["text"] == text if not hit else ALNUM.findall(clean[d]["text"].translate(LOWER)) == [x for i, x in enumerate(w) if i not in hit]
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mixture(spark, df, tables).collect())
    assert max(mixed.values()) <= 2 * 2 and set(mixed) <= set(groups)  # one id is there twice


def test_run(spark, tables):
    docs = queries.table(spark, tables, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
    from tokenizers import Tokenizer

    tokenizer, at, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, tables).collect()), key=lambda r: r[1]) == want


def test_near_duplicates_of_documents_that_share_a_key(spark, monkeypatch):
    """Should all keys of 64 bits be the same, no document goes but exact repetitions of rows."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "other words"), (1, "a second text"), (None, text)], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, text), (3, "other words"), (1, "a second text"), (None, text)], key=str)
    monkeypatch.setattr(corpus_pipeline.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, text), (2, text), (3, "other words"), (1, "a second text"), (None, text)], key=str)
