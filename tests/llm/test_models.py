"""Language ID, URL rules, top-k, BPE, packing and the pipeline."""

import hashlib
import random
import re
from itertools import combinations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrel.llm import bpe, langid, packing, queries, topk, url_rules

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, t, lang) for i in range(20) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    edge = [(100, None, "en"), (101, "", None), (102, "12 !?", "de"), (None, "the dog", None), (104, "und die " * 5000, None)]
    df = spark.createDataFrame(rows + edge, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.report(df).collect() if r.doc_id is None or r.doc_id >= 100}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[None][0] == "en" and got[104][0] == "de"
    kept = langid.accept(df)
    assert kept.columns == df.columns and kept.where("doc_id IN (100, 101, 102)").count() == 0
    assert langid.report(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.report(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def exact_rates(model_grams, text, false_rate):
    """Shares of a text's n-grams in each language's set, found without filters."""
    keys = langid.gram_keys(langid._squeezed(text))
    return {lang: np.isin(keys, grams).mean() for lang, grams in model_grams.items()}


def test_filters_against_exact_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {}
    build = langid.Model.build.__func__
    langid.Model.build = classmethod(lambda cls, grams, **kw: (kept.update(grams), build(cls, grams, **kw))[1])
    try:
        model = langid.fit(docs)
    finally:
        langid.Model.build = classmethod(build)
    agreed = n = 0
    for r in docs.where(F.col("text").isNotNull() & (F.length("text") > 200)).limit(200).collect():
        rates = model.rates(r.text)
        if rates is None:
            continue
        exact = exact_rates(kept, r.text, model.false_rate)
        assert all(abs(rates[k] - exact[lang]) < 0.03 for k, lang in enumerate(model.languages))
        n += 1
        agreed += model.languages[int(rates.argmax())] == max(model.languages, key=exact.get)
    assert n > 100 and agreed / n > 0.99


def test_slices_of_very_long_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = langid.report(docs).collect()
    monkeypatch.setattr(langid, "SLICE", 5_000)
    model = langid.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    same = [model.predict(texts[r.doc_id])[0] == r.lang_pred for r in whole]
    assert np.mean(same) > 0.995


def brute_url(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    stops = [tail.find(c) for c in "?#" if c in tail]
    path = tail[: min(stops)] if stops else tail
    return "".join(c.lower() if c.isascii() else c for c in host), path


def brute_rule(host, path):
    fit = [(h + p, kind) for kind, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://Example.ORG/es/x?q=1", "https://a.example.org/en/12#t", "http://notexample.org/en/1", "http://x.com/de/",
        "http://x.com/fr/?a://b/", "http://com/de/9", "ftp://y.com?x", "http://x.org", "http://É.org/a", "http://a\nb.org/c", "a://b://c/d",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("tokens", F.lit("clash"))
    got = {r.page_id: r for r in url_rules.report(df).collect()}
    for i, u in enumerate(urls):
        host, path = brute_url(u)
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u
    assert url_rules.report(df.limit(0)).count() == 0


def test_mined_rules_block_their_urls(spark):
    urls = [(i, f"http://shop.net/{'casino' if i % 2 else 'news'}/{i}") for i in range(100)] + [(200, "http://other.net/casino/x"), (201, "http://other.net/y")]
    pages = spark.createDataFrame(urls, "__id long, url string")
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(100)], "__id long, bad boolean")
    got = url_rules.judge(pages, labels).collect()
    assert all((r.verdict == "block") == ("casino" in dict(urls)[r["__id"]]) for r in got) and len(got) == len(urls)
    # Thousands of other pages take nothing from a rule: its support is a number, not a share.
    more = spark.createDataFrame([(1000 + i, f"http://site{i}.net/news") for i in range(3000)], "__id long, url string")
    wide = labels.unionByName(more.select("__id", F.lit(False).alias("bad")))
    few = pages.where("__id < 12 OR __id >= 200").unionByName(more)
    assert {r["__id"] for r in url_rules.judge(few, wide).where("verdict = 'block'").collect()} == {1, 3, 5, 7, 9, 11, 200}


def brute_tokens(url):
    host, path = brute_url(url)
    if not host:
        return frozenset()
    words = re.findall(r"[^\W_]*[-a-z][-a-z0-9]*|[-a-z0-9]+", path.lower())
    words = [w for w in words if re.search("[a-z-]", w)]
    return frozenset([f"h:{x}" for x in host.split(".")] + [f"p:{w}" for w in words] + [f"q:{k}" for k in re.findall(r"[?&](\w+)=", url)])


def brute_mined(taught, min_urls, confidence):
    """Rules by counting every token set of every bad URL."""
    total = [t for t, _ in taught if t]
    plain = {x for t, bad in taught if bad for x in t if not all(x in u for u in total)}
    sets = {frozenset(c) for t, bad in taught if bad for n in range(1, len(t & plain) + 1) for c in combinations(sorted(t & plain), n)}
    rules = {}
    for s in sets:
        holds = [bad for t, bad in taught if s <= t]
        if sum(holds) >= min_urls and sum(holds) / len(holds) >= confidence:
            rules[s] = sum(holds) / len(holds)
    return {s: c for s, c in rules.items() if not any(rules.get(s - {x}, -1) >= c for x in s)}


def spelt_out(rules, classes):
    """Rules with every choice of a token for each class."""
    of = {}
    for r in classes.collect():
        of.setdefault(r.cls, []).append(r.token)
    return {frozenset(choice): r.confidence for r in rules.collect() for choice in product(*(of[c] for c in r["items"]))}


@pytest.mark.parametrize("longest", [12, 0])
def test_minimal_rules_by_either_way(spark, monkeypatch, longest):
    """FP-growth and growing by levels give the confident sets without a confident part."""
    monkeypatch.setattr(url_rules, "LONGEST", longest)
    rnd = random.Random(6)
    taught = []
    for _ in range(250):
        words = {f"p:{x}" for x in "abcdefgh" if rnd.random() < 0.45}
        words |= {"p:twin", "q:twin"} if "p:a" in words else set()
        bad = {"p:b", "p:c"} <= words or {"p:d", "p:e", "p:f"} <= words or rnd.random() < 0.05
        taught.append((frozenset(words), bool(bad)))
    sets = {frozenset(c) for t, bad in taught if bad for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}
    confident = {}
    for s in sets:
        holds = [bad for t, bad in taught if s <= t]
        if sum(holds) >= 5 and sum(holds) / len(holds) >= 0.9:
            confident[s] = sum(holds) / len(holds)
    want = {s: c for s, c in confident.items() if not any(r < s for r in confident)}
    df = spark.createDataFrame([(sorted(t), bad) for t, bad in taught], "tokens array<string>, bad boolean").repartition(3)
    mined, classes = url_rules.mine(df)
    got = spelt_out(url_rules.pruned(mined), classes)
    assert len(want) > 3 and max(map(len, want)) >= 3
    assert got == {s: pytest.approx(c) for s, c in want.items()}


def test_long_and_repeated_urls(spark):
    """Subsets of a long URL's words are not enumerated, however often it is repeated or parts of it occur elsewhere."""
    long = "/".join(f"word{k}x" for k in range(40))
    urls = [f"http://a.example.org/es/{long}"] * 6 + [f"http://b.org/word{k}x" for k in range(40)] + [f"http://c{k}.net/{long}" for k in range(3)]
    urls += ["http://d.example.org/es/" + "/".join(f"many{k % 5000}y" for k in range(20_000))] * 4 + ["http://e.net/plain", None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.report(pages).collect()}
    assert [got[k] for k in range(len(urls))] == ["block"] * 6 + ["allow"] * 40 + ["block"] * 3 + ["block"] * 4 + ["allow"] * 3
    pages = spark.createDataFrame([(k, urls[0]) for k in range(10_000)] + [(-1, "http://c.net/word3x"), (-2, "http://b.org/")], "page_id long, url string")
    assert url_rules.report(pages).where("verdict = 'block'").count() == 10_001


def test_rules_against_every_token_set(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = pages.collect()
    taught, rest = [], {}
    for r in rows:
        rule, verdict = brute_rule(*brute_url(r.url))
        if verdict:
            taught.append((brute_tokens(r.url), verdict == "block"))
        else:
            rest[r.page_id] = brute_tokens(r.url)
    want = brute_mined(taught, url_rules.MIN_URLS, url_rules.MIN_CONFIDENCE)
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    told = pages.select(url_rules.host(url).alias("host"), url_rules.path(url).alias("path"), url_rules.tokens(url).alias("tokens"))
    told = told.withColumn("fixed", url_rules.fixed(host, path)[1]).where("fixed IS NOT NULL").select("tokens", (F.col("fixed") == "block").alias("bad"))
    mined, classes = url_rules.mine(told)
    found = spelt_out(url_rules.pruned(mined), classes)
    assert want and found == want
    got = {r.page_id: r.verdict for r in url_rules.report(pages).collect()}
    judged = {i: "block" if any(s <= t for s in want) else "allow" for i, t in rest.items()}
    assert {i: got[i] for i in judged} == judged and set(judged.values()) == {"allow", "block"}


def brute_top(rows, k):
    out = {}
    fine = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for n, (q, v) in enumerate(fine):
        if q % 100 == 0:
            found = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(fine) if m != n and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("shard_rows, query_block", [(40, 2), (10_000, 4_096)])
def test_topk(spark, shard_rows, query_block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(400)]
    rows += [(i + 1000, rows[i][1]) for i in range(30)]  # ties
    rows += [(5000, None), (5100, [1.0, None, 0.0, 0.0]), (5200, [float("nan"), 0.0, 0.0, 0.0]), (5300, [1.0, 2.0]), (5301, [0.0, 1.0]), (5400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=shard_rows, query_block=query_block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: v for q, v in brute_top(rows, 10).items() if v}
    assert got == want
    assert topk.report(df.limit(0)).count() == 0


def test_topk_of_ragged_vectors(spark):
    """Every vector may have a dimension of its own: only those of several shards reach the driver."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=1 + i % 60)]) for i in range(300)] + [(1000 + i, [0.0] * (1 + i)) for i in range(5)] + [(7000, [5.0] * 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.report(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in brute_top(rows, 10).items() if v}


def test_topk_leaves_far_cells_out(spark, monkeypatch):
    rng = np.random.default_rng(2)
    places = rng.normal(size=(8, 6)) * 20
    rows = [(i, [float(x) for x in (places[i % 8] + rng.normal(size=6) * 0.2)]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    written = []
    monkeypatch.setattr(topk.Scratch, "write", lambda self, d, label, write=topk.Scratch.write: (written.append((label, write(self, d, label))), written[-1][1])[1])
    counts = []
    monkeypatch.setattr(topk, "materialize", lambda d, label, keep=topk.materialize: (counts.append(sum(t.count() for n, t in written if n == "sent")), keep(d, label))[1])
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top(rows, 10)
    assert counts[0] < 16 * 16 / 2  # of 16 queries and 16 cells, most pairs are never sent


def test_bpe(spark):
    path = queries.tokenizer_path()
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    texts = [None, "", " \t\n", "a<|endoftext|>b <|STARTOFTEXT|> it's 12 x　y é e\u0301 ΣΑΣ İ 日本語 🎉👍🏽", "x " * 3000, "\x1c a\x85b   c", "it's it's 'S"]
    df = spark.createDataFrame([(i if i else None, x) for i, x in enumerate(texts)], "doc_id long, text string").withColumn("chunk", F.lit("clash"))

    def want(x):
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back

    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.report(df, path).collect())
    assert got == sorted((str(i if i else None), *want(x)[:3]) for i, x in enumerate(texts))
    back = bpe.decode(bpe.encode(df, path), path).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i if i else None), want(x)[3]) for i, x in enumerate(texts))
    assert bpe.report(df.limit(0), path).count() == 0


@pytest.mark.parametrize("words", [1, 7])
def test_bpe_in_small_chunks(spark, words):
    path = queries.tokenizer_path()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).select("doc_id", "text")
    want = sorted(map(tuple, bpe.report(docs, path).collect()))
    old = bpe.CHUNK_WORDS, bpe.BUCKET_BYTES, bpe.ENCODE_WORDS
    bpe.CHUNK_WORDS, bpe.BUCKET_BYTES, bpe.ENCODE_WORDS = words * 100, 1000, words
    try:
        assert sorted(map(tuple, bpe.report(docs, path).collect())) == want
    finally:
        bpe.CHUNK_WORDS, bpe.BUCKET_BYTES, bpe.ENCODE_WORDS = old


def test_bpe_refuses_tokenizers_that_look_across_words():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises((ValueError, KeyError)):
        bpe.check_tokenizer(f.read())


def brute_pack(lengths, capacities):
    """The method in plain words: best fit, else the length whose trial filling costs least a token; then downsize."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins = []
    for k, i in enumerate(order):
        n = lengths[i]
        fit = [b for b in bins if b["room"] >= n]
        if fit:
            b = min(fit, key=lambda b: (b["room"], bins.index(b)))
        else:
            trials = []
            for c in capacities:
                if c >= n:
                    room = c
                    for j in order[k:]:
                        room -= lengths[j] if lengths[j] <= room else 0
                    trials.append((packing.cost(c) / (c - room), c))
            b = {"room": min(trials)[1], "items": []}
            bins.append(b)
        b["room"] -= n
        b["items"].append(i)
    used = [sum(lengths[i] for i in b["items"]) for b in bins]
    return [sorted(b["items"]) for b in bins], [min(c for c in capacities if c >= u) for u in used]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_best_fit(lengths):
    sizes = (5, 11, 25, 40)
    owner, offset, final = packing.best_fit(lengths, sizes)
    items, want = brute_pack(lengths, sizes)
    assert [sorted(i for i, b in enumerate(owner) if b == k) for k in range(len(final))] == items and final == want
    spans = sorted((owner[i], offset[i], lengths[i]) for i in range(len(lengths)))
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans[:-1], spans[1:], strict=True))


def least_cost(lengths, sizes):
    """Cost of the best packing of a few items, by every grouping."""
    best = [float("inf")]

    def go(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(min(packing.cost(c) for c in sizes if c >= u) for u in bins))
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= max(sizes):
                go(k + 1, [u + lengths[k] * (j == b) for j, u in enumerate(bins)])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def test_packing_cost_against_every_grouping():
    rnd = np.random.default_rng(3)
    ratios, opened = [], set()
    for _ in range(40):
        lengths = [int(x) for x in rnd.integers(40, 4096, size=7)]
        _, _, final = packing.best_fit(lengths, packing.CAPACITIES)
        opened |= set(final)
        ratios.append(sum(map(packing.cost, final)) / least_cost(lengths, packing.CAPACITIES))
    assert min(ratios) >= 1 - 1e-9 and np.mean(ratios) < 1.1 and max(ratios) < 1.5, (np.mean(ratios), max(ratios))
    assert opened == set(packing.CAPACITIES)


def test_several_lengths_occur_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bins = packing.pack(docs).groupBy("bin_id", "capacity").agg(F.sum("length").alias("used")).collect()
    assert {r.capacity for r in bins} == set(packing.CAPACITIES)
    words = sum(len((r.text or "").encode().split()) for r in docs.collect())
    one = -(-words // 4096) * packing.cost(4096)
    assert sum(r.used for r in bins) == words and sum(packing.cost(r.capacity) for r in bins) < one


def test_packing(spark):
    texts = [None, "", "a b c", "w " * 25, "x " * 10, "y", "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n": F.lit("clash"), "row": F.lit(0)})
    got = packing.pack(df, capacities=(4, 10), group_items=4).collect()
    placed = {}
    for r in got:
        placed.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t in enumerate(texts):
        at = 0
        for start, n in sorted(placed.get(i, [])):
            assert start == at
            at += n
        assert at == len((t or "").split())
    for b in {r.bin_id for r in got}:
        own = [r for r in got if r.bin_id == b]
        assert sum(r.length for r in own) <= own[0].capacity and len({r.capacity for r in own}) == 1
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_of_one_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 60_000), (2, "a b")], "doc_id long, text string")
    got = packing.pack(df, capacities=(4, 10), group_items=1000).collect()
    mine = sorted((r.start, r.length) for r in got if r.doc_id == 1)
    assert mine == [(i, 10) for i in range(0, 60_000, 10)]


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in out}
    assert 0 < len(kept) <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    for r in out:
        assert 0 < r.length <= r.capacity and r.bin_offset + r.length <= r.capacity
