"""Every pipeline stage on its predecessor's rows, against brute force; and on awkward tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_dedup import norm
from test_near import stays

from kestrel.llm import langid

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def cut(texts, window=35):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    starts = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - window + 1) if starts[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        if not gone:
            out[i] = texts[i]
        elif len(gone) < len(w):
            out[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        assert name == "best_fit_packing" or docs.columns == COLUMNS
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    language = by_id(kept["language_id"])
    judged = {r.doc_id: r.lang_pred != "und" and r.score >= 0.2 for r in langid.report(whole).collect()}
    assert set(language) == {i for i, good in judged.items() if good}

    least = {}
    for i in sorted(language):
        least.setdefault(norm(language[i]), i)
    exact = by_id(kept["exact_dedup"])
    assert exact == {i: language[i] for i in least.values()}

    near = by_id(kept["simhash_near_dedup"])
    assert near == {i: exact[i] for i in stays(exact)}

    cleaned = by_id(kept["substring_dedup"])
    assert cleaned == cut(near)
    assert all(r.n_chars == len(r.text) for r in kept["substring_dedup"].collect())

    pieces = {}
    for r in kept["best_fit_packing"].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    counts = {i: len(WORD.findall(t or "")) for i, t in cleaned.items()}
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: n for i, n in counts.items() if n}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_tables(spark, name, stage):
    rows = [
        (1, "the quick brown fox", "en", "a", 19), (1, "the quick brown fox", "en", "a", 19), (2, None, None, None, None), (3, "", "en", None, 0),
        (None, "no id here at all", None, "b", None), (5, "the dog " * 3000, "en", "a", None), (5, "another text of the same id", None, None, 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = df.withColumns({n: F.lit("clash") for n in ("id", "key", "fp", "digest", "piece", "score", "n", "row", "kept", "rid", "tag", "word", "n_words")})
    for given in (df, clash):
        out = stage(spark, given, SF)
        assert name == "best_fit_packing" or out.columns == given.columns
        assert 0 < out.count() <= len(rows) + 1
        assert stage(spark, given.limit(0), SF).count() == 0
