"""The pipeline's near-duplicate stage against all pairs by five-word Jaccard similarity of 0.8 or more."""

import random
import re

import corpus_pipeline
import pytest

from kestrel.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def stays(texts):
    """Ids that stay: the smallest of each class."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, b in enumerate(ids):
        for a in ids[:k]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i for i in ids if find(i) == i}


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"z{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("sample, stars", [(16, 2), (1, 0), (1, 3)])
def test_stage_against_all_pairs(spark, monkeypatch, sample, stars):
    monkeypatch.setattr(near_dedup, "SAMPLE", sample)
    monkeypatch.setattr(near_dedup, "STARS", stars)
    rnd = random.Random(stars)
    texts = [None, "", " \t", "one", "One", "a b c", "x " * 400]
    shared = [f"license{i}" for i in range(30)]
    for _ in range(25):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([6, 40, 150, 300]))] + shared * rnd.randint(0, 1)
        texts += [edited(rnd, base, rnd.randint(0, len(base) // 15)) for _ in range(rnd.randint(1, 8))]
    rnd.shuffle(texts)
    texts = dict(enumerate(texts))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = stays(texts)
    assert len(want) < len(texts) - 10
    got = [r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()]
    assert sorted(got) == sorted(want)


def test_stage_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()}
    assert got == stays({r.doc_id: r.text for r in df.collect()})
