"""Deduplication, sharding and line filters against brute force."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrel.llm import exact_dedup, line_dedup, rolling, rows, sharding, simhash, substring_dedup
from kestrel.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASES = [
    (1, "The quick  brown fox"), (2, "The quick brown fox"), (3, None), (4, ""), (5, " \t\n"), (None, "null id text"),
    (7, "the Quick brown fox"), (8, "a b"), (8, "a b"), (9, "one"), (10, "x " * 4000), (11, "ÀÉ É à"), (12, "\x1c odd\x85space\u3000here"),
]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    return df.withColumns({"digest": F.lit("clash"), "uid": F.lit(1), "kept": F.lit(False), "fp": F.lit("x"), "key": F.lit(None).cast("int")})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact(spark, docs):
    got = exact_dedup.report(docs).collect()
    groups = Counter(norm(t) for _, t in CASES)
    least = {}
    for i, t in CASES:
        if i is not None:
            least[norm(t)] = min(least.get(norm(t), i), i)
    assert len(got) == len(CASES)
    want = sorted((str(i), str(least.get(norm(t))), groups[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in CASES)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(k.encode()).hexdigest(): 1 for k in groups})
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.report(empty(spark)).count() == 0


def test_index_persists_between_batches(spark):
    index = exact_dedup.scratch_index(spark)
    one = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.deduplicate(one, index=index).collect()} == {5, 6}
    assert {r.doc_id for r in exact_dedup.deduplicate(two, index=index).collect()} == {2}
    assert index.read().count() == 3
    index.drop()


def test_sharding(spark, docs):
    for shards in (1, 3, 40):
        got = sharding.assign(docs, shards).collect()
        assert len(got) == len(CASES)
        size = {(i, t): (0 if t is None else len(t.encode())) + 16 for i, t in CASES}
        assert sorted(r.size for r in got) == sorted(size[c] for c in CASES)
        assert sorted(r.crc for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in CASES)
        order = sorted(got, key=lambda r: (r["shard"], r.slot))
        for s in {r["shard"] for r in got}:
            own = [r for r in order if r["shard"] == s]
            assert [r.slot for r in own] == list(range(len(own)))
        ids = [(-1 if r["__id"] is None else r["__id"]) for r in order]
        assert ids == sorted(ids)  # contiguous in key order
        whole, most = sum(size[c] for c in CASES), max(size.values())
        assert all(abs(sum(r.size for r in got if r["shard"] == s) - whole / shards) <= most for s in range(shards))
    assert sharding.assign(empty(spark), 4).count() == 0


def fingerprint(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    n = min(3, len(w))
    hs = [xxhash.xxh64(" ".join(w[i : i + n]).encode(), seed=42).intdigest() for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs):
    got = sorted((str(r.doc_id), r.fingerprint) for r in simhash.report(docs).collect())
    assert got == sorted((str(i), f"{fingerprint(t):016x}") for i, t in CASES)
    by = {r.doc_id: r.component_id for r in simhash.report(docs).collect()}
    assert by[7] == 1 and by[2] == 1 and by[4] == 3 and by[5] == 3 and by[None] is None
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 8, 9, 10, 11, 12, None]))
    assert simhash.report(empty(spark)).count() == 0


@pytest.mark.parametrize("dense", [0, 3, 1000])
def test_links_give_brute_force_components(spark, dense):
    rnd = random.Random(dense)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 25)):
            x = base
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, dense)).collect()}
    want = {}
    for i, x in enumerate(signed):
        want.setdefault(find(i), []).append(x)
    for members in want.values():
        assert {found.get(x, x) for x in members} == {min(members)}


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (None, 3)], "a long, b long")
    assert {(r.node, r.root) for r in components(path).collect()} == {(i, 0) for i in range(1, 61)}


def removed(texts, window):
    ws = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        hit = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                hit[i : i + window] = [True] * window
        kept = b" ".join(x for x, h in zip(w, hit, strict=True) if not h)
        out.append((len(w), sum(hit), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window,first", [(3, 3), (7, 3), (35, 9)])
def test_substrings(spark, window, first):
    rnd = random.Random(window)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3 * window))) for _ in range(25)]
    passage = " ".join(f"w{i}" for i in range(2 * window))
    texts += [None, "", passage + " tail", "head " + passage, passage, passage, "z " * (3 * window)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    judged = substring_dedup.judged(df, window=window, first=first)
    ids = df.select("doc_id", *substring_dedup._rid(rows.text_key("text")))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in ids.join(judged, ["rid", "tag"]).collect())
    assert got == [(i, *x) for i, x in enumerate(removed(texts, window))]


def test_substrings_in_small_runs(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, substring_dedup.report(docs).collect()))
    monkeypatch.setattr(substring_dedup, "RUN_BYTES", 300)
    assert sorted(map(tuple, substring_dedup.report(docs).collect())) == want


def test_substrings_stop_when_no_candidate_is_left(spark, monkeypatch):
    labels = []
    write = substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, label: (labels.append(label), write(df, label))[1])
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 60), i -> concat(id, '_', i)), ' ')").alias("text"))
    got = substring_dedup.report(df).collect()
    assert {r.n_removed for r in got} == {0} and {r.n_words for r in got} == {60}
    assert "level0" in labels and "level1" not in labels


def test_substring_edges(spark, docs):
    assert substring_dedup.report(empty(spark)).count() == 0
    assert substring_dedup.report(docs).count() == len(CASES)
    cleaned = substring_dedup.clean(docs)
    assert cleaned.columns == docs.columns
    left = {r.doc_id: r.text for r in cleaned.collect()}
    assert 10 not in left and left[1] == "The quick  brown fox"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=8).filter(lambda b: len(b.split()) == 1 and b.split()[0] == b), max_size=40), st.integers(1, 6))
def test_window_hashes_depend_on_words_alone(words, length):
    text = b" ".join(words)
    one, two = rolling.Words([text]), rolling.Words([b"pre fix", text, b"post"])
    n = len(words) - length + 1
    if n > 0:
        a = one.windows(length)
        b = two.windows(length, at=np.arange(n) + 2)
        assert (a == b).all()
        same = {}
        for i in range(n):
            same.setdefault(tuple(words[i : i + length]), set()).add(int(a[i]))
        assert all(len(v) == 1 for v in same.values()) and len(set(a.tolist())) == len(same)


def test_runs_over_block_edges(monkeypatch):
    values = np.arange(1000, dtype=np.uint8)
    starts, ends = np.arange(0, 900, 7), np.arange(0, 900, 7) + 50
    whole = rolling.runs(values, starts, ends, rolling.BASES[0])
    monkeypatch.setattr(rolling, "BLOCK", 64)
    monkeypatch.setattr(rolling, "_TABLES", {})
    assert (rolling.runs(values, starts, ends, rolling.BASES[0]) == whole).all()


def test_lines(spark):
    pages = [(i, "h", f"menu \nbody {i}\n\n footer") for i in range(10)] + [(20, "h", None), (21, None, "menu"), (22, "small", "menu\nmenu")]
    df = spark.createDataFrame(pages, "doc_id long, source string, text string").withColumn("lines", F.lit("clash"))
    for limit in (100_000, 0):  # broadcast, and salted
        got = {r.doc_id: r for r in line_dedup.clean(df, ratio=0.5, broadcast_rows=limit).collect()}
        assert got[3]["__kept"] == "body 3\n" and got[3]["__n_dropped"] == 2
        assert got[20]["__kept"] is None and got[20]["__n_lines"] == 0
        assert got[21]["__kept"] == "menu" and got[22]["__kept"] == "menu\nmenu"
    assert line_dedup.report(empty(spark)).count() == 0
    clash = df.withColumns({c: F.lit("clash") for c in ("host", "line", "n", "pages")})
    assert {r.doc_id: r["__kept"] for r in line_dedup.clean(clash, ratio=0.5).collect()} == {r.doc_id: r["__kept"] for r in line_dedup.clean(df, ratio=0.5).collect()}


def test_shard_folders_hold_whole_rows(spark, docs, tmp_path):
    clash = docs.withColumns({"shard": F.lit("own"), "size": F.lit(1), "slot": F.lit(None).cast("int")})
    plan = sharding.write_shards(clash, f"{tmp_path}/out", 3, files=6)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == sorted([*clash.columns, "shard_"])
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, clash.select("doc_id", "text").collect()))
    assert Counter(r.shard_ for r in back.collect()) == Counter(r["shard"] for r in plan.collect())
    assert {r["shard"] for r in back.collect()} == {"own"}


def test_shards_of_equal_texts(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(300)]
    got = sharding.spread(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {(r.copies, r.shards) for r in got} == {(200, 4), (1, 1)}  # the largest spread: every shard


def test_sharding_does_not_gather_partitions(spark, docs):
    plan = sharding.assign(docs, 4)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Window" not in plan


def test_index_batches_run_again(spark):
    from kestrel.storage import scratch

    index = exact_dedup.scratch_index(spark)
    one = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c")], "doc_id long, text string")
    exact_dedup.deduplicate(one, index=index, batch="one")
    with scratch(spark) as out:  # a run that appends and then dies
        index.ingest(two, out, "doc_id", "text", "two")
    assert {r.doc_id for r in exact_dedup.deduplicate(two, index=index, batch="two").collect()} == {2}
    assert {r.doc_id for r in exact_dedup.deduplicate(two, index=index, batch="three").collect()} == set()
    before = sorted(map(tuple, index.read().collect()))
    index.compact()
    assert sorted(map(tuple, index.read().collect())) == before and len(before) == 3
    assert {r.doc_id for r in exact_dedup.deduplicate(one, index=index, batch="one").collect()} == {5, 6}
    index.drop()


SESSION = """
import sys
from pyspark.sql import SparkSession
from kestrel.llm import exact_dedup
folder, ids, texts = sys.argv[1], sys.argv[2].split(","), sys.argv[3].split(",")
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config(
    "spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"{folder}/shared").getOrCreate()
index = exact_dedup.DigestIndex(spark, "seen", 4, f"{folder}/the index's files")
docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id string, text string")
print("KEPT", *sorted(r.doc_id for r in exact_dedup.deduplicate(docs, index=index).collect()))
if len(sys.argv) > 4:
    index.compact()
print("HELD", index.read().count(), index.buckets)
"""


def test_index_lasts_longer_than_a_session(tmp_path):
    """Processes without a metastore, one after another, on one folder."""
    root = Path(__file__).resolve().parents[2]
    env = os.environ | {"PYTHONPATH": str(root)}
    run = lambda *args: subprocess.run([sys.executable, "-c", SESSION, str(tmp_path), *args], env=env, capture_output=True, text=True, check=True, cwd=tmp_path).stdout
    assert re.findall("(?:KEPT|HELD).*", run("x1,x2,x3", "a,b,a", "compact")) == ["KEPT x1 x2", "HELD 2 4"]
    assert re.findall("(?:KEPT|HELD).*", run("w0,w1", "a,c")) == ["KEPT w1", "HELD 3 4"]
    folders = sorted(p.name for p in (tmp_path / "the index's files").iterdir() if not p.name.startswith("."))
    assert folders == ["g1", "index.json"]


def test_index_survives_a_change_of_state_that_died(spark):
    index = exact_dedup.scratch_index(spark)
    exact_dedup.deduplicate(spark.createDataFrame([(5, "a")], "doc_id long, text string"), index=index)
    fs, at = index._file("index.json")
    fs.rename(at, index._file("next.json")[1])  # the old file is gone, the new one not yet named
    again = exact_dedup.DigestIndex(spark, f"{index.table}_again", 99, index.path)
    assert again.buckets == index.buckets and again.read().count() == 1
    assert exact_dedup.deduplicate(spark.createDataFrame([(1, "a")], "doc_id long, text string"), index=again).count() == 0
    again.drop()


def test_index_side_is_read_by_bucket(spark):
    index = exact_dedup.scratch_index(spark)
    exact_dedup.deduplicate(spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string"), index=index)
    new = spark.createDataFrame([(b"x" * 32,)], "digest binary")
    plan = new.join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # of the new digests alone
    index.drop()


def test_string_ids_pass_in_batches(spark):
    rows = [(f"doc-{k:04d}", f"text {k % 70}") for k in range(200)] + [(None, "text 3"), ("doc-", "text 199"), ("doc-0199é", "text 4")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    seen = df.select(F.col("doc_id").alias("__id"))
    parts = [sorted(str(r["__id"]) for r in p.collect()) for p in exact_dedup._in_order(seen, 3)]
    assert len(parts) == 3 and all(len(p) > 50 for p in parts)
    known = [[i for i in p if i != "None"] for p in parts]
    assert all(known[k][-1] < known[k + 1][0] for k in range(2)) and "None" in parts[-1]
    least = {}
    for i, t in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    got = exact_dedup.report(df).collect()
    assert sorted((str(r.doc_id), r.keep_id) for r in got) == sorted((str(i), least[t]) for i, t in rows)
    assert sum(r.kept for r in got) == len(least)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_of_one_table_give_the_same_rows(spark, docs, batches):
    def rows(n):
        got = exact_dedup.judged(docs, "doc_id", "text", batches=n).collect()
        return sorted((str(r["__id"]), bytes(r.digest), str(r.keep_id), r.group_size) for r in got), sum(r.kept for r in got)

    assert rows(batches) == rows(1)


def test_later_batches_meet_a_filled_index(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
    got = exact_dedup.report(df).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {
        (i, i % 7, len(range(i % 7, 40, 7)), i < 7) for i in range(40)
    }


def test_chain_prunes_before_the_whole_distance(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        two = [b for s in rnd.sample(range(6), 2) for b in range(simhash.EDGES[s], simhash.EDGES[s + 1])]
        for _ in range(8):  # members differ within two segments of the ring
            fps.add(base ^ sum(1 << b for b in rnd.sample(two, rnd.randint(0, 4))))
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    pairs = simhash.met(simhash.blocks(df)).distinct()
    through = pairs.where(simhash.chained(F.col("a"), F.col("b")))
    near = through.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    every = sorted(fps)
    want = sum((x ^ y).bit_count() <= 2 for i, x in enumerate(every) for y in every[:i])
    counts = pairs.count(), through.count(), near.count()
    assert counts[0] > counts[1] > counts[2] == want, counts
    print("met at a key, through the chain, within two bits:", counts)


def test_very_long_texts_in_runs(spark, monkeypatch):
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(n)) for n in (1, 50, 2000, 4999)]
    whole = [fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "VOTES", 64)
    assert [simhash.fingerprint(t.encode()) for t in texts] == whole


def test_hot_node_joins_can_be_split(spark):
    """A star of which one node holds nearly all links: the join is of two written tables."""
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        from kestrel.storage import materialize

        edges, _ = materialize(spark.range(20000).select(F.when(F.col("id") < 15000, 0).otherwise(F.col("id")).alias("b"), (F.col("id") + 100000).alias("a")).repartition(8))
        least, _ = materialize(edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u"))
        df = edges.join(least, edges.b == least.u)
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
        assert components(edges).count() == 20000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
