"""Spelling variants, the filter audit and MinHash near-duplicates against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import filter_audit, minhash, spelling
from kestrel.storage import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LONG = " ".join(f"w{k % 7919}" for k in range(60_000))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in ("digest", "node", "n", "word", "id", "part", "h", "step", "root", "__k_key")})


# Operator 11


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in LETTERS.findall(t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_group(n):
    out, form = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(near))
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, *out[w], n.get(form[w]))
    return out


def grouped(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_finds_every_pair_once(spark, seed):
    rnd = random.Random(seed)
    # Few letters, so that words part everywhere: runs of one letter, words that end in others, accents, a supplementary letter.
    alphabet = ["ab", "aàé\U0001d4d0"][seed - 1]
    words = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 7))) for _ in range(220)} | {"a" * k for k in range(9)}
    words |= {"a" * 400, "a" * 399, "b" + "a" * 399}
    df = spark.createDataFrame([(k, w) for k, w in enumerate(sorted(words))], "id long, word string").repartition(3)
    names = dict(enumerate(sorted(words)))
    with scratch(spark) as out:
        got = Counter(frozenset((names[r.a], names[r.b])) for r in spelling.pairs(df, out).collect())
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert got == Counter(dict.fromkeys(want, 1))


def test_words_move_with_light_edges_alone(spark):
    rnd = random.Random(3)
    words = sorted({"pre" + "".join(rnd.choice("abcde") for _ in range(rnd.randint(3, 9))) for _ in range(500)})
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    with scratch(spark) as out:
        moves = Counter(r.id for r in spelling.light(spelling.edges(df), out).select("id").collect())
    assert max(moves.values()) <= np.log2(len(words))


def test_variants_of_texts(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(4, 9))) for _ in range(40)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = rnd.choice(base[:3] if rnd.random() < 0.4 else base)
            if rnd.random() < 0.1:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + "É" + w[at + 1 :], w[:at] + "x" + w[at:]])
            words.append(w.upper() if w.isascii() and rnd.random() < 0.1 else w)
        rows.append((i, rnd.choice(" ,\n-1×").join(words)))
    rows += [(None, "Hello hello HELLO hella hella"), (301, None), (302, ""), (303, " 12 Ā "), (5, "Hello hello"), (5, "Hello hello"), (304, "z" * 5000 + " ab" * 3)]
    n = brute_words(rows)
    assert "hello" in n and any(not w.isascii() for w in n)
    got = grouped(spelling.report(clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)))
    want = brute_group(n)
    assert got == want
    assert any(v[0] is not None for v in got.values())


def test_no_words(spark):
    assert spelling.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.report(spark.createDataFrame([(1, None), (2, "ab cd")], "doc_id long, text string")).count() == 0
    alone = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert grouped(spelling.group(alone)) == {"alone": (None, "alone", 3, 0, None)}


def test_ties_and_long_chains(spark):
    # Each word is the form of the next; the last has two near words of equal n.
    n = {"aaaaa" + "b" * k: 2**k for k in range(12)} | {"caaaa": 3, "daaaa": 3}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert grouped(spelling.group(df)) == brute_group(n)


# Operator 12


def fails(t):
    w = WORD.findall(t)
    out = {"A"} if len(w) < 100 else set()
    out |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
    return out | ({"D"} if re.search("[#$%&*|]", t) else set())


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = defaultdict(lambda: [0] * 6)
    for i, t, lang in rows:
        t = t or ""
        f = fails(t) | ({"E"} if i is not None and i > first[t] else set())
        good, toxic = any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)
        for p in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(p):
                c = out[lang or "", "".join(p), step + 1]
                now = x in f and not gone
                for k, add in enumerate((not gone and not now, now, x in f and gone, f == {x}, now and good, now and toxic)):
                    c[k] += add
                gone |= now
    shapley = Counter()
    for (part, p, step), c in out.items():
        shapley[part, p[step - 1]] += c[1]
    return {k: (*c, shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_audit(spark):
    rnd = random.Random(5)
    texts = [
        None, "", " \t\n", "short", "SHOUT", "a#b", " ".join(f"w{k}" for k in range(99)), " ".join(f"w{k}" for k in range(100)), "x " * 120,
        " ".join(f"v{k % 80}" for k in range(100)), " ".join(f"v{k % 79}" for k in range(100)), "ABCDEFGHI" + "é" * 81, "ABCDEFGHI" + "é" * 82, LONG, "same text", "same  text",
    ]
    rows = [(k, rnd.choice(texts), rnd.choice([None, "", "en", "fr"])) for k in range(120)]
    rows += [(None, "same text", "en"), (None, "same text", "en"), (7, "same text", "en"), (7, "same text", "en"), (-1, "short", None)]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in range(0, 130, 2)] + [(4, 1, 0), (None, 1, 1), (7, 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("digest", "part", "at", "fails", "good", "quality")})
    got = filter_audit.report(df, clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == brute_audit(rows, labels)
    assert len(got) == 3 * 600


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.report(none, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "a", "en")], none.schema), labels, {"A": filter_audit.few_words})
    assert sorted((r.filter_order, r.step, r.removed, r.shapley) for r in one.collect()) == [("AE", 1, 1, 2), ("AE", 2, 0, 0), ("EA", 1, 0, 0), ("EA", 2, 1, 2)]


def test_orders_are_crossed_without_moving_documents(spark):
    flagged = spark.range(1000).selectExpr("'en' AS part", "CAST(id % 32 AS INT) AS fails", "false AS good", "false AS toxic")
    plan = filter_audit.replay(flagged, "ABCDE")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "partial_count" in plan and plan.count("hashpartitioning") == 1


# Operator 13


def shingles(t, width=4):
    w = WORD.findall(lower(t or ""))
    n = min(width, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_classes(rows):
    """(id, set size, smallest id of the class) of each row, in order."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(rows)):
        for a in range(b):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def near_rows(rnd, groups):
    texts, passage = [], [f"license{i}" for i in range(40)]
    for _ in range(groups):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([4, 30, 120, 300]))] + passage * rnd.randint(0, 1)
        for _ in range(rnd.choice([1, 2, 8, 30])):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 18))):
                words[rnd.randrange(len(words))] = f"z{rnd.randrange(10**6)}"
            texts.append(" ".join(words).upper() if rnd.random() < 0.1 else "  ".join(words))
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("stars", [2, 0])
def test_near_duplicates(spark, monkeypatch, stars):
    monkeypatch.setattr(minhash, "STARS", stars)
    rows = near_rows(random.Random(stars), 12 + 20 * stars)
    awkward = [None, "", " \t", "one", "One", "a b c", "a b c", "x " * 300, LONG, LONG + " tail", "\x1c odd\x85space　here"]
    rows += [(1000 + k, t) for k, t in enumerate(awkward)] + [(None, "null id text"), (None, "null id text"), (1002, ""), (3, "a B c"), (3, "a B c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.report(clashing(df).repartition(3)).collect()
    want = brute_classes(rows)
    assert len({w[2] for w in want}) < len(rows) - 20
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(key((*w, w[0] == w[2])) for w in want)


def test_near_duplicates_removed(spark):
    rows = near_rows(random.Random(9), 8) + [(500, ""), (501, None), (501, None), (None, "n u l l"), (None, "n u l l")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1))
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    want = {i for i, _, c in brute_classes(rows) if i == c}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def test_no_near_duplicates(spark):
    assert minhash.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert minhash.report(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").repartition(2)).count() == 2


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.8, 0.9):
        agree = []
        for _ in range(60):
            x = rnd.integers(-(1 << 63), 1 << 63, 600)
            shared = int(600 * 2 * j / (1 + j))
            y = np.concatenate((x[:shared], rnd.integers(-(1 << 63), 1 << 63, 600 - shared)))
            agree.append((minhash.signature(np.sort(x)) == minhash.signature(np.sort(y))).sum())
        mean, spread = np.mean(agree) / minhash.HASHES, np.std(agree)
        assert abs(mean - j) < 0.02
        assert spread < 1.5 * np.sqrt(minhash.HASHES * j * (1 - j))  # as independent draws would
    assert (minhash.signature(np.empty(0, np.int64)) == minhash.signature(np.empty(0, np.int64))).all()


def test_pruning_bounds():
    """The posterior mass of similarities of 0.8 or more, by integration."""
    s = np.linspace(0, 1, 200_001)
    for n in range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH):
        least = minhash.least_matches(n)
        for m in (least - 1, least):
            density = s**m * (1 - s) ** (n - m)
            mass = density[s >= 0.8].sum() / density.sum()
            assert (mass >= minhash.MISS) == (m >= least), (n, m, mass)


def test_signatures_prune_before_the_sets(spark):
    """Pairs at similarity 0.4 meet the signatures, not the sets; those at 0.9 pass."""
    rnd = random.Random(1)
    texts = []
    for k in range(40):
        base = [f"b{k}x{j}" for j in range(200)]
        texts += [" ".join(base), " ".join(base[:115] + [f"r{rnd.random()}" for _ in range(85)]), " ".join(base[:195])]
    df = spark.createDataFrame([(k, None, t.encode()) for k, t in enumerate(texts)], "__id long, __key binary, __text binary")
    nodes = minhash.signed(df, 4).cache()
    ids = {bytes(r["node"]): r["__id"] for r in nodes.collect()}
    by_id = {i: n for n, i in ids.items()}
    pairs = spark.createDataFrame([(by_id[k], by_id[k + d]) for k in range(0, 120, 3) for d in (1, 2)], "a binary, b binary")
    with scratch(spark) as out:
        left = {(ids[bytes(r.a)], ids[bytes(r.b)]) for r in minhash.plausible(pairs, nodes, out).collect()}
    assert left == {(k, k + 2) for k in range(0, 120, 3)}


def test_last_join_emits_each_pair_once_and_none_that_the_batches_prune(spark):
    rnd = random.Random(3)
    base = [f"b{j}" for j in range(300)]
    texts = []
    for share in (0.12, 0.05):
        for _ in range(25):
            start = rnd.randrange(int(300 * (1 - share)))
            texts.append(" ".join([*base[:start], *(f"r{rnd.random()}" for _ in range(int(300 * share))), *base[start + int(300 * share) :]]))
    df = spark.createDataFrame([(k, None, t.encode()) for k, t in enumerate(texts)], "__id long, __key binary, __text binary")
    nodes = minhash.signed(df, 4).cache()
    known = nodes.collect()
    sigs = {bytes(r["node"]): np.frombuffer(r["sig"], np.uint16) for r in known}
    sets = {bytes(r["node"]): shingles(texts[r["__id"]]) for r in known}
    bands = {n: {(k, s[k : k + minhash.BAND].tobytes()) for k in range(0, minhash.HASHES, minhash.BAND)} for n, s in sigs.items()}
    names = sorted(sigs)
    met = {(a, b) for k, b in enumerate(names) for a in names[:k] if bands[a] & bands[b]}
    with scratch(spark) as out:
        blocks = minhash.buckets(nodes, out).withColumn("root", F.col("node"))
        got = [(bytes(r.a), bytes(r.b)) for r in minhash.left_pairs(blocks, nodes, out).collect()]
    links = {(a, b) for a, b in met if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) < sum(len(bands[a] & bands[b]) for a, b in met) / 4
    assert links and links <= set(got) <= met
    agree = [(sigs[a].view(np.uint8)[::2] == sigs[b].view(np.uint8)[::2]).sum() for a, b in got]
    assert min(agree) >= minhash.least_matches(minhash.HASHES)
