"""Operator 13 moves the signatures of those texts alone that share a band with another."""

from kestrel import storage
from kestrel.llm import minhash


def test_signatures_of_clean_texts_are_not_written_again(spark, monkeypatch):
    clean = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)]
    words = [f"v{k}" for k in range(100)]
    near = [(100, " ".join(words)), (101, " ".join([*words[:-1], "other"])), (102, " ".join(words))]
    seen, real = [], storage.materialize

    def watched(df, label="step"):
        table, path = real(df, label)
        if {"sig", "node"} <= set(table.columns):
            seen.append((label, table.select("node").distinct().count()))
        return table, path

    monkeypatch.setattr(storage, "materialize", watched)
    rows = minhash.report(spark.createDataFrame(clean + near, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {**{i: i for i, _ in clean}, 100: 100, 101: 100, 102: 100}
    # Once for every text as it is signed, once a set, then only the two sets that meet.
    assert [n for label, n in seen if label not in ("signed", "nodes")] == [2] and len(seen) == 3
