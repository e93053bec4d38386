"""Rows without an id are neither lost nor passed by."""

from __future__ import annotations

from dubsar.llm import chat_format, decontaminate, near_dedup


def test_conversation_of_null_id(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "a"), (None, 2, "user", "b"), (4, 0, "user", "c"), (4, 1, "assistant", "d")]
    nodes = chat_format.as_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for branches in (1, 2):
        got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat_format.parsed(chat_format.formatted(nodes, branches)).collect()}
        assert got == {None: ["hi", "a", "b"], 4: ["c", "d"]}


def test_documents_of_null_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (9, text(4)), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in near_dedup.near_dedup(docs).collect())
    assert left == sorted([(1, text(1)), (0, text(2)), (0, text(3)), (9, text(4)), (0, ""), (0, "")])
    items = spark.createDataFrame([(5, text(3)), (6, text(4))], "item_id long, text string")
    clean = sorted((r["doc_id"] or 0, r["text"] or "") for r in decontaminate.decontaminate(docs, items).collect())
    assert clean == sorted([(1, text(1)), (0, text(1)), (0, text(2)), (0, text(2)), (0, ""), (0, "")])


def test_items_without_id_are_found(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    docs = spark.createDataFrame([(1, text(1)), (2, "before " + text(2) + " after"), (3, text(3)), (4, "short item")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text(1)), (7, text(2)), (None, text(2)), (None, None), (None, "short item")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == sorted([(1, None), (2, 7), (2, None), (4, None)], key=str)
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [3]
