"""Small tables of near-dedup go to few files, however many partitions shuffles have."""

from dubsar.llm import near_dedup, shared


def test_components_of_few_edges_are_written_to_few_files(spark, monkeypatch):
    files = []

    def counted(df, name, *rows):
        out = shared.stored(df, name, *rows)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(200).selectExpr("id * 7 as a", "id * 7 + 7 * (id % 4) as b")
        found = {(r["id"], r["comp"]) for r in near_dedup.components(edges).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    # Brute force: the smallest id that edges lead to.
    label = {7 * (k + d): 7 * (k + d) for k in range(200) for d in (0, k % 4) if k % 4}
    moved = True
    while moved:
        moved = False
        for k in range(200):
            if k % 4:
                a, b = 7 * k, 7 * (k + k % 4)
                low = min(label[a], label[b])
                moved |= label[a] != label[b]
                label[a] = label[b] = low
    assert found == set(label.items())
    assert max(files) == 1
