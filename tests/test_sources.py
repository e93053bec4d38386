"""Files read from many splits, archives by member, trees of any depth: each against the plain way."""

from __future__ import annotations

import csv
import io
import json
import random
import zipfile

import pytest

from dubsar.operators import names
from dubsar.sources import archives, readers, splits

CELLS = ["plain", "", 'say ""x""', "two\nlines", "a,b", "\n\n", "cr\r\nlf", '"', "é" * 7, "&P1 = x\n1. 3(disz) udu\n2. ki a-ta", " pad "]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in before.items():
        spark.conf.set(k, v)


def _csv(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end, quoting=csv.QUOTE_NONNUMERIC).writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_splits_equals_the_file(spark, tmp_path, small_splits, end):
    rng = random.Random(2)
    header = ["id_text", "designation", "transliteration", "pos"]
    files = {"b.csv": 120, "a.csv": 90, "c.csv": 0}
    want = []
    for name, n in files.items():
        rows = [[f"{name}{i}", rng.choice(CELLS), rng.choice(CELLS) + ("\nlong cell" * 60 if i % 40 == 7 else ""), "given"] for i in range(n)]
        _csv(tmp_path / name, [header, *rows], end)
        want.append((name, rows))
    want = [[c or None for c in r] for _, rows in sorted(want) for r in rows]  # Spark reads an empty cell as null
    small_splits(700)
    frame = readers.read_csv(spark, str(tmp_path))
    assert frame.columns == header
    table = splits.records(spark, str(tmp_path), splits.Quoted())
    assert table.select("file", "start").distinct().count() > 16
    got = [list(r) for r in frame.collect()]
    key = lambda r: r[0]
    assert sorted(got, key=key) == sorted(want, key=key)
    small_splits(1 << 27)
    assert sorted(map(list, readers.read_csv(spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)


def test_pos_follows_files_and_limit_stops(spark, tmp_path, small_splits):
    header = ["id_text", "transliteration"]
    (tmp_path / "in").mkdir()
    for name, n in (("z.csv", 300), ("a.csv", 5)):
        _csv(tmp_path / "in" / name, [header, *([f"{name}{i}", f"1. gu4\n2. {i}"] for i in range(n))])
    small_splits(500)
    want = [f"a.csv{i}" for i in range(5)] + [f"z.csv{i}" for i in range(300)]
    assert [r["id_text"] for r in readers.read_tablets(spark, str(tmp_path / "in")).orderBy("pos").collect()] == want
    (tmp_path / "in" / "zz.csv.gz").write_bytes(b"no archive at all")  # never opened
    assert [r["id_text"] for r in readers.read_tablets(spark, str(tmp_path / "in"), 9).orderBy("pos").collect()] == want[:9]


def test_json_store_in_splits_equals_the_file(spark, tmp_path, small_splits):
    rng = random.Random(4)
    odd = ["", "{", "}", '"', "\\", 'x"}{\\', "\n", "é}", "1. {d}inanna\n2. [x] gu4"]
    entries = [(f'k"{i}\\}}{{' if i % 9 == 0 else str(i % 150), {"atf": "".join(rng.choices(odd, k=rng.randint(0, 6))), "rul": "AS", "yr": str(i), "des": rng.choice(odd)}) for i in range(200)]
    text = "{" + ",\n ".join(f"{json.dumps(k, ensure_ascii=i % 2 == 0)}: {json.dumps(v, ensure_ascii=i % 3 == 0)}" for i, (k, v) in enumerate(entries)) + "}\n"
    (tmp_path / "store.json").write_text(text, encoding="utf-8")
    want = {(k, v["des"], v["atf"], f"AS.{v['yr']}..", "") for k, v in json.loads(text).items()}
    for size in (300, 1 << 27):
        small_splits(size)
        got = readers.read_store(spark, str(tmp_path / "store.json")).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    small_splits(300)
    assert splits.records(spark, str(tmp_path / "store.json"), splits.Entries()).select("start").distinct().count() >= 8
    for nothing in ("{}", "", "{ }\n"):
        (tmp_path / "none.json").write_text(nothing)
        assert readers.read_store(spark, str(tmp_path / "none.json")).collect() == []


def test_zip_members_by_range(spark, tmp_path):
    rng = random.Random(1)
    members = {f"p/corpusjson/{i}.json": "".join(rng.choices("abcé{}", k=rng.randint(0, 4000))) for i in range(60)} | {"p/other.json": "{}", "p/corpusjson/x.txt": "no"}
    for a, kind in (("one.zip", zipfile.ZIP_DEFLATED), ("two.zip", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(tmp_path / a, "w", kind) as z:
            for name, text in members.items():
                with z.open(f"{a}/{name}", "w", force_zip64=True) as m:
                    m.write(text.encode())
    found = readers.read_zip_members(spark, str(tmp_path / "*.zip"), group=20_000)
    assert found.rdd.getNumPartitions() > 8
    want = {(f"{a}/{n}", t) for a in ("one.zip", "two.zip") for n, t in members.items() if "corpusjson" in n and n.endswith(".json")}
    assert {tuple(r) for r in found.collect()} == want
    assert readers.read_zip_members(spark, str(tmp_path / "one.zip"), "nothing").collect() == []


def test_damaged_member_is_told(tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.json", "{}")
    with zipfile.ZipFile(buffer) as z:
        i = z.infolist()[0]
    with pytest.raises(zipfile.BadZipFile):
        archives.unpacked(buffer, archives.Member(i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC ^ 1))


def _tree(rng: random.Random, depth: int = 0) -> str:
    scalar = lambda: rng.choice(['"l"', '"\\u006c"', '"c"', '"x\\"}{"', "1", "-2.5e3", "true", "null", '""'])
    out = []
    for _ in range(rng.randint(0, 5)):
        key = rng.choice(["node", "f", "cdl", "cdl", "x", "n\\u006fde"])
        kind = rng.random()
        if key == "cdl" and kind < 0.8 and depth < 5:
            value = "[" + " , ".join(_tree(rng, depth + 1) if rng.random() < 0.9 else rng.choice(["null", "[[1]]", "[]", '"s"']) for _ in range(rng.randint(0, 3))) + "]"
        elif key == "f" and kind < 0.7:
            value = '{"form": "w%d", "gw": [1, {"a": "}"}], "pos": null, "cf": %s}' % (rng.randint(0, 99), scalar())
        else:
            value = '"l"' if key == "node" and kind < 0.7 else scalar() if kind < 0.9 or depth > 4 else _tree(rng, depth + 1)
        out.append(f'"{key}" : {value}')
    return "{" + ", ".join(out) + "}"


def test_pulled_words_equal_parsed_ones():
    rng = random.Random(9)
    n = bad = 0
    for _ in range(4_000):
        text = _tree(rng)
        if rng.random() < 0.2:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "{", "}", ",", '"', "\\", "1", " ", "]"]) + text[at + 1 :]
        try:
            want = list(names._parsed_words(text))
        except ValueError:
            bad += 1
            with pytest.raises(ValueError):
                list(names._pulled_words(text))
            continue
        n += len(want)
        assert list(names._pulled_words(text)) == want, text
    assert n > 300 and bad > 100


def test_deep_tree_is_walked_and_malformed_ones_give_nothing(spark):
    deep = '{"node": "c", "cdl": [' * 50_000 + '{"node": "l", "f": {"form": "a"}}' + "]}" * 50_000
    rows = [("deep", deep), ("cut", deep[:-1]), ("tail", '{"cdl": [{"node": "l", "f": {"form": "a"}}]} x'), ("null", None), ("two", '{"cdl": [null, {"f": {"form": "b", "cf": 7}, "cdl": [{"node": "l", "f": {"form": "c"}}], "node": "l"}]}')]
    got = names.walk_lemmas(spark.createDataFrame(rows, "doc string, json string")).orderBy("doc", "seq").collect()
    assert [(r["doc"], r["seq"], r["form"], r["cf"]) for r in got] == [("deep", 1, "a", None), ("two", 1, "b", "7"), ("two", 2, "c", None)]
