"""The queries that SQL states in part return everything."""

from __future__ import annotations

import pytest

from dubsar.operators import extract, flatten
from dubsar.plans.queries import QUERIES
from dubsar.sources.synthetic import tablets

ROLES = ("source", "receiver", "intermediary", "commissioner", "sealer", "deliverer")


def _flat(x: dict) -> dict:
    """The flat record of an extracted tablet, in plain Python."""
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    of = lambda role, key: [key(p) for p in x["persons"] if p["role"] == role]

    def animal(a):
        count = f"[imp:{a['imputed_count']}]" if a["is_imputed"] else str(a["count"])
        return f"{count}×{a['animal']}" + "".join(f"-{q}" for q in a["qualifiers"])

    out = {c: text(x[c]) for c in flatten.FLAT_COLUMNS if c in x}
    for r in ROLES:
        out[r] = "; ".join(of(r, lambda p: p["name"]))
    for r in ROLES[:4]:
        out[f"{r}_normalized"] = "; ".join(of(r, lambda p: p["normalized_name"] or p["name"]))
    for r in ROLES[:3]:
        out[f"{r}_title"] = "; ".join(t for t in of(r, lambda p: p["title"]) if t)
    for c in ("regnal_year", "month_number", "edge_total"):
        out[c] = str(x[c]) if x[c] else ""
    for c in ("has_summary_line", "has_sza3_bi_ta", "has_transliteration"):
        out[c] = "1" if x[c] else "0"
    out["animals_detail"] = ", ".join(map(animal, x["animals"]))
    if x["total_animals_status"] == "incomplete":
        out["total_animals_resolved"] = "NaN"
    out["divine_recipients"] = "; ".join(x["divine_recipients"])
    out |= {"preservation_score": str(x["damage"]["preservation"]), "damaged_signs": str(x["damage"]["damaged_signs"]), "broken_signs": str(x["damage"]["broken_signs"])}
    return out


def test_flat_records_have_all_columns(spark, sf_dir):
    got = QUERIES["flat_records_whole"](spark, sf_dir)
    assert got.columns == flatten.FLAT_COLUMNS and len(got.columns) == 44
    rows = {r["tablet_id"]: r.asDict() for r in got.where("cast(tablet_id AS int) % 7 = 0").collect()}
    whole = extract.extract(tablets(spark, sf_dir)).where("cast(tablet_id AS int) % 7 = 0").collect()
    assert len(rows) == len(whole) > 100
    for r in whole:
        x = r.asDict(recursive=True)
        assert rows[x["tablet_id"]] == _flat(x)
    assert all(any(r[c] for r in rows.values()) for c in ("animals_detail", "divine_recipients", "preservation_score", "source_normalized"))


def test_every_official_by_period(spark, sf_dir):
    whole, part = (QUERIES[n](spark, sf_dir).collect() for n in ("officials_by_period", "tenure_split"))
    assert {r["official"].split("#")[0] for r in whole} > {"in-ta-e3-a"}
    assert set(part) == {r for r in whole if r["official"].startswith("in-ta-e3-a")}


@pytest.mark.parametrize("name", ["flat_records_whole", "officials_by_period"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()


def test_comparisons_broadcast_no_tablets(spark, sf_dir):
    """Both sides grow with the tablets; estimated sizes of a few columns of a wide table made one a broadcast."""
    from dubsar.plans import queries

    for name in ("field_accuracy", "field_accuracy_whole", "snapshot_changes"):
        plan = getattr(queries, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name
