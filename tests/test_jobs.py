"""Whole jobs and serving calls over a small CSV."""

from __future__ import annotations

import csv
import json
import zipfile

from dubsar.operators import evaluate
from dubsar.operators.flatten import FLAT_COLUMNS
from dubsar.plans import jobs
from dubsar.sources import readers


def test_batch_link_and_serve(spark, tmp_path):
    text = "@tablet\n@obverse\n1. 5(disz) udu niga\n2. ki na-sa6-ta\n3. ur-mes i3-dab5\n4. {n}\n5. iti ezem-mah\n6. u4 3(disz)-kam"
    with open(tmp_path / "in.csv", "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id_text", "designation", "transliteration", "date_of_origin", "dates_referenced"])
        for i in range(4):
            w.writerow([str(i), f"T{i}", "" if i == 3 else text.replace("{n}", "{d}en-lil2" if i else "e2-gal-sze3"), "Amar-Suen.05.09.03", "Amar-Suen.05.09.03"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("corpusjson/P1.json", json.dumps({"cdl": [{"node": "l", "f": {"form": "na-sa₆", "cf": "Nasa", "pos": "PN"}}]}))
    known = jobs.build_dictionary(spark, str(tmp_path / "z.zip"), str(tmp_path / "names"))
    flat = jobs.process_database(spark, str(tmp_path / "in.csv"), str(tmp_path / "flat"), dictionary=known)
    rows = {r["tablet_id"]: r for r in flat.collect()}
    assert flat.columns == FLAT_COLUMNS and rows["0"]["source_normalized"] == "Nasa" and rows["0"]["animals_detail"] == "5×udu-niga" and rows["3"]["has_transliteration"] == "0"
    service = jobs.Service(readers.read_tablets(spark, str(tmp_path / "in.csv")))
    jobs.find_linked_records(service.extracted, str(tmp_path / "pairs"))
    assert {(r["tablet_a"], r["tablet_b"]) for r in readers.read_csv(spark, str(tmp_path / "pairs")).collect()} == {("0", "1"), ("0", "2"), ("1", "2")}
    assert service.index().count() == 3 and service.random(1).count() == 1
    noted = service.tablet("1").first()
    assert noted["en"].startswith("This tablet records a transfer of 5 sheep (niga). From na-sa6 [Chief Official]. Received by ur-mes [Shepherds].") and "For god en-lil2." in noted["en"]
    assert {r["key"]: r["value"] for r in service.stats().where("measure = 'by_transaction'").collect()} == {"transfer": 3}
    people, network, when = service.officials()
    assert [(r["source"], r["target"], r["count"]) for r in network.collect()] == [("na-sa6", "ur-mes", 3)] and people.count() == 2 and when.count() == 2
    assert service.animals().where("granularity = 'year'").first()["period"] == "AS.05" and service.recipients("deity").where("granularity = 'total'").first()["total_count"] == 10
    assert service.cell("udu", "AS.05.09", "month", 2).count() == 2
    shot = evaluate.snapshot(service.extracted)
    assert evaluate.snapshot_diff(shot, shot).count() == 0
