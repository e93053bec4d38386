"""Whole jobs: batch extraction with linkage, dictionary and glossary builds, the evaluation suite, the serving calls, and steps that run only where they are due."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from functools import reduce
from urllib.parse import parse_qs, quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dubsar.functions import atf
from dubsar.operators import analytics, annotate, evaluate, extract, flatten, issues, linkage, names
from dubsar.sources import lookup, readers
from dubsar.sources.scratch import scratch_path, stored


def process_database(spark: SparkSession, source: str, target: str, limit: int = 0, fmt: str = "csv", dictionary: DataFrame | None = None) -> DataFrame:
    """Extract a tablet CSV into flat records, write them, return what was written."""
    full = extract.extract_tablets(readers.read_tablets(spark, source, limit))
    if dictionary is not None:
        full = names.normalize_persons(full, dictionary)
    readers.write_flat(flatten.to_flat(full), target, fmt)
    return readers.read_csv(spark, target) if fmt == "csv" else spark.read.format(fmt).load(target)


def find_linked_records(extracted: DataFrame, target: str, fmt: str = "csv") -> None:
    """Link double-booked records (extract() with pos) and write the ranked pairs."""
    flat = flatten.to_flat(extracted, carried=("pos",))
    readers.write_flat(linkage.ranked(linkage.link(flat)).drop("pos_a", "pos_b"), target, fmt)


def build_dictionary(spark: SparkSession, archive: str, target: str) -> DataFrame:
    """A lemma archive into a name dictionary, written as JSON lines."""
    built = names.build_names(names.walk_lemmas(readers.read_zip_members(spark, archive)))
    readers.write_json(names.ordered_names(built), target)
    return readers.read_names(spark, target)


def build_glossary(spark: SparkSession, archive: str, target: str) -> DataFrame:
    """The glossary member of a lemma archive, written as JSON lines."""
    readers.write_json(names.build_glossary(readers.read_glossary_entries(spark, archive)), target)
    return readers.read_glossary(spark, target)


#: Sources of expectations that a suite takes; any other name takes all.
SUITES = {"gold": ["manual_translation", "cdli"], "edge": ["edge_case"]}


def run_ground_truth(spark: SparkSession, store: str, truth: str, suite: str | None = None) -> DataFrame:
    """tablet_id, source, field, passed: a JSON store of tablets held against the expectations of a suite; tablets that the store lacks are skipped."""
    expected = readers.read_ground_truth(spark, truth)
    if suite in SUITES:
        expected = expected.where(F.col("source").isin(SUITES[suite]))
    # Only tablets with expectations are extracted.
    asked = readers.read_store(spark, store).join(expected.select(F.col("tablet_id").alias("id_text")).distinct(), "id_text", "left_semi")
    compared = evaluate.compare(extract.extract(asked), expected)
    return compared.join(expected.select("tablet_id", "field", "source"), ["tablet_id", "field"])


def report(truth: DataFrame, regression: DataFrame, path: str, day: datetime.date | None = None) -> dict:
    """Results per tablet of run_ground_truth and, as rows tablet_id and passed, of a regression run: one JSON file beside the driver, also returned."""
    by_tablet = truth.groupBy("tablet_id", "source").agg(F.every("passed").alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("field")))).alias("failed_fields"))
    held, stable = ([r.asDict() for r in df.orderBy("tablet_id").collect()] for df in (by_tablet, regression))
    passed = lambda rows: sum(bool(r["passed"]) for r in rows)
    made = {
        "date": str(day or datetime.date.today()), "ground_truth_results": held, "regression_results": stable,
        "summary": {"gt_pass": passed(held), "gt_total": len(held), "reg_stable": passed(stable), "reg_total": len(stable)},
    }
    readers.dump_report(made, path)
    return made


def extract_snippets(snippets: DataFrame) -> DataFrame:
    """Rows of id_text and text, each a bare line or a whole tablet, extracted."""
    return extract.extract(snippets.withColumn("transliteration", atf.wrapped_snippet(F.col("text"))).drop("text"))


def run_steps(spark: SparkSession, steps: list[tuple[str, str, list[str], Callable[[], object]]], force: bool = False) -> list[str]:
    """Run in order those steps (name, output, sources, work) whose output is missing or not younger than every source there is; their names."""
    ran = []
    for name, output, sources, work in steps:
        made = readers.modified(spark, output)
        if force or made is None or any(made <= t for s in sources if (t := readers.modified(spark, s)) is not None):
            work()
            ran.append(name)
    return ran


def _together(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of a list for each part, in its order: for small results, bounded by the lexicon and the calendar."""
    row = lambda df: F.to_json(F.struct(*df.columns))
    rows = [df.select(F.lit(name).alias("part"), F.monotonically_increasing_id().alias("at"), row(df).alias("row")) for name, df in parts.items()]
    every = reduce(DataFrame.unionByName, rows)
    of = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == name, F.struct("at", "row")))), lambda x: x["row"])
    return every.agg(*(of(name).alias(name) for name in parts))


class Service:
    """What a front end asks for, as DataFrames over tablets that are extracted once.

    They lie in a lookup table by id, written to path (or the shared folder), as do the contributions of timelines.
    """

    def __init__(self, tablets: DataFrame, date_column: str = "dates_referenced", path: str | None = None) -> None:
        spark = tablets.sparkSession
        made = stored(extract.extract_tablets(readers.with_text(tablets), date_column), "served")
        self.by_id = lookup.write(made, path or scratch_path(spark, "served-by-id"), "tablet_id")
        self.extracted = self.by_id.rows
        self.contrib = stored(analytics.contributions(self.extracted), "contributions")

    def index(self) -> DataFrame:
        return flatten.tablet_index(flatten.to_flat(self.extracted))

    def tablet(self, tablet_id: str) -> DataFrame:
        """One tablet with annotation, summary and issues."""
        own = self.by_id.at(tablet_id)
        noted = own.withColumn("issues", issues.found_issues())
        return noted.join(annotate.annotate(own), "tablet_id").join(annotate.plain_summary(own), "tablet_id")

    def random(self, seed: int | None = None) -> DataFrame:
        return self.extracted.orderBy(F.rand(seed)).limit(1)

    def stats(self) -> DataFrame:
        return analytics.corpus_stats(self.extracted)

    def officials(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Officials in order, their network, and the periods."""
        return analytics.ordered_officials(analytics.officials(self.extracted)), analytics.edges(self.extracted), analytics.periods(self.extracted)

    def animals(self, flow: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
        return analytics.timeline(self.contrib, "animal", flow, exclude)

    def recipients(self, lens: str = "deity", flow: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
        return analytics.timeline(self.contrib, lens if lens in analytics.LENSES[1:] else "deity", flow, exclude)

    def cell(self, animal: str, period: str, granularity: str = "year", limit: int = 100, flow: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
        return analytics.cell(self.contrib, animal, period, granularity, limit, "animal", flow, exclude)

    def respond(self, url: str) -> DataFrame:
        """The rows that a GET of url asks for, each one as JSON. An unknown route raises KeyError; an unknown tablet gives no row."""
        at = urlsplit(url)
        given = {k: v[0] for k, v in parse_qs(at.query).items()}
        shared = {"flow": given.get("flow"), "exclude": tuple(x for x in given.get("exclude", "").split(",") if x)}
        route, _, rest = at.path.removeprefix("/api/").partition("/")
        routes: dict[str, Callable[[], DataFrame]] = {
            "index": self.index,
            "tablet": lambda: self.tablet(unquote(rest)),
            "random": self.random,
            "stats": self.stats,
            "timeline": lambda: _together(dict(zip(("officials", "edges", "periods"), self.officials(), strict=True))),
            "animals_timeline": lambda: self.animals(**shared),
            "recipients_timeline": lambda: self.recipients(given.get("lens", "deity"), **shared),
            "animals_cell": lambda: self.cell(given.get("animal", ""), given.get("period", ""), given.get("granularity", "year"), **shared),
        }
        told = routes[route]()
        if route == "timeline":  # its lists hold JSON already
            lists = (F.concat(F.lit(f'"{c}":['), F.array_join(c, ","), F.lit("]")) for c in told.columns)
            return told.select(F.concat(F.lit("{"), F.concat_ws(",", *lists), F.lit("}")).alias("json"))
        return readers.to_json_rows(told)

    def export(self, tablet_id: str, path: str) -> bool:
        """One tablet as a JSON file beside the driver; False, and no file, where there is none."""
        if not self.by_id.at(tablet_id).limit(1).count():
            return False
        readers.dump_report(json.loads(self.respond(f"/api/tablet/{quote(tablet_id, safe='')}").first()["json"]), path)
        return True
