"""Data-quality issues of extracted tablets: one array of findings per row, exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubsar.functions import atf
from dubsar.functions import lexicon as L
from dubsar.functions.columns import any_of, bind, has, matches, starts, words

# Fixed values in this module: types, severities and messages of issues.
ISSUE = "struct<type:string,severity:string,line:string,message:string>"
_DAMAGE = ("x", "...", "n", "xx", "X", "&")


def issue(kind: str, severity: Column | str, line: Column | str, message: Column | str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(kind).alias("type"), lit(severity).alias("severity"), lit(line).alias("line"), lit(message).alias("message")).cast(ISSUE)


def _unrecognised(x: Column) -> Column:
    """A numeral before something that is neither animal nor any known other matter."""
    c = x["clean"]
    units = ["disz", "disz@t", "u", "gesz2", "gesz'u", "szar2", "szar'u", "szargal", "asz", "la2"]
    bare = F.replace(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("("), F.lit("")), F.lit(")"), F.lit(""))
    for u in units:
        bare = F.replace(bare, F.lit(u), F.lit(""))

    def with_words(ws: Column) -> Column:
        telling = F.filter(ws, lambda w: ~w.isin(*_DAMAGE, "la2", ".") & ~matches(w, "^" + atf.NUMERAL) & ~matches(w, r"^\d+/\d+\("))
        spared = (
            has(c, "u4 ", "-kam", "ba-zal", "iti ", "mu ") | matches(bare, r"^\d*$") | (F.size(telling) == 0)
            | F.exists(ws, lambda w: w.isin(*L.MEASURES)) | F.exists(ws, lambda w: has(w, "-") & F.substring_index(w, "-", 1).isin(*L.MEASURES))
            | matches(c, r"\d+\((?:barig|ban2)\)") | has(c, *L.NOT_ANIMAL_MARKERS) | has(x["raw"], "blank space") | matches(c, r"e2-u4-\d+")
            | F.exists(ws, lambda w: starts(w, "gesz", "{gesz}")) | has(c, "szimaszgi") | matches(c, r"\d+\([^)]+\)-am3")
        )
        worn = 2 * F.size(F.filter(ws, lambda w: w.isin(*_DAMAGE, "."))) > F.size(ws)
        kind = "unrecognized_after_numeral"
        found = F.when(atf.is_summary(c), issue(kind, "info", c, "Summary line with unrecognized term after numeral")).otherwise(issue(kind, F.when(worn, "info").otherwise("warning"), c, "Numeral found but no recognized animal term follows"))
        return F.when(~spared, found)

    open_ = matches(c, atf.NUMERAL) & ~matches(c, any_of(L.ANIMALS))
    return F.when(open_, bind(words(c), with_words))


def _theophoric(lines: Column, deities: Column, people: Column) -> Column:
    """Recipients that a line may hold inside a personal name, once per deity and line."""

    def of_deity(d: Column) -> Column:
        def of_line(x: Column) -> Column:
            c = x["clean"]
            at = F.instr(c, d)
            before, after = F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(d), F.length(c))
            alone = matches(before, r"(?:^|[ \t])$") & matches(after, r"^(?:$|[ \t]|-sze3|-ra|-ke4)")
            inside = matches(before, "-$") | starts(after, "-")
            return F.when((at > 0) & ~alone, issue("possible_theophoric", F.when(inside, "info").otherwise("warning"), c, F.concat(F.lit("Deity "), d, F.lit(" may be part of a personal name"))))

        named = F.exists(people, lambda p: F.contains(p["name"], d))
        return F.when(named, F.array().cast(f"array<{ISSUE}>")).otherwise(F.array_distinct(F.filter(F.transform(lines, of_line), lambda i: i.isNotNull())))

    return F.flatten(F.transform(deities, of_deity))


def found_issues() -> Column:
    """The issues of a row of extract()."""
    lines, people, entries = F.col("lines"), F.col("persons"), F.col("animals")
    some = F.size(lines) > 0
    cleans = lambda test: F.exists(lines, lambda x: test(x["clean"]))
    marked = cleans(lambda c: matches(c, r"ki\s+\S+-ta") | has(c, "szu ba-ti", "i3-dab5", "giri3 "))
    edge, total, kept = F.col("edge_total"), F.col("total_animals"), F.col("damage.preservation")
    off = F.abs(edge - total)
    worn_total = F.exists(lines, lambda x: atf.is_category_total(x["clean"]) & atf.has_damage(x["raw"]))
    level = F.when(off <= 2, "info").when(kept < 0.8, "warning").when(off > 5, "error").otherwise("warning")
    mismatch = (edge > 0) & (total > 0) & (edge != total) & (kept >= 0.6) & ~worn_total
    single = F.array(
        F.when((F.col("transaction_type") == "") & some, issue("no_transaction", "info", "", "No transaction type detected")),
        F.when((F.size(people) == 0) & some & marked, issue("missed_persons", "warning", "", "Person role markers found but no persons extracted")),
        F.when(mismatch, issue("total_mismatch", level, edge.cast("string"), F.concat(F.lit("Edge total "), edge.cast("string"), F.lit(" ≠ extracted total "), total.cast("string"), F.lit(" (diff="), off.cast("string"), F.lit(")")))),
    )
    implied = F.transform(F.filter(entries, lambda a: (a["count"] == 1) & ~matches(a["raw"], atf.NUMERAL)), lambda a: issue("implicit_count", "info", a["raw"], F.concat(F.lit("Implicit count=1 for "), a["animal"])))
    every = F.concat(F.transform(lines, _unrecognised), _theophoric(lines, F.col("divine_recipients"), people), single, implied)
    return F.filter(every, lambda i: i.isNotNull())


def issues(extracted: DataFrame) -> DataFrame:
    """tablet_id, seq, type, severity, line, message."""
    return extracted.select("tablet_id", F.posexplode_outer(found_issues()).alias("seq", "i")).where("seq is not null").select("tablet_id", "seq", "i.*")
