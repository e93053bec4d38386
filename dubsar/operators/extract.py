"""The tablet pipeline: one wide row of facts per text.

What a line says depends on the line alone, on a few kinds of lines also on the one
before. extract_tablets() therefore works it out once for each frequent line of the
whole corpus and hands that to all tasks; other lines are worked out where they stand.
extract() does so with all lines, in one pass: for streams and small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubsar.functions import atf
from dubsar.functions import lexicon as L
from dubsar.functions.columns import any_of, bind, chain, first, found, has, last, lookup, matches, q, starts, strings, strip, total, words
from dubsar.sources.scratch import shared_table, stored

# Fixed values throughout this module: the marks and patterns of lines are those of the text format and its records.
PERSON = "struct<name:string,role:string,title:string,normalized_name:string,name_type:string>"
ANIMAL = "struct<count:bigint,animal:string,qualifiers:array<string>,raw:string,damaged:boolean,is_imputed:boolean,imputed_count:bigint>"
_OPTIONAL = {"designation": "", "transliteration": "", "date_of_origin": "", "dates_referenced": ""}


def with_defaults(df: DataFrame) -> DataFrame:
    """Optional columns that are missing, and nulls, become ''."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in df.columns else F.lit(v) for c, v in _OPTIONAL.items()})


# --- Transaction ----------------------------------------------------------


def keyword(clean: Column) -> Column:
    """The transaction that a line names, null if none."""
    return F.when(has(clean, "szu ba-ti"), "receipt").when(has(clean, "ba-zi", "ba-an-zi"), "expenditure").when(has(clean, "i3-dab5"), "transfer").when(has(clean, "mu-kux"), "delivery")


def transaction_type(lines: Column) -> Column:
    """Damaged delivery marks first, then the last line with a keyword, then marks of document kinds."""
    raw = F.array_join(F.transform(lines, lambda x: x["raw"]), " ")
    clean = F.array_join(F.transform(lines, lambda x: x["clean"]), " ")
    delivery = F.when(has(raw, "mu-kux(DU) lugal", "mu-kux lugal"), "royal_delivery").otherwise("delivery")
    primary = last(F.filter(F.transform(lines, lambda x: x["keyword"]), lambda t: t.isNotNull()))
    kinds = {"sza3-bi-ta": "sub_disbursement", "zi-ga": "expenditure", "sa2-du11": "regular_offering", "nig2-ka9": "running_account", "la2-ia3": "deficit_account", "u3-tu-da": "birth_record"}
    secondary = chain(((has(clean, k), F.lit(v)) for k, v in kinds.items()), F.lit(""))
    return F.when(F.exists(lines, lambda x: x["marked"]), delivery).otherwise(F.coalesce(bind(primary, lambda p: F.when(p == "delivery", delivery).otherwise(p)), secondary))


# --- Persons --------------------------------------------------------------


def _person(name: Column, role: str, title: Column | None = None, kind: str = "") -> Column:
    return F.struct(name.alias("name"), F.lit(role).alias("role"), (F.lit("") if title is None else title).alias("title"), F.lit("").alias("normalized_name"), F.lit(kind).alias("name_type"))


def _titled(text: Column, role: str, cut: str = "before", unless: tuple[str, ...] = (), named: bool = False) -> Column:
    """A person from text; its title goes with what follows it ("before") or alone ("out"); null if vetoed."""

    def of(t: Column) -> Column:
        name = F.when(t == "", text).otherwise(strip(F.replace(text, t, F.lit("")) if cut == "out" else _up_to(text, t)))
        bad = lambda n: starts(n, *unless) | ((n == "") if named else F.lit(False))
        return bind(name, lambda n: F.when(bad(n), F.lit(None).cast(PERSON)).otherwise(_person(n, role, t)))

    return bind(atf.title_in(text), of)


def _up_to(text: Column, mark: Column) -> Column:
    return F.substring(text, F.lit(1), F.instr(text, mark) - 1)


_FROM_PLACE = r"ki\s+(.+?)-ta(?:\s|$)"
_TOOK = r"^(.+?)\s+szu ba-ti"
_SEIZED_ALONE = r"^i3-dab5\s*$"


def _of_line(line: Column, prev: Column, later: Column) -> list[Column]:
    """The persons of one line in the order of the rules; null where a rule does not fire."""
    none = F.lit(None).cast(PERSON)
    grab = lambda pattern, text=line: strip(found(text, pattern))
    source = F.when(matches(line, _FROM_PLACE), _person(grab(_FROM_PLACE), "source", atf.title_in(line))).when(starts(line, "ki ") & has(prev, "zi-ga"), bind(grab(r"ki\s+(.+)"), lambda n: _titled(n, "source", unless=("iti", "mu "), named=True)))
    receiver = F.when(matches(line, _TOOK), _person(grab(_TOOK), "receiver")).when(has(line, "szu ba-ti") & later & ~has(prev, "ki ", "giri3", "maszkim", "iti ", "mu "), _titled(strip(prev), "receiver", cut="out"))
    seized = r"^(.+?)\s+i3-dab5"
    blocked = ("ki ", "giri3", "maszkim", "iti ", "mu ", "ba-zi", "szu ba-ti", "ba-usz2", "ba-ug7")
    taker = F.when(matches(line, seized), bind(grab(seized), lambda n: _titled(n, "receiver"))).when(matches(line, _SEIZED_ALONE) & later & ~has(prev, *blocked), _titled(strip(prev), "receiver"))
    after = lambda pattern, role, **how: F.when(matches(line, pattern), bind(grab(pattern), lambda n: _titled(n, role, **how)))
    mukux = r"mu-kux(?:\(DU\))?\s+(.+)"
    deliverer = F.when(matches(line, mukux), bind(grab(mukux), lambda n: F.when(starts(n, "lugal", "iti", "mu "), none).otherwise(_titled(n, "deliverer"))))
    governor = r"^bala\s+ensi2\s+(.+)"
    spent = lambda rest: F.when(matches(rest, governor), _person(F.concat(F.lit("governor of "), strip(found(rest, governor))), "source", F.lit("ensi2"))).otherwise(_titled(rest, "source", unless=("ki ", "iti", "mu ", "bala"), named=True))
    agent = F.when(matches(line, r"zi-ga\s+(.+)"), bind(grab(r"zi-ga\s+(.+)"), spent))
    office = r"(?U)bala\s+([\w{}-]+(?:\s+[\w{}-]+)*)\s+ensi2"
    official = F.when(matches(line, office), _person(grab(office), "source", F.lit("ensi2"), "bala-official"))
    seal = r"kiszib3\s+(.+)"
    return [source, receiver, taker, after(r"giri3\s+(.+)", "intermediary"), after(r"^(.+?)\s+maszkim", "commissioner"), F.when(matches(line, seal), _person(grab(seal), "sealer")), deliverer, agent, official]


#: A line without any of these gives no person; it skips nine rules.
_ROLE_HINTS = ("ki ", "szu ba-ti", "i3-dab5", "giri3", "maszkim", "kiszib3", "mu-kux", "zi-ga", "bala")


def _named(clean: Column, prev: Column, later: Column) -> Column:
    """The persons of a line, by the line before it where there is one."""
    some = F.filter(F.array(*(p.cast(PERSON) for p in _of_line(clean, prev, later))), lambda p: p.isNotNull())
    return F.when(has(clean, *_ROLE_HINTS), some).otherwise(F.array().cast(f"array<{PERSON}>"))


def looks_back(raw: Column) -> Column:
    """Whether the persons of a line depend on the line before: once cleaned, it starts or ends a phrase whose other half it lacks."""
    lacks = lambda c: (starts(c, "ki ") & ~matches(c, _FROM_PLACE)) | (has(c, "szu ba-ti") & ~matches(c, _TOOK)) | matches(c, _SEIZED_ALONE)
    return bind(atf.without_damage(raw), lacks)


def with_role(people: Column, *roles: str) -> Column:
    return F.filter(people, lambda p: p["role"].isin(*roles))


def offices(people: Column, *roles: str) -> Column:
    """The branches of known officials in some roles, each once, joined."""
    branches = F.transform(with_role(people, *roles), lambda p: lookup(p["name"], {n: b for n, (_, b) in L.OFFICE_OF.items()}))
    return F.array_join(F.array_distinct(F.filter(branches, lambda b: b != "")), "; ")


# --- Animals --------------------------------------------------------------

_TERM = rf"^{any_of(L.ANIMALS)}(?=[ \t]|$)"
_CARCASS = rf"^{any_of(L.CARCASS)}(?: |$)"


def _vetoed(animal: Column, rest: Column) -> Column:
    return chain(((animal == a, has(rest, *parts)) for a, parts in L.VETOES.items()), F.lit(False))


def _term_at(text: Column) -> Column:
    """The longest animal term that starts a text, '' without one or when its context vetoes it."""
    return bind(found(text, _TERM, 0), lambda a: F.when(_vetoed(a, text), "").otherwise(a))


def _qualifiers(rest: Column) -> Column:
    return bind(words(rest), lambda ws: F.filter(strings(L.QUALIFIERS), lambda t: F.array_contains(ws, t)))


def _entry(count: Column, animal: Column, qualifiers: Column, raw: Column, damaged: Column) -> Column:
    return F.struct(count.cast("long").alias("count"), animal.alias("animal"), qualifiers.alias("qualifiers"), raw.alias("raw"), damaged.alias("damaged"), F.lit(False).alias("is_imputed"), F.lit(0).cast("long").alias("imputed_count"))


def _nothing() -> Column:
    return F.array().cast(f"array<{ANIMAL}>")


def _counted(line: Column) -> Column:
    """Entries of a line with numerals: each run of signs and what follows it."""
    pattern = rf"({atf.RUN})(.?(?:(?!{atf.NUMERAL}).)*)"
    runs = F.regexp_extract_all(line["clean"], F.lit(pattern), F.lit(1))
    tails = F.regexp_extract_all(line["clean"], F.lit(pattern), F.lit(2))
    bad_numeral = matches(line["raw"], atf.DAMAGED_NUMERAL)
    after_mark = found(line["raw"], r"[\[#?](.*)$")

    def each(parts: Column) -> Column:
        def of(run: Column, i: Column) -> Column:
            later = F.when(i + 1 < F.size(parts["runs"]), F.array_join(F.transform(F.sequence(i + 1, F.size(parts["runs"]) - 1), lambda j: F.concat(F.get(parts["runs"], j), F.get(parts["tails"], j))), "")).otherwise("")
            rest = strip(F.concat(F.get(parts["tails"], i), later))

            def with_rest(r: Column) -> Column:
                dead = matches(r, _CARCASS)
                body = strip(F.regexp_replace(r, _CARCASS, ""))

                def with_body(b: Column) -> Column:
                    def with_term(a: Column) -> Column:
                        left = strip(F.substring(b, F.length(a) + 1, F.length(b)))
                        quals = F.concat(F.when(dead, F.array(F.lit("ba-usz2"))).otherwise(F.array().cast("array<string>")), _qualifiers(left))
                        entry = lambda n: _entry(n, a, quals, line["clean"], bad_numeral | (atf.has_damage(line["raw"]) & F.contains(after_mark, n.cast("string"))))
                        derived = found(left, r"(?U)^(\S*)").isin(*L.DERIVED_GOODS)
                        return F.when((a == "") | derived, F.lit(None).cast(ANIMAL)).otherwise(bind(atf.numeral(run), entry))

                    return bind(_term_at(b), with_term)

                return bind(body, with_body)

            return bind(rest, with_rest)

        return F.filter(F.transform(parts["runs"], of), lambda e: e.isNotNull())

    return bind(F.struct(runs.alias("runs"), tails.alias("tails")), each)


def _implied(line: Column) -> Column:
    """The one entry of a line that starts with an animal and has no numeral."""

    def with_term(a: Column) -> Column:
        left = strip(F.substring(line["clean"], F.length(a) + 1, F.length(line["clean"])))
        after_first = F.array_join(F.slice(words(line["clean"]), 2, 1_000_000), " ")
        header = after_first.isin(*L.SECTION_HEADERS) | line["clean"].isin(*L.SECTION_HEADERS) | left.isin(*L.SECTION_HEADERS)
        return F.when((a == "") | header, _nothing()).otherwise(F.array(_entry(F.lit(1), a, _qualifiers(left), line["clean"], atf.has_damage(line["raw"]))))

    return bind(_term_at(line["clean"]), with_term)


def _broken(line: Column) -> Column:
    """Entries whose numeral is lost: [x] before an animal."""
    pieces = F.split(line["raw"], r"(?U)\[x\]\s+")

    def of(p: Column) -> Column:
        def at(k: Column) -> Column:
            rest = atf.without_damage(F.array_join(F.slice(p, k + 1, F.size(p)), "[x] "))
            return bind(rest, lambda r: bind(_term_at(r), lambda a: F.when(a == "", F.lit(None).cast(ANIMAL)).otherwise(_entry(F.lit(1), a, _qualifiers(F.substring(r, F.length(a) + 1, F.length(r))), strip(line["raw"]), F.lit(True)))))

        return F.filter(F.transform(F.sequence(F.lit(1), F.size(p) - 1), at), lambda e: e.isNotNull())

    return F.when(matches(line["raw"], r"(?U)\[x\]\s+") & ~atf.is_summary(line["clean"]), bind(pieces, of)).otherwise(_nothing())


def animals(lines: Column) -> Column:
    """entries, has_summary and has_sza3_bi_ta of a tablet's lines."""
    categories, grand = F.exists(lines, lambda x: x["category"]), F.exists(lines, lambda x: x["grand"])

    def with_kind(kind: Column) -> Column:
        used = lambda x: F.when(kind == 2, x["category"]).when(kind == 1, x["grand"]).otherwise(True) & (x["counted"] | (kind == 0))
        main = F.flatten(F.transform(F.filter(lines, used), lambda x: x["entries"]))
        return F.struct(F.concat(main, F.flatten(F.transform(lines, lambda x: x["broken"]))).alias("entries"), (kind > 0).alias("has_summary"), F.exists(lines, lambda x: x["sza3"]).alias("has_sza3"))

    return bind(F.when(categories, 2).when(grand, 1).otherwise(0), with_kind)


# --- Date, destination, recipients ----------------------------------------


def month_in(clean: Column) -> Column:
    candidate = strip(found(clean, r"iti\s+(.+?)(?:\s*$)"))
    return bind(candidate, lambda c: F.when(starts(c, "u4"), "").otherwise(strip(F.regexp_replace(c, r"\s+ba-zal.*$", ""))))


def day_in(clean: Column) -> Column:
    patterns = [r"(?U)u4\s+([\d()\w\s]+?)(?:-kam|\s+ba-zal|\s+ba-ra-zal)", r"(?U)iti-ta\s+u4\s+([\d()\w\s]+?)\s+ba-ra-zal", r"(?U)iti\s+u4\s+([\d()\w\s]+?)ba-zal"]
    return F.when(has(clean, "u4"), F.coalesce(*(bind(atf.numeral(found(clean, p)), lambda n: F.when(n > 0, n)) for p in patterns)))


def destination_in(clean: Column) -> Column:
    """destination and category that a line names, null if none."""
    pair = lambda d, c: F.struct(d.alias("destination"), c.alias("category"))
    category = lambda d: lookup(d, L.DESTINATION_CATEGORY)
    to = found(clean, r"(?U)([\w{}-]+)-sze3")
    inside = found(clean, r"(?U)sza3\s+([\w{}-]+)")
    entered = found(clean, r"(?U)([\w{}-]+)\s+ba-an-kux")
    kind = lambda d: F.when(category(d) != "", category(d)).otherwise(category(F.regexp_replace(d, "-la$", "")))
    return F.coalesce(
        bind(to, lambda d: F.when(d != "", pair(F.concat(d, F.lit("-sze3")), category(d)))),
        bind(inside, lambda d: F.when(category(d) != "", pair(F.concat(F.lit("sza3 "), d), category(d)))),
        bind(entered, lambda d: F.when(kind(d) != "", pair(F.concat(d, F.lit(" ba-an-kux")), kind(d)))),
    )


def first_of(lines: Column, field: str, none: Column) -> Column:
    """The first value of a field that some line has."""
    return F.coalesce(first(F.filter(F.transform(lines, lambda x: x[field]), lambda v: v.isNotNull())), none)


_SUFFIXED = r"(?:-(?:sze3|ra|ke4|kam|ta|me|e-ne))?(?=[ \t]|$)"
_NOT_OFFERING = ("ki ", "giri3 ", "kiszib3", "mu-kux", "maszkim", "szu ba-ti", "i3-dab5", "ba-zi", "ba-an-zi", "zi-ga")


def deities_alone(clean: Column) -> Column:
    """Deities that stand alone in a line of offering, in order of the list."""
    offering = ~has(clean, *_NOT_OFFERING) & ~matches(clean, r"^(mu|iti)\s+") & matches(clean, any_of(L.DEITIES))
    alone = lambda d: F.regexp_like(clean, F.concat(F.lit(r"(?:^|[ \t]|ezem-|e2-|sza3-)\Q"), d, F.lit(r"\E" + _SUFFIXED)))
    return F.when(offering, F.filter(strings(L.DEITIES), alone)).otherwise(F.array().cast("array<string>"))


def divine_recipients(lines: Column, people: Column) -> Column:
    """Deities of all lines in order of line, then list, each once; none that is a person's name."""
    names = F.transform(people, lambda p: p["name"])
    return F.array_distinct(F.filter(F.flatten(F.transform(lines, lambda x: x["deities"])), lambda d: ~F.array_contains(names, d)))


# --- Lines ----------------------------------------------------------------


def line_facts(line: Column, prev: Column, later: Column, with_signs: bool = False) -> Column:
    """All that a content line (raw, clean) says, by the clean line before it; its signs too, if asked for."""
    raw, clean = line["raw"], line["clean"]
    counted = matches(clean, atf.NUMERAL)
    absent = lambda c: bind(c, lambda v: F.when(v != "", v))
    return F.struct(
        raw.alias("raw"), clean.alias("clean"), keyword(clean).alias("keyword"), matches(raw, r"mu-\[kux|mu-\[DU").alias("marked"), _named(clean, prev, later).alias("persons"),
        atf.is_category_total(clean).alias("category"), atf.is_grand_total(clean).alias("grand"), has(clean, "sza3-bi-ta").alias("sza3"),
        counted.alias("counted"), F.when(counted, _counted(line)).otherwise(_implied(line)).alias("entries"), _broken(line).alias("broken"),
        absent(month_in(clean)).alias("month"), day_in(clean).cast("string").alias("day"), F.when(matches(clean, r"^mu\s+"), clean).alias("year"),
        destination_in(clean).alias("destination"), deities_alone(clean).alias("deities"), *([atf.line_damage(raw).alias("signs")] if with_signs else []),
    )


def _cleaned(raw: Column) -> Column:
    return F.struct(raw.alias("raw"), atf.without_damage(raw).alias("clean"))


# --- Whole tablets --------------------------------------------------------


def _imputed(entries: Column, has_summary: Column, edge: Column) -> Column:
    """status, resolved, method, target, entries: one lost count follows from the scribe's own total."""
    damaged = F.size(F.filter(entries, lambda a: a["damaged"]))
    certain = total(F.filter(entries, lambda a: ~a["damaged"]), lambda a: a["count"])
    all_ = total(entries, lambda a: a["count"])

    def judged(c: Column) -> Column:
        solved = (damaged == 1) & ~has_summary & (edge > 0) & (c["inferred"] >= 1)
        fill = F.transform(entries, lambda a: F.when(a["damaged"] & solved, F.struct(*(a[k].alias(k) for k in ("count", "animal", "qualifiers", "raw", "damaged")), F.lit(True).alias("is_imputed"), c["inferred"].alias("imputed_count"))).otherwise(a))
        return F.struct(
            F.when(damaged == 0, "complete").when(solved, "imputed").otherwise("incomplete").alias("status"),
            F.when(damaged == 0, all_).when(solved, edge).otherwise(F.lit(0)).cast("long").alias("resolved"),
            F.when(solved, "edge_total").otherwise("").alias("method"),
            F.when(solved, first(F.filter(entries, lambda a: a["damaged"]))["animal"]).otherwise("").alias("target"),
            fill.alias("entries"),
        )

    return bind(F.struct((edge - certain).alias("inferred")), judged)


def extract(tablets: DataFrame, date_column: str = "date_of_origin") -> DataFrame:
    """One row of facts per row of tablets (id_text, designation, transliteration and a date code), worked out within the row.

    Columns of tablets other than the text and lines stay in front.
    """
    given = with_defaults(tablets)
    given = given.withColumn("transliteration", strip(F.col("transliteration")))
    cut = given.select("*", atf.sections(atf.stripped_lines(F.col("transliteration"))).alias("_cut"))
    cut = cut.withColumn("_lines", F.transform("_cut.content", lambda x: _cleaned(x["raw"])))
    facts = F.transform("_lines", lambda x, i: line_facts(x, F.when(i > 0, F.get("_lines", i - 1)["clean"]).otherwise(""), i > 0))
    numbered = F.transform(F.filter("_cut.content", lambda x: x["numbered"]), lambda x: x["raw"])
    parts = cut.select(
        *given.columns, facts.alias("_facts"), F.transform(F.concat(numbered, F.col("_cut.other")), atf.line_damage).alias("_signs"),
        F.transform("_cut.edge", atf.line_number_value).alias("_edge"), F.col("_cut.n_notes").alias("_notes"),
    )
    return _assembled(parts, given.columns, date_column)


#: Hot are the most frequent lines, at most as many as the inverse of this.
HOT = 1 / 20_000
#: Hot lines of more characters are worked out in the row, like rare ones; so what goes to every task is bounded.
LONGEST_HOT = 1_000


def most_frequent(counted: DataFrame) -> DataFrame:
    """The hot rows of a table with counts n: those met twice or more, at most 1 / HOT of them."""
    return counted.where("n > 1").orderBy(F.desc("n")).limit(int(1 / HOT))


def line_table(lines: DataFrame) -> DataFrame:
    """n of each distinct row of lines: kind (c content, o other, e edge), raw, prev, later.

    id addresses a row by content: a digest of the four.
    """
    return lines.groupBy("kind", "raw", "prev", "later").agg(F.count(F.lit(1)).alias("n")).withColumn("id", _line_id())


def _line_id() -> Column:
    return F.unhex(F.md5(F.concat("kind", F.col("later").cast("string"), F.octet_length("raw").cast("string"), F.lit(":"), F.col("raw"), F.coalesce(F.concat(F.lit("<"), F.col("prev")), F.lit("")))))


def _said(raw: Column, prev: Column, later: Column) -> Column:
    """line_facts() and signs of a content line by its neighbour, each part evaluated once."""
    before = F.when(prev.isNull(), "").otherwise(atf.without_damage(prev))
    return bind(F.struct(_cleaned(raw).alias("line"), before.alias("before")), lambda x: line_facts(x["line"], x["before"], later, with_signs=True))


def extract_tablets(tablets: DataFrame, date_column: str = "date_of_origin") -> DataFrame:
    """What extract() gives, over a table of distinct lines; the order of rows is free.

    Texts are stored, cut into lines, and their distinct lines counted. What the hot ones say (the most frequent, 1 / HOT rows at
    most) is worked out once, by rows, and goes to every task as one value; a line is found there by its hash.
    All others are worked out where they stand. So no line leaves its text, and what is shuffled is a count of each task's distinct lines.
    """
    given = with_defaults(tablets)
    columns = given.columns
    given = given.withColumn("transliteration", strip(F.col("transliteration"))).select(F.struct(*columns).alias("given"))
    cut = given.select("given", atf.sections(atf.stripped_lines(F.col("given.transliteration"))).alias("cut"))
    back = F.transform("cut.content", lambda x, i: (i > 0) & looks_back(x["raw"]))
    content = F.transform(F.arrays_zip(F.col("cut.content").alias("x"), F.col("back").alias("later")), lambda z: F.struct(
        z["x"]["raw"].alias("raw"), z["later"].alias("later"), z["x"]["numbered"].alias("numbered")))
    texts = stored(cut.withColumn("back", back).select("given", content.alias("content"), "cut.other", "cut.edge", "cut.n_notes"), "texts")
    # The line before is found by its place: it is not stored a second time.
    texts = texts.withColumn("content", F.transform("content", lambda x, i: F.struct(x["raw"].alias("raw"), F.when(x["later"], F.get("content", i - 1)["raw"]).alias("prev"), x["later"].alias("later"), x["numbered"].alias("numbered"))))

    row = lambda kind, raw, prev, later: F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), prev.alias("prev"), later.alias("later"))
    plain = lambda c, kind: F.transform(c, lambda x: row(kind, x, F.lit(None).cast("string"), F.lit(False)))
    lines = texts.select(F.inline(F.concat(F.transform("content", lambda x: row("c", x["raw"], x["prev"], x["later"])), plain("other", "o"), plain("edge", "e"))))
    counted = stored(line_table(lines), "lines")
    hot = most_frequent(counted.where((F.col("kind") == "c") & (F.length("raw") + F.coalesce(F.length("prev"), F.lit(0)) <= LONGEST_HOT)).select("raw", "prev", "later", "n")).drop("n")
    # Few bytes may be much work: deal them out by number, which adaptive execution leaves alone.
    hot = hot.repartition(max(int(tablets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "raw", "prev", "later")
    before = F.when(F.col("prev").isNull(), "").otherwise(atf.without_damage(F.col("prev")))
    hot = hot.withColumns({"line": _cleaned(F.col("raw")), "before": before})
    hot = hot.select("raw", "prev", "later", line_facts(F.col("line"), F.col("before"), F.col("later"), with_signs=True).alias("facts"))
    known = shared_table(stored(hot, "hot-lines"), "raw", "prev", "later")

    # Every transform copies what it gives: facts go through one.
    met = F.transform("content", lambda x: F.coalesce(known(x["raw"], x["prev"], x["later"])["facts"], _said(x["raw"], x["prev"], x["later"])))
    whole = texts.select("given", met.alias("_facts"), F.transform("content", lambda x: x["numbered"]).alias("numbered"), "other", "edge", "n_notes")
    signs = F.transform(F.filter(F.transform("numbered", lambda x, i: F.when(x, i)), lambda i: i.isNotNull()), lambda i: F.get("_facts", i)["signs"])
    parts = whole.select(
        "given.*", "_facts", F.concat(signs, F.transform("other", atf.line_damage)).alias("_signs"),
        F.transform("edge", atf.line_number_value).alias("_edge"), F.col("n_notes").alias("_notes"),
    )
    return _assembled(parts, columns, date_column)


def _assembled(parts: DataFrame, given: list[str], date_column: str) -> DataFrame:
    """The row of facts from the lines': _facts, _signs (of numbered lines), _edge (values of the first left edge), _notes."""
    none = F.size("_facts") == 0
    facts = F.col("_facts")
    none_named = F.struct(F.lit("").alias("destination"), F.lit("").alias("category"))
    parts = parts.select(
        *given, F.transform(facts, lambda x: F.struct(x["raw"].alias("raw"), x["clean"].alias("clean"))).alias("lines"),
        transaction_type(facts).alias("transaction_type"), F.flatten(F.transform(facts, lambda x: x["persons"])).alias("persons"), animals(facts).alias("_animals"),
        F.when(none, F.lit(0).cast("long")).otherwise(F.coalesce(first(F.filter("_edge", lambda v: v > 0)), F.lit(0).cast("long"))).alias("edge_total"),
        first_of(facts, "month", F.lit("")).alias("month_name"), first_of(facts, "day", F.lit("")).alias("day"), first_of(facts, "year", F.lit("")).alias("year_name"), first_of(facts, "destination", none_named).alias("_destination"),
        F.when(none, atf_empty_damage()).otherwise(atf.damage_report(F.col("_signs"), F.col("_notes"))).alias("damage"),
        atf.date_code(F.col(date_column)).alias("_date"), (F.col("transliteration") != "").alias("has_transliteration"), "_facts",
    )
    more = parts.select(
        "*", _imputed(F.col("_animals.entries"), F.col("_animals.has_summary"), F.col("edge_total")).alias("_fill"),
        divine_recipients(F.col("_facts"), F.col("persons")).alias("divine_recipients"),
        offices(F.col("persons"), "source", "deliverer").alias("source_office"), offices(F.col("persons"), "receiver", "sealer").alias("receiver_office"),
    )
    entries = F.col("_animals.entries")
    sum_of = lambda keep: total(F.filter(entries, keep), lambda a: a["count"])
    all_, uncertain = total(entries, lambda a: a["count"]), sum_of(lambda a: a["damaged"])
    dated = (F.col("month_name") != "") | (F.col("year_name") != "")
    score = atf.score_label(F.col("has_transliteration"), F.col("transaction_type"), F.size("persons"), F.size(entries), dated, F.col("damage.preservation"), uncertain, all_)
    columns = [
        *(F.col(c) for c in given), F.col("id_text").alias("tablet_id"), F.col("lines"), F.col("transaction_type"), F.col("persons"), F.col("_fill.entries").alias("animals"),
        all_.alias("total_animals"), sum_of(lambda a: ~a["damaged"]).alias("total_animals_certain"), uncertain.alias("total_animals_uncertain"),
        F.col("edge_total"), F.col("_animals.has_summary").alias("has_summary_line"), F.col("_animals.has_sza3").alias("has_sza3_bi_ta"),
        F.col("month_name"), F.col("_date.ruler").alias("ruler"), F.col("_date.regnal_year").alias("regnal_year"),
        F.when(F.col("_date.month_number") != 0, F.col("_date.month_number")).otherwise(lookup(F.col("month_name"), L.MONTHS, 0)).cast("long").alias("month_number"),
        F.col("day"), F.col("year_name"), F.col("_destination.destination").alias("destination"), F.col("_destination.category").alias("destination_category"),
        F.col("divine_recipients"), F.col("source_office"), F.col("receiver_office"), F.col("damage"),
        F.col("_fill.resolved").alias("total_animals_resolved"), F.col("_fill.status").alias("total_animals_status"), F.col("_fill.method").alias("imputation_method"), F.col("_fill.target").alias("imputation_target"),
        F.col("has_transliteration"), score.alias("extraction_score"),
    ]
    # A generator is a wall that no filter passes: pushed below, it would repeat whole extractors in its condition.
    return more.select(F.inline_outer(F.array(F.struct(*columns))))


def atf_empty_damage() -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("total_signs"), zero.alias("damaged_signs"), zero.alias("broken_signs"), zero.alias("missing_lines"), F.lit(1.0).alias("preservation"))


def person_facts(extracted: DataFrame) -> DataFrame:
    """One row per person: tablet_id, seq and the person's fields."""
    return extracted.select("tablet_id", F.posexplode("persons").alias("seq", "p")).select("tablet_id", "seq", "p.*")


def animal_facts(extracted: DataFrame) -> DataFrame:
    """One row per animal entry: tablet_id, seq and the entry's fields."""
    return extracted.select("tablet_id", F.posexplode("animals").alias("seq", "a")).select("tablet_id", "seq", "a.*")
