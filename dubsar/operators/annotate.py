"""Token-level annotation of tablets: sections, roles, translations, line types, links, summaries.

Lines and tokens are arrays inside the tablet's row; a token's role is one ordered
choice over its own text, its line and the tablet's persons. Dictionary and glossary
are maps on one broadcast row, or absent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubsar.functions import atf
from dubsar.functions import lexicon as L
from dubsar.functions.columns import bind, chain, first, found, has, last, lookup, matches, q, starts, strip, words
from dubsar.operators import extract
from dubsar.operators.names import without_suffix
from dubsar.sources.scratch import shared_table, stored

_SKIP = "skip"


def lines_of(text: Column) -> Column:
    """section, kind (structural, metadata, damage_note, ruling, content), raw, number, body of every annotated line."""

    def step(acc: Column, head: Column) -> Column:
        low = head["low"]
        section = F.when(has(low, "obverse"), "obverse").when(has(low, "reverse"), "reverse").when(has(low, "left"), "left_edge").when(has(low, "seal"), "seal").when(acc["seal"], F.replace(low, F.lit("@"), F.lit(""))).otherwise(acc["section"])
        seal = F.when(has(low, "obverse", "reverse", "left"), acc["seal"]).otherwise(has(low, "seal"))
        return bind(section, lambda s: F.struct(s.alias("section"), seal.alias("seal"), F.concat(acc["out"], F.array(F.struct(head["at"].alias("at"), s.alias("section")))).alias("out")))

    start = F.struct(F.lit("obverse").alias("section"), F.lit(False).alias("seal"), F.array().cast("array<struct<at:int,section:string>>").alias("out"))

    def of(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.when(starts(x, "@"), F.struct(i.alias("at"), F.lower(x).alias("low")))), lambda h: h.isNotNull())
        return bind(F.aggregate(heads, start, step, lambda acc: acc["out"]), lambda sections: F.filter(F.transform(lines, lambda x, i: row(x, i, sections)), lambda r: r.isNotNull()))

    def row(line: Column, i: Column, sections: Column) -> Column:
        kind = F.when(matches(line, r"(?U)^(?:\d+[.']|\.\s+)"), "content").when(starts(line, "@"), "structural").when(starts(line, "#", "&"), "metadata").when(starts(line, "$"), F.when(has(F.lower(line), *atf.BROKEN_WORDS), "damage_note").otherwise("ruling")).otherwise(_SKIP)

        def of_kind(k: Column) -> Column:
            # A line belongs to the last head up to it.
            section = F.coalesce(last(F.filter(sections, lambda s: s["at"] <= i))["section"], F.lit("obverse"))
            number = F.when(k == "content", found(line, r"(?U)^(\d+[.'])")).otherwise("")
            body = F.when(k == "content", F.regexp_replace(line, r"(?U)^(?:\d+[.']\s*|\.\s+)", "")).otherwise("")
            return F.when(k != _SKIP, F.struct(section.alias("section"), k.alias("kind"), line.alias("raw"), number.alias("number"), body.alias("body")))

        return bind(kind, of_kind)

    return bind(atf.raw_lines(F.coalesce(text, F.lit(""))), of)


def _known_prefix(prefix: Column, names: Column, dictionary: Column | None) -> Column:
    known = F.array_contains(names, prefix) | prefix.isin([n.lower() for n in L.OFFICE_OF]) | prefix.isin(*L.STRUCTURAL) | prefix.isin(*L.PLACES) | (F.length(prefix) > 3)
    return known if dictionary is None else known | _entry(dictionary, prefix).isNotNull()


def _entry(table: Column, key: Column) -> Column:
    """Dictionary entry of a token: as it is, else without a case suffix."""
    return F.coalesce(table[key], table[without_suffix(key, L.CASE_SUFFIXES)])


def split_tokens(body: Column, names: Column, dictionary: Column | None = None) -> Column:
    """text and low of each token, with -ta and -sze3 apart from a known or long prefix."""

    def cut(token: Column) -> Column:
        def with_low(low: Column) -> Column:
            whole = F.array(F.struct(token.alias("text"), low.alias("low")))
            suffix = F.when(F.endswith(low, F.lit("-ta")) & (low != "-ta"), "-ta").when(F.endswith(low, F.lit("-sze3")) & (low != "-sze3"), "-sze3").otherwise("")
            prefix = F.left(low, F.length(low) - F.length(suffix))
            at = F.length(F.substring_index(token, "-", -1)) + 1
            left, right = F.left(token, F.length(token) - at), F.rtrim(F.right(token, at), F.lit("]"))
            left = F.when(F.length(F.regexp_replace(left, r"[^\[]", "")) > F.length(F.regexp_replace(left, r"[^\]]", "")), F.concat(left, F.lit("]"))).otherwise(left)
            two = F.array(*(F.struct(t.alias("text"), F.lower(atf.without_damage(t)).alias("low")) for t in (left, right)))
            splits = (suffix != "") & ~atf.normal_mukux(low).isin(*L.TX_KEYWORDS) & _known_prefix(prefix, names, dictionary) & has(token, "-")
            return F.when(splits, two).otherwise(whole)

        return bind(F.lower(atf.without_damage(token)), with_low)

    return F.flatten(F.transform(words(body), cut))


_YEAR_STARTS = ("us2-sa", "ma2-", "{d}", "en-", "si-", "ha-", "a-ra2")
_LOW_ANIMALS = {a: en for a, en in L.ANIMALS.items() if a == a.lower()}
_LOW_OFFICIALS = {n.lower(): branch for n, (_, branch) in L.OFFICE_OF.items()}


_OFFICIAL_START = "^(" + "|".join(q(o) for o in _LOW_OFFICIALS if len(o) > 3) + ")-"


def _year_line(low: Column) -> Column:
    rest = F.substring(low, F.lit(4), F.length(low))
    return starts(rest, *_YEAR_STARTS) | has(rest, "-ki ", "ba-hul", "ba-ab-du8") | (F.size(words(low)) >= 5)


def _rolled(tokens: Column, line_low: Column, names: Column, people: Column, animal_line: Column, dictionary: Column | None, glossary: Column | None) -> Column:
    """role and detail of each token."""
    detail_of = lambda n: F.coalesce(_of_person(people, n, "en"), F.lit(""))
    pair = lambda role, detail: F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    year_at_start = (F.get(tokens, F.lit(0))["low"] == "mu") & _year_line(line_low)

    def role(t: Column, i: Column) -> Column:
        low = t["low"]
        tx = atf.normal_mukux(low)
        after = F.when(i > 0, F.get(tokens, i - 1)["low"]).otherwise("")
        ahead = F.coalesce(F.get(tokens, i + 1)["low"], F.lit(""))
        own = first(F.filter(names, lambda n: (F.length(n) > 3) & F.startswith(low, n)))
        part = first(F.filter(names, lambda n: F.contains(line_low, n) & F.array_contains(F.split(n, "-"), low)))
        official = found(low, _OFFICIAL_START)
        entry = None if dictionary is None else _entry(dictionary, low)
        named = lambda pos: F.lit(False) if entry is None else F.coalesce(entry["pos"].isin(*pos), F.lit(False))
        canonical = F.lit("") if entry is None else entry["canonical"]
        meaning = F.lit(None).cast("string") if glossary is None else glossary[low]
        return chain(
            [
                ((low == "ba-ti") & (after == "szu"), pair("transaction", L.TX_KEYWORDS["szu ba-ti"])),
                (matches(low, "^" + atf.NUMERAL), pair("numeral", atf.numeral(low).cast("string"))),
                (low == "la2", pair("numeral", "minus")),
                (low.isin(*_LOW_ANIMALS), pair("animal", lookup(low, _LOW_ANIMALS))),
                (low.isin(*L.TOKEN_QUALIFIERS), pair("qualifier", lookup(low, L.TOKEN_QUALIFIERS))),
                ((low == "szu") & (ahead == "ba-ti"), pair("transaction", L.TX_KEYWORDS["szu ba-ti"])),
                (tx.isin(*(k for k in L.TX_KEYWORDS if " " not in k)), pair("transaction", lookup(tx, L.TX_KEYWORDS))),
                (low.isin(*L.STRUCTURAL), pair("structural_keyword", lookup(low, L.STRUCTURAL))),
                ((low == "mu") & (i == 0), F.when(_year_line(line_low), pair("structural_keyword", "year_marker")).otherwise(pair("text", ""))),
                (low.isin(*L.MONTHS), pair("month", F.concat(F.lit("month "), lookup(low, L.MONTHS, 0).cast("string")))),
                (low.isin(*L.TEMPLES), pair("structural_keyword", F.concat(F.lit("temple: "), lookup(low, L.TEMPLES)))),
                (F.array_contains(names, low), pair("person", detail_of(low))),
                (own.isNotNull(), pair("person", F.concat(detail_of(own), F.lit(" ("), own, F.lit(")")))),
                (part.isNotNull(), pair("person_part", F.concat(F.lit("part of "), part))),
                (low.isin(*_LOW_OFFICIALS), pair("person", F.concat(F.lit("official ("), lookup(low, _LOW_OFFICIALS), F.lit(")")))),
                (official != "", pair("person", F.concat(F.lit("official ("), lookup(official, _LOW_OFFICIALS), F.lit(", "), official, F.lit(")")))),
                (has(t["text"], "{d}"), chain([(named(("PN",)), pair("person", canonical)), (starts(line_low, "mu ") & year_at_start, pair("year_text", "year name element"))], pair("deity", "divine name"))),
                (low.isin(*L.MEASURES), F.when((low == "ga") & animal_line, pair("qualifier", "suckling")).otherwise(pair("measure", "non-animal commodity"))),
                (low.isin(*L.ROLE_MARKERS), pair("role_marker", lookup(low, L.ROLE_MARKERS))),
                (low.isin(*L.TITLES), pair("title", low)),
                (has(low, "szu-nigin", "szunigin"), pair("summary_marker", "grand total")),
                (low.isin(*L.PLACES), pair("structural_keyword", F.concat(F.lit("destination: "), lookup(low, L.PLACES)))),
                (has(low, "{ki}"), pair("structural_keyword", F.concat(F.lit("place: "), F.replace(low, F.lit("{ki}"), F.lit(""))))),
                (t["text"].isin("x", "...") | matches(t["text"], r"^\[|\]$"), pair("damage", "broken/illegible")),
                (named(("PN",)), pair("person", canonical)),
                (named(("DN",)), pair("deity", canonical)),
                (named(("GN", "SN")), pair("structural_keyword", F.concat(F.lit("place: "), canonical))),
                (meaning.isNotNull(), pair("glossary_term", meaning)),
            ],
            pair("text", ""),
        )

    return F.transform(tokens, role)


def translation(low: Column, role: Column, language: str) -> Column:
    """What the glosses, the numeral or the role make of a token; language en or nl."""
    k = 0 if language == "en" else 1
    gloss = lookup(low, {t: v[k] for t, v in L.GLOSS.items()})
    god = F.concat(F.lit("god "), F.replace(F.replace(F.replace(low, F.lit("{d}"), F.lit("")), F.lit("{"), F.lit("")), F.lit("}"), F.lit("")))
    broken = "damaged/illegible" if language == "en" else "beschadigd/onleesbaar"
    return F.when(low.isin(*L.GLOSS), gloss).when(role == "numeral", atf.numeral(low).cast("string")).when(role == "deity", god).when(role == "damage", broken).otherwise("")


def line_type(low: Column, has_year_marker: Column) -> Column:
    return F.when(has(low, "szu-nigin", "szunigin"), "summary").when(has(low, "iti "), "date").when(starts(low, "mu ", "mu-"), F.when(has_year_marker, "year").otherwise("content")).when(has(low, *L.TX_KEYWORDS), "transaction").when(has(low, "ki ", "giri3 ", "maszkim ", "kiszib3 "), "person_role").otherwise("content")


def _role_detail(p: Column, language: str) -> Column:
    """A person's role and title in words."""
    k = 0 if language == "en" else 1
    named = lambda c, table: F.when(c.isin(*table), lookup(c, {t: v[k] for t, v in table.items()})).otherwise(c)
    return F.concat(named(p["role"], L.GLOSS), F.when(p["title"] != "", F.concat(F.lit(" ("), named(p["title"], L.GLOSS), F.lit(")"))).otherwise(""))


def _of_person(people: Column, name: Column, language: str) -> Column:
    return first(F.filter(people, lambda p: p["name"] == name))[language]


def _known_people(people: Column) -> Column:
    """name (in small letters), en and nl of each person; of one name the last role counts."""
    row = lambda p: F.struct(strip(F.lower(p["name"])).alias("name"), p["role"].alias("role"), p["title"].alias("title"))
    of = lambda p: F.struct(p["name"].alias("name"), _role_detail(p, "en").alias("en"), _role_detail(p, "nl").alias("nl"))
    return bind(F.transform(people, row), lambda rows: F.transform(F.array_distinct(F.transform(rows, lambda p: p["name"])), lambda n: bind(last(F.filter(rows, lambda p: p["name"] == n)), of)))


_TOLD = "struct<type:string,tokens:array<struct<text:string,role:string,detail:string,en:string,nl:string,damaged:boolean>>,links:array<struct<target:string,value:string,detail:string>>>"
#: Words in brackets from end to end: no cut at a hyphen parts them.
_BRACKETED = r"(?<![^ ])\[[^\[\]\s-]*\](?![^ ])"
#: A line without any of these, bracketed words apart, is whole: what its tokens say in small letters, cleaned, stands in the line in small letters, cleaned.
_UNEVEN = r"(?U)[<\[\]Σ]|\s\s|[\s&&[^ ]]|^ | $"


def _token(text: Column, role: Column, en: Column | str = "", nl: Column | str = "") -> Column:
    """A token of which no more than this is told."""
    return F.struct(text.alias("text"), role.alias("role"), F.lit("").alias("detail"), F.lit(en).alias("en") if isinstance(en, str) else en.alias("en"), F.lit(nl).alias("nl") if isinstance(nl, str) else nl.alias("nl"), F.lit(False).alias("damaged"))


def _told(x: Column, dictionary: Column | None, meanings: Column | None) -> Column:
    """type, tokens and links of a line (its number and links to animals apart): kind, raw, body, low, people, animal_line."""
    note = x["kind"] == "damage_note"
    whole = _token(x["raw"], F.when(x["kind"] == "structural", "section_header").otherwise(x["kind"]), F.when(note, "broken/missing").otherwise(""), F.when(note, "gebroken/ontbrekend").otherwise(""))
    other = F.struct(F.when(x["kind"] == "metadata", "metadata").otherwise("structural").alias("type"), F.array(whole).alias("tokens"), F.array().cast("array<struct<target:string,value:string,detail:string>>").alias("links")).cast(_TOLD)
    return F.when(x["kind"] == "content", _told_content(x, dictionary, meanings)).otherwise(other)


def _told_content(x: Column, dictionary: Column | None, meanings: Column | None) -> Column:
    """What _told() gives of a content line: body, low, people, animal_line."""
    people = x["people"]
    link = lambda target, value, extra: F.struct(F.lit(target).alias("target"), value.alias("value"), extra.alias("detail"))

    def token(t: Column, r: Column) -> Column:
        who = first(F.filter(people, lambda p: F.contains(t["low"], p["name"]) & (p["name"] != "")))
        as_person = lambda lang: F.when((r["role"] == "person") & who.isNotNull(), who[lang])
        en = F.coalesce(as_person("en"), translation(t["low"], r["role"], "en"))
        nl = F.coalesce(as_person("nl"), translation(t["low"], r["role"], "nl"))
        return F.struct(t["text"].alias("text"), r["role"].alias("role"), r["detail"].alias("detail"), F.when(en == "", r["detail"]).otherwise(en).alias("en"), nl.alias("nl"), has(t["text"], "[", "]", "#", "?").alias("damaged"))

    def of_content(tokens: Column, roles: Column) -> Column:
        toks = F.transform(F.arrays_zip(tokens.alias("t"), roles.alias("r")), lambda z: token(z["t"], z["r"]))
        marked = F.exists(roles, lambda r: (r["role"] == "structural_keyword") & (r["detail"] == "year_marker"))
        folk = F.transform(F.filter(people, lambda p: F.contains(x["low"], p["name"])), lambda p: link("persons", p["name"], F.coalesce(p["en"], F.lit(""))))
        deals = F.filter(F.array(*(F.when(has(x["low"], k), link("transaction", F.lit(v), F.lit(k))) for k, v in L.TX_KEYWORDS.items())), lambda v: v.isNotNull())
        return F.struct(line_type(x["low"], marked).alias("type"), toks.alias("tokens"), F.concat(folk, deals).alias("links")).cast(_TOLD)

    def by_names(names: Column) -> Column:
        rolled = lambda tokens: bind(_rolled(tokens, x["low"], names, people, x["animal_line"], dictionary, meanings), lambda roles: of_content(tokens, roles))
        return bind(split_tokens(x["body"], names, dictionary), rolled)

    return bind(F.transform(people, lambda p: p["name"]), by_names)


def _prepared(extracted: DataFrame) -> DataFrame:
    """tablet_id, animals and lines, each with the people that it may name and whether its animals matter; of a whole line that is what it holds."""

    def seen(x: Column, whole: Column, low: Column) -> Column:
        content = x["kind"] == "content"
        some = F.when(content & whole, F.filter("people", lambda p: F.contains(low, p["name"]))).when(content, F.col("people")).otherwise(F.slice("people", 1, 0))
        # Only a measure, ga, is another thing in a line of animals.
        beast = (~whole | F.contains(low, F.lit("ga"))) & F.exists("animals", lambda a: F.contains(low, a["animal"]))
        return F.struct(*(x[k].alias(k) for k in ("section", "kind", "raw", "number", "body")), low.alias("low"), some.alias("people"), F.coalesce(beast, F.lit(False)).alias("animal_line"))

    line = lambda x: bind(~matches(F.when(has(x["body"], "["), F.regexp_replace(x["body"], _BRACKETED, "x")).otherwise(x["body"]), _UNEVEN), lambda whole: bind(F.lower(atf.without_damage(x["body"])), lambda low: seen(x, whole, low)))
    base = extracted.select("tablet_id", _known_people(F.col("persons")).alias("people"), F.transform("animals", lambda a: F.struct(a["animal"].alias("animal"), a["raw"].alias("raw"))).alias("animals"), lines_of(F.col("transliteration")).alias("lines"))
    return base.select("tablet_id", "animals", F.transform("lines", line).alias("lines"))


def _with_lexicons(df: DataFrame, names: DataFrame | None, glossary: DataFrame | None) -> tuple[DataFrame, Column | None, Column | None]:
    dictionary, meanings = None, None
    if names is not None:
        table = names.agg(F.map_from_entries(F.collect_list(F.struct(F.replace("form", F.lit("kuₓ"), F.lit("kux")).alias("form"), F.struct("canonical", "pos").alias("e")))).alias("_names"))
        df, dictionary = df.join(F.broadcast(table)), F.col("_names")
    if glossary is not None:
        df, meanings = df.join(F.broadcast(glossary.agg(F.map_from_entries(F.collect_list(F.struct("atf", "meaning"))).alias("_meanings")))), F.col("_meanings")
    return df, dictionary, meanings


def _annotated(prepared: DataFrame, told: Callable[[Column], Column]) -> DataFrame:
    link = lambda i: F.struct(F.lit("animals").alias("target"), i.cast("string").alias("value"), F.lit("").alias("detail"))

    def finished(x: Column, lows: Column) -> Column:
        beasts = F.filter(F.transform(lows, lambda low, i: F.when((x["kind"] == "content") & (low == x["low"]), link(i))), lambda v: v.isNotNull())
        number = _token(x["number"], F.lit("line_number"))
        tokens = lambda t: F.when(x["number"] != "", F.concat(F.array(number), t["tokens"])).otherwise(t["tokens"])
        return bind(told(x), lambda t: F.struct(t["type"].alias("type"), x["section"].alias("section"), x["raw"].alias("raw"), tokens(t).alias("tokens"), F.concat(beasts, t["links"]).alias("links")))

    annotated = bind(F.transform("animals", lambda a: F.lower(atf.without_damage(a["raw"]))), lambda lows: F.transform("lines", lambda x: finished(x, lows)))
    return prepared.select(F.inline_outer(F.array(F.struct("tablet_id", annotated.alias("annotated")))))


def annotate(extracted: DataFrame, names: DataFrame | None = None, glossary: DataFrame | None = None) -> DataFrame:
    """tablet_id and annotated: an array of lines with type, section, raw, links and tokens.

    names (form, canonical, pos) and glossary (atf, meaning) are gathered into one row
    of two maps; they are lexicons of bounded size, not data.
    """
    df, dictionary, meanings = _with_lexicons(_prepared(extracted), names, glossary)
    return _annotated(df, lambda x: _told(x, dictionary, meanings))


#: What decides what is told of a content line, its number apart.
_LINE_KEY = ("body", "people", "animal_line")
#: Lines that may name more people are not shared, however frequent.
_MOST_PEOPLE = 16


def annotate_tablets(extracted: DataFrame, names: DataFrame | None = None, glossary: DataFrame | None = None) -> DataFrame:
    """What annotate() gives, for many tablets: what is told of a line that is hot (with the people it names) is worked out once.

    As in extract_tablets() that goes to all tasks as one value of at most 1 / HOT rows; other lines are worked out where they stand.
    """
    tablets = stored(_prepared(extracted), "annotating")
    lines = tablets.select(F.inline("lines")).where("kind = 'content'")
    counted = stored(lines.groupBy("body", "low", "people", "animal_line").agg(F.count(F.lit(1)).alias("n")), "told-lines")
    hot = extract.most_frequent(counted.where((F.length("body") <= extract.LONGEST_HOT) & (F.size("people") <= _MOST_PEOPLE))).drop("n")
    hot = hot.repartition(max(int(extracted.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), *_LINE_KEY)
    rows, dictionary, meanings = _with_lexicons(hot.select(*_LINE_KEY, F.struct("*").alias("x")), names, glossary)
    known = shared_table(stored(rows.select(*_LINE_KEY, _told_content(F.col("x"), dictionary, meanings).alias("told")), "told"), *_LINE_KEY)
    df, dictionary, meanings = _with_lexicons(tablets, names, glossary)
    hit = lambda x: F.when(x["kind"] == "content", known(*(x[k] for k in _LINE_KEY))["told"])
    return _annotated(df, lambda x: F.coalesce(hit(x), _told(x, dictionary, meanings)))


def line_counts(extracted: DataFrame, names: DataFrame | None = None, glossary: DataFrame | None = None) -> DataFrame:
    """type, section, numbered, tokens (the number's apart) and n of each distinct line of all tablets, as annotate() tells them.

    For counts of what lines and tokens are: each distinct line is told once, however often it stands, and no tablet is put together.
    """
    content = F.col("kind") == "content"
    # Of inline() the optimizer infers a filter on the size of the array, for which it would work out all lines once more.
    lines = _prepared(extracted).select(F.inline_outer("lines")).where("kind is not null")
    key = {"section": F.col("section"), "kind": F.col("kind"), "raw": F.when(content, "").otherwise(F.col("raw")), "numbered": F.col("number") != "", "body": F.col("body"), "low": F.col("low"), "people": F.col("people"), "animal_line": F.col("animal_line")}
    counted = lines.groupBy(*(c.alias(k) for k, c in key.items())).agg(F.count(F.lit(1)).alias("n"))
    # Few bytes may be much work: see extract_tablets().
    dealt = counted.repartition(max(int(extracted.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), *key)
    df, dictionary, meanings = _with_lexicons(dealt.select("section", "numbered", "n", F.struct(*key).alias("x")), names, glossary)
    told = df.select("section", "numbered", "n", _told(F.col("x"), dictionary, meanings).alias("told"))
    return told.select("told.type", "section", "numbered", "told.tokens", "n")


def token_table(annotated: DataFrame) -> DataFrame:
    """One row per token: tablet_id, line, type, section, seq, text, role, detail, en, nl, damaged."""
    lines = annotated.select("tablet_id", F.posexplode("annotated").alias("line", "x"))
    return lines.select("tablet_id", "line", "x.type", "x.section", F.posexplode("x.tokens").alias("seq", "t")).select("tablet_id", "line", "type", "section", "seq", "t.*")


def person_summary(p: Column, transaction: Column) -> Column:
    """name, role, title, normalized, office, bureau and why the role was given."""
    low = strip(F.lower(p["name"]))
    plain = {n.replace("-", ""): o for n, o in reversed(L.OFFICE_OF.items())}
    canonical = strip(F.lower(p["normalized_name"]))
    of = lambda k: F.when(low.isin(*L.OFFICE_OF), lookup(low, {n: o[k] for n, o in L.OFFICE_OF.items()})).when(canonical != "", lookup(canonical, {n: o[k] for n, o in plain.items()})).otherwise("")
    why = F.replace(lookup(p["role"], L.ROLE_EXPLANATIONS), F.lit("{name}"), p["name"])
    why = F.when(p["role"] == "receiver", F.replace(why, F.lit("{transaction_keyword}"), F.when(transaction == "", "?").otherwise(transaction))).otherwise(why)
    return F.struct(p["name"].alias("name"), p["role"].alias("role"), p["title"].alias("title"), p["normalized_name"].alias("normalized"), of(1).alias("office"), of(0).alias("bureau"), why.alias("explanation"))


def plain_summary(extracted: DataFrame) -> DataFrame:
    """tablet_id, en, nl: what a tablet records, in sentences."""
    tx = F.when(F.col("transaction_type") == "", "unknown transaction").otherwise(F.col("transaction_type"))
    people = F.transform("persons", lambda p: person_summary(p, F.col("transaction_type")))

    def in_words(language: str) -> Column:
        k = 0 if language == "en" else 1
        other = F.concat(F.lit("records a "), tx, F.lit(" involving")) if k == 0 else F.concat(F.lit("beschrijft een "), tx, F.lit(" van"))
        verb = F.when(tx.isin(*L.VERBS), lookup(tx, {t: v[k] for t, v in L.VERBS.items()})).otherwise(other)
        name = lambda a: bind(lookup(strip(F.lower(a["animal"])), {t: v[k] for t, v in L.GLOSS.items()}), lambda g: F.when(g == "", a["animal"]).otherwise(g))
        items = F.transform("animals", lambda a: F.concat(a["count"].cast("string"), F.lit(" "), name(a), F.when(F.size(a["qualifiers"]) > 0, F.concat(F.lit(" ("), F.array_join(a["qualifiers"], ", "), F.lit(")"))).otherwise("")))
        n = F.size("animals")
        more = F.concat(F.lit(" and " if k == 0 else " en "), (n - 5).cast("string"), F.lit(" more entries" if k == 0 else " meer"))
        some = F.concat(F.array_join(F.slice(items, 1, 5), ", "), F.when(n > 5, more).otherwise(""))
        beasts = F.when(n > 0, some).otherwise("animals (details unclear)" if k == 0 else "dieren (details onduidelijk)")
        who = lambda role: bind(first(F.filter(F.col("_people"), lambda p: p["role"] == role)), lambda p: F.concat(F.when(p["normalized"] != "", p["normalized"]).otherwise(p["name"]), F.when(p["title"] != "", F.concat(F.lit(" ("), p["title"], F.lit(")"))).otherwise(""), F.when(p["office"] != "", F.concat(F.lit(" ["), p["office"], F.lit("]"))).otherwise("")))
        say = lambda lead, c: F.concat(F.lit(lead + " "), c, F.lit("."))
        gods = F.array_join(F.transform("divine_recipients", lambda d: bind(F.replace(F.replace(F.replace(d, F.lit("{d}"), F.lit("")), F.lit("{"), F.lit("")), F.lit("}"), F.lit("")), lambda g: translation(g, F.lit("deity"), language))), ", ")
        lead = ("From", "Delivered by", "Received by", "For", "Destination:", "Dated month", ", day ") if k == 0 else ("Van", "Geleverd door", "Ontvangen door", "Voor", "Bestemming:", "Gedateerd maand", ", dag ")
        when = F.concat(F.col("month_name"), F.when(F.col("day") != "", F.concat(F.lit(lead[6]), F.col("day"))).otherwise(""))
        return F.concat_ws(
            " ", F.concat(F.lit("This tablet " if k == 0 else "Dit tablet "), verb, F.lit(" "), beasts, F.lit(".")),
            say(lead[0], who("source")), say(lead[1], who("deliverer")), say(lead[2], who("receiver")), say("Via", who("intermediary")),
            F.when(F.size("divine_recipients") > 0, say(lead[3], gods)), F.when(F.col("destination") != "", say(lead[4], F.col("destination"))), F.when(F.col("month_name") != "", say(lead[5], when)),
        )

    return extracted.withColumn("_people", people).select("tablet_id", in_words("en").alias("en"), in_words("nl").alias("nl"))


__all__ = ["annotate", "annotate_tablets", "line_counts", "token_table", "plain_summary", "person_summary", "lines_of", "split_tokens", "line_type", "translation"]
