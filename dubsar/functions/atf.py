"""Scalar functions of the text format: lines, damage, numerals, dates, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dubsar.functions import lexicon as L
from dubsar.functions.columns import bind, chain, first, found, has, lookup, matches, q, starts, strings, strip, total, whole, words

# Patterns of the text format.
_UNIT = "|".join(q(u) for u in sorted(L.UNITS, key=len, reverse=True))
NUMERAL = rf"\d+\((?:{_UNIT})\)"
RUN = rf"{NUMERAL}(?:\s+(?:la2\s+)?{NUMERAL})*"
DAMAGED_NUMERAL = rf"(?U)\[[\d()\w\s']*\d+\((?:{_UNIT})\)[\d()\w\s']*\]|\d+\((?:{_UNIT})\)[#?]"
LINE_NUMBER = r"(?U)^\d+[.']"
BROKEN_WORDS = ("broken", "missing", "traces")
LINES = "array<struct<raw:string,clean:string>>"


def without_damage(c: Column) -> Column:
    """Damage marks removed, what stands in brackets kept, blanks collapsed."""
    out = F.regexp_replace(c, "<<[^>]*>>", "")
    out = F.regexp_replace(out, "<([^>]*)>", "$1")
    out = F.regexp_replace(out, r"\[([^\]]*)\]", "$1")
    out = strip(F.regexp_replace(F.translate(out, "#?!", ""), r"(?U)\s+", " "))
    return F.when(matches(c, r"(?U)[<\[#?!]|\s\s|[\s&&[^ ]]|^ | $"), out).otherwise(c)  # most lines are whole


def has_damage(c: Column) -> Column:
    return matches(c, r"[#?\[]")


def raw_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


#: Blocks of a text whose lines are stripped: a seal up to the next surface, a left edge up to the next surface or note of an object.
SEAL_BLOCK = r"(?mds)^@seal.*?(?=^@(?!column)|\z)"
LEFT_BLOCK = r"(?mds)^@(?i:left)$.*?(?=^[@&]|\z)"
FIRST_LEFT = r"(?mds)^@(?i:left)$(.*?)(?=^(?!@(?i:left)$)[@&]|\z)"
BODY = r"(?Us)^(?:\d+[.'] *|\.\s+)(.*)$"
NUMBERED_BODY = r"(?Us)^\d+[.'] *(.*)$"


def stripped_lines(text: Column) -> Column:
    """A text with every line stripped."""
    return F.array_join(raw_lines(F.coalesce(text, F.lit(""))), "\n")


def sections(stripped: Column) -> Column:
    """content, other, edge, n_notes of a text of stripped lines.

    content: body of each content line in order and whether it has a number; other: bodies of numbered lines in
    seals and on left edges; edge: bodies of numbered lines of the first left edge; n_notes: notes of lost lines.
    """
    bodies = lambda t: F.filter(F.transform(F.split(t, "\n"), lambda x: found(x, NUMBERED_BODY)), lambda x: x != "")
    content = lambda t: F.filter(F.transform(F.split(t, "\n"), lambda x: F.struct(found(x, BODY).alias("raw"), (F.substring(x, F.lit(1), F.lit(1)) != ".").alias("numbered"))), lambda x: x["raw"] != "")
    none = F.array().cast("array<string>")
    blocks = lambda t, mark, pattern: F.when(has(t, mark), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)

    def of(t: Column) -> Column:
        def outside_seals(rest: Column) -> Column:
            low = F.lower(rest)
            apart = F.concat(blocks(t, "@seal", SEAL_BLOCK), F.when(has(low, "@left"), F.regexp_extract_all(rest, F.lit(LEFT_BLOCK), F.lit(0))).otherwise(none))
            return F.struct(
                content(F.when(has(low, "@left"), F.regexp_replace(rest, LEFT_BLOCK, "")).otherwise(rest)).alias("content"),
                F.flatten(F.transform(apart, bodies)).alias("other"),
                F.when(has(F.lower(t), "@left"), bodies(found(t, FIRST_LEFT))).otherwise(none).alias("edge"),
                F.when(has(t, "$"), F.size(F.filter(F.split(t, "\n"), lambda x: starts(x, "$") & has(F.lower(x), *BROKEN_WORDS)))).otherwise(0).cast("long").alias("n_notes"),
            )

        return bind(F.when(has(t, "@seal"), F.regexp_replace(t, SEAL_BLOCK, "")).otherwise(t), outside_seals)

    return bind(stripped, of)


def numeral_sum(c: Column) -> Column:
    """Sum of value times unit over all numeral signs of a text."""
    signs = F.regexp_extract_all(c, F.lit(NUMERAL), F.lit(0))
    value = lambda s: F.coalesce(found(s, r"^\d+", 0).try_cast("long"), F.lit(0)) * lookup(found(s, r"\((.*)\)$"), L.UNITS, 1).cast("long")
    return total(signs, value)


def numeral(c: Column) -> Column:
    """Value of a numeral; what follows the first la2 is subtracted, never below zero."""
    parts = F.split(c, r"(?U)\s+la2\s+", 2)
    return bind(parts, lambda p: F.when(F.size(p) == 2, F.greatest(F.lit(0).cast("long"), numeral_sum(F.get(p, F.lit(0))) - numeral_sum(F.get(p, F.lit(1))))).otherwise(numeral_sum(c)))


def is_category_total(clean: Column) -> Column:
    return has(clean, "szu-nigin", "szunigin")


def is_grand_total(clean: Column) -> Column:
    return has(clean, "nigin2-ba")


def is_summary(clean: Column) -> Column:
    return is_category_total(clean) | is_grand_total(clean)


def line_damage(body: Column) -> Column:
    """plain, damaged and broken signs of one line."""
    in_brackets = total(F.regexp_extract_all(body, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda b: F.greatest(F.lit(1), F.size(words(b))).cast("long"))
    outside = words(F.regexp_replace(body, r"\[[^\]]*\]", ""))
    return bind(outside, lambda o: F.struct(F.size(o).cast("long").alias("plain"), F.size(F.filter(o, lambda t: has(t, "#", "?"))).cast("long").alias("damaged"), in_brackets.alias("broken")))


def damage_report(lines: Column, n_notes: Column) -> Column:
    """total_signs, damaged_signs, broken_signs, missing_lines, preservation of a whole text, seals included, from line_damage of its numbered lines."""
    broken, damaged, plain = (total(lines, lambda x, k=k: x[k]) for k in ("broken", "damaged", "plain"))
    counts = F.struct((broken + plain).alias("total"), damaged.alias("damaged"), broken.alias("broken"), n_notes.alias("missing"))

    def done(c: Column) -> Column:
        kept = F.when(c["total"] > 0, F.greatest(F.lit(0.0), 1.0 - (c["damaged"] + c["broken"]) / c["total"])).otherwise(0.0)
        kept = kept * F.when(c["missing"] > 0, F.greatest(F.lit(0.3), 1.0 - c["missing"] * 0.15)).otherwise(1.0)
        return F.struct(c["total"].alias("total_signs"), c["damaged"].alias("damaged_signs"), c["broken"].alias("broken_signs"), c["missing"].alias("missing_lines"), F.bround(kept, 3).alias("preservation"))

    return bind(counts, done)


def line_number_value(body: Column) -> Column:
    """The value of a line that is purely numeral, else 0."""
    pure = lambda c: (F.size(words(c)) > 0) & F.forall(words(c), lambda t: matches(t, "^" + NUMERAL) | (t == "la2"))
    return bind(without_damage(body), lambda c: F.when(pure(c), numeral(c)).otherwise(F.lit(0).cast("long")))


def title_in(c: Column) -> Column:
    """The first title of the list that occurs."""
    return F.coalesce(first(F.filter(strings(L.TITLES), lambda t: F.contains(c, t))), F.lit(""))


def date_code(c: Column) -> Column:
    """ruler, regnal_year, month_number of a code ruler.year.month.day."""
    empty = F.struct(F.lit("").alias("ruler"), F.lit(0).cast("long").alias("regnal_year"), F.lit(0).cast("long").alias("month_number"))
    parts = F.split(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s*\(.*?\)", "")), r"\.")
    parsed = lambda p: F.when(F.size(p) >= 2, F.struct(F.get(p, F.lit(0)).alias("ruler"), whole(F.get(p, F.lit(1))).alias("regnal_year"), whole(F.regexp_replace(F.coalesce(F.get(p, F.lit(2)), F.lit("")), "[a-zA-Z]", "")).alias("month_number"))).otherwise(empty)
    return F.when(F.coalesce(c, F.lit("")).isin("", "00.00.00.00", "--.--.--.--"), empty).otherwise(bind(parts, parsed))


def clean_form(c: Column) -> Column:
    """A written form of a name without damage marks."""
    out = F.translate(F.regexp_replace(c, r"\[([^\]]*)\]", "$1"), "#?!", "")
    return strip(F.regexp_replace(F.regexp_replace(out, "<<[^>]*>>", ""), r"(?U)\s+", " "))


def to_ascii(c: Column) -> Column:
    """Subscript digits and special consonants in ASCII."""
    out = F.translate(c, "₀₁₂₃₄₅₆₇₈₉", "0123456789")
    for letter, plain in L.UNICODE_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def without_case_suffix(c: Column) -> Column:
    return F.regexp_replace(c, "(?:" + "|".join(L.CASE_SUFFIXES) + ")$", "")


def meaning_category(guide_word: Column) -> Column:
    low = F.lower(guide_word)
    return F.when(has(low, *L.ANIMAL_WORDS), "animal").when(has(low, *L.PROFESSION_WORDS), "profession").otherwise("other")


def animal_base(c: Column) -> Column:
    return F.when(starts(c, "{") & has(c, "}"), c).otherwise(found(c, r"(?U)^([^-\s]*)"))


def animal_category(base: Column) -> Column:
    return lookup(base, L.CATEGORY_OF_ANIMAL, "other")


def tx_flow(tx: Column) -> Column:
    return lookup(F.lower(F.coalesce(tx, F.lit(""))), L.FLOW_OF, "other")


def flow_matches(tx: Column, flow: str | None) -> Column:
    """Whether a transaction type passes a flow filter."""
    if not flow or flow == "all":
        return F.lit(True)
    return tx_flow(tx).isin("in", "out") if flow == "external" else tx_flow(tx) == flow


def deity_category(c: Column) -> Column:
    from dubsar.functions.columns import group_of

    return group_of(F.lower(c), L.DEITY_GROUPS)


def destination_group(c: Column) -> Column:
    from dubsar.functions.columns import group_of

    return group_of(F.lower(c), L.DESTINATION_GROUPS)


def ruler_index(c: Column) -> Column:
    return lookup(c, {name: k for k, (name, _) in enumerate(L.RULERS)}, -1)


def ruler_abbreviation(c: Column) -> Column:
    return chain(((c == name, F.lit(abbr)) for name, abbr in L.RULERS), c)


def two_digits(c: Column) -> Column:
    return F.when(F.length(c.cast("string")) < 2, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))


def period_label(ruler: Column, year: Column) -> Column:
    return F.when(ruler_index(ruler) >= 0, F.concat(ruler_abbreviation(ruler), F.lit("."), two_digits(year))).otherwise(F.concat(ruler, F.lit("."), year.cast("string")))


def date_not_after(ruler_abbr: Column, year: Column, month: Column, end: tuple[str, int, int] | None) -> Column:
    """Whether an ordinal date is at or before an end; None is open, a missing month sorts first."""
    if end is None:
        return F.lit(True)
    rank = {abbr: k for k, (_, abbr) in enumerate(L.RULERS)}
    here, there = lookup(ruler_abbr, rank, -1), rank.get(end[0], -1)
    year_, month_ = F.coalesce(year, F.lit(0)), F.coalesce(month, F.lit(0))
    return (here < there) | ((here == there) & ((year_ < end[1]) | ((year_ == end[1]) & (month_ <= end[2]))))


def normal_tablet_id(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, "^[Pp]+", ""), "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


def normal_type(c: Column) -> Column:
    """Spellings of one transaction type made equal."""
    low = strip(F.lower(c))
    return F.when(low.isin("to accept", "szu ba-ti"), "receipt").otherwise(low)


def normal_mukux(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("kuₓ"), F.lit("kux")), r"(?i)mu-kux?\(du\)", "mu-kux(du)")


def wrapped_snippet(c: Column) -> Column:
    """A bare line as a whole small tablet."""
    return F.when(starts(strip(c), "@"), c).otherwise(F.concat(F.lit("@tablet\n@obverse\n1. "), c))


def parsed_animals(detail: Column) -> Column:
    """count and animal of each entry of a flat animals cell."""
    pattern = r"(?:\[imp:(\d+)\]|(\d+))(?U:\s*[×x]\s*)([^,]+)"
    each = F.regexp_extract_all(F.coalesce(detail, F.lit("")), F.lit(pattern), F.lit(0))
    parsed = F.transform(each, lambda e: F.struct(F.greatest(whole(found(e, pattern, 1)), whole(found(e, pattern, 2))).alias("count"), strip(found(e, pattern, 3)).alias("animal")))
    return F.filter(parsed, lambda x: x["animal"] != "")


def score_label(has_text: Column, transaction: Column, n_persons: Column, n_animals: Column, dated: Column, preservation: Column, uncertain: Column, all_animals: Column) -> Column:
    """high, medium, low or none: fields present times preservation, less when counts are mostly uncertain."""
    present = sum((c.cast("int") for c in (transaction != "", n_persons > 0, n_animals > 0, dated)), F.lit(0))
    value = present * preservation * F.when((all_animals > 0) & (uncertain * 2 > all_animals), 0.8).otherwise(1.0)
    return F.when(~has_text, "none").otherwise(bind(value, lambda v: F.when(v >= 3.0, "high").when(v >= 1.5, "medium").when(v > 0, "low").otherwise("none")))


__all__ = [n for n in dir() if not n.startswith("_")] + ["strings"]
