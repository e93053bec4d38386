"""Name dictionary and glossary from lemmatised text, and lookup with ordered fallback."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dubsar.functions import atf
from dubsar.functions import lexicon as L
from dubsar.functions.columns import lookup, q, strip

NAMES = "form string, canonical string, pos string, category string, attestations bigint"
#: Bytes of a dictionary that is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 64 << 20


LEMMAS = "doc string, seq long, form string, cf string, gw string, pos string, epos string"
#: Rows that the walk hands on at once.
WALKED = 10_000


_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([\[\]{},:])|("[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity))'
)
_FIELDS = ("form", "cf", "gw", "pos", "epos")


def _events(text: str) -> Iterator[tuple[str, int, int]]:
    """The tokens of a JSON text with their places: brackets, k (a key), v (any other scalar). ValueError where it is malformed.

    What is held is one character for each open bracket.
    """
    open_: list[str] = []
    want, pos = "value", 0
    while want != "end":
        m = _TOKEN.match(text, pos)
        if m is None:
            raise ValueError(f"no token at {pos}")
        mark, string, pos = m[1], m[2], m.end()
        if want == "colon":
            if mark != ":":
                raise ValueError(f"no colon at {pos}")
            want = "value"
            continue
        if want == "comma" and mark == ",":
            want = "key" if open_[-1] == "{" else "value"
            continue
        if mark is None:
            if want == "comma" or (want in ("key", "key or }") and string is None):
                raise ValueError(f"a value too many at {pos}")
            key = want in ("key", "key or }")
            yield "k" if key else "v", m.start(2) if string else m.start(3), pos
            want = "colon" if key else "comma" if open_ else "end"
        elif mark in "{[" and want in ("value", "value or ]"):
            open_.append(mark)
            yield mark, pos - 1, pos
            want = "key or }" if mark == "{" else "value or ]"
        elif mark in "}]" and open_ and (open_[-1] + mark) in ("{}", "[]") and want in ("comma", "key or }" if mark == "}" else "value or ]"):
            open_.pop()
            yield mark, pos - 1, pos
            want = "comma" if open_ else "end"
        else:
            raise ValueError(f"{mark} at {pos}")
    if text[pos:].strip(" \t\n\r"):
        raise ValueError(f"more at {pos}")


class _Node:
    """An open node: where it opened, node and f so far (places of their values), its last cdl, whether its word is out."""

    __slots__ = ("at", "cdl", "f", "kind", "late", "out")

    def __init__(self, at: int) -> None:
        self.at, self.kind, self.f, self.cdl, self.late, self.out = at, None, None, None, False, False


def _nodes(text: str, late: dict[int, tuple] | None) -> Iterator[tuple]:
    """Without late: the nodes that name kind, fields or children again after children, as (place, kind, f, cdl). With it: place of f of each word, in reading order."""
    open_: list[_Node | None] = []  # None: a list of children
    skipped, key, began = 0, "", 0
    for what, a, b in _events(text):
        if skipped:
            skipped += (what in "{[") - (what in "}]")
            if skipped:
                continue
            what, a = "v", began  # a value that is not walked, now whole
        node = open_[-1] if open_ else None
        if node is None and open_:
            if what == "{":
                open_.append(_Node(a))
            elif what == "[":
                skipped, began, key = 1, a, ""
            elif what == "]":
                open_.pop()
            continue
        if node is None:
            if what == "{":
                open_.append(_Node(a))
            elif what == "[":
                skipped, began = 1, a
            continue
        if what == "k":
            key = json.loads(text[a:b])
            node.late |= node.cdl is not None and key in ("node", "f", "cdl")
        elif what == "}":
            if late is None and node.late:
                yield node.at, node.kind, node.f, node.cdl
            elif late is not None and not node.out and len(open_) > 1:
                kind, f, _ = late.get(node.at, (node.kind, node.f, None))
                if _is_word(text, kind):
                    yield (f,)
            open_.pop()
        elif what == "[" and key == "cdl" and (late is None or node.at not in late or late[node.at][2] == a):
            node.cdl = a
            if late is not None and len(open_) > 1:
                kind, f, _ = late.get(node.at, (node.kind, node.f, None))
                node.out = True
                if _is_word(text, kind):
                    yield (f,)
            open_.append(None)
        elif what in "{[":
            skipped, began = 1, a
        elif key == "node":
            node.kind = (a, b)
        elif key == "f":
            node.f = (a, b)
        elif key == "cdl" and node.cdl is not None:
            node.cdl = -1


def _is_word(text: str, kind: tuple[int, int] | None) -> bool:
    return kind is not None and kind[1] - kind[0] < 16 and text[slice(*kind)].startswith('"') and json.loads(text[slice(*kind)]) == "l"


def _fields(text: str, f: tuple[int, int] | None) -> tuple[str | None, ...] | None:
    """form, cf, gw, pos, epos of the value of f; None where that is null or not there."""
    said = text[slice(*f)] if f else "null"
    if said == "null":
        return None
    if not said.startswith("{"):
        return (None,) * len(_FIELDS)
    try:
        given = json.loads(said)
        return tuple(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in map(given.get, _FIELDS))
    except RecursionError:  # a value deeper than Python's own parser goes names no word
        return (None,) * len(_FIELDS)


#: Characters of a text that Python's own parser may take whole.
PARSED = 1 << 24


def _parsed_words(text: str) -> Iterator[tuple[str | None, ...]]:
    """The same of a text that is parsed whole; RecursionError where it is too deep for that."""
    below = lambda node: node["cdl"] if isinstance(node, dict) and isinstance(node.get("cdl"), list) else []
    open_, end = [iter(below(json.loads(text)))], object()
    while open_:
        node = next(open_[-1], end)
        if node is end:
            open_.pop()
        elif isinstance(node, dict):
            f = node.get("f")
            if node.get("node") == "l" and f is not None:
                got = (f.get(k) if isinstance(f, dict) else None for k in _FIELDS)
                yield tuple(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in got)
            open_.append(iter(below(node)))


def _pulled_words(text: str) -> Iterator[tuple[str | None, ...]]:
    """The text is read twice, token by token: first to know that it is well formed, and which nodes tell of themselves
    after their children; then words go out while it is read. What is held grows with the depth alone.
    """
    late = {at: rest for at, *rest in _nodes(text, None)}
    for (f,) in _nodes(text, late):
        if (word := _fields(text, f)) is not None:
            yield word


def _words(text: str) -> Iterator[tuple[str | None, ...]]:
    """The fields of the word nodes of one tree, in reading order; of any depth and size. Malformed texts have none."""
    try:
        if len(text) <= PARSED:
            try:
                yield from _parsed_words(text)
                return
            except RecursionError:  # raised before the first word
                pass
        yield from _pulled_words(text)
    except ValueError:
        return


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.string()), ("seq", pa.int64()), *((k, pa.string()) for k in ("form", "cf", "gw", "pos", "epos"))])
    for b in batches:
        held: list[tuple] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for seq, word in enumerate(_words(text or ""), 1):
                held.append((doc, seq, *word))
                if len(held) == WALKED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def walk_lemmas(texts: DataFrame) -> DataFrame:
    """LEMMAS: the word nodes of text JSON trees (doc, json), in reading order.

    A large or deep tree is read by a pull parser, so there is no bound on either, and rows
    go on in small batches: one narrow stage, no shuffle. Malformed JSON and null give no rows.
    """
    return texts.select(F.col("doc").cast("string"), "json").mapInArrow(_walk, LEMMAS)


def build_names(lemmas: DataFrame, order: tuple[str, ...] = ("doc", "seq")) -> DataFrame:
    """NAMES: per written form the canonical name with most tokens; the first seen wins a tie.

    Part of speech and category are those of the last token of that pair.
    """
    tags = list(L.NAME_POS)
    pos = F.coalesce("pos", F.lit(""))
    eff = F.when(F.coalesce("epos", pos).isin(tags), F.coalesce("epos", pos)).otherwise(pos)
    place = F.struct(*order)
    clean = atf.clean_form(strip(F.coalesce("form", F.lit(""))))
    kept = lemmas.select(place.alias("at"), eff.alias("pos"), clean.alias("clean"), strip(F.coalesce("cf", F.lit(""))).alias("canonical")).where(F.col("pos").isin(tags) & (F.col("clean") != "") & (F.col("canonical") != ""))
    forms = kept.select("at", "pos", "canonical", F.explode(F.array_distinct(F.array("clean", atf.to_ascii(F.col("clean"))))).alias("form"))
    pairs = forms.groupBy("form", "canonical").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max_by("pos", "at").alias("pos"))
    best = pairs.groupBy("form").agg(F.min_by(F.struct("canonical", "pos", "n"), F.struct((-F.col("n")).alias("n"), "first")).alias("b"))
    return best.select("form", "b.canonical", "b.pos", lookup(F.col("b.pos"), L.NAME_POS).alias("category"), F.col("b.n").alias("attestations"))


def ordered_names(names: DataFrame) -> DataFrame:
    """By category in the order of the parts of speech, then form."""
    return names.orderBy(lookup(F.col("category"), {c: k for k, c in enumerate(L.NAME_POS.values())}, 99), "form")


def name_summary(names: DataFrame) -> DataFrame:
    """measure, key, value: forms, attestations, forms by category and by part of speech."""
    cubed = names.groupingSets([[], ["category"], ["pos"]], "category", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("attestations").alias("t"), F.grouping_id().alias("g"))
    row = lambda m, k, v: F.struct(F.lit(m).alias("measure"), k.alias("key"), v.cast("long").alias("value"))
    rows = F.when(F.col("g") == 3, F.array(row("forms", F.lit(""), F.col("n")), row("attestations", F.lit(""), F.coalesce("t", F.lit(0))))).when(F.col("g") == 1, F.array(row("category", F.col("category"), F.col("n")))).otherwise(F.array(row("pos", F.col("pos"), F.col("n"))))
    return cubed.select(F.inline(rows))


def top_names(names: DataFrame, pos: str = "PN", k: int = 20) -> DataFrame:
    return names.where(F.col("pos") == pos).orderBy(F.desc("attestations"), "form").limit(k)


def without_suffix(form: Column, suffixes: list[str]) -> Column:
    """A form without its case suffix, null if it has none. Suffixes are single parts after a hyphen, so the last part decides."""
    last = F.substring_index(form, "-", -1)
    return F.when(F.contains(form, F.lit("-")) & last.isin([s[1:] for s in suffixes]), F.left(form, F.length(form) - F.length(last) - 1))


def candidates(name: Column) -> Column:
    """Keys to look a name up by, best first: as written, in ASCII, then each without its case suffix."""
    clean = atf.clean_form(name)
    forms = [clean, atf.to_ascii(clean)]
    return F.filter(F.array(*forms, *(without_suffix(f, L.DICTIONARY_SUFFIXES) for f in forms)), lambda x: x.isNotNull())


def stem(form: Column) -> Column:
    """What all candidates of a name have in common: in ASCII, without any case suffixes at the end."""
    return F.regexp_replace(atf.to_ascii(form), "(?:" + "|".join(q(s) for s in L.DICTIONARY_SUFFIXES) + ")+$", "")


def look_up(named: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """named with canonical, pos, category and attestations, null where no key is known.

    One probe a name: a name and every form that it may stand for share a stem, by which they are joined; the best
    candidate among the few forms of that stem is kept.
    """
    asked = named.select(F.col(name).alias("_name")).distinct()
    asked = asked.select("_name", stem(atf.clean_form(F.col("_name"))).alias("_stem"), candidates(F.col("_name")).alias("_keys"))
    known = names.withColumn("_stem", stem(F.col("form")))
    hit = asked.join(F.broadcast(known) if _is_small(names) else known, "_stem").withColumn("_at", F.array_position("_keys", F.col("form"))).where("_at > 0")
    hit = hit.groupBy("_name").agg(F.min_by(F.struct("canonical", "pos", "category", "attestations"), "_at").alias("e"))
    return named.join(hit, named[name] == hit["_name"], "left").drop("_name").select(*named.columns, "e.*")


def _is_small(names: DataFrame) -> bool:
    """Whether a dictionary takes MOST_BROADCAST bytes at most, by what its strings and numbers measure."""
    strings_ = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("form", "canonical", "pos", "category")), F.lit(0))
    return (names.agg(F.sum(2 * strings_ + 120)).first()[0] or 0) <= MOST_BROADCAST  # a row holds form and stem, and what surrounds them


def normalize_persons(extracted: DataFrame, names: DataFrame, row: str = "pos") -> DataFrame:
    """extracted with canonical names and name types filled in where the dictionary knows a person.

    row: the column that tells tablets apart; ids may repeat, the place in the input does not.
    """
    people = extracted.select(F.col(row).alias("_row"), F.posexplode("persons").alias("seq", "p"))
    found = look_up(people.select("_row", "seq", "p", F.col("p.name").alias("name")), names)
    filled = F.struct("p.name", "p.role", "p.title", F.coalesce("canonical", F.col("p.normalized_name")).alias("normalized_name"), F.coalesce("pos", F.col("p.name_type")).alias("name_type"))
    again = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("seq", filled.alias("p")))).alias("_p")).select("_row", F.transform("_p", lambda x: x["p"]).alias("_persons"))
    joined = extracted.join(again, F.col(row) == F.col("_row"), "left")
    return joined.select(*(F.coalesce("_persons", "persons").alias("persons") if c == "persons" else c for c in extracted.columns))


def build_glossary(entries: DataFrame) -> DataFrame:
    """Vocabulary of entries (idx, cf, gw, pos, icount, forms array<struct<n,icount>>).

    Forms by count, entries by attestations, both stable; without citation form or
    guide word an entry is skipped.
    """
    txt = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    num = lambda c: F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
    named = F.filter(F.transform(F.coalesce("forms", F.array().cast("array<struct<n:string,icount:string>>")), lambda f, i: F.struct((-num(f["icount"])).alias("worse"), i.alias("i"), strip(F.coalesce(f["n"], F.lit(""))).alias("form"))), lambda f: f["form"] != "")
    forms = F.transform(F.sort_array(named), lambda f: F.struct(f["form"].alias("form"), atf.to_ascii(f["form"]).alias("atf"), (-f["worse"]).alias("count")))
    kept = entries.where((txt("cf") != "") & (txt("gw") != ""))
    return kept.select("idx", txt("cf").alias("citation"), txt("gw").alias("meaning"), txt("pos").alias("pos"), atf.meaning_category(txt("gw")).alias("category"), num(F.col("icount").cast("string")).alias("attestations"), forms.alias("forms")).orderBy(F.desc("attestations"), "idx")


def glossary_lookup(glossary: DataFrame) -> DataFrame:
    """atf, meaning, pos: the first entry wins each lower-cased form."""
    rank = Window.partitionBy("atf").orderBy(F.desc("attestations"), "idx", "i")
    each = glossary.select("idx", "attestations", "meaning", "pos", F.posexplode("forms").alias("i", "f")).withColumn("atf", F.replace(F.lower("f.atf"), F.lit("kuₓ"), F.lit("kux"))).where("atf <> ''")
    return each.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select("atf", "meaning", "pos")
