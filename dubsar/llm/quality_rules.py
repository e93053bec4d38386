"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one failure bit per rule; a policy is a versioned mask over those bits, so a new
policy or an ablation never reads a text again. All of it is built-in functions in
one narrow stage: no shuffle, whatever the skew.

Defined results: a null text counts as no words; an empty table gives an empty
ledger; repeated rows are kept; other columns of the input are kept unless the
ledger has a column of that name, which then wins. Ties cannot occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubsar.llm.shared import BLANKS, GAP, let

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _rules() -> dict[str, Column]:
    """Name -> failure, over the measurements; a rule's place is its bit."""
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 5 * c("word_chars"),
        "repeated_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 15 * c("n_words"),
    }


RULE_NAMES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words")
#: Version -> the rules whose failure rejects a document.
POLICIES = {"base": RULE_NAMES[:2], "v1": RULE_NAMES}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULE_NAMES.index(r) for r in rules)


def _repeated(windows: Column) -> Column:
    """Words covered by window hashes that occur twice or more; windows: one 64-bit hash per start."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(rows: Column) -> Column:
        same = F.filter(rows, lambda x, k: (F.get(rows, k - 1)["h"] == x["h"]) | (F.get(rows, k + 1)["h"] == x["h"]))
        starts = F.sort_array(F.transform(same, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n")),
            lambda acc: acc["n"],
        )

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(placed, covered))


def _measures(text: Column) -> Column:
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    def of(ws: Column) -> Column:
        repeats = F.when(F.size(ws) <= WINDOW, 0).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: let(windows(hs), _repeated)))
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"))

    def by_line(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(words, of).alias("w"),
        let(lines, by_line).alias("l"),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with MEASURES and fail_bits."""
    own = {*MEASURES, "fail_bits", "_m"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in own]
    measured = docs.select(*rest, _measures(F.coalesce(F.col(text), F.lit(""))).alias("_m"))
    flat = measured.select(*rest, "_m.w.n_words", "_m.word_chars", "_m.n_symbols", "_m.l.n_lines", "_m.l.n_dup_lines", "_m.w.n_repeat_words")
    bits = sum((F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(_rules().values())), F.lit(0))
    return flat.withColumn("fail_bits", bits.cast("long"))


def passes(policy: str) -> Column:
    """Whether a ledger row survives a policy version."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and kept if it were dropped.

    One pass and one small aggregate row, however many rules.
    """
    m = mask(POLICIES[policy])
    hit = F.col("fail_bits").bitwiseAND(F.lit(m))
    one = led.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit == 0).alias("kept"),
        *(F.count_if(hit.bitwiseAND(F.lit(mask((r,)))) != 0).alias(f"f_{r}") for r in POLICIES[policy]),
        *(F.count_if(hit == mask((r,))).alias(f"o_{r}") for r in POLICIES[policy]),
        F.coalesce(F.bit_or(hit), F.lit(0)).alias("any_bits"),
        F.coalesce(F.bit_and(hit), F.lit(0)).alias("all_bits"),
    )
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"), (F.col("kept") + F.col(f"o_{r}")).alias("kept_without")) for r in POLICIES[policy]))
    return one.select(F.lit(policy).alias("policy"), "n", "kept", "any_bits", "all_bits", F.inline(rows))


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that a policy keeps, with docs' own columns. The bits ride along in the same stage."""
    m = _measures(F.coalesce(F.col("text"), F.lit("")))
    names = docs.columns
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_d"), m.alias("_m"))
    flat = wide.select("_d", "_m.w.n_words", "_m.word_chars", "_m.n_symbols", "_m.l.n_lines", "_m.l.n_dup_lines", "_m.w.n_repeat_words")
    rules = _rules()
    failed = sum((F.when(rules[r], F.lit(1 << RULE_NAMES.index(r))).otherwise(F.lit(0)) for r in RULE_NAMES), F.lit(0)).cast("long")
    return flat.withColumn("fail_bits", failed).where(passes(policy)).select("_d.*")
