"""Operator 6: license scan by ordered signature rules, in DataFrame functions only.

Rules are gated by keywords: a rule's regex is tried only where all of its keywords
occur in the lower-cased text, and its regex needs each of them as it stands, so the
gate loses no match. Detections are character intervals; one that lies within
another of higher priority is suppressed, of equal priority if the other is longer
or, of equal intervals, comes from an earlier rule. Everything happens within the
row: no shuffle, no join, no Python.

A regex runs over a text once for its matches and once for what is between them;
places, and the furthest end so far at each priority, are running values found by
doubling, so work grows as n log n of a text's matches.

Base phrases are counted over the text's words besides and never suppressed.

Defined results: null and empty texts have no words and score 0; null ids stay
null; repeated rows repeat; equal detections of one interval and priority leave the
first rule's; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_rules import Rule, rules
from .shared import table, text_of

#: What divides the contract's words: all of ASCII but digits and letters (lower-cased).
DIVIDES = "".join(c for c in map(chr, range(128)) if not (c.isdigit() or "a" <= c <= "z"))
#: Two dividers, so no word holds them: between words in ``_joined``.
_GAP = "\x01\x02"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_PRIORITY = 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GROUPS = "array<struct<top:string,groups:array<struct<needs:array<string>,rules:array<struct<label:string,priority:int,nth:int,regex:string>>>>>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: a lambda's variable holds it, and the optimizer puts no expression in its place."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running ``op`` of an array, each element included, by doubling distances."""

    def further(acc: Column, k: Column) -> Column:
        n, by = F.size(acc), F.pow(F.lit(2), k).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(zero, F.least(by, n)), F.slice(acc, F.lit(1), F.greatest(n - by, F.lit(0)))), op)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)
    return F.when(F.size(values) > 1, F.aggregate(rounds, values, further)).otherwise(values)


def rule_groups(own: list[Rule]) -> Column:
    """A constant: a first keyword that many rules share, then the sets of keywords with their rules."""
    tops: dict[str, dict[str, list[dict]]] = {}
    for nth, r in enumerate(own):
        words = r.keywords.split()
        top = "licen" if any("licen" in w for w in words) else words[0]
        tops.setdefault(top, {}).setdefault(r.keywords, []).append({"label": r.label, "priority": r.priority, "nth": nth, "regex": r.regex})
    said = [{"top": t, "groups": [{"needs": k.split(), "rules": v} for k, v in groups.items()]} for t, groups in tops.items()]
    return F.from_json(F.lit(json.dumps(said)), _GROUPS)


def _intervals(low: Column, rule: Column) -> Column:
    """All matches of one rule: between matches lie the split's pieces."""

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(low, rule["regex"], -1), F.lit(1), F.size(found)), found, lambda gap, x: F.length(gap) + F.length(x))
        ends = _let(steps, lambda s: _running(s, lambda a, b: a + b, F.lit(0)))
        at = F.zip_with(ends, found, lambda end, x: F.struct((end - F.length(x)).alias("start"), (-end).alias("back"), (-rule["priority"]).alias("below"), rule["nth"].alias("nth"), rule["label"].alias("label")))
        return F.when(F.size(found) > 0, at)

    return _let(F.regexp_extract_all(low, rule["regex"], F.lit(0)), placed)


def detections(low: Column, own: list[Rule]) -> Column:
    """Every rule's matches in a lower-cased text, before suppression, in order of (start, -end, -priority, rule)."""

    def all_of(t: Column) -> Column:
        tops = F.filter(rule_groups(own), lambda g: F.contains(t, g["top"]))
        groups = F.filter(F.flatten(F.transform(tops, lambda g: g["groups"])), lambda g: F.forall(g["needs"], lambda w: F.contains(t, w)))
        tried = F.flatten(F.transform(groups, lambda g: g["rules"]))
        return F.array_sort(F.flatten(F.filter(F.transform(tried, lambda r: _intervals(t, r)), lambda x: x.isNotNull())))

    return _let(low, all_of)


def unsuppressed(found: Column, own: list[Rule]) -> Column:
    """Without intervals contained in one that beats them, as array of (start, end, label, priority).

    In the order of ``detections`` whatever contains an interval comes before it, as does, of equal
    intervals, the one that stays; so an interval goes if an end as far was seen at its priority or above.
    """
    levels = sorted({r.priority for r in own})
    at = F.array(*[F.lit(p) for p in levels])
    none = F.array_repeat(F.lit(0), len(levels))

    def swept(s: Column) -> Column:
        ends = F.transform(s, lambda x: F.transform(at, lambda p: F.when(-x["below"] >= p, -x["back"]).otherwise(F.lit(0))))
        upto = _let(ends, lambda e: _running(e, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)), none))
        before = F.concat(F.array(none), F.slice(upto, F.lit(1), F.size(s) - 1))
        kept = F.zip_with(s, before, lambda x, b: F.when(F.element_at(b, F.array_position(at, -x["below"]).cast("int")) < -x["back"], x))
        return F.when(F.size(s) > 1, F.filter(kept, lambda x: x.isNotNull())).otherwise(s)

    return F.transform(_let(found, swept), lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["label"].alias("label"), (-x["below"]).alias("priority")))


def _phrase(spaced: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Places of a phrase, its first and its last start. ``spaced`` has each word between spaces of its own."""
    words = phrase.split()
    text = "".join(f" {w} " for w in words)
    n = (F.length(spaced) - F.length(F.replace(spaced, F.lit(text), F.lit("")))) / len(text)
    n_of = lambda part: F.regexp_count(part, F.lit("[^ ]+"))
    before, after = F.substring_index(spaced, text, 1), F.substring_index(spaced, text, -1)
    return n.cast("bigint"), F.when(n > 0, n_of(before)), F.when(n > 0, n_words - n_of(after) - len(words))


def _joined(low: Column) -> Column:
    """The words, ``_GAP`` between them: every divider becomes a space and runs of spaces one gap, without a regex."""
    spaces = F.trim(F.translate(low, DIVIDES, " " * len(DIVIDES)))
    return F.replace(F.replace(spaces, F.lit(" "), F.lit(_GAP)), F.lit(_GAP[1] + _GAP[0]), F.lit(""))


def _base(joined: Column) -> Column:
    """Words, and the contract's phrases: n, first, last and labels."""

    def counted(x: Column) -> Column:
        places = {label: _phrase(x["spaced"], x["n_words"], phrase) for phrase, label in BASE.items()}
        labels = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for label, (n, _, _) in places.items()]))
        total = sum((n for n, _, _ in places.values()), F.lit(0).cast("bigint"))
        return F.struct(x["n_words"].alias("n_words"), total.alias("n"), F.least(*[f for _, f, _ in places.values()]).cast("bigint").alias("first"), F.greatest(*[z for _, _, z in places.values()]).cast("bigint").alias("last"), labels.alias("labels"))

    def read(j: Column) -> Column:
        n_words = F.when(j == "", F.lit(0)).otherwise(F.octet_length(j) - F.octet_length(F.replace(j, F.lit(_GAP[0]), F.lit(""))) + 1).cast("bigint")
        spaced = F.when(F.contains(j, F.lit("license")), F.concat(F.lit(" "), F.replace(j, F.lit(_GAP), F.lit("  ")), F.lit(" "))).otherwise("")
        return F.struct(n_words.alias("n_words"), spaced.alias("spaced"))

    return _let(_let(joined, read), counted)


def license_scan(docs: DataFrame, own: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    own = rules() if own is None else own
    low = text_of(docs, id_col, text_col).select("doc_id", F.translate("text", _UPPER, _LOWER).alias("low"))
    # one value for all, so that nothing below is computed anew for each of its uses
    whole = F.struct(_base(_joined(F.col("low"))).alias("base"), unsuppressed(detections(F.col("low"), own), own).alias("detections"))
    rows = low.select("doc_id", F.explode(F.array(whole)).alias("x")).select("doc_id", "x.*")
    doubt = F.aggregate(F.concat(F.transform("detections", lambda h: h["priority"]), F.transform("base.labels", lambda _: F.lit(BASE_PRIORITY))), F.lit(1.0), lambda left, p: left * (1 - p / 100))
    return rows.select(
        "doc_id", F.col("base.n_words").alias("n_words"), F.col("base.n").alias("n_base"), F.col("base.first").alias("first_word"), F.col("base.last").alias("last_word"),
        F.array_join(F.array_sort("base.labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base.labels", F.transform("detections", lambda h: h["label"]))), ",").alias("labels"),
        F.round(1 - doubt, 6).alias("score"), "detections",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")
