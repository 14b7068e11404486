"""Amenities read from free text: rules, evidence and flags."""
from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import AMENITY_DOUBTS, AMENITY_HINTS, AMENITY_RULES, NEGATION
from .text import Windows, contains_any, normalize_text


@dataclass(frozen=True)
class TextRule:
    pattern: str
    no_before: str | None = None
    no_after: str | None = None
    no_context: str | None = None
    needs_context: str | None = None
    starts: str = ""
    words: tuple[str, ...] = ()
    doubts: tuple[str | None, str | None, str | None, bool] | None = None

    @property
    def uses_context(self) -> bool:
        return bool(self.no_context or self.needs_context)


    def windows(self, t: Column) -> Windows:
        return Windows(t, self.pattern, starts=self.starts)

    def may_match(self, t: Column) -> Column:
        """Cheap test no matching text fails."""
        return contains_any(t, self.words) if self.words else t.rlike(self.pattern)

    def is_counted(self, t: Column) -> Column:
        """Some match counts, by one scan of a normalised text in which every match is asked where it stands; only for rules that name their
        doubts, and texts that aren't odd."""
        before, after, _, apart = self.doubts
        behind = [b for b in (NEGATION.removesuffix("$"), before) if b]
        first = f"(?=[{self.starts}])" if self.starts else ""
        counts = "".join(f"(?<!{b})" for b in behind) + f"((?>{self.pattern}))" + (f"(?!{after})" if after else "")
        if apart:
            return t.rlike(rf"(?s){first}(?=(?:{self.pattern})){counts}")
        # A match that doesn't count is passed over whole by the second branch, as the next one begins behind it, and leaves the group empty.
        regex = rf"(?s){first}(?=(?:{self.pattern}))(?:{counts}|(?>{self.pattern}))"
        group = 1 + sum(re.compile(p).groups for p in (self.pattern, *behind))
        return F.coalesce(F.array_max(F.regexp_extract_all(t, F.lit(regex), F.lit(group))) > "", F.lit(False))


RuleBook = dict[str, list[TextRule]]


def rule_book(rows: Iterable[tuple]) -> RuleBook:
    """Rules by feature from rows (feature, pattern, no_before, no_after, no_context, needs_context[, starts, words, doubts])."""
    book: RuleBook = {}
    for feature, *rule in rows:
        book.setdefault(feature, []).append(TextRule(*rule))
    return book


def rule_book_from_table(df: DataFrame, max_rules: int = 10_000) -> RuleBook:
    """Rules from a table; each becomes a literal pattern, so the table must be small."""
    rows = (df.orderBy("feature", "rule_no").limit(max_rules + 1)
            .select("feature", "pattern", "no_before", "no_after", "no_context", "needs_context").collect())
    if len(rows) > max_rules:
        raise ValueError(f"rule table has more than {max_rules} rules")
    return rule_book(map(tuple, rows))


DEFAULT_RULES = rule_book((*rule, *hints, doubts) for rule, hints, doubts in zip(AMENITY_RULES, AMENITY_HINTS, AMENITY_DOUBTS, strict=True))


def discard_reason(rule: TextRule, before: Column, match: Column, after: Column) -> Column:
    """Why a match does not count, first cause only; NULL when it counts."""
    context = F.concat(before, match, after)
    causes = [F.when(before.rlike(NEGATION), F.lit("negacion"))]
    if rule.no_before:
        causes.append(F.when(before.rlike(rule.no_before), F.lit("no_antes")))
    if rule.no_after:
        causes.append(F.when(after.rlike(rule.no_after), F.lit("no_despues")))
    if rule.no_context:
        causes.append(F.when(context.rlike(rule.no_context), F.lit("no_contexto")))
    if rule.needs_context:
        causes.append(F.when(~context.rlike(rule.needs_context), F.lit("falta_contexto")))
    return F.coalesce(*causes)


def _reasons(t: Column, rule: TextRule) -> Column:
    """Array with one discard reason (or NULL) per match, scanning only what the rule needs."""
    found = rule.windows(t)
    if rule.uses_context:
        return F.transform(found.structs(),
                           lambda m: discard_reason(rule, m["before"], m["match"], m["after"]))
    if rule.no_after:
        return F.zip_with(found.before, found.after, lambda b, a: discard_reason(rule, b, F.lit(""), a))
    return F.transform(found.before, lambda b: discard_reason(rule, b, F.lit(""), F.lit("")))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def is_mentioned(t: Column, rules: list[TextRule]) -> Column:
    """Some match of some rule counts; texts without the words are never scanned, and only odd ones reach the window scan."""
    def one(r: TextRule) -> Column:
        if r.doubts is None:
            return F.exists(_reasons(t, r), lambda x: x.isNull())
        odd = r.doubts[2]
        return F.when(t.rlike(odd), F.exists(_reasons(t, r), lambda x: x.isNull())).otherwise(r.is_counted(t)) if odd else r.is_counted(t)
    return _any([F.when(r.may_match(t), one(r)).otherwise(F.lit(False)) for r in rules])


def has_negation(t: Column, rules: list[TextRule]) -> Column:
    return _any([F.when(r.may_match(t), F.exists(_reasons(t, r), lambda x: F.coalesce(x == "negacion", F.lit(False))))
                 .otherwise(F.lit(False)) for r in rules])


def is_blank(t: Column) -> Column:
    return F.trim(t) == ""


def amenity_matches(t: Column, rules: list[TextRule]) -> Column:
    """ARRAY<STRUCT<motivo, fragmento>> over all rules in order; motivo NULL marks a counted mention."""
    empty = F.array().cast("array<struct<motivo:string,fragmento:string>>")

    def one(rule: TextRule) -> Column:
        matches = F.transform(rule.windows(t).structs(), lambda m: F.struct(
            discard_reason(rule, m["before"], m["match"], m["after"]).alias("motivo"),
            F.concat(m["before"], m["match"], m["after"]).alias("fragmento")))
        return F.when(rule.may_match(t), matches).otherwise(empty)

    return F.concat(*[one(r) for r in rules]) if len(rules) > 1 else one(rules[0])


def evidence(t: Column, counted: Column, negated: Column, discards: Column) -> Column:
    """State, conflict, first evidence, first negation and discards of one feature."""
    state = (F.when(is_blank(t), "sin_descripcion").when(F.size(counted) > 0, "mencionado")
             .when(F.size(negated) > 0, "negado").otherwise("sin_mencion"))
    return F.struct(state.alias("estado"),
                    ((F.size(counted) > 0) & (F.size(negated) > 0)).alias("conflicto"),
                    F.get(counted, F.lit(0)).alias("evidencia"), F.get(negated, F.lit(0)).alias("negacion"),
                    discards.alias("descartes"))


def extract_amenities(df: DataFrame, column: str = "description", rules: RuleBook = DEFAULT_RULES,
                      output: str = "amenidades") -> DataFrame:
    """Add a map feature -> evidence struct, built in steps so that every array is computed once."""
    n = range(len(rules))
    out = (df.withColumn("__t", normalize_text(F.col(column)))
           .withColumns({f"__m{i}": amenity_matches(F.col("__t"), r) for i, r in enumerate(rules.values())}))
    parts = {}
    for i in n:
        found = F.col(f"__m{i}")
        parts[f"__c{i}"] = F.transform(F.filter(found, lambda m: m["motivo"].isNull()), lambda m: m["fragmento"])
        parts[f"__n{i}"] = F.transform(F.filter(found, lambda m: m["motivo"] == "negacion"), lambda m: m["fragmento"])
        parts[f"__d{i}"] = F.filter(found, lambda m: m["motivo"] != "negacion")
    out = out.withColumns(parts)
    pairs = [x for i, f in enumerate(rules) for x in (F.lit(f), evidence(
        F.col("__t"), F.col(f"__c{i}"), F.col(f"__n{i}"), F.col(f"__d{i}")))]
    return out.withColumn(output, F.create_map(*pairs)).drop(
        "__t", *[f"__{k}{i}" for k in "mcnd" for i in n])


def amenity_flags(df: DataFrame, column: str = "description", rules: RuleBook = DEFAULT_RULES) -> DataFrame:
    """Add `X`, `X_negado` per feature and `sin_descripcion`."""
    names = {f: f"__r_{i}" for i, f in enumerate(rules)}
    empty = F.array().cast("array<string>")

    def reasons(feature: str) -> Column:
        parts = [F.when(r.may_match(F.col("__t")), _reasons(F.col("__t"), r)).otherwise(empty)
                 for r in rules[feature]]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    out = (df.withColumn("__t", normalize_text(F.col(column)))
           .withColumns({r: reasons(f) for f, r in names.items()}))
    flags = {}
    for f, r in names.items():
        counted = F.exists(F.col(r), lambda x: x.isNull())
        flags[f] = counted
        flags[f"{f}_negado"] = ~counted & F.exists(F.col(r), lambda x: F.coalesce(x == "negacion", F.lit(False)))
    flags["sin_descripcion"] = is_blank(F.col("__t"))
    return out.withColumns(flags).drop("__t", *names.values())
