"""Expressions over inclusive integer ranges: array<struct<start:int,end:int>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = "array<struct<start:int,end:int>>"

# Labels, roles, priorities and boosts of how a record's ranges stand to a query's.
ROLES = {
    "overlaps_query_range": "selected_range_support",
    "global_context": "general_context",
    "other_range_context": "other_range_context_only",
    "unspecified_context": "unconfirmed_scope_context_only",
    "general_evidence": "general_support",
    "unspecified_scope": "unconfirmed_scope_support",
    "local_example": "local_example",
}
RANGED_PRIORITY = {"overlaps_query_range": 3, "global_context": 2, "other_range_context": 1, "unspecified_context": 0}
UNRANGED_PRIORITY = {"general_evidence": 1, "local_example": 1, "unspecified_scope": 1}


def overlap(a: Column, b: Column) -> Column:
    """Any range of a meets any of b."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["start"] <= y["end"]) & (y["start"] <= x["end"])))


def _empty(ranges: Column) -> Column:
    return F.coalesce(F.size(ranges), F.lit(0)) <= 0


def scope_label(ranges: Column, status: Column, query: Column) -> Column:
    unspecified = F.coalesce(status == "unspecified", F.lit(False))
    return (
        F.when(_empty(query) & unspecified, "unspecified_scope")
        .when(_empty(query) & _empty(ranges), "general_evidence")
        .when(_empty(query), "local_example")
        .when(unspecified, "unspecified_context")
        .when(_empty(ranges), "global_context")
        .when(overlap(ranges, query), "overlaps_query_range")
        .otherwise("other_range_context")
    )


def _lookup(table: dict, label: Column, default: object) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), label), F.lit(default))


def scope_role(label: Column) -> Column:
    return _lookup(ROLES, label, "context")


def scope_priority(label: Column, query: Column) -> Column:
    return F.when(_empty(query), _lookup(UNRANGED_PRIORITY, label, 0)).otherwise(_lookup(RANGED_PRIORITY, label, 0))


def scope_boost(ranges: Column, status: Column, scope: Column, final: Column, query: Column) -> Column:
    unspecified = F.coalesce(status == "unspecified", F.lit(False))
    unranged = F.when(F.coalesce(final, F.lit(False)), 1.0).when(unspecified, 0.0).when(_empty(ranges), 1.5).otherwise(0.75)
    met = F.when(F.coalesce(scope == "recurring", F.lit(False)), 6.0).otherwise(5.0)
    return F.when(_empty(query), unranged).when(unspecified, -1.25).when(_empty(ranges), 0.25).when(overlap(ranges, query), met).otherwise(-1.0)


def default_scope(ranges: Column) -> Column:
    return F.when(_empty(ranges), "global").when(F.size(ranges) > 1, "multi_range").otherwise("local")


def scope_is_consistent(ranges: Column, scope: Column) -> Column:
    return F.when(scope == "recurring", ~_empty(ranges)).otherwise(F.coalesce(scope == default_scope(ranges), F.lit(False)))


def merged(ranges: Column, gap: int = 0) -> Column:
    """Ranges of one row as a sorted union. gap 0: those that meet become one; 1: also those that adjoin."""
    none = F.array().cast(RANGES)

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (x["start"] <= last["end"] + gap)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    return F.aggregate(F.sort_array(F.coalesce(ranges, none)), none, add)


def covers(cover: Column, wanted: Column) -> Column:
    """Every integer of wanted lies in the union of cover; adjoining ranges carry on from each other."""
    union = merged(cover, 1)
    return F.forall(wanted, lambda w: F.exists(union, lambda u: (u["start"] <= w["start"]) & (w["end"] <= u["end"])))


def formatted(ranges: Column, none: str = "general / no specific measure") -> Column:
    parts = F.transform(ranges, lambda x: F.when(x["start"] == x["end"], x["start"].cast("string")).otherwise(F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))))
    return F.when(_empty(ranges), F.lit(none)).otherwise(F.array_join(parts, ", "))


def parsed(text: Column) -> Column:
    """`28-30, 12` as ranges; blank is none. Any other form, 0 or a reversed range is an error."""
    plain = F.trim(F.translate(text, "–—−‒", "----"))

    def one(part: Column) -> Column:
        part = F.trim(part)
        start = F.regexp_extract(part, r"^([0-9]+)", 1).cast("int")
        end = F.coalesce(F.nullif(F.regexp_extract(part, r"-\s*([0-9]+)$", 1), F.lit("")).cast("int"), start)
        fine = part.rlike(r"^[0-9]+(\s*-\s*[0-9]+)?$") & (start >= 1) & (end >= start)
        wrong = F.raise_error(F.concat(F.lit("not a range: '"), part, F.lit("'")))
        return F.when(fine, F.struct(start.alias("start"), end.alias("end"))).otherwise(F.from_json(wrong.cast("string"), "struct<start:int,end:int>"))

    return F.when(plain == "", F.array().cast(RANGES)).otherwise(F.transform(F.split(plain, "[,，;]"), one))


def checked(ranges: Column) -> Column:
    """The ranges, or an error if one starts below 1 or ends before its start."""
    fine = F.forall(ranges, lambda x: (x["start"] >= 1) & (x["end"] >= x["start"]))
    return F.when(fine, ranges).otherwise(F.raise_error(F.lit("a range starts below 1 or ends before its start")).cast(RANGES))
