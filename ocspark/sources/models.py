"""Constraint models: read from JSON in either form and orientation, filter, write.

A model file is a list of arcs, or an object with constraints whose endpoints are those of
the arc ("constraint_orientation": "arc") or already those of the kind of constraint, in
which a precedence names the earlier activity first. constraints() gives both readings of
each entry; the arc's is what arcs.py checks. A file is small, and so are these frames.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arcs import Arc

#: Names of the arrows as kinds of constraints: fixed values of the format.
KINDS = {"EF": "response", "EP": "precedence", "AS": "responded_existence", "DF": "chain_response", "DP": "chain_precedence"}
#: Kinds under the names of older files, kinds with a least count of 1, and what [0, 0] makes of a kind: fixed values too.
RENAMED = {"direct_response": "chain_response", "direct_precedence": "chain_precedence"}
ONE_AT_LEAST = ["precedence", "response", "chain_precedence", "chain_response", "responded_existence", "chain_succession", "succession"]
NEGATED = {"response": "not_succession", "responded_existence": "not_coexistence", "coexistence": "not_coexistence"}
#: Arrows of kinds that an arc can state; the negated ones have the bounds [0, 0].
ARROWS = {**{k: a for a, k in KINDS.items()}, "not_succession": "EF", "not_precedence": "EP"}

_LABEL = "array<struct<object_type:string>>"
_TEXTS = ["arc_type", "type", "constraint_type", "from", "to", "source", "target", "source_activity", "target_activity", "a", "b", "nmin", "nmax"]
_FIELDS = {
    **{c: "string" for c in _TEXTS},
    "counts": "array<string>",
    "support": "double",
    "guard": "string",
    "involvement_per_label": "map<string,string>",
    "label": f"struct<each:{_LABEL},any:{_LABEL},all:{_LABEL}>",
    "scope": "struct<kind:string,object_type:string,bindings:array<array<string>>,involvement_per_label:map<string,string>>",
}
_ENTRY = ",".join(f"`{k}`:{v}" for k, v in _FIELDS.items())
SCHEMA = ",".join(f"`{k}` {v}" for k, v in _FIELDS.items()) + f", constraint_orientation string, constraints array<struct<{_ENTRY}>>"


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def _labels() -> Column:
    """(otype, mode) of an entry, in the order of the file."""
    own = lambda m: F.when(F.size(m) > 0, F.transform(F.map_entries(m), lambda x: F.struct(x.key.alias("otype"), F.lower(x.value).alias("mode"))))
    pairs = F.when(F.size("scope.bindings") > 0, F.transform("scope.bindings", lambda x: F.struct(x[0].alias("otype"), F.lower(x[1]).alias("mode"))))

    def of(mode: str) -> Column:
        return F.transform(F.coalesce(f"label.{mode}", F.array()), lambda x: F.struct(x.object_type.alias("otype"), F.lit(mode).alias("mode")))

    listed = F.filter(F.concat(of("each"), of("any"), of("all")), lambda x: x.otype.isNotNull())
    primary = F.when(F.length("scope.object_type") > 0, F.array(F.struct(F.col("scope.object_type").alias("otype"), F.lower(F.coalesce("scope.kind", F.lit("each"))).alias("mode"))))
    return F.coalesce(own(F.col("scope.involvement_per_label")), own(F.col("involvement_per_label")), pairs, F.when(F.size(listed) > 0, listed), primary)


def constraints(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry that names a kind and both activities.

    number; kind, source, target, nmin, nmax as the kind of constraint reads; arc, src, tgt,
    lo, hi as the arc does (null where no arc says the same); labels ("type:mode", comma
    between), guarded, support.
    """
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    raw = raw.withColumn("__row", F.monotonically_increasing_id())
    listed = raw.where("constraints is null").select("__row", F.lit(0).alias("__at"), F.lit("list").alias("form"), *[F.col(f"`{c}`") for c in _FIELDS])
    held = raw.select("__row", F.coalesce("constraint_orientation", F.lit("")).alias("o"), F.posexplode("constraints").alias("__at", "c"))
    held = held.select("__row", "__at", F.when(F.col("o") == "arc", "arc").otherwise("kind").alias("form"), "c.*")
    e = listed.unionByName(held)
    as_arc = F.col("form") != "kind"
    given = F.coalesce("constraint_type", "type")
    named = _mapped(KINDS, F.col("arc_type"))
    kind = F.when(F.col("form") == "list", F.coalesce(named, "arc_type", F.lit("unknown"))).when(as_arc | given.isNull(), F.coalesce(named, given)).otherwise(given)
    e = e.withColumn("kind", F.coalesce(_mapped(RENAMED, kind), kind))
    ends = as_arc & F.col("from").isNotNull() & F.col("to").isNotNull()
    first = F.when(ends, F.col("from")).otherwise(F.coalesce("source_activity", "source", "a"))
    second = F.when(ends, F.col("to")).otherwise(F.coalesce("target_activity", "target", "b"))
    e = e.withColumn("first", first).withColumn("second", second).where("kind <> '' and first <> '' and second <> ''")
    backward = F.col("kind").isin("precedence", "chain_precedence")
    swap = as_arc & (backward | ((F.col("form") == "arc") & F.col("arc_type").isin("EP", "DP")))
    counts = as_arc & (F.size("counts") == 2)
    lo = F.when(counts, F.col("counts")[0]).otherwise(F.col("nmin")).try_cast("long")
    hi = F.when(counts, F.col("counts")[1]).otherwise(F.col("nmax")).try_cast("long")
    least = F.when(F.col("form") == "list", F.when(F.col("counts").isNull(), 1).otherwise(0)).when(F.col("kind").isin(ONE_AT_LEAST), 1).otherwise(0)
    e = e.withColumn("lo", F.coalesce(lo, least).cast("long")).withColumn("hi", hi)
    none = (F.col("lo") == 0) & (F.col("hi") == 0) & F.col("kind").isin(list(NEGATED))
    # what an arc says: forms other than "kind" are arcs as they stand
    arrow = F.when(as_arc, F.when(F.col("arc_type").isin(list(KINDS)), F.col("arc_type"))).otherwise(_mapped(ARROWS, F.col("kind")))
    e = e.withColumn("labels", _labels()).withColumn("arc", arrow)
    turned = (~as_arc) & F.col("arc").isin("EP", "DP")
    negative = (~as_arc) & F.col("kind").startswith("not_")
    return e.select(
        (F.row_number().over(_order()) - 1).alias("number"),
        F.when(none, _mapped(NEGATED, F.col("kind"))).otherwise(F.col("kind")).alias("kind"),
        F.when(swap, F.col("second")).otherwise(F.col("first")).alias("source"),
        F.when(swap, F.col("first")).otherwise(F.col("second")).alias("target"),
        F.col("lo").alias("nmin"), F.when(~none, F.col("hi")).alias("nmax"), "arc",
        F.when(turned, F.col("second")).otherwise(F.col("first")).alias("src"),
        F.when(turned, F.col("first")).otherwise(F.col("second")).alias("tgt"),
        F.when(negative, 0).otherwise(F.col("lo")).cast("long").alias("lo"), F.when(negative, 0).otherwise(F.col("hi")).cast("long").alias("hi"),
        F.array_join(F.transform(F.coalesce("labels", F.array()), lambda x: F.concat_ws(":", x.otype, x.mode)), ",").alias("labels"),
        (F.length("guard") > 2).alias("guarded"), "support",
    )


def _order():
    from pyspark.sql import Window

    return Window.orderBy("__row", "__at")  # the entries of one model file


def read_arcs(spark: SparkSession, path: str) -> list[Arc]:
    """The model as arcs to check. Guards and kinds that no arc states are refused."""
    out = []
    for r in constraints(spark, path).orderBy("number").collect():  # one model's entries
        if r.guarded or r.arc is None:
            raise NotImplementedError(f"constraint {r.number}: {'a guard' if r.guarded else r.kind} can't be checked as an arc")
        modes: dict[str, list[str]] = {"each": [], "all": [], "any": []}
        for x in filter(None, r.labels.split(",")):
            otype, mode = x.rsplit(":", 1)
            modes[mode].append(otype)
        out.append(Arc(r.src, r.tgt, r.arc, tuple(modes["each"]), tuple(modes["all"]), tuple(modes["any"]), r.lo, r.hi))
    return out


def filtered(model: DataFrame, text: str = "", special: str = "") -> DataFrame:
    """Constraints with the text in an activity's name; special: 'selfloop' or 'multi_response' keeps those at such an activity."""
    hit = model.where(F.lower("source").contains(text.lower()) | F.lower("target").contains(text.lower()))
    if special == "selfloop":
        at = model.where("source = target").select(F.col("source").alias("x"))
    elif special == "multi_response":
        at = model.where("kind in ('response', 'chain_response', 'alternate_response')").groupBy(F.col("target").alias("x")).count().where("count >= 2")
    else:
        return hit
    at = at.select("x").distinct()
    return hit.join(at, (F.col("source") == F.col("x")) | (F.col("target") == F.col("x")), "left_semi")


def fraction(value: float, name: str, zero: bool = False) -> float:
    """A number in (0, 1], or in [0, 1]; anything else, a boolean or NaN too, is refused."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not (0 < value <= 1 or (zero and value == 0)):
        raise ValueError(f"{name} must be a number in {'[' if zero else '('}0, 1]")
    return float(value)


def model_json(arcs: list[tuple[Arc, float | None]]) -> str:
    """The arcs and their supports as a model in arc orientation, which read_arcs reads back."""
    entries = []
    for a, support in arcs:
        entries.append({
            "constraint_type": KINDS[a.arc], "arc_type": a.arc, "from": a.src, "to": a.tgt, "counts": [a.nmin, a.nmax], "support": support,
            "involvement_per_label": {t: m for m, ts in (("each", a.each), ("all", a.all_), ("any", a.any_)) for t in ts},
        })
    names = sorted({x for a, _ in arcs for x in (a.src, a.tgt)})
    types = sorted({t for a, _ in arcs for t in (*a.each, *a.all_, *a.any_)})
    per_type = {t: sum(a.arc == t for a, _ in arcs) for t in KINDS}
    known = [s for _, s in arcs if s is not None]
    stats = {"n_constraints": len(arcs), "per_arc_type": per_type, "avg_support": round(sum(known) / len(known), 3) if known else None}
    return json.dumps({"constraint_orientation": "arc", "activities": [{"name": n} for n in names], "object_types": [{"name": t} for t in types], "constraints": entries, "stats": stats})


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text (a model, parameters) as the one file of a new folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
