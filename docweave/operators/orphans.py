"""References to records that do not exist, direct and inherited.

A foreign-key graph is a set of tables and a list of :class:`Reference`.
Direct orphans are found by one aggregate per key and one join for all
references.  The cascade then treats records that refer to orphaned records as
orphans themselves: waves of semi-joins run down the graph until a wave is
empty.  Direct orphans are level 0 of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import cut

#: Waves after which the keys found so far are written as one set; the number doubles each time.
WAVES = 16


@dataclass(frozen=True)
class Reference:
    """``child.field`` names ``parent.key``, within the same ``scope`` (a column of both) or everywhere.

    ``row_id`` identifies a row of the child; its last column is reported.
    ``made_at`` is the time of the reference, ``known_at`` that from which a
    row of the parent is there, ``deleted_at`` is set if it is no more; without
    one of these columns nothing is late, or nothing deleted.
    """

    child: str
    field: str
    parent: str
    key: str
    scope: str | None
    row_id: tuple[str, ...]
    made_at: str | None
    known_at: str | None
    deleted_at: str | None = "deleted_at"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _scope(r: Reference) -> Column:
    return F.col(r.scope).cast("string") if r.scope else F.lit("")


def _rows(tables: dict[str, DataFrame], references: list[Reference], own: dict[str, Reference]) -> DataFrame:
    """One row per reference: ``table, id, own_scope, field, parent, scope, key, made_at``.

    ``id`` is what other tables call the row by (``own``), else its row id.
    Each table is read once for all of its references; null and empty
    references, and those in a null scope, are left out.
    """
    out = []
    for name in dict.fromkeys(r.child for r in references):
        mine = [r for r in references if r.child == name]
        fields = F.array(*[F.struct(F.lit(r.field).alias("field"), F.lit(r.parent).alias("parent"), _scope(r).alias("scope"), F.col(r.field).cast("string").alias("key")) for r in mine])
        known = own.get(name)
        made_at = F.col(mine[0].made_at) if mine[0].made_at else F.lit(None).cast("timestamp_ntz")
        rows = tables[name].select(F.lit(name).alias("table"), F.col(known.key if known else mine[0].row_id[-1]).alias("id"), (_scope(known or mine[0])).alias("own_scope"), made_at.alias("made_at"), F.explode(fields).alias("_r"))
        rows = rows.select("table", "id", "own_scope", "made_at", "_r.field", "_r.parent", "_r.scope", "_r.key").where("key is not null and key <> '' and scope is not null")
        out.append(rows.where("id is not null and own_scope is not null") if known else rows)
    if len(out) > 1:  # ids of one type
        out = [rows.withColumn("id", F.col("id").cast("string")) for rows in out]
    return _union(out)


def _states(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """One row per key of a parent: ``parent, scope, key``, whether a row is live, and since when."""
    out, types = [], [tables[r.parent].schema[r.known_at].dataType for r in references if r.known_at]
    for r in {(r.parent, r.scope, r.key): r for r in references}.values():
        live = F.col(r.deleted_at).isNull() if r.deleted_at else F.lit(True)
        since = F.col(r.known_at) if r.known_at else F.lit(None).cast(types[0] if types else "timestamp_ntz")
        key = F.col(r.key).cast("string")
        keyed = tables[r.parent].select(F.lit(r.parent).alias("parent"), _scope(r).alias("scope"), key.alias("key"), F.when(live, since).alias("_since"), live.alias("_live")).where("key is not null and key <> ''")
        out.append(keyed.groupBy("parent", "scope", "key").agg(F.min("_since").alias("_since"), F.max("_live").alias("_live")))
    return _union(out)


def _reason() -> Column:
    return F.when(F.col("_live").isNull(), "missing").when(~F.col("_live"), "deleted").when(F.col("_since") > F.col("made_at"), "late")


def _found(tables: dict[str, DataFrame], references: list[Reference], own: dict[str, Reference], orphaned: DataFrame | None = None) -> DataFrame:
    """The references that are orphans: direct ones and, given the ``orphaned`` records, inherited ones; repeated rows as they are.

    All references go through one join with the states of all keys, which hold
    one row per key, so a key that a third of the rows refer to is skewed on
    one side only, where AQE splits it.
    """
    keys = ["parent", "scope", "key"]
    states = _states(tables, references).withColumn("_level", F.lit(None).cast("int"))
    if orphaned is not None:
        states = states.drop("_level").join(orphaned.select(F.col("table").alias("parent"), F.col("own_scope").alias("scope"), F.col("id").alias("key"), F.col("level").alias("_level")), keys, "left")
    joined = _rows(tables, references, own).join(states, keys, "left").withColumn("_why", _reason())
    level = F.when(F.col("_why").isNotNull(), 0).otherwise(F.col("_level") + 1)
    return joined.select("table", "own_scope", "id", "field", F.coalesce("_why", F.when(F.col("_level").isNotNull(), F.lit("parent"))).alias("reason"), level.alias("level"), "made_at").where("reason is not null")


def orphan_references(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """The direct orphans of one child table: its row id, ``field`` and ``reason``, each once.

    ``reason`` is ``missing`` if no row has the key, else ``deleted`` if all
    rows with it are deleted, else ``late`` if the earliest live row is younger
    than the reference.  Null and empty references, and references in a null
    scope, are none.  Repeated rows count once.  Extra columns are ignored.
    This is level 0 of :func:`orphan_graph` for one table.
    """
    if len({r.child for r in references}) != 1:
        raise ValueError("references of one table are needed")
    return _found(tables, references, {}).select(F.col("id").alias(references[0].row_id[-1]), "field", "reason").distinct()


def orphan_graph(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """Direct and inherited orphans of all tables of a foreign-key graph.

    Result: ``table``, ``scope``, ``id``, ``field``, ``kind`` (direct or
    inherited), ``reason`` (of a direct orphan, or ``parent``), ``level`` (0
    for direct), ``made_at``.  A record inherits if it refers to an orphaned
    record and is no orphan by itself.  In tables to which others refer, the
    rows of one key are one record, which inherits once, by the shortest way;
    in other tables each reference inherits for itself.

    Only tables that have children take part in the waves.  A wave visits only
    the references whose parents the wave before has reached, and is added to
    the ones before without writing these again.  Cycles end because a wave
    only holds keys not yet orphaned.
    """
    own: dict[str, Reference] = {}
    for r in references:
        known = own.setdefault(r.parent, r)
        if (known.key, known.scope) != (r.key, r.scope):
            raise ValueError(f"{r.parent} is referred to by two different keys")
    inner = [r for r in references if r.child in own]
    outer = [r for r in references if r.child not in own]
    identity = ["table", "own_scope", "id"]
    results, orphaned = [], None
    if inner:
        direct = _found(tables, inner, own).withColumn("id", F.col("id").cast("string"))
        direct = cut(direct.groupBy(*identity, "field").agg(F.min("reason").alias("reason"), F.min("made_at").alias("made_at"), F.lit(0).alias("level")))
        wave = direct.select(*identity, "level").distinct()
        waves, written, level = [wave], WAVES, 0
        edges = {r: cut(_rows(tables, [r], own).withColumn("id", F.col("id").cast("string")).distinct()) for r in inner if r.child == r.parent}
        results.append(direct)
        while True:
            level += 1
            reached = {row["table"] for row in wave.select("table").distinct().collect()}  # at most one row per table
            steps = []
            for r in inner:
                if r.parent in reached:
                    rows = edges.get(r)
                    rows = _rows(tables, [r], own).withColumn("id", F.col("id").cast("string")) if rows is None else rows
                    keys = wave.where(F.col("table") == r.parent).select(F.col("own_scope").alias("scope"), F.col("id").alias("key"))
                    steps.append(rows.join(keys, ["scope", "key"], "left_semi").select(*identity, "field", "made_at"))
            if not steps:
                break
            met = _union(steps).groupBy(*identity).agg(F.min("field").alias("field"), F.min("made_at").alias("made_at"))
            new = cut(met.join(_union(waves).select(*identity), identity, "left_anti").withColumn("reason", F.lit("parent")).withColumn("level", F.lit(level)))
            wave = new.select(*identity, "level")
            if wave.isEmpty():
                break
            results.append(new)
            waves.append(wave)
            if len(waves) > written:
                waves, written = [cut(_union(waves))], 2 * written
        orphaned = _union(waves)
    if outer:
        found = _found(tables, outer, own, orphaned).withColumn("id", F.col("id").cast("string"))
        results.append(found.distinct())
    kind = F.when(F.col("level") == 0, "direct").otherwise("inherited").alias("kind")
    return _union([f.select("table", F.col("own_scope").alias("scope"), "id", "field", kind, "reason", "level", "made_at") for f in results])


def orphan_report(orphans: DataFrame, period: str = "month", time_column: str = "made_at") -> DataFrame:
    """Counts per ``table``, ``field``, ``kind``, ``reason`` and period (its first instant; null stays a period of its own)."""
    return orphans.groupBy("table", "field", "kind", "reason", F.date_trunc(period, F.col(time_column)).alias("period")).agg(F.count(F.lit(1)).alias("n"))
