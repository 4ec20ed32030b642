"""Three-way merges, conflicts and their resolution.

Two merges with different rules live here. :func:`merge_deltas` works on two deltas and treats
every key both sides touched as a conflict. :func:`merge_rows` works on whole tables and also
accepts identical edits and one-sided deletes; :func:`merge_columns` adds column-level resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowtrail.functions.text import pk_key
from rowtrail.operators.changes import replace_rows
from rowtrail.operators.diff import aligned, diff_rows, full_join, op_of
from rowtrail.plans import cut

# Resolution strategies, the first one is the default.
STRATEGIES = ["ours", "theirs", "ancestor", "delete", "workingcopy"]


def _last_per_key(delta: DataFrame, keys: list[str], seq: str | None, prefix: str) -> DataFrame:
    keyed = delta.select(pk_key(delta, keys).alias("pk_key"), F.struct(*keys, "op", "old", "new").alias(prefix),
                         *([F.col(seq).alias("_seq")] if seq else []))
    if seq is None:
        return keyed
    # The aggregate holds numbers only; rows join it.
    top = keyed.groupBy("pk_key").agg(F.max("_seq").alias("_top"))
    return keyed.join(top, "pk_key").filter(F.col("_seq") == F.col("_top")).dropDuplicates(["pk_key"]).select("pk_key", prefix)


def classify_conflict(ours_op: Column, theirs_op: Column) -> Column:
    """BothAdded for two inserts, ModifyDelete for an update against a delete, else BothModified."""
    pair = F.concat(ours_op, theirs_op)
    return F.when(pair == "II", "BothAdded").when(pair.isin("UD", "DU"), "ModifyDelete").otherwise("BothModified")


def merge_deltas(ours: DataFrame, theirs: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Strict merge of two deltas.

    A key one side touched is ``resolved`` (FastForward) with that side's new values, and gives no
    row when that side deleted it. A key both sides touched is always a ``conflict``; its ancestor
    is the old row of ours. With ``seq``, a key repeated on one side counts by its last row.
    """
    joined = _last_per_key(ours, keys, seq, "o").join(_last_per_key(theirs, keys, seq, "t"), "pk_key", "full")
    o, t = F.col("o"), F.col("t")
    both = o.isNotNull() & t.isNotNull()
    values = F.when(~both, F.coalesce(o["new"], t["new"]))
    return joined.filter(both | o["new"].isNotNull() | t["new"].isNotNull()).select(
        *[F.coalesce(o[k], t[k]).alias(k) for k in keys],
        "pk_key",
        F.when(both, "conflict").otherwise("resolved").alias("status"),
        F.when(~both, "FastForward").alias("resolution"),
        F.when(both, classify_conflict(o["op"], t["op"])).alias("conflict_type"),
        values.alias("values"),
        F.when(both, o["old"]).alias("ancestor"),
        F.when(both, o["new"]).alias("ours"),
        F.when(both, t["new"]).alias("theirs"),
    )


def merge_rows(
    base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], keys_not_null: bool = False
) -> DataFrame:
    """Row-level three-way merge of whole tables: the keys at least one side changed.

    ``status`` is ``ours``, ``theirs``, ``identical`` or ``conflict``. ``merged`` is the accepted
    row, NULL for a deletion or a conflict; ``op`` relates it to the base row and is NULL for a
    conflict.

    Both sides are diffed against the base first, so each table is exchanged once (the exchange of
    the base serves both diffs) and only changed rows meet in the last join.
    """
    # Columns of all three versions, in common types; what a version lacks is NULL there.
    names = [c for c in base.columns if c not in keys]
    names += [c for c in dict.fromkeys([*ours.columns, *theirs.columns]) if c not in keys and c not in names]
    base, ours, theirs = (
        aligned(x, keys, names, *others)
        for x, *others in ((base, ours, theirs), (ours, base, theirs), (theirs, base, ours))
    )

    def changes(side: DataFrame, name: str) -> DataFrame:
        delta = diff_rows(base, side, keys, keys_not_null)
        return delta.select(*keys, F.struct("old", "new").alias(name))

    joined = full_join(changes(ours, "o"), changes(theirs, "t"), keys, keys_not_null)
    o, t = F.col("o"), F.col("t")
    old = F.when(o.isNotNull(), o["old"]).otherwise(t["old"])
    # A side without a change has the base row.
    rows = joined.select(
        *keys,
        F.when(t.isNull(), "ours").when(o.isNull(), "theirs").when(o["new"].eqNullSafe(t["new"]), "identical")
        .otherwise("conflict").alias("status"),
        old.alias("base"),
        F.when(o.isNotNull(), o["new"]).otherwise(old).alias("ours"),
        F.when(t.isNotNull(), t["new"]).otherwise(old).alias("theirs"),
    )
    status = F.col("status")
    merged = F.when(status == "theirs", F.col("theirs")).when(status != "conflict", F.col("ours"))
    rows = rows.withColumn("merged", merged)
    op = F.when(status != "conflict", op_of(F.col("base"), F.col("merged")))
    return rows.select(*keys, "status", op.alias("op"), "base", "ours", "theirs", "merged")


def merge_columns(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Three-way merge that resolves two updates of one row column by column.

    ``resolution`` is FastForward, IdenticalChanges, ColumnMerge or Conflict.
    """
    rows = merge_rows(base, ours, theirs, keys)
    names = rows.schema["base"].dataType.names
    b, o, t = F.col("base"), F.col("ours"), F.col("theirs")
    fields, clashes = [], []
    for c in names:
        ours_kept, theirs_kept = o[c].eqNullSafe(b[c]), t[c].eqNullSafe(b[c])
        fields.append(F.when(ours_kept, t[c]).otherwise(o[c]).alias(c))
        clashes.append(~ours_kept & ~theirs_kept & ~o[c].eqNullSafe(t[c]))
    clash = clashes[0]
    for more in clashes[1:]:
        clash = clash | more
    complete = b.isNotNull() & o.isNotNull() & t.isNotNull()
    mergeable = (F.col("status") == "conflict") & complete & ~clash
    resolution = (
        F.when(F.col("status").isin("ours", "theirs"), "FastForward")
        .when(F.col("status") == "identical", "IdenticalChanges")
        .when(mergeable, "ColumnMerge")
        .otherwise("Conflict")
    )
    merged = F.when(mergeable, F.struct(*fields)).otherwise(F.col("merged"))
    return rows.select(*keys, resolution.alias("resolution"), "base", "ours", "theirs", merged.alias("merged"))


def list_conflicts(merged: DataFrame) -> DataFrame:
    """Rows whose merge is a conflict."""
    return merged.filter(F.col("status") == "conflict")


def count_conflicts(merged: DataFrame) -> DataFrame:
    """One row: ``conflicts`` and ``has_conflicts``."""
    n = F.count_if(F.col("status") == "conflict")
    return merged.agg(n.alias("conflicts"), (n > 0).alias("has_conflicts"))


def _resolved(conflicts: DataFrame, keys: list[str], row: Column) -> DataFrame:
    return conflicts.select(*keys, F.when(row.isNull(), "D").otherwise("U").alias("op"), row.alias("resolved"))


def resolve(
    conflicts: DataFrame,
    keys: list[str],
    strategy: str = "ours",
    working_copy: DataFrame | None = None,
    only: dict | None = None,
) -> DataFrame:
    """Resolve conflicts by ``strategy``; ``only`` names the key values of a single conflict.

    Returns the keys, ``op`` (U, or D where the chosen side has no row) and the ``resolved`` struct.
    The ancestor is the merge base's row.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    for name, value in (only or {}).items():
        conflicts = conflicts.filter(F.col(name).eqNullSafe(F.lit(value)))
    if strategy == "workingcopy":
        if working_copy is None:
            raise ValueError("the workingcopy strategy needs the working copy")
        names = [c for c in working_copy.columns if c not in keys]
        current = working_copy.select(*keys, F.struct(*names).alias("_current"))
        return _resolved(conflicts.join(current, keys, "left"), keys, F.col("_current"))
    if strategy == "delete":
        row = F.lit(None).cast(conflicts.schema["ours"].dataType)
    else:
        ancestor = "ancestor" if "ancestor" in conflicts.columns else "base"
        row = F.col(ancestor if strategy == "ancestor" else strategy)
    return _resolved(conflicts, keys, row)


def resolve_with(conflicts: DataFrame, replacements: DataFrame, keys: list[str]) -> DataFrame:
    """Resolve the conflicts that ``replacements`` has a row for; the others are not returned."""
    names = [c for c in replacements.columns if c not in keys]
    rows = replacements.select(*keys, F.struct(*names).alias("_row"))
    return _resolved(conflicts.join(rows, keys), keys, F.col("_row"))


def replacements_from_json(features: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Replacement rows out of GeoJSON Feature texts: their ``properties`` read by ``schema``."""
    feature = T.StructType([T.StructField("properties", schema)])
    return features.select(F.from_json(column, feature).alias("_f")).select("_f.properties.*")


class UnresolvedConflicts(ValueError):
    """A merge was finished while conflicts remained."""


def finish_merge(base: DataFrame, merged: DataFrame, resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """The merged table out of the base, the :func:`merge_rows` result and conflict resolutions.

    Raises :class:`UnresolvedConflicts` while a conflict has no resolution. The changed rows are
    written once; the base is only scanned when they prove small enough to broadcast.
    """
    merged, resolutions = cut(merged), cut(resolutions)
    if not list_conflicts(merged).join(resolutions, keys, "left_anti").isEmpty():
        raise UnresolvedConflicts("conflicts remain")
    accepted = merged.filter(F.col("merged").isNotNull()).select(*keys, "merged.*")
    chosen = resolutions.filter(F.col("op") != "D").select(*keys, "resolved.*")
    return replace_rows(base, merged, accepted.unionByName(chosen), keys)
