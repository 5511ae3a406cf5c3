"""Data-quality rules: declared constraints as one rule engine.

``check`` evaluates every rule as a Boolean column in one pass and returns
one row per rule. A CHECK constraint passes when its predicate is NULL, so a
row violates a rule only when the predicate is false.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.keys import spread

# Fixed value: the rejection message of the id check.
REJECT_MESSAGE = "jeune_cin invalide : CIN non trouve dans cin_beneficiaires_valides"


@dataclass
class Rule:
    name: str
    predicate: Column  # true (or NULL) when the row satisfies the rule


def not_null(*cols: str) -> list[Rule]:
    return [Rule(f"not_null:{c}", F.col(c).isNotNull()) for c in cols]


def in_list(col: str, values: list[str]) -> Rule:
    return Rule(f"in_list:{col}", F.col(col).isin(values))


def violated(r: Rule) -> Column:
    return ~F.coalesce(r.predicate, F.lit(True))


def check(df: DataFrame, rules: list[Rule], table: str) -> DataFrame:
    """-> (table, rule, n_violations): all rules counted in a single scan."""
    counts = df.agg(*[F.count_if(violated(r)).alias(f"r{i}") for i, r in enumerate(rules)])
    names = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("n")) for i, r in enumerate(rules)])
    return counts.select(F.inline(names)).select(F.lit(table).alias("table_name"), "rule",
                                                  F.col("n").alias("n_violations"))


def violations(df: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """Row-level detail: (key..., rule) for every violated rule of every row."""
    tags = F.filter(F.array(*[F.when(violated(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return df.select(*key, F.explode(tags).alias("rule"))


def check_unique(df: DataFrame, keys: list[str], table: str, rows: int | None = None) -> DataFrame:
    """-> (table, key, n_duplicate_keys, n_rows_in_duplicates): keys seen more than once.

    The per-key count is a partial (map-side) aggregate, so a hot key costs
    one counter per task, not one row per occurrence. A frame of many ``rows`` is hashed by key before it, into
    tasks by their number: its keys are nearly all different, and a task would hold a counter for each."""
    dup = spread(df.select(*keys), rows, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return dup.agg(F.count(F.lit(1)).alias("n_duplicate_keys"),
                   F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows_in_duplicates")).select(
        F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key"), "n_duplicate_keys", "n_rows_in_duplicates")


@dataclass
class ForeignKey:
    """A declared relationship: the child's columns name a row of the parent by its columns."""

    name: str
    child: str
    child_keys: list[str]
    parent: str
    parent_keys: list[str]


def _key(cols: list[str]) -> Column:
    """One text for a key of one or several columns (NULL when any part is)."""
    parts = [F.col(c).cast("string") for c in cols]
    whole = parts[0] if len(parts) == 1 else F.concat_ws("\x1f", *parts)
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in parts]), whole)


def check_fks(frames: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """-> (relationship, n_violations) of all relationships: child rows whose non-NULL key has no parent.

    Parents and children are one stream of (parent, key, relationship, number of children) rows, and one aggregate by
    (parent, key) tells which keys have a parent and how many children of each relationship ask for them. Keys of one
    column are counted as they are, each relationship by itself, before they become text: a key that a third of all
    children share is a few rows, and the stream holds different keys only. Keys of several columns and those of parents
    seldom repeat and go straight into the stream. A frame is read once for each of its relationships and for each key
    it is the parent of, with the columns of that key alone: keep one that is not read cheaply."""
    parents = list(dict.fromkeys((k.parent, tuple(k.parent_keys)) for k in keys))
    tag = {p: i for i, p in enumerate(parents)}
    rank: dict[int, int] = {}
    slot = []                                   # place of a relationship among those of its parent
    for k in keys:
        t = tag[k.parent, tuple(k.parent_keys)]
        slot.append(rank.get(t, 0))
        rank[t] = slot[-1] + 1
    entry = lambda df, t, s, cols, n: df.select(F.lit(t).alias("parent"), F.lit(s).alias("slot"), _key(cols).alias("key"),
                                                n.alias("n")).where("key IS NOT NULL")
    one = F.lit(1).cast("long")
    entries = [entry(frames[frame], t, -1, list(cols), one) for (frame, cols), t in tag.items()]
    for k, s in zip(keys, slot):
        t, df = tag[k.parent, tuple(k.parent_keys)], frames[k.child]
        if len(k.child_keys) == 1:
            (c,) = k.child_keys
            counts = df.select(F.col(c).alias("_k")).where("_k IS NOT NULL").groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
            entries.append(entry(counts, t, s, ["_k"], F.col("_n")))
        else:
            entries.append(entry(df, t, s, k.child_keys, one))
    rows = reduce(DataFrame.unionByName, entries)
    width = max(rank.values())
    counted = rows.groupBy("parent", "key").agg(F.max(F.col("slot") == -1).alias("there"),
                                                *[F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(width)])
    orphans = counted.groupBy("parent").agg(*[F.sum(F.when(F.col("there"), 0).otherwise(F.col(f"c{i}"))).alias(f"c{i}") for i in range(width)])
    named = F.array(*[F.struct(F.lit(k.name).alias("relationship"), F.lit(tag[k.parent, tuple(k.parent_keys)]).alias("p"), F.lit(s).alias("s"))
                      for k, s in zip(keys, slot)])
    # a row per parent, then a row per relationship; a parent without any row has none either
    found = orphans.agg(F.map_from_entries(F.collect_list(F.struct("parent", F.array(*[f"c{i}" for i in range(width)])))).alias("m"))
    return found.select("m", F.inline(named)).select(
        "relationship", F.coalesce(F.element_at(F.try_element_at("m", F.col("p")), F.col("s") + 1), F.lit(0)).cast("long").alias("n_violations"))


def check_fk(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str],
             name: str) -> DataFrame:
    """-> (relationship, n_violations): non-NULL child keys without a parent (G6, J16), of one relationship."""
    return check_fks({"child": child, "parent": parent}, [ForeignKey(name, "child", child_keys, "parent", parent_keys)])


def validate_ids(rows: DataFrame, mirror: DataFrame, id_col: str = "jeune_cin") -> DataFrame:
    """Each row's national id must be in the mirror; a NULL id passes.

    Adds ``accepted`` and ``message``. The mirror is distinct ids, joined by
    shuffle (it grows with the population)."""
    m = mirror.select(F.col("cin").alias("_cin")).distinct().withColumn("_hit", F.lit(True))
    out = rows.join(m, F.col(id_col) == F.col("_cin"), "left")
    ok = F.col(id_col).isNull() | F.col("_hit").isNotNull()
    return out.withColumn("accepted", ok).withColumn(
        "message", F.when(ok, F.lit(None).cast("string")).otherwise(
            F.lit(REJECT_MESSAGE))).drop("_cin", "_hit")


def validate_changes(old: DataFrame, new: DataFrame, key: str, mirror: DataFrame,
                     id_col: str = "jeune_cin") -> DataFrame:
    """Update check: only rows whose id became non-NULL and differs from the old one."""
    o = old.select(F.col(key).alias("_k"), F.col(id_col).alias("_old"))
    changed = new.join(o, F.col(key) == F.col("_k"), "left").filter(
        F.col(id_col).isNotNull() & ~F.col("_old").eqNullSafe(F.col(id_col))).drop("_k", "_old")
    return validate_ids(changed, mirror, id_col)


def refresh_mirror(ids: DataFrame, col: str = "cin") -> DataFrame:
    """Mirror refresh: the distinct non-NULL ids of the source."""
    return ids.filter(F.col(col).isNotNull()).select(F.col(col).alias("cin")).distinct()
