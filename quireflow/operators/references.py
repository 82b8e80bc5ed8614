"""References to records that do not exist, are deleted, or arrive later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.plans.workspace import written


@dataclass(frozen=True)
class Reference:
    """``ref_field`` of ``ref_table`` names keys of any table of ``targets``."""

    ref_table: str
    ref_field: str
    targets: tuple[str, ...]

    @property
    def space(self) -> str:
        return "+".join(self.targets)


def _month_start(at: Column) -> Column:
    return F.trunc(at.cast("date"), "month")


def _records(tables: dict[str, DataFrame], keys: dict[str, str], name: str) -> DataFrame:
    """(key, born) of a table: a record's time is its earliest arrival."""
    key = F.col(keys[name])
    return tables[name].where(key.isNotNull() & (key != "")).groupBy(key.alias("key")).agg(F.min("ingested_at").alias("born"))


def _tagged(ids: Column, r: Reference) -> Column:
    return F.transform(ids, lambda k: F.struct(F.lit(r.space).alias("space"), F.lit(r.ref_field).alias("ref_field"), k.alias("key")))


def reference_rows(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference]) -> DataFrame:
    """Every distinct reference: space, key, ref_table, ref_field, record_id, month (first day, of the record's time)."""
    parts = []
    for name in dict.fromkeys(r.ref_table for r in references):
        own = [r for r in references if r.ref_table == name]
        named = []
        for r in own:
            kind = dict(tables[name].dtypes)[r.ref_field]
            ids = F.col(r.ref_field) if kind.startswith("array") else F.array(r.ref_field)
            named.append(_tagged(ids, r))
        named = [F.coalesce(n, F.array().cast("array<struct<space:string,ref_field:string,key:string>>")) for n in named]
        key = F.col(keys[name])
        rows = (
            tables[name]
            .where(key.isNotNull())
            .select(key.alias("record_id"), "ingested_at", F.explode(F.concat(*named)).alias("r"))
            .select("record_id", "ingested_at", "r.*")
            .where(F.col("key").isNotNull() & (F.col("key") != ""))
            .groupBy("record_id", "space", "ref_field", "key")
            .agg(F.min("ingested_at").alias("at"))
        )
        parts.append(rows.select("space", "key", F.lit(name).alias("ref_table"), "ref_field", "record_id", _month_start(F.col("at")).alias("month")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _open_months(refs: DataFrame, tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], tombstones: DataFrame) -> DataFrame:
    """space, key, month, counts (ref_table, ref_field, n) of each key and month that no living parent covers.

    Parents (a target record with its time, its tombstone as end) and children (a reference key with its month) are
    united in long form, tagged, and grouped by parent space and key; children reach that step already counted down to
    one row per key and month, so a hub costs a row a month.
    """
    fields = refs.groupBy("space", "key", "month", "ref_table", "ref_field").agg(F.count(F.lit(1)).alias("n"))
    children = fields.groupBy("space", "key", "month").agg(F.collect_list(F.struct("ref_table", "ref_field", "n")).alias("counts"))  # one a referring field
    none = F.lit(None)
    long = children.select("space", "key", "month", "counts", none.cast("timestamp").alias("born"), none.cast("timestamp").alias("dead"))
    ends = tombstones.groupBy(F.col("record_table").alias("t"), F.col("record_id").alias("key")).agg(F.min("deleted_at").alias("dead"))
    for space in dict.fromkeys(r.space for r in references):
        for target in space.split("+"):
            lives = _records(tables, keys, target).join(ends.where(F.col("t") == target).select("key", "dead"), "key", "left")
            parents = lives.select(F.lit(space).alias("space"), "key", none.cast("date").alias("month"), none.cast(children.schema["counts"].dataType).alias("counts"), "born", "dead")
            long = long.unionByName(parents)
    # Of one key there are at most as many parents as target tables, and at most as many child rows as months.
    grouped = long.groupBy("space", "key").agg(
        F.collect_list(F.when(F.col("month").isNull(), F.struct("born", "dead"))).alias("parents"),
        F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", "counts"))).alias("months"),
    )
    month_end = lambda m: F.add_months(m, 1).cast("timestamp")
    open_ = F.filter(
        "months",
        lambda m: ~F.exists("parents", lambda p: F.coalesce(p["born"] < month_end(m["month"]), F.lit(False)) & F.coalesce(p["dead"] >= month_end(m["month"]), F.lit(True))),
    )
    return grouped.where(F.size("months") > 0).select("space", "key", F.explode(open_).alias("m")).select("space", "key", "m.month", "m.counts")


#: A key with more references in a month than this is hot: its references are scattered over so many parts in the join back.
HOT_REFERENCES, HOT_PARTS = 100_000, 256


def orphan_references(
    tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], tombstones: DataFrame
) -> DataFrame:
    """ref_table, ref_field, record_id, ref_id, period of each reference that nothing alive answers at its month's end.

    Keys and months that no living parent covers are found from counts and joined back to their references; an orphaned
    hub's references are scattered first, its one row copied to each part. A null or empty key is no reference; keys
    compare exactly as stored; a reference given twice counts once; a record without time has no period and is no case;
    tombstones for unknown records change nothing; empty tables give no cases, or make every reference to them one.
    """
    refs = written(reference_rows(tables, keys, references).where(F.col("month").isNotNull()), "refs")
    orphans = _open_months(refs, tables, keys, references, tombstones)
    part = F.pmod(F.xxhash64("record_id"), F.lit(HOT_PARTS)).cast("int")
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    orphans = written(orphans.select("space", "key", "month", (total > HOT_REFERENCES).alias("hot")), "orphans")
    found = refs.join(orphans.where("not hot").drop("hot"), ["space", "key", "month"], "left_semi")
    if not orphans.where("hot").isEmpty():
        copied = orphans.where("hot").select("space", "key", "month", F.explode(F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).alias("part"))
        found = found.unionByName(refs.withColumn("part", part).join(copied, ["space", "key", "month", "part"], "left_semi").drop("part"))
    return found.select(
        "ref_table", "ref_field", "record_id", F.col("key").alias("ref_id"), F.date_format("month", "yyyy-MM").alias("period")
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Given orphan references per referring table, field and month."""
    return orphans.groupBy("ref_table", "ref_field", "period").agg(F.count(F.lit(1)).alias("n_orphans"))


def orphan_totals(
    tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], tombstones: DataFrame
) -> DataFrame:
    """ref_table, ref_field, period, n_orphans: the counts of the keys and months nothing covers, summed; no reference is
    joined back."""
    refs = reference_rows(tables, keys, references).where(F.col("month").isNotNull())
    rows = _open_months(refs, tables, keys, references, tombstones).select("month", F.explode("counts").alias("c")).select("month", "c.*")
    return rows.groupBy("ref_table", "ref_field", F.date_format("month", "yyyy-MM").alias("period")).agg(F.sum("n").alias("n_orphans"))


#: The references of the manual tables.
MANUAL_KEYS = {"chunks": "chunk_id", "elements": "element_id", "graph_nodes": "node_id", "graph_edges": "edge_id"}
MANUAL_REFERENCES = [
    Reference("chunks", "element_ids", ("elements",)),
    Reference("graph_nodes", "evidence_ids", ("elements", "chunks")),
    Reference("graph_edges", "source_id", ("graph_nodes",)),
    Reference("graph_edges", "target_id", ("graph_nodes",)),
]
