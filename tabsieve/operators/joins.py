"""Joins: checked broadcast, block assembly, prefix and city lookups.

Broadcast rule: a side is broadcast only when its size is bounded by
construction (top-k lists, fixed dimensions) or was counted below
``max_rows``; otherwise the plain join is left to the planner (sort-merge,
AQE may still convert it at runtime and split skewed partitions).
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.operators.profile import c_, q

BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 128 << 20


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      known_rows: int | None = None, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only when the side has at most ``max_rows`` rows and ``max_bytes`` bytes (as text, counted in
    one small aggregate); else the planner joins by shuffle."""
    n = known_rows if known_rows is not None else small.count()
    if n > max_rows:
        return small
    row = F.to_json(F.struct(*[c_(c) for c in small.columns]))
    size = small.agg(F.sum(F.octet_length(row).cast("long"))).first()[0] or 0
    return F.broadcast(small) if size <= max_bytes else small


def materialize(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint fitted state to the shared checkpoint folder; return it with its row count.

    Cuts lineage (the state survives executor loss) and gives the size check
    for the broadcast decision.
    """
    st = df.checkpoint(eager=True)
    return st, st.count()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as it was written once, in columns, to ``path`` (default: a folder of its own in the checkpoint folder).

    Unlike a checkpoint it is compressed, and readers fetch only the columns that they need.
    """
    if any(k in f.dataType.simpleString() for f in df.schema.fields for k in ("void", "interval")):
        return df.checkpoint(eager=True)  # types that files cannot hold
    path = path or scratch_path(df.sparkSession)
    plain = [f"c{i}" for i in range(len(df.columns))]  # any name, also two that differ only in case
    df.toDF(*plain).write.parquet(path)
    return df.sparkSession.read.schema(T.StructType([
        T.StructField(n, f.dataType, True, f.metadata) for n, f in zip(plain, df.schema.fields)])).parquet(path).toDF(*df.columns)


def scratch_path(spark) -> str:
    from tabsieve.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"


def drop_stored(spark, path: str) -> None:
    """Delete a folder of ``stored`` that nothing reads any more, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# ------------------------------------------------------------ block assembly
def assemble_blocks(blocks: list[DataFrame], key: str = "row_id", how: str = "inner") -> DataFrame:
    """Inner-join feature blocks on ``key``; duplicate non-key columns are rejected up front.

    For blocks that are joined more than once, ``store_block`` and ``assemble_stored`` pay the shuffle once.
    """
    _check_blocks(blocks, key)
    return functools.reduce(lambda a, b: a.join(b, on=key, how=how), blocks)


def _check_blocks(blocks: list[DataFrame], key: str) -> None:
    seen: dict[str, int] = {}
    for i, b in enumerate(blocks):
        if key not in b.columns:
            raise ValueError(f"block {i} has no {key} column")
        for c in b.columns:
            if c == key:
                continue
            if c in seen:
                raise ValueError(f"column {c!r} appears in blocks {seen[c]} and {i}")
            seen[c] = i


def store_block(block: DataFrame, table: str, path: str, key: str = "row_id", buckets: int | None = None) -> str:
    """Write a block as table ``table`` at ``path`` (shared storage), bucketed and sorted by ``key``; returns the name.

    Rows are dealt by the bucket hash first, so every bucket is one file. Blocks that are to be joined need the same
    ``buckets`` (default: the shuffle partitions); a bucket should be a few hundred MB of the widest block. An existing
    table of this name is replaced, so a repeated write leaves the same rows.
    """
    n = buckets or int(block.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (block.repartition(n, c_(key)).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(n, key).sortBy(key).saveAsTable(table))
    return table


def assemble_stored(spark, tables: list[str], key: str = "row_id", how: str = "inner") -> DataFrame:
    """Join stored blocks bucket by bucket: sort-merge joins without an exchange.

    Blocks with unlike numbers of buckets are refused, because joining them would shuffle again.
    """
    described = [{r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {q(t)}").collect()} for t in tables]
    layouts = {(d.get("Num Buckets"), d.get("Bucket Columns")) for d in described}
    if len(layouts) != 1 or (None, None) in layouts:
        raise ValueError(f"blocks are bucketed differently: {sorted(map(str, layouts))}")
    blocks = [spark.table(q(t)) for t in tables]
    _check_blocks(blocks, key)
    return functools.reduce(lambda a, b: a.join(b.hint("merge"), on=key, how=how), blocks)


def left_join_fill(df: DataFrame, other: DataFrame, key: str, fill: dict | None = None,
                   max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Left join (e.g. per-order history) and fill NULLs of the joined columns."""
    out = df.join(other, on=key, how="left")
    return out.fillna(fill) if fill else out


def outer_join_rankings(rankings: dict[str, DataFrame], key: str = "feature") -> DataFrame:
    """Full outer join of several (feature, ...) tables, coalescing the key."""
    names = list(rankings)
    out = rankings[names[0]]
    for n in names[1:]:
        out = out.join(rankings[n], on=key, how="full")
    return out


# --------------------------------------------------------- lookup by prefix
def lookup_by_prefix(df: DataFrame, prefix_col: str, ref: DataFrame, ref_prefix: str,
                     ref_value: str, ref_order: str, out: str, unknown: str = "unknown") -> DataFrame:
    """Prefix -> value dictionary where the last duplicate wins (``max_by`` order), default unknown.

    The dictionary is aggregated to one row per prefix before the join.
    """
    dic = ref.groupBy(F.col(ref_prefix).alias("_pfx")).agg(
        F.max_by(F.col(ref_value), F.col(ref_order)).alias("_val"))
    dic, n = materialize(dic)
    j = df.join(checked_broadcast(dic, known_rows=n), df[prefix_col] == F.col("_pfx"), "left")
    return j.withColumn(out, F.coalesce(F.col("_val"), F.lit(unknown))).drop("_pfx", "_val")


# --------------------------------------------------------- city -> region
NAMES_MAX_BYTES = 16 << 20  # names of one automaton, in UTF-8


def _normal_name(c):
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\d{6}", ""), r"[\s,]+", " ")))


def name_blocks(names: DataFrame, max_bytes: int = NAMES_MAX_BYTES) -> list[DataFrame]:
    """The rows (kind, name, normal, region) dealt by hash into blocks of about ``max_bytes`` of names each."""
    size = names.agg(F.sum(F.octet_length("name") + F.octet_length("normal") + F.octet_length(
        F.coalesce("region", F.lit(""))).cast("long"))).first()[0] or 0
    n = -(-size // max_bytes)
    return [names.where(F.pmod(F.xxhash64("kind", "name"), F.lit(n)) == b) for b in range(n)]


def contained_names(values: DataFrame, names: DataFrame, max_bytes: int = NAMES_MAX_BYTES) -> DataFrame:
    """(_v, exact_r, exact_c, len_r, name_r, len_c, name_c, region_c): for every value ``_v`` with normal text ``_vn``
    the names equal to the value, and the longest region and city whose normal name the normal text contains (ties:
    greatest name).

    An Aho-Corasick automaton of the names reads each value once, in Arrow batches; a value of any length is one row.
    A dictionary of more than ``max_bytes`` is dealt into blocks, one automaton after the other, each settled before
    the next is built; the best match of all blocks wins.
    """
    spark, schema = values.sparkSession, ("_v string, exact_r string, exact_c boolean, exact_cr string, len_r int, "
                                          "name_r string, len_c int, name_c string, region_c string")
    found = [spark.createDataFrame([], schema)]
    for block in name_blocks(names, max_bytes):
        shared = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])  # bounded by max_bytes

        def run(batches, shared=shared):
            import ahocorasick
            import pyarrow as pa
            machine, best = ahocorasick.Automaton(), {}
            regions, cities = set(), {}
            for kind, name, normal, region in shared.value:
                if kind == "r":
                    regions.add(name)
                else:
                    cities[name] = region
                if normal:
                    slot = best.setdefault(normal, {})
                    slot[kind] = max(slot.get(kind, ("", None)), (name, region), key=lambda t: t[0])
            for normal, slot in best.items():
                machine.add_word(normal, (len(normal), slot))
            if best:
                machine.make_automaton()
            for batch in batches:
                rows = []
                for value, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    top = {}
                    for _, (length, slot) in (machine.iter(text) if best else ()):
                        for kind, (name, region) in slot.items():
                            if (length, name) > top.get(kind, (0, ""))[:2]:
                                top[kind] = (length, name, region)
                    r, c = top.get("r", (None, None, None)), top.get("c", (None, None, None))
                    here = value in cities
                    if top or here or value in regions:
                        rows.append((value, value if value in regions else None, here, cities.get(value), *r[:2], *c))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[i] for row in rows], t) for i, t in enumerate(
                        [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.int32(),
                         pa.string(), pa.string()])], [part.split()[0] for part in schema.split(", ")])
        part, _ = materialize(values.select("_v", "_vn").mapInArrow(run, schema))
        shared.unpersist()
        found.append(part)
    long = functools.reduce(DataFrame.unionByName, found)
    pick = lambda what, size, name: F.max_by(what, F.when(F.col(size).isNotNull(), F.struct(size, name)))
    return long.groupBy("_v").agg(
        F.max("exact_r").alias("exact_r"), F.max(F.when(F.col("exact_c"), F.col("exact_cr"))).alias("exact_c"),
        pick("name_r", "len_r", "name_r").alias("name_r"), pick("region_c", "len_c", "name_c").alias("region_c"))


def map_city_to_region(df: DataFrame, city_col: str, regions: DataFrame, region_col: str,
                       cities: DataFrame, city_name_col: str, city_region_col: str,
                       out: str, max_bytes: int = NAMES_MAX_BYTES) -> DataFrame:
    """Map free-text city to a region.

    Order of rules: exact region name, exact city name, then after stripping a
    6-digit postcode and normalising: longest region name contained, longest
    city name contained, else the original text.

    Only the *distinct* city values take part; an automaton of all names reads each of them once
    (``contained_names``). The mapping comes back by a join that broadcasts it only below the row and byte limits.
    """
    reg = regions.select(F.col(region_col).alias("name")).where("name is not null").distinct().select(
        F.lit("r").alias("kind"), "name", _normal_name(F.col("name")).alias("normal"), F.lit(None).cast("string").alias("region"))
    cit = (cities.where(F.col(city_name_col).isNotNull()).groupBy(F.col(city_name_col).alias("name"))
           .agg(F.min(F.col(city_region_col)).alias("region"))
           .select(F.lit("c").alias("kind"), "name", _normal_name(F.col("name")).alias("normal"), "region"))
    names, _ = materialize(reg.unionByName(cit))
    values, _ = materialize(df.select(F.col(city_col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
                            .withColumn("_vn", _normal_name(F.col("_v"))))
    m = contained_names(values, names, max_bytes).select(
        "_v", F.coalesce("exact_r", "exact_c", "name_r", "region_c", "_v").alias("_mapped"))
    m, n = materialize(m)
    j = df.join(checked_broadcast(m, known_rows=n), df[city_col] == F.col("_v"), "left")
    return j.withColumn(out, F.coalesce(F.col("_mapped"), df[city_col])).drop("_v", "_mapped")


def explode_cities(df: DataFrame, list_col: str, keep: list[str], out: str = "city") -> DataFrame:
    """Comma-separated list cell -> one row per trimmed, non-empty item; distinct rows."""
    items = df.select(*keep, F.explode(F.split(F.col(list_col), ",")).alias("_item"))
    return (items.select(*keep, F.trim(F.col("_item")).alias(out))
            .where(F.col(out) != "").distinct())


def rank_within(partition_cols, order_cols):
    return F.row_number().over(Window.partitionBy(*partition_cols).orderBy(*order_cols))
