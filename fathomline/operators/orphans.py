"""References to records that do not exist.

Keys are cut into ranges of a 64-bit digest.  Parents are stored as one sorted array per range; references go to the
same range (hot ranges over several salts), and each Arrow batch is probed by one vectorised binary search.  A digest
that is found is confirmed by comparing the keys themselves, so digests never decide alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.session import materialise

_PARENTS_PER_RANGE = 100_000
_REFERENCES_PER_TASK = 100_000
_MOST_SPLITS = 1_000_000  # rows of the table of split ranges, which is broadcast: 12 bytes each


def living_parents(records: DataFrame, key: str, stamp: str, pruned: DataFrame, table_name: str) -> DataFrame:
    """Distinct keys that exist and have no ``pruned`` row later than their newest stamp: one column ``parent_key``.

    A null stamp counts as older than any deletion.  Null keys are left out.
    """
    seen = records.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("parent_key")).agg(F.max(stamp).alias("_seen"))
    gone = pruned.where(F.col("table_name") == table_name).groupBy(F.col("record_key").alias("parent_key")).agg(F.max("pruned_at").alias("_gone"))
    return seen.join(gone, "parent_key", "left").where("_gone is null or _gone <= coalesce(_seen, -9223372036854775808)").select("parent_key")


def _range_of(digest: str, ranges: int) -> str:
    return f"cast((((shiftright({digest}, 40) + 8388608) * {ranges}L) div 16777216L) as int)"


def _probe(key: tuple, refs: pa.Table | Iterator[pa.RecordBatch], parents: pa.Table) -> pa.Table:
    hashes = np.asarray(refs["h"].combine_chunks(), dtype=np.int64) if refs.num_rows else np.empty(0, np.int64)
    lists = parents["entries"].combine_chunks() if parents.num_rows else None
    out_cols = [c for c in refs.column_names if c not in ("h", "rng", "salt")]
    if not refs.num_rows:
        return refs.select(out_cols)
    missing = np.ones(len(hashes), bool)
    if lists is not None and len(lists):
        flat = lists.flatten()
        keys, digests = flat.field("k"), np.asarray(flat.field("h"), dtype=np.int64)
        at = np.searchsorted(digests, hashes, side="left")
        todo = np.flatnonzero(at < len(digests))
        ref_keys = refs["ref_key"].combine_chunks()
        while len(todo):
            todo = todo[digests[at[todo]] == hashes[todo]]
            if not len(todo):
                break
            same = np.asarray(pc.equal(ref_keys.take(pa.array(todo)), keys.take(pa.array(at[todo]))))
            missing[todo[same]] = False
            todo = todo[~same]  # another key with the same digest: look at the next entry
            at[todo] += 1
            todo = todo[at[todo] < len(digests)]
    return refs.filter(pa.array(missing)).select(out_cols)


def missing_references(refs: DataFrame, parents: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The rows of ``refs`` whose ``ref_key`` is not in ``parents.parent_key``.

    ``keys(ref_key)`` are keys in about the numbers of ``refs``, from which the load of the ranges is counted; where
    ``refs`` is costly, the rows that it was made from serve as well.
    ``refs`` has a string column ``ref_key``, neither null nor empty (such rows are no references and are dropped).
    Keys are compared exactly.  A table without parents makes every reference missing.
    """
    spark = refs.sparkSession
    refs = refs.where("ref_key is not null and ref_key <> ''").withColumn("h", F.xxhash64("ref_key"))
    parents = parents.select("parent_key", F.xxhash64("parent_key").alias("h"))
    counted = refs if keys is None else keys.where("ref_key is not null and ref_key <> ''").withColumn("h", F.xxhash64("ref_key"))
    # both numbers are counted in one pass each; ranges follow from the larger of the two loads
    n, m = parents.count(), counted.count()
    ranges = max(2 * spark.sparkContext.defaultParallelism, -(-n // _PARENTS_PER_RANGE), -(-m // (_REFERENCES_PER_TASK // 2)))
    ranges = min(1 << (ranges - 1).bit_length(), 1 << 24)
    per_task = max(_REFERENCES_PER_TASK, m // _MOST_SPLITS)
    load = counted.groupBy(F.expr(_range_of("h", ranges)).alias("rng")).agg(F.count(F.lit(1)).alias("n"))
    # at most m / per_task ranges hold more than that, so the table of split ranges has a bound whatever the input
    split = F.broadcast(materialise(load.where(F.col("n") > per_task).select("rng", F.ceil(F.col("n") / per_task).alias("copies")), "split-ranges"))
    # the salt follows from the row itself, so a task that is run again after a loss sends each row where it went before
    row = F.xxhash64(*[F.col(c) for c in refs.columns if c != "h"])
    left = refs.withColumn("rng", F.expr(_range_of("h", ranges))).join(split, "rng", "left")
    left = left.withColumn("salt", F.pmod(row, F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    arrays = (
        parents.groupBy(F.expr(_range_of("h", ranges)).alias("rng"))
        .agg(F.array_sort(F.collect_list(F.struct("h", F.col("parent_key").alias("k")))).alias("entries"))
        .join(split, "rng", "left")
        .select("rng", "entries", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)).cast("int") - 1)).alias("salt"))
    )
    out_schema = ", ".join(f"{n} {t}" for n, t in refs.dtypes if n != "h")
    return left.groupBy("rng", "salt").cogroup(arrays.groupBy("rng", "salt")).applyInArrow(_probe, out_schema)


def find_orphans(edges: DataFrame, nodes: DataFrame, chunks: DataFrame, pruned: DataFrame) -> DataFrame:
    """Orphan references: ``table_name, field_name, record_id, period``; each (table, field, record) once.

    The reference is that of the record's newest row, the period the UTC month of that row (null where it has no stamp).
    A pruned referrer still counts; a target that arrives later than its referrer is there.  Empty tables give no rows.
    """
    # whole days since the epoch make a date without any time zone
    month = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.expr(f"cast(_s div {86_400 * 10**9}L as int)")), "yyyy-MM").alias("period")
    live_nodes = materialise(living_parents(nodes, "id", "last_seen_at", pruned, "graph_nodes"), "parents")
    newest_edge = edges.where("id is not null").groupBy("id").agg(F.max(F.struct(F.coalesce(F.col("last_seen_at"), F.lit(-1)).alias("_s"), "src_id", "dst_id")).alias("r"))
    edge_refs = newest_edge.select(F.col("id").alias("record_id"), F.expr("nullif(r._s, -1)").alias("_s"), F.explode(F.array(F.struct(F.lit("src_id").alias("field_name"), F.col("r.src_id").alias("ref_key")), F.struct(F.lit("dst_id").alias("field_name"), F.col("r.dst_id").alias("ref_key")))).alias("x"))
    edge_refs = edge_refs.select("record_id", "x.field_name", "x.ref_key", month)
    newest_node = nodes.where("id is not null").groupBy("id").agg(F.max(F.struct(F.coalesce(F.col("last_seen_at"), F.lit(-1)).alias("_s"), "chunk_id")).alias("r"))
    node_refs = newest_node.select(F.col("id").alias("record_id"), F.expr("nullif(r._s, -1)").alias("_s"), F.col("r.chunk_id").cast("string").alias("ref_key"))
    node_refs = node_refs.select("record_id", F.lit("chunk_id").alias("field_name"), "ref_key", month)
    live_chunks = materialise(living_parents(chunks, "id", "last_seen_at", pruned, "chunks"), "parents")
    a = missing_references(edge_refs, live_nodes, edges.select(F.explode(F.array("src_id", "dst_id")).alias("ref_key"))).withColumn("table_name", F.lit("graph_edges"))
    b = missing_references(node_refs, live_chunks, nodes.select(F.col("chunk_id").cast("string").alias("ref_key"))).withColumn("table_name", F.lit("graph_nodes"))
    return a.unionByName(b).select("table_name", "field_name", "record_id", "period")
