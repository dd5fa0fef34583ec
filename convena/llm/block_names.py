"""Exact de-duplication by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Sorting the distinct blocks gives each an integer name; then adjacent
names are paired, the sorted distinct pairs are named in turn, and so on until one name is left for each document. Equal
names at equal levels mean equal texts, as every name stands for one content: there is no fingerprint to collide.

A block or pair that occurs once in the corpus proves that its document has no copy, so the document leaves the recursion there.
Only documents whose every block recurs have their content shuffled; what is counted before that is 8-byte block hashes, which
prune and never decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, SMALL_KEYS, bounded, dealt_join, materialise, stored, with_row_id, wrapped

#: Bytes in a block: most documents have one block, the longest some dozens, and a level of pairing halves that.
BLOCK_BYTES = 2048


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(_rid, _n, _i, _block): an empty text has one empty block."""
    size = F.octet_length("_text")
    n = F.greatest(F.ceil(size / block_bytes).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("_text").cast("binary"), i * block_bytes + 1, F.lit(block_bytes)))
    return rows.select("_rid", n.alias("_n"), F.posexplode(cut).alias("_i", "_block"))


def _named(distinct: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Distinct keys, sorted within their partitions, with an integer name each: place of the partition, then rank. Written, so that names hold when a task is run again."""
    return materialise(distinct.sortWithinPartitions(*keys).withColumn("_name", F.monotonically_increasing_id()), tag)


def _identities(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(_rid, _level, _name) of the documents all of whose blocks recur; equal (_level, _name) if and only if equal text."""
    hashed = _blocks(rows, block_bytes).select("_rid", "_n", F.xxhash64("_block").alias("_h"))
    recurring = materialise(hashed.groupBy("_h").agg(F.count("*").alias("_c")).filter("_c > 1").select("_h"), "op3-recurring")
    inside = dealt_join(hashed, recurring, ["_h"], "_rid", BROADCAST_KEYS).groupBy("_rid", "_n").agg(F.count("*").alias("_c")).filter("_c = _n").select("_rid")
    inside = materialise(inside, "op3-rows")
    blocks = _blocks(rows.join(bounded(inside), "_rid", "left_semi"), block_bytes)
    names = _named(blocks.groupBy("_block").agg(F.count("*").alias("_c")).filter("_c > 1").select("_block"), ["_block"], "op3-blocks")
    level, done = 0, None
    now = materialise(blocks.join(bounded(names, SMALL_KEYS), "_block").select("_rid", "_n", "_i", "_name"), "op3-level")
    while True:
        ended = now.filter("_n = 1").select("_rid", F.lit(level).alias("_level"), "_name")
        done = ended if done is None else done.unionByName(ended)
        rest = now.filter("_n > 1")
        if rest.isEmpty():
            return done
        # A missing half was unique: its document has no copy. Only the last pair of an odd row of names lacks a right half by nature.
        pairs = rest.groupBy("_rid", "_n", F.expr("_i div 2").cast("int").alias("_j")).agg(
            F.max(F.when(F.col("_i") % 2 == 0, F.col("_name"))).alias("_a"), F.max(F.when(F.col("_i") % 2 == 1, F.col("_name"))).alias("_b")
        )
        tail = (F.col("_n") % 2 == 1) & (F.col("_j") == F.expr("_n div 2"))
        pairs = pairs.withColumn("_b", F.when(tail, F.lit(-1)).otherwise(F.col("_b"))).filter("_a is not null and _b is not null")
        pairs = materialise(pairs.select("_rid", F.ceil(F.col("_n") / 2).cast("int").alias("_n"), F.col("_j").alias("_i"), "_a", "_b"), "op3-pairs")
        names = _named(pairs.groupBy("_a", "_b").agg(F.count("*").alias("_c")).filter("_c > 1").select("_a", "_b"), ["_a", "_b"], "op3-names")
        now = materialise(dealt_join(pairs, names, ["_a", "_b"], "_rid", BROADCAST_KEYS >> 2).select("_rid", "_n", "_i", "_name"), "op3-level")
        level += 1


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and the row's place ``_rid``.

    Texts are equal when their UTF-8 bytes are; a null text counts as an empty one. Of equal texts the row with the largest id
    stays (null ids are smallest); of rows that share that id too, the last in the input stays, so exactly one row of a group is
    kept. Columns other than the two named are ignored and may have any name. An empty table gives an empty result. ``docs`` is written once if it doesn't come straight from files.
    """
    rows = with_row_id(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_rid")
    same = materialise(_identities(rows, block_bytes).join(rows.select("_rid", "_id"), "_rid"), "op3-same")
    groups = same.groupBy("_level", "_name").agg(F.max(F.struct("_id", "_rid")).alias("_keep"), F.count("*").alias("_size")).filter("_size > 1")
    found = dealt_join(same, materialise(groups, "op3-groups"), ["_level", "_name"], "_rid", BROADCAST_KEYS >> 2).select("_rid", "_keep", "_size")
    out = rows.select("_rid", "_id", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")).join(found, "_rid", "left")
    own = F.col("_keep").isNull()
    return out.select(
        F.col("_id").alias(id_col), F.when(own, F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_keep._rid") == F.col("_rid"), F.lit(True)).alias("kept"), "text_sha256", "_rid",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep; the columns stay as they are."""
    docs = stored(docs)
    dropped = materialise(exact_groups(docs, id_col, text_col, block_bytes).filter("not kept").select("_rid"), "op3-dropped")
    return with_row_id(wrapped(docs), "_rid").join(bounded(dropped), "_rid", "left_anti").select("doc.*")
