"""Exact deduplication behind a Bloom filter: only rows whose text may repeat are shuffled.

Pass one counts the filter positions of every text's digest; a position met twice or more sets its bit. Pass two probes
the filter: a text with an unset bit is unique for certain and passes straight through, the others are grouped by
their SHA-256, which settles false alarms. The filter is blocked (all bits of a digest lie in one block of 32,768), has
`bits_per_row` bits a row and at most MOST_BITS, which bounds what is broadcast (32 MB); beyond that size more rows
are possible repeats and are grouped, so results stay exact.

Of equal texts the row with the largest id stays. Defined results: a NULL text counts as empty; a NULL id is below
all others; of rows that share text and id the one with the larger hash of all columns stays, and of rows equal in
every column any one. A group holding a third of all rows is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .common import attach, col

BLOCK_BITS = 32768
MOST_BITS = 1 << 28
PROBES = 3


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _bit(sha: Column, i: int) -> Column:
    """Position in its block of a digest's bit number i."""
    return F.conv(F.substring(sha, 17 + 8 * i, 8), 16, 10).cast("bigint") % BLOCK_BITS


def _block(sha: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(blocks))


def repeated_filter(digests: DataFrame, rows: int, bits_per_row: int = 16) -> tuple[DataFrame, int]:
    """The filter of positions met twice or more: `block`, `bits` (a bitmap); and the number of blocks."""
    return position_filter(digests, rows, 2, bits_per_row)


def position_filter(digests: DataFrame, rows: int, least: int, bits_per_row: int = 16) -> tuple[DataFrame, int]:
    """A filter of the positions met at least `least` times by `rows` digests (`sha`): `block`, `bits`; and the number of blocks."""
    blocks = max(1, min(rows * bits_per_row, MOST_BITS) // BLOCK_BITS)
    met = digests.select(_block(F.col("sha"), blocks).alias("block"), F.explode(F.array(*[_bit(F.col("sha"), i) for i in range(PROBES)])).alias("bit"))
    often = met.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return often.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")), blocks


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def probe(rows: DataFrame, repeated: DataFrame, blocks: int) -> DataFrame:
    """`rows` (with `sha`) and whether each may repeat, as `maybe`."""
    hit = F.lit(True)
    for i in range(PROBES):
        hit = hit & _is_set(F.col("bits"), _bit(F.col("sha"), i))
    with_bits = rows.withColumn("block", _block(F.col("sha"), blocks)).join(F.broadcast(repeated), "block", "left")
    return with_bits.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("block", "bits")


class Groups:
    """Both passes over a table's digests; the texts themselves are read once."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id"):
        self.docs, self.text, self.key = docs, text, key
        self.tie = F.xxhash64(*[col(c) for c in docs.columns])
        digests = stage(docs.select(col(key).alias("id"), digest(col(text)).alias("sha"), self.tie.alias("tie")))
        repeated, self.blocks = repeated_filter(digests, digests.count())
        self.repeated = stage(repeated)
        probed = probe(digests, self.repeated, self.blocks)
        self.unique = probed.where(~F.col("maybe"))
        self.rows = stage(probed.where("maybe").groupBy("sha", "id", "tie").agg(F.count(F.lit(1)).alias("copies")))
        self.groups = stage(self.rows.groupBy("sha").agg(F.max(F.struct("id", "tie")).alias("keep"), F.sum("copies").alias("size"),
                                                        F.count(F.lit(1)).alias("n")))

    def report(self) -> DataFrame:
        """One row per document: id, keep_id, group_size, kept, sha."""
        placed = attach(self.rows, self.groups, "sha", "n", self.rows.count())
        first = (F.col("id").eqNullSafe(F.col("keep.id"))) & (F.col("tie") == F.col("keep.tie"))
        again = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        repeats = again.select("id", F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"), (first & (F.col("copy") == 1)).alias("kept"), "sha")
        single = self.unique.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
        return single.unionByName(repeats)

    def kept(self) -> DataFrame:
        """The documents that stay, with their own columns; of the others only possible repeats are shuffled."""
        names = self.docs.columns
        held = self.docs.select(F.struct(*[col(c) for c in names]).alias("row"), col(self.key).alias("id"),
                                digest(col(self.text)).alias("sha"), self.tie.alias("tie"))
        probed = probe(held, self.repeated, self.blocks)
        winners = (self.groups.select("sha", F.col("keep.id").alias("keep_id"), F.col("keep.tie").alias("tie"))
                   .join(self.rows.select("sha", "tie", F.col("id").alias("row_id"), "copies"), ["sha", "tie"])
                   .where(F.col("row_id").eqNullSafe(F.col("keep_id"))).drop("row_id"))
        won = probed.where("maybe").join(winners, ["sha", "tie"]).where(F.col("id").eqNullSafe(F.col("keep_id")))
        once = won.where("copies = 1").select("row")
        several = won.where("copies > 1").groupBy("sha", "tie").agg(F.any_value("row").alias("row")).select("row")
        return probed.where(~F.col("maybe")).select("row").unionByName(once).unionByName(several).select("row.*")
