"""Chat formatting: collapse cumulative snapshots, then render (operator 9).

A service that logs the whole conversation after each turn leaves snapshots: each
is a prefix of the next. Only conversations that no longer one begins with stay.

Main path: DataFrame functions only. Turns get a hash; the rolling prefix hash of
a conversation after turn i is the XOR of hashes of (turn hash, position) up to i,
two words of 64 bits. A conversation whose last prefix hash is a proper prefix
hash of some conversation is left out by an anti-join.

Scale: a conversation is worked on in blocks of turn numbers, so that even a
single conversation with a third of all turns spreads over tasks; a block with over
HOT_TURNS turns, as when a third of all rows has neither conv_id nor turn number, is cut
further by turn number and hash, which is the order inside it. Block counts
and block XORs are prefix-summed over the few block rows. Prefixes and complete
conversations are aggregated (map side first) before they meet, so neither a
common first turn nor a thousand copies make a hot key in the anti-join.

Defined results: rows that repeat exactly count once; turns with equal numbers are
ordered by the hash of role and text; a null turn number sorts first; a null role
is rendered as "unknown" and differs from that word; a null text renders as empty
and differs from an empty one; rows with null conv_id form one conversation. Of
equal conversations the one with the smallest conv_id stays. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumidex.llm.common import saved, table

#: Turn numbers per block; also the most turns rendered into one row.
BLOCK_TURNS = 256
BEFORE_ALL = -(2**62)
#: Rows of a block from which it is cut further, and parts of the hashes that it is cut by.
HOT_TURNS, HASH_PARTS = 1 << 16, 4096


def _turns(conversations: DataFrame, block_turns: int) -> DataFrame:
    key = F.sha2(F.to_json(F.struct(F.col("role").cast("string").alias("r"), F.col("text").cast("string").alias("t"))), 256)
    return conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(BEFORE_ALL)).alias("span"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        key.alias("key"),
    )


def hot_spans(conversations: DataFrame, block_turns: int = BLOCK_TURNS, hot_turns: int = HOT_TURNS) -> DataFrame:
    """(h_conv, h_span) of the spans of turn numbers that more than hot_turns rows share: nearly always none."""
    counted = _turns(conversations, block_turns).groupBy("conv_id", "span").agg(F.count("*").alias("n")).where(F.col("n") > hot_turns)
    return saved(counted.select(F.col("conv_id").alias("h_conv"), F.col("span").alias("h_span")), "hot")


def _in_blocks(turns: DataFrame, hot: DataFrame, block_turns: int) -> DataFrame:
    """turns with block: the span, and for a hot one the place in the order of turn numbers and hashes inside it."""
    inside = F.coalesce(F.pmod(F.floor("turn"), F.lit(block_turns)), F.lit(0)) * HASH_PARTS + F.conv(F.substring("key", 1, 3), 16, 10).cast("long")
    joined = turns.join(hot, turns["conv_id"].eqNullSafe(hot["h_conv"]) & (turns["span"] == hot["h_span"]), "left")
    return joined.withColumn("block", F.struct("span", F.when(F.col("h_span").isNotNull(), inside).otherwise(0).alias("part"))).drop("h_conv", "h_span", "span")


def prefix_hashes(conversations: DataFrame, hot: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, block, pos (from 1), h1, h2 (rolling prefix hash), is_last; one row a distinct turn. hot: hot_spans()."""
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "key")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks_before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("conv_id").orderBy("block")
    numbered = saved(
        _in_blocks(_turns(conversations, block_turns), hot, block_turns)
        .select("conv_id", "turn", "block", "key")
        .distinct()
        .withColumns({"n_in": F.row_number().over(in_block), "ends_block": F.lead("key").over(in_block).isNull()}),
        "turns",
    )
    counts = (
        numbered.groupBy("conv_id", "block")
        .agg(F.count("*").alias("n"))
        .select(
            F.col("conv_id").alias("c_conv"),
            F.col("block").alias("c_block"),
            F.coalesce(F.sum("n").over(blocks_before), F.lit(0)).alias("before"),
            F.lead("block").over(blocks).isNull().alias("final_block"),
        )
    )
    placed = numbered.join(counts, numbered["conv_id"].eqNullSafe(counts["c_conv"]) & (F.col("block") == F.col("c_block")))
    placed = placed.select(
        "conv_id", "turn", "block", "key",
        (F.col("before") + F.col("n_in")).alias("pos"),
        (F.col("ends_block") & F.col("final_block")).alias("is_last"),
    )
    stepped = placed.withColumns({"s1": F.xxhash64("key", "pos"), "s2": F.xxhash64(F.reverse("key"), "pos")})
    rolling = saved(
        stepped.withColumns({"r1": F.bit_xor("s1").over(so_far), "r2": F.bit_xor("s2").over(so_far)}).drop("s1", "s2", "key"), "rolling"
    )
    ends = rolling.groupBy("conv_id", "block").agg(F.max(F.struct("pos", "r1", "r2")).alias("end"))
    xors = ends.select(
        F.col("conv_id").alias("x_conv"),
        F.col("block").alias("x_block"),
        F.coalesce(F.bit_xor("end.r1").over(blocks_before), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("end.r2").over(blocks_before), F.lit(0)).alias("b2"),
    )
    out = rolling.join(xors, rolling["conv_id"].eqNullSafe(xors["x_conv"]) & (F.col("block") == F.col("x_block")))
    return out.select(
        "conv_id", "block", "pos", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"), "is_last"
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one begins with."""
    keys = ["pos", "h1", "h2"]
    whole = prefixes.where("is_last").groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = prefixes.where("not is_last").select(*keys).distinct()
    return whole.join(proper, keys, "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def collapse(conversations: DataFrame, block_turns: int = BLOCK_TURNS, hot_turns: int = HOT_TURNS) -> DataFrame:
    """conv_id, piece, n_turns, n_copies, text: the maximal conversations, rendered.

    A piece holds block_turns turns by position, whatever their numbers; nearly all
    conversations have one piece, and pieces in order join to the whole conversation.
    """
    hot = hot_spans(conversations, block_turns, hot_turns)
    prefixes = saved(prefix_hashes(conversations, hot, block_turns), "prefixes")
    stay = saved(maximal(prefixes), "maximal")
    starts = prefixes.groupBy("conv_id", "block").agg((F.min("pos") - 1).alias("before"))
    places = starts.join(stay, starts["conv_id"].eqNullSafe(stay["conv_id"])).select(
        starts["conv_id"].alias("p_conv"), F.col("block").alias("p_block"), "before", "n_turns", "n_copies"
    )
    rows = _in_blocks(_turns(conversations, block_turns), hot, block_turns)
    kept = rows.join(places, rows["conv_id"].eqNullSafe(places["p_conv"]) & (rows["block"] == places["p_block"]))
    said = F.sort_array(F.collect_set(F.struct("turn", "key", "role", "text")))
    turn_text = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n"))
    whole = ["conv_id", "n_turns", "n_copies"]
    blocks = kept.groupBy(*whole, "block", "before").agg(said.alias("said"))
    # a block's turns go to one piece, or to a few where a multiple of block_turns falls among them
    last = F.col("before") + F.size("said") - 1
    cut = blocks.select("*", F.explode(F.sequence(F.floor(F.col("before") / block_turns), F.floor(last / block_turns))).alias("nth"))
    first = F.greatest(F.col("nth") * block_turns - F.col("before"), F.lit(0))
    past = F.least((F.col("nth") + 1) * block_turns - F.col("before"), F.size("said"))
    part = F.slice("said", (first + 1).cast("int"), (past - first).cast("int"))
    parts = cut.select(*whole, (F.col("nth") + 1).alias("piece"), "block", F.array_join(F.transform(part, turn_text), "").alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "")
    return parts.groupBy("conv_id", "piece", "n_turns", "n_copies").agg(joined.alias("text")).select("conv_id", "piece", "n_turns", "n_copies", "text")


def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (
  SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
         string_agg(role || chr(31) || text || chr(30), '') OVER (w ROWS UNBOUNDED PRECEDING) AS seq,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (w ROWS UNBOUNDED PRECEDING) AS rendered
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
whole AS (SELECT seq, min(conv_id) AS conv_id, count(*) AS n_copies, min(total) AS n_turns, min(rendered) AS text FROM p WHERE n = total GROUP BY seq)
SELECT conv_id, CAST(1 AS BIGINT) AS piece, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, text
FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.total AND p.seq = whole.seq)
"""
