"""Chat formatting: logged snapshots of a growing conversation collapse into the longest, which is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.shared import materialize, read, row_place, shuffle_width

#: Turns that are rendered into one row, at most.
PART_TURNS = 500
#: Three sums of 40-bit hashes tell prefixes apart; sums of 2^23 turns fit a long.
HASHES = ["h0", "h1", "h2"]
#: Characters of a text that order rows of the same turn and role; where they tie, the rest of the texts does.
HEAD = 32
ORDER = ["turn", "role", "head", "rest", "h0"]


def conversation_turns(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, head, rest``, three hashes of a turn and ``place``, that of its row in the table; repeated rows count once.

    Null roles are ``unknown``, null texts empty, null turns come first. Null ids are one conversation. Turns count from a
    conversation's first. Texts themselves stay behind: they are fetched by place when they are rendered. Only where different texts of a turn and role
    share their ``head``, ``rest`` has what follows it, as rows are ordered by the whole text.
    """
    clean = chats.select(F.col(conv).alias("conv"), F.coalesce(F.col(turn), F.lit(-1)).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), row_place(chats).alias("place"))
    hashes = {h: F.pmod(F.xxhash64(F.lit(i), "role", "text"), F.lit(2**40)) for i, h in enumerate(HASHES)}
    narrow = clean.withColumns({"head": F.substring("text", 1, HEAD), **hashes}).drop("text")
    turns = with_rest(materialize(narrow.groupBy("conv", "turn", "role", "head", *HASHES).agg(F.min("place").alias("place")), "rows"), clean)
    starts = turns.groupBy(F.col("conv").alias("s_conv")).agg(F.min("turn").alias("first"))
    turns = turns.join(starts, F.col("conv").eqNullSafe(F.col("s_conv"))).withColumn("turn", F.col("turn") - F.col("first")).drop("s_conv", "first")
    return turns.withColumns({h: F.pmod(F.xxhash64("turn", h), F.lit(2**40)) for h in HASHES})


def with_rest(turns: DataFrame, clean: DataFrame) -> DataFrame:
    """Add ``rest``: of rows that share conversation, turn, role and head with another, their text behind the head, else nothing."""
    alike = turns.groupBy(*[F.col(c).alias(f"a_{c}") for c in ("conv", "turn", "role", "head")]).agg(F.count(F.lit(1)).alias("a_n")).filter("a_n > 1")
    same = [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in ("conv", "turn", "role", "head")]
    asked = materialize(turns.join(alike, same, "left_semi").select(F.col("place").alias("r_place")), "alike")
    if asked.isEmpty():
        return turns.withColumn("rest", F.lit(""))
    rest = clean.select("place", F.substring("text", HEAD + 1, 2**31 - 1).alias("rest")).join(asked, F.col("place") == F.col("r_place")).select("r_place", "rest")
    return turns.join(rest, F.col("place") == F.col("r_place"), "left").drop("r_place").withColumn("rest", F.coalesce("rest", F.lit("")))


def prefixes(turns: DataFrame) -> DataFrame:
    """Add ``n`` and the sums ``p0, p1, p2``: length and rolling hash of the conversation up to each turn.

    Turns are ordered across partitions. Sums run within a conversation's rows of one partition and start from the sums of the
    partitions before, so a conversation of any length, with any number of rows a turn, is spread over tasks.
    """
    width = shuffle_width(turns.sparkSession)
    turns = materialize(turns.repartitionByRange(width, "conv", *ORDER).withColumn("block", F.spark_partition_id()), "turns")
    sums = {"n": F.lit(1), **{f"p{i}": F.col(h) for i, h in enumerate(HASHES)}}
    blocks = turns.groupBy("conv", "block").agg(*[F.sum(v).alias(f"t_{k}") for k, v in sums.items()])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("conv").alias("b_conv"), F.col("block").alias("b_block"), *[F.coalesce(F.sum(f"t_{k}").over(earlier), F.lit(0)).alias(f"b_{k}") for k in sums])
    within = Window.partitionBy("conv", "block").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rolled = turns.withColumns({f"w_{k}": F.sum(v).over(within) for k, v in sums.items()})
    joined = rolled.join(starts, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    return joined.select("conv", "place", *[(F.col(f"w_{k}") + F.col(f"b_{k}")).alias(k) for k in sums])


def maximal_conversations(rolled: DataFrame) -> DataFrame:
    """``conv, n_turns, copies``: one conversation of each content, without those that longer ones begin with.

    Of equal conversations the smallest id stays. A prefix is an (n, hash) pair before a
    conversation's last turn; both sides are grouped before they meet, so a first turn or
    conversation that everyone has is one row.
    """
    mark = ["n", "p0", "p1", "p2"]
    ends = rolled.groupBy("conv").agg(F.max(F.struct(*mark)).alias("end")).select("conv", "end.*")
    unique = ends.groupBy(*mark).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    sizes = ends.select(F.col("conv").alias("e_conv"), F.col("n").alias("e_n"))
    inner = rolled.join(sizes, F.col("conv").eqNullSafe(F.col("e_conv")) & (F.col("n") < F.col("e_n"))).select(*[F.col(c).alias(f"x_{c}") for c in mark]).distinct()
    same = [F.col(c) == F.col(f"x_{c}") for c in mark]
    return unique.join(inner, same, "left_anti").select("conv", F.col("n").alias("n_turns"), "copies")


def format_chats(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", start: str = "<|im_start|>", end: str = "<|im_end|>", stable: bool = False) -> DataFrame:
    """Rendered maximal conversations: ``conv, part, n_turns, copies, rendered``.

    A conversation comes in parts of ``PART_TURNS`` turns, as one row can't hold an unbounded
    one. Rows of the same turn are rendered by role, then by text. ``copies`` counts the conversations
    of the same content. An empty table gives no rows; very long texts are rendered whole; other columns aren't looked at,
    whatever their names. Rows are fetched by place, so an input that isn't ``stable`` (a plain read of files) is written first.
    """
    chats = chats if stable else materialize(chats, "chats")
    rolled = materialize(prefixes(conversation_turns(chats, conv, turn, role, text)), "prefixes")
    kept = maximal_conversations(rolled).withColumnRenamed("conv", "k_conv")
    rows = rolled.join(kept, F.col("conv").eqNullSafe(F.col("k_conv"))).select("conv", "n", "n_turns", "copies", "place", F.floor((F.col("n") - 1) / PART_TURNS).alias("part"))
    segment = F.concat(F.lit(start), F.coalesce(F.col(role), F.lit("unknown")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit(f"{end}\n"))
    texts = chats.select(segment.alias("segment"), row_place(chats).alias("t_place"))
    parts = rows.join(texts, F.col("place") == F.col("t_place")).groupBy("conv", "part", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("n", "segment"))).alias("segments"))
    return parts.select("conv", "part", "n_turns", "copies", F.array_join("segments.segment", "").alias("rendered"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(read(spark, sf_dir, "conversations"), stable=True)
    return out.select(F.col("conv").alias("conv_id"), "part", "n_turns", "copies", "rendered")


#: The driver's conversations are shorter than a part.
ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS seg, turn - min(turn) OVER (PARTITION BY conv_id) AS rel FROM t),
p AS (SELECT conv_id, count(*) OVER w AS n, sha256(string_agg(rel || '|' || role || '|' || length(text) || '|' || text, '#') OVER w) AS h, count(*) OVER (PARTITION BY conv_id) AS total
      FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
u AS (SELECT h, min(conv_id) AS conv_id, count(*) AS copies, any_value(n) AS n_turns FROM p WHERE n = total GROUP BY h),
k AS (SELECT * FROM u WHERE h NOT IN (SELECT h FROM p WHERE n < total))
SELECT k.conv_id, CAST(0 AS BIGINT) AS part, k.n_turns, k.copies, string_agg(s.seg, '' ORDER BY s.turn, s.role, s.text) AS rendered
FROM k JOIN s ON s.conv_id = k.conv_id GROUP BY k.conv_id, k.n_turns, k.copies
"""
