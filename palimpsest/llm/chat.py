"""Chat formatting: cumulative snapshots collapse, maximal conversations are rendered.

Logs often hold a conversation again and again as it grows. Every turn gets a rolling hash
of the turns up to it (the xor of hashes of place, role and text, twice 64 bits). A
conversation whose last hash is the hash of a turn before the end of a longer one is a
prefix of that and goes; of equal conversations the one with the least id stays.

Turns are numbered and hashed in chunks of a conversation, whose counts and hashes are
then added up over the chunks, so a very long conversation is no single task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written

#: Turn numbers of one chunk.
CHUNK = 512
SEEDS = (0x51, 0xA7)


def _rolled(turns: DataFrame) -> DataFrame:
    """Adds chunk, place (from 1), h1 and h2: hashes of the conversation up to the turn."""
    rows = turns.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    within = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("place", F.row_number().over(within).cast("long"))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & a["chunk"].eqNullSafe(b["chunk"])
    rows = rows.join(before, same(rows, before)).select(rows["*"], before["before"]).withColumn("place", F.col("place") + F.col("before")).drop("before")
    for i, seed in enumerate(SEEDS, 1):
        rows = rows.withColumn(f"h{i}", F.xxhash64(F.lit(seed), "place", "role", F.col("role").isNull(), "text", F.col("text").isNull()))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"))
    before = chunks.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("c1", "c2")))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"h{i}": F.bit_xor(f"h{i}").over(upto) for i in (1, 2)})
    rows = rows.join(before, same(rows, before)).select(rows["*"], before["c1"], before["c2"])
    return rows.withColumns({f"h{i}": F.col(f"h{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)}).drop("c1", "c2")


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations of ``turns`` (conv_id, turn, role, text): conv_id, n_turns, copies.

    Turns are taken in order of their number, equal numbers by role, then text; nulls come
    first and equal each other. Rows without a conv_id are one conversation. ``copies``
    counts the conversations that equal it.
    """
    rows = written(_rolled(turns.select("conv_id", "turn", "role", "text")).select("conv_id", "place", "h1", "h2"), "turns")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("x")).select("conv_id", "x.*")
    whole = last.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    length = last.select(F.col("conv_id").alias("of"), F.col("place").alias("n_turns"))
    inner = rows.join(length, rows["conv_id"].eqNullSafe(length["of"])).filter("place < n_turns").select("place", "h1", "h2").distinct()
    return whole.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """The turns of ``kept`` conversations as lines of a chat template: conv_id, place, n_turns, copies, line.

    A conversation's lines in order are its rendering; one row is one turn, however long the
    conversation. A null role is ``unknown``, a null text empty.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    kept = kept.select(F.col("conv_id").alias("of"), "n_turns", "copies")
    rows = _rolled(turns.join(kept.select("of"), turns["conv_id"].eqNullSafe(F.col("of")), "left_semi"))
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    return rows.join(kept, rows["conv_id"].eqNullSafe(F.col("of"))).select("conv_id", "place", "n_turns", "copies", line.alias("line"))


def op6_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return render(turns, written(collapse(turns), "conversations"))


OP6_SQL = r"""
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations
), lists AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS turns, count(*) AS n FROM numbered GROUP BY conv_id
), kept AS (
  SELECT turns, n, min(conv_id) AS conv_id, count(*) AS copies FROM lists GROUP BY turns, n
), maximal AS (
  SELECT * FROM kept a WHERE NOT EXISTS (SELECT 1 FROM lists b WHERE b.n > a.n AND b.turns[1] = a.turns[1] AND list_slice(b.turns, 1, a.n) = a.turns)
)
SELECT m.conv_id, t.place, m.n AS n_turns, m.copies,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line
FROM maximal m JOIN numbered t ON m.conv_id = t.conv_id
"""
