"""Chat formatting (operator 10): multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant and all others as named users; the mask marks
the characters to train on, which are the speaker's own words and end marks.
System turns are context: they are nobody's perspective and keep their role.

A long conversation is rendered in parts of at most ``PART_TURNS`` turns, one
row each, whose offsets run on from part to part. Texts are only ever grouped
by part; the offsets are summed over narrow rows, one a part. (Turns of one
conversation whose numbers fall into one range of ``PART_TURNS`` are ordered in
one window: all of them, where they share one number.) DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.llm.common import let, read
from relevo.session import write_shared

PART_TURNS = 256
START, END = "<|im_start|>", "<|im_end|>"


#: Characters that end a line; a name holds none of them.
LINE_ENDS = "\n\v\f\r\u0085\u2028\u2029"


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def _header(role: Column, speaker: Column) -> Column:
    name = _unmarked(F.translate(role, LINE_ENDS, " " * len(LINE_ENDS)))
    return (F.when(role == "system", F.lit("system")).when(role == speaker, F.lit("assistant"))
            .otherwise(F.concat(F.lit("user name="), name)))


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, speaker, part, start, n_turns, rendered, mask)`` from ``(conv_id, turn, role, text)``.

    ``start`` is the offset of the part in the speaker's whole rendering and
    ``mask`` an array of ``(begin, end)`` offsets in that rendering, all in
    code points. Null roles read ``unknown``, null texts are empty, null ids
    are one conversation of their own; a null turn stands just before turn 0;
    turns with equal numbers are ordered by role and text, and repeated rows
    stay repeated. Start and end marks inside
    a text or a name are broken by a space, and line ends in a name are spaces, so neither can
    look like another header (the names of two speakers may read alike then; ``speaker`` is
    the role as it is). Conversations without a participant other
    than ``system`` give no row.
    """
    clean = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        _unmarked(F.coalesce("text", F.lit(""))).alias("text"))
    coarse = F.floor(F.coalesce("turn", F.lit(0)) / part_turns)
    w = Window.partitionBy("conv_id", "coarse").orderBy("at", "turn", "role", "text")
    parts = (clean.withColumns({"coarse": coarse, "at": F.coalesce("turn", F.lit(0))})
             .withColumn("fine", F.floor((F.row_number().over(w) - 1) / part_turns))
             .groupBy("conv_id", "coarse", "fine")
             .agg(F.array_sort(F.collect_list(F.struct("at", "turn", "role", "text"))).alias("turns")))
    speakers = clean.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    rotated = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), _header(t.role, F.col("speaker")), F.lit("\n")).alias("head"), t.text.alias("text"),
        (t.role == F.col("speaker")).alias("own")))
    tail = F.lit(END)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("mask"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["text"]) + len(END)
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(
            F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(acc["mask"]).alias("mask"))

    done = rotated.select("conv_id", "speaker", "coarse", "fine", F.size("turns").alias("n_turns"), let(
        pieces, lambda ps: F.struct(
            F.concat_ws("", F.transform(ps, lambda p: F.concat(p["head"], p["text"], tail, F.lit("\n")))).alias("rendered"),
            F.aggregate(ps, zero, step).alias("m"))).alias("r"))
    done = write_shared(done.select("conv_id", "speaker", "coarse", "fine", "n_turns", "r.rendered", F.col("r.m.at").alias("size"),
                                    F.col("r.m.mask").alias("mask")), "renderings")
    # the running sums see a narrow row a part; the texts meet them by the part's own key
    order = Window.partitionBy("conv_id", "speaker").orderBy("coarse", "fine")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    keys = "conv_id", "speaker", "coarse", "fine"
    placed = done.select(*keys, "size").select(
        *[F.col(k).alias(f"at_{k}") for k in keys], (F.row_number().over(order) - 1).alias("part"), before.alias("start"))
    same = [F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in keys]
    return done.join(placed, same).select("conv_id", "speaker", "part", "start", "n_turns", "rendered", F.transform(
        "mask", lambda m: F.struct((m["begin"] + F.col("start")).alias("begin"), (m["end"] + F.col("start")).alias("end"))).alias("mask"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side; the mask as ``begin-end`` pairs in a string."""
    return rotate_perspectives(read(spark, sf_dir, "conversations")).select(
        "conv_id", "speaker", "part", "start", "n_turns", "rendered",
        F.concat_ws(",", F.transform("mask", lambda m: F.concat_ws("-", m["begin"], m["end"]))).alias("mask"))


_SQL_ENDS = " || ".join(f"chr({ord(c)})" for c in LINE_ENDS)
_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
                  replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
n AS (SELECT *, floor(coalesce(turn, 0) / {PART_TURNS}) AS coarse,
             (row_number() OVER (PARTITION BY conv_id, floor(coalesce(turn, 0) / {PART_TURNS})
                                 ORDER BY coalesce(turn, 0), turn NULLS FIRST, role, text) - 1) // {PART_TURNS} AS fine,
             row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 0), turn NULLS FIRST, role, text) AS k FROM t),
p AS (SELECT n.*, s.speaker, '{START}' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
             ELSE 'user name=' || replace(translate(role, {_SQL_ENDS}, '{' ' * len(LINE_ENDS)}'), '<|im_', '<| im_') END || chr(10) AS head
      FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, sum(length(head) + length(text) + {len(END) + 1}) OVER (PARTITION BY conv_id, speaker ORDER BY k) AS stop FROM p),
g AS (SELECT conv_id, speaker, coarse, fine, count(*)::INTEGER AS n_turns,
             string_agg(head || text || '{END}' || chr(10), '' ORDER BY k) AS rendered,
             min(stop - length(head) - length(text) - {len(END) + 1})::BIGINT AS start,
             coalesce(string_agg(CASE WHEN role = speaker THEN (stop - length(text) - {len(END) + 1}) || '-' || (stop - 1) END,
                                 ',' ORDER BY k), '') AS mask
      FROM o GROUP BY ALL)
SELECT conv_id, speaker, (row_number() OVER (PARTITION BY conv_id, speaker ORDER BY coarse, fine) - 1)::INTEGER AS part,
       start, n_turns, rendered, mask FROM g
"""

QUERIES = {"op10_perspective_rotation": op10_perspective_rotation}
ORACLES = {"op10_perspective_rotation": _SQL}
