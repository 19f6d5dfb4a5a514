"""Preference formatting: a chosen and a rejected conversation become one prompt and two completions.

Both conversations are joined turn by turn; the first turn at which they differ ends the longest
common prefix. Turns before it are rendered once, as the prompt; turns from it on are rendered for
each side, with a loss mask that is set on the assistant's turns only. The result has one row per
rendered turn, in the order of ``part`` (prompt, chosen, rejected) and ``turn``.

Scale: the join key is (pair, turn), so that a conversation of any length is spread over tasks; the
prefix length is a grouped minimum with partial aggregation, and the join that brings it back to the
turns is a plain equi-join, which adaptive execution splits where one pair is hot. No conversation is
gathered in a task; ``assemble`` does that for those who want whole strings, one pair a row, so that a pair
must fit a row there (Spark's bound is 2 GB; a larger one is an error, not left out).

Two pairings of plain conversations: ``repeated_answer_pairs`` has those with two assistant turns or more, up to the
last of these; ``preference_sides`` has every conversation with all its turns, and is what the queries use. Its sides
come from one table, so no join of conversations is made: one exchange puts the turns in order, and what is known
of a pair (where it forks, what is said instead) is one row a pair, broadcast where there are few of them.

Edge cases: rows with null pair id or turn are left out; a null role or text counts as empty; of rows
that repeat a (pair, turn) the smallest (role, text) counts; a side that ends earlier differs at the
turn where it ends; identical sides give a prompt and no completions; a pair that only one side has
gives that side's completion with an empty prompt; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.totals import totals_before
from leafmill.session import broadcast_if_small, materialize

KEYS = ["pair_id", "turn"]


def _turns(side: DataFrame, name: str) -> DataFrame:
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = side.where("pair_id IS NOT NULL AND turn IS NOT NULL").select(*KEYS, said.alias("said"))
    return rows.groupBy(*KEYS).agg(F.min("said").alias(name))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``chosen`` and ``rejected``: pair_id, turn, role, text. Returns pair_id, part, turn, role,
    rendered, loss."""
    return format_joined(_turns(chosen, "c").join(_turns(rejected, "r"), KEYS, "full_outer"))


def format_joined(both: DataFrame) -> DataFrame:
    """``format_preferences`` of sides that are joined already: pair_id, turn, and what is said (role, text) in ``c``
    and ``r``, null where a side has no such turn."""
    both = materialize(both, "sides")
    cut = both.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("turn").alias("cut"))
    joined = both.join(broadcast_if_small(materialize(cut, "cuts")), "pair_id", "left")
    joined = joined.withColumn("shared", F.col("cut").isNull() | (F.col("turn") < F.col("cut")))
    part = lambda name, said: F.struct(F.lit(name).alias("part"), F.col(said).alias("said"))
    parts = F.when(F.col("shared"), F.array(part("prompt", "c"))).otherwise(F.array(part("chosen", "c"), part("rejected", "r")))
    rows = joined.select("pair_id", "turn", F.explode(parts).alias("p")).where("p.said IS NOT NULL")
    role, text = F.col("p.said.role"), F.col("p.said.text")
    loss = (F.col("p.part") != "prompt") & (role == "assistant")
    return rows.select("pair_id", F.col("p.part").alias("part"), "turn", role.alias("role"), rendered(role, text).alias("rendered"), loss.alias("loss"))


def assemble(formatted: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected and the loss spans of the completions (start, stop in
    characters). For pairs whose turns fit in a row."""
    piece = F.struct("turn", "rendered", "loss")

    def whole(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("part") == name, piece)))

    grouped = formatted.groupBy("pair_id").agg(*[whole(p).alias(p) for p in ("prompt", "chosen", "rejected")])

    def lost(x: Column, before: Column) -> Column:
        start = before.cast("int")
        return F.when(x["loss"], F.struct(start.alias("start"), (start + F.length(x["rendered"])).alias("stop")))

    sizes = lambda p: F.transform(p, lambda x: F.length(x["rendered"]).cast("long"))
    text = lambda p: F.array_join(F.transform(p, lambda x: x["rendered"]), "")
    spans = lambda p: F.array_compact(F.zip_with(F.col(p), totals_before(sizes(F.col(p))), lost))
    return grouped.select(
        "pair_id", *[text(F.col(p)).alias(p) for p in ("prompt", "chosen", "rejected")],
        *[spans(p).alias(f"{p}_loss") for p in ("chosen", "rejected")],
    )


def repeated_answer_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations (conv_id, turn, role, text): up to the last assistant
    turn a conversation is chosen; it is rejected with that turn replaced by the first assistant turn,
    an answer that only repeats itself. Conversations with one assistant turn make no pair."""
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    spoke = F.when(F.col("role") == "assistant", F.col("turn"))
    ends = rows.groupBy("pair_id").agg(F.min(spoke).alias("first"), F.max(spoke).alias("last")).where("first < last")
    chosen = rows.join(ends, "pair_id").where("turn <= last")
    first = chosen.where("turn = first").groupBy("pair_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("instead"))
    keep = chosen.where("turn < last").select("pair_id", "turn", "role", "text")
    last = ends.join(first, "pair_id").select("pair_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("instead").alias("text"))
    return chosen.select("pair_id", "turn", "role", "text"), keep.unionByName(last)


def preference_sides(conversations: DataFrame) -> DataFrame:
    """A pair for every conversation (conv_id, turn, role, text), all turns kept, its sides joined. The whole
    conversation is chosen. It is rejected with every assistant turn from one of them on repeating the text last
    said before that one (empty if nothing was); which one is picked by a hash of (conv_id, turn). With one
    assistant turn that is the one; with none both sides are equal, which gives a prompt and no completions."""
    rows = materialize(_turns(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"), "c"), "turns")
    hash_ = F.sha2(F.concat_ws(":", F.col("pair_id").cast("string"), F.col("turn").cast("string")), 256)
    cuts = rows.where("c.role = 'assistant'").groupBy("pair_id").agg(F.min(F.struct(hash_.alias("hash"), F.col("turn").alias("turn")))["turn"].alias("cut"))
    cut = rows.join(broadcast_if_small(materialize(cuts, "cuts")), "pair_id", "left")
    said = cut.where("turn < cut").groupBy("pair_id").agg(F.max(F.struct("turn", "c.text"))["text"].alias("instead"))
    other = cut.join(broadcast_if_small(materialize(said, "said")), "pair_id", "left")
    again = (F.col("turn") >= F.col("cut")) & (F.col("c.role") == "assistant")
    text = F.when(again, F.coalesce("instead", F.lit(""))).otherwise(F.col("c.text"))
    return other.select(*KEYS, "c", F.struct(F.col("c.role").alias("role"), text.alias("text")).alias("r"))


def preference_turns(conversations: DataFrame) -> DataFrame:
    """The rendered turns of ``preference_sides``, one row each."""
    return format_joined(preference_sides(conversations))


def preference_rows(conversations: DataFrame) -> DataFrame:
    """One row for every conversation: pair_id, prompt, chosen, rejected, and the loss spans of the completions as
    start:stop, comma-joined."""
    whole = assemble(preference_turns(conversations))
    one = lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))
    listed = [F.array_join(F.transform(f"{p}_loss", one), ",").alias(f"{p}_loss") for p in ("chosen", "rejected")]
    return whole.select("pair_id", "prompt", "chosen", "rejected", *listed)


_PARTS = r"""
WITH t AS (
  SELECT conv_id AS pair_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
e AS (
  SELECT *, first_value(turn) OVER (PARTITION BY pair_id ORDER BY said.role = 'assistant' DESC, sha256(pair_id || ':' || turn), turn) AS cut,
         bool_or(said.role = 'assistant') OVER (PARTITION BY pair_id) AS answered
  FROM t),
i AS (
  SELECT pair_id, turn, said, CASE WHEN answered AND turn >= cut AND said.role = 'assistant'
    THEN {'role': 'assistant', 'text': coalesce((SELECT x.said.text FROM t x WHERE x.pair_id = e.pair_id AND x.turn < e.cut ORDER BY x.turn DESC LIMIT 1), '')}
    ELSE said END AS other
  FROM e),
k AS (SELECT *, min(turn) FILTER (WHERE said IS DISTINCT FROM other) OVER (PARTITION BY pair_id) AS fork FROM i),
p AS (
  SELECT pair_id, turn, 'prompt' AS part, said FROM k WHERE fork IS NULL OR turn < fork
  UNION ALL SELECT pair_id, turn, 'chosen', said FROM k WHERE turn >= fork
  UNION ALL SELECT pair_id, turn, 'rejected', other FROM k WHERE turn >= fork)"""

#: Of ``preference_turns``.
ORACLE = _PARTS + r"""
SELECT pair_id, part, turn, said.role AS role, '<|' || said.role || '|>' || chr(10) || said.text || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND said.role = 'assistant' AS loss
FROM p
"""

#: Of ``preference_rows``.
PAIRS_ORACLE = _PARTS + r""",
r AS (SELECT *, '<|' || said.role || '|>' || chr(10) || said.text || '<|end|>' || chr(10) AS rendered FROM p),
s AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM r)
SELECT pair_id,
  coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (WHERE part = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (WHERE part = 'rejected'), '') AS rejected,
  coalesce(string_agg((stop - length(rendered)) || ':' || stop, ',' ORDER BY turn) FILTER (WHERE part = 'chosen' AND said.role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg((stop - length(rendered)) || ':' || stop, ',' ORDER BY turn) FILTER (WHERE part = 'rejected' AND said.role = 'assistant'), '') AS rejected_loss
FROM s GROUP BY pair_id
"""
