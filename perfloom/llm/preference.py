"""Preference pairs for training: the turns that both conversations share as prompt, the rest as masked completions.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns in order, in one row as a conversation is one training example.

    Repeated rows count once; rows that share a turn number stand in the order of role, then text. Rows of a null id are one
    conversation; null roles and texts are empty ones.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_set(turn)).alias("turns"))


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two turn lists; turns are equal where role and text are."""
    n = F.least(F.size(chosen), F.size(rejected))
    same = F.transform(F.slice(chosen, F.lit(1), n), lambda t, i: (t["role"] == F.get(rejected, i)["role"]) & (t["text"] == F.get(rejected, i)["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def _head(t: Column) -> Column:
    return F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE))


def render(ts: Column) -> Column:
    return F.array_join(F.transform(ts, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def trained(ts: Column, role: str) -> Column:
    """Spans (start, end in code points of the rendered turns) of what ``role`` says, its end mark included."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(_head(t))
        end = start + F.char_length(t["text"]) + len(END)
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(ts, none, step, lambda acc: acc["spans"])


def preference_pairs(pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """``pairs`` (id, chosen, rejected: turn lists as ``turns`` makes them) -> id, n_shared, prompt, and of both sides the
    completion and the spans of it that are trained.

    Equal conversations have empty completions; where nothing is shared the prompt is empty; a missing side has no turns.
    """
    none = F.array().cast("array<struct<turn:long,role:string,text:string>>")
    p = pairs.select("id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    p = p.withColumn("n", shared_turns(F.col("chosen"), F.col("rejected")))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))

    return p.select("id", F.col("n").cast("long").alias("n_shared"), render(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
                    render(rest("chosen")).alias("chosen"), trained(rest("chosen"), role).alias("chosen_spans"),
                    render(rest("rejected")).alias("rejected"), trained(rest("rejected"), role).alias("rejected_spans"))


def with_other_reply(convs: DataFrame, role: str = "assistant") -> DataFrame:
    """Pairs (id, chosen, rejected) from (id, turns): the rejected side ends, from the last turn of ``role`` on, in the last such
    turn of the conversation with the next id, where there is one; without such a turn both sides are equal."""
    spoken = F.filter("turns", lambda t: t["role"] == role)
    last = F.element_at(spoken, -1)
    own = convs.withColumn("last", F.when(F.size(spoken) > 0, last))
    other = own.select((F.col("id") - 1).alias("before"), F.col("last").alias("reply"))
    kept = F.filter("turns", lambda t: t < F.col("last"))
    end = F.when(F.col("reply").isNull(), F.filter("turns", lambda t: F.lit(False))).otherwise(F.array("reply"))
    rejected = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.concat(kept, end))
    return own.join(other, F.col("id") == F.col("before"), "left").select("id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
