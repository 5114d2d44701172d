"""Multi-party perspective rotation of dialogues, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rotate_perspectives(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> (conv_id, participant, rendered, masks, n_turns, n_chars, n_masked).

    For every participant of a conversation the whole dialogue is rendered once: the participant's turns as
    ``assistant``, everyone else's as ``user`` with their name, system turns as ``system``. ``masks`` lists, in
    order, the character ranges [start, end) of ``rendered`` that count for the loss: the participant's texts
    and their end marks.

    Names are roles in lower case, on one line and without outer blanks; a null or blank one is ``unknown``;
    ``system`` is no participant, so a conversation of system turns alone gives no row. A null text is empty. Turns
    are in the order of turn (nulls first), name and text; repeated rows stay. Rows with a null conv_id take no part.
    A marker string inside a name or a text is broken by a backslash. Offsets are running sums over a window, not
    folds of an array, so a long conversation costs no more a turn than a short one; a rendering is one row, so
    the turns of one conversation and participant meet in one task. An empty table gives an empty result; other
    columns have no effect, whatever their names.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    role = F.trim(F.regexp_replace(F.col("role").cast("string"), r"[\t\n\x0B\f\r ]+", " "))
    name = safe(F.coalesce(F.nullif(F.lower(role), F.lit("")), F.lit("unknown")))
    body = safe(F.coalesce(F.col("text").cast("string"), F.lit("")))
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", name.alias("speaker"), body.alias("body"))
    people = turns.filter("speaker <> 'system'").select("conv_id", F.col("speaker").alias("participant")).distinct()
    own = F.col("speaker") == F.col("participant")
    role = F.when(F.col("speaker") == "system", F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), "speaker"))
    head = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))
    views = turns.join(people, "conv_id").withColumn("head", head).withColumn("part", F.concat("head", "body", F.lit("<|im_end|>\n")))
    order = Window.partitionBy("conv_id", "participant").orderBy(F.asc_nulls_first("turn"), "speaker", "body")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    views = views.withColumn("place", F.row_number().over(order)).withColumn("end", F.sum(F.length("part")).over(so_far))
    start = F.col("end") - F.length("part") + F.length("head")
    span = F.when(own, F.struct(start.cast("long").alias("start"), (F.col("end") - 1).cast("long").alias("end")))
    grouped = views.withColumn("span", span).groupBy("conv_id", "participant").agg(
        F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"),
        F.array_sort(F.collect_list("span")).alias("masks"),
        F.count("*").alias("n_turns"),
        F.max("end").alias("n_chars"),
        F.coalesce(F.sum(F.col("span.end") - F.col("span.start")), F.lit(0)).alias("n_masked"),
    )
    rendered = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    return grouped.select("conv_id", "participant", rendered.alias("rendered"), "masks", "n_turns", "n_chars", "n_masked")
