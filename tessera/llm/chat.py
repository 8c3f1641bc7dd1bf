"""Chat formatting: conversations as windows of a token budget, with a loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scans import running_before
from tessera.plans.tables import saved

#: The marks of a turn: ``<s>[INST]role[/INST]text</s>``.
START, HEAD_END, TURN_END = "<s>[INST]", "[/INST]", "</s>"
#: A mark, perhaps with backslashes after its first character: a text gets one more, which reading takes away again.
_MARK = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
#: Tokens that the marks of a turn count for, and bytes that count as one token.
MARK_TOKENS, TOKEN_BYTES = 4, 4


def escaped(text: Column) -> Column:
    """A text without any mark, from which ``unescaped`` gives it back."""
    return F.regexp_replace(text, _MARK, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def estimated_tokens(text: Column) -> Column:
    """A token for every four bytes begun, and four for the marks."""
    return F.lit(MARK_TOKENS) + F.floor((F.octet_length(text) + TOKEN_BYTES - 1) / TOKEN_BYTES)


def format_conversations(turns: DataFrame, budget: int = 512, history: int = 128, tokens_col: str | None = None, id_col: str = "conv_id", target: str = "assistant") -> DataFrame:
    """Formats conversations as windows of at most ``budget`` tokens of whole turns.

    ``turns``: ``id_col long, turn, role, text`` and, where ``tokens_col`` names it, a count of tokens for
    each turn (nulls and less than 1 count as 1, and of equal rows the largest holds); without it tokens are estimated from bytes.  Returns per
    window: ``id_col long, first_place long`` (place in its conversation, from 0, of its first new turn),
    ``n_turns int, n_repeated int`` (turns in it, and those at its start that an earlier window has as
    new), ``n_tokens long, text string, mask array<struct<start long, length long>>`` (code points from 0
    of the texts to learn from, without their marks).

    Method: prefix sums of tokens place each turn in its conversation.  A leading system turn is retained
    in every window; what it leaves of the budget, less ``history``, is the stride.  A turn belongs to the
    stretch of one stride that it ends in, but one of more than ``history`` tokens that crosses a border of
    stretches stands alone, so the new turns of a window never need more than stride and history.  Turns
    before a window's first are repeated as far as ``history`` and the budget allow.  Only new turns
    of the role ``target`` are under the mask, so each of them is learnt from once.  A turn that is
    larger than the budget allows is not cut: it stands alone, and its window is over the budget.

    Turns are ordered by turn (nulls first), role and text; repeated rows are turns of their own.  Null
    roles and texts are empty; rows without a conversation's id form one conversation of their own.  A
    system turn anywhere else is a turn like others, and one alone is a window.  An empty table gives no
    rows; other columns are not read.

    Texts shuffle twice, to meet their places and as parts of windows.  Conversations may hold any share of the rows: prefix sums scan ranges, and all joins and groups are
    by conversation and place or window, whose rows the budget bounds; the join that gives every turn its
    conversation's system turn is one adaptive execution can split.
    """
    if not 0 <= history < budget:
        raise ValueError("history has to be less than the budget")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    tokens = estimated_tokens(F.concat(role, text)) if tokens_col is None else F.greatest(F.coalesce(F.col(f"`{tokens_col}`").cast("long"), F.lit(1)), F.lit(1))
    conv, named = F.col(f"`{id_col}`").cast("long"), lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    whole_row = F.concat_ws("|", named(conv), named(F.col("turn")), F.length(role).cast("string"), F.concat(role, text))
    rows = turns.select(conv.alias("conv"), "turn", role.alias("role"), text.alias("text"), tokens.cast("long").alias("tokens"), F.sha2(text, 256).alias("tie"), F.sha2(whole_row, 256).alias("row"))

    # Windows are planned on rows without their texts, which join once at the end; equal rows are one with a count until then.
    counted = rows.groupBy("conv", "turn", "role", "tie", "row").agg(F.max("tokens").alias("tokens"), F.count("*").alias("copies"))
    scanned = running_before(counted, "conv", ["turn", "role", "tie"], {"place": F.col("copies"), "before": F.col("tokens") * F.col("copies")}, {})
    copy = scanned.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = saved(copy.select("conv", "role", "row", "tokens", (F.col("place") + F.col("copy")).alias("place"), (F.col("before") + F.col("copy") * F.col("tokens")).alias("before")))

    windows = _planned(placed.select("conv", "place", "before", "tokens", (F.col("role") == "system").alias("system")), budget, history)
    named_rows = placed.select(F.col("conv").alias("_conv"), F.col("place").alias("_place"), "row", "tokens")
    members = windows.join(named_rows, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place"))).drop("_conv", "_place")
    piece = F.concat(F.lit(START), escaped(F.col("role")), F.lit(HEAD_END), escaped(F.col("text")), F.lit(TURN_END))
    head = F.length(escaped(F.col("role"))) + len(START) + len(HEAD_END)
    pieces = rows.groupBy("row").agg(F.first("role").alias("role"), F.first("text").alias("text")).select("row", (F.col("role") == target).alias("target"), head.cast("long").alias("head"), piece.alias("piece"))
    found = pieces.join(members, "row")
    turn = F.struct("place", "new", "tokens", (F.col("new") & F.col("target")).alias("learnt"), "head", F.length("piece").cast("long").alias("size"), "piece")
    whole = found.groupBy("conv", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    masked = F.filter(F.transform(_starts("turns"), lambda t: F.when(t["learnt"], F.struct((t["at"] + t["head"]).alias("start"), (t["size"] - t["head"] - len(TURN_END)).alias("length")))), lambda m: m.isNotNull())
    return whole.select(
        F.col("conv").alias(id_col), F.array_min(F.transform(F.filter("turns", lambda t: t["new"]), lambda t: t["place"])).alias("first_place"), F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_repeated"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"), masked.alias("mask"),
    )


def _starts(turns: str) -> Column:
    """Where each turn of a window starts in its text; a window has few turns."""
    empty = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<at long, learnt boolean, head long, size long>>").alias("done"))
    step = lambda a, t: F.struct((a["end"] + t["size"]).alias("end"), F.concat(a["done"], F.array(F.struct(a["end"].alias("at"), t["learnt"].alias("learnt"), t["head"].alias("head"), t["size"].alias("size")))).alias("done"))
    return F.aggregate(turns, empty, step, lambda a: a["done"])


def _planned(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """Which turns each window holds: ``conv, place, window long, new boolean``, from places, prefix sums and token counts alone."""
    leading = F.when((F.col("place") == 0) & F.col("system"), F.col("tokens"))
    about = placed.groupBy("conv").agg(F.max(leading).alias("kept"), F.count("*").alias("n"))
    about = about.select(F.col("conv").alias("_conv"), F.when(F.col("n") > 1, F.col("kept")).alias("kept"))
    known = placed.join(about, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv", "system")
    known = saved(known.withColumns({"retained": (F.col("place") == 0) & F.col("kept").isNotNull(), "kept": F.coalesce("kept", F.lit(0))}))

    spoken = known.filter(~F.col("retained")).withColumn("before", F.col("before") - F.col("kept"))
    stride = F.greatest(F.lit(budget - history) - F.col("kept"), F.lit(1))
    first, last = F.floor(F.col("before") / stride), F.floor((F.col("before") + F.col("tokens") - 1) / stride)
    alone = (last > first) & (F.col("tokens") > history)
    spoken = spoken.withColumn("window", 2 * last - F.when(alone, 1).otherwise(0))
    windows = spoken.groupBy("conv", "window").agg(F.min("before").alias("start"), F.sum("tokens").alias("new_tokens"), F.first("kept").alias("kept"), F.min("place").alias("first_place"))
    windows = saved(windows.withColumn("room", F.least(F.lit(history), F.lit(budget) - F.col("kept") - F.col("new_tokens"))))

    # Turns repeated before a window lie in its own stretch of history's width or the one before; tokens bound how many there are.
    width = max(1, history)
    asked = windows.filter("room > 0 and start > 0").select("conv", "window", "start", "room", F.explode(F.array(F.floor(F.col("start") / width), F.floor(F.col("start") / width) - 1)).alias("_stretch"))
    turns = spoken.select(F.col("conv").alias("_conv"), "place", "before", "tokens", F.floor(F.col("before") / width).alias("_of"))
    near = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("_stretch") == F.col("_of"))
    repeated = asked.join(turns, near).filter((F.col("before") + F.col("tokens") <= F.col("start")) & (F.col("before") >= F.col("start") - F.col("room")))
    systems = known.filter("retained").select(F.col("conv").alias("_conv"), "place")
    retained = windows.join(systems, F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", "place", "window", (F.col("first_place") == 1).alias("new"))
    return spoken.select("conv", "place", "window", F.lit(True).alias("new")).unionByName(repeated.select("conv", "place", "window", F.lit(False).alias("new"))).unionByName(retained)


def read_windows(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Reads windows back: their columns and ``turns array<struct<role, text>>`` (the new ones), ``learnt array<string>`` (texts under the mask), all unescaped."""
    pieces = F.slice(F.split("text", TURN_END, -1), F.lit(1), F.col("n_turns"))
    bare = F.transform(F.slice(pieces, F.col("n_repeated") + 1, F.col("n_turns")), lambda p: F.substring(p, len(START) + 1, F.length(p)))
    turn = lambda p: F.struct(unescaped(F.substring_index(p, HEAD_END, 1)).alias("role"), unescaped(F.substring(p, F.length(F.substring_index(p, HEAD_END, 1)) + len(HEAD_END) + 1, F.length(p))).alias("text"))
    learnt = F.transform("mask", lambda m: unescaped(F.substring(F.col("text"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return windows.withColumns({"turns": F.transform(bare, turn), "learnt": learnt})


def conversation_digests(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the windows of each conversation hold, read back from their texts and masks.

    Returns ``id_col, n_turns long, turns_sha256, loss_chars long, loss_sha256, formatted_chars long, n_windows long``.
    A digest runs over a whole conversation, so its windows meet in one row: nothing but these digests needs that.
    """
    read = read_windows(windows, id_col)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.groupBy(id_col).agg(
        F.sum(F.size("turns")).alias("n_turns"), F.sum(F.length("text").cast("long")).alias("formatted_chars"), F.count("*").alias("n_windows"),
        F.array_sort(F.collect_list(F.struct("first_place", spoken.alias("spoken"), F.array_join("learnt", "").alias("learnt")))).alias("parts"),
    )
    joined = {c: F.array_join(F.col(f"parts.{c}"), "") for c in ("spoken", "learnt")}
    return parts.select(
        id_col, "n_turns", F.sha2(joined["spoken"], 256).alias("turns_sha256"), F.length(joined["learnt"]).cast("long").alias("loss_chars"), F.sha2(joined["learnt"], 256).alias("loss_sha256"), "formatted_chars", "n_windows"
    )
