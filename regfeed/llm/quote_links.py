"""Quotation linking: which message quotes which, and conversations in order of replies without the quotes.

A line's level is the number of ``>`` it begins with. Neighbouring lines of one level that have a word form a passage; its text
is normalised (lower case, runs of blanks as one) and hashed. A quoted passage is joined to the first message of the same
conversation that has it as its own, whole or as one line, and comes before. First messages are a table with one row
per conversation and passage, so the join never multiplies rows, and a passage that very many messages repeat is one row there.
A passage without such a message, as one with lines left out, is linked to the first message before that has all its lines.

A message replies to the message that its least deeply quoted linked passage is from (of several, the latest). Threads follow from
doubling: each round joins what is reached with what is reached from there, so a chain of n replies takes log n rounds.
DataFrame expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regfeed.llm.common import stored
from regfeed.operators.scan import running_number

PREFIX = r"^[ \t]*(?:>[ \t]?)*"
# The line that mail programs put before a quote.
ATTRIBUTION = r"(?i)^\s*(on\b.*|.*\S) wrote:\s*$"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quote_lines(messages: DataFrame) -> DataFrame:
    """``msg, conv_id, turn, line, level, words``: one row for each line of the text, quote marks removed."""
    lines = messages.select("msg", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    mark = F.regexp_extract("raw", PREFIX, 0)
    level = F.when(F.col("raw").rlike(r"^[ \t]*>"), F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).otherwise(0)
    words = F.when(level > 0, F.expr("substring(raw, length(regexp_extract(raw, '" + PREFIX.replace("\\", "\\\\") + "', 0)) + 1)")).otherwise(F.col("raw"))
    return lines.select("msg", "conv_id", "turn", "line", level.alias("level"), words.alias("words"))


def passages(lines: DataFrame) -> DataFrame:
    """``msg, conv_id, turn, level, first, size, passage, parts``: hash of each run of lines with words at one level, its line count and the lines' hashes."""
    by_message = Window.partitionBy("msg").orderBy("line")  # the lines of one message
    solid = lines.withColumn("norm", normal(F.col("words")))
    solid = solid.withColumn("_run", F.when((F.lag("level").over(by_message) == F.col("level")) & (F.lag("norm").over(by_message) != ""), 0).otherwise(1))
    solid = solid.withColumn("_run", F.sum("_run").over(by_message)).where("norm != ''")
    gathered = solid.groupBy("msg", "conv_id", "turn", "level", "_run").agg(F.array_sort(F.collect_list(F.struct("line", "norm"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["norm"]), " ")
    parts = F.array_distinct(F.transform("rows", lambda r: F.md5(r["norm"].cast("binary"))))
    return gathered.select("msg", "conv_id", "turn", "level", F.col("rows")[0]["line"].alias("first"), F.size("rows").alias("size"), F.md5(text.cast("binary")).alias("passage"), parts.alias("parts"))


def links(quoted: DataFrame, own: DataFrame, single: DataFrame) -> DataFrame:
    """``quoted`` passages with ``original``, the turn of the first message that has the passage, if that comes before."""
    keys = own.select("conv_id", "turn", "passage").unionByName(single.select("conv_id", "turn", "passage"))
    first = keys.where("conv_id is not null and turn is not null").groupBy("conv_id", "passage").agg(F.min("turn").alias("original"))
    found = quoted.join(first, ["conv_id", "passage"], "left")
    return found.withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))


def trimmed(linked: DataFrame, single: DataFrame) -> DataFrame:
    """``linked`` with ``original`` also for passages without one: the first message before that has all their lines, wherever they stand in it.

    Equal passages of a conversation are looked up once, among the messages that have the line which the fewest have.
    """
    asked = linked.where("original is null and size > 1 and conv_id is not null and turn is not null").select("conv_id", "passage", "parts")
    if asked.isEmpty():
        return linked
    asked = asked.dropDuplicates(["conv_id", "passage"]).select("conv_id", "passage", F.size("parts").alias("wanted"), F.explode("parts").alias("part"))
    held = single.where("turn is not null").select("conv_id", "turn", F.col("passage").alias("part")).join(asked, ["conv_id", "part"], "left_semi")
    held = stored(held.distinct(), "held")
    spread = asked.join(held.groupBy("conv_id", "part").agg(F.count("*").alias("n")), ["conv_id", "part"])
    rarest = spread.groupBy("conv_id", "passage").agg(F.min_by("part", F.struct("n", "part")).alias("part"), F.count("*").alias("_found"), F.first("wanted").alias("wanted"))
    some = rarest.where("_found = wanted").join(held, ["conv_id", "part"]).select("conv_id", "passage", "turn")
    both = some.join(asked, ["conv_id", "passage"]).join(held, ["conv_id", "turn", "part"], "left_semi")
    whole = both.groupBy("conv_id", "passage", "turn").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")).where("n = wanted")
    first = whole.groupBy("conv_id", "passage").agg(F.min("turn").alias("_holder"))
    found = linked.join(first, ["conv_id", "passage"], "left")
    return found.withColumn("original", F.coalesce("original", F.when(F.col("_holder") < F.col("turn"), F.col("_holder")))).drop("_holder")


def threads(parents: DataFrame) -> DataFrame:
    """``conv_id, turn, thread, depth`` for each (conv_id, turn) with an earlier ``parent``: the turn its chain begins at, and its length."""
    reached = stored(parents.select("conv_id", "turn", F.col("parent").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        step = reached.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_to"), F.col("depth").alias("_more"))
        joined = reached.join(step, ["conv_id", "thread"], "left")
        moved = stored(
            joined.select("conv_id", "turn", F.coalesce("_to", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_to").isNotNull().alias("_moved")),
            "threads",
        )
        reached = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return reached


def reply_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, body, n_quoted, n_linked, deepest, reply_to, thread, depth, position``, one row per message.

    ``body`` is the text without quoted lines and the attribution before them. In a conversation, messages are ordered by the
    thread's first turn, then depth, then turn: ``position`` counts from 0, and a message always follows the one it replies to.
    A message without a linked quote begins a thread. A NULL text is an empty body. A NULL ``conv_id`` or ``turn`` links with
    nothing; NULL conversations are ordered as one. Of rows with the same conversation and turn each is a message; they share
    the least ``reply_to``. Other columns are ignored; an empty table gives no rows.
    """
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    # Equal rows are one message as far as quotes go: figures and bodies follow from the row's own values.
    given = given.withColumn("msg", F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("conv_id", "turn", "role", "text")]).cast("binary")))
    lines = quote_lines(given.dropDuplicates(["msg"]))
    found = passages(lines)
    single = lines.where("level = 0").withColumn("norm", normal(F.col("words"))).where("norm != ''")
    single = single.select("conv_id", "turn", F.md5(F.col("norm").cast("binary")).alias("passage"))
    linked = stored(links(found.where("level > 0"), found.where("level = 0"), single), "whole-links")
    linked = stored(trimmed(linked, single), "links")

    per_message = linked.groupBy("msg").agg(
        F.count("*").alias("n_quoted"), F.count("original").alias("n_linked"), F.max("level").alias("deepest"),
        F.max_by("original", F.when(F.col("original").isNotNull(), F.struct(-F.col("level"), "original"))).alias("reply_to"),
    )
    parents = linked.where("original is not null").groupBy("msg", "conv_id", "turn").agg(F.max_by("original", F.struct(-F.col("level"), "original")).alias("parent"))
    parents = parents.groupBy("conv_id", "turn").agg(F.min("parent").alias("parent"))
    chains = threads(parents)

    after = F.lead("level").over(Window.partitionBy("msg").orderBy("line"))
    kept = lines.withColumn("_next", F.coalesce(after, F.lit(0))).where((F.col("level") == 0) & ~((F.col("_next") > 0) & F.col("words").rlike(ATTRIBUTION)))
    bodies = kept.groupBy("msg").agg(F.array_sort(F.collect_list(F.struct("line", "words"))).alias("rows"))
    bodies = bodies.select("msg", F.trim(F.array_join(F.transform("rows", lambda r: r["words"]), "\n"), F.lit(" \t\r\n")).alias("body"))
    shared = parents.withColumnRenamed("parent", "reply_to")
    whole = (
        given.join(bodies, "msg", "left")
        .join(per_message.drop("reply_to"), "msg", "left")
        .join(shared, ["conv_id", "turn"], "left")
        .join(chains, ["conv_id", "turn"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    whole = whole.select(
        "conv_id", "turn", "role", F.coalesce("body", F.lit("")).alias("body"), zero("n_quoted"), zero("n_linked"), zero("deepest"),
        "reply_to", F.coalesce("thread", "turn").alias("thread"), zero("depth"), F.coalesce("conv_id", F.lit(0)).alias("_conv"), F.col("conv_id").isNull().alias("_none"), "msg",
    )
    ordered = running_number(whole, ["_none", "_conv"], ["thread", "depth", "turn", "msg"], "position")
    return ordered.select("conv_id", "turn", "role", "body", "n_quoted", "n_linked", "deepest", "reply_to", "thread", "depth", "position")
