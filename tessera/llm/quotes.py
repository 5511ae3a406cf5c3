"""Quotation linking for messages (DataFrame functions only).

A line's quote level is the number of ``>`` at its start, blanks between them allowed. A message's own lines
have level 0; lines of level n quote somebody. Each line is normalised (markers off, lower case, white space
runs to one blank, trimmed) and hashed. Quoted line hashes are looked up among the own lines of earlier messages of
the same conversation.

What finds no line there is looked up by passage, which a mail client may have wrapped anew. Consecutive lines of one
level, up to a blank line, are a passage, normalised across line ends; it and its sentences are hashed and looked up
among the passages and sentences that earlier messages of the conversation wrote. A line takes the origin of its
passage, else the latest origin among the sentences it is part of. Only then is a line looked up in the whole table: its
origin is the first message that wrote it.

The latest earlier turn is found without pairs of messages: own and quoted pieces are sorted together by
(conversation, piece, turn) in ranges, each range carries the last own turn along, and a range that begins within a
piece takes over the last own turn of the ranges before it. A line that very many messages of one conversation write
and quote costs one row per message.

The reply link of a message is the earlier message of its conversation that wrote most of its quoted lines of the lowest
level (ties: the latest); without such a quote it is the message of the preceding turn number, if there is one. Following links to
their end gives the thread; links always point to earlier turns, so ordering a thread by turn puts every reply
after its original. Links are followed by pointer doubling: the number of joins is the logarithm of the longest
chain, each join is on the unique message key, and every round is written to the shared folder.

Edge cases: null text is empty, null conversation or turn never links and is a thread of its own, messages
that repeat a (conversation, turn) share its links and thread but keep their own texts, quotes whose origin
is unknown are removed from the text and counted as unlinked, empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, partitions

MARK = r"^(?:[ \t]*>)+"
END = "[.!?] "          # of a sentence, in a normalised passage


def level(line):
    """Quote level of a line: number of leading markers."""
    return F.regexp_count(F.regexp_extract(line, MARK, 0), F.lit(">")).cast("int")


def normalise(line):
    bare = F.regexp_replace(line, MARK, "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[ \t\r\f]+", " "))


def parse(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row per line: conv_id, turn, line_no, level, line, norm, norm_hash."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                            F.posexplode(F.split(t, "\n")).alias("line_no", "line"))
            .withColumn("level", level(F.col("line"))).withColumn("norm", normalise(F.col("line")))
            .withColumn("norm_hash", F.xxhash64("norm")))


def latest(own: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """``asked`` (conv_id, turn, norm_hash, norm and others) with ``src_turn``: the latest turn of ``own`` (conv_id, turn,
    norm_hash, norm) before its own with the same conversation and text.

    Both sides are cut together into ranges of (conversation, text, turn); only one row per range is looked at across ranges."""
    piece = ["conv_id", "norm_hash", "norm"]
    asked_row = F.struct(*[F.col(c) for c in asked.columns])
    both = (asked.select(*piece, "turn", F.lit(0).alias("__own"), asked_row.alias("__row"))     # at one turn: asked first
            .unionByName(own.select(*piece, "turn", F.lit(1).alias("__own")), allowMissingColumns=True))
    order = [*piece, "turn", "__own"]
    ranged = cut(both.repartitionByRange(partitions(own.sparkSession), *order).withColumn("__range", F.spark_partition_id())
                 .withColumn("__wrote", F.when(F.col("__own") == 1, F.col("turn"))), name)
    key = F.struct(*piece)
    ends = ranged.groupBy("__range").agg(F.min(key).alias("head"), F.max(F.struct(key.alias("piece"), "__wrote")).alias("tail"))
    # one row per range and end: what a range's last piece wrote goes to later ranges that begin with that piece
    marks = ends.select("__range", F.col("tail.piece").alias("piece"), F.col("tail.__wrote").alias("__wrote"), F.lit(False).alias("head")) \
        .unionByName(ends.select("__range", F.col("head").alias("piece"), F.lit(None).cast(own.schema["turn"].dataType).alias("__wrote"),
                                 F.lit(True).alias("head")))
    before = Window.partitionBy("piece").orderBy("__range").rangeBetween(Window.unboundedPreceding, -1)
    carried = (marks.withColumn("carried", F.max("__wrote").over(before)).where(F.col("head") & F.col("carried").isNotNull())
               .select(F.col("__range").alias("__r"), "piece.*", "carried"))
    here = Window.partitionBy("__range", *piece).orderBy("turn", "__own").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("src_turn", F.max("__wrote").over(here)).where(F.col("__own") == 0).select(
        "__range", "__row", F.col("src_turn"))
    on = (F.col("__range") == F.col("__r")) & (F.col("__row.conv_id") == F.col("c.conv_id")) \
        & (F.col("__row.norm_hash") == F.col("c.norm_hash")) & (F.col("__row.norm") == F.col("c.norm"))
    return found.join(F.broadcast(carried.alias("c")), on, "left").select(   # at most one row per range
        "__row.*", F.coalesce("src_turn", "carried").alias("src_turn"))


def _pieces(passage):
    """A passage and its sentences."""
    return F.array_distinct(F.concat(F.array(passage), F.split(passage, "(?<=[.!?]) ")))


def own_pieces(messages: DataFrame) -> DataFrame:
    """conv_id, turn, norm_hash, norm of the passages and sentences that messages wrote."""
    kept = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.when(level(x) == 0, x).otherwise(F.lit("")))
    blank = r"\n[ \t\r\f]*(?=\n)"
    return (messages.select("conv_id", "turn", F.explode(F.split(F.array_join(kept, "\n"), blank)).alias("p"))
            .select("conv_id", "turn", F.explode(_pieces(F.trim(F.regexp_replace(F.lower("p"), r"[ \t\r\f\n]+", " ")))).alias("norm"))
            .where(F.col("norm") != "").withColumn("norm_hash", F.xxhash64("norm")).distinct())


def passage_sources(messages: DataFrame) -> DataFrame:
    """conv_id, turn, line_no, level, norm, by_passage: the latest earlier turn of the conversation that wrote the passage of a
    quoted line, else one of the line's sentences."""
    mail = messages.select("conv_id", "turn", "text", F.xxhash64("text").alias("mail"))
    lines = (mail.select("conv_id", "turn", "mail", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
             .withColumn("level", level(F.col("line"))).withColumn("norm", normalise(F.col("line")))
             .where((F.col("level") > 0) & (F.col("norm") != "")).select("conv_id", "turn", "mail", "line_no", "level", "norm").distinct())
    block = ["conv_id", "turn", "mail", "level"]
    run = [*block, "run"]
    lines = lines.withColumn("run", F.col("line_no") - F.row_number().over(Window.partitionBy(*block).orderBy("line_no")))
    before = Window.partitionBy(*run).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = (lines.withColumn("ends", F.regexp_count(F.concat("norm", F.lit(" ")), F.lit(END)))
             .withColumn("s0", F.coalesce(F.sum("ends").over(before), F.lit(0)))
             .withColumn("s1", F.col("s0") + F.col("ends") - F.when(F.col("norm").rlike("[.!?]$"), 1).otherwise(0)))
    lines = cut(lines, "quote-passages")
    passage = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "norm"))), lambda x: x["norm"]), " ")
    passages = lines.groupBy(*run).agg(passage.alias("passage"))
    asked = (passages.select(*run, F.posexplode(F.concat(F.array("passage"), F.split("passage", "(?<=[.!?]) "))).alias("at", "norm"))
             .withColumn("norm_hash", F.xxhash64("norm")))
    own = own_pieces(messages).join(asked.select("norm_hash").distinct(), "norm_hash", "left_semi")
    found = latest(own, asked, "quote-pieces").where(F.col("src_turn").isNotNull()).select(*run, "at", "src_turn")
    found = cut(found, "quote-found")
    whole = found.where(F.col("at") == 0).select(*run, F.col("src_turn").alias("whole"))
    parts = lines.select(*run, "line_no", "norm", F.explode(F.sequence(F.col("s0") + 1, F.col("s1") + 1)).alias("at"))
    by = parts.join(found, [*run, "at"], "left").groupBy(*run, "line_no", "norm").agg(F.max("src_turn").alias("part"))
    # messages that repeat a (conversation, turn) share their lines' origins
    return (by.join(whole, run, "left").groupBy("conv_id", "turn", "line_no", "level", "norm")
            .agg(F.max(F.coalesce("whole", "part")).alias("by_passage")).where(F.col("by_passage").isNotNull()))


def links(messages: DataFrame) -> DataFrame:
    """Quoted lines and the message they come from: conv_id, turn, line_no, level, norm, src_conv, src_turn, src_first.

    src_turn is the latest earlier turn of the same conversation with that own line, else with its passage or sentence;
    src_first tells that the origin lies in another conversation (the smallest (conversation, turn) that wrote the line)."""
    named = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    lines = parse(named).where(F.col("norm") != "")
    quoted = lines.where(F.col("level") > 0).select("conv_id", "turn", "line_no", "level", "norm", "norm_hash").distinct()
    own = (lines.where(F.col("level") == 0).select("conv_id", "turn", "norm_hash", "norm").distinct()
           .join(quoted.select("norm_hash").distinct(), "norm_hash", "left_semi"))
    quoting = named.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id").distinct()
    near = (latest(own, quoted, "quote-lines")
            .join(passage_sources(named.join(quoting, "conv_id", "left_semi")), ["conv_id", "turn", "line_no", "level", "norm"], "left")
            .withColumn("src_turn", F.coalesce("src_turn", "by_passage")).drop("by_passage"))
    first = own.groupBy(F.col("norm_hash").alias("h"), F.col("norm").alias("t")).agg(F.min(F.struct("conv_id", "turn")).alias("f"))
    far = near.join(first, (F.col("norm_hash") == F.col("h")) & (F.col("norm") == F.col("t")), "left")
    outside = F.col("src_turn").isNull() & (F.col("f.conv_id") != F.col("conv_id"))
    return far.select("conv_id", "turn", "line_no", "level", "norm",
                      F.when(F.col("src_turn").isNotNull(), F.col("conv_id")).when(outside, F.col("f.conv_id")).alias("src_conv"),
                      F.coalesce("src_turn", F.when(outside, F.col("f.turn"))).alias("src_turn"),
                      F.coalesce(outside & F.col("f").isNotNull(), F.lit(False)).alias("src_first"))


def threads(messages: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread (turn of the first message), depth, one row per message key."""
    keys = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn").distinct()
    near = found.where(F.col("src_turn").isNotNull() & ~F.col("src_first"))
    lowest = near.groupBy("conv_id", "turn").agg(F.min("level").alias("lowest"))
    parent = (near.join(lowest, ["conv_id", "turn"]).where(F.col("level") == F.col("lowest"))
              .groupBy("conv_id", "turn", "src_turn").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("conv_id", "turn").agg(F.max(F.struct("n", "src_turn"))["src_turn"].alias("quoted")))
    before = keys.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    state = cut(keys.join(parent, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
                .withColumn("reply_to", F.coalesce("quoted", "before"))
                .select("conv_id", "turn", "reply_to", F.coalesce("reply_to", "turn").alias("thread"),
                        F.when(F.col("reply_to").isNull(), 0).otherwise(1).alias("depth"),
                        F.col("reply_to").isNull().alias("done")), "quote-threads")
    while not (open_ := state.where(~F.col("done"))).isEmpty():   # messages at their first one take no further part
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("t2"), F.col("depth").alias("d2"),
                          F.col("done").alias("there"))
        moved = open_.join(up, ["conv_id", "thread"]).select(
            "conv_id", "turn", "reply_to", F.col("t2").alias("thread"), (F.col("depth") + F.col("d2")).alias("depth"),
            F.col("there").alias("done"))
        state = cut(state.where("done").unionByName(moved), "quote-threads")
    return state.drop("done")


def conversations(messages: DataFrame) -> DataFrame:
    """Messages in reply order without quotes: conv_id, thread, turn, depth, reply_to, role, text, n_quoted,
    n_linked, max_level. Order by (conv_id, thread, turn) reads a conversation thread by thread."""
    messages = messages.select("conv_id", "turn", "role", "text")  # other columns are ignored
    found = cut(links(messages), "quote-links")
    per = found.groupBy("conv_id", "turn").agg(F.sum(F.when(F.col("src_turn").isNotNull(), 1).otherwise(0)).alias("n"),
                                               F.count(F.lit(1)).alias("all"))
    state = threads(messages, found).join(per, ["conv_id", "turn"], "left") \
        .select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reply_to", "thread", "depth", "n")
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    m = messages.withColumn("__lines", split).withColumn("__levels", F.transform("__lines", level))
    kept = F.filter("__lines", lambda x: level(x) == 0)
    return (m.join(state, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
            .select("conv_id", F.coalesce("thread", "turn").cast("long").alias("thread"), "turn",
                    F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
                    F.col("reply_to").cast("long").alias("reply_to"), "role", F.array_join(kept, "\n").alias("text"),
                    F.size(F.filter("__levels", lambda x: x > 0)).cast("long").alias("n_quoted"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_linked"),
                    F.array_max("__levels").cast("long").alias("max_level")))
