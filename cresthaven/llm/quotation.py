"""Chat formatting by quotation linking, with DataFrame functions only.

A message's lines carry quote levels: the number of leading ``>`` marks, which may be spaced.  Consecutive lines of a
level form a passage.  Passages that were quoted (level 1 or more) are normalised (lower case, white space as one
space) and hashed with SHA-256, whole and by line and sentence; so is every message's own text, whole and by paragraph,
line and sentence.  Equal digests stand for equal texts, so nothing is left to verify.  A join by digest inside the
conversation links a quoted passage to the latest earlier message that says it whole, or else to the one that is the
latest to say most of its lines and sentences.  The message then replies to the one that its last linked passage of
the lowest level comes from, or else to the message before.  Conversations are built in reply order, without quotes.
A line like "... wrote:" goes with the quote that follows it; anywhere else it is text like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)\b(?:wrote|schrieb|escribió|a écrit)\s*:\s*$"
SENTENCE = r"(?<=[.!?\u2026])\s+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def lines(text: Column) -> Column:
    """The text's lines as structs of level, body and whether they are blank."""
    def line(x):
        return let(F.regexp_replace(x, MARKS + " ?", ""), lambda body: F.struct(level(x).alias("level"), body.alias("body"), (F.trim(body) == "").alias("blank")))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), line)


def without_attributions(parsed: Column) -> Column:
    """The lines but those that introduce a quote: the next line, or after a blank one the one behind it, is of a higher level."""
    def opens(x, i):
        after = F.get(parsed, i + 1)
        deeper = F.when(after.blank & ~(after.level > x.level), F.get(parsed, i + 2).level).otherwise(after.level)
        return x.body.rlike(ATTRIBUTION) & (F.coalesce(deeper, F.lit(0)) > x.level)

    return F.filter(parsed, lambda x, i: ~opens(x, i))


def passages(parsed: Column) -> Column:
    """Consecutive lines of a level put together: structs of level and text; blank lines part a passage in two.  Linear in the lines."""
    at = lambda i: F.get(parsed, i)
    apart = lambda i: (i == 0) | (i == F.size(parsed)) | F.coalesce(at(i - 1).blank | at(i).blank | (at(i - 1).level != at(i).level), F.lit(True))
    places = F.sequence(F.lit(0), F.size(parsed))
    begins = F.filter(places, lambda i: (i < F.size(parsed)) & ~at(i).blank & apart(i))
    ends = F.filter(places, lambda i: (i > 0) & ~at(i - 1).blank & apart(i))
    one = lambda b, e: F.struct(at(b).level.alias("level"), F.array_join(F.transform(F.slice(parsed, b + 1, e - b), lambda x: x.body), "\n").alias("text"))
    return let(ends, lambda e: F.transform(begins, lambda b, k: one(b, F.get(e, k))))


def parse(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the same with said (own text without quotes) and quoted (array of level, text)."""
    marked = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
    # a message without a quote mark needs no line-by-line pass
    whole = let(lines(F.col("text")), lambda p: let(without_attributions(p), passages))
    out = messages.withColumn("_passages", F.when(marked, whole).otherwise(F.array().cast("array<struct<level:int,text:string>>")))
    plain = F.array_join(F.transform(F.filter("_passages", lambda p: p.level == 0), lambda p: p.text), "\n\n")
    return out.withColumn("said", F.when(marked, plain).otherwise(F.coalesce("text", F.lit("")))).withColumn("quoted", F.filter("_passages", lambda p: p.level > 0)).drop("_passages")


def parts(text: Column) -> Column:
    """A passage's normalised lines and sentences; sentences may run over line ends."""
    return F.array_distinct(F.filter(F.concat(F.transform(F.split(text, r"\n"), normal), F.split(normal(text), SENTENCE)), lambda x: x != ""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def before(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Add n_before and max_before: how many rows of the same keys stand earlier in the order, and their greatest value.

    Rows are range-partitioned by keys and order and summed within a range; what earlier ranges hold of the same keys
    is added from a table of the keys that span ranges (at most two rows a range and key).  So a key with very many
    rows is dealt over many tasks.  Keys may be null.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    w = earlier(Window.partitionBy("_range", *keys).orderBy(*order))
    local = dealt.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_m", F.max(value).over(w))
    per = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("n"), F.max(value).alias("m"))
    many = per.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias("ranges")).where("ranges > 1")
    same = lambda a, b: [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)]
    under = [f"_{k}" for k in keys]
    span = per.join(F.broadcast(many), same(keys, under), "left_semi")
    v = earlier(Window.partitionBy(*keys).orderBy("_range"))
    span = span.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(v), F.lit(0)).alias("_sn"), F.max("m").over(v).alias("_sm"))
    out = local.join(F.broadcast(span), [*same(keys, under), F.col("_range") == F.col("_r")], "left")
    return out.select(*rows.columns, (F.col("_n") + F.coalesce("_sn", F.lit(0))).alias("n_before"), F.greatest("_m", "_sm").alias("max_before"))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> a row per message: conv_id, place, turn, role, said, n_quotes, n_linked, reply_to (turn), reply_place.

    Only rows equal in conv_id, turn, role and text are one message.  A conversation's messages are ordered by turn,
    then role, then the digest of the text, and ``place`` is the number in that order, from 0; "earlier" means a lesser
    place, also within a turn.  Null conversation ids form one conversation; messages without a turn come first, reply
    to nothing and are replied to by nothing.  An empty table gives no rows; extra columns are ignored.  Quotes of
    passages that nobody said before are dropped from the text but link nowhere.
    """
    one = messages.select("conv_id", "turn", "role", "text").distinct().withColumn("digest", F.sha2("text", 256))
    one = before(one, ["conv_id"], ["turn", "role", "digest"], "turn").withColumnsRenamed({"n_before": "at", "max_before": "turn_before"})
    own = written(parse(one).drop("text", "digest"), "parsed")
    quotes = own.select("conv_id", "at", F.posexplode("quoted").alias("nth", "q"))
    # only conversations with a quote have their passages hashed
    asked = quotes.select(F.col("conv_id").alias("c")).distinct()
    unit = lambda text, whole: F.struct(digest(text).alias("hash"), whole.alias("whole"))
    units = F.concat(F.array(unit(normal(F.col("q.text")), F.lit(True))), F.transform(parts(F.col("q.text")), lambda x: unit(x, F.lit(False))))
    asks = quotes.select("conv_id", "at", "nth", F.col("q.level").alias("level"), F.explode(units).alias("u"))
    asks = asks.select("conv_id", "u.hash", "at", F.lit(0).alias("kind"), "nth", "level", "u.whole", F.lit(None).cast("bigint").alias("source"))
    paragraphs = F.filter(F.split("said", r"\n\s*\n"), lambda p: F.trim(p) != "")
    texts = F.concat(F.array(normal(F.col("said"))), F.flatten(F.transform(paragraphs, lambda p: F.concat(F.array(normal(p)), parts(p)))))
    said = own.join(asked, own.conv_id.eqNullSafe(asked.c), "left_semi").where("turn is not null and said rlike '\\\\S'").select("conv_id", "at", F.explode(F.array_distinct(texts)).alias("text"))
    said = said.select("conv_id", digest(F.col("text")).alias("hash"), "at", F.lit(1).alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("level"), F.lit(True).alias("whole"), F.col("at").alias("source"))
    # the latest earlier message that says it: a running maximum, never all pairs
    found = before(asks.unionByName(said), ["conv_id", "hash"], ["at", "kind", "nth", "whole"], "source").where("kind = 0 and max_before is not null")
    votes = found.groupBy("conv_id", "at", "nth", "level", "max_before").agg(F.bool_or("whole").alias("whole"), F.count_if(~F.col("whole")).alias("n"))
    linked = votes.groupBy("conv_id", "at", "nth", "level").agg(F.max_by("max_before", F.struct("whole", "n", "max_before")).alias("source"))
    per = linked.groupBy("conv_id", "at").agg(F.count("*").alias("linked"), F.max_by("source", F.struct(-F.col("level"), "nth")).alias("target"))
    # the turn of the message replied to
    t = own.select(F.col("conv_id").alias("c"), F.col("at").alias("t"), F.col("turn").alias("to_turn"))
    p = per.join(t, per.conv_id.eqNullSafe(t.c) & (per.target == t.t)).select("c", F.col("at").alias("p"), "linked", "target", "to_turn")
    out = own.join(p, own.conv_id.eqNullSafe(p.c) & (own.at == p.p), "left")
    last = F.when(F.col("turn_before").isNotNull(), F.col("at") - 1)
    return out.select("conv_id", F.col("at").alias("place"), "turn", "role", "said", F.size("quoted").alias("n_quotes"), F.coalesce("linked", F.lit(0)).alias("n_linked"), F.coalesce("to_turn", "turn_before").alias("reply_to"), F.coalesce("target", last).alias("reply_place"))


def conversations(messages: DataFrame, segment: int = 256) -> DataFrame:
    """Conversations in reply order, in segments of at most ``segment`` messages, so that no row is unbounded.

    Columns: conv_id, segment (0 on), n_messages, n_linked, messages (array of turn, role, reply_to, text).  Messages
    are ordered by what they reply to, then by place: replies to a message stand together, after all replies to earlier
    ones, and the first message comes first.  Texts are without quotes.
    """
    rows = link(messages).withColumn("after", F.coalesce("reply_place", F.lit(-1)))
    placed = before(rows, ["conv_id"], ["after", "place"], "place")
    each = F.struct(F.col("n_before").alias("nth"), "turn", "role", "reply_to", F.col("said").alias("text"))
    out = placed.groupBy("conv_id", F.floor(F.col("n_before") / segment).alias("segment")).agg(F.count("*").alias("n_messages"), F.sum("n_linked").alias("n_linked"), F.sort_array(F.collect_list(each)).alias("m"))
    return out.select("conv_id", "segment", "n_messages", "n_linked", F.transform("m", lambda x: F.struct(x.turn.alias("turn"), x.role.alias("role"), x.reply_to.alias("reply_to"), x.text.alias("text"))).alias("messages"))
