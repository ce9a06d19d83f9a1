"""Chat formatting by quotation linking, with DataFrame functions only.

A line's quote level is the number of '>' marks before its text. Consecutive lines of one level are a passage. Passages
of level 1 and up are quotes; what a message says itself can be quoted. Passages are normalised (A-Z lower-cased, runs of
white space made one blank, trimmed) and hashed. A quote of at least ``WORDS`` words can be any run of words of a message's own
text, however either is wrapped: where the quote's first words stand in a message, the run of the quote's length is hashed. A
shorter quote is a whole passage, a run of its lines, or the whole own text. Within a conversation each quote finds the
latest earlier message that says the same, by one window over (conversation, hash) in which quotes and sayings are
ordered by turn, so a phrase that is said a thousand times is not multiplied. A message replies to what its
outermost quote cites; without a link, it just follows. Messages are ordered by the thread (the turn that the chain of
replies leads to), then by turn, and formatted without the quotes that were linked; quotes of anything else stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.llm.common import plain, staged, table

_MARKS = r"^((?:[ \t]*>)*)"
#: Quotes of at least so many words are looked for anywhere in a message.
WORDS = 5


def normalised(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.trim(F.regexp_replace(F.translate(text, upper, lower), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, level, first, text, raw) for (conv_id, turn, part, text): the passages of each message in order, without and with their marks."""
    lines = messages.select("conv_id", "turn", "part", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    marks = F.regexp_extract("raw", _MARKS, 1)
    lines = lines.select("conv_id", "turn", "part", "line", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace("raw", _MARKS + r"[ \t]?", "").alias("said"), "raw")
    lines = lines.withColumn("said", F.when(F.col("level") > 0, F.col("said")).otherwise(F.col("raw")))
    order = Window.partitionBy("conv_id", "turn", "part").orderBy("line")
    changed = (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")
    lines = lines.withColumn("changed", changed).withColumn("passage", F.sum("changed").over(order))
    ordered = F.array_sort(F.collect_list(F.struct("line", "said", "raw")))
    text = F.array_join(F.transform("lines", lambda x: x["said"]), "\n").alias("text")
    raw = F.array_join(F.transform("lines", lambda x: x["raw"]), "\n").alias("raw")
    return lines.groupBy("conv_id", "turn", "part", "passage", "level").agg(F.min("line").alias("first"), ordered.alias("lines")).select("conv_id", "turn", "part", "level", "first", text, raw)


def link_quotes(df: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, copies, body (without linked quotes), quotes, linked, deepest, reply_to, thread, place, formatted.

    ``quotes`` counts quoted passages, ``linked`` those that an earlier message says, ``deepest`` is the greatest quote
    level. ``reply_to`` is the turn of the latest message that says a passage of the least linked level; ``thread`` the
    turn where following reply_to ends (its own turn without one); ``place`` the message's number inside its thread.
    A quote that no earlier message says (code, a shell's prompt, other people's words) stays in the body as it was written.

    Messages that are the same in all four columns are one row with ``copies``; different messages of one turn share
    the turn and are ordered by role and text. Null texts count as empty, null roles as 'unknown'; a null conversation is
    a conversation of its own, null turns come first and are never quoted nor linked. Texts are read whole,
    however long. An empty table gives an empty result; other columns are ignored.
    """
    rows = plain(df, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = rows.groupBy("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("part", F.sha2(F.concat_ws("\x1f", "role", "text"), 256))
    quoting = rows.filter(F.col("text").rlike(r"(?m)^[ \t]*>"))
    parts = staged(passages(quoting.select("conv_id", "turn", "part", "text")))

    quotes = parts.filter("level > 0 and turn is not null").select("conv_id", "turn", "part", "level", "first", normalised(F.col("text")).alias("norm"), _lines(F.col("text")).alias("lines")).filter("norm <> ''")
    by_line = quotes.filter((F.size("lines") > 1) & (_count("norm") < WORDS)).select("conv_id", F.sha2(F.col("lines")[0], 256).alias("start"), F.size("lines").alias("n")).distinct()
    by_word = quotes.filter(_count("norm") >= WORDS).select("conv_id", F.sha2(F.substring_index("norm", " ", WORDS), 256).alias("start"), _count("norm").alias("n")).distinct()
    quotes = quotes.select("conv_id", "turn", "part", "level", "first", F.sha2("norm", 256).alias("hash"))
    # Only conversations that quote need hashes of what was said.
    asked = quotes.select("conv_id").distinct()
    said = rows.alias("r").join(asked.alias("a"), F.expr("r.conv_id <=> a.conv_id"), "left_semi").filter("turn is not null")
    said = passages(said.select("conv_id", "turn", "part", "text")).filter("level = 0")
    whole = said.groupBy("conv_id", "turn", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "\n").alias("text"))
    short = said.select("conv_id", "turn", "text").union(said.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("text"))).union(whole.select("conv_id", "turn", "text"))
    short = short.select("conv_id", "turn", normalised(F.col("text")).alias("norm")).union(_runs(whole.withColumn("items", _lines(F.col("text"))), F.col("item"), by_line)).filter(_count("norm") < WORDS)
    long = whole.withColumn("items", F.split(normalised(F.col("text")), " "))
    long = _runs(long, F.array_join(F.slice("items", F.col("at") + 1, WORDS), " "), by_word)
    units = short.filter("norm <> ''").union(long).select("conv_id", "turn", F.sha2("norm", 256).alias("hash")).distinct()
    none = F.lit(None)
    both = units.select("conv_id", "turn", "hash", F.col("turn").alias("source"), none.cast("string").alias("part"), none.cast("int").alias("level"), none.cast("int").alias("first")).union(quotes.select("conv_id", "turn", "hash", none.cast("long"), "part", "level", "first"))
    ahead = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("source", F.when(F.col("level").isNotNull(), F.max("source").over(ahead))).filter("level is not null and source is not null")
    found = staged(found.select("conv_id", "turn", "part", "level", "first", "source"))
    linked = found.groupBy("conv_id", "turn", "part").agg(F.count(F.lit(1)).alias("linked"), F.max_by("source", F.struct(-F.col("level"), "source")).alias("reply_to"))

    key = ["conv_id", "turn", "part"]
    same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in key))
    left = parts.alias("p").join(found.alias("f"), same("p", "f") & F.expr("p.first = f.first"), "left").select("p.*", F.col("f.source").isNull().alias("stays"))
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("first", "raw")))), lambda x: x["raw"]), "\n"))
    own = left.groupBy("conv_id", "turn", "part").agg(body.alias("body"), F.count_if(F.col("level") > 0).alias("quotes"), F.max("level").alias("deepest"))
    facts = own.alias("o").join(linked.alias("l"), same("o", "l"), "left").select("o.*", F.coalesce("l.linked", F.lit(0)).alias("linked"), "l.reply_to")
    joined = rows.alias("r").join(facts.alias("f"), same("r", "f"), "left").select("r.*", F.coalesce("f.body", F.col("r.text")).alias("body"), F.coalesce("f.quotes", F.lit(0)).alias("quotes"), F.coalesce("f.linked", F.lit(0)).alias("linked"), F.coalesce("f.deepest", F.lit(0)).alias("deepest"), "f.reply_to")
    joined = joined.alias("m").join(_threads(linked).alias("t"), F.expr("m.conv_id <=> t.conv_id and m.turn = t.turn"), "left").select("m.*", F.coalesce("t.thread", "m.turn").alias("thread"))
    place = F.row_number().over(Window.partitionBy("conv_id", "thread").orderBy("turn", "role", "part"))
    formatted = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    return joined.select("conv_id", "turn", "role", "copies", "body", "quotes", "linked", "deepest", "reply_to", "thread", place.cast("long").alias("place"), formatted.alias("formatted"))


def _count(norm: str) -> Column:
    """The number of words of a normalised text that isn't empty."""
    return F.size(F.split(norm, " "))


def _lines(text: Column) -> Column:
    """The normalised lines that hold anything."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def _runs(whole: DataFrame, start: Column, starts: DataFrame) -> DataFrame:
    """(conv_id, turn, norm): the runs of ``n`` ``items`` of each message where ``start`` (of the item, at its place) is one of ``starts``."""
    at = whole.select("conv_id", "turn", "part", "items", F.posexplode("items").alias("at", "item"))
    at = at.select("conv_id", "turn", "part", "at", F.size("items").alias("of"), F.sha2(start, 256).alias("start"))
    at = at.alias("w").join(starts.alias("s"), F.expr("w.conv_id <=> s.conv_id and w.start = s.start and w.at + s.n <= w.of")).select("w.conv_id", "w.turn", "w.part", "w.at", "s.n")
    at = at.groupBy("conv_id", "turn", "part").agg(F.collect_list(F.struct("at", "n")).alias("at"))
    runs = F.transform("at", lambda x: F.array_join(F.slice("items", x["at"] + 1, x["n"]), " "))
    return whole.alias("w").join(at.alias("a"), F.expr("w.conv_id <=> a.conv_id and w.turn = a.turn and w.part = a.part")).select("w.conv_id", "w.turn", F.explode(runs).alias("norm"))


def _threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): where the chain of replies of each linked turn ends, by pointer doubling."""
    up = staged(linked.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread")))
    while True:
        above = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("next"))
        up_next = staged(up.join(above, F.expr("conv_id <=> c and thread = t"), "left").select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), F.col("next").isNotNull().alias("moved")))
        moved = not up_next.filter("moved").isEmpty()
        up = up_next.drop("moved")
        if not moved:
            return up


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


def quoting(conversations: DataFrame) -> DataFrame:
    """The messages of ``conversations``, each behind a quote of the one before it where that has ``WORDS`` words, rewrapped:
    blanks of the quote after each full stop are line ends."""
    own = plain(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    before = own.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.max("text").alias("quoted"))
    quote = F.concat(F.lit("> "), F.regexp_replace(F.regexp_replace("quoted", r"\. ", ".\n"), "\n", "\n> "), F.lit("\n"))
    enough = F.size(F.split(normalised(F.col("quoted")), " ")) >= WORDS
    return own.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.concat(F.when(enough, quote).otherwise(""), "text").alias("text"))


def chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links found in ``quoting`` messages."""
    out = link_quotes(quoting(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", "quotes", "linked", "reply_to", F.sha2("body", 256).alias("body_sha256"))


#: The tables' messages hold no quotes, so op8's SQL states what is left: each message is a thread of its own.
SQL = {
    "chat_quotes": r"""
WITH o AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r]+', ' ', 'g')) AS norm FROM conversations),
q AS (SELECT conv_id, turn + 1 AS turn, norm AS quoted FROM o WHERE len(string_split(norm, ' ')) >= 5),
l AS (SELECT q.conv_id, q.turn, max(o.turn) AS reply_to FROM q JOIN o ON o.conv_id = q.conv_id AND o.turn < q.turn
      AND contains(' ' || o.norm || ' ', ' ' || q.quoted || ' ') GROUP BY 1, 2)
SELECT o.conv_id, o.turn, role, CAST(q.quoted IS NOT NULL AS BIGINT) AS quotes, CAST(l.reply_to IS NOT NULL AS BIGINT) AS linked, l.reply_to, sha256(CASE WHEN q.quoted IS NULL THEN text ELSE trim(text) END) AS body_sha256
FROM o LEFT JOIN q USING (conv_id, turn) LEFT JOIN l USING (conv_id, turn)
""",
    "op8_chat_formatting": r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, count(*) AS copies
           FROM conversations GROUP BY 1, 2, 3, 4)
SELECT conv_id, turn, role, copies, text AS body, CAST(0 AS BIGINT) AS quotes, CAST(0 AS BIGINT) AS linked, 0 AS deepest, CAST(NULL AS BIGINT) AS reply_to, turn AS thread,
       row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, sha256(concat_ws(chr(31), role, text))) AS place,
       '<|' || role || '|>' || chr(10) || text || chr(10) AS formatted
FROM m
"""
}
QUERIES = {"op8_chat_formatting": op8_chat_formatting, "chat_quotes": chat_quotes}
