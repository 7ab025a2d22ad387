"""Stand-in inputs: thin projections of the supplied tables onto this library's schemas.

Every view has a SQL twin in ``plans/views.py`` with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import core as fx
from ..session import sized

# "now" for every due-date computation below: 2000-01-01T00:00:00Z
NOW = 946_684_800_000
FOUR_HOURS_MS = 4 * 3600 * 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores; a large scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def micros(ts: str | Column) -> Column:
    """Epoch microseconds of a zone-less timestamp, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), fx.col(ts))


def millis(ts: str | Column) -> Column:
    return F.floor(micros(ts) / F.lit(1000)).cast("bigint")


def _letter(shift: Column) -> Column:
    return F.substring(F.lit("ABCDE"), (shift % 5 + 1).cast("int"), F.lit(1))


def questions(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    year = (F.lit(2002) + F.col("p_size") % 22).cast("int")
    number = (F.lit(1) + F.col("p_partkey") % 70).cast("int")
    none = F.array().cast("array<string>")
    return p.select(
        F.col("p_partkey").alias("question_id"),
        year.alias("year"),
        number.alias("number"),
        fx.area_for(number, year).alias("area"),
        _letter(F.col("p_partkey")).alias("answer"),
        (F.col("p_partkey") % 40 == 0).alias("annulled"),
        F.when(F.col("p_size") % 7 == 0, none)
        .when(F.col("p_size") % 2 == 1, F.array("p_brand"))
        .otherwise(F.array("p_brand", "p_type"))
        .alias("topics"),
        F.col("p_partkey").alias("bank_pos"),
    )


def topics(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    slugs = p.select(F.explode(F.array("p_brand", "p_type")).alias("slug")).distinct()
    return slugs.select(
        "slug",
        F.replace("slug", F.lit("#"), F.lit(" ")).alias("label"),
        F.when(F.col("slug").contains("#"), F.lit("fundamentos")).otherwise(F.lit("tecnologia")).alias("area"),
    )


def sessions(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    created = millis("o_orderdate") + F.col("o_orderkey") % 86400 * 1000
    finished = F.when(F.col("o_orderstatus") != "P", created + FOUR_HOURS_MS)
    return o.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("session_id"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("mode"),
        F.concat(F.lit("Prova "), F.col("o_orderkey").cast("string")).alias("label"),
        created.alias("created_at"),
        finished.alias("finished_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("exam")).otherwise(F.lit("study")).alias("correction_mode"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.lit(14400)).alias("time_limit_seconds"),
        F.floor(F.col("o_totalprice") % 14400).cast("bigint").alias("elapsed_seconds"),
        finished.alias("updated_at"),
    )


def raw_items(spark, d) -> DataFrame:
    """Session items without the session's own columns (no join)."""
    li = table(spark, d, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate")
    return li.select(
        F.col("l_orderkey").alias("session_id"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.col("l_partkey").alias("question_id"),
        F.when(F.col("l_returnflag") == "A", _letter(F.col("l_partkey")))
        .when(F.col("l_returnflag") == "R", _letter(F.col("l_partkey") + 1))
        .alias("response"),
        (F.col("l_discount") >= 0.08).alias("flagged"),
        (F.col("l_quantity") * 8).alias("seconds"),
        millis("l_shipdate").alias("seen_at"),
        F.col("l_linenumber").alias("line"),
    )


def items(spark, d) -> DataFrame:
    """Every item of every session, with its owner and session times."""
    s = sessions(spark, d).select("session_id", "user_id", "created_at", "finished_at", "time_limit_seconds")
    return sized(raw_items(spark, d), "session_id").join(s, "session_id")


def attempts(spark, d) -> DataFrame:
    """Answer history of finished sessions; `seq` is the array position used for ties."""
    s = (
        table(spark, d, "orders")
        .filter(F.col("o_orderstatus") != "P")
        .select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"))
    )
    annulled = F.col("question_id") % 40 == 0
    i = raw_items(spark, d).select(
        "session_id",
        "question_id",
        F.col("seen_at").alias("timestamp"),
        F.col("response").alias("answer"),
        fx.is_correct(annulled, "response", _letter(F.col("question_id"))).alias("correct"),
        F.col("seconds").alias("seconds_spent"),
        F.col("session_id").alias("seq"),
        "flagged",
    )
    return sized(i, "session_id").join(s, "session_id")


def srs(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """One schedule row per (user, item); `rows` are the attempts, if they are at hand."""
    interval = F.when(F.max_by("correct", F.struct("timestamp", "seq")), F.lit(6)).otherwise(F.lit(1))
    rows = (attempts(spark, d) if rows is None else rows).select("user_id", "question_id", "correct", "timestamp", "seq")
    return (
        sized(rows, "user_id", "question_id")
        .groupBy("user_id", "question_id")
        .agg(
            F.count_if("correct").alias("repetitions"),
            interval.alias("interval_days"),
            F.max("timestamp").alias("last_reviewed_at"),
        )
        .select(
            "user_id",
            "question_id",
            "repetitions",
            "interval_days",
            F.lit(2.5).alias("ease_factor"),
            (F.col("last_reviewed_at") + F.col("interval_days") * fx.DAY_MS).alias("due_at"),
            "last_reviewed_at",
        )
    )


def srs_all(spark, d) -> DataFrame:
    """`srs` with schedules of items that have left the bank."""
    s = srs(spark, d)
    gone = s.filter("question_id % 7 = 0").withColumn("question_id", F.col("question_id") + 1_000_000_000)
    return s.unionByName(gone)


def topic_srs(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """One schedule row per (user, primary topic); `rows` are the attempts, if they are at hand."""
    q = questions(spark, d).select("question_id", F.try_element_at("topics", F.lit(1)).alias("slug"))
    rows = sized((attempts(spark, d) if rows is None else rows).select("question_id", "user_id", "correct", "timestamp"), "question_id")
    return (
        sized(rows.join(q.filter("slug is not null"), "question_id").drop("question_id"), "user_id", "slug")
        .groupBy("user_id", "slug")
        .agg(
            F.count_if("correct").alias("repetitions"),
            (F.count("*") % 9 + 1).alias("interval_days"),
            F.max("timestamp").alias("last_reviewed_at"),
            fx.ratio(F.count_if("correct"), F.count("*")).alias("last_accuracy"),
        )
        .select(
            "user_id",
            "slug",
            "repetitions",
            "interval_days",
            F.lit(2.5).alias("ease_factor"),
            (F.col("last_reviewed_at") + F.col("interval_days") * fx.DAY_MS).alias("due_at"),
            "last_reviewed_at",
            "last_accuracy",
        )
    )


def marks(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """One review mark per (user, item) that was ever flagged in a finished session; `rows` are the attempts, if they are at hand."""
    reason = F.element_at(F.array(*[F.lit(r) for r in fx.REASONS]), (F.col("question_id") % 4 + 1).cast("int"))
    return (
        sized((attempts(spark, d) if rows is None else rows).filter("flagged"), "user_id", "question_id")
        .groupBy("user_id", "question_id")
        .agg(
            F.max_by("session_id", F.struct("timestamp", "seq")).alias("session_id"),
            F.min("timestamp").alias("created_at"),
            F.max("timestamp").alias("updated_at"),
            F.count("*").alias("times_marked"),
        )
        .select(
            "user_id",
            "question_id",
            reason.alias("reason"),
            F.lit("").alias("note"),
            "session_id",
            "created_at",
            "updated_at",
            F.when((F.col("user_id") + F.col("question_id")) % 3 == 0, F.col("updated_at")).alias("resolved_at"),
            "times_marked",
        )
    )


def events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        "user_id",
        micros("ts").alias("ts_us"),
        F.get_json_object("props", "$.k").cast("int").alias("item"),
        F.col("event_type").alias("type"),
        "value",
    )


def screens(spark, d) -> DataFrame:
    """Sessions in the time of the event log: a day of orders is 18 minutes of January 2024; some overlap, some are open."""
    o = table(spark, d, "orders")
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    start = (F.lit(1_704_067_200) + day * 1080 + F.col("o_orderkey") % 1080) * 1_000_000
    hours = F.col("o_orderkey") % 60 + 1
    return o.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("session_id"),
        start.alias("start_us"),
        F.when(F.col("o_orderstatus") != "P", start + hours * 3_600_000_000).alias("end_us"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey") % 240 + 60).alias("limit_seconds"),
    )


# ---------------------------------------------------------------- documents as words and keys

LINES_PER_PAGE = 40


def lines(spark, d) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))


def words(spark, d) -> DataFrame:
    """Every document as positioned words; each line starts with an item number in one of four styles.

    `word_no` is the reading position in the document. Some numbers are struck twice.
    """
    docs = spread(table(spark, d, "documents"))
    style = F.col("doc_id") % 4

    def prefix(i):
        n = (i + 1).cast("string")
        twice = (i + 1) % 7 == 0
        mark = F.when((F.col("doc_id") % 8 == 1) & (i < 10), F.lit(".")).otherwise(F.lit(")"))
        dot = F.concat(n, F.when(style == 0, F.lit(".")).otherwise(mark))
        return (
            F.when(style == 2, F.array(n, F.lit("-")))
            .when(style == 3, F.array(F.lit("▬QUESTÃO"), n))
            .when(twice, F.array(dot, dot))
            .otherwise(F.array(dot))
        )

    def tokens(line, i):
        return F.concat(prefix(i), F.array_remove(F.split(line, " "), ""))

    def places(ws, i):
        first = F.shiftleft(i.cast("bigint"), 32)
        return F.sequence(first, first + F.size(ws) - 1)

    # line and place in it as one long per word, made line by line: nothing is done for single words before they are rows
    by_line = docs.select("doc_id", F.transform(F.split("text", "\n"), tokens).alias("ls"))
    flat = by_line.select("doc_id", F.flatten("ls").alias("ws"), F.flatten(F.transform("ls", places)).alias("at"))
    # the array of places is only read in Spark's compiled loop over the words, it is not copied into their rows
    w = flat.select("doc_id", "at", F.posexplode_outer("ws").alias("word_no", "text"))
    w = w.select("doc_id", "word_no", "text", F.get("at", F.col("word_no")).alias("at"))
    i = F.shiftright("at", 32).cast("int")
    j = F.col("at").bitwiseAND(0xFFFFFFFF).cast("int")
    p = F.when((style >= 2) | ((i + 1) % 7 == 0), 2).otherwise(1)
    margin = F.lit(50.0) + (i + 1) % 3 * 1.5
    second = F.when(style == 2, F.lit(62.0)).when(style == 3, F.lit(110.0)).otherwise(margin)
    x0 = F.when(j == 0, margin).when(j < p, second).otherwise(F.lit(130.0) + (j - p) * 20.0)
    y0 = i % LINES_PER_PAGE * 18.0 + 50.0 + F.when((style <= 1) & (j == 1) & (p == 2), 0.4).otherwise(0.0)
    return w.select(
        "doc_id",
        F.floor(i / LINES_PER_PAGE).cast("int").alias("page"),
        "word_no",
        "text",
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 12.0).alias("x1"),
        (y0 + 12.0).alias("y1"),
    )


def ocr_tokens(spark, d) -> DataFrame:
    """The words as scanner tokens: pixel boxes at double scale, one block per page, one text line per row."""
    return words(spark, d).select(
        "doc_id",
        "page",
        F.col("word_no").alias("pos"),
        "text",
        F.floor(F.col("x0") * 2).cast("int").alias("left"),
        F.floor(F.col("y0") * 2).cast("int").alias("top"),
        F.lit(18).alias("width"),
        F.lit(24).alias("height"),
        F.col("page").alias("block_num"),
        F.floor((F.col("y0") - 50) / 18).cast("int").alias("line_num"),
    )


def key_text(spark, d) -> DataFrame:
    """An answer key per document, one entry per line, in one of three layouts."""
    docs = spread(table(spark, d, "documents")).select("doc_id", F.split("text", "\n").alias("ls"))
    letter = F.transform(
        "ls", lambda line: F.substring(F.lit("ABCDE*"), (F.length(line) % 6 + 1).cast("int"), F.lit(1))
    )
    one = F.transform(letter, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". ("), a, F.lit(")")))
    zero = F.when(F.col("doc_id") % 2 == 0, F.lit("0")).otherwise(F.lit("o"))
    packed = F.transform(
        letter,
        lambda a, i: F.concat(F.when(i < 9, zero).otherwise(F.lit("")), (i + 1).cast("string"), F.lit(" - "), a),
    )
    starts = F.sequence(F.lit(1), F.size("ls"), F.lit(10))
    pairs = F.transform(
        starts,
        lambda s: F.concat(
            F.array_join(F.transform(F.sequence(s, F.least(s + 9, F.size("ls"))), lambda n: n.cast("string")), " "),
            F.lit("\n"),
            F.array_join(F.slice(letter, s, 10), " "),
        ),
    )
    text = (
        F.when(F.col("doc_id") % 3 == 0, F.array_join(one, "\n"))
        .when(F.col("doc_id") % 3 == 1, F.array_join(packed, " "))
        .otherwise(F.array_join(pairs, "\n"))
    )
    return docs.select("doc_id", text.alias("text"))


def sections(spark, d) -> DataFrame:
    """Documents as exams in two sections, the first and the second half of their pages; one page makes one section.

    Every third exam names the area of its first section. Of the style whose numbers stand apart from their dash, the
    first section counts as scanned and the second one forces its pattern.
    """
    docs = table(spark, d, "documents").select("doc_id", F.ceil(F.size(F.split("text", "\n")) / LINES_PER_PAGE).alias("n"))
    docs = docs.filter("n > 0")
    mid = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    parts = F.when(F.col("n") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    s = docs.select("doc_id", mid.alias("mid"), F.explode(parts).alias("k"))
    first = F.col("k") == 0
    style = F.col("doc_id") % 4
    return s.select(
        (F.col("doc_id") * 2 + F.col("k")).alias("section_id"),
        F.col("doc_id").cast("int").alias("year"),
        "doc_id",
        F.when(first, F.lit(0)).otherwise(F.col("mid")).alias("page_from"),
        F.when(first, F.col("mid")).alias("page_to"),
        F.when(first & (F.col("doc_id") % 3 == 0), F.lit("matematica")).alias("area"),
        F.when(style != 2, "auto").when(first, "ocr").otherwise("bare").alias("pattern"),
    )


def key_pages(spark, d) -> DataFrame:
    """Printed keys: the page of `key_text`, then one for another edition whose answers are all E."""
    k = key_text(spark, d).select("doc_id", F.col("text").alias("own"))
    other = F.regexp_replace("own", r"\b[A-D]\b", "E")
    pages = F.array(F.struct(F.lit(0).alias("page"), F.col("own").alias("text")), F.struct(F.lit(1).alias("page"), other.alias("text")))
    return k.select("doc_id", F.inline(pages))


def key_ranges(spark, d) -> DataFrame:
    """The pages of each exam's key: one edition for even documents, the other for the rest, all pages for every fifth."""
    even = F.col("doc_id") % 2 == 0
    every = F.col("doc_id") % 5 == 0
    return table(spark, d, "documents").filter("text is not null").select(
        F.col("doc_id").cast("int").alias("year"),
        "doc_id",
        F.when(every | even, 0).otherwise(1).alias("key_from"),
        F.when(every, None).when(even, 1).otherwise(2).alias("key_to"),
    )
