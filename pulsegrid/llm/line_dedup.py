"""Removal of repeated multi-line chunks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import forget, fresh, release, stored

CUT_EVERY = 8    # of so many line hashes, all but one end a segment
MIN_LINES, MIN_WORDS = 2, 16
LONG_WORDS = 16  # a line of so many words is a segment by itself
LONE_WORDS = 50  # a line of so many words is a chunk alone
_ENDS = ["\n", ". ", "! ", "? "]  # a line is a text line, wrapped after each sentence
_MARK = "\x01"
_SQL_BLANKS = " \\t\\r\\n\\u000c\\u000b"  # the blanks at the ends of lines, in SQL


def _lines(text: str) -> F.Column:
    """Lines of a text, each with the characters that end it; joined they give
    the text. A text that holds the mark itself is split by a pattern."""
    marked = F.col(text)
    for end in _ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    return (F.when(F.contains(text, F.lit(_MARK)), F.split(text, r"(?<=\n|[.!?] )"))
            .otherwise(F.split(marked, _MARK)))


def _bare(line: str) -> str:
    """SQL of a line without the blanks and line breaks at its end."""
    return f"trim(trailing '{_SQL_BLANKS}' from {line})"


def _chunks(docs: DataFrame, row: str, id_col: str, text: str) -> DataFrame:
    """(row, id, s, e, h): the chunks of every text as ranges of its lines.

    A rolling hash over two line hashes decides after each line whether a
    segment ends there, from these two lines alone: text put in or cut out
    before them shifts nothing. Before and after a line of LONG_WORDS words one
    always does, whatever stands there. A chunk is two consecutive segments,
    so chunks overlap, and each has at least MIN_LINES lines; a line of
    LONE_WORDS words is a chunk by itself too.
    """
    d = docs.select(F.col(row).alias("row"), F.col(id_col).alias("id"), _lines(text).alias("lines"))
    d = d.where(F.col("lines").isNotNull()).selectExpr(
        "row", "id", f"transform(lines, l -> xxhash64({_bare('l')})) as hashes",
        f"transform(lines, l -> length(l) - length(translate(l, '{_SQL_BLANKS}', '')) + 1) as words")
    d = d.selectExpr(
        "row", "id", "hashes", "words",
        "filter(sequence(0, size(hashes) - 1), i -> i = 0 or "
        f"pmod(xxhash64(get(hashes, i - 2), hashes[i - 1]), {CUT_EVERY}) <> 0 or "
        f"words[i] >= {LONG_WORDS} or words[i - 1] >= {LONG_WORDS}) as starts")
    d = d.selectExpr(
        "row", "id", "hashes", "words",
        "explode(concat(filter(transform(starts, (s, k) -> struct(s, coalesce(get(starts, k + 2), size(hashes)) as e)), "
        f"c -> c.e - c.s >= {MIN_LINES}), "
        f"transform(filter(starts, s -> words[s] >= {LONE_WORDS}), s -> struct(s, s + 1 as e)))) as c")
    return d.where(
        f"aggregate(slice(words, c.s + 1, c.e - c.s), 0, (a, w) -> a + w) >= {MIN_WORDS}"
    ).selectExpr("row", "id", "c.s as s", "c.e as e",
                 "xxhash64(slice(hashes, c.s + 1, c.e - c.s)) as h")


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut out of the text, and ``lines_removed``.

    Of a chunk (see ``_chunks``) that occurs more than once in the whole table
    the lines go from every place but the first one of the least id. Chunks
    overlap, so a line that stays for one chunk may go for another; it has then
    a copy in a lesser id, or earlier. No line is lost: the first line of its
    kind that lies in a repeated chunk stays, by id, then place, since a chunk
    that would cut it there has a place before. Blanks and line breaks at the ends of lines
    do not count, all other bytes must be equal. What is left is not changed
    in any byte. Rows that share the least id each keep it; so do rows with a
    null id if no other row has it. A text of which all lines go
    becomes empty; null stays null; empty texts have no chunk. An empty table
    gives an empty table. A column named ``lines_removed`` is replaced.
    """
    docs = docs.drop("lines_removed")
    row, spans = fresh(docs, "row_no"), fresh(docs, "spans")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    chunks = stored(_chunks(numbered, row, id_col, text), "chunks")
    repeated = chunks.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first_id")) \
                     .where("n > 1").drop("n")
    # the places of a chunk in a row meet where the join by h has put them
    places = chunks.join(repeated, "h").groupBy("h", "row").agg(
        F.bool_and(F.expr("id <=> first_id")).alias("first"), F.min("s").alias("least"),
        F.collect_list(F.struct("s", "e")).alias("at"))
    per_row = places.groupBy("row").agg(F.flatten(F.collect_list(F.transform("at", lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.col("h").alias("h"),
        (~F.col("first") | (x["s"] != F.col("least"))).alias("gone"))))).alias(spans))
    per_row = stored(per_row.withColumnRenamed("row", row), "spans")
    forget(chunks)
    release(docs.sparkSession)
    joined = stored(numbered.join(per_row, row, "left"), "marked")
    release(docs.sparkSession)

    # The lines are a column of their own below the generator, made once a row.
    texts = joined.where(f"{spans} is not null").select(_lines(text).alias("lines"), F.col(spans).alias("spans")) \
        .selectExpr("inline(transform(spans, c -> struct(c.h as h, array_join(transform("
                    f"slice(lines, c.s + 1, c.e - c.s), l -> {_bare('l')}), '\n') as bytes)))")
    unequal = stored(texts.groupBy("h", "bytes").agg(F.lit(1).alias("one"))
                     .groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "unequal")
    if not unequal.isEmpty():  # equal hashes of different bytes: those chunks stay
        right = (joined.where(f"{spans} is not null").select(row, F.inline(spans))
                 .join(unequal, "h", "left_anti")
                 .groupBy(row).agg(F.collect_list(F.struct("s", "e", "h", "gone")).alias(spans)))
        joined = joined.drop(spans).join(right, row, "left")

    gone = F.expr(f"array_distinct(flatten(transform(filter({spans}, c -> c.gone), "
                  "c -> sequence(c.s, c.e - 1))))")
    lost, lines = fresh(joined, "lost"), fresh(joined, "lines")
    out = joined.withColumn(lost, F.coalesce(gone, F.expr("cast(array() as array<int>)")))
    rest = F.expr(f"array_join(transform(array_except(sequence(0, size({lines}) - 1), {lost}), "
                  f"i -> {lines}[i]), '')")
    cut = (out.withColumn(lines, F.when(F.size(lost) > 0, _lines(text)))
           .withColumn("lines_removed", F.size(lost).cast("long"))
           .withColumn(text, F.when(F.size(lost) > 0, rest).otherwise(F.col(text))))
    return cut.select(*docs.columns, "lines_removed")
