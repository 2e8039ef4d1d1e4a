"""Quality rules with cross-document line frequency. DataFrame functions only.

Base rules look at one text. The method: lines are normalised (trimmed, white space to single spaces, lower case) and hashed with
their host, the `source` column; the distinct documents that hold each hash are counted; lines in more than `max_docs` documents of a host are
removed; a document is depleted, and rejected, if the removed lines had over `most_removed` of its words.

How it scales: only distinct (host, line hash, document) are shuffled, then counts per line by partial sums, so a line that a third of all
rows hold costs a row a task. Frequent lines alone come back; adaptive execution broadcasts them if they are small and
splits the join if a line is hot. Texts stay where they are, unless clean_text is asked for.

Repeated word windows are found inside a row: hashes of all windows with their places in the low bits of one long, sorted as
primitives, give the windows that may repeat; those are then sorted by their words, and equal neighbours are repeats.

Cases: a null text has no words and fails; a null source is a host of its own. Rows that share a doc_id are one document of their lines, however
many they are, and each has a row in the result; rows without a doc_id are one document if their texts are equal. Equal rows get equal
results. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHITE = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"
MAX_DOCS, MOST_REMOVED = 20, 0.5


def _trim(x: Column) -> Column:
    return F.btrim(x, F.lit(_WHITE))


def words(text: Column) -> Column:
    inside = _trim(text)
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, _GAP, -1))


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(_trim(line), _GAP, " "))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _full(line: Column) -> Column:
    return _trim(line) != ""


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows that a text holds twice or more. df has words `w` and their number n_words."""
    places = F.sequence(F.lit(0), F.col("n_words") - 3)
    window = lambda i: [F.get("w", i + k) for k in range(3)]
    # The low bits hold the place; what is left of the hash tells which windows may be equal.
    df = df.withColumn("_b", F.length(F.bin("n_words")))
    high = lambda x: F.call_function("shiftright", x, F.col("_b"))
    packed = F.transform(places, lambda i: F.call_function("shiftleft", high(F.xxhash64(*window(i))), F.col("_b")).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("_p", F.when(F.col("n_words") >= 4, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    like = lambda x, y: high(x) == high(y)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_b")) - 1
    may = F.filter("_p", lambda x, i: like(x, F.get("_p", i - 1)) | like(x, F.get("_p", i + 1)))
    df = df.withColumn("_m", F.transform(may, lambda x: x.bitwiseAND(mask))).drop("_p", "_b")
    # Words hold no space, so windows are equal if their words joined by spaces are.
    spelled = F.transform("_m", lambda i: F.struct(F.concat_ws(" ", *window(i.cast("int"))).alias("s"), i.alias("i")))
    df = df.withColumn("_q", F.sort_array(spelled)).drop("w", "_m")
    again = F.filter("_q", lambda x, i: (x["s"] == F.get("_q", i - 1)["s"]) | (x["s"] == F.get("_q", i + 1)["s"]))
    df = df.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_q")
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("last"))
    covered = F.aggregate("_at", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("bigint"), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered).drop("_at")


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.col("text")
    df = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("w", words(text)).withColumn("_l", F.filter(_lines(text), _full))
    df = df.select(
        "doc_id",
        "source",
        "text",
        "w",
        _key().alias("key"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(text, _WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    df = _repeat_words(df)
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _key() -> Column:
    return F.xxhash64("doc_id", "source", F.coalesce("text", F.lit("")))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host hash, line hash `h`, n_docs): lines in more than max_docs documents of a host."""
    lines = F.filter(_lines(F.col("text")), _full)
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(F.col("source"), normalised(x))))
    nameless = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit(""))))
    once = docs.select("doc_id", nameless.alias("nameless"), F.explode(hashes).alias("h")).distinct()
    return once.groupBy("h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def removed_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, key, removed: set of (line number from 0, its words)) of the documents that hold frequent lines."""
    lines = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.xxhash64(F.col("source"), normalised(x)).alias("h"), F.size(words(x)).alias("n"), _full(x).alias("full")))
    each = docs.select("doc_id", _key().alias("key"), F.explode(F.filter(lines, lambda x: x["full"])).alias("line")).select("doc_id", "key", "line.i", "line.h", "line.n")
    return each.join(frequent_lines(docs, max_docs), "h").groupBy("doc_id", "key").agg(F.collect_set(F.struct("i", "n")).alias("removed"))


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, most_removed: float = MOST_REMOVED) -> DataFrame:
    """One row for each row of docs: doc_id, the base features, base_failed, n_removed_lines, n_removed_words, kept, clean_text."""
    features = base_features(docs)
    gone = removed_lines(docs, max_docs).withColumnsRenamed({"doc_id": "_doc_id", "key": "_key"})
    out = features.join(gone, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    places = F.transform("removed", lambda x: x["i"])
    clean = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains(places, i)), "\n"))
    out = out.withColumn("n_removed_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed_lines", F.greatest("n_removed_lines", F.lit(0).cast("long")))
    out = out.withColumn("n_removed_words", F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long")))
    depleted = F.col("n_removed_words") > most_removed * F.col("n_words")
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "n_removed_lines",
        "n_removed_words",
        (~F.col("base_failed") & ~depleted).alias("kept"),
        clean.alias("clean_text"),
    )


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")


OP1_SQL = rf"""
with doc as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), line as (
  select r, who, source, l, lower(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) as x, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n
  from (select r, coalesce('i' || doc_id, 'n' || t) as who, source, unnest(string_split(t, chr(10))) as l from doc) where regexp_matches(l, '[^\x20\x09-\x0D]')
), dup as (
  select r, count(*) - count(distinct l) as n_dup_lines from line group by r
), often as (
  select source, x from line group by source, x having count(distinct who) > {MAX_DOCS}
), gone as (
  select r, count(*) as n_removed_lines, cast(sum(n) as bigint) as n_removed_words from line join often on line.x = often.x and line.source is not distinct from often.source group by r
), win as (
  select r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as s from (select r, w, unnest(range(1, len(w) - 1)) as p from doc where len(w) >= 3)
), again as (
  select r, count(distinct p + i) as n_repeat_words from (
    select r, p, unnest(range(0, 3)) as i from (select r, p, count(*) over (partition by r, s) as c from win) where c > 1
  ) group by r
), told as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_removed_lines, 0) as n_removed_lines, coalesce(n_removed_words, 0) as n_removed_words
  from doc left join dup on doc.r = dup.r left join again on doc.r = again.r left join gone on doc.r = gone.r
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not n_removed_words > {MOST_REMOVED} * n_words as kept from told
"""
