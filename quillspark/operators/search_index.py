"""The mirror's stored full-text index; F19, F20.

Postings are (token, doc_id, ord), a folder a batch, and inside it a folder for each beginning of a
token, whose files are sorted by token: a prefix is a filter on folders and a range of each file. A
dictionary beside it holds every token with its number of documents. A batch adds its own folders and
reads no other; its commit mark is written last, and readers take marked batches only.

Tokens are runs of letters and digits, lower case, without accents, of every indexed column, the id
included. Search words are a-z and 0-9 with three characters at least, so tokens that don't begin so
can't be asked for and aren't stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quillspark import sinks
from quillspark.functions import text
from quillspark.lineage import cut, release

#: Characters of a token that name its folder: one, or two in batches of many GB; those of a token that can be asked for.
MOST_START, LEAST = 2, 3
#: Characters up to which the beginnings of a token are spelled out, to meet the words that are they.
MOST_BEGIN = 12
#: Search words whose ranges are spelled out for the files' own statistics.
RANGES = 64


def tokens(*columns: Column) -> Column:
    """The distinct searchable tokens of some columns."""
    # Whole texts are folded, not tokens: marks and accents make no letter of what is none, nor the other way round.
    plain = lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), text.unaccented(c)).otherwise(F.lower(c))
    runs = lambda c: F.regexp_extract_all(plain(c.cast("string")), F.lit(rf"(?<![\p{{L}}\p{{N}}])([a-z0-9]{{{LEAST}}}[\p{{L}}\p{{N}}]*)"), F.lit(1))
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(runs(c), F.array().cast("array<string>")) for c in columns))))


def extend(mirror: DataFrame, index: str, batch: int, columns: tuple[str, ...] = ("doc_id", "text"), start: int = 1) -> None:
    """Add a batch of documents (doc_id, ord and the indexed columns); one that is there already is skipped.

    There are 36 ** `start` folders at most. Ranges are over token and order, so the postings of a frequent token are several files of several tasks.
    """
    spark = mirror.sparkSession
    if not 1 <= start <= MOST_START:
        raise ValueError("folders are named by one or two characters")
    if batch in sinks.committed(spark, index):
        return
    # Stored, for ranges are found by a sample: else texts would be cut into tokens twice.
    posts = cut(mirror.select("doc_id", "ord", F.explode(tokens(*(mirror[c] for c in columns))).alias("token")), "posts").withColumn("start", F.substring("token", 1, start))
    mirror.select("doc_id", "ord").limit(0).write.mode("ignore").parquet(f"{index}/keys")
    at = f"{index}/postings/batch={batch}"
    posts.repartitionByRange("token", "ord").sortWithinPartitions("start", "token", "ord").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("start").parquet(at)
    release(posts)
    terms = _table(spark, index, "postings", [batch]).groupBy("start", "token").agg(F.count(F.lit(1)).alias("docs"), F.min("ord").alias("first_ord"))
    terms.repartitionByRange("token").sortWithinPartitions("start", "token").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("start").parquet(f"{index}/dictionary/batch={batch}")
    sinks.commit(spark, index, batch)


def _table(spark: SparkSession, index: str, name: str, batches: list[int]) -> DataFrame:
    """Rows of these batches; folder names are text, whatever they look like."""
    kept = {f.name: f.dataType for f in spark.read.parquet(f"{index}/keys").schema}
    own = {"postings": {"token": StringType(), "doc_id": kept["doc_id"], "ord": kept["ord"]}, "dictionary": {"token": StringType(), "docs": LongType(), "first_ord": kept["ord"]}}[name]
    schema = StructType([StructField(c, t) for c, t in (own | {"batch": IntegerType(), "start": StringType()}).items()])
    return spark.read.schema(schema).option("basePath", f"{index}/{name}").parquet(*(f"{index}/{name}/batch={b}" for b in batches))


def _asked(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The rows of an index table that words (word) may need: their folders, and of few words their ranges."""
    starts = [r[0] for r in words.select(F.substring("word", 1, MOST_START)).distinct().collect()]  # 36 ** 2 at most
    rows = rows.where(F.col("start").isin(sorted({s[: k + 1] for s in starts for k in range(MOST_START)})))
    few = [r[0] for r in words.select("word").distinct().limit(RANGES + 1).collect()]
    if 0 < len(few) <= RANGES:
        ranges = [(F.col("token") >= w) & (F.col("token") < w + "\U0010ffff") for w in few]
        while len(ranges) > 1:  # a tree, not a chain
            ranges = [ranges[k] | ranges[k + 1] if k + 1 < len(ranges) else ranges[k] for k in range(0, len(ranges), 2)]
        rows = rows.where(ranges[0])
    return rows


def _fitting(found: DataFrame, words: DataFrame) -> DataFrame:
    """Rows whose token begins with a word: each beginning of a token, of up to MOST_BEGIN characters, meets the words that are it, or begin so and are longer."""
    begins = F.transform(F.sequence(F.lit(LEAST), F.least(F.length("token"), F.lit(MOST_BEGIN))), lambda n: F.substr("token", F.lit(1), n))
    met = found.where(F.length("token") >= LEAST).withColumn("_b", F.explode(begins)).join(words.withColumn("_b", F.substring("word", 1, MOST_BEGIN)), "_b")
    return met.where(F.col("token").startswith(F.col("word"))).drop("_b")


def vocabulary(spark: SparkSession, index: str, words: DataFrame) -> DataFrame:
    """The stored tokens that begin with each word (word), with their number of documents over all batches."""
    asked = words.select("word").distinct()
    rows = _asked(_table(spark, index, "dictionary", sinks.committed(spark, index)), asked)
    terms = rows.groupBy("token").agg(F.sum("docs").alias("docs"), F.min("first_ord").alias("first_ord"))
    return _fitting(terms, asked)


def postings(spark: SparkSession, index: str, words: DataFrame) -> DataFrame:
    """The postings (token, doc_id, ord) of all tokens that begin with one of the words (word)."""
    return _asked(_table(spark, index, "postings", sinks.committed(spark, index)), words.select("word").distinct()).select("token", "doc_id", "ord")


def query_words(queries: DataFrame) -> DataFrame:
    """query_id and word, one row for each different word of a query (query_id, terms)."""
    return queries.select("query_id", F.explode(F.array_distinct(text.query_words(F.col("terms")))).alias("word"))


def search(queries: DataFrame, index: str, limit: int = 4) -> DataFrame:
    """for each query (query_id, terms) the first `limit` documents by `ord` that hold a token beginning with one of its words: query_id, place, doc_id.

    The dictionary says which tokens each different word means; of each token the first `limit` postings are kept, partly
    before the shuffle, then of each word, and only those meet the queries. The limit is the search's own.
    """
    spark, wanted = queries.sparkSession, query_words(queries)
    words = wanted.select("word").distinct()
    if not sinks.committed(spark, index):
        raise ValueError(f"{index}: no batch is committed")
    meant = _fitting(_asked(_table(spark, index, "dictionary", sinks.committed(spark, index)), words).select("token").distinct(), words)
    return matched(first_of(postings(spark, index, words), ["token"], ["ord", "doc_id"], limit), meant, wanted, limit)


def matched(kept: DataFrame, meant: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """The first documents of each query (query_id, word), from those of each word, and these from those of each token: queries with the same word don't meet its tokens each."""
    of_word = first_of(kept.join(meant, "token").select("word", "doc_id", "ord").distinct(), ["word"], ["ord", "doc_id"], limit)
    hits = of_word.join(wanted, "word").select("query_id", "doc_id", "ord").distinct()
    return first_of(hits, ["query_id"], ["ord", "doc_id"], limit).select("query_id", "place", "doc_id")


def search_unstored(queries: DataFrame, mirror: DataFrame, limit: int = 4, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The same over a mirror that has no index, whose every text is read."""
    wanted = query_words(queries)
    posts = mirror.select("doc_id", "ord", F.explode(tokens(*(mirror[c] for c in columns))).alias("token"))
    begins = wanted.select(F.substring("word", 1, LEAST).alias("_b")).distinct()
    asked = posts.withColumn("_b", F.substring("token", 1, LEAST)).join(begins, "_b", "left_semi").drop("_b")
    kept = first_of(asked, ["token"], ["ord", "doc_id"], limit)
    return matched(kept, _fitting(kept.select("token").distinct(), wanted.select("word").distinct()), wanted, limit)


def first_of(rows: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """The first rows of each group, with their `place`; tasks keep as many of a group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= limit)
