"""Prefix, membership and substring matches as equality joins: nothing here compares every row with every name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia.functions import text as x
from scrivia.functions.digests import hash_on
from scrivia.lineage import cut
from scrivia.sources.tables import spread


def prefix_join(rows: DataFrame, text: Column, prefixes: DataFrame, prefix: str) -> DataFrame:
    """rows and the rows of prefixes whose `prefix` begins the text: an equality join on prefixes, one key of a row for each length that prefixes have.

    The empty prefix begins every text; null begins none. There are as many lengths as differ among prefixes, at most the longest of them.
    """
    lengths = prefixes.filter(F.col(prefix).isNotNull()).agg(F.array_sort(F.collect_set(F.length(prefix)))).scalar()
    keyed = rows.withColumn("_text", text).withColumn("_lengths", lengths).withColumn("_length", F.explode(F.filter("_lengths", lambda n: n <= F.length("_text"))))
    keyed = keyed.withColumn("_begin", F.substring(F.col("_text"), F.lit(1), F.col("_length")))
    return keyed.join(prefixes, F.col("_begin") == F.col(prefix)).drop("_text", "_lengths", "_length", "_begin")


def not_in(rows: DataFrame, value: Column, listed: DataFrame, of: str) -> DataFrame:
    """rows whose value SQL's NOT IN keeps: all where the list is empty, none where it holds a null, else those with a value that is not in it.

    An anti join and two counts; the engine's own null-aware join would broadcast the list.
    """
    every, given = listed.agg(F.count("*")).scalar(), listed.agg(F.count(F.col(of))).scalar()
    known = listed.select(F.col(of).alias("_listed")).filter("_listed is not null").distinct()
    left = rows.withColumn("_value", value).join(known, F.col("_value") == F.col("_listed"), "left_anti").withColumns({"_all": every, "_given": given})
    return left.filter((F.col("_all") == 0) | ((F.col("_all") == F.col("_given")) & F.col("_value").isNotNull())).drop("_value", "_all", "_given")


def heading_pages(pages: DataFrame, headings: DataFrame, *, id_col: str, scope_col: str, page_col: str, text_col: str) -> DataFrame:
    """(id_col, heading, page, hits, found) for each heading (scope_col, heading) of a report's scope: the page with most of its keywords, the earliest of equals; null where none has any.

    A keyword stands on a page where a word begins with its first five characters, so words and keywords meet by those. Headings without keywords are left out.
    Only pages that hold one of their scope's beginnings anywhere are cut into words, and only those beginnings become rows.
    """
    keys = headings.select(F.col(scope_col).alias("_scope"), "heading", x.keywords_of(F.col("heading")).alias("_keys")).filter("size(_keys) > 0")
    keys = keys.select("_scope", "heading", F.size("_keys").alias("_total"), F.posexplode("_keys").alias("_n", "_key")).select("_scope", "heading", "_total", "_n", F.substring("_key", 1, 5).alias("_stem"))
    wanted = keys.groupBy(F.col("_scope").alias("_of")).agg(F.collect_set("_stem").alias("_stems"))
    low = x.tr_lower(F.col(text_col))
    held = pages.join(F.broadcast(wanted), F.col(scope_col).eqNullSafe(F.col("_of"))).withColumn("_low", low).filter(F.exists("_stems", lambda s: F.contains(F.col("_low"), s)))
    words = F.filter(x.words_of(F.col(text_col)), lambda w: F.length(w) >= 3)
    stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(F.substring(w, 1, 4), F.substring(w, 1, 5)))))
    stood = held.select(id_col, F.col(scope_col).alias("_s"), F.col(page_col).alias("_page"), F.explode(F.array_intersect(stems, "_stems")).alias("_w"))
    met = stood.join(keys, (F.col("_w") == F.col("_stem")) & F.col("_s").eqNullSafe(F.col("_scope")))
    hits = met.groupBy(F.col(id_col).alias("_id"), F.col("heading").alias("_heading"), "_page").agg(F.count_distinct("_n").alias("_hits"))
    best = hits.groupBy("_id", "_heading").agg(F.max("_hits").alias("hits"), F.max_by("_page", F.struct("_hits", -F.col("_page"))).alias("page"))
    every = pages.select(id_col, F.col(scope_col).alias("_s")).distinct().join(keys.select("_scope", "heading", "_total").distinct(), F.col("_s").eqNullSafe(F.col("_scope")))
    out = every.join(best, (F.col(id_col) == F.col("_id")) & (F.col("heading") == F.col("_heading")), "left")
    n = F.coalesce("hits", F.lit(0).cast("long"))
    return out.select(id_col, "heading", "page", n.alias("hits"), (n * 2 >= F.col("_total")).alias("found"))


def grams(text: Column) -> Column:
    """The distinct stretches of one, two and three characters."""
    of = lambda size: F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def postings(entries: DataFrame, *, id_col: str, name_col: str, field_col: str) -> DataFrame:
    """(gram, id, name, hay) of every gram that an entry's folded name and field hold, to be written once: dealt out by gram and a hash of the id, and sorted by gram in each part.

    An entry's texts stand once, in its row of the empty gram, and are null in the others, so that they are not shuffled and stored once for each gram.
    """
    name = x.fold(F.coalesce(F.col(name_col), F.lit("")))
    rows = spread(entries.select(id_col, name_col, field_col)).select(F.col(id_col).alias("id"), name.alias("name"), F.concat_ws(" ", name, x.fold(F.col(field_col))).alias("hay"))
    rows = rows.select(F.explode(F.concat(F.array(F.lit("")), grams(F.col("hay")))).alias("gram"), "id", "name", "hay")
    once = lambda text: F.when(F.col("gram") == "", F.col(text)).alias(text)
    return rows.select("gram", "id", once("name"), once("hay")).repartition("gram", F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions("gram", "id")


def search_many(posted: DataFrame, queries: DataFrame, *, id_col: str, query_col: str, limit: int, rarest: int = 3, pushed: int = 2_000) -> DataFrame:
    """(id_col, query_col, id, rank, place, total) for every query: the entries that hold all of its words, first those whose name begins with it, then those with a word that begins with its
    first word, then the others; of equals the lesser id, at most `limit` of them, and how many there are.

    A word's own grams (its trigrams, or itself where it is shorter) bound where it can stand. Of each query the `rarest` grams are intersected, and what is in all of them is
    verified by its texts, the row of the empty gram. A few queries' grams are pushed into the scan of the postings, which are sorted by gram. A query without words, or null, finds nothing.
    """
    plain = x.fold(F.trim(F.col(query_col)))
    asked = queries.select(F.col(id_col).alias("_q"), F.col(query_col).alias("_wanted"), plain.alias("_query")).withColumn("_words", F.filter(F.split("_query", r"\s+"), lambda w: w != "")).filter("size(_words) > 0")
    gram = lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3))))
    needed = asked.select("_q", F.explode(F.array_distinct(F.flatten(F.transform("_words", gram)))).alias("_gram"))
    own = needed.select("_gram").distinct()
    few = [r["_gram"] for r in own.limit(pushed + 1).collect()]
    read = posted.filter(F.col("gram").isin(few)) if len(few) <= pushed else posted.join(own, F.col("gram") == F.col("_gram"), "left_semi")
    often = read.groupBy("gram").agg(F.count("*").alias("_n"))
    counted = needed.join(often, F.col("_gram") == F.col("gram"), "left").select("_q", "_gram", F.coalesce("_n", F.lit(0)).alias("_n"))
    first = counted.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy("_n", "_gram"))).filter(F.col("_r") <= rarest)
    chosen = first.withColumn("_of", F.count("*").over(Window.partitionBy("_q"))).select("_q", "_gram", "_of")
    both = read.join(chosen, F.col("gram") == F.col("_gram")).groupBy("_q", "id", "_of").agg(F.count("*").alias("_met")).filter("_met = _of").select("_q", "id")
    texts = posted.filter("gram = ''").select(F.col("id").alias("_id"), "name", "hay")
    found = both.join(texts, F.col("id") == F.col("_id")).join(asked.withColumnRenamed("_q", "_own"), F.col("_q") == F.col("_own")).filter(F.forall("_words", lambda w: F.contains(F.col("hay"), w)))
    word = F.get("_words", F.lit(0))
    rank = F.when(F.startswith("name", F.col("_query")), 0).when(F.contains(F.concat(F.lit(" "), F.regexp_replace("name", r"\s", " ")), F.concat(F.lit(" "), word)), 1).otherwise(2)
    ranked = found.select("_q", "_wanted", "id", rank.alias("rank"))
    total = ranked.groupBy(F.col("_q").alias("_t")).agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("_q").orderBy("rank", "id"))
    top = ranked.withColumn("place", place).filter(F.col("place") <= limit).join(total, F.col("_q") == F.col("_t"))
    return top.select(F.col("_q").alias(id_col), F.col("_wanted").alias(query_col), "id", "rank", "place", "total")


_LOCAL = r"^\w+:/*"


def blob_files(spark, folder: str, pattern: str = "*", *, whole: int = 64 << 20, piece: int = 256 << 20) -> DataFrame:
    """(path, name, size, sha256) of the files below a folder, through the binary file source; a file is one row, read where it lies.

    Files of more than `whole` bytes that tasks can open as paths (file:) are not read as rows: they are hashed by pieces, so no task reads more than `piece` bytes
    of them and none holds such a file. Of other file systems every file is read whole by one task, up to the source's limit of 2 GB. Empty files are none of the source's rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    large = files.filter(F.col("length") > whole).select("path", F.col("length").alias("size")).filter(F.startswith("path", F.lit("file:")))
    n = large.count()
    read = files.filter(F.col("length") <= whole) if n else files
    hashed = read.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    if n:
        hashed = hashed.unionByName(_hashed_by_pieces(large, n, piece))
    return hashed.select(F.regexp_replace("path", _LOCAL, "/").alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256")


def _hashed_by_pieces(files: DataFrame, n: int, piece: int) -> DataFrame:
    """(path, size, sha256) of n files. A SHA-256 is one chain over its bytes, so a round hashes the next piece of every file, each in its own task, and hands on the states.

    A task that has two files all the same shares its `piece` bytes between them and leaves the rest to later rounds.
    """
    columns = "path string, size long, at long, state binary, sha256 string"
    left = files.select("path", "size", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("state"), F.lit(None).cast("string").alias("sha256"))
    while True:
        left = cut(left.repartitionByRange(n, "path").mapInArrow(next_pieces(piece), columns))
        if left.filter("sha256 is null").isEmpty():
            return left.select("path", "size", "sha256")


def next_pieces(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = piece
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if row["sha256"] is None and share > 0:
                    begin = row["at"]
                    row["at"], row["state"], row["sha256"] = hash_on(re.sub(_LOCAL, "/", row["path"]), row["size"], begin, row["state"], share)
                    share -= row["at"] - begin
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run
