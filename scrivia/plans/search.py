"""Queries by prefix, membership, heading and substring, over stored files, and state changes as writes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from scrivia.lineage import shared_folder
from scrivia.operators import search, writes
from scrivia.plans.registry import query
from scrivia.sources.tables import spread

_SITE = "regexp_extract(url, '^[^/]*//[^/]*/')"


@query(f"SELECT prefix, page_id FROM pages JOIN (SELECT DISTINCT {_SITE} AS prefix FROM pages UNION SELECT DISTINCT regexp_extract(url, '^[^/]*//[^/]*/[^/?#]*') FROM pages) s ON prefix <> '' AND starts_with(url, prefix)")
def j21_prefix_theta_join(t):
    """Every page under every site and every first path segment that occurs: whole names as prefixes."""
    site = lambda pattern: t.pages.select(F.regexp_extract("url", pattern, 0).alias("prefix"))
    names = site("^[^/]*//[^/]*/").union(site("^[^/]*//[^/]*/[^/?#]*")).filter("prefix != ''").distinct()
    return search.prefix_join(t.pages.select("page_id", "url"), F.col("url"), names, "prefix").select("prefix", "page_id")


_KEYED = "(SELECT c_custkey, CASE WHEN c_custkey % 11 > 0 THEN c_custkey END AS k FROM customer)"


@query(f"""SELECT 'some' AS list, c_custkey FROM {_KEYED} WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'with a null', c_custkey FROM {_KEYED} WHERE k NOT IN (SELECT CASE WHEN o_orderkey % 100 > 0 THEN o_custkey END FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'empty', c_custkey FROM {_KEYED} WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = '?')""")
def p11_j11_not_in(t):
    """Customers outside a list of keys, where some customers have none: a plain list, one that holds a null, and an empty one."""
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey")).alias("k"))
    held = t.orders.filter("o_orderstatus = 'P'")
    lists = {"some": held.select("o_custkey"), "with a null": held.select(F.when(F.col("o_orderkey") % 100 > 0, F.col("o_custkey")).alias("o_custkey")), "empty": t.orders.filter("o_orderstatus = '?'").select("o_custkey")}
    each = [search.not_in(rows, F.col("k"), own, "o_custkey").select(F.lit(name).alias("list"), "c_custkey") for name, own in lists.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


#: Headings that a report of each language needs.
_HEADS = (("en", "the thing that counts"), ("en", "Oranges and lemons"), ("de", "nicht ohne einlich"), ("fr", "Elle est ouverte lelle"), ("es", "de la"), ("es", "Los datos necesarios"))


def _heading_sql(lang: str, heading: str) -> str:
    keys = [w for w in heading.lower().split() if len(w) >= 4]
    hits = " + ".join(f"CASE WHEN len(list_filter(w, lambda y: length(y) >= {min(5, len(key))} AND starts_with(y, '{key[:5]}'))) > 0 THEN 1 ELSE 0 END" for key in keys) or "0"
    return f"SELECT doc_id, '{heading}' AS heading, {len(keys)} AS total, page, {hits} AS hits FROM l WHERE lang = '{lang}'"


@query(f"""WITH p AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents),
l AS (SELECT doc_id, lang, page, list_filter(regexp_split_to_array(lower(translate(replace(line, 'İ', 'i'), 'Iİ', 'ıi')), '[^a-zçğıöşüâîû0-9]+'), lambda y: length(y) >= 3) AS w FROM p),
h AS ({" UNION ALL ".join(_heading_sql(*h) for h in _HEADS)}), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, heading ORDER BY hits DESC, page) AS n FROM h WHERE total > 0)
SELECT doc_id, heading, CASE WHEN hits > 0 THEN page END AS page, CAST(hits AS BIGINT) AS hits, hits * 2 >= total AS found FROM b WHERE n = 1""")
def t9_w6_heading_pages(t):
    """Each line of a text as a page; the pages where the words of its language's headings stand."""
    pages = spread(t.documents.select("doc_id", "lang", "text")).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("page", "line"))
    return search.heading_pages(pages, t.spark.createDataFrame(_HEADS, "lang string, heading string"), id_col="doc_id", scope_col="lang", page_col="page", text_col="line")


_ASKED = "(SELECT min(p_partkey) AS query_id, ' ' || upper(split_part(p_name, ' ', 1)) || '  ' || substr(split_part(p_name, ' ', 2), 1, 2) || ' ' AS query FROM part GROUP BY 2)"


@query(f"""WITH q AS (SELECT query_id, query, string_split(trim(regexp_replace(lower(query), '\\s+', ' ', 'g')), ' ') AS w, lower(trim(query)) AS f FROM {_ASKED}),
e AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_brand) AS name, lower(p_name || ' ' || p_brand) || ' ' || lower(p_type) AS hay FROM part),
m AS (SELECT query_id, query, id, CASE WHEN starts_with(name, f) THEN 0 WHEN contains(' ' || name, ' ' || w[1]) THEN 1 ELSE 2 END AS rank FROM q JOIN e ON contains(hay, w[1]) AND contains(hay, w[2])),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS place, count(*) OVER (PARTITION BY query_id) AS total FROM m)
SELECT query_id, query, id, rank, place, total FROM r WHERE place <= 20""")
def o8_posting_search(t):
    """Many searches at once over entries' postings, which are written once: for each first word and begin of a second word, the twenty first entries and how many there are."""
    word = lambda n: F.split_part(F.col("p_name"), F.lit(" "), F.lit(n))
    query_text = F.concat(F.lit(" "), F.upper(word(1)), F.lit("  "), F.substring(word(2), 1, 2), F.lit(" "))
    queries = t.part.groupBy(query_text.alias("query")).agg(F.min("p_partkey").alias("query_id"))
    path = f"{shared_folder(t.spark)}/postings-{uuid.uuid4().hex}"
    entries = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"), "p_type")
    search.postings(entries, id_col="p_partkey", name_col="name", field_col="p_type").write.parquet(path)
    return search.search_many(t.spark.read.parquet(path), queries, id_col="query_id", query_col="query", limit=20)


@query()
def s5_blob_files(t):
    """The tables' own files as stored objects: name, size and hash; tested against the files, since SQL here does not know the folder."""
    return search.blob_files(t.spark, t.sf_dir, "*.parquet").select("name", "size", "sha256")


@query("SELECT event_type, event_id, CASE WHEN event_type = 'error' THEN -value ELSE value END AS value FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 1)")
def d3_partition_overwrite(t):
    """Events stored by type; the errors' partition is replaced whole by corrected ones, twice, and the others stay."""
    path = f"{shared_folder(t.spark)}/d3-{uuid.uuid4().hex}"
    events = t.events.select("event_type", "event_id", "value")
    writes.replace_partitions(events, path, ["event_type"])
    corrected = events.filter("event_type = 'error' and event_id % 2 = 0").withColumn("value", -F.col("value"))
    for _ in range(2):
        writes.replace_partitions(corrected, path, ["event_type"])
    return t.spark.read.parquet(path).select("event_type", "event_id", "value")


@query("""SELECT 'orders' AS source, o_orderkey AS id, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2
UNION ALL SELECT 'lineitem', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1, 2""")
def d15_purged_tables(t):
    """Orders under review and their lines purged from stored tables, lines first; what is left of either."""
    shared = f"{shared_folder(t.spark)}/d15-{uuid.uuid4().hex}"
    orders, lines = f"{shared}/orders", f"{shared}/lineitem"
    writes.store(t.orders.select("o_orderkey", "o_orderstatus"), orders, "o_orderkey", 16)
    writes.store(t.lineitem.select("l_orderkey", "l_linenumber"), lines, "l_orderkey", 16)
    gone = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey")
    writes.purge_cascade(t.spark, [(lines, "l_orderkey")], (orders, "o_orderkey"), gone, "o_orderkey")
    left = lambda path, key, name: writes.stored(t.spark, path, key).groupBy(F.lit(name).alias("source"), F.col(key).alias("id")).agg(F.count("*").alias("n"))
    return left(orders, "o_orderkey", "orders").unionByName(left(lines, "l_orderkey", "lineitem"))
