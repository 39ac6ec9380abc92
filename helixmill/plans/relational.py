"""Relational and streaming breadth that the engine brings along: joins, grouping sets, windows, sessions, text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.plans.registry import S, exact_sum, query, table


@query("JON04", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("JON05", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_anti(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("JON02 JON10", f"SELECT n_name, r_name, count(*) AS n, {S('c_acctbal')} AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dimension_join(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count("*").alias("n"), exact_sum(F.col("c_acctbal")).alias("balance"))


@query("JON10", "WITH b AS (SELECT p_partkey, p_size * 10 AS lo, p_size * 10 + 5 AS hi FROM part) SELECT CAST(b.lo AS INTEGER) AS lo, count(*) AS n FROM events e JOIN (SELECT DISTINCT lo, hi FROM b) b ON e.value >= b.lo AND e.value < b.hi GROUP BY b.lo")
def range_join(spark, d):
    bands = table(spark, d, "part").select((F.col("p_size") * 10).alias("lo"), (F.col("p_size") * 10 + 5).alias("hi")).distinct()
    # Bands of width 5 start at multiples of 10: the bucket is an equi-join key.
    e = table(spark, d, "events").select("value", (F.floor(F.col("value") / 10) * 10).cast("int").alias("lo"))
    return e.join(bands, "lo").filter("value >= lo AND value < hi").groupBy("lo").agg(F.count("*").alias("n"))


@query("JON10", "WITH f AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase') SELECT f.event_id, max(e.event_id) AS before FROM f LEFT JOIN events e ON e.user_id = f.user_id AND e.event_id < f.event_id AND e.event_type <> 'purchase' GROUP BY f.event_id")
def asof_join(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return e.withColumn("before", F.last(F.when(F.col("event_type") != "purchase", F.col("event_id")), ignorenulls=True).over(w)).filter("event_type = 'purchase'").select("event_id", "before")


@query("AGG23", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {S('l_extendedprice * (1 - l_discount)')} AS revenue FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_summary(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("AGG23", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {S('o_totalprice')} AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_summary(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), exact_sum(F.col("o_totalprice")).alias("total"))


@query("AGG23", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def grouping_sets(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupingSets([[docs.lang], [docs.source], []], docs.lang, docs.source).agg(F.count("*").alias("n"))


@query("AGG23", f"SELECT event_type, {S('value')} AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_users(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(exact_sum(F.col("value")).alias("total"), F.countDistinct("user_id").alias("users"))


@query("PRJ10", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS text, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_template(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"), F.size("r").cast("long").alias("turns"))


@query("", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS paragraphs FROM pages")
def html_parse(spark, d):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), n("<a href=").alias("links"), n("<p[ >]").alias("paragraphs"))


@query("SNK05 SNK06", "SELECT doc_id, '>' || CAST(doc_id AS VARCHAR) || ' L=' || CAST(n_chars AS VARCHAR) || ' q=' || printf('%.2f', CAST(n_chars AS DOUBLE) / 7) || chr(10) || replace(text, chr(10), '') AS record FROM documents")
def fasta_records(spark, d):
    from helixmill.sinks import writers

    header = writers.annotated_header(F.col("doc_id").cast("string"), F.col("n_chars"), q=F.col("n_chars").cast("double") / 7)
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.concat(F.lit(">"), header, F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(""))).alias("record"))


@query("SNK07", "SELECT event_id, printf('ATOM  %5d  CA  GLY A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f           C  ', CAST(event_id % 100000 AS BIGINT), CAST(event_id % 10000 AS BIGINT), CAST(value AS DOUBLE), CAST(1.5 AS DOUBLE), CAST(-2.25 AS DOUBLE), CAST(1 AS DOUBLE), CAST(50 AS DOUBLE)) AS line FROM events")
def pdb_lines(spark, d):
    from helixmill.sinks import writers

    c = F.col
    return table(spark, d, "events").select("event_id", writers.atom_line(c("event_id") % 100000, F.lit("CA"), F.lit("GLY"), F.lit("A"), c("event_id") % 10000, c("value"), F.lit(1.5), F.lit(-2.25), F.lit(50.0)).alias("line"))


@query("SNK01 AGG21", "SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'skipped' ELSE 'success' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def ingest_status(spark, d):
    from helixmill.sinks import writers

    return writers.new_rows(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id").groupBy("status").agg(F.count("*").alias("n"))


@query("JON10", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    from helixmill.streaming import streams

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.windowed(e, "ts", "1 hour", None, ["event_type"], n=F.count("*")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("JON10", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def sessionize(spark, d):
    from helixmill.streaming import streams

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(e, "ts", "30 minutes", ["user_id"], n=F.count("*")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
