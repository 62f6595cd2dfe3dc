"""Queries: sources, sinks, incremental maintenance and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import graph as G
from papyrine.plans.registry import register
from papyrine.sources import sinks as K
from papyrine.sources.tables import read
from papyrine.sources.workdir import work_folder, written
from papyrine.streaming import streams as T
from papyrine.streaming.staging import rocks_state, staged


def rows_n():
    """Number of rows; made when a query is built, since columns need a session."""
    return F.count(F.lit(1))


@register("src1_precedence", "select d.doc_id, coalesce(p.url, 'source:' || d.source) as origin, coalesce(cast(l.quality as varchar), 'unknown') as quality from documents d full outer join pages p on p.page_id = d.doc_id left join labels l on l.doc_id = d.doc_id where d.doc_id is not null")
def src1(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source")
    p = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    l = read(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(p, "doc_id", "left").join(l, "doc_id", "left")
    return j.select("doc_id", F.coalesce("url", F.concat(F.lit("source:"), "source")).alias("origin"), F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality"))


@register("src2_sorted_scan", "select page_id, url from pages order by url, page_id limit 100")
def src2(spark, sf):
    return read(spark, sf, "pages").select("page_id", "url").orderBy("url", "page_id").limit(100)


@register("src3_union_hits", "select 'document' as asset_type, doc_id as id, substr(text, 1, 100) as title, case when n_chars > 2000 then 0.7 else 0.5 end::double as confidence from documents where n_chars > 20 union all select 'page', page_id, substr(url, 1, 100), 0.5 from pages union all select 'turn', conv_id, substr(text, 1, 100), 0.5 from conversations")
def src3(spark, sf):
    d = read(spark, sf, "documents").where("n_chars > 20").select(F.lit("document").alias("asset_type"), F.col("doc_id").alias("id"), F.substring("text", 1, 100).alias("title"), F.when(F.col("n_chars") > 2000, 0.7).otherwise(0.5).alias("confidence"))
    p = read(spark, sf, "pages").select(F.lit("page").alias("asset_type"), F.col("page_id").alias("id"), F.substring("url", 1, 100).alias("title"))
    t = read(spark, sf, "conversations").select(F.lit("turn").alias("asset_type"), F.col("conv_id").alias("id"), F.substring("text", 1, 100).alias("title"))
    return d.unionByName(p, allowMissingColumns=True).unionByName(t, allowMissingColumns=True).fillna(0.5, ["confidence"])


@register("src4_first_non_empty", "select d.doc_id, case when l.doc_id is not null then 'labels' when p.page_id is not null then 'pages' else 'documents' end as chosen from documents d left join labels l using (doc_id) left join pages p on p.page_id = d.doc_id")
def src4(spark, sf):
    l = read(spark, sf, "labels").select("doc_id", F.lit("labels").alias("a"))
    p = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit("pages").alias("b"))
    d = read(spark, sf, "documents").select("doc_id")
    return d.join(l, "doc_id", "left").join(p, "doc_id", "left").select("doc_id", F.coalesce("a", "b", F.lit("documents")).alias("chosen"))


@register("src5_filtered_scan", "select vec_id, label from embeddings where label = 2 order by vec_id limit 20")
def src5(spark, sf):
    return read(spark, sf, "embeddings").where("label = 2").select("vec_id", "label").orderBy("vec_id").limit(20)


@register("src6_delimited_roundtrip", "select p_partkey, p_name, p_size from part")
def src6(spark, sf):
    path = work_folder(spark, "tsv")
    read(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.option("header", True).option("sep", "\t").csv(path)
    return spark.read.schema("p_partkey bigint, p_name string, p_size int").option("header", True).option("sep", "\t").csv(path)


@register("src9_preview", "select source, doc_id, substr(text, 1, 80) as preview from (select *, row_number() over (partition by source order by doc_id) as r from documents) where r <= 3")
def src9(spark, sf):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return read(spark, sf, "documents").select("source", "doc_id", F.substring("text", 1, 80).alias("preview"), r.alias("r")).where("r <= 3").drop("r")


@register("src10_html_text", "select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*(</p>\")?[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ') as body from pages")
def src10(spark, sf):
    t = F.regexp_replace("html", r"<(script|style)[^>]*>[^<]*(</p>\")?[^<]*</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), "[ \t\n\r]+", " ")
    return read(spark, sf, "pages").select("page_id", F.btrim(t, F.lit(" ")).alias("body"))


@register("src11_jsonl_bad_lines", "select event_id, event_type from events where event_id % 10 <> 3")
def src11(spark, sf):
    """Lines that are no JSON are skipped."""
    path = work_folder(spark, "jsonl")
    line = F.to_json(F.struct("event_id", "event_type"))
    broken = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), line)).otherwise(line)
    read(spark, sf, "events").select(broken.alias("value")).write.text(path)
    return spark.read.schema("event_id bigint, event_type string").option("mode", "DROPMALFORMED").json(path).where("event_id is not null")


@register("src12_xml_anchors", "select s_suppkey, s_name from supplier")
def src12(spark, sf):
    path = work_folder(spark, "xml")
    row = F.concat(F.lit("<item><key>"), F.col("s_suppkey").cast("string"), F.lit("</key><name>"), "s_name", F.lit("</name></item>"))
    read(spark, sf, "supplier").select(row.alias("value")).write.text(path)
    item = F.from_xml("value", "key bigint, name string")
    return spark.read.text(path).select(item.alias("x")).select(F.col("x.key").alias("s_suppkey"), F.col("x.name").alias("s_name"))


@register("src13_bundle_classification", "select host, page_id from (select split_part(split_part(url, '://', 2), '/', 1) as host, page_id, row_number() over (partition by split_part(split_part(url, '://', 2), '/', 1) order by case when contains(url, '.html') then 0 else 1 end, length(html) desc, page_id) as r from pages) where r = 1")
def src13(spark, sf):
    from papyrine.operators.linking import best_match

    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    p = read(spark, sf, "pages").select(host.alias("host"), "page_id", F.contains("url", F.lit(".html")).cast("int").alias("main"), F.length("html").alias("n"))
    return best_match(p, ["host"], F.col("main"), [F.desc("n"), F.col("page_id")]).select("host", "page_id")


@register("snk1_group_replace", "select c_custkey, c_nationkey, c_acctbal from customer where c_nationkey not in (select c_nationkey from customer where c_nationkey < 5 and c_custkey % 2 = 0) union all select c_custkey + 1000000, c_nationkey, c_acctbal + 1 from customer where c_nationkey < 5 and c_custkey % 2 = 0")
def snk1(spark, sf):
    t = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    batch = t.where("c_nationkey < 5 and c_custkey % 2 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_nationkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return written(K.replace_groups(t, batch, ["c_nationkey"]), "upsert")


@register("snk2_insert_absent", "select vec_id, label from embeddings where vec_id % 2 = 0 union all select vec_id, 99 from embeddings where vec_id % 2 = 1 and vec_id < 100")
def snk2(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "label")
    batch = e.where("vec_id < 100").withColumn("label", F.lit(99))
    return written(K.insert_absent(e.where("vec_id % 2 = 0"), batch, "vec_id"), "insert")


@register("snk3_append_or_rebuild", "select doc_id, lang from documents where lang in ('en', 'fr')")
def snk3(spark, sf):
    path = work_folder(spark, "append")
    d = read(spark, sf, "documents").select("doc_id", "lang")
    d.where("lang = 'de'").write.mode("overwrite").parquet(path)
    d.where("lang = 'en'").write.mode("overwrite").parquet(path)
    d.where("lang = 'fr'").write.mode("append").parquet(path)
    return spark.read.schema(d.schema).parquet(path)


@register("snk4_status_upsert", "select o_orderkey, case when o_orderkey % 4 = 0 then 'done' else o_orderstatus end as status from orders")
def snk4(spark, sf):
    t = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return written(K.upsert(t, t.where("o_orderkey % 4 = 0").withColumn("status", F.lit("done")), "o_orderkey"), "status")


@register("snk5_json_roundtrip", "select p_partkey, p_brand, p_size from part")
def snk5(spark, sf):
    path = work_folder(spark, "json")
    read(spark, sf, "part").select("p_partkey", "p_brand", "p_size").write.json(path)
    return spark.read.schema("p_partkey bigint, p_brand string, p_size int").json(path)


@register("snk6_graph_export", "select '<node id=\"r' || r_regionkey || '\"/>' as value from region union all select '<node id=\"n' || n_nationkey || '\"/>' from nation union all select '<node id=\"s' || s_suppkey || '\"/>' from supplier union all select '<edge source=\"n' || n_nationkey || '\" target=\"r' || n_regionkey || '\"/>' from nation union all select '<edge source=\"s' || s_suppkey || '\" target=\"n' || s_nationkey || '\"/>' from supplier")
def snk6(spark, sf):
    path = work_folder(spark, "graphml")
    K.graphml(G.nodes(spark, sf), G.edges(spark, sf)).write.text(path)
    return spark.read.text(path)


@register("snk7_report_csv", "select lang, count(*) as n from documents group by lang")
def snk7(spark, sf):
    path = work_folder(spark, "report")
    read(spark, sf, "documents").groupBy("lang").agg(rows_n().alias("n")).write.option("header", True).csv(path)
    return spark.read.schema("lang string, n bigint").option("header", True).csv(path)


@register("snk8_usage_log", "select event_type, count(*) as n from events group by event_type")
def snk8(spark, sf):
    path = work_folder(spark, "log")
    e = read(spark, sf, "events").select("event_id", "event_type")
    for half in (0, 1):
        e.where(f"event_id % 2 = {half}").write.mode("append").json(path)
    return spark.read.schema("event_id bigint, event_type string").json(path).groupBy("event_type").agg(rows_n().alias("n"))


@register("snk9_manifest_verify", "select doc_id, case when doc_id % 50 = 0 then 'missing' when doc_id % 20 = 0 then 'mismatch' else 'verified' end as status from documents")
def snk9(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("now"))
    manifest = d.select("doc_id", F.when(F.col("doc_id") % 20 == 0, F.lit("x")).otherwise(F.col("now")).alias("want"))
    files = d.where("doc_id % 50 <> 0")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("want"), "mismatch").otherwise("verified")
    return manifest.join(files, "doc_id", "left").select("doc_id", status.alias("status"))


@register("st1_tumbling", "select event_type, cast(date_trunc('day', ts) as date) as day, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def st1(spark, sf):
    w = T.tumbling(T.events_stream(spark, sf), "1 day", "event_type")
    flat = w.select("event_type", F.to_date("window.start").alias("day"), "n", F.round("total", 4).alias("total"))
    return T.drained(flat, "complete", "tumbling")


@register("st2_stream_dedup", "select distinct user_id, event_type from events")
def st2(spark, sf):
    s = T.first_seen(T.events_stream(spark, sf).select("ts", "user_id", "event_type"), "user_id", "event_type")
    return T.drained(s, "append", "dedup").select("user_id", "event_type")


@register("st3_changed_groups", "select source from documents where doc_id % 97 = 0 group by source")
def st3(spark, sf):
    old = read(spark, sf, "documents").select("source", "doc_id", "text")
    new = old.withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return K.changed_groups(old, new, ["source"], ["doc_id", "text"])


@register("st4_latest_status", "select user_id, arg_max(event_type, event_id) as last_type, count(*) as n from events group by user_id")
def st4(spark, sf):
    """Last state of every key, kept by a stream that merges each batch into the table of states."""
    s = T.events_stream(spark, sf).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), rows_n().alias("n"))
    return T.drained(s, "complete", "status")


@register("st5_fingerprints", "select lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by lang")
def st5(spark, sf):
    d = read(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    stale = K.changed_groups(d.limit(0), d, ["lang"], ["doc_id", "n_chars"])
    return d.join(stale, "lang", "left_semi").groupBy("lang").agg(rows_n().alias("n"), F.sum("n_chars").alias("chars"))


@register("st6_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as first_ts, count(*) as n from s group by user_id, k""")
def st6(spark, sf):
    s = T.sessions(T.events_stream(spark, sf), "6 hours", "user_id").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first_ts"), "n")
    return T.drained(s, "complete", "sessions")


@register("st6b_staged_uploads")
def st6b(spark, sf):
    """A user's events are steps of uploads; outcomes are those of the state machine, which SQL cannot say."""
    action = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"view": "add", "click": "plan", "purchase": "confirm", "error": "create"}.items() for x in kv]), F.col("event_type")), F.lit("create"))
    e = T.events_stream(spark, sf).select(F.col("user_id").cast("string").alias("session"), action.alias("action"), F.concat(F.lit("f"), F.pmod("event_id", F.lit(7)).cast("string")).alias("name"), F.col("event_id").alias("bytes"), "ts")
    with rocks_state(spark):
        return T.drained(staged(e), "append", "uploads")


@register("st7_sliding", "select event_type, w as start_ts, count(*) as n from (select event_type, unnest([date_trunc('day', ts) - interval 1 day, date_trunc('day', ts)]) as w from events) group by 1, 2")
def st7(spark, sf):
    s = T.sliding(T.events_stream(spark, sf), "2 days", "1 day", "event_type").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start_ts"), "n")
    return T.drained(s, "complete", "sliding")


@register("cp18_table_bodies", """with l as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 as place, case when l_returnflag = 'N' then 1 else 3 end as n from lineitem),
i as (select doc, place, place - row_number() over (partition by doc order by place) as g from l where n = 3) select doc, min(place) as first_line, max(place) as last_line, count(*) as rows from i group by doc, g""")
def cp18(spark, sf):
    from pyspark.sql import Window

    from papyrine.operators.chunking import table_bodies

    l = read(spark, sf, "lineitem")
    place = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")) - 1).cast("bigint")
    line = F.when(F.col("l_returnflag") == "N", "prose").otherwise(F.concat_ws("\t", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag"))
    return table_bodies(l.select(F.col("l_orderkey").alias("doc"), place.alias("place"), line.alias("line")), "doc", "place", "line")


@register("cp22_archive_plan", "select page_id, case when page_id % 9 = 0 then 'skip' when contains(url, '.html') then 'copy' else 'move' end as action, 'archive/' || page_id % 100 || '/' || page_id as target from pages")
def cp22(spark, sf):
    """What an archive run would do, as rows; nothing is copied or moved."""
    k = F.col("page_id")
    action = F.when(k % 9 == 0, "skip").when(F.contains("url", F.lit(".html")), "copy").otherwise("move")
    return read(spark, sf, "pages").select("page_id", action.alias("action"), F.concat(F.lit("archive/"), (k % 100).cast("string"), F.lit("/"), k.cast("string")).alias("target"))


@register("src7_workbook_cells", "select r_regionkey::bigint as row, r_name as value from region")
def src7(spark, sf):
    """A workbook written by hand into the shared folder, read back as cells."""
    import io
    import zipfile

    from papyrine.sources.xlsx import MAIN, read_xlsx

    names = [r.r_name for r in read(spark, sf, "region").orderBy("r_regionkey").collect()]  # a table of fixed size
    rows = "".join(f'<row r="{i + 1}"><c r="A{i + 1}" t="inlineStr"><is><t>{n}</t></is></c></row>' for i, n in enumerate(names))
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
    path = work_folder(spark, "workbook") + "/book.xlsx"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(book.getvalue()))
    out.close()
    return read_xlsx(spark, path).select("row", "value")
