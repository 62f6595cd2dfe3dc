"""Queries: scalar functions over strings, dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import column_rules as C
from papyrine.functions import repair as M
from papyrine.functions import text as T
from papyrine.plans.registry import register
from papyrine.sources.tables import PAPERS_SQL, papers, read, spread

P = f"with {PAPERS_SQL} "
ARR = "select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) as w from conversations"


@register("fn1_tokenize_query", "select conv_id, turn, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9_.+-]+'), lambda x: length(x) >= 2), ' ') as tokens from conversations")
def fn1(spark, sf):
    found = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_.+-]+"), 0), lambda x: F.length(x) >= 2)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(found, " ").alias("tokens"))


@register("fn2_normalize_doi", P + "select paper_id, rtrim(lower(replace(doi, 'https://doi.org/', '')), '.') as doi from papers")
def fn2(spark, sf):
    return papers(spark, sf).select("paper_id", T.normalize_doi(F.col("doi")).alias("doi"))


@register("fn3_first_year", "select o_orderkey, try_cast(nullif(regexp_extract('in ' || strftime(o_orderdate, '%Y') || ', no 1234', '(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?:$|[^0-9A-Za-z_])', 1), '') as int) as year from orders")
def fn3(spark, sf):
    text = F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy"), F.lit(", no 1234"))
    return read(spark, sf, "orders").select("o_orderkey", T.first_year(text).alias("year"))


@register("fn4_author_lists", "select n_nationkey, array_to_string(list_filter(list_transform(string_split(n_name || '; ; ' || lower(n_name), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') as authors from nation")
def fn4(spark, sf):
    raw = F.split(F.concat("n_name", F.lit("; ; "), F.lower("n_name")), ";")
    return read(spark, sf, "nation").select("n_nationkey", F.array_join(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""), "|").alias("authors"))


@register("fn5_string_list", "select p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))), ',') as items from part")
def fn5(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))), ",").alias("items"))


@register("fn6_clean_scalar", "select page_id, nullif(trim(regexp_replace(html, '[ \\t\\n\\r\\f]+', ' ', 'g')), '') as cleaned from pages")
def fn6(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.clean_scalar(F.col("html")).alias("cleaned"))


@register("fn7_safe_name", "select page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) as name from pages")
def fn7(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@register("fn8_excerpt", "select doc_id, substr(text, greatest(p - 160, 1), p + 260 - greatest(p - 160, 1)) as excerpt from (select doc_id, text, coalesce(least(nullif(instr(lower(text), 'that'), 0), nullif(instr(lower(text), 'with'), 0)), 1) as p from documents)")
def fn8(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text"), ["that", "with"]).alias("excerpt"))


@register("fn9_summary_sections", "select conv_id, role as section, string_agg(substr(text, 1, 20), '|' order by turn) as items from conversations group by conv_id, role")
def fn9(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id", F.col("role").alias("section"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 20).alias("t")))), lambda x: x["t"])
    return c.agg(F.array_join(items, "|").alias("items"))


@register("fn10_citation_line", "select l_orderkey, l_linenumber, regexp_extract(s, 'page=([0-9]+)', 1) as page, regexp_extract(s, 'section=([A-Z])', 1) as section from (select *, 'page=' || l_linenumber || ' section=' || l_returnflag || ' excerpt=\"x\"' as s from lineitem)")
def fn10(spark, sf):
    l = read(spark, sf, "lineitem")
    s = F.concat(F.lit("page="), F.col("l_linenumber").cast("string"), F.lit(" section="), "l_returnflag", F.lit(' excerpt="x"'))
    return l.select("l_orderkey", "l_linenumber", F.regexp_extract(s, "page=([0-9]+)", 1).alias("page"), F.regexp_extract(s, "section=([A-Z])", 1).alias("section"))


@register("fn11_json_dig", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def fn11(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@register("fn13_short_ids", "select doc_id, substr(sha256(doc_id || ':' || source || ':0001'), 1, 16) as chunk_id, 'doc_' || lpad(cast(doc_id as varchar), 6, '0') as label from documents")
def fn13(spark, sf):
    d = F.col("doc_id").cast("string")
    key = F.concat(d, F.lit(":"), "source", F.lit(":0001"))
    return read(spark, sf, "documents").select("doc_id", F.substring(F.sha2(key, 256), 1, 16).alias("chunk_id"), F.concat(F.lit("doc_"), F.lpad(d, 6, "0")).alias("label"))


@register("fn14_text_normalise", "select doc_id, length(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) as n from documents")
def fn14(spark, sf):
    t = F.regexp_replace(F.regexp_replace(F.translate("text", "\0", ""), "[ \t]+", " "), "\n{3,}", "\n\n")
    return read(spark, sf, "documents").select("doc_id", F.length(t).cast("bigint").alias("n"))


@register("fn15_section_for_offset", "select page_id, list_extract(regexp_extract_all(substr(html, 1, 1500), '<([a-z0-9]+)', 1), -1) as section from pages")
def fn15(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.try_element_at(F.regexp_extract_all(F.substring("html", 1, 1500), F.lit("<([a-z0-9]+)"), 1), F.lit(-1)).alias("section"))


NO_TEXT = (*M.ARTEFACTS, "***", "$$$", "%%%", "###", "&&&")
_FN16 = "coalesce(text, '')"
for _a in NO_TEXT:
    _FN16 = f"replace({_FN16}, '{_a}', '')"


def _fn16_step(n: int, k: int) -> str:
    """One phrase length: the first run of ``k`` words that are those ``k`` places on, and the words without it."""
    span = f"over (partition by doc_id order by i rows between current row and {k - 1} following)"
    return f"""e{n} as (select doc_id, i, x = lead(x, {k}) over (partition by doc_id order by i) as same, length(x) as chars, count(*) over (partition by doc_id) as n from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w{n - 1} where long)),
f{n} as (select doc_id, i, n, sum(coalesce(same, false)::int) {span} as run, sum(chars) {span} as chars from e{n}),
p{n} as (select doc_id, min(i) - 1 as p from f{n} where run = {k} and chars + {k - 1} > 12 and i - 1 < n - {2 * k} group by doc_id),
w{n} as materialized (select w{n - 1}.doc_id, case when p is null then w else list_concat(w[1:p + {k}], w[p + {2 * k + 1}:]) end as w, long from w{n - 1} left join p{n} on p{n}.doc_id = w{n - 1}.doc_id)"""


@register("fn16_clean_repeats", f"with w0 as materialized (select doc_id, w, len(w) > 8 as long from (select doc_id, list_filter(string_split_regex({_FN16}, '{T.SPACE}+'), lambda x: x <> '') as w from documents)), {_fn16_step(1, 5)}, {_fn16_step(2, 6)} select doc_id, len(w)::int as words, md5(array_to_string(w, ' ')) as digest from w2")
def fn16(spark, sf):
    """Every whole text without artefacts (the driver's runs of marks are added) and without the first phrase told twice."""
    d = spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", M.cleaned_words(F.col("text"), NO_TEXT).alias("w"))
    d = d.withColumn("long", F.size("w") >= M.LEAST_WORDS)
    for k in M.PHRASE_WORDS:
        d = d.withColumn("w", F.when(F.col("long"), M.without_repeat(F.col("w"), k)).otherwise(F.col("w")))
    return d.select("doc_id", F.size("w").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@register("fn17_label_normalise", "select p_partkey, case when regexp_matches(s, '^(fig|figure)') then 'Figure ' when regexp_matches(s, '^table') then 'Table ' else 'Other ' end || regexp_extract(s, '([0-9]+)', 1) as label from (select p_partkey, case p_partkey % 3 when 0 then 'fig. ' when 1 then 'table s' else 'dataset ' end || p_size as s from part)")
def fn17(spark, sf):
    s = F.concat(F.when(F.col("p_partkey") % 3 == 0, "fig. ").when(F.col("p_partkey") % 3 == 1, "table s").otherwise("dataset "), F.col("p_size").cast("string"))
    kind = F.when(s.rlike("^(fig|figure)"), "Figure ").when(s.rlike("^table"), "Table ").otherwise("Other ")
    return read(spark, sf, "part").select("p_partkey", F.concat(kind, F.regexp_extract(s, "([0-9]+)", 1)).alias("label"))


@register("fn19_context_window", "select doc_id, substr(text, greatest(p - 200, 1), 400) as context from (select doc_id, text, instr(text, 'that') as p from documents) where p > 0")
def fn19(spark, sf):
    p = F.instr("text", "that")
    return read(spark, sf, "documents").where(p > 0).select("doc_id", F.substr("text", F.greatest(p - 200, F.lit(1)), F.lit(400)).alias("context"))


@register("fn20_sentences", "select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \\n\\t]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) as n from documents")
def fn20(spark, sf):
    parts = F.filter(F.split("text", r"(?<=[.!?])[ \n\t]+"), lambda x: x != "")
    return read(spark, sf, "documents").select("doc_id", F.size(parts).cast("bigint").alias("n"))


@register("fn21_token_overlap", f"with c as ({ARR}), p as (select a.conv_id, a.turn, a.w as x, b.w as y from c a join c b on a.conv_id = b.conv_id and b.turn = a.turn + 1) select conv_id, turn, round(case when len(x) > 0 and len(y) > 0 then len(list_intersect(x, y)) / cast(least(len(x), len(y)) as double) else 0 end, 6) as overlap, round(case when len(list_distinct(list_concat(x, y))) > 0 then len(list_intersect(x, y)) / cast(len(list_distinct(list_concat(x, y))) as double) else 0 end, 6) as jaccard from p")
def fn21(spark, sf):
    from pyspark.sql import Window

    c = read(spark, sf, "conversations").withColumn("x", F.array_distinct(T.words(F.col("text"), 4)))
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("y", F.lead("x").over(w)).withColumn("next", F.lead("turn").over(w)).where("next = turn + 1")
    return c.select("conv_id", "turn", F.round(T.overlap(F.col("x"), F.col("y")), 6).alias("overlap"), F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@register("fn23_direction_from_text", "select conv_id, turn, case when contains(lower(text), 'thatin') then 'down' when contains(lower(text), 'that') then 'up' when contains(lower(text), 'with') then 'mixed' else 'unknown' end as direction from conversations")
def fn23(spark, sf):
    lexicon = {"that": "up", "thatin": "down", "with": "mixed"}
    found: Column = F.lit("unknown")
    for term in reversed(sorted(lexicon, key=lambda t: -len(t))):
        found = F.when(F.lower("text").contains(term), lexicon[term]).otherwise(found)
    return read(spark, sf, "conversations").select("conv_id", "turn", found.alias("direction"))


@register("fn24_direction_from_record", "select c_custkey, case when c_mktsegment = 'BUILDING' then 'up' when c_acctbal > 0 then 'up' when c_acctbal < 0 then 'down' else 'unknown' end as direction from customer")
def fn24(spark, sf):
    m = F.create_map(F.lit("logfc"), F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
    value = T.decimal_comma(F.element_at(m, "logfc"))
    d = F.when(F.col("c_mktsegment") == "BUILDING", "up").when(value > 0, "up").when(value < 0, "down").otherwise("unknown")
    return read(spark, sf, "customer").select("c_custkey", d.alias("direction"))


#: The families with two beginnings of the driver's words each.
FAMILIES = tuple((label, (*patterns, f"^{x}", f"^{y}")) for (label, patterns), x, y in zip(C.COLUMN_FAMILIES, ("tha", "ono", "ino", "ora", "rew", "hehe", "ane"), ("ell", "pou", "nic", "dan", "par", "que", "sch"), strict=True))
_FAMILY_SQL = "case " + " ".join(f"when regexp_matches(n, '{'|'.join(f'(?:{p})' for p in patterns)}') then '{label}'" for label, patterns in FAMILIES) + " else 'unknown' end"


@register("fn25_classify_column", f"select h, {_FAMILY_SQL} as family from (select h, ltrim(trim(regexp_replace(lower(h), '(?:[_-]|{T.SPACE})+', '_', 'g'), '_'), chr(65279)) as n from (select distinct unnest(string_split(string_split(text, chr(10))[1], ' ')) as h from documents))")
def fn25(spark, sf):
    """The words of each document's first line are names of columns."""
    names = read(spark, sf, "documents").select(F.explode(F.split(F.substring_index("text", "\n", 1), " ")).alias("h")).distinct()
    return names.select("h", C.column_family(F.col("h"), FAMILIES).alias("family"))


@register("fn26_normalize_entity", "select p_partkey, regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', ' ', 'g') as entity from part")
def fn26(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.regexp_replace(F.lower(F.trim("p_brand")), "[^a-z0-9]+", " ").alias("entity"))


@register("fn27_entity_mentions", "select doc_id, m as mention from (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z]{3,}[0-9]*'))) as m from documents) where length(m) <= 12")
def fn27(spark, sf):
    e = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z]{3,}[0-9]*"), 0))).alias("mention")
    return read(spark, sf, "documents").select("doc_id", e).where("length(mention) <= 12")


@register("fn28_decimal_comma", "select c_custkey, c_acctbal as value from customer")
def fn28(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", T.decimal_comma(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))).alias("value"))


@register("fn29_header_normalise", "select p_partkey, replace(replace(replace(lower(p_brand), '_', ' '), '-', ' '), '#', ' ') as header from part")
def fn29(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.translate(F.lower("p_brand"), "_-#", "   ").alias("header"))


@register("fn30_citation_markers", "select l_orderkey, l_linenumber, len(regexp_extract_all(s, '\\[[0-9, ]+\\]')) as markers from (select *, 'x [' || l_linenumber || ', 2] y [' || l_suppkey || ']' as s from lineitem)")
def fn30(spark, sf):
    s = F.concat(F.lit("x ["), F.col("l_linenumber").cast("string"), F.lit(", 2] y ["), F.col("l_suppkey").cast("string"), F.lit("]"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.regexp_count(s, F.lit(r"\[[0-9, ]+\]")).cast("bigint").alias("markers"))


@register("fn31_text_stats", "select doc_id, length(text) as chars, len(string_split(text, chr(10))) as lines, round(len(regexp_extract_all(text, '[*#$%&!]')) / cast(greatest(length(text), 1) as double), 6) as odd_ratio from documents")
def fn31(spark, sf):
    odd = F.regexp_count("text", F.lit("[*#$%&!]")) / F.greatest(F.length("text"), F.lit(1))
    return read(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"), F.round(odd, 6).alias("odd_ratio"))


@register("fn32_topic_name", "select source, string_agg(word, ' / ' order by n desc, word) as topic from (select source, word, n, row_number() over (partition by source order by n desc, word) as r from (select source, w as word, count(*) as n from (select source, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as w from documents) group by 1, 2)) where r <= 3 group by source")
def fn32(spark, sf):
    from pyspark.sql import Window

    w = read(spark, sf, "documents").select("source", F.explode(T.words(F.col("text"), 5)).alias("word")).groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word"))
    top = w.withColumn("r", r).where("r <= 3").groupBy("source")
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), " / ").alias("topic"))


@register("fn33_pseudo_citation", P + "select paper_id, split_part(title, ' ', 1) || ' et al., ' || coalesce(cast(year as varchar), 'n.d.') as citation from papers")
def fn33(spark, sf):
    return papers(spark, sf).select("paper_id", F.concat(F.split_part("title", F.lit(" "), F.lit(1)), F.lit(" et al., "), F.coalesce(F.col("year").cast("string"), F.lit("n.d."))).alias("citation"))


@register("fn34_fsm_transitions", "select o_orderstatus || '>' || n as move, count(*) as total, (o_orderstatus || '>' || n) in ('O>P', 'P>F', 'O>F') as allowed from (select o_orderstatus, lead(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n is not null group by o_orderstatus, n")
def fn34(spark, sf):
    from pyspark.sql import Window

    nxt = F.lead("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    moves = read(spark, sf, "orders").withColumn("n", nxt).where("n is not null").groupBy(F.concat("o_orderstatus", F.lit(">"), "n").alias("move")).agg(F.count(F.lit(1)).alias("total"))
    known = spark.createDataFrame([("O>P",), ("P>F",), ("O>F",)], "move string").withColumn("ok", F.lit(True))
    return moves.join(known, "move", "left").select("move", "total", F.coalesce("ok", F.lit(False)).alias("allowed"))


@register("fn35_memory_category", "select p_partkey, case when p_size * 10 > 300 then 'high' when p_size * 10 > 100 then 'medium' else 'low' end as category from part")
def fn35(spark, sf):
    mb = F.col("p_size") * 10
    return read(spark, sf, "part").select("p_partkey", F.when(mb > 300, "high").when(mb > 100, "medium").otherwise("low").alias("category"))


@register("fn36_json_repair", "select event_id, case event_id % 5 when 0 then 'plain' when 1 then 'fenced' when 4 then 'none' else 'repaired' end as how, case when event_id % 5 < 4 then cast(json_extract(props, '$.k') as int) end as k from events")
def fn36(spark, sf):
    """Properties as they are, in a fence, with a comma too many, cut off, and without an opening bracket."""
    i, p = F.col("event_id") % 5, F.rtrim("props")
    shapes = F.when(i == 0, p).when(i == 1, F.concat(F.lit("Answer:\n```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit("so "), F.regexp_replace(p, r"\}$", ", } it is"))).when(i == 3, F.concat(F.regexp_replace(p, r"\}$", ""), F.lit(', "cut'))).otherwise(F.substring(p, 2, 100))
    found = read(spark, sf, "events").select("event_id", M.json_of(shapes).alias("j"))
    return found.select("event_id", "j.how", F.get_json_object("j.json", "$.k").cast("int").alias("k"))


@register("fn37_token_cost", "select doc_id, length(text) // 3 as tokens, round((length(text) // 3) * case lang when 'en' then 0.002 else 0.003 end, 6)::double as cost from documents")
def fn37(spark, sf):
    tokens = F.floor(F.length("text") / 3)
    prices = spark.createDataFrame([("en", 0.002), ("fr", 0.003), ("de", 0.003), ("es", 0.003)], "lang string, price double")
    return read(spark, sf, "documents").join(prices, "lang").select("doc_id", tokens.alias("tokens"), F.round(tokens * F.col("price"), 6).alias("cost"))


@register("fn38_cutoff_days", "select cast(ts as date) as day, count(*) as n from events where ts >= (select max(ts) from events) - interval 7 day group by 1")
def fn38(spark, sf):
    e = read(spark, sf, "events").select("ts")
    last = e.agg(F.max("ts").alias("last"))
    recent = e.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("interval 7 days"))  # one row
    return recent.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
