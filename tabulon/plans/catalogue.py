"""Queries over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import classify, dates, text
from tabulon.operators import joins, retrieval, sequences, timetable
from tabulon.sources import html
from tabulon.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEAN = r"trim(regexp_replace(text, '[\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}]+', ' ', 'g'))"
_FOLD = f"strip_accents(lower({_CLEAN}))"
_WORDS = r"regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)"


@query(f"SELECT doc_id, md5({_CLEAN}) AS cleaned FROM documents")
def q_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


@query(f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents")
def q_latin_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.latin_search_text(F.col("text"))).alias("folded"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_FOLD}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def q_slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query(
    f"WITH t AS (SELECT doc_id, {_FOLD} AS s FROM documents) SELECT doc_id, CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])nicht') THEN '' ELSE concat_ws(',', "
    "CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])licensed under([^a-z0-9_]|$)') THEN 'licence' END, CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])all rights reserved([^a-z0-9_]|$)') THEN 'rights' END, "
    "CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])(an )?thin(g)') OR regexp_matches(s, '(^|[^a-z0-9_])an thin') THEN 'thing' END, CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])que([^a-z0-9_]|$)') THEN 'que' END) END AS labels FROM t"
)
def q_classify_multi(spark, sf_dir):
    rules = {"licence": ["licensed under!"], "rights": ["all rights reserved!"], "thing": ["thing*", "an thin*"], "que": ["que!"]}
    folded = text.latin_search_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(classify.labels(folded, rules, ["nicht*"]), ",").alias("labels"))


_NOTE = "concat('skolska ', year(o_orderdate), '/', year(o_orderdate) + o_orderkey % 3, ', do ', day(o_orderdate), '.', month(o_orderdate), '.', year(o_orderdate), '. godine ', year(o_orderdate) + 1)"


@query(
    f"WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 3 AS k, o_orderdate AS d FROM orders) SELECT o_orderkey, CASE WHEN k = 1 AND y >= 2000 THEN y || '/' || (y + 1) ELSE '' END AS academic, "
    "CASE WHEN y + k >= 2000 AND y >= 2000 THEN concat_ws(',', y, y + 1) WHEN y + k >= 2000 THEN concat_ws(',', y + k, CASE WHEN y + 1 >= 2000 AND y + 1 <> y + k THEN y + 1 END) WHEN y + 1 >= 2000 THEN cast(y + 1 AS VARCHAR) ELSE '' END AS years, strftime(d, '%Y-%m-%d') AS dates FROM t"
)
def q_years_in_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("note", F.expr(_NOTE))
    return o.select("o_orderkey", F.array_join(dates.academic_years(F.col("note")), ",").alias("academic"), F.array_join(dates.calendar_years(F.col("note")), ",").alias("years"), F.array_join(dates.numeric_dates(F.col("note")), ",").alias("dates"))


@query("WITH t AS (SELECT year(o_orderdate) - CASE WHEN month(o_orderdate) >= 10 THEN 0 ELSE 1 END AS y, o_totalprice AS p FROM orders) SELECT y || '/' || (y + 1) AS academic, count(*) AS n, round(sum(p), 2) AS total FROM t GROUP BY 1")
def q_academic_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(dates.academic_year_of(F.col("o_orderdate")).alias("academic")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1997-10-01' AND '1998-09-30'")
def q_year_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter(dates.belongs_to_year(F.lit("bez godine"), F.date_format("o_orderdate", "yyyy-MM-dd"), "1997/1998")).select("o_orderkey")


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount < 0.03) AS low, round(sum(CASE WHEN l_linestatus = 'O' THEN 10 ELSE 1 END), 0) AS weight FROM lineitem GROUP BY 1")
def q_class_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") < 0.03).alias("low"), F.round(F.sum(F.when(F.col("l_linestatus") == "O", 10).otherwise(1)).cast("double"), 0).alias("weight"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY 1, 2")
def q_group_by_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("ids"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q_semi_related(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_anti_applied(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, p_partkey FROM orders JOIN (SELECT p_partkey, p_partkey * 7 AS low, p_partkey * 7 + p_size AS high FROM part) ON o_custkey BETWEEN low AND high")
def q_range_lookup(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7).alias("low"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("high"))
    return joins.range_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", r, "low", "high", 50).select("o_orderkey", "p_partkey")


@query("SELECT n_name, r_name, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def q_fk_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_orphans(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query(
    "WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a) "
    "SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS started, max(event_id) AS ended, count(*) AS n FROM b GROUP BY 1, 2, 3"
)
def q_runs(spark, sf_dir):
    return sequences.runs(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type", "event_id", "event_id")


@query(
    "WITH e AS (SELECT event_type, CAST(value AS DECIMAL(18, 2)) AS value FROM events), a AS (SELECT event_type, value, CASE WHEN value - lag(value) OVER w > 0.05 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY event_type ORDER BY value)), b AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING) AS cluster FROM a) "
    "SELECT event_type, CAST(cluster AS BIGINT) AS cluster, CAST(sum(value) AS DOUBLE) / count(*) AS mean, count(*) AS n FROM b GROUP BY 1, 2"
)
def q_gap_cluster(spark, sf_dir):
    return sequences.gap_clusters(table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)")), ["event_type"], "value", 0.05)


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def q_carry_forward(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sequences.carried(F.when(F.col("event_type") == "purchase", F.col("value")), ["user_id"], ["event_id"]).alias("carried"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def q_first_seen(spark, sf_dir):
    return sequences.first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def q_sorted_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(100)


@query(
    "WITH s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS rank FROM s) SELECT id, neighbour, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"
)
def q_cosine_topk(spark, sf_dir):
    return retrieval.cosine_neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)


@query(f"WITH t AS (SELECT doc_id, CAST(len(list_filter({_WORDS}, lambda w: w IN ('worthless', 'token', 'licensed'))) AS INTEGER) AS score FROM documents) SELECT * FROM t WHERE score > 0")
def q_token_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.term_score(F.col("text"), ["worthless", "token", "licensed"]).alias("score")).filter("score > 0")


@query(f"SELECT doc_id, CAST(len(list_distinct({_WORDS})) AS INTEGER) AS distinct_words FROM documents")
def q_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("distinct_words"))


def _grams(s: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({s}), '([\\p{{L}}\\p{{N}}]+)', 1), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"WITH t AS (SELECT p_partkey, {_grams('p_name')} AS a, {_grams(chr(39) + 'red widgets' + chr(39))} AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM t")
def q_trigram(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.trigram_similarity(F.col("p_name"), F.lit("red widgets")), 6).alias("similarity"))


_TYPO = "concat(substr(p_name, 1, length(p_name) - 1), CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE substr(p_name, length(p_name), 1) END)"


@query(
    f"WITH l AS (SELECT p_name AS candidate, min(p_partkey) AS ord FROM part GROUP BY 1), n AS (SELECT p_partkey, {_TYPO} AS name FROM part), d AS (SELECT name, candidate, ord, levenshtein(upper(name), upper(candidate)) AS distance FROM (SELECT DISTINCT name FROM n), l), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, ord) AS k FROM d WHERE distance <= greatest(1, length(candidate) // 8)) SELECT p_partkey, n.name, coalesce(candidate, n.name) AS snapped FROM n LEFT JOIN r ON n.name = r.name AND k = 1"
)
def q_lexicon_snap(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lexicon = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return joins.snap_to_lexicon(p.select("p_partkey", F.expr(_TYPO).alias("name")), lexicon).select("p_partkey", "name", "snapped")


@query(
    f"WITH e AS (SELECT p_brand, {_TYPO} AS name, p_partkey % 3 = 0 AS ocr, p_partkey AS ord FROM part), w AS (SELECT p_brand, name, sum(CASE WHEN ocr THEN 1 ELSE 10 END) AS weight, min(ord) AS ord FROM e GROUP BY 1, 2), "
    "c AS (SELECT a.p_brand, a.name, b.name AS unified, row_number() OVER (PARTITION BY a.p_brand, a.name ORDER BY b.weight DESC, b.ord) AS k FROM w a JOIN w b ON a.p_brand = b.p_brand AND b.weight > a.weight AND levenshtein(upper(a.name), upper(b.name)) <= greatest(2, CAST(floor(length(b.name) * 0.25) AS INTEGER))) "
    "SELECT w.p_brand, w.name, coalesce(unified, w.name) AS unified FROM w LEFT JOIN c ON w.p_brand = c.p_brand AND w.name = c.name AND k = 1"
)
def q_fuzzy_unify(spark, sf_dir):
    e = table(spark, sf_dir, "part").select("p_brand", F.expr(_TYPO).alias("name"), (F.col("p_partkey") % 3 == 0).alias("from_ocr"), F.col("p_partkey").alias("ord"))
    return joins.unify_names(e, ["p_brand"])


@query(r"WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), u AS (SELECT doc_id, unnest(parts) AS chunk, unnest(range(len(parts))) AS ord FROM t) SELECT doc_id, CAST(ord AS INTEGER) AS ord, md5(chunk) AS digest, CAST(len(regexp_extract_all(chunk, '[^ \t\r\f]+')) AS INTEGER) AS token_count FROM u")
def q_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "chunk"))
    return d.select("doc_id", "ord", F.md5("chunk").alias("digest"), F.regexp_count("chunk", F.lit("[^ \\t\\r\\f]+")).alias("token_count"))


@query(
    "WITH a AS (SELECT l_orderkey, l_linenumber AS row_id, l_quantity AS y0, l_quantity + 10 AS y1 FROM lineitem), b AS (SELECT l_orderkey, l_linenumber AS rid, l_discount * 100 AS r0, l_discount * 100 + 20 AS r1 FROM lineitem), "
    "c AS (SELECT l_orderkey, row_id, rid, greatest(0, least(y1, r1) - greatest(y0, r0)) AS amount FROM a JOIN b USING (l_orderkey)), d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, row_id ORDER BY amount DESC, rid) AS k FROM c WHERE amount > 5) SELECT l_orderkey, row_id, rid, round(amount, 4) AS amount FROM d WHERE k = 1"
)
def q_interval_overlap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", F.col("l_linenumber").alias("row_id"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 10).alias("y1"))
    regions = li.select("l_orderkey", F.col("l_linenumber").alias("rid"), (F.col("l_discount") * 100).alias("r0"), (F.col("l_discount") * 100 + 20).alias("r1"))
    return joins.best_overlap(rows, regions, ["l_orderkey"], "row_id", 0.5).select("l_orderkey", "row_id", "rid", F.round("amount", 4).alias("amount"))


@query("WITH t AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS links FROM pages) SELECT page_id, CAST(len(links) AS INTEGER) AS n, array_to_string(links, ' ') AS links FROM t")
def q_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).alias("n"), F.array_join(links, " ").alias("links"))


@query("SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(url, '[?&]page=([0-9]+)', 1), lambda x: CAST(x AS INTEGER))) > 1, false) AS next_page FROM pages")
def q_next_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.exists(F.regexp_extract_all("url", F.lit("[?&]page=([0-9]+)"), 1), lambda x: x.cast("int") > 1).alias("next_page"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE trim(text) <> '') SELECT conv_id, string_agg(role || ':' || length(trim(text)), '|' ORDER BY turn) AS history FROM r WHERE k <= 4 GROUP BY 1")
def q_chat_window(spark, sf_dir):
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = table(spark, sf_dir, "conversations").filter(F.trim("text") != "").withColumn("k", F.row_number().over(last)).filter("k <= 4")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.length(F.trim("text")).cast("string")).alias("said"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["said"]), "|").alias("history"))


@query("SELECT source, count(*) AS record_count, CAST(sum(CAST(('0x' || sha256(text)[1:15]) AS BIGINT)) AS VARCHAR) AS digest FROM documents GROUP BY 1")
def q_hash_manifest(spark, sf_dir):
    """The digest of a source is the sum of its texts' hashes: it needs no order, and parts add up."""
    part = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("record_count"), F.sum(part).cast("string").alias("digest"))


@query("WITH n AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 4000 THEN c_acctbal ELSE c_acctbal + 1 END AS bal FROM customer) SELECT c.c_custkey, coalesce(n.bal, c.c_acctbal) AS balance FROM customer c LEFT JOIN n USING (c_custkey)")
def q_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.lit(0).alias("seen"))
    new = c.select("c_custkey", F.when(F.col("balance") < 4000, F.col("balance")).otherwise(F.col("balance") + 1).alias("balance"), F.lit(1).alias("seen"))
    return sequences.upsert(c, new, "c_custkey", "balance", "seen").select("c_custkey", "balance")


@query("SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'mala' WHEN 'LARGE' THEN 'velika' ELSE p_type END AS kind FROM part")
def q_map_lookup(spark, sf_dir):
    names = F.create_map(F.lit("SMALL"), F.lit("mala"), F.lit("LARGE"), F.lit("velika"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(names, F.col("p_type")), "p_type").alias("kind"))


@query("SELECT o_orderstatus AS status, o_orderstatus IN ('O', 'F') AS accepted, count(*) AS n FROM orders GROUP BY 1, 2")
def q_accepted_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderstatus").isin("O", "F").alias("accepted")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer)")
def q_union_distinct(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return c.unionByName(s).unionByName(c).distinct()


@query("SELECT l_orderkey, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1, bool_and(l_discount < 0.1) AS every, bool_or(l_tax > 0.07) AS some FROM lineitem GROUP BY 1")
def q_bounding_box(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.min("l_extendedprice").alias("y0"), F.max("l_extendedprice").alias("y1"), F.bool_and(F.col("l_discount") < 0.1).alias("every"), F.bool_or(F.col("l_tax") > 0.07).alias("some"))


@query("SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY 1")
def q_upper_median(spark, sf_dir):
    values = F.array_sort(F.collect_list("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1).alias("upper_median"))


@query("SELECT p_partkey, upper(p_name) AS course, CASE WHEN p_size < 100 THEN CAST(p_size AS VARCHAR) END AS \"group\", 'A' || p_partkey AS room FROM part")
def q_cell_text(spark, sf_dir):
    cell = F.concat(F.upper("p_name"), F.lit("  - "), F.col("p_size").cast("string"), F.lit(" - (A"), F.col("p_partkey").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", timetable.parse_cell(cell).alias("c")).select("p_partkey", "c.course", "c.group", "c.room")


@query("SELECT o_orderkey, 'osnovne_akademske' AS study_level, 'S' || o_orderkey AS course_code, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS date, '09:30' AS time FROM orders")
def q_exam_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.add_months("o_orderdate", 240))  # dates are read from 2000 on
    months = F.array(*map(F.lit, "januar februar mart april maj jun jul avgust septembar oktobar novembar decembar".split()))
    day = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(". "), F.get(months, F.month("o_orderdate") - 1), F.lit(" "), F.year("o_orderdate").cast("string"), F.lit("."))
    line = F.concat(F.lit("ОАС 2014 4 РИИ S"), F.col("o_orderkey").cast("string"), F.lit(" Базе података среда, "), day, F.lit(" 9:30:00"))
    return orders.select("o_orderkey", timetable.exam_row(line).alias("e")).select("o_orderkey", "e.study_level", "e.course_code", "e.date", "e.time")


@query()
def q_article_extract(spark, sf_dir):
    a = html.articles(table(spark, sf_dir, "pages"))
    return a.select("page_id", F.length("article.text").alias("n_chars"), F.size("article.paragraphs").alias("paragraphs"), F.size("article.list_items").alias("items"), F.size("article.links").alias("links"))


@query("SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def q_windowed_counts(spark, sf_dir):
    return ingest.windowed_counts(table(spark, sf_dir, "events"))


@query("SELECT n.n_nationkey AS point, s.s_suppkey AS rid FROM nation n CROSS JOIN LATERAL (SELECT s_suppkey FROM supplier WHERE n.n_nationkey * 100 BETWEEN s_acctbal - 501 AND s_acctbal + 501 + s_suppkey ORDER BY 1002 + s_suppkey, s_suppkey LIMIT 1) s")
def q_region_at(spark, sf_dir):
    points = table(spark, sf_dir, "nation").select(F.lit(0).alias("page"), F.col("n_nationkey").alias("point"), (F.col("n_nationkey") * 100.0).alias("x"), F.lit(5.0).alias("y"))
    regions = table(spark, sf_dir, "supplier").select(F.lit(0).alias("page"), (F.col("s_acctbal") - 500).alias("x0"), (F.col("s_acctbal") + 500 + F.col("s_suppkey")).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"), F.col("s_suppkey").alias("rid"))
    return joins.region_at(points, regions, ["page"], "point").select("point", "rid")
