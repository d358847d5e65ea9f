"""Queries over small tables written out here, each beside a SQL of the rows that it must give; and page geometry over shapes made of lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import classify, dates, text
from tabulon.operators import documents, geometry, grid, joins, timetable
from tabulon.plans.catalogue import QUERIES, SQL, query, table
from tabulon.sources import html, schemas


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of rows; columns such as "id int, name string"."""
    names, types = zip(*(c.strip().split() for c in columns.split(",")))
    kinds = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "bigint": "BIGINT"}
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    cast = ", ".join(f'CAST({n} AS {kinds[t]}) AS "{n}"' for n, t in zip(names, types))
    return f"SELECT {cast} FROM (VALUES {listed}) AS t({', '.join(names)})"


def case(name: str, schema: str, rows: list[tuple], f, columns: str, expected: list[tuple]) -> None:
    """Registers f over rows of a schema; it must give the expected rows."""

    def run(spark, sf_dir: str) -> DataFrame:
        return f(spark.createDataFrame(rows, schema))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, _values(columns, expected)


def each(name: str, f, pairs: list[tuple], kind: str = "string", inputs: int = 1) -> None:
    """Registers a function of columns, over pairs of inputs and what it gives for them."""
    rows = [(k, *p[:inputs]) for k, p in enumerate(pairs)]
    schema = "id int, " + ", ".join(f"c{i} {'int' if all(isinstance(p[i], int) or p[i] is None for p in pairs) else 'string'}" for i in range(inputs))
    case(name, schema, rows, lambda df: df.select("id", f(*(F.col(f"c{i}") for i in range(inputs))).cast(kind).alias("value")), f"id int, value {kind}", [(k, p[inputs]) for k, p in enumerate(pairs)])


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """The order of a small table, as a column."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


each("q_fold_cyrillic", text.latin_search_text, [("Љубав  Његош", "ljubav njegos"), ("Ђак и Џеп", "djak i dzep"), ("Čćšžđ ĆŠ", "ccszđ cs"), ("АБВ где", "abv gde"), ("plain ASCII", "plain ascii"), (None, None)])
each("q_clean_recognized", text.clean_recognized, [("| _Matematika 2 |", "Matematika 2"), ("^^Fizika;,.", "Fizika"), ("a  ¦ b!", "a b"), ("", "")])
each("q_canonical_group", text.canonical_group, [("г1", "11"), ("Т2", "12"), ("O5", "0Б")])
each("q_explicit_room", text.explicit_room, [("Сала: 534 нешто", "Сала 534"), ("лаб 12", "лаб 12"), ("без", None)])
each("q_letter_count", text.letter_count, [("аб1", 2), ("", 0), ("x", 1)], "int")
each("q_note_in_parens", text.note_in_parens, [("a (b c) d", "b c"), ("none", "")])
each("q_period", lambda c: F.concat_ws("|", dates.period(c)["od"], dates.period(c)["do"]), [("od 1.10.2025. do 5.11.2025. godine", "2025-10-01|2025-11-05"), ("3.2.2026. i 7.2.2026.", "2026-02-03|2026-02-07"), ("nista", "")])
each("q_study_year", lambda level, semester: dates.study_year(level, semester), [("osnovne_akademske", 5, 3), ("master_akademske", 3, 1), ("osnovne_akademske", 8, 4)], "int", 2)
each("q_activities", lambda a, b: joined(classify.activities(a, b)), [("Letnja praksa", "prijave", "praksa"), ("Stipendija i kurs", "", "kurs,stipendija"), ("Rang lista za praksu", "", ""), ("Nista", "posebno", "")], "string", 2)
each("q_procedures", lambda a, b: joined(classify.procedures(a, b)), [("Овера летњег семестра", "", ""), ("Overa prolecnog semestra", "", "overa_semestra"), ("Prijava ispita i uplatnice", "", "skolarina_ili_uplata,prijava_ispita"), ("Raspored ispita", "prijava ispita", "")], "string", 2)
each("q_study_levels", lambda s, t, b: joined(classify.study_levels(s, t, b)), [("mas", "Upis", "tekst", "MAS"), ("x", "OAS upis", "doktorske akademske", "OAS,DAS"), ("x", "nista", "nista", "SVI")], "string", 3)
each("q_file_name", lambda u: F.concat_ws("|", schemas.parse_pdf_name(u)["semester"].cast("string"), schemas.parse_pdf_name(u)["module"], schemas.parse_pdf_name(u)["submodule"]), [("https://x.test/a/1-sem3-rii.pdf", "3|RII"), ("https://x.test/12-mas1-ee-ek-v2.pdf?x=1", "1|EE|EK"), ("https://x.test/sem3.pdf", "")])
each("q_page_url", lambda u, p: schemas.page_url(u, p), [("https://x.test/l", 1, "https://x.test/l"), ("https://x.test/l", 3, "https://x.test/l?page=3")], "string", 2)
each("q_neutral_fill", geometry.is_neutral, [("#808080", True), ("#80808f", True), ("#ff0000", False), ("red", False), (None, False)], "boolean")
each("q_background_fill", geometry.is_background, [("#ffffff", True), ("#f0f0f0", True), ("#ebebeb", False), ("", False)], "boolean")
each("q_region_class", lambda fill, d: geometry.region_class(fill, d == 1, "#c0c0c0"), [("#c0c0c0", 1, "predavanje"), ("#ffffff", 1, "laboratorijske_vezbe"), ("#ffffff", 0, "racunske_vezbe"), ("#ff0000", 0, "ostali_casovi")], "string", 2)
each("q_resource_kind", lambda u: html.resource_kind(u, "https://sip.test/"), [("https://sip.test/a.PDF?x", "dokument"), ("https://sip.test/a", "sip_stranica"), ("https://b.test/", "spoljni_link")])
each("q_day_name", grid.day_of, [("Понедељак", "ponedeljak"), (" уторак ", "utorak"), ("недеља", None), ("СУБОТА", "subota")])
each("q_is_class", grid.is_class, [("Колоквијуми 2026", False), ("Математика", True), ("испити", False), (None, True)], "boolean")
each("q_temporal_scope", lambda a, c: documents.temporal_scope(a, c), [("2025/2026", 2026, "skolska_godina"), (None, 2026, "kalendarska_godina"), (None, None, "opste")], "string", 2)
each("q_user_message", documents.user_message, [("  kada je rok? ", "kada je rok?"), (None, ""), (" ", "")])
each("q_first_year", lambda level, semester: timetable.first_year(level, semester), [("osnovne_akademske", 1, True), ("osnovne_akademske", 3, False), ("master_akademske", 1, False)], "boolean", 2)
each("q_strip_groups", lambda c: grid.strip_groups(c, F.array(F.lit("Г1"), F.lit("A")), text.canonical_group), [("Математика Г1 -", "Математика"), ("Физика, А,", "Физика"), ("Увод", "Увод")])
each("q_output_names", lambda y: F.concat_ws("|", documents.output_name("dokumentacija", y), documents.output_name("konkursi", y)), [("2025/2026", "dokumentacija-2025-2026.json|konkursi-2025-2026.json")])

case(
    "q_candidate_years", "id int, title string, url string, summary string",
    [(1, "Upis 2025/2026", "https://x.test/a", ""), (2, "Konkurs 2026", "https://x.test/article/upis-2024-2025", "2023/2024"), (3, "Rok", "https://x.test/a", "za 2023/24 godinu"), (4, None, "x", None)],
    lambda d: d.select("id", documents.candidate_years(F.col("title"), F.col("url"), F.col("summary")).alias("y")).select("id", "y.*"),
    "id int, academic_year string, calendar_year int", [(1, "2025/2026", None), (2, "2024/2025", 2026), (3, "2023/2024", None), (4, None, None)],
)
case(
    "q_resolved_years", "id int, a string, c int, body string",
    [(1, "2025/2026", None, "2024/2025"), (2, None, None, "skolska 2025/2026"), (3, None, None, "skolska 2024/2025"), (4, None, None, "do 5.5.2026."), (5, None, None, "do 5.5.2024."), (6, None, 2026, "2024"), (7, None, None, ""), (8, "2024/2025", None, ""), (9, None, 2024, "")],
    lambda d: d.filter(documents.worth_fetching(F.col("a"), F.col("c"), "2025/2026", 2026)).select("id", documents.resolved_years(F.col("a"), F.col("c"), F.col("body"), "2025/2026", 2026).alias("y")).filter("y.keep").select("id", "y.academic_year", "y.calendar_year", documents.temporal_scope(F.col("y.academic_year"), F.col("y.calendar_year")).alias("scope")),
    "id int, academic_year string, calendar_year int, scope string", [(1, "2025/2026", None, "skolska_godina"), (2, "2025/2026", None, "skolska_godina"), (4, None, 2026, "kalendarska_godina"), (6, None, 2026, "kalendarska_godina"), (7, None, None, "opste")],
)
case(
    "q_manifest", "url string, file string, entries int, message string", [("b", "b.json", 3, None), ("a", "a.json", 5, None), ("c", None, None, "no lines")],
    lambda d: documents.manifest(d).select("total", "succeeded", "failed", F.array_join("schedules.file", ",").alias("files"), F.array_join("failures.message", ",").alias("messages")),
    "total bigint, succeeded bigint, failed bigint, files string, messages string", [(3, 2, 1, "a.json,b.json", "no lines")],
)
case(
    "q_header_warnings", "id int, s int, y string, fs int, fy string", [(1, 3, "2025/2026", 3, "2025/2026"), (2, 4, "2024/2025", 3, "2025/2026"), (3, None, None, 3, "2025/2026")],
    lambda d: d.select("id", F.size(documents.header_warnings(F.col("s"), F.col("y"), F.col("fs"), F.col("fy"))).alias("n")), "id int, n int", [(1, 0), (2, 2), (3, 0)],
)
case(
    "q_classified", "id int, title string", [(1, "Letnja praksa"), (2, "Nista")],
    lambda d: documents.classified(d, classify.activities(F.col("title"), F.lit("")), "labels").select("id", joined(F.col("labels")).alias("labels")), "id int, labels string", [(1, "praksa")],
)
case(
    "q_newest_first", "id int, published string, title string", [(1, "2026-01-02", "b"), (2, "2026-01-02", "č"), (3, "2026-01-02", "c"), (4, "2026-02-01", "z"), (5, "2026-01-02", "d"), (6, None, "a")],
    lambda d: _ranked(d, documents.newest_first("published", "title")).select("id", "rank"), "id int, rank int", [(4, 1), (1, 2), (3, 3), (2, 4), (5, 5), (6, 6)],
)
case(
    "q_timetable_order", "id int, day string, at string, course string", [(1, "utorak", "08:15", "b"), (2, "ponedeljak", "10:15", "Ž"), (3, "ponedeljak", "10:15", "z"), (4, "ponedeljak", "08:15", "x")],
    lambda d: _ranked(d, [documents.timetable_order(F.col("day"), ["ponedeljak", "utorak"]), F.col("at"), documents.collated(F.col("course"))]).select("id", "rank"), "id int, rank int", [(4, 1), (3, 2), (2, 3), (1, 4)],
)
case(
    "q_filters_hold", "id int, filters map<string,string>", [(1, {"level": "OAS", "year": "2"}), (2, {"level": "MAS"}), (3, {})],
    lambda d: d.filter(documents.contains_all(F.col("filters"), F.create_map(F.lit("level"), F.lit("OAS")))).select("id"), "id int", [(1,)],
)
case(
    "q_group_rooms", "page string, line int, text string", [("p", 1, "Сале за предавања"), ("p", 2, "група А - 534"), ("p", 3, "САЛЕ ЗА РАЧУНСКЕ вежбе"), ("p", 4, "Група А1 – 301"), ("p", 5, "група А1 - 302"), ("q", 1, "група Б - 1")],
    lambda d: grid.group_rooms(d).withColumnRenamed("group", "group_name"), "page string, kind string, group_name string, room string", [("p", "lectures", "А", "534"), ("p", "exercises", "А1", "302")],
)
case(
    "q_header", "page string, line int, text string",
    [("p", 1, "УНИВЕРЗИТЕТ У НИШУ"), ("p", 2, "Рачунарство и информатика"), ("p", 3, "Школска година 2025 / 2026"), ("p", 4, "Семестар: IV"), ("p", 5, "Модул: Софтвер"), ("p", 6, "Семестар: V 2024/2025"), ("q", 1, "Електроника"), ("q", 2, "Семестар: XX")],
    grid.header, "page string, academic_year string, module string, semester int, program string", [("p", "2025/2026", "Софтвер", 4, "Рачунарство и информатика"), ("q", None, "Електроника", None, "Електроника")],
)

X, Y = [0, 40, 140, 240, 340], [0, 30, 60, 90, 120, 150]
SHAPES = [("p", k, float(x), float(x + 1), 0.0, 150.0, "#000000") for k, x in enumerate(X)] + [("p", 10 + k, 0.0, 341.0, float(y), float(y + 1), "#000000") for k, y in enumerate(Y)] + [("p", 30, 0.0, 60.0, -40.0, -20.0, "#c0c0c0"), ("q", 1, 0.0, 1.0, 0.0, 5.0, "#000000")]
NUMBERS = [("p", 100 + 4 * r + k, f"{v}", 3.0 + 9 * k, 9.0 + 9 * k, Y[r] + 12.0, Y[r] + 18.0) for r in range(4) for k, v in enumerate((8 + r, 15, 9 + r, "00"))]
TEXTS = [("p", 1, "Понедељак", 60.0, 120.0, 140.0, 148.0), ("p", 2, "уторак", 160.0, 220.0, 140.0, 148.0), ("p", 3, "среда", 60.0, 100.0, 140.0, 148.0), ("p", 4, "среда", 260.0, 300.0, 140.0, 148.0), ("p", 5, "ПРЕДАВАЊА", 10.0, 50.0, -34.0, -26.0), ("p", 6, "РАЧУНСКЕ ВЕЖБЕ", 70.0, 120.0, -34.0, -26.0), *NUMBERS]
SHAPE, TEXT = "page string, ord int, x0 double, x1 double, y0 double, y1 double, fill string", "page string, ord int, text string, x0 double, x1 double, y0 double, y1 double"


def page_case(name: str, f, columns: str, expected: list[tuple]) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        shapes, texts = spark.createDataFrame(SHAPES, SHAPE), spark.createDataFrame(TEXTS, TEXT)
        return f(shapes, texts, grid.table_box(shapes))

    QUERIES[name], SQL[name] = run, _values(columns, expected)


page_case("q_day_columns", grid.day_columns, "page string, day string, x0 double, x1 double", [("p", "ponedeljak", 40.5, 140.5), ("p", "utorak", 140.5, 240.5), ("p", "sreda", 240.5, 340.5)])
page_case("q_time_rows", lambda s, t, b: grid.time_rows(s, t, b, grid.day_columns(s, t, b)).select("page", "from_time", "to_time", F.floor("y0").cast("int").alias("y0")), "page string, from_time string, to_time string, y0 int", [("p", f"{8 + r:02d}:15", f"{9 + r:02d}:00", Y[r]) for r in range(4)])
page_case("q_legend", lambda s, t, b: grid.legend(s, t, b).select("page", "lecture_fill", "has_lab", F.array_join("labels", "|").alias("labels")), "page string, lecture_fill string, has_lab boolean, labels string", [("p", "#c0c0c0", False, "ПРЕДАВАЊА|РАЧУНСКЕ ВЕЖБЕ")])
page_case("q_inconsistent", lambda s, t, b: grid.inconsistent(grid.day_columns(s, t, b).union(s.sparkSession.createDataFrame([("p", "sreda", 500.0, 600.0)], "page string, day string, x0 double, x1 double")).filter("day <> 'sreda' OR x0 = 500"), t, b), "page string, day string, problem string", [("p", "sreda", "apart")])
case(
    "q_cells", "page string, kind string, id int, text string, x0 double, x1 double, y0 double, y1 double",
    [("p", "r", 1, "", 0.0, 50.0, 50.0, 100.0), ("p", "r", 2, "", 0.0, 50.0, 0.0, 50.0), ("p", "r", 3, "", 60.0, 110.0, 0.0, 50.0), ("p", "r", 4, "", 0.0, 50.0, -50.0, 0.0), ("p", "l", 1, "Мат", 10.0, 40.0, 51.0, 58.0), ("p", "l", 2, "ематика", 10.0, 40.0, 42.0, 49.0)],
    lambda d: grid.cells(d.filter("kind = 'r'").withColumnRenamed("id", "rid"), d.filter("kind = 'l'").withColumnRenamed("id", "line"), d.filter("kind = 'g'")),
    "page string, rid int, cell int", [("p", 1, 1), ("p", 2, 1), ("p", 3, 3), ("p", 4, 4)],
)
case(
    "q_text_lines", TEXT, [("p", 1, "world", 40.0, 60.0, 10.0, 16.0), ("p", 2, "hello", 10.0, 30.0, 11.0, 17.0), ("p", 3, "below", 10.0, 30.0, 0.0, 6.0)],
    lambda d: geometry.text_lines(d).select("page", "line", "text"), "page string, line int, text string", [("p", 0, "hello world"), ("p", 1, "below")],
)
case(
    "q_text_blocks", "page string, line int, text string, x0 double, x1 double, y0 double, y1 double", [("p", 0, "a", 0.0, 10.0, 20.0, 26.0), ("p", 1, "b", 0.0, 10.0, 12.0, 18.0), ("p", 2, "c", 0.0, 10.0, -40.0, -34.0)],
    lambda d: geometry.text_blocks(d).select("page", "line", "block"), "page string, line int, block int", [("p", 0, 0), ("p", 1, 0), ("p", 2, 2)],
)
case(
    "q_listing", "source string, page int, html string",
    [("s", 1, "<main><ul><li><h3><a href='/article/a'>A</a></h3><time datetime='2026-01-05T10:00'></time><p>sum</p></li><li><a href='/article/b'>B</a><p>5. mart 2026 10:00</p></li></ul><a href='?page=2'>2</a></main>"), ("s", 2, "<main><ul><li><a href='/article/a'>A</a><time datetime='2026-01-05'></time></li></ul></main>")],
    lambda d: html.listings(d).select("page", "ord", "title", "summary", "published"), "page int, ord int, title string, summary string, published string", [(1, 0, "A", "sum", "2026-01-05"), (1, 1, "B", "", "2026-03-05")],
)
case(
    "q_timetable_links", "page_url string, level string, html string",
    [("https://x.test/oas", "osnovne_akademske", "<a href='/f/1-sem3-rii.pdf'>Raspored</a><a href='/f/odd.pdf'>x</a><a href='/f/1-sem3-rii.pdf'>again</a><a href='/n'>n</a>"), ("https://x.test/mas", "master_akademske", "<a href='/f/2-mas1-ee.pdf?v=2'>M</a>")],
    lambda d: html.timetable_links(d).select("level", "semester", "study_year", "module", "text"), "level string, semester int, study_year int, module string, text string", [("osnovne_akademske", 3, 2, "RII", "Raspored"), ("master_akademske", 1, 1, "EE", "M")],
)

_SHAPES = "SELECT l_suppkey AS page, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS rid, CAST(l_quantity AS DOUBLE) AS x0, l_quantity + CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE l_partkey % 90 END AS x1, l_tax * 100.0 AS y0, l_tax * 100 + CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 60 ELSE 2 END AS y1 FROM lineitem"


def _line_shapes(spark, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tabulon_lineitem")
    return spark.sql(_SHAPES.replace("FROM lineitem", "FROM tabulon_lineitem").replace("CAST(l_quantity AS DOUBLE)", "double(l_quantity)"))


def _boxes(shapes: DataFrame, height: int) -> DataFrame:
    at = joins.by_parts(shapes, joins.parts(shapes), "page", "rid").groupBy("page", "rid").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"))
    return at.withColumns({"x1": F.col("x0") + 60, "y1": F.col("y0") + height})


@query(
    f"WITH s AS ({_SHAPES}), k AS (SELECT *, x1 - x0 < 4 AND y1 - y0 > 10 AS up, y1 - y0 < 4 AND x1 - x0 > 10 AS across FROM s), w AS (SELECT *, max(CASE WHEN across THEN x1 - x0 END) OVER (PARTITION BY page) AS w, max(CASE WHEN up THEN y1 - y0 END) OVER (PARTITION BY page) AS h FROM k) "
    "SELECT page, round(min(x0) FILTER (across AND x1 - x0 > w * 0.9), 3) AS x0, round(max(x1) FILTER (across AND x1 - x0 > w * 0.9), 3) AS x1, round(min(y0) FILTER (up AND y1 - y0 > h * 0.9), 3) AS y0, round(max(y1) FILTER (up AND y1 - y0 > h * 0.9), 3) AS y1 FROM w GROUP BY 1 HAVING bool_or(up) AND bool_or(across)"
)
def q_table_box(spark, sf_dir):
    return grid.table_box(_line_shapes(spark, sf_dir)).select("page", *(F.round(c, 3).alias(c) for c in ("x0", "x1", "y0", "y1")))


@query(f"WITH s AS ({_SHAPES}), p AS (SELECT rid, page, min(x0) AS x0, min(x0) + 60 AS x1, min(y0) AS y0, min(y0) + 40 AS y1 FROM s GROUP BY 1, 2) SELECT p.page, p.rid, count(s.rid) AS glyphs, count(s.rid) >= 5 AS drawn FROM p LEFT JOIN s ON s.page = p.page AND s.x0 > p.x0 + 1 AND s.x1 < p.x1 - 1 AND s.y0 > p.y0 + 1 AND s.y1 < p.y1 - 1 GROUP BY 1, 2")
def q_glyph_count(spark, sf_dir):
    shapes = _line_shapes(spark, sf_dir)
    return grid.with_glyphs(_boxes(shapes, 40), shapes).select("page", "rid", "glyphs", "drawn")


@query(f"WITH s AS ({_SHAPES}), p AS (SELECT rid, page, min(x0) AS x0, min(x0) + 60 AS x1, min(y0) AS y0, min(y0) + 4 AS y1 FROM s GROUP BY 1, 2) SELECT p.page, p.rid, count(s.rid) >= 3 AS dashed FROM p LEFT JOIN s ON s.page = p.page AND s.y1 - s.y0 < 4 AND s.x0 >= p.x0 - 2 AND s.x1 <= p.x1 + 2 AND s.x1 - s.x0 < 0.6 * (p.x1 - p.x0) AND abs((s.y0 + s.y1) / 2 - p.y1) < 3 GROUP BY 1, 2")
def q_dashed(spark, sf_dir):
    shapes = _line_shapes(spark, sf_dir).withColumn("fill", F.lit("#000000"))
    return grid.dashed(_boxes(shapes, 4), shapes).select("page", "rid", "dashed")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def q_composite_lookup(spark, sf_dir):
    return documents.lookup(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=3).select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def q_parameterised(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least", args={"status": "F", "least": 200000}, orders=orders)
