"""Operators on rows written by hand."""

import json
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import classify, dates, text
from tabulon.operators import calendar, grid, joins, retrieval, sequences, timetable
from tabulon.sources import html, schemas
from tabulon.streaming import ingest


def one(spark, f, *values):
    """f over each value as a row."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.withColumn("o", f(F.col("v"))).orderBy("i").collect()]


def test_text(spark):
    assert one(spark, text.clean_text, " a   b\n﻿", None, "") == ["a b", None, ""]
    assert one(spark, text.latin_search_text, "Љубав Ђорђе ЏЕП", "Žuć đak é", "Ćirilica Ш") == ["ljubav djordje dzep", "zuc đak e", "cirilica s"]
    assert one(spark, text.slugify, "Јунски рок!", "  Đak -- 1 ", "***") == ["junski-rok", "djak-1", ""]
    assert one(spark, text.clean_recognized, "-|. БАЗЕ  ПОДАТАКА !,", "a-") == ["БАЗЕ ПОДАТАКА", "a-"]
    assert one(spark, text.canonical_group, "a5", "тЗ") == ["АБ", "13"]
    assert one(spark, text.explicit_room, "у САЛА: 12 данас", "лабораторија А5", "ништа") == ["САЛА 12", "лабораторија А5", None]
    assert one(spark, text.note_in_parens, "дан ( по среди ) x", "нема") == ["по среди", ""]
    assert one(spark, lambda c: F.round(text.trigram_similarity(c, F.lit("word")), 4), "word", "two words", "") == [1.0, 0.3636, 0.0]


def test_slug_of_a_slug(spark):
    values = ["A b", "Ћао Свете", "--x--", "é à"]
    once = one(spark, text.slugify, *values)
    assert one(spark, text.slugify, *once) == once


def test_dates(spark):
    assert one(spark, dates.textual_date, "понедељак, 5. март 2026. 10:00", "12.januar 2025", "1. foo 2025", "x") == ["2026-03-05", "2025-01-12", None, None]
    assert one(spark, dates.numeric_dates, "од 1.2.2025. до 31.12.2026. и 3.3.2024", "") == [["2025-02-01", "2026-12-31"], []]
    p = one(spark, dates.period, "траје од 1.2.2025. до 3.4.2025. а 9.9.2025.", "само 5.6.2025.", "нема")
    assert [(x.od, x["do"]) for x in p] == [("2025-02-01", "2025-04-03"), ("2025-06-05", "2025-06-05"), (None, None)]
    assert one(spark, dates.parse_time, "9:05:00", "10:30", None, "") == ["09:05", "10:30", None, None]
    assert one(spark, dates.academic_years, "2025/2026 и 2024-25, 2025–2026, 2025/2027") == [["2025/2026", "2024/2025"]]
    assert one(spark, dates.calendar_years, "2025/2027 па 2024 и x2023, 12025, 2024") == [[2024, 2023]]
    assert one(spark, lambda c: dates.academic_year_of(c.cast("date")), "2025-09-30", "2025-10-01") == ["2024/2025", "2025/2026"]
    belongs = lambda d: lambda c: dates.belongs_to_year(c, F.lit(d), "2025/2026")
    assert one(spark, belongs("2020-01-01"), "za 2025/26", "za 2024/2025", "bez") == [True, False, False]
    assert one(spark, belongs("2026-09-30"), "bez") == [True]
    assert dates.require_academic_year("2025/2026") == "2025/2026"
    with pytest.raises(ValueError):
        dates.require_academic_year("2025/2027")


PROCEDURES = [
    ("Овера јесењег семестра", ["overa_semestra"]), ("Upis studenata u iii godinu", ["upis_godine"]), ("Упис нове школске године", ["upis_godine"]), ("Исписница", ["ispis_sa_fakulteta"]), ("Листа изборних предмета", ["izbor_predmeta_ili_modula"]),
    ("Мировање права", ["status_studenta"]), ("Пријава завршног рада – захтев", ["zavrsni_rad", "obrazac_ili_zahtev"]), ("Стручна пракса", ["strucna_praksa"]), ("Ослобађање од плаћања", []), ("Oslobadjanje placanja", ["skolarina_ili_uplata"]), ("Пријаве испита", ["prijava_ispita"]),
    ("Распоред часова и захтев", []), ("Ранг листа за упис године", []), ("Obrazac", ["obrazac_ili_zahtev"]), ("obrazacx", []), (None, []),
]


def test_procedures(spark):
    got = one(spark, lambda c: classify.procedures(c, F.lit(None).cast("string")), *(t for t, _ in PROCEDURES))
    want = [w for _, w in PROCEDURES]
    want[8] = ["skolarina_ili_uplata"]  # the Cyrillic letter folds to dj
    assert got == want


def test_activities_and_levels(spark):
    got = one(spark, lambda c: classify.activities(c, F.lit("")), "Stručna praksa i kurs", "Internships", "Internship 2025", "Отворена врата", "Rezultati konkursa za praksu", "Povraćaj dela školarine, kurs", "Program podrške", "Hackathon job")
    assert got == [["praksa", "kurs"], [], ["praksa"], ["predavanje_tribina_ili_konferencija"], [], [], ["studentski_program"], ["takmicenje_ili_hakaton", "zaposlenje"]]
    levels = one(spark, lambda c: classify.study_levels(F.lit("mas"), c, F.lit("")), "OAS i DAS", "мастер академске", "ništa")
    assert levels == [["OAS", "DAS"], ["MAS"], ["MAS"]]


LINES = """Јесењи семестар почиње 1.10.2025. и траје од 1.10.2025. до 16.1.2026.
Свечана додела индекса 1.10.2025.
Субота, 8.11.2025. је радна (по распореду од понедељка)
Државни празници и нерадни дани
11.11.2025. Дан примирја
Овера семестра до 16.1.2026.
Јануарски испитни рок одржава се од 19.1.2026. до 9.2.2026.
12.12.2026. више није празник
Пријава испита од 10.1.2026. до 12.1.2026.
Јунски испитни рок одржава се у два полагања
Прво полагање од 1.6.2026. до 12.6.2026.
Пријава испита од 20.5.2026. до 22.5.2026.
Друго полагање од 15.6.2026. до 26.6.2026.""".split("\n")


def test_calendar(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(LINES)] + [("e", 0, "Прво полагање 1.1.2026.")], "doc string, ord int, line string")
    kinds = {r.ord: r.kind for r in calendar.classified(lines).filter("doc = 'd'").collect()}
    assert [kinds[i] for i in range(len(LINES))] == ["autumn", "note", "working_day", "holidays", "holiday", "certification", "exam_period", None, "application", "exam_period", "sitting", "application", "sitting"]
    got = {tuple(r)[1:] for r in calendar.exam_periods(lines).collect()}
    assert got == {
        ("januarski", "Јануарски", None, "2026-01-19", "2026-02-09", "2026-01-10", "2026-01-12"), ("junski", "Јунски", "prvo_polaganje", "2026-06-01", "2026-06-12", "2026-05-20", "2026-05-22"),
        ("junski", "Јунски", "drugo_polaganje", "2026-06-15", "2026-06-26", None, None),
    }
    assert {r.doc: r.missing for r in calendar.completeness(lines).collect()} == {"d": [], "e": ["exam_periods", "semesters", "holidays"]}


def test_cells(spark):
    got = one(spark, timetable.parse_cell, "БАЗЕ ПОДАТАКА - 2 - (А5)", "ФИЗИКА (теорија и пракса велика група) - А1, А2 - (сала 1)", "МАТЕМАТИКА -", "НЕШТО - дуго име - даље .")
    assert [tuple(x) for x in got] == [("БАЗЕ ПОДАТАКА", "2", "А5"), ("ФИЗИКА", "А1, А2", "сала 1"), ("МАТЕМАТИКА", None, None), ("НЕШТО даље", None, None)]


def test_first_year_groups(spark):
    maps = "lec map<string,string>, ex map<string,string>"
    rows = [(0, "МАТ A1, Б2 сала А1", False), (1, "МАТ - А -", True), (2, "МАТ Б", False), (3, "МАТ предмет", False)]
    df = spark.createDataFrame([(*r, {"А": "1", "Б": "2"}, {"А1": "3", "А2": "4", "Б1": "5", "Б2": "5"}) for r in rows], f"i int, raw string, is_lec boolean, {maps}")
    out = df.withColumn("g", timetable.resolve_groups(F.col("raw"), F.col("is_lec"), F.col("lec"), F.col("ex"))).withColumn("r", timetable.rooms_of(F.col("g"), F.when(F.col("is_lec"), F.col("lec")).otherwise(F.col("ex"))))
    got = [(r.g, r.r, r.room) for r in out.withColumn("room", timetable.entry_room(F.col("raw"), F.lit(None).cast("string"), F.col("r"))).orderBy("i").collect()]
    assert got == [(["А1", "Б2"], {"А1": "3", "Б2": "5"}, "сала А1"), (["А"], {"А": "1"}, "1"), (["Б1", "Б2"], {"Б1": "5", "Б2": "5"}, "5"), ([], {}, None)]


def test_exam_rows(spark):
    got = one(spark, timetable.exam_row, "12 ОАС 2014 4 РИИ 2ОЕР Базе података понедељак, 5. јануар 2026. 9:30:00", "MAS 2019 1 KIT X1 Web petak, 6. mart 2026.", "-- 1 of 2 --", "друго")
    assert tuple(got[0]) == ("osnovne_akademske", "2014", "4", "РИИ", "2ОЕР", "Базе података", "2026-01-05", "09:30")
    assert (got[1].study_level, got[1].date, got[1].time) == ("master_akademske", "2026-03-06", None) and got[2:] == [None, None]


def test_names(spark):
    lexicon = spark.createDataFrame([("ОБЈЕКТНО ПРОГРАМИРАЊЕ", 1), ("ФИЗИКА 1", 2), ("ФИЗИКА 2", 3)], "name string, ord int")
    names = spark.createDataFrame([("ОБЈЕКТНО ПРОГРАМИРАЊЕ",), ("ОБЈЕКТHО ПРОГРАМИРАЊE",), ("ФИЗИКE 2",), ("ФИЗЖЖЖ 2",)], "name string")
    got = {r.name: r.snapped for r in joins.snap_to_lexicon(names, lexicon).collect()}
    assert got == {"ОБЈЕКТНО ПРОГРАМИРАЊЕ": "ОБЈЕКТНО ПРОГРАМИРАЊЕ", "ОБЈЕКТHО ПРОГРАМИРАЊE": "ОБЈЕКТНО ПРОГРАМИРАЊЕ", "ФИЗИКE 2": "ФИЗИКА 2", "ФИЗЖЖЖ 2": "ФИЗЖЖЖ 2"}
    rows = spark.createDataFrame([("f", "БАЗЕ ПОДАТАКА", False, 0), ("f", "БАЗЕ ПОДАТКА", True, 1), ("f", "БАЗЕ ПОДАТАКА 2", False, 2), ("g", "БАЗЕ ПОДАТКА", True, 0)], "file string, name string, from_ocr boolean, ord int")
    got = {(r.file, r.name): r.unified for r in joins.unify_names(rows, ["file"]).collect()}
    assert got == {("f", "БАЗЕ ПОДАТАКА"): "БАЗЕ ПОДАТАКА", ("f", "БАЗЕ ПОДАТКА"): "БАЗЕ ПОДАТАКА", ("f", "БАЗЕ ПОДАТАКА 2"): "БАЗЕ ПОДАТАКА 2", ("g", "БАЗЕ ПОДАТКА"): "БАЗЕ ПОДАТКА"}


def test_runs_cover_all_rows(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])] + [(2, 0, "a")], "k int, i int, v string")
    got = sorted((r.k, r.run, r.v, r.n) for r in sequences.runs(rows, ["k"], ["i"], "v", "i", "i").collect())
    assert got == [(1, 1, "a", 2), (1, 2, None, 2), (1, 3, "b", 1), (1, 4, "a", 1), (2, 1, "a", 1)]


LISTING = """<main><ul><li><h3><a href="/article/1#x">Упис</a></h3><p>уто, 5. март 2026. у 10:30</p><p>Опис</p></li>
<li><a href="/article/1#x">Опет</a><time datetime="2026-01-02T10:00">x</time></li><li><a href="mailto:a@b">пошта</a><span>5. март 2026.</span></li>
<li><a href="b.pdf">Други</a><p><time datetime="2025-12-31">31. 12.</time></p><p>S</p></li><li>без везе</li></ul><a href="?page=2">2</a></main><ul><li><a href="/x">ван</a><span>1. мај 2026.</span></li></ul>"""
ARTICLE = f"""<html><body><nav><p>мени</p></nav><div><p>кратко</p></div><article><h1>Н</h1><p>пет, 5. март 2026. 10:30</p><p>{"реч " * 40}<p>други<ul><li>а<li>б</ul>
<a href="/article/7">седам</a><a href="/article/7">опет</a><a href="f/My%20File.PDF?x=1"></a><a href="#a">a</a></article><script>x</script></body></html>"""


def test_html(spark):
    items = html.listing(LISTING)
    assert [(i["title"], i["summary"], i["published"]) for i in items] == [("Упис", "Опис", "2026-03-05"), ("Други", "S", "2025-12-31")]
    a = html.article(ARTICLE, "https://www.example.edu/article/1")
    assert a["list_items"] == ["а", "б"] and a["paragraphs"] == [("реч " * 40).strip(), "други"] and "мени" not in a["text"]
    assert [x["url"] for x in a["links"]] == ["https://www.example.edu/article/7", "https://www.example.edu/article/f/My%20File.PDF?x=1"]
    pages = spark.createDataFrame([("https://www.example.edu/article/1", ARTICLE), ("https://www.example.edu/article/7", "<p>x"), (None, None)], "url string, html string")
    rec = html.articles(pages).withColumnRenamed("url", "source_url")
    assert [(r.source_url[-1], r.url[-1]) for r in html.related(rec).collect()] == [("1", "7")]
    files = rec.select(html.attachments(F.col("article.links")).alias("f")).collect()[0].f
    assert [(x.file_name, x.file_type) for x in files] == [("My File.PDF", "pdf")]
    assert html.lines("<div><p>a <b>b</b></p><li><p>c</p></li><form><p>d</p></form></div>") == ["a b", "c"]
    table = "<table><tr><th>Од броја индекса<tr><td>1<td>20<td>А<td>А1<tr><td>21<td>40<td>А2<tr><td>x<td>y<td>z</table>"
    assert [tuple(r.values()) for r in html.index_ranges(table)] == [(1, 20, "А", "А1"), (21, 40, "А", "А2")]


def test_listings_stop(spark):
    page = lambda n, more: f"<li><a href='/a{n}'>t{n}</a><span>{n}. мај 2026.</span></li>" + ("<a href='?page=9'>" if more else "")
    rows = [("s", 1, page(1, True)), ("s", 2, page(2, False)), ("s", 3, page(3, True)), ("t", 1, page(1, True))]
    got = sorted((r.source, r.title) for r in html.listings(spark.createDataFrame(rows, "source string, page int, html string")).collect())
    assert got == [("s", "t1"), ("s", "t2")]


def test_sources(spark, tmp_path):
    rooms = {"А": "1"}
    doc = {"groupRooms": {"lectures": rooms}, "academicYear": "2025/2026", "schedule": [{"day": "petak", "course": "X", "roomsByGroup": {"А1": "2"}}, {"day": "sreda"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    t = schemas.read_json(spark, str(tmp_path), schemas.TIMETABLE)
    assert [(r.file, r.ord, r.day, r.roomsByGroup) for r in schemas.entries(t).orderBy("ord").collect()] == [("a.json", 0, "petak", {"А1": "2"}), ("a.json", 1, "sreda", None)]
    got = one(spark, schemas.parse_pdf_name, "http://x/12-sem4-rii-v2.pdf", "3-mas1-kit-koi.PDF?x", "other.pdf")
    assert [x and tuple(x) for x in got] == [(4, "RII", None), (1, "KIT", "KOI"), None]
    found = schemas.file_scan(spark, str(tmp_path))
    known = found.withColumn("sha256", F.lit("old")).select("path", "sha256")
    assert schemas.new_files(found, known).count() == 1 and schemas.edited(found, known).count() == 1 and schemas.new_files(found, found.select("path", "sha256")).count() == 0
    out = str(tmp_path / "out")
    assert not schemas.write_guarded(t.limit(0), out) and schemas.write_guarded(schemas.entries(t).select("day", "course"), out, ["day"]) and spark.read.parquet(out).count() == 2


def test_incremental_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put = lambda name, rows: (source / name).write_text("\n".join(map(json.dumps, rows)))
    run = lambda: ingest.ingest(spark, str(source), "url string, body string", str(tmp_path / "t"), str(tmp_path / "c"), "url", "body").awaitTermination()
    put("1.json", [{"url": "a", "body": "x"}, {"url": "a", "body": "x"}, {"url": "b", "body": "y"}])
    run()
    put("2.json", [{"url": "a", "body": "x"}, {"url": "b", "body": "z"}])
    run()
    assert sorted((r.url, r.body) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", "x"), ("b", "y"), ("b", "z")]


def test_cosine_neighbours(spark):
    """Against brute force, with copies, a zero and a NULL; blocks are of bounded size."""
    rng = np.random.default_rng(0)
    v = np.repeat(rng.normal(size=(120, 8)), 3, axis=0).astype(np.float32)
    v[7] = 0
    rows = [(5 * i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)]
    got = retrieval.cosine_neighbours(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 4, 5).collect()
    unit = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1), 1e-300)[:, None]
    s = np.round(unit @ unit.T, 6)
    want = {}
    for i in set(range(len(v))) - {7}:
        order = [j for j in np.lexsort((np.arange(len(v)), -s[i])) if j not in (i, 7)][:4]
        want |= {(5 * i, r): (5 * int(j), float(s[i, j])) for r, j in enumerate(order, 1)}
    assert {(r.id, r["rank"]): (r.neighbour, r.similarity) for r in got} == want


def test_cosine_blocks_are_bounded(monkeypatch, spark):
    """More vectors make more pairs of blocks, and a pair needs memory for one product at a time."""
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 8 * 2 * 100)
    rows = spark.range(1000).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    assert retrieval.cosine_neighbours(rows, "id", "v", 2).count() == 2000
    a = np.random.default_rng(0).normal(size=(6000, 8))
    a /= np.linalg.norm(a, axis=1)[:, None]
    tracemalloc.start()
    found = retrieval.best_pairs(np.arange(6000), a, np.arange(6000, 12000), a, 5, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(f[0]) for f in found] == [30000, 30000] and peak < 8 * 6000 * 6000 / 4


def test_best_overlap_by_parts(monkeypatch, spark):
    """A task's rows don't grow with the table: parts of PART_ROWS, whatever the session's number of parts; the same rows as in one part."""
    rows = spark.range(3000).select((F.col("id") % 700).alias("k"), "id", (F.col("id") % 13).cast("double").alias("y0"), (F.col("id") % 13 + 9.0).alias("y1"))
    regions = spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").alias("rid"), (F.col("id") % 11).cast("double").alias("r0"), (F.col("id") % 11 + 8.0).alias("r1"))
    run = lambda: joins.best_overlap(rows, regions, ["k"], "id", 0.5)
    whole = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(joins, "PART_ROWS", 100)
    assert run().rdd.getNumPartitions() == 30 and sorted(map(tuple, run().collect())) == whole and len(whole) > 2000


def test_counts_of_shapes_by_parts(monkeypatch, spark):
    """A task's rows don't grow with the table, whatever the session's number of parts; the same counts as in one part."""
    box = lambda d, w, h: d.select((F.col("id") % 40).cast("string").alias("page"), F.col("id").alias("rid"), (F.col("id") % 17).cast("double").alias("x0"), (F.col("id") % 17 + w).alias("x1"), (F.floor(F.col("id") / 40) % 5).cast("double").alias("y0"), (F.floor(F.col("id") / 40) % 5 + h).alias("y1"), F.lit("#000000").alias("fill"))
    regions, shapes = box(spark.range(400), 30.0, F.col("id") % 3 + 3.0), box(spark.range(2000), 6.0, 1.0)
    run = lambda: [grid.dashed(regions, shapes).select("page", "rid", "dashed"), grid.with_glyphs(box(spark.range(400), 30.0, 40.0), shapes).select("page", "rid", "glyphs", "drawn")]
    whole = [sorted(map(tuple, d.collect())) for d in run()]
    monkeypatch.setattr(joins, "PART_ROWS", 100)
    assert [d.rdd.getNumPartitions() for d in run()] == [20, 20] and [sorted(map(tuple, d.collect())) for d in run()] == whole
    assert {r[2] for r in whole[0]} == {True, False} and any(r[2] > 5 for r in whole[1])
