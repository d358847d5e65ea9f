"""The grid of a timetable page out of shapes (page, x0, x1, y0, y1, fill) and texts (page, ord, text, x0, x1, y0, y1): table box, day columns, time rows, legend, header, cells. Every function works on all pages at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import clean_text, or_null
from tabulon.operators.geometry import is_background, is_neutral, text_blocks
from tabulon.operators.joins import by_parts, parts
from tabulon.operators.sequences import gap_clusters

DAYS = dict(zip("понедељак уторак среда четвртак петак субота".split(), "ponedeljak utorak sreda cetvrtak petak subota".split()))
NO_CLASS = "(?iu)^(колоквијуми|остали|испити|пријем)"
ROMAN = {n: k for k, n in enumerate("I II III IV V VI VII VIII".split(), 1)}
LEAST_GLYPHS, LEAST_DASHES = 5, 3


def day_of(text: Column) -> Column:
    """The day that a column's header names, in whatever case; NULL for other texts."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in DAYS.items() for x in pair)), F.lower(clean_text(text)))


def is_vertical(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return (x1 - x0 < 4) & (y1 - y0 > 10)


def is_horizontal(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return is_vertical(y0, y1, x0, x1)


_BOX = ("x0", "x1", "y0", "y1")


def _box() -> list[Column]:
    return [F.col(c) for c in _BOX]


def table_box(shapes: DataFrame) -> DataFrame:
    """(page, x0, x1, y0, y1) of each page's table: the ends of its horizontal lines of more than nine tenths of the widest, and of its vertical ones of the highest. Pages without lines of either kind have none."""
    across, up = is_horizontal(*_box()), is_vertical(*_box())
    w = Window.partitionBy("page")
    marked = shapes.withColumns({"__w": F.max(F.when(across, F.col("x1") - F.col("x0"))).over(w), "__h": F.max(F.when(up, F.col("y1") - F.col("y0"))).over(w)})
    wide, high = across & (F.col("x1") - F.col("x0") > F.col("__w") * 0.9), up & (F.col("y1") - F.col("y0") > F.col("__h") * 0.9)
    found = marked.groupBy("page").agg(F.min(F.when(wide, F.col("x0"))).alias("x0"), F.max(F.when(wide, F.col("x1"))).alias("x1"), F.min(F.when(high, F.col("y0"))).alias("y0"), F.max(F.when(high, F.col("y1"))).alias("y1"))
    return found.filter("x0 IS NOT NULL AND y0 IS NOT NULL")


def _of(box: DataFrame) -> DataFrame:
    return box.select("page", *(F.col(c).alias(f"t_{c}") for c in _BOX))


def _bounds(values: DataFrame, value: str, least: int) -> DataFrame:
    """(page, i, low, high): neighbours among the clustered values of pages that have at least so many."""
    w = Window.partitionBy("page").orderBy("mean")
    found = gap_clusters(values, ["page"], value, 3).withColumns({"i": F.row_number().over(w) - 1, "high": F.lead("mean").over(w), "n_": F.count("*").over(Window.partitionBy("page"))})
    return found.filter((F.col("n_") >= least) & F.col("high").isNotNull()).select("page", "i", F.col("mean").alias("low"), "high")


def day_columns(shapes: DataFrame, texts: DataFrame, box: DataFrame) -> DataFrame:
    """(page, day, x0, x1): each day, in the week's order, takes its first column to the right of the day before it. Columns lie between vertical lines of more than four fifths of the table's height, three at least; a header lies in the first column that holds its centre."""
    tall = shapes.join(_of(box), "page").filter(is_vertical(*_box()) & (F.col("y1") - F.col("y0") > 0.8 * (F.col("t_y1") - F.col("t_y0"))))
    columns = _bounds(tall.select("page", ((F.col("x0") + F.col("x1")) / 2).alias("x")), "x", 3)
    heads = texts.select("page", "ord", day_of(F.col("text")).alias("day"), ((F.col("x0") + F.col("x1")) / 2).alias("x")).filter("day IS NOT NULL")
    place = heads.join(columns, "page").filter("x BETWEEN low AND high").groupBy("page", "ord", "day").agg(F.min("i").alias("i"))
    options = place.groupBy("page", "day").agg(F.sort_array(F.collect_set("i")).alias("options"))
    week = F.array(*map(F.lit, DAYS.values()))
    held = F.map_from_entries(F.collect_list(F.struct("day", "options")))
    none = F.lit(None).cast("int")

    def take(state: Column, day: Column) -> Column:
        free = F.get(F.filter(F.try_element_at(F.col("held"), day), lambda i: i > state["last"]), F.lit(0))
        return F.struct(F.coalesce(free, state["last"]).alias("last"), F.concat(state["taken"], F.array(F.coalesce(free, none))).alias("taken"))

    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("taken"))
    chosen = options.groupBy("page").agg(held.alias("held")).select("page", F.posexplode(F.aggregate(week, start, take, lambda s: s["taken"])).alias("at", "i")).filter("i IS NOT NULL")
    return chosen.join(columns, ["page", "i"]).select("page", F.get(week, F.col("at")).alias("day"), F.col("low").alias("x0"), F.col("high").alias("x1"))


def time_rows(shapes: DataFrame, texts: DataFrame, box: DataFrame, columns: DataFrame) -> DataFrame:
    """(page, from_time, to_time, y0, y1): rows between the horizontal lines through the middle of the time column (the table's ends among them, five at least) that hold four numbers there: hour, minute, hour, minute. Pages of fewer than four such rows have none."""
    side = _of(box).join(columns.groupBy("page").agg(F.min("x0").alias("t_right")), "page")
    middle = F.col("t_x0") + (F.col("t_right") - F.col("t_x0")) * 0.5
    lines = shapes.join(side, "page").filter(is_horizontal(*_box()) & (F.col("x0") <= middle) & (F.col("x1") >= middle)).select("page", ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    ends = side.select("page", F.explode(F.array("t_y0", "t_y1")).alias("y"))
    rows = _bounds(lines.union(ends), "y", 5)
    digits = texts.join(side, "page").filter((F.col("x0") >= F.col("t_x0") - 2) & (F.col("x1") <= F.col("t_right") + 2) & clean_text(F.col("text")).rlike("^[0-9]{1,2}$"))
    placed = digits.select("page", clean_text(F.col("text")).alias("d"), "x0", "ord", ((F.col("y0") + F.col("y1")) / 2).alias("y")).join(rows, "page").filter("y > low AND y < high")
    parts = placed.groupBy("page", "i", "low", "high").agg(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "d"))), lambda p: F.lpad(p["d"], 2, "0")).alias("p")).filter(F.size("p") == 4)
    told = parts.withColumn("n_", F.count("*").over(Window.partitionBy("page"))).filter("n_ >= 4")
    time = lambda k: F.concat_ws(":", F.get("p", F.lit(k)), F.get("p", F.lit(k + 1)))
    return told.select("page", time(0).alias("from_time"), time(2).alias("to_time"), F.col("low").alias("y0"), F.col("high").alias("y1"))


def inconsistent(columns: DataFrame, texts: DataFrame, box: DataFrame) -> DataFrame:
    """(page, day, problem) of day columns none of whose headers lies over them ("apart"), or only outside the table ("outside")."""
    heads = texts.select("page", day_of(F.col("text")).alias("day"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y0").alias("y")).filter("day IS NOT NULL")
    over = F.col("x").between(F.col("x0"), F.col("x1"))
    both = columns.join(heads, ["page", "day"]).join(_of(box), "page").groupBy("page", "day").agg(F.bool_or(over).alias("over"), F.bool_or(over & F.col("y").between(F.col("t_y0"), F.col("t_y1"))).alias("inside"))
    return both.filter("NOT inside").select("page", "day", F.when(F.col("over"), "outside").otherwise("apart").alias("problem"))


def legend(shapes: DataFrame, texts: DataFrame, box: DataFrame) -> DataFrame:
    """(page, lecture_fill, has_lab, labels): below the table, the grey fill of the first shape around the first label of lectures, and all labels, each once. Pages without such a shape, or without a label of exercises, have none."""
    low = texts.join(_of(box), "page").filter("y1 < t_y0").withColumn("label", clean_text(F.col("text")))
    first = Window.partitionBy("page").orderBy("ord")
    lecture = low.filter(F.col("label").rlike("(?iu)предавањ")).withColumn("r", F.row_number().over(first)).filter("r = 1").select("page", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "t_y0")
    fits = is_neutral(F.col("fill")) & ~is_background(F.col("fill")) & (F.col("fill") != "#000000") & (F.col("y1") < F.col("t_y0")) & F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1"))
    swatch = lecture.join(shapes, "page").filter(fits).groupBy("page").agg(F.min_by("fill", "ord").alias("lecture_fill"))
    every = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]))
    joined = low.groupBy("page").agg(every.alias("labels"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), " ").alias("all"))
    return swatch.join(joined.filter(F.col("all").rlike("(?iu)рачунске")), "page").select("page", "lecture_fill", F.col("all").rlike("(?iu)лаб").alias("has_lab"), "labels")


def header(lines: DataFrame) -> DataFrame:
    """(page, academic_year, module, semester, program) from header lines (page, line, text) above a table: of each the first line that names it, of semesters the first that is a number; the program is the first line of more than three letters that is none of these; a module that isn't named is the program."""
    text = clean_text(F.col("text"))
    year = F.regexp_replace(or_null(F.regexp_extract(text, "([0-9]{4}\\s*/\\s*[0-9]{4})", 1)), "\\s+", "")
    module = or_null(clean_text(F.regexp_extract(text, "(?iu)Модул\\s*:?\\s*(.+)$", 1)))
    roman = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    semester = F.try_element_at(roman, F.upper(or_null(F.regexp_extract(text, "(?iu)Семестар\\s*:?\\s*([IVX]+)\\b", 1))))
    program = F.when((F.length(text) > 3) & ~text.rlike("(?iu)Универзитет|Електронски факултет|Школска година|Распоред часова|Семестар|Модул"), text)
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line")))
    found = lines.groupBy("page").agg(first(year).alias("academic_year"), first(module).alias("module"), first(semester).alias("semester"), first(program).alias("program"))
    return found.withColumn("module", F.coalesce("module", "program"))


def _counted(regions: DataFrame, shapes: DataFrame, holds: Column, name: str) -> DataFrame:
    """regions with the number of shapes of their page for which a condition on the shape's x0..y1 and the region's r_x0..r_y1 holds; NULL for none. In parts of bounded size, by the number of shapes."""
    n = parts(shapes)
    r = by_parts(regions.select("page", "rid", *(F.col(c).alias(f"r_{c}") for c in _BOX)), n, "page")
    found = r.join(by_parts(shapes.select("page", *_BOX), n, "page"), "page").filter(holds).groupBy("page", "rid").agg(F.count("*").alias(name))
    return by_parts(regions, n, "page", "rid").join(by_parts(found, n, "page", "rid"), ["page", "rid"], "left")


def dashed(regions: DataFrame, shapes: DataFrame) -> DataFrame:
    """regions (page, rid, x0..y1) with dashed: at least LEAST_DASHES black segments, each under six tenths of its width, lie along the upper edge."""
    short = (F.col("y1") - F.col("y0") < 4) & (F.col("x0") >= F.col("r_x0") - 2) & (F.col("x1") <= F.col("r_x1") + 2) & (F.col("x1") - F.col("x0") < 0.6 * (F.col("r_x1") - F.col("r_x0"))) & (F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("r_y1")) < 3)
    return _counted(regions, shapes.filter("fill = '#000000'"), short, "n").withColumn("dashed", F.coalesce(F.col("n") >= LEAST_DASHES, F.lit(False))).drop("n")


def with_glyphs(cells: DataFrame, glyphs: DataFrame) -> DataFrame:
    """cells (page, rid, x0..y1) with the number of glyph shapes more than one unit inside, and whether that is enough for a text (drawn)."""
    inside = (F.col("x0") > F.col("r_x0") + 1) & (F.col("x1") < F.col("r_x1") - 1) & (F.col("y0") > F.col("r_y0") + 1) & (F.col("y1") < F.col("r_y1") - 1)
    return _counted(cells, glyphs, inside, "glyphs").fillna(0, ["glyphs"]).withColumn("drawn", F.col("glyphs") >= LEAST_GLYPHS)


def is_class(course: Column) -> Column:
    """Whether a cell is a class: its text isn't one of the labels that head other parts of the page."""
    return ~F.coalesce(clean_text(course).rlike(NO_CLASS), F.lit(False))


def cells(regions: DataFrame, lines: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(page, rid, cell): regions of one width that touch are one cell if a block of text or a glyph crosses the edge between them, unless both hold the same text; cell is the least rid of those that hang together. One page is one task's: its result depends on all pairs of its regions."""
    blocks = text_blocks(lines).join(lines.select("page", "line", *_BOX), ["page", "line"])
    kinds = [regions.select("page", F.lit("r").alias("kind"), F.col("rid").alias("id"), F.lit("").alias("text"), *_BOX), blocks.select("page", F.lit("l").alias("kind"), F.col("block").cast("int").alias("id"), "text", *_BOX), glyphs.select("page", F.lit("g").alias("kind"), F.lit(0).alias("id"), F.lit("").alias("text"), *_BOX)]

    def f(page: pd.DataFrame) -> pd.DataFrame:
        own, texts, drawn = (page[page.kind == k].sort_values(["id", "y0"], ascending=[True, False]) for k in "rlg")
        root = {int(i): int(i) for i in own.id}
        center = ((texts.x0 + texts.x1) / 2, (texts.y0 + texts.y1) / 2)

        def top(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        def held(r) -> list[str]:
            return list(texts.text[(center[0] >= r.x0 - 1) & (center[0] <= r.x1 + 1) & (center[1] >= r.y0) & (center[1] <= r.y1)])

        rows = list(own.itertuples())
        for k, a in enumerate(rows):
            for b in rows[k + 1 :]:
                edge = a.y0 if abs(a.y0 - b.y1) < 2 else a.y1 if abs(a.y1 - b.y0) < 2 else None
                if edge is None or abs(a.x0 - b.x0) >= 2 or abs(a.x1 - b.x1) >= 2 or (held(a) and held(a) == held(b)):
                    continue
                near = (center[0] >= a.x0 - 1) & (center[0] <= a.x1 + 1)
                sides = pd.DataFrame({"id": texts.id[near], "up": center[1][near] > edge, "down": center[1][near] < edge}).groupby("id").any()
                middle = (drawn.x0 + drawn.x1) / 2
                through = (drawn.y0 < edge - 0.2) & (drawn.y1 > edge + 0.2) & (middle >= a.x0 - 1) & (middle <= a.x1 + 1)
                if bool((sides.up & sides.down).any()) or bool(through.any()):
                    p, q = sorted((top(a.id), top(b.id)))
                    root[q] = p
        return pd.DataFrame({"page": page.page.iloc[0], "rid": list(root), "cell": [top(i) for i in root]})

    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("page").applyInPandas(f, "page string, rid int, cell int")


def group_rooms(lines: DataFrame) -> DataFrame:
    """(page, kind, group, room) from the notes (page, line, text) beside a table: sections of rooms for lectures and for exercises, in each lines of a group and its room; of a group named twice the last counts."""
    text = clean_text(F.col("text"))
    opens = F.when(text.rlike("(?iu)сале\\s+за\\s+предавања"), "lectures").when(text.rlike("(?iu)сале\\s+за\\s+рачунске"), "exercises")
    carried = F.last(opens, ignorenulls=True).over(Window.partitionBy("page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    pattern = "(?iu)група\\s+([^\\s-]{1,3})\\s*[-–—]\\s*(\\S{1,10})\\s*$"
    found = lines.select("page", "line", carried.alias("kind"), opens.alias("opens"), or_null(F.regexp_extract(text, pattern, 1)).alias("group"), F.regexp_extract(text, pattern, 2).alias("room"))
    return found.filter("opens IS NULL AND kind IS NOT NULL AND group IS NOT NULL").groupBy("page", "kind", "group").agg(F.max_by("room", "line").alias("room"))


def strip_groups(course: Column, groups: Column, canonical) -> Column:
    """A course without the groups named in it, and without dashes at its end."""
    words = F.filter(F.split(course, "\\s+"), lambda w: (F.length(_bare(w)) > 3) | ~F.exists(groups, lambda g: canonical(g) == canonical(_bare(w))))
    end = "[\\s]*[-–—]+[\\s]*$"
    kept = F.regexp_replace(F.regexp_replace(F.array_join(words, " "), end, ""), ",\\s*$", "")
    return clean_text(F.when(F.size(groups) == 0, F.regexp_replace(course, end, "")).otherwise(kept))


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, "[,;.()–—-]", "")
