"""Timetable cells: course, group and room from a cell's text; groups and rooms of first-year entries; exam rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.dates import parse_time, textual_date
from tabulon.functions.text import canonical_group, clean_text, explicit_room, once, or_null

_LETTERS = "0-9A-Za-zА-Яа-яЂђЈјЉљЊњЋћЏџ"
ROOM = f"\\(\\s*([{_LETTERS}][-{_LETTERS} /.]{{0,15}}?)\\s*\\)"
_DASH, _NOT_DASH = "[–—-]", "[^–—-]"
GROUP = f"(?:^|\\s){_DASH}\\s*({_NOT_DASH}{{1,40}}?)\\s*{_DASH}(?=\\s|$)"
_SHORT = "[\\p{L}0-9]{1,3}"
GROUP_LIST = f"^(?:[0-9]{{1,2}}|{_SHORT}(?:\\s*,\\s*{_SHORT})+)$"
SPLIT = "[\\s,;.()–—-]+"


def parse_cell(text: Column) -> Column:
    """(course, group, room): the room is the last text in parentheses that looks like one, the group the first text between dashes if it is a number or a list."""
    t = clean_text(text)
    rooms = F.regexp_extract_all(t, F.lit(ROOM), 1)
    token = or_null(clean_text(F.regexp_extract(t, GROUP, 1)))
    bare = F.regexp_replace(F.regexp_replace(t, "\\([^()]*\\)", " "), GROUP, " ")
    loose = "".join((".,", ";:", "'\"`", "~_", "\\^"))
    course = clean_text(F.regexp_replace(F.regexp_replace(bare, f"\\s{_DASH}+\\s*$", " "), f"(?:^|\\s)[{loose}]+(?=\\s|$)", " "))
    return F.struct(course.alias("course"), F.when(token.rlike(GROUP_LIST), token).alias("group"), clean_text(F.try_element_at(rooms, F.lit(-1))).alias("room"))


def resolve_groups(raw: Column, lecture: Column, lectures: Column, exercises: Column) -> Column:
    """The groups named in a first-year entry, sorted: words of up to 3 letters that look like a group of its kind (of groups that look alike the last one counts); for other kinds than lectures, failing that, all groups that begin with a lecture group's letter."""
    kinds = "|".join(("сала", "лабораторија", "лаб", "амфитеатар", "учионица"))
    rest = F.regexp_replace(raw, f"(?iu)(?:{kinds})\\s*[:.]?\\s*[0-9\\p{{L}}]{{1,6}}", " ")
    known = F.when(lecture, F.map_keys(lectures)).otherwise(F.map_keys(exercises))
    words = F.filter(F.split(rest, SPLIT), lambda w: (F.length(w) > 0) & (F.length(w) <= 3))
    alike = lambda w: F.try_element_at(F.filter(known, lambda g: canonical_group(g) == canonical_group(w)), F.lit(-1))
    found = F.array_distinct(F.array_compact(F.transform(words, alike)))
    letters = F.filter(words, lambda w: (F.length(w) == 1) & F.map_contains_key(lectures, canonical_group(w)))
    wider = F.filter(known, lambda g: F.exists(letters, lambda w: g.startswith(canonical_group(w))))
    return F.array_sort(F.when((F.size(found) == 0) & ~lecture, F.array_distinct(wider)).otherwise(found))


def first_year(level: Column, semester: Column) -> Column:
    """Whether groups and rooms are told by notes beside the table: in the first year of basic studies."""
    return (level == "osnovne_akademske") & semester.isin(1, 2)


def rooms_of(groups: Column, table: Column) -> Column:
    """The map of those groups that have a room."""
    return F.map_filter(F.map_from_arrays(groups, F.transform(groups, lambda g: F.try_element_at(table, g))), lambda _, room: room.isNotNull())


def entry_room(raw: Column, room: Column, rooms: Column) -> Column:
    """The room named in the text, else the one parsed, else the only one of the groups."""
    only = F.array_distinct(F.map_values(rooms))
    return F.coalesce(explicit_room(raw), room, F.when(F.size(only) == 1, F.get(only, F.lit(0))))


_LEVELS = "MAS|OAS|МАС|ОАС"
_DAYS = "|".join("ponedeljak utorak sreda cetvrtak četvrtak petak subota nedelja nedjelja понедељак уторак среда четвртак петак субота недеља".split())
_GAP = "[\\s\u00a0]*"
EXAM = f"(?iu)^(?:[0-9]+\\s+)?({_LEVELS})\\s+([0-9]{{4}})" + "\\s+(\\S+)" * 3 + f"\\s+(.+?)\\s+((?:{_DAYS}),\\s*[0-9]{{1,2}}[.]{_GAP}\\S+{_GAP}[0-9]{{4}}[.]){_GAP}([0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?)?\\s*$"


def exam_row(line: Column) -> Column:
    """The fields of a line of an exam timetable; NULL for other lines."""
    fields = "\x01".join(f"${k}" for k in range(1, 9))  # matched once; a line that doesn't match stays one field
    return once(F.split(F.regexp_replace(F.trim(line), EXAM, fields), "\x01"), _exam_fields)


def _exam_fields(found: Column) -> Column:
    part = [F.lit(None), *(F.get(found, F.lit(k)) for k in range(8))]
    level = F.lower(F.translate(part[1], "ОАСМоасм", "OASMoasm"))
    named = F.when(level == "oas", "osnovne_akademske").when(level == "mas", "master_akademske").otherwise(part[1])
    names = ("accreditation", "semester", "module", "course_code")
    row = F.struct(named.alias("study_level"), *(part[k + 2].alias(n) for k, n in enumerate(names)), F.trim(part[6]).alias("course_name"), textual_date(part[7]).alias("date"), parse_time(or_null(part[8])).alias("time"))
    return F.when((F.size(found) == 8) & ~part[1].startswith("--"), row)
