"""Page geometry: colours and coordinates as Column expressions; text lines and blocks of a page as grouped-map functions, for their result depends on the order in which items are taken."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX = "^#[0-9a-f]{6}$"


def _channels(fill: Column) -> list[Column]:
    return [F.conv(F.substring(fill, k, 2), 16, 10).cast("int") for k in (2, 4, 6)]


def is_neutral(fill: Column) -> Column:
    """Grey: the channels lie within 24 of each other."""
    c = _channels(fill)
    return F.coalesce(fill.rlike(HEX) & (F.greatest(*c) - F.least(*c) < 24), F.lit(False))


def is_background(fill: Column) -> Column:
    """Almost white: all channels above 235."""
    return F.coalesce(fill.rlike(HEX) & (F.least(*_channels(fill)) > 235), F.lit(False))


def region_class(fill: Column, dashed: Column, lecture_fill: str) -> Column:
    return F.when(fill == lecture_fill, "predavanje").when(dashed, "laboratorijske_vezbe").when(is_background(fill), "racunske_vezbe").otherwise("ostali_casovi")


def transformed(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under an affine matrix of six numbers."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def text_angle(m: list[Column]) -> Column:
    return F.degrees(F.atan2(m[1], m[0]))


def compose(items: list[tuple[str, float, float]]) -> str:
    """The text of a line from (text, x0, x1): overlapping runs are laid over each other by character width, gaps become spaces."""
    items = sorted(items, key=lambda i: i[1])
    widths = sorted(w for t, a, b in items if (w := (b - a) / max(1, len(t))) > 0.1)
    unit, left, row, end = (widths[len(widths) // 2] if widths else 1.0), items[0][1], [], None
    for t, a, b in items:
        if end is not None and a < end - 0.5:
            at = max(0, int((a - left) / unit + 0.5))
            row += [" "] * (at + len(t) - len(row))
            for k, c in enumerate(t, at):
                if c != " " or row[k] == " ":
                    row[k] = c
        else:
            if end is not None and a - end > unit / 4:
                row.append(" ")
            row += t
        end = b if end is None else max(end, b)
    return " ".join("".join(row).split())


def text_lines(items: DataFrame) -> DataFrame:
    """(page, line, text, x0, x1, y0, y1) from items (page, ord, text, x0, x1, y0, y1), from top to bottom: an item joins the first line that has a member at its height."""

    def f(page: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for i in page.sort_values(["y0", "ord"], ascending=[False, True], kind="stable").itertuples():
            home = next((g for g in groups if any(abs(m.y0 - i.y0) < 4 and min(m.y1, i.y1) > max(m.y0, i.y0) for m in g)), None)
            if home is None:
                groups.append([i])
            else:
                home.append(i)
        rows = [(compose([(m.text, m.x0, m.x1) for m in g]), min(m.x0 for m in g), max(m.x1 for m in g), min(m.y0 for m in g), max(m.y1 for m in g)) for g in groups]
        return pd.DataFrame([(page.page.iloc[0], k, *r) for k, r in enumerate(r for r in rows if r[0])], columns=["page", "line", "text", "x0", "x1", "y0", "y1"])

    return items.groupBy("page").applyInPandas(f, "page string, line int, text string, x0 double, x1 double, y0 double, y1 double")


def text_blocks(lines: DataFrame) -> DataFrame:
    """lines with block, the least line of those that hang together: lines that share three tenths of the narrower one and lie within 1.9 heights."""

    def f(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("line").reset_index(drop=True)
        root = list(range(len(page)))

        def top(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        rows = list(page.itertuples())
        for i, a in enumerate(rows):
            for j, b in enumerate(rows[:i]):
                shared = min(a.x1, b.x1) - max(a.x0, b.x0)
                if shared > 0.3 * min(a.x1 - a.x0, b.x1 - b.x0) and shared > 0 and abs(a.y0 - b.y0) <= 1.9 * max(a.y1 - a.y0, b.y1 - b.y0):
                    p, q = sorted((top(i), top(j)))
                    root[q] = p
        return page.assign(block=[int(page.line[top(i)]) for i in range(len(page))])[["page", "line", "text", "block"]]

    return lines.groupBy("page").applyInPandas(f, "page string, line int, text string, block int")
