"""Text of a page from its placed items: lines in reading order, and tables rebuilt where columns line up."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How far a baseline may lie off, what gap parts cells, how far a column, and the least table.
BASELINE, CELL_GAP, COLUMN, ROWS, COLUMNS = 2.0, 2.0, 1.5, 3, 3
ITEMS = "array<struct<text: string, x: double, y: double, width: double>>"


@dataclass
class Cell:
    x: float
    end: float
    text: str
    items: list[int]


def _squeezed(text: str) -> str:
    return re.sub(r"[ \t]+", " ", text).strip()


def _lines(items: list) -> list[list[int]]:
    """Items in reading order, a new line wherever the baseline moves."""
    out: list[list[int]] = []
    for i, (_, _, y, _) in enumerate(items):
        if not out or abs(y - items[i - 1][2]) > BASELINE:
            out.append([])
        out[-1].append(i)
    return out


def _baselines(items: list) -> list[list[int]]:
    """Items by baseline from the top, each from the left, whatever their reading order."""
    out: list[list[int]] = []
    for i in sorted(range(len(items)), key=lambda k: -items[k][2]):
        if out and items[out[-1][0]][2] - items[i][2] <= BASELINE:
            out[-1].append(i)
        else:
            out.append([i])
    return [sorted(row, key=lambda k: items[k][1]) for row in out]


def _cells(items: list, row: list[int], advance: float) -> list[Cell]:
    """A baseline's cells: a gap of two glyphs parts them; a lone mark goes to the cell after it."""
    glyph = lambda i: items[i][3] / len(items[i][0]) if items[i][3] > 0 and items[i][0] else advance
    cells: list[Cell] = []
    for k, i in enumerate(row):
        text, x, _, width = items[i]
        near = min(glyph(row[k - 1]), glyph(i)) if k else glyph(i)
        if cells and x - cells[-1].end <= CELL_GAP * near:
            last = cells[-1]
            last.text, last.end = f"{last.text} {text}", max(last.end, x + width)
            last.items.append(i)
        else:
            cells.append(Cell(x, x + width, text, [i]))
    while len(cells) > 1 and len(mark := cells[0].text.strip()) <= 2 and not any(map(str.isalnum, mark)):
        first, after = cells[0], cells[1]
        cells[:2] = [Cell(first.x, after.end, f"{first.text} {after.text}", first.items + after.items)]
    for c in cells:
        c.text = _squeezed(c.text)
    return cells


def _grid(cells: list[Cell], advance: float) -> list[float]:
    """The columns' positions: cells that lie close share one, at their mean."""
    groups: list[list[float]] = []
    for x in sorted(c.x for c in cells):
        if groups and x - sum(groups[-1]) / len(groups[-1]) <= COLUMN * advance:
            groups[-1].append(x)
        else:
            groups.append([x])
    return [sum(g) / len(g) for g in groups]


def _column(x: float, grid: list[float], advance: float) -> int:
    return next((i for i, g in enumerate(grid) if abs(g - x) <= COLUMN * advance), -1)


def _wrapped_below(ys: list[float]) -> float | None:
    """The gap below which a row goes on with the one before, if a table's gaps are of two sorts."""
    gaps = [abs(a - b) for a, b in zip(ys, ys[1:], strict=False)]
    if len(gaps) < 2 or min(gaps) <= 0 or max(gaps) / min(gaps) < 1.5:
        return None
    return (min(gaps) + max(gaps)) / 2


def _table(rows: list[list[Cell]], ys: list[float], grid: list[float], advance: float) -> str:
    bound, done = _wrapped_below(ys), []
    for k, cells in enumerate(rows):
        values = [""] * len(grid)
        for c in cells:
            if (i := _column(c.x, grid, advance)) >= 0:
                values[i] = c.text
        if done and (len(cells) < len(grid) or (bound is not None and abs(ys[k - 1] - ys[k]) < bound)):
            done[-1] = [old + ("" if not old or not new or old.endswith("-") else " ") + new for old, new in zip(done[-1], values, strict=True)]
        else:
            done.append(values)
    line = lambda v: "| " + " | ".join(x.replace("|", "\\|") for x in v) + " |"
    return "\n".join([line(done[0]), line(["---"] * len(grid)), *map(line, done[1:])])


def _tables(items: list, advance: float) -> Iterator[tuple[str, set[int]]]:
    """(Markdown, its items) of each run of baselines that share the columns of its first one."""
    base = _baselines(items)
    rows, ys = [_cells(items, r, advance) for r in base], [items[r[0]][2] for r in base]
    at = 0
    while at < len(rows):
        if len(rows[at]) < COLUMNS:
            at += 1
            continue
        grid = _grid(rows[at], advance)
        fits = lambda cells: bool(cells) and all(_column(c.x, grid, advance) >= 0 for c in cells)  # noqa: B023, E731
        end = at + 1
        while end < len(rows) and fits(rows[end]):
            end += 1
        if sum(len(r) == len(grid) for r in rows[at:end]) < ROWS:
            at += 1
            continue
        begin = at - 1 if at and 2 <= len(rows[at - 1]) < len(grid) and fits(rows[at - 1]) else at  # a head without its corner
        yield _table(rows[begin:end], ys[begin:end], grid, advance), {i for r in rows[begin:end] for c in r for i in c.items}
        at = end


def assemble(items: list[tuple[str, float, float, float]]) -> tuple[str, bool]:
    """(text, has_tables) of a page's items (text, x, y, width). A table replaces the lines it came from only if they follow
    each other and it has all of them."""
    items = [x for x in items if x[0] and x[0].strip()]
    if not items:
        return "", False
    lines = _lines(items)
    texts: list[str | None] = [_squeezed(" ".join(items[i][0] for i in line)) for line in lines]
    widths = sorted(w / len(t) for t, _, _, w in items if w > 0)
    advance = widths[len(widths) // 2] if widths else 0.0
    taken: set[int] = set()
    if advance > 0:
        for markdown, own in _tables(items, advance):
            over = [k for k, line in enumerate(lines) if own & set(line)]
            if over and over == list(range(over[0], over[-1] + 1)) and not taken & set(over) and all(own >= set(lines[k]) for k in over):
                texts[over[0] : over[-1] + 1] = [markdown, *[None] * (len(over) - 1)]
                taken |= set(over)
    return "\n".join(x for x in texts if x).strip(), bool(taken)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text, has_tables) of pages (doc_id, page, items); blank items count for nothing, white space in items is
    single spaces, missing places are 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [assemble([(i["text"], i["x"], i["y"], i["width"]) for i in (items if items is not None else ())]) for items in b["items"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "page": b["page"], "text": [x for x, _ in done], "has_tables": [x for _, x in done]})

    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    clean = F.transform("items", lambda i: F.struct(F.trim(F.regexp_replace(i.text, r"(?U)\s+", " ")).alias("text"), zero(i.x).alias("x"), zero(i.y).alias("y"), zero(i.width).alias("width")))
    kept = F.filter(clean, lambda i: F.coalesce(i.text, F.lit("")) != "")
    return pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), kept.alias("items")).mapInPandas(run, "doc_id long, page int, text string, has_tables boolean")
