"""Scores out of web pages: table cells, embedded JSON, cards and free text. Only cutting HTML into
cells and scripts' literals into JSON is Python; rules are DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.scalars import contains_any, parse_pct_cell
from scorelake.sources.scripts import embedded_json
from scorelake.sources.shared import bound_batches

CELLS = T.StructType([T.StructField("page_id", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("table_no", "row_no", "col_no")), T.StructField("header", T.StringType()), T.StructField("cell", T.StringType())])


#: Characters of a page that the parser is fed at a time, and cells that are yielded at a time.
SLICE, YIELDED = 1 << 20, 10_000
#: Limits of the standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Table:
    """An open table: its header once it is known, the row and cell that are open, and the cells that reach down from rows above."""

    def __init__(self, number: int):
        self.number, self.rows, self.header = number, 0, None
        self.row: list | None = None
        self.cell: list[str] | None = None
        self.spans = (1, 1)
        self.down: dict[int, tuple[int, str]] = {}

    def close_cell(self) -> None:
        if self.cell is not None:
            self.row.append(("".join(self.cell).strip(), *self.spans))
            self.cell = None

    def close_row(self) -> list[str] | None:
        """The row's texts by column, with cells from above and those that span columns."""
        self.close_cell()
        if self.row is None:
            return None
        out: list[str] = []
        cells = iter(self.row)
        cell = next(cells, None)
        down = {}
        while cell is not None or len(out) in self.down:
            k = len(out)
            if k in self.down:
                left, text = self.down[k]
                out.append(text)
                if left > 1:
                    down[k] = left - 1, text
                continue
            text, across, rows = cell
            for _ in range(across):
                if rows > 1:
                    down[len(out)] = rows - 1, text
                out.append(text)
            cell = next(cells, None)
        # What reaches down beyond a shorter row still does.
        self.down = {k: (left - 1, t) for k, (left, t) in self.down.items() if k >= len(out) and left > 1} | down
        self.row = None
        return out


def _span(attrs: list, name: str, most: int) -> int:
    value = dict(attrs).get(name) or ""
    n = int(value) if value.strip().isdecimal() else 1
    return min(n, most) if n else (most if name == "rowspan" else 1)


class _Cells(HTMLParser):
    """Cells of tables, as the page is fed: a stack holds the open tables, so a table inside a cell is a table of its own, and what follows it
    belongs to the outer one again. A cell's text is without that of tables, scripts and styles in it."""

    def __init__(self) -> None:
        super().__init__()
        self.count, self.stack, self.found, self.hidden = 0, [], [], False

    def close_row(self, t: _Table) -> None:
        texts = t.close_row()
        if texts is None:
            return
        if t.header is None:
            t.header = texts
        elif len(texts) == len(t.header):
            self.found += [(t.number, t.rows, k, h, c) for k, (h, c) in enumerate(zip(t.header, texts, strict=True))]
        t.rows += 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden = True
        elif tag == "table":
            self.stack.append(_Table(self.count))
            self.count += 1
        elif tag in ("tr", "td", "th") and self.stack:
            t = self.stack[-1]
            if tag == "tr":
                self.close_row(t)
                t.row = []
                return
            t.close_cell()
            if t.row is None:
                t.row = []
            t.cell, t.spans = [], (_span(attrs, "colspan", MOST_COLUMNS), _span(attrs, "rowspan", MOST_ROWS))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = False
        elif self.stack:
            t = self.stack[-1]
            if tag in ("td", "th"):
                t.close_cell()
            elif tag == "tr":
                self.close_row(t)
            elif tag == "table":
                self.close_row(t)
                self.stack.pop()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].cell is not None and not self.hidden:
            self.stack[-1].cell.append(data)

    def taken(self, html: str) -> Iterator[list[tuple]]:
        """The cells of a page, some at a time."""
        for a in range(0, len(html), SLICE):
            self.feed(html[a : a + SLICE])
            if len(self.found) >= YIELDED:
                yield self.found
                self.found = []
        self.close()
        while self.stack:
            self.close_row(self.stack.pop())
        yield self.found


def extract_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Cells of every table: page_id, table_no (in the order in which tables begin, nested ones too), row_no from 1 (0 is the header), col_no,
    header, cell. Cells that span columns or rows count in each. Rows with another number of columns than the header's are left out, and null
    pages have no cells. A page is parsed in slices, and its cells are yielded as they are found."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for page, html in zip(b[id_col], b[html_col], strict=True):
                for cells in _Cells().taken(html or ""):
                    out += [(page, *c) for c in cells]
                    if len(out) >= YIELDED:
                        yield pd.DataFrame(out, columns=CELLS.names)
                        out = []
            yield pd.DataFrame(out, columns=CELLS.names)

    return pages.select(id_col, html_col).mapInPandas(run, CELLS)


ROW = ("page_id", "table_no", "row_no")


def table_cells_to_scores(cells: DataFrame, model_headers: Sequence[str] = ("model", "model name", "name"), rank_metric: str = "Rank") -> DataFrame:
    """model, metric, value of tables whose model column is found by its header; the row's place is a metric too."""
    is_model = F.lower("header").isin(*model_headers)
    model = cells.where(is_model).groupBy(*ROW).agg(F.min_by("cell", "col_no").alias("model"))
    scores = cells.where(~is_model).select(*ROW, F.col("header").alias("metric"), parse_pct_cell(F.col("cell")).alias("value")).where("value is not null")
    ranks = model.select(*ROW, F.lit(rank_metric).alias("metric"), F.col("row_no").cast("double").alias("value"))
    return scores.unionByName(ranks).join(model, list(ROW)).where("model != ''").select(*ROW, "model", "metric", "value")


def table_cells_first_in_range(cells: DataFrame, model_col: int = 1, low: float = 0, high: float = 2000, pattern: str = r"(\d+\.?\d*)") -> DataFrame:
    """A fixed model column, and the first later cell with a number in the range."""
    number = F.regexp_extract("cell", pattern, 1).try_cast("double")
    score = cells.where(F.col("col_no") > model_col).withColumn("n", number).where(F.col("n").between(low, high)).groupBy(*ROW).agg(F.min_by("n", "col_no").alias("value"))
    return cells.where(F.col("col_no") == model_col).select(*ROW, F.col("cell").alias("model")).join(score, list(ROW))


def table_cells_two_column(cells: DataFrame) -> DataFrame:
    """First cell the name, second the score, if it is a number above 0."""
    return cells.groupBy(*ROW).agg(F.max(F.when(F.col("col_no") == 0, F.col("cell"))).alias("model"), F.max(F.when(F.col("col_no") == 1, F.col("cell"))).try_cast("double").alias("value")).where("value > 0 and model != ''")


def table_cells_keyword(cells: DataFrame, model_kw: Sequence[str] = ("model", "name"), score_kw: Sequence[str] = ("pass@1", "score", "%", "humaneval", "mbpp")) -> DataFrame:
    """Model and score columns by words in their headers; the first valid score of a row, times 100 if it is at most 1 and without %."""
    n = F.regexp_extract("cell", r"(\d+\.?\d*)", 1).try_cast("double")
    value = F.when((n <= 1) & ~F.col("cell").contains("%"), n * 100).otherwise(n)
    is_model = contains_any(F.col("header"), model_kw)
    model = cells.where(is_model).groupBy(*ROW).agg(F.min_by("cell", "col_no").alias("model"))
    score = cells.where(~is_model & contains_any(F.col("header"), score_kw)).withColumn("value", value).where("value is not null").groupBy(*ROW).agg(F.min_by("value", "col_no").alias("value"))
    return model.join(score, list(ROW)).where("model != ''")


#: Words in a header and the field that they name, tried in this order.
OPEN_LLM_HEADERS = {"rank": "rank", "model": "model", "type": "model_type", "average": "average", "ifeval": "ifeval", "bbh": "bbh", "math": "math", "gpqa": "gpqa", "musr": "musr", "mmlu": "mmlu_pro"}


def map_headers(cells: DataFrame) -> DataFrame:
    """One row a table row: model, and the score fields that its headers name; rows without a score are left out."""
    from scorelake.functions.scalars import cascade

    h = F.lower("header")
    field = cascade([(h.contains(k), v) for k, v in OPEN_LLM_HEADERS.items()], F.when(h.contains("co") & h.contains("cost"), "co2_cost"))
    scores = [v for v in OPEN_LLM_HEADERS.values() if v not in ("rank", "model_type", "model")]
    wide = cells.withColumn("field", field).groupBy(*ROW).pivot("field", [*OPEN_LLM_HEADERS.values(), "co2_cost"]).agg(F.min_by("cell", "col_no"))
    out = wide.select(*ROW, "model", "model_type", *(parse_pct_cell(F.col(c)).alias(c) for c in ("rank", *scores, "co2_cost")))
    return out.where(F.coalesce(*scores).isNotNull())


def extract_embedded_json(pages: DataFrame, patterns: Sequence[str], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pattern_no and json of every page that has one: the first text that is JSON among what the patterns' matches, in order, lead to. A match
    whose group isn't JSON as it stands is read as a script's literal, from the group's first bracket to the one that closes it: comments,
    bare keys, single quotes, trailing commas and undefined are mended, strings aren't touched. Empty objects and arrays don't count."""
    bound_batches(pages.sparkSession)
    compiled = [re.compile(p) for p in patterns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for page, html in zip(b[id_col], b[html_col], strict=True):
                for k, p in enumerate(compiled):
                    if (found := embedded_json(html or "", p)) is not None:
                        yield pd.DataFrame([(page, k, found)], columns=[id_col, "pattern_no", "json"])
                        break

    schema = T.StructType([pages.select(id_col).schema[0], T.StructField("pattern_no", T.IntegerType()), T.StructField("json", T.StringType())])
    return pages.select(id_col, html_col).mapInPandas(run, schema)


def extract_cards(pages: DataFrame, item: str, name: str, score: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Items of a page by patterns: name, score (the first number), and the place as rank where there is none."""
    one = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(item), 1)).alias("pos", "html"))
    n = F.trim(F.regexp_extract("html", name, 1))
    value = F.regexp_extract(F.regexp_extract("html", score, 1), r"(\d+\.?\d*)", 1).try_cast("double")
    return one.select(id_col, "pos", n.alias("model"), value.alias("value"), F.when(value.isNull(), F.col("pos") + 1).alias("rank")).where("model != ''")


def proximity_scores(pages: DataFrame, pattern: str, text: Column, before: int = 2, after: int = 2, low: float = 15, high: float = 100, id_col: str = "page_id") -> DataFrame:
    """A line that names a model takes the first number in range among the lines around it; version numbers don't count."""
    lines = pages.select(id_col, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    numbers = F.filter(F.transform(F.regexp_extract_all("t", F.lit(r"(\d+\.?\d*)"), 1), lambda x: x.cast("double")), lambda x: x.between(low, high) & ~x.isin(2.5, 3.7, 4.0, 1.5))
    w = W.partitionBy(id_col).orderBy("line").rowsBetween(-before, after)
    near = lines.withColumn("around", F.flatten(F.collect_list(numbers).over(w)))
    return near.where(F.col("t").rlike(pattern) & (F.size("around") > 0)).select(id_col, "line", F.regexp_extract("t", pattern, 0).alias("model"), F.get("around", F.lit(0)).alias("value"))


def regex_scan(pages: DataFrame, pattern: str, low: float, high: float, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """name and score of every match of a pattern with two groups; a later match of a name replaces an earlier one."""
    hits = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(pattern), 1).alias("name"), F.regexp_extract_all(html_col, F.lit(pattern), 2).alias("score"))
    one = pages.select(id_col, F.posexplode(hits).alias("pos", "h")).select(id_col, "pos", F.trim(F.col("h")["name"]).alias("name"), F.col("h")["score"].try_cast("double").alias("score"))
    return one.where(F.col("score").between(low, high)).groupBy(id_col, "name").agg(F.max_by("score", "pos").alias("score"))
