"""Tables out of HTML pages, and the chain league > club > squad > injury over landed pages.

A page is read as a stream of tags by the standard library's tokenizer, in pieces, inside an Arrow
batch; nothing of it is kept but the rows that are open.  A page of plain markup alone is cut into
the same tags by one pattern.  What browsers forgive is forgiven: cells
and rows that are not closed end where the next one begins, tables within cells are tables of their
own, a page may end anywhere, entities are resolved by name or number, spans repeat their cell so
that positions hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.columns import c
from kestrel.storage import materialize

#: Characters given to the tokenizer at once, rows sent back at once, and the most that a span may span.
PIECE, ROWS, MOST_COLUMNS, MOST_ROWS = 1 << 16, 1_000, 1_000, 65_534
CELL = "struct<text: string, header: boolean, class: array<string>, links: array<struct<href: string, text: string>>, images: array<struct<src: string, alt: string>>>"
SCHEMA = f"seq int, `table` int, inside array<string>, section string, `row` int, cells array<{CELL}>"
_KINDS = pa.list_(
    pa.struct(
        [
            ("text", pa.string()), ("header", pa.bool_()), ("class", pa.list_(pa.string())),
            ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))),
            ("images", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())]))),
        ]
    )
)


#: Plain markup: names of letters and digits, values quoted or of few signs, without entities; no comments and no tags whose contents are raw.
_SPACE = r"[ \t\n\r\f]"
_VALUE = rf'{_SPACE}++(%s[A-Za-z][-A-Za-z0-9_]*+)(?:="(%s[^"<>&]*+)"|=(%s[A-Za-z0-9_.%%-]++)(?=[ \t\n\r\f>]|\Z))?+'
_RAW = "(?!(?i:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)(?![A-Za-z0-9]))"
_TAG = rf"(%s[^<]++)|<{_RAW}(%s[A-Za-z][A-Za-z0-9]*+)(%s(?:{_VALUE.replace('(%s', '(?:').replace('%%', '%')})*+){_SPACE}*+(%s/?+)>|</(%s[A-Za-z][A-Za-z0-9]*+){_SPACE}*+>".replace("%-]", "%%-]")
PLAIN, TAG, VALUE = re.compile(f"(?:{_TAG % (('?:',) * 5)})*+"), re.compile(_TAG % (("",) * 5)), re.compile(_VALUE % (("",) * 3))


class _Table:
    def __init__(self, number: int, classes: list[str], inside: list[str]):
        self.number, self.inside = number, [*inside, *classes]
        self.section, self.rows = "", 0
        self.cells: list[dict] | None = None  # of the open row
        self.cell: dict | None = None
        self.spans: dict[int, tuple[int, dict]] = {}  # column -> (rows still to come, cell)


def _span(attributes: dict[str, str | None], name: str, most: int) -> int:
    given = (attributes.get(name) or "").strip()
    return min(max(int(given), 1), most) if given.isdecimal() and len(given) < 9 else 1


class _Reader(HTMLParser):
    """Rows of all tables of a page, as they end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.done: list[tuple] = []
        self.tables = 0
        self.silent = 0
        self.link: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        top = self.open[-1] if self.open else None
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.open.append(_Table(self.tables, (given.get("class") or "").split(), top.inside if top else []))
            self.tables += 1
        elif top is None:
            return
        elif tag in ("thead", "tbody", "tfoot"):
            self._end_row(top)
            top.section = tag
        elif tag == "tr":
            self._end_row(top)
            top.cells = []
        elif tag in ("td", "th"):
            self._end_cell(top)
            if top.cells is None:
                top.cells = []
            top.cell = {
                "text": [], "header": tag == "th", "class": (given.get("class") or "").split(), "links": [], "images": [],
                "columns": _span(given, "colspan", MOST_COLUMNS), "rows": _span(given, "rowspan", MOST_ROWS),
            }
        elif top.cell is None:
            return
        elif tag == "a":
            self._end_link()
            self.link = {"href": given.get("href") or "", "text": []}
            top.cell["links"].append(self.link)
        elif tag == "img":
            top.cell["images"].append({"src": given.get("src") or "", "alt": given.get("alt") or ""})
        elif tag in ("br", "p", "div", "li"):
            top.cell["text"].append(" ")

    def handle_endtag(self, tag: str) -> None:
        top = self.open[-1] if self.open else None
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == "a":
            self._end_link()
        elif top is None:
            return
        elif tag in ("td", "th"):
            self._end_cell(top)
        elif tag == "tr":
            self._end_row(top)
        elif tag in ("thead", "tbody", "tfoot"):
            self._end_row(top)
            top.section = ""
        elif tag == "table":
            self._end_table()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        for table in self.open:  # the text of a table within a cell is the cell's too
            if table.cell is not None:
                table.cell["text"].append(data)
        if self.link is not None:
            self.link["text"].append(data)

    def _end_link(self) -> None:
        if self.link is not None:
            self.link["text"] = " ".join("".join(self.link["text"]).split())
            self.link = None

    def _end_cell(self, table: _Table) -> None:
        if table.cell is None:
            return
        self._end_link()
        cell, table.cell = table.cell, None
        columns, rows = cell.pop("columns"), cell.pop("rows")
        cell["text"] = " ".join("".join(cell["text"]).split())
        self._spanned(table)
        for _ in range(columns):
            if rows > 1:
                table.spans[len(table.cells)] = (rows - 1, cell)
            table.cells.append(cell)

    def _spanned(self, table: _Table) -> None:
        """Cells of rows above that reach into the next columns."""
        while (held := table.spans.get(len(table.cells))) is not None:
            left, cell = held
            if left > 1:
                table.spans[len(table.cells)] = (left - 1, cell)
            else:
                del table.spans[len(table.cells)]
            table.cells.append(cell)

    def _end_row(self, table: _Table) -> None:
        self._end_cell(table)
        if table.cells is None:
            return
        self._spanned(table)
        if table.cells:
            self.done.append((table.number, table.inside, table.section, table.rows, table.cells))
            table.rows += 1
        table.cells = None

    def _end_table(self) -> None:
        self._end_row(self.open[-1])
        self.open.pop()

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted

    def finish(self) -> None:
        if self.rawdata.startswith("<"):  # a tag that the page's end cuts off
            self.rawdata = ""
        self.close()
        while self.open:
            self._end_table()


def page_rows(html: str) -> Iterator[tuple]:
    """(table, classes of it and the tables around it, section, row, cells) of a page, row by row."""
    reader = _Reader()
    if PLAIN.fullmatch(html):
        for m in TAG.finditer(html):
            text, name, values, slash, end = m.groups()
            if text is not None:
                reader.handle_data(unescape(text) if "&" in text else text)
            elif end is not None:
                reader.handle_endtag(end.lower())
            else:
                given = [(k.lower(), quoted or bare) for k, quoted, bare in VALUE.findall(values)] if values else []
                (reader.handle_startendtag if slash else reader.handle_starttag)(name.lower(), given)
            if reader.done:
                yield from reader.done
                reader.done.clear()
        html = ""
    for at in range(0, len(html), PIECE):
        reader.feed(html[at : at + PIECE])
        yield from reader.done
        reader.done.clear()
    reader.finish()
    yield from reader.done


def _listed(lists: list[list], values) -> pa.Array:
    """``lists`` as an array whose items, one after another, ``values`` turns into an array."""
    offsets = pa.array([0, *accumulate(map(len, lists))], pa.int32())
    return pa.ListArray.from_arrays(offsets, values([x for own in lists for x in own]))


def _cells(rows: list[list[dict]]) -> pa.Array:
    """Rows of cells in columns: dictionaries one by one would take as long as the parsing."""

    def structs(kind: pa.DataType, items: list[dict]) -> pa.Array:
        names = [kind.field(k).name for k in range(kind.num_fields)]
        return pa.StructArray.from_arrays([pa.array([x[n] for x in items], kind.field(n).type) for n in names], names)

    def cells(items: list[dict]) -> pa.Array:
        kind = _KINDS.value_type
        links, images = (_listed([x[n] for x in items], partial(structs, kind.field(n).type.value_type)) for n in ("links", "images"))
        classes = _listed([x["class"] for x in items], lambda own: pa.array(own, pa.string()))
        return pa.StructArray.from_arrays(
            [pa.array([x["text"] for x in items], pa.string()), pa.array([x["header"] for x in items], pa.bool_()), classes, links, images],
            [kind.field(k).name for k in range(kind.num_fields)],
        )

    return _listed(rows, cells)


def tables(df: DataFrame, html_col: str, *keep: str) -> DataFrame:
    """(keep..., seq, table, inside, section, row, cells) for every row of every table; a null page has none.

    ``seq`` counts a page's rows as they end, those of a table within a cell before the cell's own; ``inside`` holds the classes of the row's table and of those around it, outermost first.
    """
    names = [f"__k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []

            def sent(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                own = [col.take(pa.array(at, pa.int64())) for col in batch.columns[1:]]
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32())
                out = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*own, *out, _cells([r[5] for r in rows])], names=[*names, "seq", "table", "inside", "section", "row", "cells"])

            for k, html in enumerate(batch.column(0)):
                for seq, row in enumerate(page_rows(html.as_py() or "")):
                    at.append(k)
                    rows.append((seq, *row))
                    if len(rows) >= ROWS:
                        yield sent()
                        at, rows = [], []
            yield sent()

    given = df.select(c(html_col).cast("string").alias("__html"), *(c(k).alias(n) for k, n in zip(keep, names, strict=True)))
    kinds = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)
    return given.mapInArrow(run, f"{kinds + ', ' if kinds else ''}{SCHEMA}").withColumnsRenamed(dict(zip(names, keep, strict=True)))


#: Class of the tables and of the cells that link on, and the club of an injury without one.
ITEMS, MAIN, NO_CLUB = "items", "hauptlink", "Non spécifié"


def _links(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep..., place, href, text): links in the main cells of the item tables of ``pages(url, html)``, in order."""
    rows = tables(pages, "html", *keep).where(F.array_contains("inside", ITEMS))
    main = F.flatten(F.transform(F.filter("cells", lambda x: F.array_contains(x["class"], MAIN)), lambda x: x["links"]))
    return rows.select(*(c(k) for k in keep), "seq", F.posexplode(main).alias("at", "link")).select(
        *(c(k) for k in keep), F.struct("seq", "at").alias("place"), "link.href", "link.text"
    )


def _part(url: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def clubs(pages: DataFrame) -> DataFrame:
    """(league, season, club_id, slug, club): clubs that the league pages of ``pages(url, html)`` link to."""
    url = F.col("url")
    own = pages.withColumns({"league": _part(url, r"/wettbewerb/([^/?#]+)"), "season": _part(url, r"saison_id[=/](\d+)").cast("int")})
    found = _links(own.where("league IS NOT NULL"), "league", "season").where(F.contains("href", F.lit("/startseite/verein/")))
    named = found.select("league", "season", "place", _part(F.col("href"), r"/verein/([^/?#]+)").alias("club_id"), F.split("href", "/")[1].alias("slug"), F.col("text").alias("club"))
    first = F.min(F.struct("place", "slug", "club")).alias("f")
    return named.groupBy("league", "season", "club_id").agg(first).select("league", "season", "club_id", "f.slug", "f.club")


def squads(pages: DataFrame) -> DataFrame:
    """(club_id, season, player_id, slug, name): players that the squad pages link to, each once a squad."""
    url = F.col("url")
    own = pages.withColumns({"club_id": _part(url, r"/kader/verein/([^/?#]+)"), "season": _part(url, r"saison_id[=/](\d+)").cast("int")})
    found = _links(own.where("club_id IS NOT NULL"), "club_id", "season").where(F.contains("href", F.lit("/profil/spieler/")))
    named = found.select("club_id", "season", "place", _part(F.col("href"), r"/spieler/([^/?#]+)").alias("player_id"), F.split("href", "/")[1].alias("slug"), F.col("text").alias("name"))
    first = F.min(F.struct("place", "slug", "name")).alias("f")
    return named.groupBy("club_id", "season", "player_id").agg(first).select("club_id", "season", "player_id", "f.slug", "f.name")


def injury_rows(pages: DataFrame) -> DataFrame:
    """(player_id, row, club_then, season_name, injury, since, until, days, games): rows of six cells in the first item table of a page."""
    own = pages.withColumn("player_id", _part(F.col("url"), r"/verletzungen/spieler/([^/?#]+)")).where("player_id IS NOT NULL")
    rows = tables(own, "html", "player_id").where(F.array_contains("inside", ITEMS))
    data = F.filter("cells", lambda x: ~x["header"])
    images = F.flatten(F.transform("cells", lambda x: x["images"]))
    badge = lambda i: F.contains(i["src"], F.lit("vereins")) | F.contains(i["src"], F.lit("wappen"))
    other = lambda i: (i["alt"] != "") & ~F.contains(i["src"], F.lit("spieler")) & ~F.contains(i["src"], F.lit("player"))
    club = F.get(F.filter(images, lambda i: badge(i) | other(i)), F.lit(0))["alt"]
    told = rows.where("section = 'tbody'").withColumns({"__d": data, "__club": F.coalesce(club, F.lit(NO_CLUB))}).where(F.size("__d") >= 6)
    texts = [F.col("__d")[k]["text"].alias(n) for k, n in enumerate(("season_name", "injury", "since", "until", "days", "games"))]
    # Written, so that pages are parsed once for the rows and for each player's first table.
    told, _ = materialize(told.select("player_id", "table", "row", F.col("__club").alias("club_then"), *texts), "injuries")
    first = told.groupBy(F.col("player_id").alias("__p")).agg(F.min("table").alias("__t"))
    same = (F.col("player_id") == F.col("__p")) & (F.col("table") == F.col("__t"))
    return told.join(first, same).drop("table", "__p", "__t")


def injuries(pages: DataFrame) -> DataFrame:
    """The chain over landed ``pages(url, html)``: injuries of the players of the squads of the clubs of the leagues.

    Each kind of page is parsed by itself; the chain is two joins by the ids that pages link by.
    A player of several squads has the injuries once.
    """
    members = squads(pages).join(clubs(pages).select("club_id", "season"), ["club_id", "season"], "left_semi")
    players = members.groupBy("player_id").agg(F.min_by("name", F.struct("season", "club_id")).alias("name"))
    return injury_rows(pages).join(players, "player_id").select(
        "player_id", "name", "row", "club_then", "season_name", "injury", "since", "until", "days", "games"
    )
