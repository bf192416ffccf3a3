"""Tables out of HTML against hand-written pages, the chain over landed pages, and files that land bit by bit."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kestrel.sources import files, landing, tables


def texts(html):
    return [(t, section, row, [c["text"] for c in cells]) for t, _, section, row, cells in tables.page_rows(html)]


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []),
        ("<p>no table", []),
        ("<table><tr><td>a<td>b<tr><th>c</table>", [(0, "", 0, ["a", "b"]), (0, "", 1, ["c"])]),
        ("<TABLE><TR><TD>1 &lt; 2 &#233; &#xE9; &eacute; &amp;amp;</TD></TR></TABLE>", [(0, "", 0, ["1 < 2 é é é &amp;"])]),
        ("<table><tbody><tr><td colspan=2>x<td>y</tbody><tfoot><td>z", [(0, "tbody", 0, ["x", "x", "y"]), (0, "tfoot", 0 + 1, ["z"])]),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d</table>", [(0, "", 0, ["a", "b"]), (0, "", 1, ["a", "c"]), (0, "", 2, ["d"])]),
        ("<table><tr><td>a<table><tr><td>in</table>b<td>c</table>", [(1, "", 0, ["in"]), (0, "", 0, ["ainb", "c"])]),
        ("<table><tr><td>a<script>if (x<td) </script><style>td{}</style>b<br>c<!-- <td>no -->\n d</table>", [(0, "", 0, ["ab c d"])]),
        ("</td></tr></table><table><td colspan=x rowspan=-1>a</td></table>", [(0, "", 0, ["a"])]),
        ("<table><tr><td>cut off <a href='x", [(0, "", 0, ["cut off"])]),
    ],
)
def test_rows_of_pages(html, want):
    assert texts(html) == want


def test_links_images_and_classes():
    html = '<table class="items big"><tr><td class="a hauptlink"><a href="/x?a=1&amp;b=2">One <b>two</b></a><a href=y>z<td><table class=inline><td><img src=p.png alt="A &amp; B"><a>none</a></table></table>'
    rows = list(tables.page_rows(html))
    assert [r[1] for r in rows] == [["items", "big", "inline"], ["items", "big"]]
    outer = rows[1][4]
    assert outer[0]["links"] == [{"href": "/x?a=1&b=2", "text": "One two"}, {"href": "y", "text": "z"}] and outer[0]["class"] == ["a", "hauptlink"]
    assert rows[0][4][0]["images"] == [{"src": "p.png", "alt": "A & B"}] and rows[0][4][0]["links"] == [{"href": "", "text": "none"}]


def test_pieces_do_not_matter(monkeypatch):
    rnd = random.Random(1)
    parts = ["<table>", "<tr>", "<td>", "</td>", "</table>", "text &amp; ", "<a href='/b'>", "</a>", "<th colspan=2>", "&#65;", "<tbody>"]
    for _ in range(40):
        html = "".join(rnd.choice(parts) for _ in range(60))
        whole = list(tables.page_rows(html))
        monkeypatch.setattr(tables, "PIECE", 7)
        assert list(tables.page_rows(html)) == whole
        monkeypatch.undo()


def test_tables_of_a_column(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 3)
    many = "<table>" + "".join(f"<tr><td>{i}<td>{i * i}" for i in range(10)) + "</table>"
    df = spark.createDataFrame([(1, many, "k"), (2, None, "k"), (3, "<p>", None), (4, "<table><td>x", "l")], "id int, h string, `a.b` string")
    got = tables.tables(df, "h", "id", "a.b").orderBy("id", "row").collect()
    assert [(r.id, r["a.b"], r["row"], [x.text for x in r.cells]) for r in got] == [(1, "k", i, [str(i), str(i * i)]) for i in range(10)] + [(4, "l", 0, ["x"])]
    assert tables.tables(df.limit(0), "h", "id").count() == 0


def test_chain_of_pages(spark):
    league = '<table class="items"><tbody><tr><td class="hauptlink"><a href="/ajax/startseite/verein/610/saison_id/2020">Ajax</a><td><a href="/psv/startseite/verein/383">PSV</a><tr><td class="hauptlink"><a href="/about">About</a></table>'
    squad = (
        '<table class="items"><tr><td class="posrela"><table class="inline-table"><tr><td class="hauptlink"><a href="/jan-do/profil/spieler/7">Jan&nbsp;Do</a><tr><td>Keeper</table>'
        '<tr><td class="hauptlink"><a href="/jan-do/profil/spieler/7">again</a><a href="/piet/profil/spieler/8">Piet</a></table><table><td class="hauptlink"><a href="/x/profil/spieler/9">not an item</a></table>'
    )
    seven = (
        '<table class="items"><thead><tr><th>Season<th>Injury<th>from<th>until<th>Days<th>Games</thead><tbody><tr><td>20/21<td>Knee &#38; foot<td>01/02/2021<td>-<td>12 days<td class="rechts"><img src="/wappen/610.png" alt="Ajax">3'
        '<tr><td>19/20<td>Flu<td>a<td>b<td>2 days<td><img src="/spieler/7.png" alt="Jan">-<tr><td>short</table><table class="items"><tbody><tr><td>1<td>2<td>3<td>4<td>5<td>6</table>'
    )
    pages = [
        ("https://t.com/eredivisie/startseite/wettbewerb/NL1/plus/?saison_id=2020", league),
        ("https://t.com/ajax/kader/verein/610/saison_id/2020/plus/1", squad),
        ("https://t.com/psv/kader/verein/383/saison_id/2020/plus/1", squad.replace("spieler/7", "spieler/70")),
        ("https://t.com/jan-do/verletzungen/spieler/7", seven),
        ("https://t.com/piet/verletzungen/spieler/8", None),
        ("https://t.com/other/verletzungen/spieler/70", seven),
        (None, seven),
    ]
    df = spark.createDataFrame(pages, "url string, html string").repartition(3)
    assert [tuple(r) for r in tables.clubs(df).collect()] == [("NL1", 2020, "610", "ajax", "Ajax")]
    assert sorted((r.club_id, r.player_id, r.slug, r.name) for r in tables.squads(df).collect()) == [
        ("383", "70", "jan-do", "Jan Do"), ("383", "8", "piet", "Piet"), ("610", "7", "jan-do", "Jan Do"), ("610", "8", "piet", "Piet"),
    ]
    got = sorted(tuple(r) for r in tables.injuries(df).drop("row").collect())
    assert got == [
        ("7", "Jan Do", "Ajax", "20/21", "Knee & foot", "01/02/2021", "-", "12 days", "3"),
        ("7", "Jan Do", "Non spécifié", "19/20", "Flu", "a", "b", "2 days", "-"),
    ]


@pytest.fixture
def place(tmp_path):
    source = tmp_path / "source" / "deep"
    source.mkdir(parents=True)

    def put(name, rows):
        (source / name).write_text(json.dumps(rows))
        when = len(list(source.iterdir())) * 1000 + 1_600_000_000 + len(json.dumps(rows))
        os.utime(source / name, (when, when))

    return tmp_path, put


def test_landing_takes_only_what_is_new(spark, place):
    at, put = place
    lake = landing.Landing(spark, f"{at}/lake")
    seen = []

    def read(paths):
        seen.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        return spark.read.schema("id int, v string").option("multiLine", True).json(paths)

    take = lambda: lake.take("events", f"{at}/source", read, "*.json")
    with pytest.raises(ValueError, match="nothing"):
        lake.rows("events")
    put("a.json", [{"id": 1, "v": "x"}, {"id": 2, "v": "y"}])
    put("b.json", [{"id": 3, "v": "z"}])
    put("notes.txt", [])
    assert (take(), take()) == (2, 0)
    put("c.json", [{"id": 4, "v": "w"}])
    put("a.json", [{"id": 1, "v": "changed"}])
    assert lake.pending(f"{at}/source", "*.json").count() == 2 and take() == 2
    assert seen == [["a.json", "b.json"], ["a.json", "c.json"]]
    assert sorted(map(tuple, lake.rows("events").collect())) == [(1, "changed", 2), (3, "z", 1), (4, "w", 2)]
    (at / "source" / "deep" / "b.json").unlink()
    assert take() == 0 and lake.rows("events").count() == 3
    r = lake.freshness().first()
    assert (r.source, r.files, r.last_run) == ("events", 3, 2) and lake.manifest().count() == 4


def test_landing_survives_a_run_that_dies(spark, place, monkeypatch):
    at, put = place
    lake = landing.Landing(spark, f"{at}/lake")
    read = lambda paths: files.read_csv(spark, paths, "id int")
    source = at / "source"
    (source / "one.csv").write_text("id\n1\n")
    assert lake.take("s", str(source), read, "*.csv") == 1
    (source / "two.csv").write_text("id\n2\n")
    with monkeypatch.context() as m:  # rows are written, the manifest is not
        m.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            lake.take("s", str(source), read, "*.csv")
    assert sorted(r.id for r in lake.rows("s").collect()) == [1]
    assert len(list((at / "lake/rows/source=s").iterdir())) == 2
    assert lake.take("s", str(source), read, "*.csv") == 1
    assert sorted(r.id for r in lake.rows("s").collect()) == [1, 2]
    assert len(list((at / "lake/rows/source=s").iterdir())) == 2  # the rows without a manifest are gone
    (source / "wide.csv").write_text("id,more\n3,x\n")
    assert lake.take("s", str(source), lambda p: files.read_csv(spark, p, "id int, more string"), "*.csv") == 1
    assert sorted((r.id, r.more) for r in lake.rows("s").select("id", "more").collect()) == [(1, None), (2, None), (3, "x")]
    assert lake.rows("s").where(F.col("batch_number") == 3).count() == 1


def test_old_intermediates_are_swept(spark):
    from kestrel.storage import materialize, shared_root, sweep

    df, at = materialize(spark.range(3), "old")
    _, young = materialize(spark.range(3), "young")
    folder = at.removeprefix("file:")
    os.utime(folder, (1_600_000_000, 1_600_000_000))
    other = os.path.join(shared_root(spark).removeprefix("file:"), "else")
    os.makedirs(other, exist_ok=True)
    os.utime(other, (1_600_000_000, 1_600_000_000))
    assert sweep(spark, 24 * 365) == 1
    assert not os.path.exists(folder) and os.path.exists(young.removeprefix("file:")) and os.path.exists(other)


def test_plain_pages_give_what_the_tokenizer_gives(monkeypatch):
    """Pages of plain markup are cut by one pattern: the same rows as from the tokenizer, which reads all others."""
    import random
    import re

    bits = [
        "<table>", '<table class="items x">', "<tr>", "</tr>", "<td>", "</td>", "<td colspan=2>", '<TD RowSpan="3" class="A b">', "<th>", "</th >", '<a href="/x/y?z=1">', "</a>",
        '<img alt=x src="b"/>', "<br/>", "<p>", "<div id=q class>", "<thead>", "<tbody>", "</table>", "text ", "&amp; S&#246;hne", "&nbsp", "a & b > c", '<td class="a" class="b">', "<td\n>",
        "<script>", "</script>", "<!-- c -->", "<a href=/u/v>", '<a href="x&amp;y">', "<", "</ td>", "<td x=1/>", '<td class="a"b="c">', "<td class='q'>", "<1>", "<title>",
    ]
    rnd, pattern = random.Random(3), tables.PLAIN
    pages = ["".join(rnd.choice(bits[: 25 if k % 4 else None]) for _ in range(rnd.randint(1, 30))) for k in range(4000)]
    got = [list(tables.page_rows(p)) for p in pages]
    assert sum(bool(pattern.fullmatch(p)) for p in pages) > 2000
    monkeypatch.setattr(tables, "PLAIN", re.compile("(?!)"))
    assert got == [list(tables.page_rows(p)) for p in pages]
    cells = [row[4] for own in got for row in own]
    assert tables._cells(cells).to_pylist() == cells and tables._cells([]).to_pylist() == []


def test_injury_pages_are_parsed_once(spark):
    """The rows and each player's first table read what one parse has written."""
    df = spark.createDataFrame([("http://x/p/verletzungen/spieler/1", "<table class=items><tbody><tr><td>1<td>2<td>3<td>4<td>5<td>6</table>")], "url string, html string")
    got = tables.injury_rows(df)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.games for r in got.collect()] == ["6"]
