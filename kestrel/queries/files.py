"""Sinks and scans: tables written to the shared folder in each format and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.queries.registry import Tables, query
from kestrel.sources import files, tables
from kestrel.sources.landing import Landing
from kestrel.storage import shared_root

NATION = "n_nationkey int, n_name string, n_regionkey int"


def _place(t: Tables, name: str) -> str:
    return f"{shared_root(t.spark)}/kestrel-{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(t: Tables) -> DataFrame:
    """Written as CSV with a byte-order mark, read with a declared schema."""
    path = _place(t, "csv")
    files.write_csv(t.nation, path, bom=True)
    return files.read_csv(t.spark, path, NATION)


@query("SELECT n_nationkey, n_name || ' é' AS n_name FROM nation")
def latin1_csv_scan(t: Tables) -> DataFrame:
    path = _place(t, "latin1")
    told = t.nation.select("n_nationkey", F.concat("n_name", F.lit(" é")).alias("n_name"))
    told.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_csv(t.spark, path, "n_nationkey int, n_name string", encoding="ISO-8859-1")


@query("SELECT s_suppkey, replace(s_acctbal::VARCHAR, '.', ',') AS s_acctbal FROM supplier")
def decimal_comma_csv(t: Tables) -> DataFrame:
    """Numbers with a decimal comma, as text of the file."""
    path = _place(t, "comma")
    files.write_csv(t.supplier.select("s_suppkey", "s_acctbal"), path, decimal_comma=True)
    return files.read_csv(t.spark, path, "s_suppkey long, s_acctbal string", sep=";")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def wide_csv_scan(t: Tables) -> DataFrame:
    path = _place(t, "wide")
    files.write_csv(t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return files.read_csv(t.spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def replaced_table(t: Tables) -> DataFrame:
    """Read, filtered and written over its own path."""
    path = _place(t, "replaced")
    t.nation.write.parquet(path)
    return files.replace_table(t.spark.read.parquet(path).where("n_regionkey <> 1"), path).select("n_nationkey", "n_name")


@query("SELECT n_regionkey AS \"region.id\", n_nationkey AS \"nation.id\", n_name AS \"nation.name\" FROM nation")
def json_records(t: Tables) -> DataFrame:
    """Nested JSON: one record per region with a list of nations, exploded and flattened to dotted names."""
    path = _place(t, "json")
    one = t.nation.groupBy(F.struct(F.col("n_regionkey").alias("id")).alias("region")).agg(
        F.collect_list(F.struct(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("nation"))).alias("members")
    )  # a region's nations: a fixed dimension
    one.repartition(5, "region").write.option("maxRecordsPerFile", 1).json(path)
    schema = "region struct<id: int>, members array<struct<nation: struct<id: int, name: string>>>"
    return files.read_records(t.spark, path, schema, "members", ["region"])


@query("""
SELECT o_orderpriority, 'é' AS name, count(*) AS n, round(sum(o_totalprice * 0.5), 2) AS half FROM orders
WHERE year(o_orderdate) IN (1996, 1997) AND o_totalprice >= 50000 GROUP BY 1
""")
def json_parameters(t: Tables) -> DataFrame:
    """Parameters written and read again steer a report on orders."""
    path = _place(t, "params")
    files.write_params(t.spark, {"name": "é", "years": [1996, 1997], "least": 50_000, "weight": 0.5}, path)
    p = files.read_params(t.spark, path)
    told = t.orders.where(F.year("o_orderdate").isin(p["years"]) & (F.col("o_totalprice") >= p["least"]))
    return told.groupBy("o_orderpriority").agg(
        F.lit(p["name"]).alias("name"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice") * p["weight"]), 2).alias("half")
    )


@query("SELECT 1::BIGINT AS files, true AS dated, true AS sized")
def freshness(t: Tables) -> DataFrame:
    path = _place(t, "fresh")
    t.region.coalesce(1).write.parquet(path)
    found = files.freshness(t.spark, path)
    return found.select("files", (F.col("last_modified") > F.lit("2020-01-01").cast("timestamp")).alias("dated"), (F.col("bytes") > 0).alias("sized"))


LANDED = """
SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey IN (1, 4) THEN 2 ELSE 1 END AS run FROM nation
"""


@query(LANDED)
def landed_in_two_runs(t: Tables) -> DataFrame:
    """One JSON file per region; a second run finds one region new and one changed, and reads those two alone."""
    path = _place(t, "land")
    lake = Landing(t.spark, f"{path}/lake")
    read = lambda paths: t.spark.read.schema("n_nationkey int, n_name string").json(paths)

    def put(region: int, names: DataFrame) -> None:
        names.where(F.col("n_regionkey") == region).select("n_nationkey", "n_name").coalesce(1).write.mode("overwrite").json(f"{path}/source/region{region}")

    for region in range(4):
        put(region, t.nation)
    first = lake.take("nations", f"{path}/source", read, "*.json")
    # Of a changed region the old file goes, so its rows must be taken over by the new one of the same name.
    changed = t.nation.withColumn("n_name", F.lower("n_name"))
    put(4, t.nation)
    _replaced(t, f"{path}/source/region1", changed.where("n_regionkey = 1").select("n_nationkey", "n_name"))
    second = lake.take("nations", f"{path}/source", read, "*.json")
    if (first, second, lake.take("nations", f"{path}/source", read, "*.json")) != (4, 2, 0):
        raise ValueError(f"the runs took {first} and {second} files")
    return lake.rows("nations").select("n_nationkey", "n_name", F.col("batch_number").alias("run"))


def _replaced(t: Tables, folder: str, rows: DataFrame) -> None:
    """The folder's one JSON file with other contents under the same name."""
    name = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path").first()[0]
    rows.coalesce(1).write.json(f"{folder}-new")
    new = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder}-new").select("path").first()[0]
    at = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(name).getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(name), False)
    fs.rename(at(new), at(name))
    fs.delete(at(f"{folder}-new"), True)


@query("""
SELECT c_custkey::VARCHAR AS player_id, c_name || ' & Söhne' AS name, o_orderkey, n_name AS club_then, year(o_orderdate)::VARCHAR AS season_name, o_orderpriority AS injury, (o_orderkey % 40) || ' days' AS days
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2
""")
def html_chain(t: Tables) -> DataFrame:
    """Pages of leagues (regions), squads (nations' customers) and injuries (customers' orders), and the chain over them.

    The pages have tables within cells, cells that are not closed, entities by name and number, and spans; a squad lies over
    several pages, region 2 has no league page.
    """
    lines = lambda rows, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, rows.alias("h")))), lambda x: x["h"]), "")
    page = lambda head, rows, foot="</table>": F.concat(F.lit(head), rows, F.lit(foot))
    club = F.concat(F.lit('<tr><td>1<td class="hauptlink"><a href="/n'), "n_nationkey", F.lit("/startseite/verein/"), "n_nationkey", F.lit('">'), "n_name", F.lit("</a>"))
    leagues = t.nation.where("n_regionkey <> 2").groupBy("n_regionkey").agg(lines(club, "n_nationkey").alias("rows")).select(
        F.concat(F.lit("http://x/l/startseite/wettbewerb/R"), "n_regionkey", F.lit("/plus/?saison_id=2020")).alias("url"),
        page('<table class="items"><thead><tr><th colspan=2>Clubs</thead><tbody>', F.col("rows")).alias("html"),
    )
    player = F.concat(
        F.lit('<tr><td><table class="inline-table"><tr><td class="hauptlink"><a href="/c'), "c_custkey", F.lit("/profil/spieler/"), "c_custkey", F.lit('">'),
        "c_name", F.lit(" &amp; S&#246;hne</a><tr><td>role</table>"),
    )
    squads = t.customer.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 100).alias("k")).agg(lines(player, "c_custkey").alias("rows")).select(
        F.concat(F.lit("http://x/n/kader/verein/"), "c_nationkey", F.lit("/saison_id/2020/plus/1/page/"), "k").alias("url"), page('<table class="items">', F.col("rows"), "").alias("html")
    )
    injury = F.concat(
        F.lit("<tr><td>"), F.year("o_orderdate"), F.lit("<td>"), "o_orderpriority", F.lit("<td>"), "o_orderkey", F.lit('<td>-<td class="rechts">'), F.col("o_orderkey") % 40,
        F.lit('&nbsp;days<td><img src="/p/player.png" alt="face"><img src="/vereinslogo/vereins.png" alt="'), "n_name", F.lit('"> 3'),
    )
    owned = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    injuries = owned.groupBy("c_custkey").agg(lines(injury, "o_orderkey").alias("rows")).select(
        F.concat(F.lit("http://x/c/verletzungen/spieler/"), "c_custkey").alias("url"), page('<p><table class="items"><thead><th>Season</thead><tbody>', F.col("rows")).alias("html")
    )
    found = tables.injuries(leagues.unionByName(squads).unionByName(injuries))
    return found.select("player_id", "name", F.col("since").cast("long").alias("o_orderkey"), "club_then", "season_name", "injury", "days")
