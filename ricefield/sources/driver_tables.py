"""Stand-in model tables built from the driver's TPC-H-like parquet tables.

municipality = nation, association = customer, farmer = orders (one farmer row per
order; every row of every source table is used).  This module only renames and
re-types columns into the model's schema; it does none of the library's work.

Both seasons hold every nation and every customer.  Names differ between seasons
so that the season comparisons see matched, base-only, current-only and duplicate
keys: dry names are padded and lower- or upper-cased, region 4 nations and BUILDING
customers get new names in the dry season, and region 3 nations share one dry name.
Farmers fall in the wet season for order months 6-11, otherwise in dry.

``MODEL_SQL`` is the same mapping as DuckDB SQL CTEs for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricefield.sources.model import Tables, conform

# Variety names given to the stand-in farmers (some spelled unlike the
# seed list on purpose, and one blank).
FARMER_VARIETIES = ["Bigante", "Lp2096", "NK 5017", "S6003", "SL 20", "RC 222", "Jackpot", "SL 8", ""]

# Orders dated before this become the existing farmer table of the upload queries;
# orders on or after it arrive as the uploaded file.
UPLOAD_CUTOFF = "1999-01-01"


# The columns used here; reading with a schema opens no file while a plan is built.
COLUMNS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(COLUMNS[name]) if name in COLUMNS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    wet = n.select(F.lit("wet").alias("season"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    dry = n.select(
        F.lit("dry").alias("season"),
        F.col("n_nationkey").alias("id"),
        F.when(F.col("n_regionkey") == 4, F.concat("n_name", F.lit(" NORTH")))
        .when(F.col("n_regionkey") == 3, F.concat(F.lit("District "), F.col("n_regionkey").cast("string")))
        .otherwise(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")))
        .alias("name"),
    )
    return conform(wet.unionByName(dry), "municipality")


def association(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    wet = c.select(
        F.lit("wet").alias("season"),
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("municipality_id"),
        F.col("c_name").alias("name"),
    )
    dry = c.select(
        F.lit("dry").alias("season"),
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("municipality_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat("c_name", F.lit(" Coop")))
        .otherwise(F.upper("c_name"))
        .alias("name"),
    )
    return conform(wet.unionByName(dry), "association")


def _season_of(date_col: str) -> F.Column:
    return F.when(F.month(date_col).between(6, 11), F.lit("wet")).otherwise(F.lit("dry"))


def _rsbsa() -> F.Column:
    base = F.concat(
        F.lit("R-"), (F.col("o_custkey") % 500).cast("string"), F.lit("-"), (F.col("o_orderkey") % 4).cast("string")
    )
    return (
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(""))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.lower(base), F.lit(" ")))
        .otherwise(base)
    )


def _variety() -> F.Column:
    return F.element_at(F.array([F.lit(v) for v in FARMER_VARIETIES]), (F.col("o_orderkey") % 9 + 1).cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders")


def farmer_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farmer rows plus the order's columns (used to split existing and uploaded rows)."""
    o = _read(spark, sf_dir, "orders")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select(
        _season_of("o_orderdate").alias("season"),
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("association_id"),
        _rsbsa().alias("rsbsa"),
        F.col("o_orderpriority").alias("last_name"),
        F.col("c_name").alias("first_name"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("string"))
        .otherwise(F.col("o_orderstatus"))
        .alias("middle_name"),
        F.lit("").alias("suffix"),
        ((F.col("o_orderkey") % 16).cast("double") / 4).alias("area"),
        _variety().alias("variety"),
        (F.col("o_orderkey") % 97).cast("double").alias("sacks"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("double"))
        .otherwise((F.col("o_custkey") % 21 + 40).cast("double"))
        .alias("kg"),
        F.col("o_orderdate"),
        F.col("o_orderstatus"),
        F.col("o_orderpriority"),
        F.col("o_orderkey"),
        F.col("o_custkey"),
    )


def farmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(farmer_source(spark, sf_dir), "farmer")


def variety(farmers: DataFrame) -> DataFrame:
    """Variety table per season: the distinct non-blank names farmers use."""
    from pyspark.sql import Window

    names = farmers.where(F.col("variety") != "").select("season", F.col("variety").alias("name")).distinct()
    w = Window.partitionBy("season").orderBy("name")
    return conform(names.withColumn("id", F.row_number().over(w)), "variety")


def model_tables(spark: SparkSession, sf_dir: str, with_variety: bool = False) -> Tables:
    f = farmer(spark, sf_dir)
    return Tables(
        municipality=municipality(spark, sf_dir),
        association=association(spark, sf_dir),
        farmer=f,
        variety=variety(f) if with_variety else None,
    )


# Upload file headers (stand-in spelling: padded and capitalised; the loader normalises).
def upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on/after ``UPLOAD_CUTOFF`` written as an upload sheet: all-string cells in
    the 23-column template, with blank names, junk numbers and blank varieties mixed in.
    Extra columns: ``season``, ``association_id`` (upload target) and ``line`` (file order).
    """
    s = farmer_source(spark, sf_dir).where(F.col("o_orderdate") >= F.lit(UPLOAD_CUTOFF).cast("timestamp_ntz"))
    blank_name = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    k13 = F.col("o_orderkey") % 13
    k17 = F.col("o_orderkey") % 17
    sacks_text = (
        F.when(k13 == 0, F.lit("x"))
        .when(k13 == 1, F.lit("1e1"))
        .when(k13 == 2, F.lit(" 45 "))
        .when(k13 == 3, F.lit("1,200"))
        .when(k13 == 4, F.lit(""))
        .otherwise((F.col("o_orderkey") % 97).cast("string"))
    )
    kg_text = (
        F.when(k17 == 0, F.lit("12d"))
        .when(k17 == 1, F.lit(".5"))
        .when(k17 == 2, F.lit("nan"))
        .otherwise((F.col("o_custkey") % 21 + 40).cast("string"))
    )
    area_text = F.when(k13 == 5, F.lit("n/a")).otherwise((F.col("o_orderkey") % 7).cast("string"))
    claimed = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("variety"))
    blank = F.lit("")
    return s.select(
        F.col("season"),
        F.col("association_id"),
        F.col("id").alias("line"),
        F.col("rsbsa").alias(" FFRS RSBSA Number"),
        F.when(blank_name, blank).otherwise(F.col("last_name")).alias("Farmer Last Name "),
        F.when(blank_name, F.lit(None).cast("string")).otherwise(F.col("first_name")).alias("FARMER FIRST NAME"),
        F.coalesce(F.col("middle_name"), blank).alias("Farmer Middle Name"),
        blank.alias("Farmer Ext Name"),
        blank.alias("Farm Address (Province)"),
        blank.alias("Farm Address (Municipality)"),
        claimed.alias("Seed Variety Claimed"),
        area_text.alias("Claimed Area (ha)"),
        blank.alias("Claimed seeds (kg)"),
        blank.alias("Lot Series"),
        blank.alias("Sex"),
        blank.alias("Birthdate"),
        blank.alias("Contact Number"),
        blank.alias("Crop Establishment"),
        blank.alias("Eco-System"),
        blank.alias("Eco-System Source"),
        blank.alias("Date of Sowing"),
        kg_text.alias("Average Weight per Bag (kg) - for all variety(ies)"),
        sacks_text.alias("Total Production (no. of bags) - for all variety(ies)"),
        blank.alias("Average Area Harvested (ha)"),
        F.lit("TH 82").alias("Seed Variety Planted"),
        blank.alias("Seed Class (Hybrid, Inbred, etc.)"),
    )


def existing_farmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farmer table as it stood before the upload (orders before ``UPLOAD_CUTOFF``)."""
    src = farmer_source(spark, sf_dir).where(F.col("o_orderdate") < F.lit(UPLOAD_CUTOFF).cast("timestamp_ntz"))
    return conform(src, "farmer")


# ---------------------------------------------------------------------------------
# The same mapping for DuckDB (oracle side).  Views: nation, customer, orders.
# ---------------------------------------------------------------------------------
_VARIETY_LIST = "[" + ", ".join("'" + v + "'" for v in FARMER_VARIETIES) + "]"

MODEL_SQL = f"""
muni AS (
    SELECT 'wet' AS season, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation
    UNION ALL
    SELECT 'dry', CAST(n_nationkey AS BIGINT),
           CASE WHEN n_regionkey = 4 THEN n_name || ' NORTH'
                WHEN n_regionkey = 3 THEN 'District ' || CAST(n_regionkey AS VARCHAR)
                ELSE ' ' || lower(n_name) || ' ' END
    FROM nation
),
assoc AS (
    SELECT 'wet' AS season, CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS municipality_id,
           c_name AS name FROM customer
    UNION ALL
    SELECT 'dry', CAST(c_custkey AS BIGINT), CAST(c_nationkey AS BIGINT),
           CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || ' Coop' ELSE upper(c_name) END
    FROM customer
),
farmer_src AS (
    SELECT CASE WHEN month(o_orderdate) BETWEEN 6 AND 11 THEN 'wet' ELSE 'dry' END AS season,
           CAST(o_orderkey AS BIGINT) AS id,
           CAST(o_custkey AS BIGINT) AS association_id,
           CASE WHEN o_orderkey % 11 = 0 THEN ''
                WHEN o_orderstatus = 'F'
                     THEN ' ' || lower('R-' || CAST(o_custkey % 500 AS VARCHAR) || '-' || CAST(o_orderkey % 4 AS VARCHAR)) || ' '
                ELSE 'R-' || CAST(o_custkey % 500 AS VARCHAR) || '-' || CAST(o_orderkey % 4 AS VARCHAR) END AS rsbsa,
           o_orderpriority AS last_name,
           c_name AS first_name,
           CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS middle_name,
           '' AS suffix,
           CAST(o_orderkey % 16 AS DOUBLE) / 4 AS area,
           {_VARIETY_LIST}[CAST(o_orderkey % 9 AS INTEGER) + 1] AS variety,
           CAST(o_orderkey % 97 AS DOUBLE) AS sacks,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                ELSE CAST(o_custkey % 21 + 40 AS DOUBLE) END AS kg,
           o_orderdate, o_orderstatus, o_orderpriority,
           CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey
    FROM orders JOIN customer ON o_custkey = c_custkey
),
farmer AS (
    SELECT season, id, association_id, rsbsa, last_name, first_name, middle_name, suffix, area, variety, sacks, kg
    FROM farmer_src
)"""

UPLOAD_SQL = f"""
upload_src AS (
    SELECT season, association_id, id AS line,
           rsbsa AS rsbsa_text,
           CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN '' ELSE last_name END AS last_text,
           CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE first_name END AS first_text,
           coalesce(middle_name, '') AS middle_text,
           '' AS ext_text,
           CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE variety END AS claimed_text,
           'TH 82' AS planted_text,
           CASE WHEN o_orderkey % 13 = 5 THEN 'n/a' ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS area_text,
           CASE o_orderkey % 13 WHEN 0 THEN 'x' WHEN 1 THEN '1e1' WHEN 2 THEN ' 45 ' WHEN 3 THEN '1,200'
                WHEN 4 THEN '' ELSE CAST(o_orderkey % 97 AS VARCHAR) END AS sacks_text,
           CASE o_orderkey % 17 WHEN 0 THEN '12d' WHEN 1 THEN '.5' WHEN 2 THEN 'nan'
                ELSE CAST(o_custkey % 21 + 40 AS VARCHAR) END AS kg_text
    FROM farmer_src WHERE o_orderdate >= TIMESTAMP '{UPLOAD_CUTOFF}'
),
existing AS (
    SELECT season, id, association_id, rsbsa, last_name, first_name, middle_name, suffix, area, variety, sacks, kg
    FROM farmer_src WHERE o_orderdate < TIMESTAMP '{UPLOAD_CUTOFF}'
)"""


# ---------------------------------------------------------------------------------
# Change-set stand-ins (rows in the shape each change job expects).
# ---------------------------------------------------------------------------------


def _num_text(expr) -> F.Column:
    return expr.cast("long").cast("string")


def form_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farmer form submissions: one per order on/after ``UPLOAD_CUTOFF`` (text fields,
    numbers as typed text; some bag counts are not numbers)."""
    s = farmer_source(spark, sf_dir).where(F.col("o_orderdate") >= F.lit(UPLOAD_CUTOFF).cast("timestamp_ntz"))
    return s.select(
        "season",
        "association_id",
        F.col("id").alias("line"),
        F.col("rsbsa"),
        F.concat(F.lit(" "), F.col("last_name")).alias("last_name"),
        F.col("first_name"),
        F.col("middle_name"),
        F.col("suffix"),
        _num_text(F.col("o_orderkey") % 7).alias("area"),
        F.col("variety"),
        _form_text().alias("sacks"),
        F.when(F.col("kg").isNull(), F.lit(None).cast("string")).otherwise(_num_text(F.col("kg"))).alias("kg"),
    )


def _form_text() -> F.Column:
    """Bag counts as people type them: some are no numbers."""
    k = F.col("o_orderkey") % 13
    return (
        F.when(k == 0, F.lit("x"))
        .when(k == 1, F.lit("12d"))
        .when(k == 2, F.lit("   "))
        .when(k == 3, F.lit("1_0"))
        .when(k == 4, F.lit(""))
        .when(k == 5, F.lit(" 1.5e1 "))
        .otherwise(_num_text(F.col("o_orderkey") % 50))
    )


def edit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farmer edit submissions for every '1-URGENT' order, keyed (season, id), and a second
    one for every seventh of them; the ids of every fifth are beyond the table's."""
    s = farmer_source(spark, sf_dir).where(F.col("o_orderpriority") == "1-URGENT")
    unknown = F.col("o_orderkey") % 5 == 0
    first = s.select(
        "season",
        (F.col("id") + F.when(unknown, F.lit(1_000_000_000)).otherwise(F.lit(0))).alias("id"),
        (F.col("id") * 2).alias("line"),
        F.upper(F.trim("rsbsa")).alias("rsbsa"),
        F.concat(F.lit(" "), F.lower("last_name"), F.lit(" ")).alias("last_name"),
        F.col("first_name"),
        F.lit("").alias("middle_name"),
        F.lit("Jr.").alias("suffix"),
        _num_text(F.col("o_orderkey") % 9).alias("area"),
        F.lit("SL 19").alias("variety"),
        _form_text().alias("sacks"),
        F.lit("").alias("kg"),
        (F.col("o_orderkey") % 7 == 0).alias("_twice"),
    )
    again = first.where("_twice").withColumn("line", F.col("line") + 1).withColumn("sacks", F.lit("7")).withColumn("suffix", F.lit("Sr."))
    return first.unionByName(again).drop("_twice")


def farmer_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = farmer_source(spark, sf_dir)
    return s.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "2-HIGH")).select("season", "id")


def association_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "AUTOMOBILE")
    return c.select(F.lit("wet").alias("season"), F.col("c_custkey").cast("long").alias("id"))


def municipality_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation").where(F.col("n_regionkey") == 2)
    ids = n.select(F.col("n_nationkey").cast("long").alias("id"))
    return ids.withColumn("season", F.lit("wet")).unionByName(ids.withColumn("season", F.lit("dry")))


def association_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New associations for both seasons: every supplier (in its nation), the same
    name again upper-cased, blank names for suppliers with negative balance, and every
    negative-balance customer's own name re-proposed in lower case."""
    sup = _read(spark, sf_dir, "supplier")
    cus = _read(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
    parts = []
    for season in ("wet", "dry"):
        parts.append(
            sup.select(
                F.lit(season).alias("season"),
                F.col("s_nationkey").cast("long").alias("municipality_id"),
                F.when(F.col("s_acctbal") < 0, F.lit("  ")).otherwise(F.col("s_name")).alias("name"),
                F.lit(0).alias("src"),
                F.col("s_suppkey").cast("long").alias("line"),
            )
        )
        parts.append(
            sup.select(
                F.lit(season).alias("season"),
                F.col("s_nationkey").cast("long").alias("municipality_id"),
                F.upper("s_name").alias("name"),
                F.lit(1).alias("src"),
                F.col("s_suppkey").cast("long").alias("line"),
            )
        )
        parts.append(
            cus.select(
                F.lit(season).alias("season"),
                F.col("c_nationkey").cast("long").alias("municipality_id"),
                F.concat(F.lower("c_name"), F.lit("  ")).alias("name"),
                F.lit(2).alias("src"),
                F.col("c_custkey").cast("long").alias("line"),
            )
        )
    from functools import reduce

    return reduce(DataFrame.unionByName, parts)


def association_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dry-season renames: MACHINERY customers to 'Assoc <nation>' (many per
    municipality), AUTOMOBILE customers to their own name in lower case, and
    negative-balance HOUSEHOLD customers to a blank name."""
    c = _read(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    new_name = (
        F.when(seg == "MACHINERY", F.concat(F.lit("Assoc "), F.col("c_nationkey").cast("string")))
        .when(seg == "AUTOMOBILE", F.lower("c_name"))
        .otherwise(F.lit(" "))
    )
    keep = (seg == "MACHINERY") | (seg == "AUTOMOBILE") | ((seg == "HOUSEHOLD") & (F.col("c_acctbal") < 0))
    return c.where(keep).select(
        F.lit("dry").alias("season"),
        # every eleventh id is beyond the table's, with whatever name
        (F.col("c_custkey") + F.when(F.col("c_custkey") % 11 == 0, F.lit(1_000_000_000)).otherwise(F.lit(0))).cast("long").alias("id"),
        new_name.alias("name"),
        F.col("c_custkey").cast("long").alias("line"),
    )


def municipality_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New municipalities in both seasons: each region name (blank for region 0), the
    region name again upper-cased, and each nation name in lower case."""
    r = _read(spark, sf_dir, "region")
    n = _read(spark, sf_dir, "nation")
    parts = []
    for season in ("wet", "dry"):
        parts.append(
            r.select(
                F.lit(season).alias("season"),
                F.when(F.col("r_regionkey") == 0, F.lit(" "))
                .otherwise(F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.substring("r_name", 2, 1000))))
                .alias("name"),
                F.lit(0).alias("src"),
                F.col("r_regionkey").cast("long").alias("line"),
            )
        )
        parts.append(
            r.select(
                F.lit(season).alias("season"),
                F.upper("r_name").alias("name"),
                F.lit(1).alias("src"),
                F.col("r_regionkey").cast("long").alias("line"),
            )
        )
        parts.append(
            n.select(
                F.lit(season).alias("season"),
                F.lower("n_name").alias("name"),
                F.lit(2).alias("src"),
                F.col("n_nationkey").cast("long").alias("line"),
            )
        )
    from functools import reduce

    return reduce(DataFrame.unionByName, parts)


def municipality_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wet-season renames: region 1 nations get a suffix, region 0 nations a blank name."""
    n = _read(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(0, 1))
    return n.select(
        F.lit("wet").alias("season"),
        F.col("n_nationkey").cast("long").alias("id"),
        F.when(F.col("n_regionkey") == 1, F.concat("n_name", F.lit(" (renamed)"))).otherwise(F.lit(" ")).alias("name"),
        F.col("n_nationkey").cast("long").alias("line"),
    )


def association_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered batch on the dry season's associations, two requests for most customers:
    every row but FURNITURE asks for one of 20 group names; then a row asks for another
    group, for its old name, or to be deleted, and FURNITURE rows add a group.  Lines mix
    the customers' order, so names are taken, kept and freed throughout the batch."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("long")
    dry = F.when(F.col("c_mktsegment") == "BUILDING", F.concat("c_name", F.lit(" Coop"))).otherwise(F.upper("c_name"))
    segment = F.col("c_mktsegment")

    def group(n):
        return F.concat(F.lit("Group "), (n % 20).cast("string"))

    def request(kind, name, line):
        i = F.when(kind != "add", k + F.when(k % 11 == 0, 1000000000).otherwise(0))
        m = F.when(kind == "add", F.col("c_nationkey") + F.when(k % 50 == 3, 1000).otherwise(0))
        return [kind.alias("kind"), F.lit("dry").alias("season"), i.alias("id"), m.cast("long").alias("municipality_id"), name.alias("name"), line.alias("line")]

    first = c.where(segment != "FURNITURE").select(*request(F.lit("rename"), group(k), k % 7 * 10**10 + k * 2))
    gone = (segment == "HOUSEHOLD") & (F.col("c_acctbal") < 0)
    kind = F.when(segment == "FURNITURE", "add").when(gone, "delete").otherwise("rename")
    name = (
        F.when(segment == "FURNITURE", group(k)).when(gone, F.lit(None).cast("string")).when(segment == "HOUSEHOLD", group(k * 3))
        .when(segment == "MACHINERY", group(k + 7)).when(segment == "BUILDING", dry).otherwise(F.concat(F.lit(" "), F.lower(dry)))
    )
    second = c.select(*request(kind, name, k * 5 % 7 * 10**10 + k * 2 + 1))
    return first.unionByName(second)


ASSOCIATION_REQUESTS_SQL = """
cust AS (
    SELECT CAST(c_custkey AS BIGINT) AS k, c_mktsegment AS segment, c_acctbal AS balance, CAST(c_nationkey AS BIGINT) AS nation,
           CASE c_mktsegment WHEN 'BUILDING' THEN c_name || ' Coop' ELSE upper(c_name) END AS dry
    FROM customer
),
asked AS (
    SELECT k, 'rename' AS kind, nation, 'Group ' || k % 20 AS name, k % 7 * 10000000000 + k * 2 AS line FROM cust WHERE segment <> 'FURNITURE'
    UNION ALL
    SELECT k, CASE WHEN segment = 'FURNITURE' THEN 'add' WHEN segment = 'HOUSEHOLD' AND balance < 0 THEN 'delete' ELSE 'rename' END, nation,
           CASE WHEN segment = 'FURNITURE' THEN 'Group ' || k % 20
                WHEN segment = 'HOUSEHOLD' THEN CASE WHEN balance >= 0 THEN 'Group ' || k * 3 % 20 END
                WHEN segment = 'MACHINERY' THEN 'Group ' || (k + 7) % 20 WHEN segment = 'BUILDING' THEN dry ELSE ' ' || lower(dry) END,
           k * 5 % 7 * 10000000000 + k * 2 + 1
    FROM cust
)"""
