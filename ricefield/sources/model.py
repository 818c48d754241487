"""Table model: one table per entity with a ``season`` column.

Ids are independent per season, so every key is ``(season, id)`` and every foreign-key
join is on ``(season, fk)``.  On disk each table is Parquet partitioned by ``season``,
so choosing a season is partition pruning.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

MUNICIPALITY = StructType(
    [
        StructField("season", StringType(), False),
        StructField("id", LongType(), False),
        StructField("name", StringType(), False),
    ]
)
ASSOCIATION = StructType(
    [
        StructField("season", StringType(), False),
        StructField("id", LongType(), False),
        StructField("municipality_id", LongType(), False),
        StructField("name", StringType(), False),
    ]
)
VARIETY = StructType(
    [
        StructField("season", StringType(), False),
        StructField("id", LongType(), False),
        StructField("name", StringType(), False),
    ]
)
FARMER = StructType(
    [
        StructField("season", StringType(), False),
        StructField("id", LongType(), False),
        StructField("association_id", LongType(), False),
        StructField("rsbsa", StringType(), True),
        StructField("last_name", StringType(), True),
        StructField("first_name", StringType(), True),
        StructField("middle_name", StringType(), True),
        StructField("suffix", StringType(), True),
        StructField("area", DoubleType(), True),
        StructField("variety", StringType(), True),
        StructField("sacks", DoubleType(), True),
        StructField("kg", DoubleType(), True),
    ]
)

SCHEMAS = {
    "municipality": MUNICIPALITY,
    "association": ASSOCIATION,
    "variety": VARIETY,
    "farmer": FARMER,
}
# Parent-before-child order (loads go top-down, clears go bottom-up).
TABLE_ORDER = ["municipality", "association", "variety", "farmer"]

# The nine seed varieties, in the reference's order.
SEED_VARIETIES = ["Bigante", "Lp2096", "Nk 5017", "S6003", "SL 20", "SL 19", "JACKPOT", "SL 8", "TH 82"]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the declared schema of ``table`` (column order and types)."""
    schema = SCHEMAS[table]
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class Tables:
    municipality: DataFrame
    association: DataFrame
    farmer: DataFrame
    variety: DataFrame | None = None
    # farmer totals per (season, association_id), where they are already at hand
    totals: DataFrame | None = None
    # the store and state that the tables were read from
    read_at: dict | None = None

    def items(self):
        for f in fields(self):
            df = getattr(self, f.name)
            if df is not None and f.name not in ("totals", "read_at"):
                yield f.name, df

    def with_(self, **kw) -> "Tables":
        return replace(self, **kw)

    def season(self, *seasons: str) -> "Tables":
        """Restrict every table to the given seasons (partition pruning on read)."""
        cond = F.col("season").isin(list(seasons))
        kept = {name: df.where(cond) for name, df in self.items()}
        return Tables(**kept, totals=None if self.totals is None else self.totals.where(cond))


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table as of the store's last commit (a plain folder before the first one)."""
    from ricefield.sinks import store

    return store.read(spark, root, table)


def read_tables(spark: SparkSession, root: str, with_variety: bool = True) -> Tables:
    """All tables as of one commit."""
    from ricefield.sinks import store

    at = store.state(spark, root)
    # a store without varieties is whole
    names = [n for n in TABLE_ORDER if n != "variety" or (with_variety and store.has_table(spark, root, n))]
    return Tables(**{n: store.read(spark, root, n, at) for n in names}, read_at={**at, "store": root.rstrip("/")})


def write_table(df: DataFrame, root: str, table: str, mode: str = "overwrite") -> None:
    conform(df, table).write.mode(mode).partitionBy("season").parquet(table_path(root, table))


def write_tables(tables: Tables, root: str, mode: str = "overwrite") -> None:
    for name in TABLE_ORDER:
        df = getattr(tables, name)
        if df is not None:
            write_table(df, root, name, mode)
