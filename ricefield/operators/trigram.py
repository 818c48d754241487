"""Substring search over farmers from trigram posting lists.

``LIKE '%term%'`` can't use an order of the values, so a search reads every farmer.  Here
each value of the searched columns is cut into its lower-cased three-character pieces, and
for each piece, column and part of the farmers the ids that have it are kept in one list.  A
search intersects, part by part, the lists of the pieces that every match must have, and
only these candidates are fetched and confirmed by the same ``LIKE`` as before, so results
are those of the scan.

Pieces come from the literal runs of a term (between ``%``, ``_`` and ``\\``); a term without
a run of three characters gives none, and the search scans.  Farmers are dealt into parts by
a hash of their id, and a part into so many cells that a list has about ``LIST`` ids at most:
a piece that all farmers share is many short lists, however many farmers there are, as lists
are built, read and intersected whole in memory (readers hold thousands at once).  Lists lie
sorted by piece, farmers in one folder per part: a search reads the row groups of its
pieces and the folders of parts with candidates (dynamic pruning).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ricefield.session import stored

COLUMNS = ("rsbsa", "last_name", "first_name")
PARTS = 32
LIST = 512
KEY = ["part", "season", "id"]


def pieces(column) -> F.Column:
    """The distinct trigrams of a value, lower-cased; none for NULL and shorter values."""
    low = F.lower(column)
    places = F.sequence(F.lit(1), F.length(low) - 2)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3)))))


def grams_of(df: DataFrame, term: str) -> list[str]:
    """The trigrams that any value containing the ``LIKE`` term has."""
    runs = [r for r in re.split(r"[%_\\]", term) if len(r) >= 3]
    if not runs:
        return []
    # lower-cased by Spark, as the values are
    found = df.sparkSession.createDataFrame([(r,) for r in runs], "run string").select(F.explode(pieces(F.col("run"))).alias("gram"))
    return sorted({r["gram"] for r in found.collect()})


@dataclass
class FarmerIndex:
    """``rows``: farmers by part; ``postings``: gram, field, part, cell, season, ids."""

    rows: DataFrame
    postings: DataFrame

    def candidates(self, term: str) -> DataFrame:
        """Farmers that can match the term; all of them where it has no trigram."""
        grams = grams_of(self.rows, term)
        if not grams:
            return self.rows.drop("part")
        lists = self.postings.where(F.col("gram").isin(grams)).groupBy("field", "part", "cell", "season").agg(F.collect_list("ids").alias("lists"))
        whole = lists.where(F.size("lists") == len(grams))
        both = F.aggregate(F.expr("slice(lists, 2, size(lists))"), F.col("lists")[0], F.array_intersect)
        ids = whole.select("part", "season", F.explode(both).alias("id")).distinct()
        return self.rows.join(ids, KEY, "left_semi").drop("part")


def build_index(farmer: DataFrame, columns: tuple[str, ...] = COLUMNS, parts: int = PARTS) -> FarmerIndex:
    """Write farmers by part and their posting lists below the checkpoint folder."""
    dealt = farmer.withColumn("part", F.pmod(F.xxhash64("season", "id"), F.lit(parts)).cast("int"))
    rows = stored(dealt.repartition("part"), "farmers-by-part", partition_by=["part"])
    cells = max(1, -(-rows.count() // (parts * LIST)))
    # other bits of the hash than those of the part
    cell = F.pmod(F.shiftrightunsigned(F.xxhash64("season", "id"), 32), F.lit(cells)).cast("int").alias("cell")
    each = F.array(*[F.struct(F.lit(c).alias("field"), pieces(F.col(c)).alias("grams")) for c in columns])
    found = rows.select(*KEY, cell, F.explode(each).alias("f")).select(*KEY, "cell", "f.field", F.explode("f.grams").alias("gram"))
    lists = found.groupBy("gram", "field", "part", "cell", "season").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    order = ["gram", "part", "cell"]
    return FarmerIndex(rows, stored(lists.repartitionByRange(*order).sortWithinPartitions(*order), "postings"))
