"""Hand-written model tables (FIXTURES.md F1-F5)."""

from __future__ import annotations

from ricefield.sources.model import ASSOCIATION, FARMER, MUNICIPALITY, VARIETY, Tables


def farmer_row(season, id_, assoc, rsbsa="", last="", first="", middle="", suffix="", area=0.0, variety="", sacks=0.0, kg=0.0):
    return (season, id_, assoc, rsbsa, last, first, middle, suffix, area, variety, sacks, kg)


def tables(spark, munis, assocs, farmers, varieties=None) -> Tables:
    return Tables(
        municipality=spark.createDataFrame(munis, MUNICIPALITY),
        association=spark.createDataFrame(assocs, ASSOCIATION),
        farmer=spark.createDataFrame(farmers, FARMER),
        variety=spark.createDataFrame(varieties or [], VARIETY),
    )


def f1_tables(spark) -> Tables:
    munis = [("wet", 1, "Alpha"), ("wet", 2, "Bravo"), ("dry", 1, " alpha "), ("dry", 2, "Charlie")]
    assocs = [
        ("wet", 1, 1, "Rice One"),
        ("wet", 2, 1, "Empty"),
        ("dry", 1, 1, "RICE ONE "),
        ("dry", 2, 1, "New"),
        ("dry", 3, 2, "Zero"),
    ]
    farmers = [
        farmer_row("wet", 1, 1, "A-1", "Cruz", "Ana", area=1.0, sacks=10.0, kg=50.0),
        farmer_row("wet", 2, 1, "B-2", "Reyes", "Ben", area=2.0, sacks=20.0, kg=40.0),
        farmer_row("dry", 1, 1, "A-1", "Cruz", "Ana", area=1.5, sacks=30.0, kg=50.0),
        farmer_row("dry", 2, 2, "", "Luna", "Eva", area=1.0, sacks=None, kg=50.0),
        farmer_row("dry", 3, 3, "", "Ng", "Li", area=0.0, sacks=5.0, kg=45.0),
    ]
    return tables(spark, munis, assocs, farmers)
