import pytest
from pyspark.sql import functions as F

from tessella.operators import figures, wording


@pytest.mark.parametrize("name,section", [("Calcium, Ca", "Minerals"), ("Vitamin C, total ascorbic acid", "Vitamins"), ("Fatty acids, total saturated", "Fats & fatty acids"), ("Energy", "Energy & macros"), ("Caffeine", "Other nutrients"), (None, "Other nutrients"), ("Folate, DFE", "Vitamins"), ("Sugars, total", "Energy & macros")])
def test_nutrient_sections(spark, name, section):
    assert spark.createDataFrame([(name,)], "n string").select(wording.nutrient_section(F.col("n"))).first()[0] == section


def test_composition_tables(spark):
    rows = [("Protein of beans", ["Food"], True), ("Sites", ["Food", "PROTEIN (g)"], True), ("Sites", ["Food"], False), (None, None, False)]
    d = spark.createDataFrame(rows, "caption string, headers array<string>, want boolean")
    assert d.filter(wording.composition_table(F.col("caption"), F.col("headers"), "protein|fat") != F.col("want")).count() == 0


def test_preset_windows():
    from datetime import datetime

    now = datetime(2024, 5, 4, 13, 30, 1)
    assert figures.preset_window("last_24h", now) == (datetime(2024, 5, 3, 13, 30, 1), None)
    assert figures.preset_window("last_7d", now) == (datetime(2024, 4, 27, 13, 30, 1), None)
    assert figures.preset_window("all", now) == (None, None) and figures.preset_window("other", now) == (datetime(2024, 5, 4), None)
    assert figures.preset_window("custom", now, datetime(2024, 1, 1), None) == (datetime(2024, 1, 1), None)
