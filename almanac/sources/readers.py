"""Scans of station files: monthly-wide tables, imputed station files, threshold sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.operators.quality import COLUMN_NAMES, VALUE_NAMES

KEYS = ["station_code", "station"]

# The raw table's columns, date-column keywords, and units.
DAY_COLUMNS = [f"Día{d:02d}" for d in range(1, 32)]
DATE_KEYWORDS = ("fecha", "date", "time", "timestamp", "datetime")
UNITS = {"temp_min": "°C", "temp_max": "°C", "temperature": "°C", "precipitation": "mm", "humidity": "%"}

MONTHLY_SCHEMA = T.StructType(
    [T.StructField("Código", T.IntegerType()), T.StructField("Estación", T.StringType()),
     T.StructField("Año", T.IntegerType()), T.StructField("Mes", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in DAY_COLUMNS])

STATION_FILE_SCHEMA = "station_code INT, station STRING, date STRING, value DOUBLE"

# Columns of a threshold sheet by position: cold block, gap, heat block.
SHEET_COLUMNS = (
    "code_c", "name_c", "p5_tmax", "p5_tmin", "p10_tmax", "p10_tmin",
    "gap", "code_h", "name_h", "p95_tmax", "p95_tmin", "p90_tmax", "p90_tmin")
THRESHOLDS = ("p5_tmax", "p5_tmin", "p10_tmax", "p10_tmin", "p95_tmax", "p95_tmin", "p90_tmax", "p90_tmin")


def scan_monthly_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw monthly-wide table. Day cells stay text, they hold markers for missing values."""
    return spark.read.option("header", True).schema(MONTHLY_SCHEMA).csv(path)


def file_stem(path: Column) -> Column:
    """Name of the station file a row came from; a dataset folder of that name counts as the file."""
    return F.regexp_extract(F.url_decode(path), r"([^/=]+)\.csv(/|$)", 1)


def scan_station_files(spark: SparkSession, root: str) -> DataFrame:
    """Imputed station files below ``root``: names with ``_Imputed.csv``, consolidated ones left out.

    One scan over all files; the station is the file's stem.
    """
    df = (
        spark.read.option("header", True).option("recursiveFileLookup", True)
        .schema(STATION_FILE_SCHEMA).csv(root)
        .withColumn("stem", file_stem(F.col("_metadata.file_path")))
    )
    keep = F.col("stem").endswith("_Imputed") & ~F.col("stem").startswith("all_stations")
    return parse_date_column(df.filter(keep)).select(
        F.regexp_extract("stem", r"(\d+)", 1).try_cast("int").alias("station_code"),
        F.col("stem").alias("station"), "date", "value")


def _position(cells: Column, names: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    """Number from 0 of the first cell that is one of ``names``, else of the first that has one of ``parts``; null if none."""
    exact = F.array_position(F.transform(cells, lambda c: F.coalesce(c.isin(*names), F.lit(False))), F.lit(True))
    loose = F.array_position(F.transform(cells, lambda c: F.coalesce(c.rlike("|".join(parts)), F.lit(False))), F.lit(True))
    found = F.when(exact > 0, exact).when(loose > 0, loose)
    return (found - 1).cast("int")


def scan_station_tables(spark: SparkSession, root: str, variable: str = "temp_max", columns: int = 48) -> DataFrame:
    """(station_code, station, date, value) of all CSV files below ``root``, each read by its own header.

    Columns may come in any order and under any of the known names (date, value of ``variable``, code, station), up to
    ``columns`` of them. A header is a row that has a date keyword in a cell; its places are joined to the file's
    other rows, one small row per file. Without a code column the file name's first number is the code, without a
    station column the file name is the station. Files without a date or value column give no rows; bad dates and numbers are null.
    """
    names = [f"c{i}" for i in range(columns)]
    cells = F.transform(F.array(*names), lambda c: F.trim(c))
    raw = (spark.read.option("header", False).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
           .schema(", ".join(f"{c} STRING" for c in names)).csv(root).select(cells.alias("cells"), F.col("_metadata.file_path").alias("file")))
    known = raw.withColumn("lower", F.transform("cells", F.lower))
    is_header = F.exists("lower", lambda c: F.coalesce(c.rlike("|".join(DATE_KEYWORDS)), F.lit(False)))
    wanted = {"date": (("date", "fecha"), DATE_KEYWORDS), "code": COLUMN_NAMES["code"][:2], "station": (COLUMN_NAMES["station"][0], COLUMN_NAMES["station"][1][:3]),
              "value": tuple((*a, *b) for a, b in zip(VALUE_NAMES.get(variable, VALUE_NAMES["temp_max"])[:2], (("value", "valor"),) * 2))}
    places = known.where(is_header).select("file", *[_position(F.col("lower"), *n).alias(f"{role}_at") for role, n in wanted.items()])
    of_file = places.groupBy("file").agg(*[F.min(f"{role}_at").alias(f"{role}_at") for role in wanted]).where("date_at is not null and value_at is not null")
    rows = known.where(~is_header).join(of_file, "file")
    cell = lambda role: F.get("cells", F.col(f"{role}_at"))
    stem = F.regexp_extract(F.url_decode("file"), r"([^/]+)\.csv$", 1)
    return rows.select(
        F.coalesce(cell("code").try_cast("double").cast("int"), F.regexp_extract(stem, r"(\d+)", 1).try_cast("int")).alias("station_code"),
        F.coalesce(cell("station"), stem).alias("station"), parsed_date(cell("date")).alias("date"), cell("value").try_cast("double").alias("value"))


def parsed_date(c: Column) -> Column:
    """ISO date or timestamp first, then year-month-day, then day/month/year."""
    t = c.cast("string")
    return F.coalesce(
        F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")), F.try_to_timestamp(t, F.lit("dd/MM/yyyy"))
    ).cast("date")


def find_date_column(df: DataFrame) -> str | None:
    """By keyword in the name; else the first column whose values all parse, over the whole table."""
    for c in df.columns:
        if any(k in c.lower() for k in DATE_KEYWORDS):
            return c
    texts = [c for c, t in df.dtypes if t in ("string", "date", "timestamp", "timestamp_ntz")]
    if not texts:
        return None
    counts = df.agg(*[
        F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(texts)
    ], *[F.count(parsed_date(F.col(f"`{c}`"))).alias(f"ok_{i}") for i, c in enumerate(texts)]).first()
    for i, c in enumerate(texts):
        if counts[f"n_{i}"] and counts[f"n_{i}"] == counts[f"ok_{i}"]:
            return c
    return None


def parse_date_column(df: DataFrame) -> DataFrame:
    """The date column as DATE under the name ``date``; bad text becomes null."""
    name = find_date_column(df)
    if name is None:
        raise ValueError("no date column found")
    out = df.withColumn(name, parsed_date(F.col(f"`{name}`")))
    return out if name == "date" else out.withColumnRenamed(name, "date")


def scan_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A threshold sheet exported to CSV, all text, columns by position."""
    schema = ", ".join(f"{c} STRING" for c in SHEET_COLUMNS)
    return spark.read.option("header", False).schema(schema).csv(path)


def load_thresholds(sheet: DataFrame) -> DataFrame:
    """One row per station from the two blocks; heading rows, unequal codes and missing numbers fall away."""
    cold, heat = F.col("code_c").try_cast("double").try_cast("int"), F.col("code_h").try_cast("double").try_cast("int")
    typed = sheet.select(
        cold.alias("station_code"), heat.alias("code_h"),
        F.coalesce("name_c", "name_h", F.concat(F.lit("Estación_"), cold.cast("string"))).alias("station"),
        *[F.col(c).try_cast("double").alias(c) for c in THRESHOLDS])
    return typed.filter(F.col("station_code") == F.col("code_h")).dropna(subset=list(THRESHOLDS)).drop("code_h")


def source_profile(df: DataFrame) -> DataFrame:
    """Shape, dates, values and the first ten stations by name, over the whole source."""
    names = df.select("station").where("station IS NOT NULL").distinct().orderBy("station").limit(10)
    names = names.agg(F.array_sort(F.collect_list("station")).alias("names")).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.concat_ws(",", names).alias("stations"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("std_value"))


def variable_of(name: Column) -> Column:
    low = F.lower(name)
    has = lambda *words: F.lit(False) if not words else _any([low.contains(w) for w in words])
    return (
        F.when(has("temp_min", "minima"), "temp_min").when(has("temp_max", "maxima"), "temp_max")
        .when(has("precip", "lluvia"), "precipitation").when(has("humidity", "humedad"), "humidity")
        .otherwise("temperature"))


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def unit_of(variable: Column) -> Column:
    out = F.lit("")
    for name, unit in UNITS.items():
        out = F.when(variable == name, F.lit(unit)).otherwise(out)
    return out


def variable_from_path(df: DataFrame, path: Column) -> DataFrame:
    """Variable and unit from the name of the file behind each row."""
    stem = file_stem(path)
    variable = variable_of(stem)
    return df.withColumns({"variable": variable, "unit": unit_of(variable)})
