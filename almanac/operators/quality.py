"""Schema detection and data-quality predicates. All return small frames of findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.expr import count_where, div, messages
from almanac.operators.reshape import clean_cell

KEYS = ["station_code", "station"]

# Names of day columns, first family that matches wins.
DAY_FAMILIES = ("Día", "Dia", "Day", "D", "Jour", "Tag", "G")

# Names looked for per role, exact first, then contained, then the default.
COLUMN_NAMES = {
    "date": (("fecha", "date", "fecha_medicion", "fecha_observacion"), ("fecha", "date", "fech", "dat"), "Fecha"),
    "station": (("estación", "estacion", "station", "estacion_meteorologica"),
                ("estación", "estacion", "station", "est"), "Estación"),
    "year": (("año", "ano", "year", "año_observacion"), ("año", "ano", "year", "an"), "Año"),
    "month": (("mes", "month", "mes_observacion"), ("mes", "month", "me"), "Mes"),
    "code": (("código", "codigo", "code", "codigo_estacion"), ("código", "codigo", "code", "cod"), "Código"),
}
VALUE_NAMES = {
    "temp_max": (("temperatura", "temp_max", "temperatura_maxima", "tmax"), ("temp", "temperatura", "tmax"),
                 "Temperatura"),
    "temp_min": (("temperatura", "temp_min", "temperatura_minima", "tmin"), ("temp", "temperatura", "tmin"),
                 "Temperatura"),
    "precipitation": (("precipitación", "precipitacion", "precipitation", "lluvia"), ("precip", "lluvia", "rain"),
                      "Precipitación"),
    "humidity": (("humedad", "humidity", "humedad_relativa", "hr"), ("humed", "humidity", "hr"), "Humedad"),
}

# Allowed range and missing share per variable.
RULES = {
    "temp_min": (-50.0, 60.0, 0.3),
    "temp_max": (-30.0, 70.0, 0.3),
    "precipitation": (0.0, 1000.0, 0.4),
    "humidity": (0.0, 100.0, 0.3),
}


def find_day_columns(columns: list[str]) -> tuple[str | None, list[tuple[str, int]]]:
    """Prefix and (column, day) pairs of the first family with any match."""
    for family in DAY_FAMILIES:
        found = [(c, int(m.group(1))) for c in columns if (m := re.fullmatch(rf"{family}(\d{{1,2}})", c))]
        if found:
            return family, sorted(found, key=lambda f: f[1])
    return None, []


def _filled(c: str) -> Column:
    return clean_cell(F.col(f"`{c}`").cast("string")).isNotNull()


def _present(c: str) -> Column:
    return F.col(f"`{c}`").isNotNull()


def _unfold(counted: DataFrame, entries: list[tuple], names: list[str]) -> DataFrame:
    """One row per entry from a single-row aggregate; columns given as columns or literals."""
    rows = [
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, e)]) for e in entries
    ]
    return counted.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def detect_day_columns(df: DataFrame) -> DataFrame:
    """One row per day column with its prefix, day number and count of measured cells."""
    prefix, found = find_day_columns(df.columns)
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[count_where(_filled(c)).alias(f"c{d}") for c, d in found])
    entries = [(c, prefix, d, max(x for _, x in found), F.col(f"c{d}"), F.col("n")) for c, d in found]
    return _unfold(counted, entries, ["column", "prefix", "day", "max_day", "measured", "total"])


def find_column(columns: list[str], exact, partial, default: str) -> str:
    lower = [c.lower() for c in columns]
    for name in exact:
        if name in lower:
            return columns[lower.index(name)]
    for name in partial:
        for original, low in zip(columns, lower):
            if name in low:
                return original
    return default


def detect_columns(df: DataFrame, variable: str = "temp_max") -> DataFrame:
    """Role to column name, with the number of non-null entries of the column found."""
    wanted = {**COLUMN_NAMES, "value": VALUE_NAMES.get(variable, VALUE_NAMES["temp_max"])}
    found = {role: find_column(df.columns, *names) for role, names in wanted.items()}
    counted = df.agg(*[
        (count_where(_present(c)) if c in df.columns else F.lit(0).cast("bigint")).alias(role)
        for role, c in found.items()
    ])
    entries = [(role, c, c in df.columns, F.col(role)) for role, c in found.items()]
    return _unfold(counted, entries, ["role", "column", "exists", "non_null"])


def structure_confidence(df: DataFrame) -> DataFrame:
    """Completeness of the day columns, structure type and confidence; accepted from 0.7."""
    _, found = find_day_columns(df.columns)
    lower = [c.lower() for c in df.columns]
    has = {role: any(n in lower for n in COLUMN_NAMES[role][0]) for role in ("year", "month", "station", "code")}
    if not found:
        kind = "unknown"
    elif has["year"] and has["month"]:
        kind = ("monthly_station_data" if has["code"] else "monthly_station_data_no_code") if has["station"] else "monthly_data"
    else:
        kind = "station_data" if has["station"] else "basic_data"
    base = (
        (0.3 if found else 0.0) + (0.1 if found and found[-1][1] >= 28 else 0.0)
        + 0.2 * has["year"] + 0.2 * has["month"] + 0.1 * has["station"] + 0.1 * has["code"]
    )
    filled = sum((count_where(_filled(c)) for c, _ in found), F.lit(0).cast("bigint"))
    share = F.coalesce(div(filled, F.count(F.lit(1)) * max(len(found), 1)), F.lit(0.0))
    confidence = F.least(F.lit(base) + 0.1 * F.col("completeness"), F.lit(1.0))
    return (
        df.agg(F.count(F.lit(1)).alias("rows_seen"), share.alias("completeness"))
        .select(
            F.lit(kind).alias("structure_type"), F.lit(len(found)).alias("day_columns"), "rows_seen",
            "completeness", confidence.alias("confidence"), (confidence >= 0.7).alias("accepted"),
        )
    )


def required_columns(df: DataFrame, expected: dict[str, str], min_rows: int = 1) -> DataFrame:
    """One row per expected column: present, type as expected, enough rows. Counts at most ``min_rows`` rows."""
    types = dict(df.dtypes)
    counted = df.limit(min_rows).agg(F.count(F.lit(1)).alias("n"))
    entries = [
        (c, t, types.get(c, "missing"), c in types, types.get(c) == t, F.col("n") >= min_rows)
        for c, t in expected.items()
    ]
    return _unfold(counted, entries, ["column", "expected", "actual", "present", "type_ok", "enough_rows"])


def _rule(variable: Column, i: int) -> Column:
    out = F.lit(None).cast("double")
    for name, values in RULES.items():
        out = F.when(variable == name, F.lit(values[i])).otherwise(out)
    return out


def range_violations(df: DataFrame, variable: Column) -> DataFrame:
    """Rows outside the allowed range of their variable, with the side they leave it on."""
    lo, hi = _rule(variable, 0), _rule(variable, 1)
    return df.withColumn("variable", variable).withColumn(
        "side", F.when(F.col("value") < lo, "below").when(F.col("value") > hi, "above")
    ).filter(F.col("side").isNotNull())


def missing_ratio_check(df: DataFrame, variable: str, keys: list[str] = KEYS) -> DataFrame:
    """Stations whose share of nulls is over the variable's limit."""
    limit = RULES[variable][2]
    return (
        df.groupBy(*keys).agg(F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("missing_ratio"))
        .filter(F.col("missing_ratio") > limit)
        .withColumn("missing_limit", F.lit(limit))
    )


def date_range_violations(df: DataFrame, start: str, end: str) -> DataFrame:
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    return df.withColumn(
        "side", F.when(F.col("date") < lo, "before").when(F.col("date") > hi, "after")
    ).filter(F.col("side").isNotNull())


def value_validation(df: DataFrame, variable: str, keys: list[str] = KEYS) -> DataFrame:
    """Missing count and share, moments, and warnings against the variable's rules."""
    lo, hi, limit = RULES[variable]
    stats = df.groupBy(*keys).agg(
        count_where(F.col("value").isNull()).alias("missing_count"),
        F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("missing_share"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value"),
    )
    return stats.withColumn("warnings", messages(
        (F.col("missing_share") > limit, "high_missing"),
        (F.col("min_value") < lo, "below_minimum"), (F.col("max_value") > hi, "above_maximum"),
    ))


def structure_validation(df: DataFrame, required: list[str], year: str, month: str) -> DataFrame:
    """Required columns, numeric year and month, years between 1900 and 2100."""
    missing = [c for c in required if c not in df.columns]
    bad_year = F.col(f"`{year}`").isNotNull() & F.col(f"`{year}`").try_cast("int").isNull()
    bad_month = F.col(f"`{month}`").isNotNull() & F.col(f"`{month}`").try_cast("int").isNull()
    y = F.col(f"`{year}`").try_cast("int")
    checked = df.agg(
        count_where(bad_year).alias("non_numeric_year"), count_where(bad_month).alias("non_numeric_month"),
        F.min(y).alias("min_year"), F.max(y).alias("max_year"),
    )
    ok = (
        (F.col("non_numeric_year") == 0) & (F.col("non_numeric_month") == 0)
        & (F.col("min_year") >= 1900) & (F.col("max_year") <= 2100)
    )
    return checked.select(
        "*", F.lit(",".join(missing)).alias("missing_columns"), (ok & F.lit(not missing)).alias("valid")
    )


def series_validity(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """At least 10 rows, 5 of them measured, and some variation."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"), F.var_pop("value").alias("variance"),
    ).withColumn("verdict", (
        F.when(F.col("n") < 10, "too_short").when(F.col("n_known") == 0, "all_null")
        .when(F.col("n_known") < 5, "too_few_values").when(F.col("variance") == 0, "constant").otherwise("valid")
    )).drop("variance")


def _gate(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_distinct("station").alias("n_stations"), F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(
            F.avg(F.when(F.col("value").isNull(), 100.0).otherwise(0.0)), F.lit(0.0)).alias("missing_pct"),
        F.coalesce(F.datediff(F.max("date"), F.min("date")), F.lit(0)).alias("range_days"),
    )


def station_input_report(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Findings per station, and one row for the whole table (station null)."""
    whole = _gate(df).select(
        F.lit(None).cast("int").alias("station_code"), F.lit(None).cast("string").alias("station"),
        F.col("n_rows").alias("n"), "missing_pct",
        messages(
            (F.col("n_rows") == 0, "error_empty"), (F.col("n_stations") == 0, "error_no_stations"),
            (F.col("n_stations") == 1, "one_station"), (F.col("missing_pct") < 1, "few_missing"),
            (F.col("missing_pct") > 90, "error_too_many_missing"), (F.col("range_days") < 30, "short_range"),
        ).alias("findings"),
    )
    each = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("value").isNull(), 100.0).otherwise(0.0)).alias("missing_pct"),
        F.count("value").alias("known"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    ).select(*keys, "n", "missing_pct", messages(
        (F.col("n") < 10, "few_rows"), (F.col("missing_pct") > 80, "high_missing"),
        ((F.col("known") > 1) & (F.col("lo") == F.col("hi")), "constant"),
    ).alias("findings"))
    return each.unionByName(whole)


def processed_report(df: DataFrame) -> DataFrame:
    """The same gate after restructuring: above 80% missing is an error, above 50% a warning."""
    g = _gate(df)
    return g.select(
        "n_stations", "n_rows", "missing_pct", "range_days",
        messages(
            (F.col("n_rows") == 0, "error_empty"), (F.col("n_stations") == 0, "error_no_stations"),
            (F.col("n_stations") == 1, "one_station"), (F.col("missing_pct") > 80, "error_too_many_missing"),
            (F.col("missing_pct").between(50.0000001, 80), "high_missing"),
            (F.col("range_days") < 30, "short_range"),
        ).alias("findings"),
        ((F.col("n_rows") > 0) & (F.col("n_stations") > 0) & (F.col("missing_pct") <= 80)).alias("passed"),
    )


def quality_gate(
    df: DataFrame, keys: list[str] = KEYS, order: str = "pos", min_rows: int = 100, max_rows: int = 50000,
    max_missing: float = 0.5,
) -> DataFrame:
    """Rows, missing share, infinities, variation and date order per station; stricter verdict for models.

    ``order`` is what rows arrived in: dates are tested along it. The default ``pos`` follows the dates
    of a calendar, which is sorted by construction; raw tables name their arrival column.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    finite = F.when(~F.abs("value").isin(float("inf")) & ~F.isnan("value"), F.col("value"))
    stats = df.withColumn("back", F.lag("date").over(w) > F.col("date")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("missing_ratio"),
        count_where(F.abs("value") == float("inf")).alias("infinite"),
        F.min(finite).alias("lo"), F.max(finite).alias("hi"),
        count_where(F.col("back")).alias("out_of_order"),
    )
    return stats.withColumn("findings", messages(
        (F.col("n") < min_rows, "too_few_rows"), (F.col("n") > max_rows, "too_many_rows"),
        (F.col("missing_ratio") > max_missing, "high_missing"), (F.col("infinite") > 0, "infinite_values"),
        (F.coalesce(F.col("lo") == F.col("hi"), F.lit(True)), "no_variation"),
        (F.col("out_of_order") > 0, "dates_not_sorted"),
    )).select(
        *keys, "n", "missing_ratio", "infinite", "out_of_order", "findings",
        (F.col("findings") == "").alias("passed"),
        ((F.col("n") >= 100) & (F.col("missing_ratio") <= 0.3)).alias("model_ready"),
    )
