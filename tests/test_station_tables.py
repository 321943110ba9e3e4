"""Station files read by their own headers."""

import datetime as dt

from almanac.plans.lineage import scratch_path
from almanac.sources import readers


def test_files_of_any_layout(spark, tmp_path):
    files = {
        "a/101_north.csv": "Fecha,Temperatura\n2021-01-01,1.5\n2021-01-02,\nbad,3\n2021-01-04,x\n",
        "a/b/other.csv": "value,Estación,note,Código,date\n7,South,\"a, b\",202,03/02/2021\n",
        "wide.csv": "code,lluvia,station,time\n5,0.25,West,2021-01-01T00:00:00\n",
        "no_value.csv": "Fecha,Nombre\n2021-01-01,abc\n",
        "empty.csv": "", "header_only.csv": "date,value\n", "notes.txt": "date,value\n2021-01-01,9\n"}
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    rows = {tuple(r) for r in readers.scan_station_tables(spark, str(tmp_path), "temp_max").collect()}
    day = dt.date
    assert rows == {(101, "101_north", day(2021, 1, 1), 1.5), (101, "101_north", day(2021, 1, 2), None), (101, "101_north", None, 3.0),
                    (101, "101_north", day(2021, 1, 4), None), (202, "South", day(2021, 2, 3), 7.0)}
    rain = {tuple(r) for r in readers.scan_station_tables(spark, str(tmp_path), "precipitation").collect()}
    assert (5, "West", day(2021, 1, 1), 0.25) in rain and scratch_path(spark, "x")
