"""Small observation tables for the tests."""

from datetime import datetime

OBS_DDL = (
    "platform_number string, cycle_number string, profile_id string, time timestamp, latitude double, longitude double, "
    "pres double, data_mode string, position_qc string, temp_adjusted double, temp_adjusted_qc string, "
    "psal_adjusted double, psal_adjusted_qc string, calendar_month int, year int, _source_file string, source_row bigint"
)


def obs_row(platform="1", cycle="1", day="2024-07-10", lat=19.0, lon=72.8, pres=5.0, mode="D", position="1", temp=28.0,
            temp_qc="1", psal=35.0, psal_qc="1", file="a.csv", row=3):
    t = datetime.fromisoformat(day)
    return (platform, cycle, f"{platform}:{cycle}", t, lat, lon, pres, mode, position, temp, temp_qc, psal, psal_qc, t.month, t.year, file, row)


def obs_frame(spark, rows):
    return spark.createDataFrame(rows, OBS_DDL)


def by(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}


def selection(sid="s", lat=19.0, lon=72.8, radius=300.0, explicit=False, d1="2024-07-01", d2="2024-07-31", month=None, season=None,
              calendar_month=None, view="profile", parameters=("temperature",), region=None, bounds=(None,) * 4):
    from datetime import date

    s, n, w, e = bounds
    return (sid, sid, lat, lon, region, s, n, w, e, radius, explicit, date.fromisoformat(d1), date.fromisoformat(d2), month,
            calendar_month, season, view, list(parameters), True, 2)


def selections(spark, *rows):
    from isohaline.schema import SELECTION

    return spark.createDataFrame(list(rows), SELECTION)
