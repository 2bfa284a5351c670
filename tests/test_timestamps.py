from datetime import UTC, datetime

import pytest

from quern.operators.timestamps import PARSER, local_to_epoch_ms, normalise_timestamps, parse_instant


def ms(*parts, micro=0):
    return int(datetime(*parts, tzinfo=UTC).timestamp() * 1000) + micro


@pytest.mark.parametrize(
    "text, zone, country, want",
    [
        ("2026-01-12T08:30", "Europe/Dublin", "IE", ms(2026, 1, 12, 8, 30)),
        ("2026-07-12 08:30:15", "Europe/Paris", "FR", ms(2026, 7, 12, 6, 30, 15)),
        ("20260102T042517Z", None, None, ms(2026, 1, 2, 4, 25, 17)),
        ("1767339929", None, None, 1767339929000),
        ("1767367397582", None, None, 1767367397582),
        ("2026-01-02T02:28:17.354532026+00:00", None, None, ms(2026, 1, 2, 2, 28, 17) + 354),
        ("  2026-01-01T20:23:21.8-05:00\xa0", None, None, ms(2026, 1, 2, 1, 23, 21) + 800),
        ("Fri, 01 May 2026 01:24:16 IST", "Europe/Dublin", "IE", ms(2026, 5, 1, 0, 24, 16)),
        ("Fri, 01 May 2026 01:24:16 IST", "Asia/Kolkata", "IN", ms(2026, 4, 30, 19, 54, 16)),
        ("Fri, 01 May 2026 01:24:16 IST", None, None, None),
        ("Mon, 05 Jan 2026 10:00:00 CST", "Asia/Shanghai", "CN", ms(2026, 1, 5, 2)),
        ("Mon, 05 Jan 2026 10:00:00 CST", "America/Chicago", "US", ms(2026, 1, 5, 16)),
        ("Fri Apr 24 02:34:04 2026", "UTC", "GB", ms(2026, 4, 24, 2, 34, 4)),
        ("Fri, 03 Jan 26 05:38:25 +0800", None, None, ms(2026, 1, 2, 21, 38, 25)),
        ("10/1/2026 8:19 PM", "America/Los_Angeles", "US", ms(2026, 10, 2, 3, 19)),
        ("10/1/2026 8:19 PM", "Europe/London", "GB", ms(2026, 1, 10, 20, 19)),
        ("12/01/2026 12:05 am", "Europe/London", "GB", ms(2026, 1, 12, 0, 5)),
        ("10 août 2026 à 10h30", "Europe/Paris", "FR", ms(2026, 8, 10, 8, 30)),
        ("1er août 2026 à 12h34", "Europe/Paris", "FR", ms(2026, 8, 1, 10, 34)),
        ("10 de junio de 2026, 1:06", "Europe/Madrid", "ES", ms(2026, 6, 9, 23, 6)),
        ("14. März 2026, 22:18 Uhr", "Europe/Vienna", "AT", ms(2026, 3, 14, 21, 18)),
        ("April 14, 2026 7:52 p.m.", "America/New_York", "US", ms(2026, 4, 14, 23, 52)),
        ("10 Οκτωβρίου 2026 10:09", "Europe/Athens", "GR", ms(2026, 10, 10, 7, 9)),
        ("27 сентября 2026 10:18", "Asia/Tashkent", "UZ", ms(2026, 9, 27, 5, 18)),
        ("19 अक्टूबर 2026 15:58", "Asia/Kolkata", "IN", ms(2026, 10, 19, 10, 28)),
        ("٢٠٢٦-١٠-٢٠ ١٦:٤٣", "Asia/Dubai", "AE", ms(2026, 10, 20, 12, 43)),
        ("2026年10月12日 21時22分", "Asia/Tokyo", "JP", ms(2026, 10, 12, 12, 22)),
        ("08/03/2569 15:09", "Asia/Bangkok", "TH", ms(2026, 3, 8, 8, 9)),
        ("01.04.2026 04:48", "Asia/Tashkent", "UZ", ms(2026, 3, 31, 23, 48)),
        ("2026-10-25T01:30", "Europe/London", "GB", None),  # twice
        ("2026-03-29T01:30", "Europe/London", "GB", None),  # never
        ("2026-03-29T01:30+00:00", "Europe/London", "GB", ms(2026, 3, 29, 1, 30)),
        ("2026-01-12T08:30", None, None, None),
        ("2026-05-14", "UTC", "GB", None),
        ("2026-02-30T10:00:00Z", None, None, None),
        ("2026-08-09T25:10:00Z", None, None, None),
        ("0000-00-00 00:00:00", "UTC", "GB", None),
        ("13:00 PM", "UTC", "GB", None),
        ("TBC", "UTC", "GB", None),
        ("", "UTC", "GB", None),
        (None, "UTC", "GB", None),
        ("x" * 100_000, "UTC", "GB", None),
    ],
)
def test_notations(text, zone, country, want):
    assert parse_instant(text, zone, country) == want


def test_unknown_zone_is_no_zone():
    assert local_to_epoch_ms(datetime(2026, 1, 1), "Nowhere/At-all") is None


def test_every_row_comes_out_and_the_dictionary_grows_once(spark, tmp_path):
    folder = f"file://{tmp_path}/dictionary"
    rows = [(1, "2026-01-12T08:30", "UTC", "GB"), (2, None, "UTC", "GB"), (3, " ", "UTC", "GB"), (4, "2026-01-12T08:30", None, None), (5, "2026-01-12T08:30", "UTC", "GB")]
    df = spark.createDataFrame(rows, "ord BIGINT, published STRING, tz STRING, country STRING").withColumnRenamed("ord", "epoch_MS")
    for _ in range(2):
        out = normalise_timestamps(df.withColumnRenamed("epoch_MS", "ord"), "published", "tz", "country", dictionary=folder)
        assert {r.ord: r.epoch_ms for r in out.collect()} == {1: ms(2026, 1, 12, 8, 30), 2: None, 3: None, 4: None, 5: ms(2026, 1, 12, 8, 30)}
        kept = f"{folder}/parser-{PARSER}"
        assert spark.read.parquet(kept).count() == 2  # the second run parsed nothing
    spark.read.parquet(kept).write.mode("append").parquet(kept + "-again")
    spark.read.parquet(kept + "-again").write.mode("append").parquet(kept)  # as two runs at once may leave it
    assert normalise_timestamps(df.withColumnRenamed("epoch_MS", "ord"), "published", "tz", "country", dictionary=folder).count() == 5


def test_empty_table(spark):
    df = spark.createDataFrame([], "ord BIGINT, published STRING, tz STRING, country STRING, epoch_ms INT")
    assert normalise_timestamps(df, "published", "tz", "country").collect() == []


def test_a_hot_string_is_split_off(spark, monkeypatch):
    import quern.operators.timestamps as module

    seen = []
    monkeypatch.setattr(module, "hot_keys", lambda counts, key, n: seen.extend(r[0] for r in counts.where("n > 50").select(key).collect()) or seen)
    rows = [(i, "TBC" if i % 3 else f"2026-01-12T08:{i % 60:02}", "UTC", "GB") for i in range(300)]
    out = normalise_timestamps(spark.createDataFrame(rows, "ord BIGINT, published STRING, tz STRING, country STRING"), "published", "tz", "country")
    assert out.count() == 300 and out.where("epoch_ms IS NULL").count() == 200 and len(seen) == 1
