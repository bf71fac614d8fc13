import datetime as dt

import pytest

from gatelens import schemas
from gatelens.plans.dashboard import Dashboard
from gatelens.sources import writers

AS_OF = dt.datetime(2024, 1, 2, 10, 30, tzinfo=dt.timezone.utc)


def rows(spark):
    return spark.createDataFrame(
        [(AS_OF - dt.timedelta(hours=n), "openai", f"p{n % 2}", 1.5, n % 2 == 0, None, 1, 2, 0) for n in range(5)],
        schemas.REQUEST_STATS,
    )


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_reports(spark, tmp_path, fmt):
    path = str(tmp_path / "stats")
    writers.write_request_stats(rows(spark), path, fmt)
    board = Dashboard(spark, path, fmt, AS_OF)
    assert [r["count"] for r in board.requests(hours=3).collect()] == [1, 1, 1, 1]
    assert [r.total_tokens for r in board.tokens("day", 24, "openai").collect()] == [0, 15]
    assert [(r.provider_name, r.request_count) for r in board.summary().collect()] == [("p0", 3), ("p1", 2)]
    assert board.summary(from_utc="2024-01-02T10:00:00Z").count() == 1
    with pytest.raises(ValueError):
        board.summary(hours=1, from_utc="2024-01-02T10:00:00Z")
    with pytest.raises(ValueError):
        board.requests(hours=0)


def test_missing_source(spark, tmp_path):
    board = Dashboard(spark, str(tmp_path / "none"))
    assert board.requests().collect() == board.tokens().collect() == board.summary().collect() == []
    assert board.requests().columns == ["timestamp", "count"]
    with pytest.raises(ValueError):
        board.requests("week")
