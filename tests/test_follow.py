"""Progress as samples arrive: late and repeated samples, restarts, a failure between two writes."""

import pytest

from wafermill.streaming import progress

SCHEMA = progress.STREAM_SCHEMA
ROWS = [(k, None if k % 4 == 0 else f"p{k % 3}", None if k % 7 == 0 else k % 5 > 0, None if k % 6 == 0 else k / 8) for k in range(1, 121)]


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").json(path)


def follow(spark, folder, **more):
    return progress.follow_progress(spark, f"{folder}/in", ["pcell"], "sample_id", 500, f"{folder}/out", **more)


def plain(rows):
    return sorted(((r.pcell or "", r.sample_id, r.completed, r.success_rate, r.elapsed, r.avg_time, r.eta) for r in rows))


def wanted(spark, rows):
    return plain(progress.progress_rows(spark.createDataFrame(rows, SCHEMA), ["pcell"], "sample_id", 500).collect())


def test_rows_after_a_restart(spark, tmp_path):
    put(spark, f"{tmp_path}/in", ROWS[:50])
    assert plain(follow(spark, tmp_path).collect()) == wanted(spark, ROWS[:50])
    put(spark, f"{tmp_path}/in", ROWS[50:])
    got = follow(spark, tmp_path)
    assert plain(got.collect()) == wanted(spark, ROWS)
    assert got.select("batch").distinct().count() == 2
    assert plain(follow(spark, tmp_path).collect()) == wanted(spark, ROWS)


def test_late_and_repeated_samples(spark, tmp_path):
    first, late = ROWS[3:60], ROWS[:3] + ROWS[60:80]
    put(spark, f"{tmp_path}/in", first)
    follow(spark, tmp_path)
    put(spark, f"{tmp_path}/in", first[:20] + late + late)
    got = {(r.pcell, r.sample_id): r.completed for r in follow(spark, tmp_path).collect()}
    assert len(got) == 80
    for pcell in {r[1] for r in ROWS}:
        order = [r[0] for r in first if r[1] == pcell] + sorted(r[0] for r in late if r[1] == pcell)
        assert [got[pcell, k] for k in order] == list(range(1, len(order) + 1))


def test_a_failed_batch_runs_again(spark, tmp_path, monkeypatch):
    put(spark, f"{tmp_path}/in", ROWS[:40])
    follow(spark, tmp_path)
    put(spark, f"{tmp_path}/in", ROWS[40:])
    shown = progress._shown
    calls = []

    def broken(*args):
        calls.append(1)
        if len(calls) == 1:
            return shown(*args).withColumn("elapsed", progress.F.raise_error(progress.F.lit("disk full")).cast("double"))
        return shown(*args)

    monkeypatch.setattr(progress, "_shown", broken)
    with pytest.raises(Exception):
        follow(spark, tmp_path)
    assert plain(follow(spark, tmp_path).collect()) == wanted(spark, ROWS)


def test_nothing_yet(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [])
    assert follow(spark, tmp_path).collect() == []
