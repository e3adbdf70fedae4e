"""Streaming jobs: replays, copies of shards, late rows."""

import datetime as dt

from coverlens.streaming import monitors as M

DAY = dt.datetime(2026, 1, 1)


def test_a_replayed_epoch_counts_once(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = "run string, split string, question_id long, prompt_id long, n long, c long"
    first = spark.createDataFrame([("r", "s", 1, 1, 2, 1), ("r", "s", 2, 2, 1, 0)], schema)
    second = spark.createDataFrame([("r", "s", 1, 1, 5, 3)], schema)
    for batch, epoch in [(first, 0), (second, 1), (second, 1), (first, 0)]:
        M.write_epoch(batch, epoch, out)
    assert sorted(tuple(r)[2:] for r in M.latest_counts(spark, out).collect()) == [(1, 1, 5, 3), (2, 2, 1, 0)]


def test_copies_of_a_shard_and_batches_of_files(spark, tmp_path):
    rows = [(q, q, s, "r", "all", "4", "\\boxed{4}" if s % 2 else "\\boxed{5}") for q in (1, 2) for s in range(4)]
    df = spark.createDataFrame(rows, "question_id long, prompt_id long, sample_id long, run string, split string, gt_answer string, response string")
    src = [str(tmp_path / x) for x in ("in", "out", "ckpt")]
    for shard in range(2):
        M.stage_shards(df.where(f"sample_id % 2 = {shard}").selectExpr("*", f"{shard} as shard").coalesce(1), src[0])
    M.stage_shards(df.selectExpr("*", "7 as shard").coalesce(1), src[0])
    got = M.stream_pass_counts(spark, *src, files_per_trigger=1)
    want = [("r", "all", 1, 1, 4, 2), ("r", "all", 2, 2, 4, 2)]
    assert sorted(map(tuple, got.collect())) == want
    assert spark.read.schema(M.COUNT_SCHEMA).parquet(src[1]).select("epoch").distinct().count() >= 2
    assert sorted(map(tuple, M.stream_pass_counts(spark, *src).collect())) == want  # nothing new has come


def test_late_rows_count_in_open_windows_only(spark, tmp_path):
    src = [str(tmp_path / x) for x in ("in", "out", "ckpt")]

    def deliver(shard, rows):
        data = [(i, DAY + dt.timedelta(days=d, hours=1), r, "stop", 1, shard) for i, (d, r) in enumerate(rows)]
        M.stage_shards(spark.createDataFrame(data, M.ROLLOUT_SCHEMA), src[0])
        return {r.window_start[:10]: (r.n_episodes, r.rewards) for r in M.stream_reward_sliding(spark, *src).collect()}

    # the latest time is Jan 5, 01:00, the watermark Jan 4, 01:00: windows that end by then are closed
    closed = {"2025-12-31": (1, 1.0), "2026-01-01": (2, 0.5), "2026-01-02": (1, 0.0)}
    assert deliver(0, [(0, 1.0), (1, 0.0), (4, 1.0)]) == closed
    # Jan 3 is late for the window of Jan 2 and in time for that of Jan 3; Jan 1 is late for all
    assert deliver(1, [(0, 0.0), (2, 1.0), (9, 1.0)]) == closed | {"2026-01-03": (1, 1.0), "2026-01-04": (1, 1.0), "2026-01-05": (1, 1.0)}
