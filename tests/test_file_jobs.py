"""The evaluation job from files, with shards as pandas writes them."""

import json
import os

import pandas as pd
import pytest

from coverlens.operators.coverage import run_summary
from coverlens.plans import file_jobs as J
from coverlens.plans import queries_jobs as Q
from coverlens.sources.readers import read_run_shards

SMOKE_DIR = "/root/testdata/sf0.001"
COLUMNS = ["question_id", "prompt_id", "response", "pred_answer", "gt_answer", "sampler_config", "prompt_tokens", "completion_tokens"]


def estimate(n, c, k):
    p = 1.0
    for i in range(n - c + 1, n + 1):
        p *= 1 - k / i
    return 1.0 if n - c < k else 1.0 - p


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("runs dir+")
    right = {}  # (run, question) -> correct flags in order of shard, then row
    for run in ("default", "prefix_Okay", "not listed"):
        for w, ts in enumerate(["20260101_120000", "20260101_130000"]):
            rows = []
            for q in (10, 2, 33):
                for i in range(3):
                    ok = (q + i + w + len(run)) % 3 != 0
                    rows.append((q, 0, f'He said "it",\nthen \\boxed{{{q if ok else q + 1}}}', None, str(q), "{'a': 1}", 5, 10 + i))
                    right.setdefault((run, q), []).append(ok)
            folder = base / "math" / "aime" / run
            os.makedirs(folder, exist_ok=True)
            pd.DataFrame(rows, columns=COLUMNS).to_csv(folder / f"test.generations_seed{w}.{ts}_{w}.csv", index=False)
            (folder / "test.prompts.csv").write_text("not,a\nshard,1\n")
    (base / "jobs.txt").write_text("math/aime|default|test|8\nmath/aime|prefix_Okay|test\nmath/aime|default|test|8\nmath/aime|missing|test|8\n")
    return str(base), right


def test_shards_of_all_runs(spark, root):
    rows = read_run_shards(spark, root[0]).collect()
    assert len(rows) == 54 and {(r.job_dir, r.split) for r in rows} == {("math/aime", "test")}
    assert {(r.run, r.seed, r.worker) for r in rows} == {(x, w, w) for x in ("default", "prefix_Okay", "not listed") for w in (0, 1)}
    assert all("\n" in r.response and r.completion_tokens >= 10 for r in rows)
    for run in ("default", "not listed"):  # rows of a shard keep their order
        mine = [r for r in sorted(rows, key=lambda r: tuple(r.place)) if r.run == run]
        assert [r.completion_tokens for r in mine] == [10, 11, 12] * 6 and [r.worker for r in mine] == [0] * 9 + [1] * 9


@pytest.mark.parametrize("cutoff,line", [(4, 1_000), (256, 2)])
def test_job_list_to_metrics(spark, root, tmp_path, monkeypatch, cutoff, line):
    monkeypatch.setattr(J, "LINE_VALUES", line)
    base, right = root
    processed = J.process_jobs(spark, base, f"{base}/jobs.txt", str(tmp_path / "processed"))
    assert processed.count() == 36 and "response" in processed.columns
    status = {r.run: r.n_rows for r in J.job_status(spark, f"{base}/jobs.txt", processed).collect()}
    assert status == {"default": 18, "prefix_Okay": 18, "missing": 0}
    path = J.write_metrics(processed, str(tmp_path), "20260101_150000", cutoff)
    for run in ("default", "prefix_Okay"):
        (file,) = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-") and f"run={run}/" in d + "/"]
        doc = json.load(open(file, encoding="utf-8"))["overall"]
        n = min(6, cutoff)
        assert list(doc["pass_at_k"]) == list(doc["detail_pass_at_k"]) == [f"pass@{k}" for k in range(1, n + 1)]
        for k in range(1, n + 1):
            want = [estimate(n, sum(right[run, q][:n]), k) for q in (2, 10, 33)]
            assert doc["detail_pass_at_k"][f"pass@{k}"] == pytest.approx(want) and doc["pass_at_k"][f"pass@{k}"] == pytest.approx(sum(want) / 3)
        assert doc["mean_response_len"] == 5.0
    with pytest.raises(Exception, match="already exists"):
        J.write_metrics(processed, str(tmp_path), "20260101_150000", cutoff)
    back = J.read_metrics(spark, path).where("run = 'default' and metric = 'pass@1'").orderBy("pos").collect()
    assert [r.pos for r in back] == [0, 1, 2]
    tokens = run_summary(processed, J.RUN).first()
    assert (tokens.prompt_tokens, tokens.completion_tokens) == (90, 198)


def test_paths_are_taken_apart_once_a_file(spark, root):
    """The rows of the scan meet their file's parts in a join; no pattern is matched with a row's path."""
    shards = read_run_shards(spark, root[0])
    plan = shards._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "regexp_extract" in plan
    rows = plan[plan.index("Join Inner") : plan.index(" csv")]
    assert not any(word in rows for word in ("regexp", "RLIKE", "url_decode", "UrlCodec"))


def test_a_staged_shard_has_a_part_for_every_core(spark):
    base = Q._staged(spark, SMOKE_DIR)
    shards = [d for d, _, _ in os.walk(f"{base}/runs") if d.endswith(".csv")]
    assert len(shards) == 10
    for d in shards:
        parts = [f for f in os.listdir(d) if f.startswith("part-")]
        assert len(parts) >= spark.sparkContext.defaultParallelism > 2
    places = read_run_shards(spark, f"{base}/runs").where("run = 'click'").select("place", "worker", "completion_tokens").collect()
    for w in (0, 1):  # completion_tokens are sample_id % 400, samples ascend
        tokens = [r.completion_tokens for r in sorted(places, key=lambda r: tuple(r.place)) if r.worker == w]
        assert tokens == [i % 400 for i in sorted(r.event_id for r in spark.read.parquet(f"{SMOKE_DIR}/events.parquet").where(f"event_type = 'click' AND event_id % 2 = {w}").collect())]
