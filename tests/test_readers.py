"""Sampler configs and benchmark arrays as files."""

import json
import os

import pytest

from coverlens.operators.prompts import job_matrix, prefix_variants
from coverlens.sources import readers as R

HEAD = "sampler:\n  class: VLLMSampler\n  model_name: org/Model-1.5B\n  temperature: 0.6\n  top_p: 0.95\n  top_k: -1\n  max_tokens: 32768\n  max_model_len: 32768\n  trust_remote_code: true\n"
CONFIGS = {
    "default": HEAD,
    "prefix_Okay": HEAD + "  thinking_prefix: Okay\n",
    "quoted": "# run\nsampler:\n\n  model_name: 'a # b'   # a comment\n  thinking_prefix: \"Let \\\"us\\\"\\n\"\n  stop: [\"x y\", 'z']\n  seed: ~\n  top_k:\n",
    "diverse": "tokenizer:\n  path: tok/one\nsampler:\n  class: DiverPathVLLMSampler\n  first_topk: 8\n  stop: </s>\n  gpu_memory_utilization: 0.9",
    "windows": "sampler:\r\n  model_name: m\r\n  temperature: 1\r\n",
}


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("configs")
    for run, text in CONFIGS.items():
        os.makedirs(root / "job" / run)
        (root / "job" / run / "sampler_config.yaml").write_bytes(text.encode())
    return {r.run: r for r in R.read_run_configs(spark, str(root)).collect()}, str(root)


def test_configs(runs):
    got, _ = runs
    assert set(got) == set(CONFIGS) and all(r.job_dir == "job" for r in got.values())
    d, q, v, w = got["default"], got["quoted"], got["diverse"], got["windows"]
    assert (d.sampler_class, d.model, d.temperature, d.top_p, d.top_k, d.max_tokens, d.max_model_len, d.trust_remote_code) == ("VLLMSampler", "org/Model-1.5B", 0.6, 0.95, -1, 32768, 32768, True)
    assert d.thinking_prefix is None and got["prefix_Okay"].thinking_prefix == "Okay" and d.params == {}
    assert (q.sampler_class, q.model, q.thinking_prefix, q.stop, q.top_k, q.params) == ("ChatCompletionSampler", "a # b", 'Let "us"\n', ["x y", "z"], None, {"seed": None})
    assert (v.sampler_class, v.first_topk, v.stop, v.tokenizer_path, v.params) == ("DiverPathVLLMSampler", 8, ["</s>"], "tok/one", {"gpu_memory_utilization": "0.9"})
    assert (w.model, w.temperature) == ("m", 1.0)


def test_run_table_drives_prompts_and_jobs(spark, runs):
    table = R.read_run_configs(spark, runs[1])
    prompts = spark.createDataFrame([(1, "p"), (2, "q")], "id long, prompt string")
    got = {(r.id, r.run): r.run_prompt for r in prefix_variants(prompts, runs=table).collect()}
    assert len(got) == 10 and got[1, "prefix_Okay"] == "pOkay" and got[2, "default"] == "q"
    jobs = job_matrix(prompts, 3, table)
    assert jobs.count() == 30 and {r.run for r in jobs.collect()} == set(CONFIGS)


def test_items_in_one_array(spark, tmp_path):
    rows = [{"id": 0, "Question": "a\nb", "answer": "1"}, {"id": 1, "Question": "c", "answer": "2", "Solution": "s", "subset": "x"}]
    (tmp_path / "test.json").write_text(json.dumps(rows, indent=4))
    got = R.read_benchmark(spark, "toy", {"toy": str(tmp_path / "test.json")}).orderBy("id").collect()
    assert [(r.id, r.Question, r.subset) for r in got] == [(0, "a\nb", None), (1, "c", "x")]
    with pytest.raises(ValueError):
        R.read_benchmark(spark, "none", {})
