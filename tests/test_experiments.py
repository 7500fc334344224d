import json

import pytest
from pyspark.sql import functions as F

from glyphloom.operators import experiments as ex
from glyphloom.operators import metrics as mt
from glyphloom.operators.configs import CATALOGUE, config_table
from glyphloom.session import work_dir
from glyphloom.sources import reports, results

RUNS = [("d", "split", 1, 2.0), ("d", "split", 2, 4.0), ("d", "split_factored", 1, 1.0),
        ("d", "split_factored", 2, 8.0), ("d", "split_factored", 3, 5.0), ("d", "llama", 1, 3.0),
        ("d", "metaspace", 1, 0.0)]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(RUNS, "dataset string, config string, seed bigint, char_to_token_ratio double")


def test_pairs_follow_the_seed(runs):
    rows = ex.paired_inflation(runs).collect()
    got = {(r.config, r.seed): r.inflation for r in rows}
    assert got == {("split", 1): 0, ("split", 2): 0, ("split_factored", 1): 100.0,
                   ("split_factored", 2): -50.0, ("llama", 1): 0}


def test_population_deviation(runs):
    rows = {r.config: r for r in ex.mean_pop_std(runs, "char_to_token_ratio").collect()}
    assert (rows["split"].mean, rows["split"].std, rows["split"].n) == (3.0, 1.0, 2)
    assert rows["llama"].n == 1


def test_plus_minus(spark):
    rows = [(3.0, 1.0, 2), (3.0, 0.0, 1), (None, None, 0)]
    df = spark.createDataFrame(rows, "m double, s double, n int")
    out = [r.x for r in df.select(ex.plus_minus("%.2f", *map(F.col, "msn")).alias("x")).collect()]
    assert out == ["3.00 ± 1.00", "3.00", "N/A"]
    out = [r.x for r in df.select(ex.plus_minus("%+.2f", *map(F.col, "msn"), "%%").alias("x")).collect()]
    assert out == ["+3.00% ± 1.00%", "+3.00%", "N/A"]


def test_grid_and_skips(spark, runs):
    planned = ex.grid(spark.createDataFrame([("d",)], "dataset string"),
                      config_table(spark, ["split", "llama"]).select("config"),
                      spark.createDataFrame([(1,), (2,), (3,)], "seed bigint"))
    assert planned.count() == 6
    assert {(r.config, r.seed) for r in ex.missing_runs(planned, runs).collect()} == {
        ("split", 3), ("llama", 2), ("llama", 3)}
    assert ex.present_runs(planned, runs).count() == 3


def test_result_files(spark, tmp_path):
    for dataset, run, seed in (("tinystories", "ts_split", 42), ("csn-go", "csn_go_llama_factored", 7)):
        body = {"dataset": dataset, "tokenizer_type": run, "vocab_size": 16000, "char_to_token_ratio": 2.5}
        (tmp_path / f"results_{run}_seed{seed}_25M.json").write_text(json.dumps(body, indent=2))
    rows = {r.run: r for r in results.read_runs(spark, f"{tmp_path}/*.json").collect()}
    assert rows["ts_split"].seed == 42 and rows["ts_split"].model_size == "25M"
    assert rows["csn_go_llama_factored"].seed == 7 and rows["ts_split"].vocab_size == 16000


def test_metrics_keep_nulls(spark):
    path = work_dir(spark, "metrics-test")
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "label string, inflation double")
    results.write_metrics(df, path)
    assert '"inflation":null' in "".join(r.value for r in spark.read.text(path).collect())
    assert results.read_metrics(spark, path, df.schema).exceptAll(df).isEmpty()


def test_vocab_metrics(spark):
    rows = [("l", "split", 100, 1000, 500), ("l", "split_factored", 80, 1000, 600)]
    df = mt.with_baseline(spark.createDataFrame(
        rows, "label string, config string, vocab_size bigint, chars bigint, tokens bigint"))
    got = {r.config: r for r in df.select(
        "config", mt.inflation(F.col("tokens"), F.col("base_tokens")).alias("infl"),
        mt.vocab_diff(F.col("vocab_size"), F.col("base_vocab_size"), F.lit(200)).alias("d"),
        mt.vocab_diff(F.col("vocab_size"), F.col("base_vocab_size"), F.lit(100)).alias("cut")).collect()}
    assert got["split"].infl is None and got["split"].d is None
    assert got["split_factored"].infl == pytest.approx(20) and got["split_factored"].d == pytest.approx(-20)
    assert got["split_factored"].cut is None


def test_concepts(spark):
    tokens = ["[UNK]", "Café", "cafe", "CAFE", "!!", "hmmmm", "hm", "\uE100\uE000", "\uE100\uE000hm"]
    df = spark.createDataFrame([("l", t) for t in tokens], "label string, token string")
    row = mt.concept_density(df.withColumn("ops", F.lit(True)), opcodes="ops").first()
    assert (row.concepts, row.vocab_size, row.opcode_tokens) == (2, 9, 1)


def test_reports(spark, runs):
    rows = [("Books", 128_000, "split", 40120, 30090, 75.0, 3.12504, None, None),
            ("Books", 128_000, "split_factored", 33310, 32976, 98.9973, 2.80012, 11.6037, -16.974),
            ("Books", 500, "other", 1, 1, 1.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "label string, target_vocab_size bigint, config string, actual_vocab_size bigint, "
                                     "concepts bigint, density double, chars_per_token double, inflation double, "
                                     "vocab_diff double")
    report = reports.vocab_report(df)
    lines = [r.line for r in report.filter("target_vocab_size = 128000").orderBy("ord").collect()]
    assert lines[0] == "## Dataset: Books, target vocabulary 128k" and lines[2] == "|---|---|---|---|---|---|---|"
    assert lines[3] == "| **Split Only** | 40120 | 30090 | 75.00% | 3.1250 | - | - |"
    assert lines[4] == "| **Split + Factoring** | 33310 | 32976 | 99.00% | 2.8001 | +11.60% | -16.97% |"
    assert any("| **other** |" in r.line for r in report.filter("target_vocab_size = 500").collect())

    full = runs
    for c in ("vocab_size", "tokens_per_sec", "chars_per_sec", "final_val_loss", "final_ppl_token", "final_ppl_char"):
        full = full.withColumn(c, F.lit(1500.0))
    lines = {r.line.split(" | ")[0]: r.line for r in reports.sweep_report(full).collect()}
    assert lines["| **Split + Factoring**"].split(" | ")[1:4] == [
        "1,500.0 ± 0.0", "4.667 ± 2.867", "+25.00% ± 75.00%"]
    assert lines["| **Split Only**"].split(" | ")[3] == "0.00%"
    assert lines["| **Llama Split Only**"].split(" | ")[1] == "1,500"
    strange = full.withColumn("config", F.when(F.col("config") == "split_factored", "renamed").otherwise(F.col("config")))
    rows = reports.sweep_report(strange).orderBy("ord").collect()
    unknown = [r for r in rows if "renamed" in r.line]
    assert unknown and all(r.line.split(" | ")[3] == "N/A" and r.ord > 2 for r in unknown)

    path = work_dir(spark, "report-test")
    reports.write_report(report.filter("target_vocab_size = 128000"), path, ["ord"])
    written = [r.value for r in spark.read.text(path).collect()]
    assert written[0].startswith("## Dataset") and len(written) == 5


def test_catalogue():
    assert len(CATALOGUE) == 12
    for c in CATALOGUE.values():
        assert c.factored == bool(c.baseline)
        assert c.baseline is None or not CATALOGUE[c.baseline].factored


def test_sweep_report_counts_the_corpus_once(spark, sf):
    """The report read its runs four times, and each time all documents were cut and counted anew."""
    from glyphloom.plans.queries import QUERIES
    plan = QUERIES["sweep_report"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "documents" not in plan
