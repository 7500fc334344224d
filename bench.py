"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; BENCH_ONLY, a comma
separated list, restricts the run to some queries.
"""

import json
import os
import time

from glyphloom.plans.flagship import piece_profile
from glyphloom.plans.queries import QUERIES
from glyphloom.session import local_session

HEADLINE = [
    "split_pieces", "llama_pieces", "piece_counts", "pair_counts", "config_piece_counts",
    "split_diagnostics", "concept_density", "op_frequency", "encode_pieces", "decode_pieces",
    "surface_collapse", "pack_sequences", "next_token_pairs", "piece_offsets", "unigram_ppl",
    "mean_pop_std", "repetition_rate", "generation_summary", "nfc_text", "bpe_merges", "encode_corpus",
    "decode_corpus", "decode_factored", "roundtrip_classes", "shuffle_batches", "multi_repeat_ops",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    spark = local_session(cores)
    piece_profile(spark, sf_dir).collect()  # start the JVM's and Python's workers
    runs = {"piece_profile": piece_profile, **{name: QUERIES[name] for name in HEADLINE}}
    times = {}
    for name, run in runs.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
