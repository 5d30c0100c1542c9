"""Wall time of the headline jobs; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegauge.config import KEYS, PrepConfig
from tidegauge.features.extract import extract, extract_windows
from tidegauge.features.registry import select
from tidegauge.operators import metrics
from tidegauge.operators.splits import split_lookback, split_plain
from tidegauge.operators.windows import sample_windows
from tidegauge.plans import builders, prompts, scoring
from tidegauge.sources.tables import events_series, supplier_series

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CFG = PrepConfig(seq_len=96, pred_len=24, stride=1)


def windowing(s):
    """Every stride-1 sample of the look-back splits of all suppliers."""
    return sample_windows(split_lookback(supplier_series(s, SF_DIR), 96, 24), 96, 24, 1, ["split", *KEYS])


def native_features(s):
    names = [f.name for f in (*select("temporal"), *select("statistical"))]
    return extract(supplier_series(s, SF_DIR), KEYS, names=names)


def spectral_features(s):
    return extract(supplier_series(s, SF_DIR), KEYS, domain="spectral")


def window_features(s):
    return extract_windows(supplier_series(s, SF_DIR), 50, 0.5, tag="emg")


def metric_bundle(s):
    w = sample_windows(supplier_series(s, SF_DIR), 96, 24)
    steps = metrics.explode_steps(scoring.last_value(w, 24))
    return metrics.metric(steps, ["dataset"])


def token_samples(s):
    sig = supplier_series(s, SF_DIR)
    bank = split_plain(sig).groupBy("split", *KEYS).agg(F.array(F.max("y"), F.avg("y")).alias("features"))
    return builders.token_samples(sig, bank, PrepConfig(seq_len=96, pred_len=24, stride=10))


def prompt_bank(s):
    return prompts.build_bank(events_series(s, SF_DIR))


JOBS = [windowing, native_features, spectral_features, window_features, metric_bundle, token_samples, prompt_bank]


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One pass over a table starts the JVM's readers and code generator before the clock runs.
    events_series(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = {}
    for job in JOBS:
        t0 = time.time()
        job(spark).write.format("noop").mode("overwrite").save()
        times[job.__name__] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "wall_time", "value": total, "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
