"""Settings: plain dataclasses for callers, Spark conf for size bounds."""

from __future__ import annotations

from dataclasses import dataclass

KEYS = ["dataset", "series_id"]


@dataclass(frozen=True)
class PrepConfig:
    """Defaults of the sample-preparation builders."""

    seq_len: int = 336
    pred_len: int = 96
    prompt_len: int = 133
    train_ratio: float = 0.7
    val_ratio: float = 0.1
    stride: int = 10
    scale_on_train: bool = False
    strict: bool = False
    on_missing: str = "raise"  # of a series without prompt; "drop" leaves it out, see missing_prompts


# Largest group that a plan may gather into one array or one in-task sort.
# Longer groups take the range-partitioned plans, which never gather a group.
MAX_GROUP_ROWS = ("spark.tidegauge.maxGroupRows", 100_000)
# Points per chunk where neighbouring points are needed (lag, lead, kernels).
CHUNK_ROWS = ("spark.tidegauge.chunkRows", 32_768)
# Offsets per chunk when sample windows are cut.
WINDOW_CHUNK = ("spark.tidegauge.windowChunk", 4_096)
# Points per chunk of a packed series table, the points after it that are stored with it, and
# the chunks that share one copy of what is joined per series.
PACK_CHUNK = ("spark.tidegauge.packChunk", 8_192)
PACK_HALO = ("spark.tidegauge.packHalo", 1_023)
PACK_BLOCK = ("spark.tidegauge.packBlock", 16)


def bound(spark, setting) -> int:
    name, default = setting
    return int(spark.conf.get(name, str(default)))
