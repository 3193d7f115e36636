"""What names and describes a run: tags, times, resolved parameters, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slugged(value: str) -> str:
    """Lower case, runs of other signs than letters, digits, dots, dashes and underscores as one dash, none of these at the ends."""
    return re.sub(r"[^a-z0-9._-]+", "-", value.strip().lower()).strip("-_")


def device_tag(kind: str | None, name: str | None = None, count: int = 1) -> str:
    parts = [kind or "unknown", *([f"{count}gpu"] if kind == "cuda" and count > 1 else []), *([name] if name else [])]
    return slugged("_".join(parts)) or "unknown"


def run_tag(stage: str, learning_rate: float, epochs: int, batch_size: int, accumulation: int, max_length: int, max_neg: int | None, seed: int) -> str:
    """The parameters that tell training runs apart, joined."""
    neg = "all" if max_neg is None else max_neg
    return slugged(f"{stage}_lr{learning_rate:g}_e{epochs}_bs{batch_size}_ga{accumulation}_len{max_length}_neg{neg}_seed{seed}")


def run_folder(run_id: str, auto_tag: str | None = None, user_tag: str | None = None, plain: bool = False) -> str:
    tags = [t for t in (None if plain else auto_tag, slugged(user_tag or "")) if t]
    return "_".join(["run", run_id, *tags])


def cache_tag(model: str, normalize: bool, max_length: int | None, precision: str, blacklist: bool) -> str:
    """The folder name of vectors that one set of encoder parameters gave."""
    flag = lambda x: "T" if x else "F"
    return f"{re.sub('[/ @]', '-', model.lower())}_norm{flag(normalize)}_msl{max_length or None}_pm{precision}_blk{flag(blacklist)}"


def max_length(argument: int | None, configured: int | None, model: int | None) -> int:
    """The first that is given: an argument, the configuration, a model's own bound below 100,000; else 512."""
    own = model if model and model < 100_000 else None
    return int(argument or configured or own or 512)


def local_time(at: Column | None = None, hours: int = 8) -> Column:
    """A moment (now) as ISO text at a fixed offset from UTC."""
    zone = f"{'+' if hours >= 0 else '-'}{abs(hours):02d}:00"
    moment = F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone())
    return F.concat(F.date_format(F.from_utc_timestamp(moment, zone), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))


def first_files(files: DataFrame, n: int | None = 5, order: str = "file") -> DataFrame:
    """The first n files in order, or all, for inspection."""
    return files.orderBy(order).limit(n) if n is not None else files.orderBy(order)


def sample_counts(rows: DataFrame, name: str) -> DataFrame:
    """Samples and distinct normalised query ids of a data set, one row."""
    query = F.coalesce(F.trim(F.col("query_id").cast("string")).try_cast("bigint").cast("string"), F.col("query_id").cast("string"))
    return rows.agg(F.count(F.lit(1)).alias(f"{name}_samples"), F.count_distinct(query).alias(f"{name}_query_ids"))


def manifest(train: DataFrame, dev: DataFrame, blacklist: DataFrame, facts: dict[str, str]) -> DataFrame:
    """One row: samples and queries of both sets, the blacklist's size, and given facts (paths, sources, commits) with the time."""
    black = blacklist.agg(F.count_distinct("query_id").alias("blacklist_count"))
    row = sample_counts(train, "train").join(sample_counts(dev, "dev"), F.lit(True)).join(black, F.lit(True))
    return row.select("*", *(F.lit(v).alias(k) for k, v in facts.items()), local_time().alias("created_at"))
