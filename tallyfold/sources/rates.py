"""Rate tables: per-model prices with a NULL-able cacheability threshold, and cache multipliers."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import fixed
from tallyfold.plans.sizing import bounded_broadcast
from tallyfold.store import files

RATE_SCHEMA = "model string, input_rate bigint, output_rate bigint, threshold bigint"


@dataclass(frozen=True)
class CacheMultipliers:
    """Multipliers on the input rate, as integer millionths."""

    read: int = 100_000
    write_5m: int = 1_250_000
    write_1h: int = 2_000_000
    unknown: int = 1_250_000
    unknown_confidence: str = "low"


@dataclass(frozen=True)
class RateTable:
    models: tuple[tuple[str, int, int, int | None], ...]
    cache: CacheMultipliers = CacheMultipliers()
    origin: str = "explicit"
    priced_on: str = "unknown"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.models), RATE_SCHEMA)

    @property
    def fingerprint(self) -> str:
        """Digest of every rate, threshold and multiplier, of models in use or not."""
        c = self.cache
        times = [str(Fraction(m, 1_000_000)) for m in (c.read, c.write_5m, c.write_1h, c.unknown)]
        parts = ["cache:" + "/".join([*times, c.unknown_confidence])]
        parts += [f"{m}:{i}/{o}/{floor}" for m, i, o, floor in sorted(self.models)]
        return sha256("|".join(parts).encode()).hexdigest()[:16]

    def dimension(self, spark: SparkSession) -> DataFrame:
        """The table as a join side; its row count is known here, so the broadcast is checked."""
        return bounded_broadcast(self.frame(spark), len(self.models))


def _micros(usd: object) -> int:
    return int((Decimal(str(usd)) * 1_000_000).to_integral_value())


#: Where a table comes from, the first that is there wins.
EXPLICIT, REFRESHED, BUNDLED = "explicit", "refreshed", "bundled"


def table_of(text: str, name: str, origin: str = EXPLICIT) -> RateTable:
    """A rate registry from its TOML text; a missing required key or an empty model list is an error that names the file."""
    raw = tomllib.loads(text)
    for key in ("schema_version", "cache", "models"):
        if key not in raw:
            raise ValueError(f"{name}: required key {key!r} is missing")
    if not raw["models"]:
        raise ValueError(f"{name}: no model is defined")
    models = []
    for model, entry in sorted(raw["models"].items()):
        for key in ("input_usd_per_mtok", "output_usd_per_mtok"):
            if key not in entry:
                raise ValueError(f"{name}: model {model!r} lacks {key!r}")
        floor = entry.get("min_cacheable_tokens")
        models.append((model, _micros(entry["input_usd_per_mtok"]), _micros(entry["output_usd_per_mtok"]), None if floor is None else int(floor)))
    cache = raw["cache"]
    multipliers = {
        "read": "read_multiplier", "write_5m": "write_multiplier_5m", "write_1h": "write_multiplier_1h", "unknown": "unknown_ttl_multiplier",
        "unknown_confidence": "unknown_ttl_confidence",
    }
    for key in multipliers.values():
        if key not in cache:
            raise ValueError(f"{name}: required key {key!r} is missing")
    parts = {part: str(cache[key]) if part == "unknown_confidence" else _micros(cache[key]) for part, key in multipliers.items()}
    return RateTable(models=tuple(models), cache=CacheMultipliers(**parts), origin=origin, priced_on=str(raw.get("priced_on", "unknown")))


def text_of(table: RateTable) -> str:
    """The TOML text of a table: what a refresh writes and ``table_of`` reads."""

    def usd(micros: int) -> str:
        return format(Decimal(micros) / 1_000_000, "f")

    c = table.cache
    lines = ["schema_version = 1", f'priced_on = "{table.priced_on}"', "", "[cache]", f"read_multiplier = {usd(c.read)}", f"write_multiplier_5m = {usd(c.write_5m)}"]
    lines += [f"write_multiplier_1h = {usd(c.write_1h)}", f"unknown_ttl_multiplier = {usd(c.unknown)}", f'unknown_ttl_confidence = "{c.unknown_confidence}"']
    for model, input_rate, output_rate, floor in table.models:
        lines += ["", f'[models."{model}"]', f"input_usd_per_mtok = {usd(input_rate)}", f"output_usd_per_mtok = {usd(output_rate)}"]
        lines += [] if floor is None else [f"min_cacheable_tokens = {floor}"]
    return "\n".join(lines) + "\n"


def load(spark: SparkSession, path: str, origin: str = EXPLICIT) -> RateTable:
    """A table from a file, which may lie wherever Spark can read."""
    return table_of(files.read_text(spark, path), path, origin)


def layers(spark: SparkSession, bundled: str, refreshed: str | None = None, explicit: str | None = None) -> list[RateTable]:
    """The tables that are there, the one to be used first. An explicit table that is not there is an error, a refreshed one is optional."""
    found = [load(spark, explicit, EXPLICIT)] if explicit is not None else []
    if refreshed is not None and files.exists(spark, refreshed):
        found.append(load(spark, refreshed, REFRESHED))
    return [*found, load(spark, bundled, BUNDLED)]


def layer_rows(spark: SparkSession, tables: list[RateTable]) -> DataFrame:
    """layer (from 0), origin, priced_on, model and its rates of every layer, and whether the row is in use: layers are never mixed."""
    rows = [(k, t.origin, t.priced_on, *m, k == 0) for k, t in enumerate(tables) for m in t.models]
    return spark.createDataFrame(rows, f"layer bigint, origin string, priced_on string, {RATE_SCHEMA}, in_use boolean")


def with_provenance(figures: DataFrame, table: RateTable) -> DataFrame:
    """Figures with the origin, date and fingerprint of the table that priced them."""
    return figures.withColumns({"origin": F.lit(table.origin), "priced_on": F.lit(table.priced_on), "rate_print": F.lit(table.fingerprint)})


def model_candidates(model):
    """Ids to look up in order: as given, trimmed, without vendor, without context, without date."""
    trimmed = F.trim(model)
    bare = trimmed
    for prefix in reversed(fixed.VENDOR_PREFIXES):
        bare = F.when(trimmed.startswith(prefix), F.substr(trimmed, F.lit(len(prefix) + 1))).otherwise(bare)
    plain = bare
    for end in reversed(fixed.CONTEXT_SUFFIXES):
        plain = F.when(
            bare.endswith(end), F.substr(bare, F.lit(1), F.length(bare) - len(end))
        ).otherwise(plain)
    undated = F.regexp_replace(plain, r"-\d{8}$", "")
    return F.filter(F.array_distinct(F.array(model, trimmed, bare, plain, undated)), lambda c: c != "")


def resolve_models(models: DataFrame, rates: DataFrame) -> DataFrame:
    """model -> first candidate the rate table knows (NULL when none is)."""
    tried = models.select("model", F.posexplode(model_candidates(F.col("model"))).alias("at", "candidate"))
    known = tried.join(
        rates.select(F.col("model").alias("candidate"), F.lit(True).alias("known")), "candidate", "left"
    )
    return known.groupBy("model").agg(
        F.min_by("candidate", F.when(F.col("known"), F.col("at"))).alias("priced_model")
    )
