"""Sources: message streams and their routes, images, external readers' replies, options."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.text import extract_key, is_image, media_type, strip

MESSAGE = (
    "message_id long, channel_id long, author_is_bot boolean, user_name string, text string, mentions_bot boolean, event_ts timestamp, "
    "attachments array<struct<name: string, mime: string, url: string>>, message_url string"
)
REPLY = (
    "current_wounded long, capacity_wounded long, current_ram_zone long, capacity_ram_zone long, food long, wood long, stone long, gold long, values_were_abbreviated boolean, notes string, "
    "rows array<struct<name: string, name_readable: boolean, count: long, section: string>>"
)
MAX_IMAGE_BYTES = 5 << 20


@dataclass(frozen=True)
class Channels:
    submissions: int = 1
    siege: int = 2
    log_test: int = 3


def messages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Messages as JSON lines, in batch or as a stream of files."""
    return (spark.readStream if stream else spark.read).schema(MESSAGE).json(path)


def route(df: DataFrame, channels: Channels = Channels()) -> DataFrame:
    """Adds route (report, submission, siege, test or NULL), gid, image and reject to messages that no bot wrote."""
    human = df.filter(~F.coalesce("author_is_bot", F.lit(False)))
    images = F.filter(F.coalesce("attachments", F.expr("cast(array() as array<struct<name: string, mime: string, url: string>>)")), lambda a: is_image(a["mime"], a["name"]))
    way = (
        F.when(F.coalesce("mentions_bot", F.lit(False)), "report")
        .when(F.col("channel_id") == channels.submissions, "submission")
        .when(F.col("channel_id") == channels.siege, "siege")
        .when(F.col("channel_id") == channels.log_test, "test")
    )
    out = human.withColumn("route", way).withColumn("_images", images).withColumn("gid", extract_key(F.coalesce("text", F.lit(""))))
    out = out.withColumn("gid", F.when(F.col("route") == "test", F.coalesce("gid", F.lit("test"))).otherwise(F.col("gid")))
    asked = F.col("route").isin("submission", "siege", "test")
    reject = F.when(asked & (F.size("_images") == 0), "no image").when(asked & (F.size("_images") > 1), "more than one image").when(asked & F.col("gid").isNull(), "no governor id")
    return out.withColumn("reject", reject).withColumn("image", F.when(asked & F.col("reject").isNull(), F.get("_images", F.lit(0)))).drop("_images")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, content, mime and too_large of image files; the content is not read where only the names are asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,webp,gif,PNG,JPG,JPEG,WEBP,GIF}").load(path)
    return files.select("path", "length", "content", media_type(F.col("content")).alias("mime"), (F.col("length") > MAX_IMAGE_BYTES).alias("too_large"))


def readings_from_replies(replies: DataFrame, key: str = "reading_id", reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(readings, rows) of external readers' JSON replies. Rows without a count are left out with a warning."""
    parsed = replies.select(key, F.from_json(reply, REPLY).alias("p")).filter("p IS NOT NULL")
    named = lambda r: F.coalesce(F.nullif(r["name"], F.lit("")), F.lit("unnamed"))
    skipped = F.transform(F.filter(F.coalesce("p.rows", F.expr("cast(array() as array<struct<name: string, name_readable: boolean, count: bigint, section: string>>)")), lambda r: r["count"].isNull()), lambda r: F.concat(F.lit("Row '"), named(r), F.lit("' had no readable count and was skipped.")))
    notes = strip(F.coalesce("p.notes", F.lit("")))
    readings = parsed.select(
        key,
        F.col("p.current_wounded").alias("wounded_current"), F.col("p.capacity_wounded").alias("wounded_capacity"), F.col("p.current_ram_zone").alias("ram_current"), F.col("p.capacity_ram_zone").alias("ram_capacity"),
        *[F.col(f"p.{c}") for c in ("food", "wood", "stone", "gold")],
        F.coalesce("p.values_were_abbreviated", F.lit(False)).alias("rss_approx"), F.lit("external").alias("source"),
        F.concat(skipped, F.when(notes != "", F.array(notes)).otherwise(F.array().cast("array<string>"))).alias("warnings"),
    )
    each = parsed.select(key, F.posexplode("p.rows").alias("pos", "r")).filter("r.count IS NOT NULL")
    rows = each.select(
        key, "pos", strip(F.coalesce("r.name", F.lit(""))).alias("raw_name"), F.col("r.count").alias("count"),
        (F.coalesce("r.name_readable", F.lit(False)) & (strip(F.coalesce("r.name", F.lit(""))) != "")).alias("name_visible"),
        (F.lower(strip(F.coalesce("r.section", F.lit("")))) == "ram_zone").alias("in_ram_zone"),
        F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("troop_type"),
    )
    return readings, rows


@dataclass(frozen=True)
class Options:
    """Settings from the environment; placeholders and blanks count as unset, and a number that is none is an error."""

    session_minutes: int = 30
    roster_minutes: int = 5
    workers: int = 2
    credentials: str = ""
    values: dict = field(default_factory=dict)

    @staticmethod
    def load(env: dict[str, str] | None = None, prefix: str = "TALLYMARK_") -> Options:
        env = dict(os.environ) if env is None else env

        def text(name: str, default: str = "") -> str:
            value = env.get(prefix + name, "").strip()
            return default if not value or value.lower().startswith(("your_", "your-", "changeme", "<")) else value

        def number(name: str, default: int) -> int:
            value = text(name)
            try:
                return int(value) if value else default
            except ValueError:
                raise ValueError(f"{prefix}{name} must be a whole number, got {value!r}") from None

        return Options(number("SESSION_MINUTES", 30), number("ROSTER_MINUTES", 5), number("WORKERS", 2), text("CREDENTIALS"), {k: v for k, v in env.items() if k.startswith(prefix)})


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels and BGR bytes of image files, by Spark's own image source."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def request_body(content: Column) -> Column:
    """The data URL of an image, as external readers take it."""
    return F.concat(F.lit("data:"), media_type(content), F.lit(";base64,"), F.base64(content))


def read_externally(images: DataFrame, reader: Callable[[bytes, str], str], key: str = "reading_id") -> DataFrame:
    """key, reply and error of an external reader over images (key, content, mime): too large an image, or a reader that
    raises, is an error of its row and never the job's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies, errors = [], []
            for content, mime in zip(f["content"], f["mime"]):
                reply, error = None, None
                if len(content) > MAX_IMAGE_BYTES:
                    error = "image too large"
                else:
                    try:
                        reply = reader(bytes(content), mime)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
            yield pd.DataFrame({key: f[key], "reply": replies, "error": errors})

    kind = dict(images.dtypes)[key]
    return images.select(key, "content", "mime").mapInPandas(run, f"{key} {kind}, reply string, error string")


def credentials(value: str) -> dict:
    """Credentials given as JSON or as the path of a JSON file; blank ones are none."""
    if not value.strip():
        return {}
    return json.loads(value if value.lstrip().startswith("{") else Path(value).read_text())
