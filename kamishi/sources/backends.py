"""Where observations come from: functions from images (page_id, name, ...) to observations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import ctc

FIELDS = ["text", "x", "y", "width", "height", "confidence"]


#: Observations that a constant backend may hold; they become part of the plan.
MAX_CONSTANT = 1000


def constant(observations: DataFrame):
    """Every image gives the same observations (obs_id, text, x, ...), a small fixed set."""
    held = observations.select("obs_id", *FIELDS).limit(MAX_CONSTANT + 1).collect()
    if len(held) > MAX_CONSTANT:
        raise ValueError(f"a constant backend holds at most {MAX_CONSTANT} observations")

    def recognize(images: DataFrame) -> DataFrame:
        kind = observations.select("obs_id", *FIELDS).schema
        rows = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kind.fields, row, strict=True)]) for row in held])
        return images.select("page_id", F.inline(rows.cast(T.ArrayType(kind))))

    return recognize


#: Suffixes of images, in any case.
SUFFIXES = ("png", "jpg", "jpeg", "bmp", "webp")


def image_files(spark: SparkSession, folder: str, suffixes=SUFFIXES) -> DataFrame:
    """page_id (of the path), name, length, content of the images in a folder and all folders below it, by
    suffix in any case. A folder without an image is an error."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no images ({', '.join(suffixes)}) under {folder}")
    return files.select(F.xxhash64("path").alias("page_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


REGIONS = "obs_id int, x double, y double, width double, height double, logits array<array<double>>"


def by_model(load: Callable, decode: Callable[[Column], Column], kind: str = REGIONS):
    """A recognizer in three steps: a model finds the regions of each image and reads them to logits,
    decode turns those into text and confidence, regions without text drop out.

    load() runs once in every task and gives the model: a function from an Arrow batch of images to, for
    each image, a list of regions (dicts of obs_id, x, y, width, height, logits).
    """
    shape = T._parse_datatype_string(kind)

    def recognize(images: DataFrame) -> DataFrame:
        out = T.StructType([images.schema["page_id"], T.StructField("regions", T.ArrayType(shape))])

        def run(batches):
            model = None
            for batch in batches:
                model = model or load()
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(model(batch), to_arrow_type(out["regions"].dataType))], ["page_id", "regions"])

        regions = images.mapInArrow(run, out).select("page_id", F.inline("regions")).withColumn("_read", decode(F.col("logits")))
        return regions.select("page_id", "obs_id", F.col("_read.text").alias("text"), "x", "y", "width", "height", F.col("_read.confidence").alias("confidence")).where("text <> ''")

    return recognize


def failing(message: str):
    """Reading the result raises."""

    def recognize(images: DataFrame) -> DataFrame:
        return images.select("page_id", F.raise_error(F.lit(message)).cast("int").alias("obs_id"), *[F.lit(None).cast("string" if f == "text" else "double").alias(f) for f in FIELDS])

    return recognize


def by_name(named: DataFrame):
    """Observations (name, obs_id, ...) joined by the image's name; unknown names give none."""

    def recognize(images: DataFrame) -> DataFrame:
        return images.select("page_id", "name").join(named, "name").select("page_id", "obs_id", *FIELDS)

    return recognize


def top_candidates(candidates: DataFrame) -> DataFrame:
    """The first candidate (rank 0) of each region; regions without text drop out."""
    return candidates.where((F.col("rank") == 0) & F.col("text").isNotNull() & (F.col("text") != "")).drop("rank")


def from_normalized(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> dict[str, Column]:
    """Pixel box with top-left origin of a unit box with bottom-left origin."""
    return {"x": x * image_width, "y": (1 - y - height) * image_height, "width": width * image_width, "height": height * image_height}


def padded_region(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column, padding: float = 0.05) -> dict[str, Column]:
    """Box padded by a share of its size on each side, within the image."""
    left, top = F.greatest(x - width * padding, F.lit(0.0)), F.greatest(y - height * padding, F.lit(0.0))
    return {"x": left, "y": top, "width": F.least(image_width - left, width * (1 + 2 * padding)), "height": F.least(image_height - top, height * (1 + 2 * padding))}


def rotation(region: Column, mode: str = "counterclockwise") -> Column:
    """How to turn a crop whose region is 'vertical'."""
    return F.when(region == "vertical", mode).otherwise("none")


VOCABULARY = T.StructType([T.StructField("blankIndex", T.IntegerType()), T.StructField("vocabulary", T.ArrayType(T.StringType()))])


def check_vocabulary(df: DataFrame) -> DataFrame:
    """An empty vocabulary or a blank outside it is an error when the rows are read."""
    bad = F.when(F.col("vocabulary").isNull() | (F.size("vocabulary") == 0), "empty vocabulary").when((F.col("blankIndex") < 0) | (F.col("blankIndex") >= F.size("vocabulary")), "blank index out of range")
    ok = F.when(bad.isNull(), F.col("vocabulary")).otherwise(F.raise_error(F.coalesce(bad, F.lit(""))))
    return df.select(F.coalesce("blankIndex", F.lit(0)).alias("blankIndex"), ok.alias("vocabulary")).withColumn("count", F.size("vocabulary"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """blankIndex, vocabulary, count of a JSON sidecar; malformed JSON is an error."""
    return check_vocabulary(spark.read.schema(VOCABULARY).option("multiLine", True).option("mode", "FAILFAST").json(path))


@dataclass(frozen=True)
class Decoder:
    """Greedy decoding with a vocabulary that is part of the plan."""

    vocabulary: tuple[str, ...]
    blank: int

    def _words(self) -> Column:
        return F.array(*[F.lit(w) for w in self.vocabulary])

    def indices(self, indices: Column) -> Column:
        return ctc.decode_indices(indices, self._words(), self.blank)

    def logits(self, logits: Column) -> Column:
        return ctc.decode_logits(logits, self._words(), self.blank)


def read_decoder(spark: SparkSession, path: str) -> Decoder:
    """The decoder of a JSON sidecar; a vocabulary is a model's classes, so it is bounded."""
    row = read_vocabulary(spark, path).first()
    return Decoder(tuple(row.vocabulary), row.blankIndex)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """vocabulary of a JSON array or of a text with one entry per line; blank lines count."""
    text = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\n\z", ""), "\n")
    listed = F.from_json("value", "array<string>")
    return text.select(F.when(F.ltrim("value").startswith("["), listed).otherwise(lines).alias("vocabulary"))
