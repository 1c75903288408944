"""Readers of manifests, transcripts and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravand.functions.text import strip

REQUIRED = ("audio_path", "text")
AUDIO = ("wav", "mp3", "flac", "m4a", "ogg")
TRANSCRIPTS = ("txt", "json", "srt")


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """`df`, or an error that names what is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with a header: tab for .tsv and .tab, comma for .csv unless its header holds tabs only; all strings."""
    name = path.lower().rstrip("/")
    if not name.endswith((".tsv", ".tab", ".csv")):
        raise ValueError(f"no manifest: {path}")
    sep = "\t"
    if name.endswith(".csv"):
        header = spark.read.text(path).first()
        sep = "\t" if header and "\t" in header[0] and "," not in header[0] else ","
    return require_columns(spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(path))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object on a line; blank lines are skipped."""
    fields = "audio_path string, text string, speaker_id string, dataset string, split string, uid string"
    return spark.read.schema(fields).json(path).where("not (audio_path is null and text is null)")


def first_existing(spark: SparkSession, root: str, names: str | tuple[str, ...] | None) -> str | None:
    """The first of `names` that is a file under `root`, on any file system Spark reads; None if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in (names,) if isinstance(names, str) else names or ():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(conf).exists(path):
            return name
    return None


def read_voice_corpus(spark: SparkSession, root: str, train: str | tuple[str, ...], dev: str | tuple[str, ...] | None = None) -> DataFrame:
    """A train table and, if there is one, a dev table of `path` and `sentence`, under `root`.

    Where several names are given, the first file that exists is read; no train file is an error.
    """
    out = None
    for split, names in (("train", train), ("validation", dev)):
        file = first_existing(spark, root, names)
        if file:
            part = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(f"{root}/{file}")
            require_columns(part, ("path", "sentence"))
            part = part.select(F.concat_ws("/", F.lit(root), "path").alias("audio_path"), F.col("sentence").alias("text"), F.lit(split).alias("split"))
            out = part if out is None else out.unionByName(part)
        elif split == "train":
            raise FileNotFoundError(f"none of {names} under {root}")
    return out


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, stem, extension, length) of the files under `root` with one of the extensions, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))
    return files.where(F.col("extension").isin(*extensions)).select("path", "stem", "extension", "length")


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(path, stem, text) of transcript files: of a JSON object its text, else transcript, else caption; other files whole."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("v"))
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("extension").isin(*TRANSCRIPTS))
    keys = F.when(F.col("extension") == "json", F.json_object_keys("v"))
    text = F.col("v")
    for name in ("caption", "transcript", "text"):
        text = F.when(F.array_contains(keys, name), F.get_json_object("v", f"$.{name}")).otherwise(text)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"), strip(text).alias("text"))


def load_transcript(spark: SparkSession, root: str, name: str, cleaned: bool = False) -> DataFrame:
    """(path, text) of one transcript, whole; the cleaned one if asked for (S14). A missing file is an error."""
    file = f"{name}_cleaned.txt" if cleaned else f"{name}.txt"
    if first_existing(spark, root, file) is None:
        raise FileNotFoundError(f"{root}/{file}")
    return spark.read.text(f"{root}/{file}", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
