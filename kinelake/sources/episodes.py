"""Sources: episode documents, metadata, statistics, media paths and result files, all read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import write_metadata

EPISODE_DDL = """num_frames INT, instructions ARRAY<STRING>,
observations MAP<STRING, STRUCT<type: STRING, rgb_path: STRING, depth_path: STRING, start: INT, `end`: INT, fps: DOUBLE>>,
proprios MAP<STRING, ARRAY<ARRAY<DOUBLE>>>, actions MAP<STRING, ARRAY<ARRAY<DOUBLE>>>"""
RESULT_DDL = "MAP<STRING, STRUCT<num_success_rollouts: INT, num_rollouts: INT, success_rate: DOUBLE>>"
PEEK = 8192


def episode_key(path: Column) -> Column:
    """Path below data/, without its suffix."""
    return F.regexp_extract(path, r"data/(.*)\.json$", 1)


def metadata_key(relative: Column) -> Column:
    """Relative path without its first data part and without its suffix (several sub-datasets under one root)."""
    return F.regexp_replace(F.regexp_replace(relative, r"^((?:(?!data/)[^/]+/)*)data/", "$1"), r"\.json$", "")


def glob_pattern(glob: str) -> str:
    """Regular expression of a path with stars, each of which stays inside one part."""
    return "".join("[^/]*" if c == "*" else c if c.isalnum() or c in "/_-" else f"\\x{{{ord(c):X}}}" for c in glob)


class EpisodeSource:
    """Episodes under a root folder. Subclasses change the file patterns or the key. ``documents`` (path, value) stands
    for the files where these come from elsewhere, for instance from an archive that was read already."""

    file_pattern = "episode_*.json"

    def __init__(self, spark: SparkSession, root: str, strict: bool = True, documents: DataFrame | None = None):
        self.spark, self.root, self.strict, self.documents = spark, root.rstrip("/"), strict, documents

    def folders(self) -> list[str]:
        return [f"{self.root}/data/chunk-*"]

    def key(self, path: Column) -> Column:
        return episode_key(path)

    def _text(self) -> DataFrame:
        """(episode, path, value) of the files that the patterns name."""
        if self.documents is not None:
            wanted = "|".join(glob_pattern(f"{f}/{self.file_pattern}") for f in self.folders())
            rows = self.documents.filter(F.col("path").rlike(f"^(?:{wanted})$"))
            return rows.select(self.key(F.col("path")).alias("episode"), "path", "value")
        rows = self.spark.read.option("pathGlobFilter", self.file_pattern).text(self.folders(), wholetext=True)
        return rows.select(self.key(F.col("_metadata.file_path")).alias("episode"), F.col("_metadata.file_path").alias("path"), "value")

    def episodes(self) -> DataFrame:
        """One row for each document, explicit schema. Strict: a broken document is an error; else it is left out."""
        if self.strict and self.documents is None:
            rows = self.spark.read.schema(EPISODE_DDL).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", self.file_pattern).json(self.folders())
            return rows.withColumn("episode", self.key(F.col("_metadata.file_path")))
        if self.strict:
            return self._text().select("episode", F.from_json("value", EPISODE_DDL, {"mode": "FAILFAST"}).alias("d")).select("d.*", "episode")
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        parsed = self._text().select("episode", F.from_json("value", EPISODE_DDL + ", _corrupt STRING", options).alias("d"))
        return parsed.filter("d._corrupt is null").select("d.*", "episode").drop("_corrupt")

    def parts(self) -> DataFrame:
        """One row for each document with every proprio and action as its JSON text, since these differ in depth. Strict: a
        broken document is an error; else it is left out."""
        kind = EPISODE_DDL.replace("ARRAY<ARRAY<DOUBLE>>", "STRING")
        if self.strict:
            return self._text().select("episode", F.from_json("value", kind, {"mode": "FAILFAST"}).alias("d")).select("episode", "d.*")
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        parsed = self._text().select("episode", F.from_json("value", kind + ", _corrupt STRING", options).alias("d"))
        return parsed.filter("d._corrupt is null").select("episode", "d.*").drop("_corrupt")

    def frame_counts(self) -> DataFrame:
        """(episode, num_frames) from the head of each document, else from all of it; none is an error (strict) or left out."""
        head = F.regexp_extract(F.substring("value", 1, PEEK), r'"num_frames"\s*:\s*(\d+)', 1)
        n = F.coalesce(F.expr("try_cast(nullif(_h, '') as int)"), F.expr("try_cast(get_json_object(value, '$.num_frames') as int)"))
        rows = self._text().withColumn("_h", head).withColumn("num_frames", n)
        if self.strict:
            rows = rows.withColumn("num_frames", F.coalesce("num_frames", F.raise_error(F.concat(F.lit("no num_frames in "), F.col("path"))).cast("int")))
        return rows.filter("num_frames is not null").select("episode", "num_frames")

    def metadata(self, path: str | None = None) -> DataFrame:
        """(episode, num_frames) of the metadata file. Where the file is missing it is built from the documents and
        written first; without a path it is built only."""
        if not path:
            return self.frame_counts()
        if not exists(self.spark, path):
            write_metadata(self.frame_counts(), path)
        whole = self.spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("episode", "num_frames"))

    def payloads(self, keys: DataFrame) -> DataFrame:
        """Documents of the wanted keys; a key without a document is an error (strict) or left out."""
        wanted = keys.select(F.col("episode").alias("_wanted")).distinct()
        if not self.strict:
            return self.episodes().join(wanted, F.col("episode") == F.col("_wanted"), "left_semi")
        found = wanted.join(self.episodes(), F.col("episode") == F.col("_wanted"), "left")
        missing = F.raise_error(F.concat(F.lit("no document of episode "), F.col("_wanted")))
        return found.withColumn("episode", F.coalesce("episode", missing)).drop("_wanted")


class StatisticsSource(EpisodeSource):
    """Episodes of the statistics job: any .json, also of several sub-datasets. ``nested`` says which layout the root has;
    None finds out: sub-datasets are taken where the root has no data folder of its own."""

    file_pattern = "*.json"

    def __init__(self, spark: SparkSession, root: str, nested: bool | None = None, documents: DataFrame | None = None):
        super().__init__(spark, root, strict=False, documents=documents)
        if nested is None:
            own = f"{self.root}/data/"
            nested = documents.filter(F.col("path").startswith(own)).isEmpty() if documents is not None else not exists(spark, own)
        self.nested = nested

    def folders(self) -> list[str]:
        return [f"{self.root}/*/data/chunk-*"] if self.nested else super().folders()

    def key(self, path: Column) -> Column:
        if not self.nested:
            return super().key(path)
        return metadata_key(F.regexp_replace(path, f"^.*?{glob_pattern(self.root.split('://')[-1])}/", ""))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def check_folders(spark: SparkSession, root: str, names: tuple[str, ...] = ("data", "video", "depth")) -> None:
    """The root and its folders must be there."""
    for path in (root, *(f"{root.rstrip('/')}/{n}" for n in names)):
        if not exists(spark, path):
            raise FileNotFoundError(f"missing folder {path}")


def check_parameters(sequence_length: int, frame_skip: int, action_skip: int = 1, size: tuple[int, int] | None = None) -> None:
    """Parameters of clips: more than one frame, positive skips, as many actions for every frame, a positive size."""
    if sequence_length <= 1:
        raise ValueError("sequence_length must be over 1")
    if frame_skip <= 0 or action_skip <= 0:
        raise ValueError("frame_skip and action_skip must be positive")
    if frame_skip % action_skip:
        raise ValueError("frame_skip must be a multiple of action_skip")
    if size is not None and min(size) <= 0:
        raise ValueError("the size must be positive")


def media_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def missing_media(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths that the listing (a binaryFile scan, path column only) does not have."""
    return wanted.join(listing.select(F.regexp_replace("path", "^file:(//)?", "").alias("path")), "path", "left_anti")


def statistics_rows(block: DataFrame, q01: str = "q01", q99: str = "q99") -> DataFrame:
    """(key, axis, q01, q99) of two map columns; a key or an axis in one of them alone is an error."""
    low = block.select(F.explode(q01).alias("key", "v")).select("key", F.posexplode("v").alias("axis", "q01"))
    high = block.select(F.explode(q99).alias("key", "v")).select("key", F.posexplode("v").alias("axis", "q99"))
    both = low.join(high, ["key", "axis"], "full")
    broken = F.col("q01").isNull() | F.col("q99").isNull()
    return both.withColumn("q01", F.when(broken, F.raise_error(F.concat(F.lit("statistics differ in "), F.col("key"))).cast("double")).otherwise(F.col("q01")))


def view_problems(views: DataFrame) -> DataFrame:
    """Rows of (episode, camera, type, fps, end, last_frame) with the reason that makes each unusable, or NULL."""
    from pyspark.sql import Window

    spread = F.max("fps").over(Window.partitionBy("episode")) - F.min("fps").over(Window.partitionBy("episode"))
    reason = F.when(~F.col("type").isin("static", "dynamic") | F.col("type").isNull(), "camera type").when(F.col("last_frame") >= F.col("end"), "frame past the end").when(spread > 1e-6, "frame rates differ")
    return views.withColumn("reason", reason)


def effective_fps(fps: Column, frame_skip: int) -> Column:
    """Frame rate of every frame_skip-th frame."""
    return fps / frame_skip


def camera_code(kind: Column) -> Column:
    return F.when(kind == "static", 0).when(kind == "dynamic", 1).otherwise(F.raise_error(F.concat(F.lit("camera type "), kind)).cast("int"))


def sorted_views(observations: Column) -> Column:
    """Views of an episode by camera name."""
    return F.array_sort(F.map_entries(observations))


def parsed_results(documents: DataFrame) -> DataFrame:
    """(task, num_success_rollouts, num_rollouts, success_rate) of result documents (column ``value``)."""
    return documents.select(F.explode(F.from_json("value", RESULT_DDL)).alias("task", "r")).select("task", "r.*")


def rank_results(spark: SparkSession, folder: str, pattern: str = "eval_results_*.json", below: bool = False) -> DataFrame:
    """Results of all ranks, in the folder or also below it."""
    return parsed_results(spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", below).text(folder, wholetext=True))


def text_results(spark: SparkSession, folder: str) -> DataFrame:
    """(task, success_rate): last line of each <task>/_result.txt. Spark's readers skip names with a leading underscore,
    so these small files, one for each task, are read through the file system that the path names."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_result.txt")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for status in files.globStatus(pattern) or []:
        stream = files.open(status.getPath())
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        rows.append((status.getPath().getParent().getName(), float(text.strip().splitlines()[-1])))
    return spark.createDataFrame(rows, "task string, success_rate double")


def video_names(spark: SparkSession, folder: str) -> DataFrame:
    """(task, name) of the rollout videos; their content is not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(f"{folder}/*").select("path")
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("task"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def result_layout(spark: SparkSession, folder: str) -> str:
    """A: result files by rank; B: result texts by task; A for an empty folder."""

    def some(load) -> bool:
        try:
            return bool(load().limit(1).count())
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                return False
            raise

    if some(lambda: rank_results(spark, folder)):
        return "A"
    return "B" if some(lambda: text_results(spark, folder)) else "A"
