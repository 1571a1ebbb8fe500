"""A repository's files as rows: directories that are skipped are never listed file by file, and what is left out is counted in the pass that reads the rest.

Files whose names begin with a dot or an underscore are hidden from Spark's readers; they are counted as such."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import changes

# Fixed values of repository scans.
SKIPPED_DIRS = ".git .hg .svn .next .nuxt .output .turbo .cache .venv venv node_modules dist build out coverage target vendor __pycache__".split()
SKIPPED_FILES = "package-lock.json yarn.lock pnpm-lock.yaml bun.lock bun.lockb uv.lock Cargo.lock composer.lock poetry.lock go.sum Pipfile.lock".split()
SKIPPED_SUFFIXES = ".exe .dll .so .dylib .bin .o .a .pyc .pyo .wasm .png .jpg .jpeg .gif .webp .ico .svg .woff .woff2 .ttf .eot .pdf .zip .tar .gz .tgz .7z .mp4 .mp3 .webm .sqlite .db .min.js .min.css .map .lock".split()
#: Directories (and empty files) that are listed at most, so that a tree that is not a repository ends with an error instead of a full driver.
MAX_DIRS = 1_000_000
#: Bytes of a file that is read as text; larger ones are counted as skipped.
MAX_BYTES = 1_000_000


def skip_reason(path: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """Why a file of a listed directory is not read, or null."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    ends = F.filter(F.array(*map(F.lit, SKIPPED_SUFFIXES)), lambda s: F.endswith(F.lower(name), s))
    # of several endings the longest names the reason
    longest = F.array_max(F.transform(ends, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    return F.when(name.isin(SKIPPED_FILES), F.concat(F.lit("file:"), name)).when(longest.isNotNull(), F.concat(F.lit("suffix:"), longest)).when(size > most, F.lit("size"))


@dataclass
class Scan:
    """files (path, length, text, language) and, once an action over files has ended, what was left out."""

    files: DataFrame
    _observed: Observation
    _left_out: dict[str, int]

    def skipped(self) -> dict[str, int]:
        """Skipped files by reason: those below skipped directories were counted by the file system, the others by the pass itself."""
        counts = self._observed.get
        own = {reason: n for reason, n in zip(_REASONS, (counts[f"r{k}"] for k in range(len(_REASONS)))) if n}
        return own | {reason: n for reason, n in self._left_out.items() if n}

    def included(self) -> int:
        return self._observed.get["included"]


_REASONS = [*(f"file:{n}" for n in SKIPPED_FILES), *(f"suffix:{s}" for s in SKIPPED_SUFFIXES), "size"]


def _listed(spark: SparkSession, root: str) -> tuple[list[str], dict[str, int], list[str]]:
    """The directories that are read, how many files are left out with them, and the files without bytes. Links are not followed."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dirs, skipped, empty, todo = [], {"hidden": 0}, [], [fs.getFileStatus(top).getPath()]
    while todo:
        at = todo.pop()
        found = fs.listStatus(at)
        inner = [s for s in found if s.isDirectory() and not s.isSymlink()]
        shown = [s for s in found if s.isFile() and s.getPath().getName()[0] not in "._"]
        skipped["hidden"] += sum(s.isFile() for s in found) - len(shown)
        empty += [s.getPath().toString() for s in shown if s.getLen() == 0]
        dirs.append(at.toString())
        if len(dirs) + len(empty) > MAX_DIRS:
            raise ValueError(f"more than {MAX_DIRS} directories and empty files")
        for status in inner:
            name = status.getPath().getName()
            if name in SKIPPED_DIRS:
                skipped[f"dir:{name}"] = skipped.get(f"dir:{name}", 0) + fs.getContentSummary(status.getPath()).getFileCount()
            else:
                todo.append(status.getPath())
    return sorted(dirs), skipped, empty


def scan(spark: SparkSession, root: str, most: int = MAX_BYTES) -> Scan:
    """All files of a tree but those that a scan skips; bytes that are no UTF-8 are replaced. An empty tree has no rows."""
    dirs, skipped, empty = _listed(spark, root)
    top = dirs[0].rstrip("/")  # the least in order is the root itself
    rows = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    rows = rows.option("ignoreMissingFiles", True).load([_plain(d) for d in dirs]).select("path", "length", "content")
    # Spark's readers leave out files without bytes
    rows = rows.union(spark.createDataFrame([(e, 0, b"") for e in empty], rows.schema))
    relative = F.substring(F.col("path"), F.lit(_start(top)), F.length("path"))
    told = rows.select(relative.alias("path"), "length", "content").withColumn("reason", skip_reason(F.col("path"), F.col("length"), most))
    observed = Observation()
    told = told.observe(observed, F.count_if(F.col("reason").isNull()).alias("included"), *[F.count_if(F.col("reason") == r).alias(f"r{k}") for k, r in enumerate(_REASONS)])
    files = told.filter("reason is null").select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), changes.language_of(F.col("path")).alias("language"))
    return Scan(files, observed, skipped)


def _plain(path: str) -> str:
    """A directory's name with the characters of patterns escaped."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def _start(top: str) -> int:
    return len(top) + 2
