"""Source trees: listing, filtering by path and reading files.

The listing runs where the tree is (symbolic links can only be told from files
there) and is small beside the texts; the texts are read by the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.languages import Registry
from skein.schema import FILES
from skein.workspace import ship

# fixed values: what a scan leaves out, and how many files it takes
EXCLUDED_DIRS = ("node_modules", "dist", ".git", "output", "coverage")
EXCLUDED_SUFFIX = ".d.ts"
MAX_FILES = 10_000


def extension_of(path: Column) -> Column:
    """The last dot and what follows, '' for names without one or that start with it."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"[^.](\.[^.]*)$", 1)


def is_scanned(relpath: Column, registry: Registry | None = None) -> Column:
    """Whether a scan of the tree would take this path."""
    dirs = "|".join(x.replace(".", r"\.") for x in EXCLUDED_DIRS)
    return (
        ~relpath.rlike(rf"(^|/)({dirs})/")
        & ~relpath.endswith(EXCLUDED_SUFFIX)
        & extension_of(relpath).isin(*(registry or Registry()).extensions())
    )


def registry_frame(spark: SparkSession, registry: Registry | None = None) -> DataFrame:
    """The registry as a small table (ext, lang)."""
    r = registry or Registry()
    return spark.createDataFrame([(e, r.language_of(e)) for e in r.extensions()], "ext string, lang string")


def walk(root: str, max_files: int = MAX_FILES, registry: Registry | None = None) -> list[str]:
    """Absolute paths below ``root`` in depth-first order of sorted names; links
    and what cannot be read are skipped, and so are the excluded directories
    below the root."""
    extensions = set((registry or Registry()).extensions())

    def below(folder: str) -> Iterator[str]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            try:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if e.name not in EXCLUDED_DIRS:
                        yield from below(e.path)
                elif e.is_file(follow_symlinks=False) and not e.name.endswith(EXCLUDED_SUFFIX):
                    if os.path.splitext(e.name)[1] in extensions:
                        yield e.path
            except OSError:
                continue

    out: list[str] = []
    for path in below(os.path.abspath(root)):
        if len(out) >= max_files:
            break
        out.append(path)
    return out


def read_files(spark: SparkSession, root: str, project: str = "", max_files: int = MAX_FILES, registry: Registry | None = None) -> DataFrame:
    """The scanned files of a tree as (seq, project, relpath, ext, lang, content);
    content is null where a file cannot be read."""
    r = registry or Registry()
    base = os.path.abspath(root)
    listed = []
    for seq, path in enumerate(walk(root, max_files, r)):
        ext = os.path.splitext(path)[1]
        listed.append((seq, project, os.path.relpath(path, base).replace(os.sep, "/"), ext, r.language_of(ext), path))
    frame = spark.createDataFrame(listed, "seq bigint, project string, relpath string, ext string, lang string, path string")

    def load(batches):
        for batch in batches:
            texts = []
            for path in batch["path"]:
                try:
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        texts.append(f.read())
                except OSError:
                    texts.append(None)
            yield batch.assign(content=texts)[FILES.names]

    ship(spark)
    return frame.repartition(max(1, min(len(listed), spark.sparkContext.defaultParallelism))).mapInPandas(load, FILES)
