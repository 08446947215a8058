"""Caches as Parquet tables keyed by a digest of the request, and the model connector that fills them."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def request_key(*fields: str) -> Column:
    """sha256 of the JSON of the fields in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def answer_key(qid: Column) -> Column:
    """A file-safe name of a question."""
    return F.regexp_replace(qid, "[^A-Za-z0-9_.-]+", "_")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def offline_client(prompts: list[str]) -> list[str | None]:
    """Stands in for a model: answers nothing."""
    return [None] * len(prompts)


def complete(requests: DataFrame, client: Callable[[list[str]], list[str | None]] = offline_client) -> DataFrame:
    """(key, prompt) through a client, a batch at a time; failures are left out, so a cache holds successes only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(answer=client(list(f["prompt"])))[["key", "answer"]].dropna()

    return requests.select("key", "prompt").mapInPandas(run, "key string, answer string")


#: Columns of a cache, and the folders of its runs and commits.
CACHE, RUNS, COMMITS = "key string, answer string", "runs", "commits"
#: Seconds to wait for a commit that another run is writing.
PATIENCE = 30


class Cache:
    """Answers by key in a folder that several runs may fill at once, each key once.

    A run writes its rows to a folder of its own, which nobody reads, and becomes visible by a
    commit: the next number under ``commits``, a file that is made only if it isn't there yet and
    names the folder. Where another run took the number, the run leaves out the keys that became
    visible meanwhile and tries the next one. So an interrupted run shows nothing, and one that is
    repeated under its id changes nothing once it has been committed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _claims(self) -> dict[int, str]:
        """The folder of each commit; '' of one whose run is just writing it."""
        path, fs = self._at(COMMITS)
        if not fs.exists(path):
            return {}
        out = {}
        for f in fs.listStatus(path):
            if f.getPath().getName().isdigit():
                stream = fs.open(f.getPath())
                out[int(f.getPath().getName())] = bytes(stream.readAllBytes()).decode()
                stream.close()
        return dict(sorted(out.items()))

    def commits(self) -> list[str]:
        """The folders of the committed runs, in order."""
        return [folder for folder in self._claims().values() if folder]

    def _settled(self) -> dict[int, str]:
        """The commits, once none is being written. Raises where a run died while it wrote one."""
        for _ in range(10 * PATIENCE):
            claims = self._claims()
            if all(claims.values()):
                return claims
            time.sleep(0.1)
        raise TimeoutError(f"a run ended while it wrote its commit; remove the empty file in {self.path}/{COMMITS}")

    def _take(self, number: int, folder: str) -> bool:
        """Make the commit of this number; false where there is one."""
        path, fs = self._at(COMMITS, f"{number:09}")
        try:
            if fs.getScheme() == "file":  # Hadoop's local create looks before it makes, which is no lock
                fs.mkdirs(path.getParent())
                self.spark._jvm.java.nio.file.Files.createFile(self.spark._jvm.java.io.File(path.toUri().getPath()).toPath(), self.spark._sc._gateway.new_array(self.spark._jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                fs.create(path, False).close()
        except Py4JJavaError:
            if fs.exists(path):
                return False
            raise
        out = fs.create(path, True)
        out.write(bytearray(folder.encode()))
        out.close()
        return True

    def read(self, folders: list[str] | None = None) -> DataFrame:
        """The rows of the committed runs (or of these folders)."""
        names = self.commits() if folders is None else folders
        return self.spark.read.schema(CACHE).parquet(*(f"{self.path}/{RUNS}/{n}" for n in names)) if names else self.spark.createDataFrame([], CACHE)

    def add(self, rows: DataFrame, run_id: str, known: list[str]) -> None:
        """Commit ``rows`` (key, answer), made while the runs ``known`` were visible, under ``run_id``."""
        for tries in itertools.count():
            claims = self._settled()
            if any(c.rsplit(".", 1)[0] == run_id for c in claims.values()):
                return
            folder, others = f"{run_id}.{tries}", [c for c in claims.values() if c not in known]
            fresh = rows.join(self.read(others).select("key"), "key", "left_anti") if others else rows
            fresh.select("key", "answer").dropDuplicates(["key"]).write.mode("overwrite").parquet(f"{self.path}/{RUNS}/{folder}")
            if self._take(max(claims, default=-1) + 1, folder):
                return
            rows, known = self.spark.read.schema(CACHE).parquet(f"{self.path}/{RUNS}/{folder}"), known + others


def resume(requests: DataFrame, path: str, client: Callable[[list[str]], list[str | None]] = offline_client, run_id: str | None = None) -> DataFrame:
    """Answers of all requests (key, prompt) that have one: from the cache, and new ones committed to it under ``run_id``.

    Nulls: a request without key has no answer. Repeated requests are asked once and answered as
    often as they occur. Requests that fail are asked again by the next run.
    """
    store = Cache(requests.sparkSession, path)
    known = store.commits()
    store.add(complete(misses(requests, store.read(known)), client), run_id or uuid.uuid4().hex, known)
    return requests.join(store.read(), "key")


def stamped(df: DataFrame, run_id: str, built_at: str) -> DataFrame:
    """Rows with build_meta."""
    return df.withColumn("build_meta", F.struct(F.lit(run_id).alias("run_id"), F.lit(built_at).alias("built_at")))
