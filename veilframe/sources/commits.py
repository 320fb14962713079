"""Writes that happen once per run: a log of commits beside the data, and readers that go by it.

A run (a job's name and date, a stream's batch) writes its rows into a folder of the attempt, which no reader looks
into, and then commits: one small file, named after the run, that says which attempt counts.  Making that file is
the only step that shows, and only the first to make it succeeds.  A run that is repeated finds its commit and writes nothing;
one that broke off, however far it came, left nothing to be seen and writes again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.session import remove_folder

#: Folders under a table's path; Spark's readers pass over names that begin with an underscore.
LOG, RUNS = "_commits", "_runs"
Writer = Callable[[DataFrame, str], None]


class CommitLog:
    """The commits of the table at ``path``, on any file system Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entry(self, run_id: str):
        # A run's id may hold any characters, a file's name may not.
        name = hashlib.sha256(run_id.encode()).hexdigest()[:32]
        return self._hadoop.Path(f"{self.path}/{LOG}/{name}.json")

    def committed(self, run_id: str) -> bool:
        return self._files.exists(self._entry(run_id))

    def attempt(self, run_id: str) -> str:
        """A fresh folder for the rows of one attempt."""
        name = hashlib.sha256(run_id.encode()).hexdigest()[:32]
        return f"{self.path}/{RUNS}/{name}/{uuid.uuid4().hex}"

    def commit(self, run_id: str, folder: str) -> bool:
        """Make ``folder`` the run's rows; False if the run has been committed before.

        The entry is written aside and renamed, so nobody reads half of it; a rename does not replace an entry.
        """
        target = self._entry(run_id)
        aside = self._hadoop.Path(f"{self.path}/{LOG}/_{uuid.uuid4().hex}")
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps({"run_id": run_id, "folder": folder.removeprefix(f"{self.path}/")}).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, target, no_options)
        except Exception:
            self._files.delete(aside, False)
            if self.committed(run_id):
                return False
            raise
        return True

    def entries(self) -> list[dict]:
        """The commits: run_id and folder.  The driver reads one line per run."""
        folder = self._hadoop.Path(f"{self.path}/{LOG}")
        if not self._files.exists(folder):
            return []
        rows = self.spark.read.schema("run_id string, folder string").json(f"{self.path}/{LOG}").collect()
        return [r.asDict() for r in rows]

    def folders(self) -> list[str]:
        return [f"{self.path}/{e['folder']}" for e in self.entries()]

    def clean(self) -> int:
        """Remove the folders of attempts that do not count; not while runs are writing.  Returns their number."""
        kept = set(self.folders())
        root = self._hadoop.Path(f"{self.path}/{RUNS}")
        if not self._files.exists(root):
            return 0
        gone = 0
        for run in self._files.listStatus(root):
            for attempt in self._files.listStatus(run.getPath()):
                name = f"{self.path}/{RUNS}/{run.getPath().getName()}/{attempt.getPath().getName()}"
                if name not in kept:
                    remove_folder(self.spark, name)
                    gone += 1
        return gone


def write_once(df: DataFrame, path: str, run_id: str, write: Writer) -> bool:
    """Write the rows of a run under ``path`` unless it has been committed; True if this call committed it.

    ``write(df, folder)`` writes the rows into a folder of its own.  Of two writers of one run the first to commit counts;
    the other's rows are removed.
    """
    log = CommitLog(df.sparkSession, path)
    if log.committed(run_id):
        return False
    folder = log.attempt(run_id)
    write(df, folder)
    if log.commit(run_id, folder):
        return True
    remove_folder(df.sparkSession, folder)
    return False


def read_committed(spark: SparkSession, path: str, schema, file_format: str = "parquet") -> DataFrame:
    """The rows of committed runs, and rows that were appended without a run."""
    reader = spark.read.schema(schema).format(file_format)
    log = CommitLog(spark, path)
    files = log._files
    root = log._hadoop.Path(log.path)
    plain = files.exists(root) and any(not s.getPath().getName().startswith(("_", ".")) for s in files.listStatus(root))
    frames = [reader.load(log.path)] if plain else []
    folders = log.folders()
    if folders:
        frames.append(reader.load(folders))
    if not frames:
        return spark.createDataFrame([], schema)
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
