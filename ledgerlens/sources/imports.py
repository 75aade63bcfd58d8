"""The statement import as one job: A3-A7, A9 and B1-B12 in sequence.

A batch's life is a log of manifest rows (PROCESSING, then COMPLETED or
FAILED); the last row of a batch is its state.  The log is a folder of numbered
files, one a row.  A writer reads the log, decides, and makes the next file only
if nobody else has made it; otherwise it reads and decides again.  So imports
that run at the same time get different batch ids, and one of two imports of
the same content is the duplicate.  Lines are written under the batch's own folder, and readers take only
those of COMPLETED batches, so a half-written batch is never seen and a retry
of a FAILED one replaces its lines.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import validation as V
from ledgerlens.session import create_file, path_exists
from ledgerlens.sources import csv as CSV
from ledgerlens.sources import ingest as ING

MANIFEST = ("step long, batch_id long, source_id int, file_name string, file_hash string, status string, "
            "row_count long, error string")

#: Characters of an error that its FAILED row keeps.
ERROR_CHARS = 500


class ImportRefused(ValueError):
    """An import that isn't begun; ``code`` tells why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class StatementStore:
    """Manifest and lines of imported statements under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log_dir, self.lines_dir = spark, os.path.join(folder, "manifest"), os.path.join(folder, "lines")

    def log(self) -> DataFrame:
        if not path_exists(self.spark, self.log_dir):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(self.log_dir)

    def batches(self) -> DataFrame:
        """The last state of each batch."""
        cols = [c.split()[0] for c in MANIFEST.split(", ")]
        return self.log().groupBy("batch_id").agg(F.max_by(F.struct(*cols), "step").alias("m")).select("m.*").drop("step")

    def lines(self) -> DataFrame | None:
        """The lines of COMPLETED batches; None before the first import."""
        done = self.batches().filter("status = 'COMPLETED'").select("batch_id")
        ids = [r["batch_id"] for r in done.collect()]  # one number a batch
        return self.spark.read.parquet(*[self._folder(i) for i in ids]) if ids else None

    def _folder(self, batch_id: int) -> str:
        return os.path.join(self.lines_dir, f"batch-{batch_id}")

    def _append(self, decide) -> dict:
        """Add the row that ``decide`` gives for the batches' states; asked again whenever another writer was faster."""
        while True:
            step = (self.log().agg(F.max("step")).first()[0] or 0) + 1
            row = {"step": step} | decide(self.batches())
            if create_file(self.spark, os.path.join(self.log_dir, f"{step:019d}.json"), json.dumps(row)):
                return row

    def _tell(self, batch: dict, status: str, row_count: int | None = None, error: str | None = None) -> None:
        row = {k: batch[k] for k in ("batch_id", "source_id", "file_name", "file_hash")}
        self._append(lambda _: row | {"status": status, "row_count": row_count, "error": error})

    def _begin(self, upload: DataFrame, source_id: int) -> dict:
        """Register the upload: its PROCESSING row, under a new batch id or that of its failed try."""
        def decide(batches: DataFrame) -> dict:
            got = ING.register_batch(upload, batches, source_id).first()
            if got["decision"] == "DUPLICATE_IMPORT":
                raise ImportRefused("DUPLICATE_IMPORT", f"{got['file_name']} was already imported as batch {got['batch_id']}")
            return {"batch_id": got["batch_id"], "source_id": source_id, "file_name": got["file_name"], "file_hash": got["file_hash"],
                    "status": "PROCESSING", "row_count": None, "error": None}
        return self._append(decide)

    def import_statement(self, path: str, source_id: int, acc: DataFrame, sources: DataFrame, max_rows: int | None = None) -> int:
        """Import one upload (a file, or the parts of one in a folder); its batch id.

        Raises ImportRefused (INVALID_IMPORT_SOURCE, DUPLICATE_IMPORT) before a
        batch begins, and after it failed with the code of the first rule that
        it breaks; a failed batch has a FAILED row with all of them.  Any other
        error is told in the FAILED row as well and raised again."""
        if sources.filter((F.col("source_id") == source_id) & (F.col("file_format") != "DATABASE")).isEmpty():
            raise ImportRefused("INVALID_IMPORT_SOURCE", f"source {source_id} is no external settlement source")
        parts = ING.read_files(self.spark, path).orderBy("file_name").select("file_hash").collect()  # one row a part
        whole = parts[0]["file_hash"] if len(parts) == 1 else None
        name = os.path.basename(path.rstrip("/"))
        upload = self.spark.createDataFrame([(path, name, whole, [p["file_hash"] for p in parts])],
                                            "path string, file_name string, file_hash string, parts array<string>")
        upload = upload.withColumn("file_hash", F.coalesce("file_hash", F.sha2(F.array_join("parts", ""), 256))).drop("parts")
        batch = self._begin(upload, source_id)
        try:
            rows = self._publish(path, batch, acc, max_rows)
        except (CSV.CsvHeaderError, CSV.BatchTooLarge) as e:
            self._tell(batch, "FAILED", error=e.code)
            raise ImportRefused(e.code, str(e)) from e
        except BaseException as e:  # whatever stopped it, the batch has failed and can be tried again
            self._tell(batch, "FAILED", error=str(e)[:ERROR_CHARS])
            raise
        self._tell(batch, "COMPLETED", rows)
        return batch["batch_id"]

    def _publish(self, path: str, batch: dict, acc: DataFrame, max_rows: int | None) -> int:
        raw = CSV.read_statement(self.spark, path)
        refs = self.spark.createDataFrame([], "external_ref string") if (known := self.lines()) is None else known
        broken = [r["rule"] for r in V.validate_statement(raw, acc, refs, max_rows).select("rule").collect()]  # one row a rule
        if broken:
            raise ImportRefused(broken[0], ", ".join(sorted(broken)))
        folder = self._folder(batch["batch_id"])
        CSV.publish_statement(CSV.type_statement(raw), batch["batch_id"], batch["source_id"]).write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder).count()
