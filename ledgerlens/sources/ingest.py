"""A5 content-hash batch registration and A10 historical bank extract ETL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.session import materialize, with_dense_ids


#: Larger files are hashed as a stream; a row can't hold their content.
ROW_BYTES = 1 << 30


def read_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """Uploaded files as (path, file_name, file_hash): sha256 of the content,
    taken inside the tasks.  Files of more than ``ROW_BYTES`` are read block by
    block (the same hash, in constant memory)."""
    files = spark.read.format("binaryFile").load(path_glob)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    whole = files.filter(F.col("length") <= ROW_BYTES).select("path", name, F.sha2("content", 256).alias("file_hash"))
    large = files.filter(F.col("length") > ROW_BYTES).select("path", name)
    if large.isEmpty():  # the listing tells; no Python worker is needed then
        return whole
    return whole.unionByName(large.mapInPandas(_stream_hash, "path string, file_name string, file_hash string"))


def _stream_hash(batches):
    import hashlib

    from pyarrow import fs
    for pdf in batches:
        hashes = []
        for path in pdf["path"]:
            store, inner = fs.FileSystem.from_uri(path)
            h = hashlib.sha256()
            with store.open_input_stream(inner, compression=None) as f:
                while block := f.read(8 << 20):
                    h.update(block)
            hashes.append(h.hexdigest())
        yield pdf.assign(file_hash=hashes)


def register_batch(files: DataFrame, manifest: DataFrame, source_id: int) -> DataFrame:
    """A5: (source, hash) already COMPLETED or PROCESSING -> DUPLICATE_IMPORT;
    FAILED -> RETRY (the failed batch id is used again and its lines replaced);
    otherwise NEW with the next batch ids, in order of hash.  Of files with
    equal content in one call the one with the smallest path counts, the others
    are DUPLICATE_IMPORT.  files: path, file_name, file_hash."""
    m = (manifest.filter(F.col("source_id") == source_id)
         .groupBy("file_hash").agg(F.max_by(F.struct("batch_id", "status"), "batch_id").alias("b")))
    hashes = files.groupBy("file_hash").agg(F.min("path").alias("first")).join(m, "file_hash", "left")
    hashes = materialize(hashes, "hashes")
    last = manifest.agg(F.max("batch_id")).first()[0] or 0
    new = with_dense_ids(hashes.filter("b is null").select("file_hash"), ["file_hash"], "new_id", last)
    j = files.join(hashes, "file_hash").join(new, "file_hash", "left")
    decision = (F.when(F.col("path") != F.col("first"), "DUPLICATE_IMPORT").when(F.col("b").isNull(), "NEW")
                .when(F.col("b.status").isin("COMPLETED", "PROCESSING"), "DUPLICATE_IMPORT")
                .otherwise("RETRY"))
    return j.select("path", "file_name", "file_hash", decision.alias("decision"),
                    F.coalesce("new_id", "b.batch_id").cast("long").alias("batch_id"))


def bank_date(c) -> F.Column:
    """``YYMMDD`` (leading zeros may be missing) -> date in 19YY."""
    s = F.lpad(F.col(c).cast("string"), 6, "0")
    return F.try_to_date(F.concat(F.lit("19"), s), "yyyyMMdd")


def load_bank_extract(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A10: ';'-separated account / disp / client / district / trans files ->
    branches, clients, accounts (only those with an OWNER disposition) and
    the ledger (type PRIJEM, or text starting with 'credit' -> CREDIT, else
    DEBIT; reference ``LDG-<trans_id>``)."""
    def rd(name: str) -> DataFrame:
        return spark.read.option("header", True).option("sep", ";").csv(os.path.join(folder, name))

    district, client, account = rd("district.csv"), rd("client.csv"), rd("account.csv")
    disp, trans = rd("disp.csv"), rd("trans.csv")
    branches = district.select(F.col("district_id").cast("int").alias("branch_id"), F.col("name").alias("branch_name"))
    clients = client.select(F.col("client_id").cast("long").alias("client_id"),
                            F.col("district_id").cast("int").alias("branch_id"))
    owners = disp.filter(F.upper(F.trim("type")) == "OWNER").select(
        F.col("account_id").cast("long").alias("account_id"), F.col("client_id").cast("long").alias("client_id"))
    owned = owners.groupBy("account_id").agg(F.min("client_id").alias("client_id"))
    accounts = (account.select(F.col("account_id").cast("long").alias("account_id"),
                               F.col("district_id").cast("int").alias("branch_id"))
                .join(owned, "account_id")
                .select("account_id", F.concat(F.lit("ACC-"), F.col("account_id").cast("string")).alias("external_ref"),
                        "client_id", "branch_id", F.lit("GBP").alias("currency"), F.lit("ACTIVE").alias("status")))
    t = F.lower(F.trim("type"))
    ledger = (trans.join(accounts.select(F.col("account_id").cast("string").alias("account_id")), "account_id",
                         "left_semi")
              .select(F.col("trans_id").cast("long").alias("ledger_txn_id"),
                      F.col("account_id").cast("long").alias("account_id"),
                      F.concat(F.lit("LDG-"), F.col("trans_id")).alias("txn_ref"),
                      F.when((t == "prijem") | t.startswith("credit"), "CREDIT").otherwise("DEBIT").alias("txn_type"),
                      F.abs(F.col("amount").try_cast(S.MONEY)).alias("amount"), F.lit("GBP").alias("currency"),
                      bank_date("date").alias("value_date")))
    return {"branches": branches, "clients": clients, "accounts": accounts, "ledger": ledger}
