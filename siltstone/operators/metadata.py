"""The write-once namespace of names: snapshots, bit streams and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.model import HASH_BYTES

BACKUP, BITS, LOG = "backup-", "bits-", "toencrypted-"


def stamped(name: Column, at: Column) -> Column:
    """name@yyyymmddhhmmss"""
    return F.concat(name, F.lit("@"), F.date_format(at, "yyyyMMddHHmmss"))


def of_kind(metadata: DataFrame, prefix: str) -> DataFrame:
    return metadata.where(F.col("name").startswith(prefix))


def listing(metadata: DataFrame) -> DataFrame:
    """(kind, name, created) of snapshots, then bit streams, each by name."""
    kind = F.when(F.col("name").startswith(BACKUP), "backup").when(F.col("name").startswith(BITS), "bits")
    rows = metadata.select(kind.alias("kind"), F.regexp_replace("name", f"^({BACKUP}|{BITS})", "").alias("name"), "created")
    return rows.where("kind is not null").orderBy("kind", "name")


def totals(metadata: DataFrame) -> DataFrame:
    return listing(metadata).groupBy("kind").agg(F.count("*").alias("n"))


def latest(metadata: DataFrame, prefix: str, exact: bool = False) -> DataFrame:
    """The row of this very name, else the newest whose name begins so (equal times: the greater name).

    A prefix with a stamp (@) is never completed. exact: begin with the whole name and a stamp, so that "home" is
    not taken for "home2".
    """
    if "@" in prefix:
        return metadata.where(F.col("name") == prefix)
    begins = F.col("name").startswith(prefix + "@" if exact else prefix)
    found = metadata.where((F.col("name") == prefix) | begins)
    best = found.agg(F.max_by("name", F.struct((F.col("name") == prefix).alias("own"), "created", "name")).alias("name")).where("name is not null")
    return metadata.join(F.broadcast(best), "name", "left_semi")  # one row


def collisions(metadata: DataFrame, new: DataFrame) -> DataFrame:
    """New names that exist already: these must not be written."""
    return new.join(metadata.select("name"), "name", "left_semi")


def valid_pointer(data: Column) -> Column:
    """Whether the data is one hash."""
    return F.octet_length(data) == HASH_BYTES


def suffixed(files: DataFrame, suffix: str, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Names with the suffix, and the rejects."""
    good = F.coalesce(F.col(name).endswith(suffix), F.lit(False))
    return files.where(good), files.where(~good)


def hierarchy(names: Column) -> Column:
    """name@yyyymmddhhmmss as (name, year, month, day, time); null unless the stamp has 14 digits and there is one @."""
    parts = F.split(names, "@")
    stamp = parts[1]
    fine = (F.size(parts) == 2) & stamp.rlike("^[0-9]{14}$")
    return F.when(fine, F.struct(parts[0].alias("name"), F.substring(stamp, 1, 4).alias("year"), F.substring(stamp, 5, 2).alias("month"), F.substring(stamp, 7, 2).alias("day"), F.substring(stamp, 9, 6).alias("time")))


def parse_key_record(text: Column) -> Column:
    """The four hex lines of a key record as binaries."""
    lines = F.split(text, "\n")
    return F.struct(*(F.unhex(lines[k]).alias(n) for k, n in enumerate(("salt", "passphrase_hash", "encrypted_key", "iv"))))


def encryption_map(log: DataFrame) -> DataFrame:
    """plain to encrypted hash; of several entries for one plain hash the last written counts."""
    return log.groupBy("plain").agg(F.max_by("encrypted", F.struct("written", "encrypted")).alias("encrypted"))


def encrypted_names(hashes: DataFrame, log: DataFrame, hash: str = "hash") -> DataFrame:
    """Adds the encrypted hash of every plain one, null where there is none yet."""
    return hashes.join(encryption_map(log).withColumnRenamed("plain", hash), hash, "left")
