"""Content hashes and deterministic pseudo-random numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sequence_hash(seq: Column, seq_id: Column) -> Column:
    """Identity of a record: the hash of its sequence and length, or its id if it has no sequence."""
    return F.when(F.coalesce(seq, F.lit("")) == "", seq_id).otherwise(F.sha2(F.concat(seq, F.lit("_"), F.length(seq).cast("string")), 256))


def hash_int(*parts: Column | str) -> Column:
    """A 32-bit integer from the md5 of the parts, joined by ``|``; the same in every engine."""
    key = F.concat_ws("|", *[(F.lit(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the parts."""
    return hash_int(*parts) / F.lit(4294967296.0)


def hash_role(key: Column) -> Column:
    """train, val or test: seven, one and two tenths of the keys."""
    tenth = hash_int(key) % 10
    return F.when(tenth < 7, "train").when(tenth == 7, "val").otherwise("test")
