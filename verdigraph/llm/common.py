"""What the training-data operators share: scratch tables, table reads and word rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.sources.scratch import maybe_broadcast, settle, small_enough

__all__ = ["LOWER_AZ", "WORD", "counted_join", "few_texts", "fresh", "maybe_broadcast", "own_columns", "read", "salted_join", "settle", "slices", "small_enough", "word_count"]

#: A-Z to a-z, all other bytes as they are.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Whole texts that go to Python at a time.
TEXTS = 1000


def few_texts(spark: SparkSession) -> None:
    """Have the session hand rows to Python at most TEXTS at a time: the default of 10,000 whole texts is tens of megabytes, held several times over on both sides."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= TEXTS:
        spark.conf.set(setting, str(TEXTS))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def own_columns(like: DataFrame) -> list[Column]:
    """The columns of a table by name, whatever characters the names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in like.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where df has a column of that name already (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: Column, rows: int, salts: int = 32) -> DataFrame:
    """Inner join on key. small is broadcast if it has at most so many rows; else it is repeated for each salt and big is dealt to salts by a hash of spread, so that no key is one task."""
    if small_enough(small, rows):
        return big.join(F.broadcast(small), key)
    (salt,) = fresh(big.join(small, key), "salt")
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, salt]).drop(salt)


def counted_join(big: DataFrame, small: DataFrame, keys: list[str], n: str, how: str = "inner", rows: int = 200_000, parts: int = 1000) -> DataFrame:
    """big joined ("inner" or "left") with small, which is written, has each key once and in n tells how many rows of big have it.

    small is broadcast if it has at most so many rows. Else the keys of more
    than a parts-th of these rows, of which there are under `parts`, are
    broadcast, and only the others, none of which is much for a task, meet in
    a shuffled join. Keys are not null; big is read twice then.
    """
    if small_enough(small, rows):
        return big.join(F.broadcast(small), keys, how)
    whole = small.agg(F.sum(n)).first()[0]
    heavy = small.filter(F.col(n) * parts > whole)
    light = small.filter(F.col(n) * parts <= whole)
    first = big.join(F.broadcast(heavy), keys)
    rest = big.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("merge"), keys, how)
    return first.unionByName(rest)
