"""Helpers for DataFrames whose columns may have any names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.textbatch import CHUNK_BYTES, Texts, chunks, tidy


def col(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have; names are compared as Spark does by default, without case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def check_free(columns: Iterable[str], made: Iterable[str]) -> None:
    """ValueError if one of the columns that pass through has the name of one that is made; compared without case, as in Spark."""
    taken = {c.lower() for c in columns}
    both = [m for m in made if m.lower() in taken]
    if both:
        raise ValueError(f"the table has columns {both} already: rename them or choose other names for what is made")


def ready_for_checkpoint(spark: SparkSession) -> None:
    """Let checkpoint() use the shared folder of spark.checkpoint.dir.

    Where that is unset, as in tests, a local session gets a folder of its own; on a cluster, whose executors do not share
    such a folder, RuntimeError.
    """
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)


def map_texts(docs: DataFrame, keep: list[str], text_col: str, start: Callable[[], Callable[[Texts], list]], made: T.StructType, filtered: bool = False, limit: int = CHUNK_BYTES) -> DataFrame:
    """Columns `keep` of each row and what is made of its text.

    start() runs once in a task; what it returns gets a run of whole documents and returns one array for each field of
    `made`, and if `filtered` one more, of booleans, that tells which rows stay. A run has about `limit` bytes, or one longer
    document. Inside, columns have neutral names.
    """
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField(f"m{i}", f.dataType) for i, f in enumerate(made.fields)]
    picked = [col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    at = keep.index(text_col) if text_col in keep else len(keep)
    if at == len(keep):
        picked.append(col(text_col).alias("t"))
    names, n = [f.name for f in fields], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for texts in chunks(batch.column(at), limit):
                new = work(texts)
                arrays = [batch.column(i).slice(texts.first_row, len(texts)) for i in range(n)]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x) for x in new[: len(made.fields)]]
                out = pa.RecordBatch.from_arrays(arrays, names)
                yield out.filter(pa.array(new[-1], pa.bool_())) if filtered else out

    return docs.select(*picked).mapInArrow(tidy(run), T.StructType(fields)).toDF(*keep, *(f.name for f in made.fields))
