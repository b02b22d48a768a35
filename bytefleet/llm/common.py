"""What the operators share: Arrow mapping in small slices and row hashing."""

from __future__ import annotations

import gc
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Slices handed to an operator hold about so many bytes of text; one row may be longer.
SLICE_BYTES = 4 << 20
_STATE: dict[tuple, object] = {}


def worker_state(operator: str, key: object, make: Callable[[], object]):
    """What an operator keeps in a Python worker between tasks, such as a cache: made once for a key.

    Workers are reused by later stages, so only one operator's state is held at a time: the first call of another frees it.
    """
    if (operator, key) not in _STATE:
        if _STATE:
            _STATE.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _STATE[operator, key] = make()
    return _STATE[operator, key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose text column stays near `limit` bytes, so that memory follows the slice."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_text(df: DataFrame, id_col: str, text_col: str, each: Callable[[list, list], Sequence[Sequence]], schema: str) -> DataFrame:
    """Narrow Arrow map: `each` gets the ids and texts of a slice and gives the output columns in the schema's order.

    Only the two named columns are read, so further columns of any name do no harm. Rows stay where they are:
    no shuffle, and a lost executor costs only its own partitions.
    """
    out = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                columns = each(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema)


def pa_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def hash_bound(part: int, whole: int) -> int:
    """The 64-bit hashes up to this bound are part / whole of all, or all of them where part reaches whole."""
    return min((1 << 63) - 1, ((1 << 64) - 1) * part // whole - (1 << 63))


def hashed_share(column, part: int, whole: int):
    """True on about part / whole of the ids, by hash alone; on all where part reaches whole. A bounded sample for a model's fit."""
    from pyspark.sql import functions as F

    if part >= whole:
        return F.lit(True)
    return F.xxhash64(column) <= F.lit(hash_bound(part, whole))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names.

    Where it is unset and driver and executors are one process (as in tests), one is made; on a cluster that is an error, as
    no folder of the driver's machine would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _OWN
    if _OWN is None:
        import tempfile

        _OWN = tempfile.mkdtemp(prefix="shared-")
    return _OWN


_OWN: str | None = None
#: Seconds between two clean-ups of what finished steps leave behind.
CLEAN_EVERY = 2.0
_CLEANED = 0.0


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder, so that later steps neither repeat the work nor depend on
    executors that may be lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    # Spark deletes the shuffle files and checkpoints of finished steps once the driver's garbage is collected; a thread
    # of the gateway first has to let go of what Python no longer holds, which it looks for ten times a second.
    # Short steps leave little behind and follow one another fast, so this isn't done for each of them
    global _CLEANED
    if time.monotonic() - _CLEANED > CLEAN_EVERY:
        gc.collect()
        time.sleep(0.3)
        context._jvm.System.gc()
        _CLEANED = time.monotonic()
    return df.checkpoint(eager=True)
