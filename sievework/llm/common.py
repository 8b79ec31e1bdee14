"""What the training-data operators share: shared-folder cuts, batch sizes, word rules."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Texts that a step handles at once, and about how many bytes of them.
TEXT_ROWS, TEXT_BYTES = 512, 8 << 20
#: What this worker keeps between tasks, by the module that keeps it; and the module that ran last.
_KEPT: dict[str, dict] = {}
_LAST: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors see; a temporary one only in local mode with none set."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = known or tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(known)
    return known


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever Spark keeps it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there from now on, so that a lost executor costs no recomputation."""
    ship(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, part_rows: int = 50_000) -> tuple[DataFrame, int]:
    """``cut`` with the number of rows, counted on the way; what is small is read in few tasks from then on."""
    seen = Observation()
    df = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    rows = seen.get["n"]
    return df.coalesce(rows // part_rows + 1), rows


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more: it waits for the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once a context; they may have been started without it."""
    sc = spark.sparkContext
    if getattr(sc, "_sievework_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="code-")) / "sievework.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._sievework_shipped = True


def kept_here(module: str) -> dict:
    """A dict that a worker keeps between tasks; it is emptied once the worker runs another module's step."""
    return _KEPT.setdefault(module, {})


def _begin(module: str) -> None:
    """A worker holds the vocabularies and memos of one operator at a time."""
    if _LAST != [module]:
        for kept in _KEPT.values():
            kept.clear()
        _LAST[:] = [module]
        gc.collect()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most TEXT_ROWS rows and, but for one long row, about TEXT_BYTES."""
    for b in batches:
        rows = max(1, min(TEXT_ROWS, TEXT_BYTES * max(b.num_rows, 1) // max(b.nbytes, 1)))
        if b.num_rows <= rows:
            yield b
        for lo in range(0, b.num_rows if b.num_rows > rows else 0, rows):
            yield b.slice(lo, rows)


def map_text(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in slices; Spark bounds its batches by rows and bytes, and the caller's settings stay as they are."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(step.__module__)
        yield from step(slices(batches))

    return df.mapInArrow(run, schema)


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 ...: names with dots, blanks or backticks then need no care; ``toDF(*names)`` brings them back."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


class Memo(dict):
    """A bounded memo: ``make(key)`` fills it; it starts anew once it holds ``most`` keys."""

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def plain_spacing(text: str) -> bool:
    """True if every white-space character is one blank or one line feed between two words."""
    words = text.split()
    gaps = len(words) - 1
    return text.count(" ") + text.count("\n") == gaps and sum(map(len, words)) + gaps == len(text)


def small_side(df: DataFrame, most_rows: int = 2_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """A side of a join, stored: to be broadcast if its counted rows and bytes are within both bounds, else joined by a shuffle."""
    wide = [F.octet_length(F.col(f"`{f.name}`").cast("binary")) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    seen = Observation()
    columns = len(df.columns)
    df = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(wide, F.lit(0)).cast("long")), F.lit(0)).alias("b")))
    rows, more = seen.get["n"], seen.get["b"]
    return F.broadcast(df.coalesce(rows // 50_000 + 1)) if rows <= most_rows and 16 * columns * rows + more <= most_bytes else df
