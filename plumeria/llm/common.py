"""What the operators of this subpackage share: shared-folder tables, shipping code, word rules."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.functions.shared import new_path, until_exit, written  # noqa: F401

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The same class of white space, for splitting.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and a lost executor loses nothing.

    The folder stays until the application ends, since a result may read it at any time.
    """
    return written(df, name)


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it, in any case."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    """A key of 64 bits for the text (null: as an empty one), computed without Python."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors once per application (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if getattr(sc, "_plumeria_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        out = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "plumeria_code.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(out)
    sc._plumeria_shipped = True


def give_back() -> None:
    """At the end of a task: what is free in this Python worker goes back to the system, for whatever runs next to it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row (bound as a lambda variable)."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(col, UPPER, LOWER)
