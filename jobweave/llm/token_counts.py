"""Tokens per document in flat token files without an index, by a separator scan.

A token file is a stream of fixed-width ids in which an end-of-document id follows each
document; nothing says where documents begin. The stream comes in blocks cut at any
token. Every block is searched for the separator at once with numpy: documents that lie
inside it are counted there, its first and last piece are not known to be whole. A
prefix scan over the blocks of a file gives the number of documents before each block,
in two levels (within runs of ``RUN`` blocks, then over the runs), so that no task holds
all blocks of a large file; pieces of the same document are then summed by its number.

Defined results: a document without tokens counts 0. Tokens after the last separator of a
file are a document of their own (``ended`` false). Empty blocks and files without blocks
give nothing; null tokens are an empty block. Repeated files are told apart by their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.arrow import slices, text_bytes
from jobweave.llm.pieces import default_model, load, reachable
from jobweave.session import stage, staging_path

END_ID = 2
BLOCK_TOKENS = 1 << 16
RUN = 256


def write_token_blocks(docs: DataFrame, id_column: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Token files of ``docs``, one per partition: (file, block, tokens as 16-bit ids, doc_ids that begin in the block).

    Each document is its pieces and the end id. The blocks have BLOCK_TOKENS tokens, wherever documents begin or end.
    """
    path = model or default_model()
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(reachable(path))
        if pieces.base > 1 << 16:
            raise ValueError("token files hold 16-bit ids; this vocabulary has more")
        file, block = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        begun: list[tuple[int, int | None]] = []
        n = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, begun, n, block
            stream = np.concatenate(held) if held else np.zeros(0, "<u2")
            size = len(stream) if last else len(stream) // BLOCK_TOKENS * BLOCK_TOKENS
            at = 0
            for a in range(0, size, BLOCK_TOKENS):
                ids = []
                while at < len(begun) and begun[at][0] < a + BLOCK_TOKENS:
                    ids.append(begun[at][1])
                    at += 1
                tokens = stream[a : min(a + BLOCK_TOKENS, size)].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([tokens], pa.binary()), pa.array([ids], pa.list_(pa.int64()))],
                    ["file", "block", "tokens", "doc_ids"],
                )
                block += 1
            held, n = [stream[size:]], len(stream) - size
            begun = [(p - size, d) for p, d in begun[at:]]

        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 21):
                ids, border = pieces.encode(batch.column("text").slice(a, b - a))
                body = np.ones(len(ids), bool)
                body[border[:-1]] = False  # no begin id; the end id of each text is the separator
                kept = ids[body]
                kept[border[1:] - 2 - np.arange(len(border) - 1)] = END_ID
                starts = border[:-1] - np.arange(len(border) - 1)
                begun += list(zip((starts + n).tolist(), batch.column("id").slice(a, b - a).to_pylist()))
                held.append(kept.astype("<u2"))
                n += len(kept)
                if n >= 8 * BLOCK_TOKENS:
                    yield from out(False)
        if n:
            yield from out(True)

    return plain.mapInArrow(run, "file bigint, block bigint, tokens binary, doc_ids array<bigint>")


def scan_blocks(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """(file, block, ends, first, inner, last): separators, tokens before the first, between them, and after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column("tokens"))
            ends, first, inner, last = [], [], [], []
            for a, b in zip(at[:-1], at[1:]):
                tokens = np.frombuffer(raw[a:b].tobytes(), dtype)
                where = np.flatnonzero(tokens == end_id)
                ends.append(len(where))
                first.append(int(where[0]) if len(where) else len(tokens))
                inner.append((np.diff(where) - 1).tolist())
                last.append(len(tokens) - int(where[-1]) - 1 if len(where) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(ends, pa.int64()), pa.array(first, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(last, pa.int64())],
                ["file", "block", "ends", "first", "inner", "last"],
            )

    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", "block", "tokens").mapInArrow(
        run, f"file {kind}, block bigint, ends bigint, first bigint, inner array<bigint>, last bigint"
    )


def before_blocks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the earlier blocks of the file: a prefix scan within runs of blocks and over the runs."""
    run = F.floor(F.col("block") / RUN)
    rows = rows.withColumn("run", run)
    runs = rows.groupBy("file", "run").agg(F.sum(value).alias("total"))
    # Two levels of runs keep every window short: RUN blocks, RUN runs, and the rest of the file by then is RUN^2 times shorter.
    higher = F.floor(F.col("run") / RUN)
    tops = runs.groupBy("file", higher.alias("top")).agg(F.sum("total").alias("sum"))
    by = lambda *k, order: Window.partitionBy(*k).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("top_before", F.coalesce(F.sum("sum").over(by("file", order="top")), F.lit(0))).select("file", "top", "top_before")
    runs = (
        runs.withColumn("top", higher)
        .withColumn("run_before", F.coalesce(F.sum("total").over(by("file", "top", order="run")), F.lit(0)))
        .join(tops, ["file", "top"])
        .select("file", "run", (F.col("run_before") + F.col("top_before")).alias("run_before"))
    )
    inside = F.coalesce(F.sum(value).over(by("file", "run", order="block")), F.lit(0))
    return rows.withColumn("_inside", inside).join(runs, ["file", "run"]).withColumn(name, F.col("_inside") + F.col("run_before")).drop("_inside", "run", "run_before")


def count_tokens(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """(file, doc_no, n_tokens, ended) of every document of token files given as (file, block, tokens)."""
    scanned = stage(before_blocks(stage(scan_blocks(blocks, end_id, dtype), "scanned"), "ends", "before"), "placed")
    inner = scanned.select("file", "before", F.posexplode("inner").alias("k", "n_tokens")).select(
        "file", (F.col("before") + 1 + F.col("k")).alias("doc_no"), "n_tokens", F.lit(True).alias("ended")
    )
    # The first piece belongs to the document that is open when the block begins, the last one to the next.
    first = scanned.select("file", F.col("before").alias("doc_no"), F.col("first").alias("n"), (F.col("ends") > 0).alias("ended"))
    last = scanned.where("ends > 0").select("file", (F.col("before") + F.col("ends")).alias("doc_no"), F.col("last").alias("n"), F.lit(False).alias("ended"))
    pieces = first.unionByName(last).groupBy("file", "doc_no").agg(F.sum("n").alias("n_tokens"), F.max("ended").alias("ended"))
    # Nothing after the last separator is no document.
    return inner.unionByName(pieces.where("ended or n_tokens > 0"))


def document_tokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(id, n_tokens) of every document, counted from token files written of them; ids are matched by order in the file."""
    blocks = write_token_blocks(docs, id_column, text, model)
    files = staging_path(docs.sparkSession, "token-blocks")
    blocks.write.option("compression", "zstd").parquet(files)
    blocks = docs.sparkSession.read.schema(blocks.schema).parquet(files)
    counts = count_tokens(blocks)
    begun = stage(before_blocks(blocks.select("file", "block", "doc_ids", F.size("doc_ids").alias("begun")), "begun", "before"), "begun")
    names = begun.select("file", "before", F.posexplode("doc_ids").alias("k", "id")).select("file", (F.col("before") + F.col("k")).alias("doc_no"), "id")
    return names.join(counts, ["file", "doc_no"]).select(F.col("id").alias(id_column), "file", "doc_no", "n_tokens")
