"""Stateful stream packer.

The state of a shard is what it has left over: the pieces of an unfinished chunk as a list that
new pieces are appended to, the next chunk number, and whether the shard's budget is spent. A
micro-batch is read one Arrow frame at a time. Documents of a shard with a single frame are sorted
in memory; as soon as there is a second one they are parked in the state store (RocksDB, on disk)
under their order key, and only the keys are sorted. So a worker holds one frame, one document and
less than a chunk however much of a micro-batch one shard has. How much a micro-batch admits is
bounded by bytes (``max_bytes_per_trigger`` of the source).

A single global buffer would make the stream serial; per shard, each shard's
output equals batch packing of that shard alone in the same arrival order. What is
left in the buffers when a stream has ended (fewer than ``block`` tokens each) is read
from its state store by ``stream_remainders``, so every token is accounted for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

SUB_COL = "sub"
CHUNKS_AT_ONCE = 256  # chunks in an output frame


def sub_shard(order_col: str, salt: int):
    """Deterministic sub-shard of a document: ``md5(doc key)[:8] mod salt``."""
    key = F.md5(F.col(order_col).cast("string"))
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), F.lit(salt)).cast("int")


class ShardPacker(StatefulProcessor):
    """Packs the documents of one (shard, sub) key; see the module's docstring."""

    def __init__(self, shard_col: str, order_col: str, order_type: str, ids_col: str, block: int, limit: int | None):
        self.shard_col, self.order_col, self.order_type, self.ids_col = shard_col, order_col, order_type, ids_col
        self.block, self.limit = block, limit

    def init(self, handle) -> None:
        self.place = handle.getValueState("place", "next_chunk long, done boolean")
        self.tail = handle.getListState("tail", "ids array<int>")
        self.parked = handle.getMapState("parked", f"at {self.order_type}, n long", "ids array<int>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        next_chunk, done = self.place.get() if self.place.exists() else (0, False)
        if done:
            return
        held = [np.asarray(x[0], np.int32) for x in self.tail.get()]
        size, kept = sum(map(len, held)), len(held)  # the first ``kept`` pieces are in the state already
        ready: list[np.ndarray] = []
        for ids in self._in_order(rows):
            held.append(ids)
            size += len(ids)
            if size < self.block:
                continue
            stream = np.concatenate(held)
            full = len(stream) // self.block
            if self.limit is not None:
                full = min(full, self.limit - next_chunk - len(ready))
            ready += list(stream[: full * self.block].reshape(full, self.block))
            held, kept = [stream[full * self.block :]], -1  # the state's pieces are used up
            size = len(held[0])
            done = self.limit is not None and next_chunk + len(ready) >= self.limit
            if len(ready) >= CHUNKS_AT_ONCE or done:
                yield self._frame(key, next_chunk, ready)
                next_chunk, ready = next_chunk + len(ready), []
            if done:
                break
        if ready:
            yield self._frame(key, next_chunk, ready)
            next_chunk += len(ready)
        if kept < 0:
            self.tail.clear()
        if done:
            self.parked.clear()
        else:
            for piece in held[max(kept, 0) :]:
                if len(piece):
                    self.tail.appendValue((piece.tolist(),))
        self.place.update((int(next_chunk), bool(done)))

    def _in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        single, keys = None, []
        for frame in frames:
            if not len(frame):
                continue
            if single is None and not keys:
                single = frame
                continue
            if single is not None:
                self._park(single, keys)
                single = None
            self._park(frame, keys)
            del frame
        if single is not None:
            for ids in single.sort_values(self.order_col, kind="stable", na_position="first")[self.ids_col]:
                yield np.asarray(ids, np.int32)
            return
        for k in sorted(keys, key=lambda k: (k[0] is not None, k)):
            yield np.asarray(self.parked.getValue(k)[0], np.int32)
            self.parked.removeKey(k)

    def _park(self, frame: pd.DataFrame, keys: list) -> None:
        for at, ids in zip(frame[self.order_col], frame[self.ids_col]):
            at = None if pd.isna(at) else at.item() if hasattr(at, "item") else at
            keys.append((at, len(keys)))
            self.parked.updateValue(keys[-1], (np.asarray(ids).tolist(),))

    def _frame(self, key, first: int, chunks: list[np.ndarray]) -> pd.DataFrame:
        n = len(chunks)
        return pd.DataFrame({
            self.shard_col: [key[0]] * n,
            SUB_COL: np.full(n, key[1], np.int32),
            "chunk_idx": np.arange(first, first + n, dtype=np.int64),
            "input_ids": chunks,
        })


def pack_stream(df: DataFrame, shard_col: str = "shard", block: int = 1024, order_col: str = "doc_id",
                ids_col: str = "ids", target_tokens_per_shard: int | None = None, salt: int = 1) -> DataFrame:
    """R2 (+R3): ``(shard, sub, chunk_idx, input_ids)`` from a stream of tokenised documents.

    ``salt > 1`` splits every shard into that many sub-shards by a hash of the
    document key, each with its own buffer, so a shard holding a large share of
    the stream is packed by ``salt`` tasks instead of one. Each sub-shard strands
    fewer than ``block`` tokens; the budget applies per sub-shard. The stream needs the
    RocksDB state store (``streaming.jobs`` sets it for the queries it starts).
    """
    out_schema = T.StructType([
        T.StructField(shard_col, df.schema[shard_col].dataType),
        T.StructField(SUB_COL, T.IntegerType()),
        T.StructField("chunk_idx", T.LongType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    ])
    limit = None if target_tokens_per_shard is None else math.ceil(target_tokens_per_shard / block)

    from tessera.session import ship_package

    ship_package(df.sparkSession)
    keyed = df.select(shard_col, order_col, ids_col).withColumn(SUB_COL, sub_shard(order_col, max(1, salt)))
    packer = ShardPacker(shard_col, order_col, df.schema[order_col].dataType.simpleString(), ids_col, block, limit)
    return keyed.groupBy(shard_col, SUB_COL).transformWithStateInPandas(packer, out_schema, "Append", "None")


def stream_remainders(spark: SparkSession, checkpoint: str, shard_col: str = "shard") -> DataFrame:
    """The short last chunk of every (shard, sub) of an ended stream, from its state store.

    Same columns as ``pack_stream``; shards whose budget is spent and empty buffers give no row.
    """
    def state(name: str) -> DataFrame:
        return (spark.read.format("statestore").option("stateVarName", name)
                .option("flattenCollectionTypes", False).load(checkpoint))

    tail = state("tail").select("key", F.flatten(F.transform("list_value", lambda x: x["ids"])).alias("input_ids"))
    place = state("place").select(F.col("key").alias("k"), "value.*").where(~F.col("done"))
    both = tail.where(F.size("input_ids") > 0).join(place, F.col("key").eqNullSafe(F.col("k")))
    return both.select(f"key.{shard_col}", f"key.{SUB_COL}", F.col("next_chunk").alias("chunk_idx"), "input_ids")
