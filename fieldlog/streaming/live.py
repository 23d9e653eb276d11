"""Continuous runs: files that arrive, and plays that arrive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldlog.sources import event_files as E
from fieldlog.sources.archive import publish


def ingest(spark: SparkSession, source: str, root: str, checkpoint: str, pattern: str = E.EVENT_FILES) -> StreamingQuery:
    """Archives all files under source that earlier runs haven't seen, each batch as a version, then ends. A batch that is run again after a failure leaves out the
    files that it had archived already."""

    def add(batch: DataFrame, _: int) -> None:
        publish(batch.sparkSession, batch, root)

    files = spark.readStream.format("binaryFile").schema(E.FILE_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(source)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "inning int, half string, b1 string, b2 string, b3 string, outs int"
OUT = "game_key long, seq long, bases_before string, outs_before int"


def live_bases(plays: DataFrame) -> DataFrame:
    """For a stream of moved plays (game_key, seq, inning, half, batter, outs, may_retry, move_b, move_1, move_2, move_3): bases and outs before each. A game's state
    is six fields; plays of a game must arrive in order from batch to batch, and are put in order within one."""

    def run(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("seq")
        inning, half, b1, b2, b3, outs = state.get if state.exists else (None, None, None, None, None, 0)
        out = []
        for r in rows.itertuples(index=False):
            if (r.inning, r.half) != (inning, half):
                inning, half, b1, b2, b3, outs = r.inning, r.half, None, None, None, 0
            out.append((key[0], r.seq, "".join("01"[b is not None] for b in (b1, b2, b3)), outs))
            # A bare strikeout that would make a fourth out left the batter alive.
            alive = bool(r.may_retry) and outs + r.outs == 4
            sent = [("1" if alive else r.move_b, r.batter), (r.move_1 or "1", b1), (r.move_2 or "2", b2), (r.move_3 or "3", b3)]
            b1, b2, b3 = (next((who for to, who in sent if to == base and who is not None), None) for base in "123")
            outs += int(r.outs) - alive
        state.update((inning, half, b1, b2, b3, outs))
        yield pd.DataFrame(out, columns=["game_key", "seq", "bases_before", "outs_before"])

    return plays.groupBy("game_key").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")
