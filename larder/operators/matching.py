"""Which texts hold which needles: automata over blocks of needles, one pass over the texts for each block."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.workdir import materialize

#: Letters of the needles of one automaton; its nodes take about a hundred bytes each in every worker.
BLOCK_LETTERS = 1_000_000


def _order(value: object) -> tuple:
    """A key that orders values as Spark does: null first, texts by their bytes, structs field by field."""
    if value is None:
        return (0,)
    if isinstance(value, dict):
        return (1, *(_order(v) for v in value.values()))
    return (1, value.encode()) if isinstance(value, str) else (1, value)


def least_holding(needles: DataFrame, texts: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """needle, best: the least value of the texts that hold each needle. ``needles``: needle, not empty; ``texts``: low, value.

    A task keeps one value for each needle of the block that it has met, so neither a needle that every text holds nor a text
    that holds very many needles makes pairs, and what is shuffled is a row for each needle and task at most.
    Null needles and null texts meet nothing.
    """
    wanted = needles.where("needle is not null and needle <> ''").select("needle").distinct()
    letters = wanted.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()[0]
    blocks = max(1, -(-letters // block_letters))
    wanted = wanted if blocks == 1 else materialize(wanted, "needles")
    rows, out = texts.where("low is not null").select("low", "value"), None
    kind = rows.schema["value"].dataType
    for block in range(blocks):
        own = (wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block)).toArrow()["needle"].to_pylist()

        def best(batches: Iterator[pa.RecordBatch], own: list[str] = own) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for i, needle in enumerate(own):
                machine.add_word(needle, i)
            machine.make_automaton()
            least: dict[int, tuple] = {}
            shape = None
            for batch in batches:
                shape = batch.column(1).type
                for text, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = {i for _, i in machine.iter(text)} if own else ()
                    if found:
                        key = _order(value)
                        for i in found:
                            if i not in least or key < least[i][0]:
                                least[i] = (key, value)
            if least:
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in least], pa.string()), pa.array([v for _, v in least.values()], shape)], names=["needle", "value"])

        part = rows.mapInArrow(best, f"needle string, value {kind.simpleString()}")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("needle").agg(F.min("value").alias("best"))
