"""Many names in many texts: an automaton for each shard of the names, run over batches of texts where they lie."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.sources.session import materialize

#: Characters of the names of one shard: what is broadcast at once, whatever the number of names.
SHARD_CHARACTERS = 4_000_000
#: Automata that a worker keeps.
KEPT = 2
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(number: str, names: list[str]) -> ahocorasick.Automaton:
    if number not in _built:
        while len(_built) >= KEPT:
            _built.pop(next(iter(_built)))
        found = ahocorasick.Automaton()
        for name in names:
            found.add_word(name, name)
        found.make_automaton()
        _built[number] = found
    return _built[number]


def find_names(texts: DataFrame, names: DataFrame, id_col: str, text: str, name: str = "name", whole_words: bool = False) -> DataFrame:
    """(id, name, at, n): every occurrence of every name in every text, by case-folded characters; `at` counts them from 0.

    Names and texts are case-folded; the name is that of the table, and one of several that fold alike is a row of its own.
    With whole_words an occurrence has no word character on either side. Empty and null names are nowhere. Names are dealt to
    shards of bounded size; for each a broadcast automaton reads each text once, so time grows with texts times shards, and
    no text is shuffled. n is the length of the folded name.
    """
    spark = texts.sparkSession
    held = names.where(F.length(name) > 0).select(F.col(name).alias("name")).distinct()
    weight = held.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    shards = max(1, -(-weight // SHARD_CHARACTERS))
    dealt = materialize(held.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards))))
    rows = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = None
    for shard in range(shards):
        own = [r["name"] for r in dealt.where(F.col("shard") == shard).select("name").collect()]  # of bounded size
        folded: dict[str, list[str]] = {}
        for x in own:
            folded.setdefault(x.casefold(), []).append(x)
        given, number = spark.sparkContext.broadcast(folded), uuid.uuid4().hex

        def found(batches: Iterator[pa.RecordBatch], given=given, number=number) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(number, list(given.value)) if given.value else None
            for batch in batches if automaton else ():
                source, hits, places, sizes = [], [], [], []
                for row, value in enumerate(batch.column(1).to_pylist()):
                    value = (value or "").casefold()
                    for end, key in automaton.iter(value):
                        start = end + 1 - len(key)
                        if whole_words and (start and _word(value[start - 1]) or end + 1 < len(value) and _word(value[end + 1])):
                            continue
                        for x in given.value[key]:
                            source.append(row)
                            hits.append(x)
                            places.append(start)
                            sizes.append(len(key))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), pa.array(hits, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int32())], ["id", "name", "at", "n"])

        part = rows.mapInArrow(found, f"id {kind}, name string, at long, n int")
        out = part if out is None else out.unionByName(part)
    return out


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"
