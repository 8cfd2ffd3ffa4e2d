"""People named in texts: whole names of one or several words, with the endings that Korean puts behind a name.

An automaton of all names (Aho-Corasick) reads each text once, however many names there are. It is sent to the tasks, so
its names are bounded by their characters; more names are dealt over several automata by hash, and each reads the texts
again. Nothing is joined on words, so that a frequent word costs nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters of names in one automaton.
MOST_CHARS = 2_000_000

# Endings that may follow a name; the last is after a final consonant, the one before after none.
ENDINGS = ("에게서", "한테서", "으로부터", "에게", "한테", "께서", "까지", "부터", "처럼", "보다", "으로", "라고", "이라", "은", "는", "이", "가", "을", "를", "와", "과", "도", "만", "의", "님")
CALLED = {False: "야", True: "아"}


def closed_syllable(c: str) -> bool:
    """Whether a Hangul syllable ends in a consonant."""
    return 0xAC00 <= ord(c) <= 0xD7A3 and (ord(c) - 0xAC00) % 28 != 0


def _inside(c: str) -> bool:
    """A letter or a number, which may not touch a name."""
    return unicodedata.category(c)[0] in "LN"


class Finder:
    """Names as an automaton."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.names = ahocorasick.Automaton()
        for n in names:
            self.names.add_word(n, n)
        if names:
            self.names.make_automaton()
        self.empty = not names

    def find(self, text: str) -> set[str]:
        """The names that stand in the text, composed as the names are."""
        found: set[str] = set()
        if self.empty or not text:
            return found
        text = unicodedata.normalize("NFC", text)
        for end, name in self.names.iter(text):
            if name not in found and self._stands(text, end + 1, name):
                found.add(name)
        return found

    @staticmethod
    def _stands(text: str, end: int, name: str) -> bool:
        start = end - len(name)
        if start and _inside(text[start - 1]):
            return False
        free = lambda at: at == len(text) or not _inside(text[at])
        if free(end):
            return True
        return any(text.startswith(e, end) and free(end + len(e)) for e in (*ENDINGS, CALLED[closed_syllable(name[-1])]))


def name_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, participant, name): who is named in texts(id, text), and by the longest of the names(participant, name[, place])
    that stand there; names of one length go by ``place``, which may tell display names from aliases.

    Null texts and empty names match nothing; a name that several share names them all; case counts.
    """
    place = F.col("place") if "place" in names.columns else F.lit(0)
    known = names.where("name <> ''").select("participant", T.nfc("name").alias("name"), place.cast("int").alias("place")).distinct()
    distinct = known.select("name").distinct()
    blocks = max(1, -(-(distinct.agg(F.sum(F.char_length("name"))).first()[0] or 0) // MOST_CHARS))
    id_type = texts.schema["id"].dataType.simpleString()

    def block(k: int) -> DataFrame:
        own = [r["name"] for r in distinct.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(own)
            for batch in batches:
                found = [finder.find(t) if t else () for t in batch.column(1).to_pylist()]
                rows = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([n for f in found for n in f], pa.string())], names=["id", "name"])

        return texts.select("id", "text").mapInArrow(run, f"id {id_type}, name string")

    found = reduce(DataFrame.unionByName, map(block, range(blocks)))
    # length in UTF-16 units, then the earlier place
    best = F.max(F.struct((F.octet_length(F.encode("name", "UTF-16BE")) / 2).alias("n"), (-F.col("place")).alias("p"), "name"))
    return found.join(known, "name").groupBy("id", "participant").agg(best["name"].alias("name"))


def mention_counts(mentions: DataFrame, chapters: DataFrame, participants: DataFrame) -> DataFrame:
    """For each participant of a broadcast the number of chapters(broadcast_id, id) that name them, and how far the
    broadcast's people are known from its texts."""
    n = mentions.join(chapters.select("broadcast_id", "id"), "id").groupBy("broadcast_id", "participant").agg(F.count_distinct("id").alias("n_chapters"))
    out = participants.select("broadcast_id", "participant").join(n, ["broadcast_id", "participant"], "left").na.fill(0, ["n_chapters"])
    named = F.max("n_chapters").over(W.partitionBy("broadcast_id")) > 0
    return out.withColumn("status", F.when(named, "transcript-mentions").otherwise("catalog-only"))
