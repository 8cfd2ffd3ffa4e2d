"""Caption tracks and channel feeds as data sources of Spark: ``spark.read.format("caption_json3").load(folder)``.

Files are parsed in the tasks, some for each partition, and come with their path; the same names serve ``readStream``,
where an offset is a point in modification time: a restarted stream goes on behind it and reads no file twice. Files that are no track or feed, and those over ``most_bytes``, give no rows. Folders are local paths or mounts that
driver and executors share; other stores are read by ``documents.read_captions_json3`` and ``read_atom_feed``, whose rows
these equal.
"""

from __future__ import annotations

import glob
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .documents import CUE_CHARS, MOST_CUES

#: Files of a partition.
PER_PARTITION = 64


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _listed(folder: str, pattern: str) -> list[str]:
    return sorted(p for p in glob.glob(os.path.join(folder.removeprefix("file://"), pattern)) if os.path.isfile(p))


def _chunks(paths: list[str], size: int) -> list[Files]:
    return [Files(paths[k : k + size]) for k in range(0, len(paths), size)]


def caption_cues(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(cue, start_ms, duration_ms, text) of a caption track: joined, cleaned, without empty ones and repeats of the last."""
    try:
        events = json.loads(text)["events"]
    except (ValueError, KeyError, TypeError):
        return
    cue, last = 0, None
    for event in events if isinstance(events, list) else []:
        if not isinstance(event, dict):
            continue
        start, length = event.get("tStartMs"), event.get("dDurationMs") or 0
        parts = event.get("segs")
        joined = "".join(s.get("utf8") or "" for s in parts if isinstance(s, dict)) if isinstance(parts, list) else ""
        plain = "".join(" " if unicodedata.category(c) in ("Cc", "Cf") else c for c in unicodedata.normalize("NFKC", joined))
        plain = " ".join(plain.split())[:CUE_CHARS].strip()
        if type(start) is not int or type(length) is not int or start < 0 or length < 0 or not plain or (start, plain) == last:
            continue
        cue, last = cue + 1, (start, plain)
        if cue > MOST_CUES:
            return
        yield cue, start, length, plain


_FIELDS = {f: re.compile(rf"<{t}>\s*(.*?)\s*</{t}>", re.S) for f, t in (("video", "yt:videoId"), ("channel", "yt:channelId"), ("title", "title"), ("published", "published"), ("updated", "updated"))}


def _instant(text: str) -> datetime | None:
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def feed_entries(text: str) -> Iterator[tuple]:
    """(video_id, channel_id, title, published_at, updated_at) of a feed without document type or entities."""
    if re.search("<!DOCTYPE|<!ENTITY", text.upper()):
        return
    for entry in re.findall(r"<entry>(.*?)</entry>", text, re.S):
        found = {f: (m[1] if (m := p.search(entry)) else "") for f, p in _FIELDS.items()}
        yield found["video"], found["channel"], found["title"], _instant(found["published"]), _instant(found["updated"])


class _Reading:
    """What a batch and a stream have in common: options, and the rows of some files."""

    def __init__(self, options: dict, parse, pattern: str):
        if "path" not in options:
            raise ValueError("a folder must be named by load(folder)")
        self.folder, self.pattern, self.parse = options["path"], options.get("pattern", pattern), parse
        self.most_bytes, self.per_partition = int(options.get("most_bytes", 2_000_000)), int(options.get("per_partition", PER_PARTITION))

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            if os.path.getsize(path) <= self.most_bytes:
                with open(path, encoding="utf-8-sig", errors="replace") as f:
                    for row in self.parse(f.read()):
                        yield path, *row


class FolderReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return _chunks(_listed(self.folder, self.pattern), self.per_partition) or [Files([])]


class FolderStream(_Reading, DataSourceStreamReader):
    """The offset holds the greatest modification time taken and the names taken at it: a file is new if it comes after
    that point. Its size does not grow with the files."""

    def initialOffset(self) -> dict:
        return {"ns": -1, "names": "[]"}

    def _stamped(self) -> list[tuple[int, str]]:
        return sorted((os.stat(p).st_mtime_ns, p) for p in _listed(self.folder, self.pattern))

    def latestOffset(self) -> dict:
        found = self._stamped()
        if not found:
            return self.initialOffset()
        last = found[-1][0]
        return {"ns": last, "names": json.dumps([p for ns, p in found if ns == last])}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        began, ended = set(json.loads(start["names"])), set(json.loads(end["names"]))
        after = lambda ns, p: ns > start["ns"] or ns == start["ns"] and p not in began
        until = lambda ns, p: ns < end["ns"] or ns == end["ns"] and p in ended
        return _chunks([p for ns, p in self._stamped() if after(ns, p) and until(ns, p)], self.per_partition)

    def commit(self, end: dict) -> None:
        """Offsets are all that is kept."""


class _Source(DataSource):
    columns, pattern, parse = "", "*", staticmethod(lambda text: iter(()))

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options, type(self).parse, self.pattern)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderStream(self.options, type(self).parse, self.pattern)


class CaptionJson3(_Source):
    columns, pattern, parse = "file string, cue int, start_ms long, duration_ms long, text string", "*.json*", staticmethod(caption_cues)

    @classmethod
    def name(cls) -> str:
        return "caption_json3"


class ChannelFeed(_Source):
    columns, pattern, parse = "file string, video_id string, channel_id string, title string, published_at timestamp, updated_at timestamp", "*.xml", staticmethod(feed_entries)

    @classmethod
    def name(cls) -> str:
        return "channel_feed"


def register(spark: SparkSession) -> None:
    """Make both names known to the session."""
    spark.dataSource.register(CaptionJson3)
    spark.dataSource.register(ChannelFeed)
