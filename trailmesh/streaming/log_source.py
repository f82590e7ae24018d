"""An event log in verified chunks as a stream that can be replayed from any event.

``spark.readStream.format("trailmesh_log").load(path)`` with the options ``start`` (events before
it are left out), ``most`` (events of a micro-batch at most) and ``progress`` (a shared folder of this
query's own). Offsets are event numbers, so a seek is a new query with another start.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..shipping import ship
from ..sources.chunksource import _at, _read, _there, read_manifest, verified_bytes
from ..sources.records import decode_chunk

FORMAT = "trailmesh_log"
MOST = 1_000_000


@dataclass
class LogPart(InputPartition):
    """The events of one chunk after ``after``, up to ``upto``."""

    chunk: dict
    after: int
    upto: int


class LogReader(DataSourceStreamReader):
    """Admits ``most`` events a batch. How far the query was planned is noted in its progress folder, as a restarted
    source isn't told: a batch that Spark plans again notes its end anew, so the note never falls behind the query's own log."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most, self.progress = options["path"], int(options.get("most", MOST)), options["progress"]
        self.start = int(options.get("start", 0))
        self.manifest = read_manifest(self.path, options.get("root"))
        self.last = max([0, *(int(c["end"]) for c in self.manifest["chunks"])])
        self.at = max(self.start, self._noted())

    def _noted(self) -> int:
        files, top = _at(self.progress)
        return json.loads(_read(files, f"{top}/planned.json"))["event"] if _there(files, f"{top}/planned.json") else 0

    def _note(self, event: int) -> None:
        files, top = _at(self.progress)
        files.create_dir(top)
        draft = f"{top}/draft-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as f:
            f.write(json.dumps({"event": event}).encode())
        files.move(draft, f"{top}/planned.json")

    def initialOffset(self) -> dict:
        return {"event": self.start}

    def latestOffset(self) -> dict:
        return {"event": max(self.at, min(self.at + self.most, self.last))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["event"] > self.at:
            self._note(end["event"])
            self.at = end["event"]
        after, upto = start["event"], end["event"]
        return [LogPart(c, after, upto) for c in self.manifest["chunks"] if int(c["end"]) > after and int(c["start"]) <= upto]

    def read(self, partition: LogPart) -> Iterator[pa.RecordBatch]:
        raw = decode_chunk(verified_bytes(self.path, partition.chunk), partition.chunk["decodedBytes"])
        with pa.ipc.open_stream(raw) as found:
            for b in found:
                event = b.column(self.manifest["key"])
                yield b.filter(pc.and_(pc.greater(event, partition.after), pc.less_equal(event, partition.upto)))


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(read_manifest(self.options["path"])["fields"])

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(self.options)


def log_stream(spark: SparkSession, path: str, progress: str, start: int = 0, most: int = MOST) -> DataFrame:
    """The events after ``start`` of a chunked log, in order by batches of ``most`` events at most.

    A query that is restarted on its checkpoint goes on where it was, with the same ``progress`` folder. A seek, forward
    or back, is a new query with another start, checkpoint and progress folder.
    """
    ship(spark)
    spark.dataSource.register(LogSource)
    return spark.readStream.format(FORMAT).option("progress", progress).option("start", start).option("most", most).load(path)
