"""Lines from TCP servers that can be read again: a streaming source with offsets.

Every server is a partition's worth of lines of its own.  What arrives is written to a spool in the
shared folder before it is handed out, so that a micro-batch that runs again, after a failure or a new
start, reads the same lines from there; spooled lines go once their micro-batch is committed.

Options: host, port (or several servers as `servers`, "host:port,host:port"), spool (the folder, required),
batchBytes (what a micro-batch takes of a server at most) and timeout (seconds without data after which a
micro-batch ends).  A server that closes the connection is done; its last line counts without a line break too.
"""

from __future__ import annotations

import os
import socket
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BATCH_BYTES = 8_000_000


class Spool:
    """Whole lines of a server as files named by their first and last byte; a file appears at once or not at all."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def spans(self) -> list[tuple[int, int]]:
        return sorted(tuple(map(int, n[:-6].split("-"))) for n in os.listdir(self.folder) if n.endswith(".lines"))

    def path(self, span: tuple[int, int]) -> str:
        return os.path.join(self.folder, f"{span[0]}-{span[1]}.lines")

    def end(self) -> int:
        marks = os.path.join(self.folder, "committed")
        done = int(open(marks).read()) if os.path.exists(marks) else 0
        return max([done, *(e for _, e in self.spans())])

    def append(self, start: int, data: bytes) -> int:
        end = start + len(data)
        self._write(self.path((start, end)), data)
        return end

    def commit(self, end: int) -> None:
        self._write(os.path.join(self.folder, "committed"), str(end).encode())
        for span in self.spans():
            if span[1] <= end:
                os.remove(self.path(span))

    def _write(self, path: str, data: bytes) -> None:
        with open(path + ".new", "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".new", path)

    def read(self, start: int, end: int) -> Iterator[str]:
        for span in self.spans():
            if start <= span[0] and span[1] <= end:
                with open(self.path(span), "rb") as f:
                    for line in f.read().split(b"\n")[:-1]:
                        yield line.decode()


class Lines(InputPartition):
    def __init__(self, folder: str, start: int, end: int):
        self.folder, self.start, self.end = folder, start, end


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if "spool" not in options:
            raise ValueError("the option spool names a folder that driver and executors share")
        self.servers = [s.strip() for s in options.get("servers", f"{options.get('host', 'localhost')}:{options.get('port', 10197)}").split(",")]
        self.most, self.timeout = int(options.get("batchbytes", BATCH_BYTES)), float(options.get("timeout", 1))
        self.spools = {s: Spool(os.path.join(options["spool"], s.replace(":", "_"))) for s in self.servers}
        self.sockets: dict[str, socket.socket | None] = {}
        self.rest = dict.fromkeys(self.servers, b"")

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.servers, 0)

    def latestOffset(self) -> dict:
        return {s: self._receive(s) for s in self.servers}

    def _receive(self, server: str) -> int:
        """Spool the next lines of a server; the place behind them."""
        start = self.spools[server].end()
        if server not in self.sockets:
            host, _, port = server.rpartition(":")
            self.sockets[server] = socket.create_connection((host, int(port)), self.timeout)
        connection, parts, size = self.sockets[server], [self.rest[server]], len(self.rest[server])
        while connection is not None and size < self.most:
            try:
                got = connection.recv(min(1 << 20, self.most - size))
            except TimeoutError:
                break
            if not got:
                connection.close()
                connection = self.sockets[server] = None
                if any(parts) and not b"".join(parts[-2:]).endswith(b"\n"):
                    parts.append(b"\n")
                break
            parts.append(got)
            size += len(got)
        whole, found, self.rest[server] = b"".join(parts).rpartition(b"\n")
        return self.spools[server].append(start, whole + found) if found else start

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        return [Lines(self.spools[s].folder, start.get(s, 0), end[s]) for s in self.servers if end[s] > start.get(s, 0)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        for line in Spool(partition.folder).read(partition.start, partition.end):
            yield (line,)

    def commit(self, end: dict) -> None:
        for server in self.servers:
            self.spools[server].commit(end[server])


class ReplayableLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replayable_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> ReplayReader:
        return ReplayReader({k.lower(): v for k, v in self.options.items()})


def replayable_stream(spark: SparkSession, spool: str, servers: list[str], batch_bytes: int = BATCH_BYTES, timeout: float = 1) -> DataFrame:
    """Lines of TCP servers ("host:port"), which survive a failure of the query; spool must be a shared folder."""
    spark.dataSource.register(ReplayableLines)
    return spark.readStream.format("replayable_lines").option("servers", ",".join(servers)).option("spool", spool).option("batchBytes", batch_bytes).option("timeout", timeout).load()
