"""Where records go: ``file:``, ``syslog:`` and ``unix:`` targets, for batches and for streams.

Files are Spark's own JSON lines.  The other two send each partition's lines
from where it is; no record is dropped while a target is down: the task
fails and is tried again.
"""

from __future__ import annotations

import socket
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.headers import FACILITIES


def live_json(df: DataFrame, scores: tuple[str, ...] = ("dga_score", "vpn_score", "dot_score", "doh_score")) -> Column:
    """A flat record of all columns, scores with two decimals."""
    return F.to_json(F.struct(*(F.format_string("%.2f", c).alias(c) if c in scores else F.col(c) for c in df.columns)))


def _send(target: str) -> Callable[[list[str]], None]:
    scheme, _, rest = target.partition(":")

    def unix(lines: list[str]) -> None:
        with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
            s.connect(rest)
            for line in lines:
                s.sendall(line.encode() + b"\n")

    def syslog(lines: list[str]) -> None:
        import syslog as log

        log.openlog("flows", facility=getattr(log, f"LOG_{(rest or 'local0').upper()}", log.LOG_LOCAL0))
        for line in lines:
            log.syslog(log.LOG_INFO, line)

    if scheme == "unix":
        return unix
    if scheme == "syslog" and (rest or "local0") in FACILITIES:
        return syslog
    raise ValueError(f"no such target: {target}")


def write_lines(df: DataFrame, target: str, column: str = "json") -> None:
    """Write a column of text to ``file:path``, ``syslog:facility`` or ``unix:path``."""
    if target.startswith("file:"):
        df.select(column).write.mode("append").text(target.removeprefix("file:"))
        return
    send = _send(target)

    def part(rows):
        held = []
        for r in rows:
            held.append(r[0])
            if len(held) == 256:
                send(held)
                held = []
        if held:
            send(held)

    df.select(column).foreachPartition(part)


def stream_lines(df: DataFrame, target: str, checkpoint: str, column: str = "json"):
    """The same for a stream; returns the running query."""
    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: write_lines(batch, target, column)).start()
