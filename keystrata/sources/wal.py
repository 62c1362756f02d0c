"""The log of single puts and deletes that no run holds yet.

Each record is a line: CRC-32, length and JSON. Reading stops at the first line that is
torn or does not fit its checksum: what follows it was never acknowledged.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from pathlib import Path

Entry = tuple[bytes, int, bool, bytes | None]


class Wal:
    def __init__(self, path: str):
        self.path = Path(path)
        self.entries, good = self._read()
        self.file = self.path.open("ab")
        if good < self.path.stat().st_size:
            self.file.truncate(good)

    def _read(self) -> tuple[list[Entry], int]:
        out: list[Entry] = []
        good = 0
        if not self.path.exists():
            return out, good
        for line in self.path.open("rb"):
            head, _, body = line.partition(b" ")
            if not line.endswith(b"\n") or head != b"%08x" % zlib.crc32(body):
                break
            k, seq, dead, v = json.loads(body)
            out.append((base64.b64decode(k), seq, dead, None if v is None else base64.b64decode(v)))
            good += len(line)
        return out, good

    def append(self, key: bytes, seq: int, dead: bool, value: bytes | None) -> None:
        body = json.dumps([base64.b64encode(key).decode(), seq, dead, None if value is None else base64.b64encode(value).decode()]).encode() + b"\n"
        self.file.write(b"%08x " % zlib.crc32(body) + body)
        self.file.flush()
        os.fsync(self.file.fileno())

    def reset(self) -> None:
        self.file.truncate(0)
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()
