"""Messages by offset, in files that outlast the process: what a source has given out it can give out again."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

_NAME = re.compile(r"(\d{20})-(\d{20})\.segment$")


class MemoryLog:
    """The same in memory, for sources without a folder: what was not committed is lost with the process."""

    def __init__(self):
        self.start, self.messages = 0, []

    @property
    def end(self) -> int:
        return self.start + len(self.messages)

    def append(self, messages: list[str], at_least: int = 0) -> None:
        if not self.messages:
            self.start = max(self.start, at_least)
        self.messages += messages

    def read(self, start: int, end: int) -> Iterator[str]:
        yield from self.messages[max(0, start - self.start) : max(0, end - self.start)]

    def forget(self, end: int) -> None:
        gone = min(max(0, end - self.start), len(self.messages))
        self.messages = self.messages[gone:]
        self.start += gone


class Spool:
    """Segments ``<first offset>-<offset behind the last>.segment`` of JSON lines. A segment is complete once it has its name."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def segments(self) -> list[tuple[int, int, Path]]:
        found = ((_NAME.match(p.name), p) for p in self.folder.iterdir())
        return sorted((int(m[1]), int(m[2]), p) for m, p in found if m)

    @property
    def end(self) -> int:
        return max((b for _, b, _ in self.segments()), default=0)

    def append(self, messages: list[str], at_least: int = 0) -> None:
        """On disk when this returns. ``at_least``: offsets begin there if the folder is behind it."""
        if not messages:
            return
        start = max(self.end, at_least)
        tmp = self.folder / f".{os.getpid()}-{start}"
        with tmp.open("w", encoding="utf-8") as f:
            f.writelines(json.dumps(m) + "\n" for m in messages)
            f.flush()
            os.fsync(f.fileno())
        tmp.rename(self.folder / f"{start:020d}-{start + len(messages):020d}.segment")
        folder = os.open(self.folder, os.O_RDONLY)
        try:
            os.fsync(folder)  # the name as well
        finally:
            os.close(folder)

    def read(self, start: int, end: int) -> Iterator[str]:
        for a, b, path in self.segments():
            if a < end and b > start:
                with path.open(encoding="utf-8") as f:
                    for k, line in enumerate(f, a):
                        if start <= k < end:
                            yield json.loads(line)

    def forget(self, end: int) -> None:
        """Segments wholly before ``end`` go, but for the last one, which says where offsets go on."""
        for _, b, path in self.segments()[:-1]:
            if b <= end:
                path.unlink(missing_ok=True)
