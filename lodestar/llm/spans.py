"""Spans (kind, start, end) in code points: how base ones are found and all are written."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[int, int, int]  # start, place of the kind in the list of kinds, end


def written(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def digest(spans: list[Span], kinds: list[str]) -> str:
    return hashlib.sha256(written(spans, kinds).encode()).hexdigest()


class Cover:
    """What spans cover: the places of their union, to be asked in logarithmic time."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for a, _, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        """Whether [a, b) and the union have a place in common."""
        i = bisect.bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a


def all_written(base: Column, added: Column, kinds: list[str], new: str) -> Column:
    """The same in SQL: base spans (array of struct start, kind, end) and added ones (array of struct start, end) of one new kind, listed last."""
    names = F.array(*[F.lit(k) for k in [*kinds, new]])
    more = F.transform(added, lambda x: F.struct(x["start"].alias("start"), F.lit(len(kinds)).alias("kind"), x["end"].alias("end")))
    both = F.array_sort(F.concat(base, more))
    return F.array_join(F.transform(both, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
