"""Line differences of text pairs by an exact longest common subsequence (Arrow batches, one pair at a time)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAP = 4000  # lines per side after equal ends are cut; beyond it the middle counts as replaced


def script(before: list[str], after: list[str]) -> list[tuple[str, int, int]]:
    """``(op, i, j)`` with op '=', '-' or '+': a shortest edit script, deletions before insertions where both are possible."""
    lo = 0
    while lo < len(before) and lo < len(after) and before[lo] == after[lo]:
        lo += 1
    hi = 0
    while hi < len(before) - lo and hi < len(after) - lo and before[-1 - hi] == after[-1 - hi]:
        hi += 1
    a, b = before[lo : len(before) - hi], after[lo : len(after) - hi]
    out = [("=", i, i) for i in range(lo)]
    if max(len(a), len(b)) > CAP:
        out += [("-", lo + i, lo) for i in range(len(a))] + [("+", lo + len(a), lo + j) for j in range(len(b))]
    elif a or b:
        ids: dict[str, int] = {}
        x = np.array([ids.setdefault(s, len(ids)) for s in a], np.int64)
        y = np.array([ids.setdefault(s, len(ids)) for s in b], np.int64)
        # rows[i] holds the lengths for a[i:] against every suffix of b; each row is a running maximum of the one below
        rows = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        for i in range(len(a) - 1, -1, -1):
            diag = rows[i + 1, 1:] + (y == x[i])
            best = np.maximum(rows[i + 1, :-1], diag)
            rows[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
        i = j = 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and x[i] == y[j]:
                out.append(("=", lo + i, lo + j))
                i, j = i + 1, j + 1
            elif i < len(a) and (j == len(b) or rows[i + 1, j] >= rows[i, j + 1]):
                out.append(("-", lo + i, lo + j))
                i += 1
            else:
                out.append(("+", lo + i, lo + j))
                j += 1
    return out + [("=", len(before) - hi + k, len(after) - hi + k) for k in range(hi)]


def unified(before: list[str], after: list[str], context: int = 4, most: int = 160) -> str:
    """Windows of changed lines with context; what is left out is said in the text."""
    ops = script(before, after)
    near = np.zeros(len(ops), bool)
    for k, (op, _, _) in enumerate(ops):
        if op != "=":
            near[max(0, k - context) : k + context + 1] = True
    lines, skipped = [], 0
    for keep, (op, i, j) in zip(near, ops):
        if not keep:
            skipped += 1
            continue
        if skipped:
            lines.append(f"... {skipped} equal lines ...")
            skipped = 0
        lines.append({"=": " ", "-": "-", "+": "+"}[op] + (after[j] if op == "+" else before[i]))
    if len(lines) > most:
        lines = lines[:most] + [f"... {len(lines) - most} more lines ..."]
    return "\n".join(lines)


def line_diff(pairs: DataFrame, keys: Sequence[str], before: str = "before", after: str = "after") -> DataFrame:
    """``keys, added, deleted, equal, diff`` of each pair of texts; null counts as empty."""
    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", added int, deleted int, equal int, diff string"

    def lines(t: str | None) -> list[str]:
        return t.replace("\r\n", "\n").replace("\r", "\n").split("\n") if t else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added, deleted, equal, texts = [], [], [], []
            for x, y in zip(batch.column(before).to_pylist(), batch.column(after).to_pylist()):
                a, b = lines(x), lines(y)
                ops = [o for o, _, _ in script(a, b)]
                added.append(ops.count("+"))
                deleted.append(ops.count("-"))
                equal.append(ops.count("="))
                texts.append(unified(a, b))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(added, pa.int32()), pa.array(deleted, pa.int32()), pa.array(equal, pa.int32()), pa.array(texts, pa.string())], names=[*keys, "added", "deleted", "equal", "diff"])

    return pairs.select(*keys, F.col(before), F.col(after)).mapInArrow(run, schema)
