"""Chunked and online smoothing of unbounded streams, a state per key.

The state is one binary value with the rows that later output still needs: the last ``window_capacity``
rows online, at most a chunk and an overlap for chunks, and the highest ``seq`` that was used. Rows of a
micro-batch are put in the order of ``seq`` first; a row that isn't beyond the highest one comes out with
``late`` set and no value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import kernel
from tideline.operators.chunked import online_values
from tideline.options import Options, UnsupportedFeature
from tideline.sources.series import numeric

_STATE = T.StructType([T.StructField("rows", T.BinaryType()), T.StructField("lap", T.LongType()), T.StructField("edge", T.LongType())])
_OUT = [T.StructField(n, t) for n, t in (("seq", T.LongType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("y_smooth", T.DoubleType()), ("residual", T.DoubleType()), ("robustness_weight", T.DoubleType()), ("late", T.BooleanType()))]


def _run(df: DataFrame, x: str, y: str, seq: str, by: Sequence[str], step, final: str | None, reset: str | None) -> DataFrame:
    from pyspark.sql.streaming.state import GroupStateTimeout

    by = list(by)
    flag = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(False)) if c else F.lit(False)
    base = df.select(*(F.col(f"`{c}`") for c in by), F.col(f"`{seq}`").cast("long").alias("__seq"), numeric(df, x).alias("__x"), numeric(df, y).alias("__y"), flag(final).alias("__final"), flag(reset).alias("__reset"))
    schema = T.StructType([*(base.schema[c] for c in by), *_OUT])

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("__seq", kind="stable")
        held, lap, edge = (np.frombuffer(state.get[0], float).reshape(-1, 5), state.get[1], state.get[2]) if state.exists else (np.zeros((0, 5)), 0, None)
        ends, outs, lates = False, [], []
        # a reset cuts the rows of a micro-batch in two: what came before it is used first
        part = rows["__reset"].cumsum()
        for k, mine in rows.groupby(part, sort=True):
            if k:
                held, lap = held[:0], 0
            control = mine["__final"] | mine["__reset"]
            data = mine[~control | mine["__x"].notna()]
            ends = bool(mine["__final"].any())
            new = np.ones(len(data), bool) if edge is None else (data["__seq"] > edge).to_numpy()
            values = data[["__seq", "__x", "__y"]].to_numpy(float)
            if new.any():
                edge = int(data["__seq"].max())
            out, held, lap = step(held, lap, values[new], ends)
            outs.append(out)
            lates.append(values[~new])
        out, late = np.concatenate(outs), np.concatenate(lates)
        if ends:
            state.remove()
        else:
            state.update((np.ascontiguousarray(held, float).tobytes(), int(lap), edge))
        table = np.concatenate([out, np.column_stack([late, np.full((len(late), 2), np.nan)])]) if len(late) else out
        frame = pd.DataFrame({"seq": table[:, 0].astype(np.int64), "x": table[:, 1], "y": table[:, 2], "y_smooth": table[:, 3], "residual": table[:, 2] - table[:, 3], "robustness_weight": table[:, 4], "late": np.arange(len(table)) >= len(out)})
        for c, v in reversed(list(zip(by, key, strict=True))):
            frame.insert(0, c, v)
        yield frame

    # a stream without keys is one key
    grouped = base.groupBy(*(by or [F.lit(0).alias("__all")]))
    return grouped.applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def online_stream(df: DataFrame, x: str, y: str, seq: str, by: Sequence[str] = (), *, final: str | None = None, reset: str | None = None, **options) -> DataFrame:
    """``by``, seq, x, y, y_smooth, residual, robustness_weight and late for every row of a stream, as
    :func:`tideline.operators.chunked.smooth_online` gives them. A row with ``final`` set ends its key's
    window, one with ``reset`` set empties it before that row; the x of such rows may be null, and then
    they only give the sign."""
    o = Options.of(**({"delta": 0.0} | options))
    if o.level is not None:
        raise UnsupportedFeature("intervals need the whole series")

    def step(held, lap, new, ends):
        rows = np.concatenate([held[:, :3], new])
        fit, rw = online_values(rows[:, 1], rows[:, 2], o, len(held))
        keep = rows[max(0, len(rows) - o.window_capacity) :]
        return np.column_stack([new, fit, rw]), np.column_stack([keep, np.zeros((len(keep), 2))]), 0

    return _run(df, x, y, seq, by, step, final, reset)


def chunk_stream(df: DataFrame, x: str, y: str, seq: str, by: Sequence[str] = (), *, final: str | None = None, reset: str | None = None, **options) -> DataFrame:
    """The columns of :func:`online_stream`, smoothed in chunks of ``chunk_size`` rows in the order of
    ``seq``, each sorted by x. A chunk's last ``overlap`` rows wait to be merged with the next one's fit; a
    row with ``final`` set fits and sends what is left of its key. A row with ``reset`` set drops what waits,
    unsent, before that row. No row is sent twice."""
    o = Options.of(**({"delta": 0.0} | options))
    if o.level is not None:
        raise UnsupportedFeature("intervals need the whole series")

    def merge(a, b, share):
        return {"average": 0.5 * (a + b), "weighted_average": a * (1 - share) + b * share, "take_first": a, "take_last": b}[o.merge]

    def chunk(before, new, ends):
        """Rows to send and the overlap that waits: seq, x, y, fit, robustness weight."""
        new = new[np.argsort(new[:, 1], kind="stable")]
        rows = np.concatenate([before[:, :3], new])
        if not len(new):
            return before, before[:0]
        if len(rows) > 1:
            kernel.check(rows[:, 1], rows[:, 2])
            fit, _, rw, _ = kernel.fit_sorted(rows[:, 1], rows[:, 2], None, o, o.fraction, o.delta if o.delta is not None else kernel.auto_delta(rows[:, 1]))
        else:
            fit, rw = rows[:, 2].copy(), np.ones(1)
        n = len(before)
        if n:
            share = np.arange(n) / n
            fit[:n], rw[:n] = merge(before[:, 3], fit[:n], share), merge(before[:, 4], rw[:n], share)
        full = np.column_stack([rows, fit, rw])
        cut = len(full) if ends else max(n, len(full) - o.overlap)
        return full[:cut], full[cut:]

    def step(held, lap, new, ends):
        before, waiting, out = held[:lap], np.concatenate([held[lap:, :3], new]), []
        while len(waiting) >= o.chunk_size:
            done, before = chunk(before, waiting[: o.chunk_size], False)
            out.append(done)
            waiting = waiting[o.chunk_size :]
        if ends:
            done, before = chunk(before, waiting, True)
            out += [done, before]
            waiting, before = waiting[:0], before[:0]
        keep = np.concatenate([before, np.column_stack([waiting, np.zeros((len(waiting), 2))])])
        return np.concatenate([*out, np.zeros((0, 5))]), keep, len(before)

    return _run(df, x, y, seq, by, step, final, reset)
