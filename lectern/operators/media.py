"""Timed lines and frames: operators that fold over one recording in order.

A recording's lines are one group by nature (hours, not terabytes), so they run
in ``applyInArrow``-style grouped maps; recordings spread over the cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import map_frames


def rolling_dedupe(cues: DataFrame, key: str, order: str, text: str, back: int = 3) -> DataFrame:
    """Drops a line that repeats one of the last ``back`` kept lines, and lets a
    line that only extends the previous one replace it."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        kept: list[tuple] = []
        for row in group.itertuples(index=False):
            line = (getattr(row, text) or "").strip()
            if not line or any(line == old[2] for old in kept[-back:]):
                continue
            if kept and line.startswith(kept[-1][2]):
                kept[-1] = (kept[-1][0], kept[-1][1], line)
            else:
                kept.append((getattr(row, key), getattr(row, order), line))
        return pd.DataFrame(kept, columns=[key, order, text])

    types = dict(cues.dtypes)
    return cues.select(key, order, text).groupBy(key).applyInPandas(fold, f"{key} {types[key]}, {order} {types[order]}, {text} string")


def chapters(cues: DataFrame, key: str, order: str, start: str, end: str, text: str, target: float) -> DataFrame:
    """Chapter starts near every ``target`` seconds: of the lines within half a
    target of the wanted time, the one with the best mix of silence before it, a
    sentence end before it, and nearness."""

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order).reset_index(drop=True)
        s, e, said = group[start].tolist(), group[end].tolist(), group[text].fillna("").tolist()
        cuts, wanted = [0], s[0] + target
        while wanted < e[-1] - target / 2:
            best, weight = None, None
            for i in range(cuts[-1] + 1, len(s)):
                if abs(s[i] - wanted) > target / 2:
                    continue
                w = min(s[i] - e[i - 1], 3.0) + (1.0 if said[i - 1].rstrip()[-1:] in ".!?…" else 0.0) - abs(s[i] - wanted) / target
                if weight is None or w > weight:
                    best, weight = i, w
            if best is not None:
                cuts.append(best)
                wanted = s[best] + target
            else:
                wanted += target
        ends = [s[j] for j in cuts[1:]] + [e[-1]]
        return pd.DataFrame({key: group[key].iloc[0], "chapter": range(len(cuts)), "start": [s[j] for j in cuts], "end": ends})

    kind = dict(cues.dtypes)[key]
    return cues.select(key, order, F.col(start).cast("double"), F.col(end).cast("double"), text).groupBy(key).applyInPandas(cut, f"{key} {kind}, chapter bigint, start double, end double")


def drift_segments(frames: DataFrame, key: str, order: str, vector: str, least: float) -> DataFrame:
    """Segments of frames: a frame whose cosine with the segment's first frame is
    below ``least`` begins the next segment."""
    import numpy as np

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        anchor, number, numbers = None, -1, []
        for v in group[vector]:
            v = np.asarray(v, float)
            n = np.linalg.norm(v) * (np.linalg.norm(anchor) if anchor is not None else 1)
            if anchor is None or n == 0 or v @ anchor / n < least:
                anchor, number = v, number + 1
            numbers.append(number)
        return pd.DataFrame({key: group[key], order: group[order], "segment": numbers})

    types = dict(frames.dtypes)
    return frames.select(key, order, vector).groupBy(key).applyInPandas(fold, f"{key} {types[key]}, {order} {types[order]}, segment bigint")


# Lines that speech recognition invents over silence.
INVENTED = ("thanks for watching", "thank you for watching", "subtitles by", "gracias por ver", "subtitulos por", "suscribete")


def invented(text):
    """Whether a line is one that recognisers make up."""
    from ..functions.text import fold, squeeze

    s = squeeze(F.regexp_replace(fold(text), r"[^\p{L}\p{N} ]", " "))
    out = F.lit(False)
    for phrase in INVENTED:
        out = out | s.startswith(phrase)
    return out


def collapsed(text: str, least: int = 4, longest: int = 4) -> tuple[str, int]:
    """A text whose phrases of one to ``longest`` words that repeat ``least`` times
    in a row stand once, and how many such loops there were."""
    words, out, loops, i = text.split(), [], 0, 0
    while i < len(words):
        for n in range(1, longest + 1):
            phrase, k = words[i : i + n], 1
            while len(phrase) == n and words[i + k * n : i + (k + 1) * n] == phrase:
                k += 1
            if k >= least:
                out += phrase
                i += k * n
                loops += 1
                break
        else:
            out.append(words[i])
            i += 1
    return " ".join(out), loops


def collapse_loops(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, loops)."""

    def run(batches):
        for batch in batches:
            done = [collapsed(x or "") for x in batch[text]]
            yield pd.DataFrame({key: batch[key], text: [d[0] for d in done], "loops": [d[1] for d in done]})

    return map_frames(rows.select(key, text), run, f"{key} {dict(rows.dtypes)[key]}, {text} string, loops bigint")
