"""An extension: frame deduplication over a stream, with the last kept frame of each video as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scrollweave.operators.frames import narrow, plane, ssim


def dedup_stream(frames: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``(video_id, seq)`` of frames that differ from the last kept one of their video. Micro-batches must bring a video's
    frames in order."""
    kind = frames.schema["video_id"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        image = plane(*last) if last else None
        kept = []
        for pdf in sorted(batches, key=lambda p: p.seq.min()):
            for seq, w, h, luma in pdf.sort_values("seq")[["seq", "w", "h", "luma"]].itertuples(index=False):
                now = plane(w, h, luma)
                if now is None:
                    continue
                if image is None or narrow(image).shape != narrow(now).shape or ssim(narrow(image), narrow(now)) < threshold:
                    image, last = now, (int(w), int(h), bytes(luma))
                    kept.append(seq)
        if last:
            state.update(last)
        yield pd.DataFrame({"video_id": [key[0]] * len(kept), "seq": kept})

    return frames.groupBy("video_id").applyInPandasWithState(run, f"video_id {kind}, seq long", "w int, h int, luma binary", "append", GroupStateTimeout.NoTimeout)
