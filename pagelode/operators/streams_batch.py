"""Stream transcripts, socket logs and style-sheet budgets in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.core import first_items, first_rows, head, running, seq_bucket, strip, rank_all, top_per_group
from ..session import cut_lineage


def split_frames(streams: DataFrame) -> DataFrame:
    """Frames of buffered transcripts: event blocks or lines, trimmed, at most 200.

    Works inside each row, so no shuffle: stream_key, content_type, text -> pos, frame.
    """
    events = F.lower(F.coalesce("content_type", F.lit(""))).contains("text/event-stream")
    raw = F.when(events, F.split("text", "\n\n+")).otherwise(F.split("text", "\r?\n"))
    frames = F.filter(F.transform(raw, lambda f: strip(f)), lambda f: f != "")
    cut = F.transform(first_items(frames, R.MAX_FRAMES), lambda f: head(f, R.MAX_FRAME_CHARS))
    return streams.select("stream_key", F.posexplode(cut).alias("pos", "frame"))


def socket_frames(log: DataFrame) -> DataFrame:
    """Numbered frames of sockets, with a direction prefix.

    ``log`` is (socket, seq, direction, payload, is_binary).
    """
    if R.MAX_SOCKETS is not None:
        first = first_rows(log.groupBy("socket").agg(F.min("seq").alias("opened")), ["opened"], R.MAX_SOCKETS)
        log = log.join(first.select("socket"), "socket", "left_semi")
    kept = (rank_all(log, ["socket"], ["seq"], "frame_no") if R.MAX_FRAMES is None
            else top_per_group(log, ["socket"], [F.col("seq")], R.MAX_FRAMES, "frame_no"))
    payload = F.when(F.col("is_binary"), F.lit("[binary]")).otherwise(
        head(F.col("payload"), R.MAX_FRAME_CHARS))
    return kept.select("socket", "frame_no", F.concat("direction", F.lit(": "), payload).alias("frame"))


def stylesheet_budget(sheets: DataFrame, budget: int | None = R.MAX_STYLESHEET_BYTES) -> DataFrame:
    """Style sheets kept in order while they fit a byte budget; all without one.

    A sheet that does not fit is passed over and smaller ones behind it may still
    fit. Each round takes the longest run that fits, then drops what is larger
    than the rest of the budget; the driver only sees two numbers per round.
    """
    if budget is None:
        return sheets
    sized = sheets.withColumn("_size", F.octet_length("css").cast("long"))
    left, after, kept = budget, None, None
    while True:
        open_rows = sized.filter(F.col("_size") <= left)
        if after is not None:
            open_rows = open_rows.filter(F.col("seq") > after)
        summed = running(open_rows, [], ["seq"], seq_bucket(), {"_used": ("sum", F.col("_size"))})
        run = cut_lineage(summed.filter(F.col("_used") <= left).select("seq", "_size", "_used"))
        last = run.agg(F.max("seq"), F.max("_used")).first()
        if last[0] is None:
            break
        kept = run.select("seq") if kept is None else kept.unionByName(run.select("seq"))
        after, left = last[0], left - last[1]
    if kept is None:
        return sheets.limit(0)
    return sheets.join(kept, "seq", "left_semi")


