"""Streams of motion logs and link measurements, with the state that they need."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ASSEMBLED = "model string, sample_index long, position long, link string, accepted boolean"
DELTAS = "receiver string, frame long, value double, prev_value double, delta_value double, y_change int, y_drop int"


def assemble_samples(poses: DataFrame, links: dict[str, Sequence[str]]) -> DataFrame:
    """Completed samples of a stream of (model, position, link): a sample is emitted when all the model's links have
    come. A link that comes twice, or isn't expected, spoils the model: its later rows are not accepted. State per
    model: the open sample and the number of closed ones. links: the expected links
    of each model, and under * those of all others."""
    expected = {m: frozenset(x) for m, x in links.items()}

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (model,) = key
        index, bad, open_links, open_places = state.get if state.exists else (0, False, [], [])
        open_links, open_places, out = list(open_links), list(open_places), []
        wanted = expected.get(model, expected.get("*", frozenset()))
        for row in pd.concat(list(batches)).sort_values("position").itertuples():
            if bad or row.link not in wanted or row.link in open_links:
                bad = True
                out.append((model, -1, row.position, row.link, False))
                continue
            open_links.append(row.link)
            open_places.append(row.position)
            if len(open_links) == len(wanted):
                out += [(model, index, p, x, True) for p, x in zip(open_places, open_links, strict=True)]
                index, open_links, open_places = index + 1, [], []
        state.update((index, bad, open_links, open_places))
        yield pd.DataFrame(out, columns=["model", "sample_index", "position", "link", "accepted"])

    state = "index long, bad boolean, open_links array<string>, open_places array<long>"
    return poses.select("model", "position", "link").groupBy("model").applyInPandasWithState(step, ASSEMBLED, state, "append", GroupStateTimeout.NoTimeout)


def lag_labels(rows: DataFrame) -> DataFrame:
    """Deltas and labels of a stream of (receiver, frame, value) against the row before of the same receiver, which
    is all the state there is. Rows of a receiver must come in the order of frames, those of a batch in any."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values("frame")
        before = [state.get[0]] if state.exists else []
        values = before + part["value"].tolist()
        state.update((values[-1],))
        frames = part["frame"].tolist()[1 - len(before) :]
        out = [(key[0], f, v, p, v - p, int(v != p), int(v < p)) for f, v, p in zip(frames, values[1:], values, strict=False)]
        yield pd.DataFrame(out, columns=["receiver", "frame", "value", "prev_value", "delta_value", "y_change", "y_drop"])

    return rows.select("receiver", "frame", "value").groupBy("receiver").applyInPandasWithState(step, DELTAS, "value double", "append", GroupStateTimeout.NoTimeout)


def windowed_rates(rows: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows and positive labels per receiver and window, once the watermark has passed it."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), "receiver").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_positive"))


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there, into Parquet files below `folder` (shared by all executors), and reads the
    rows that it gave."""
    done = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
