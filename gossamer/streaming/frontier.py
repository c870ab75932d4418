"""The crawl frontier as a stream: every URL passes once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gossamer.functions import urls
from gossamer.operators import links
from gossamer.operators.lineage import cut
from gossamer.operators.seen import SeenUrls


def discovered_stream(pages: DataFrame) -> DataFrame:
    """Distinct new targets of a stream of pages (page_id, url, html); the state is the set of seen URLs."""
    found = links.on_site(links.extract(pages))
    return found.select(F.col("target").alias("url"), urls.authority(F.col("target")).alias("site")).dropDuplicates(["url"])


def feed_back(frontier: DataFrame, pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the pages of new URLs to `folder`, the source of the next expansion, batch by batch."""

    def append(batch: DataFrame, _: int) -> None:
        pages.join(batch.select("url"), "url", "left_semi").write.mode("append").parquet(folder)

    return frontier.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def targets(pages: DataFrame) -> DataFrame:
    """(url, site) of the links of a stream of pages (page_id, url, html), repeated as they are: no state."""
    return links.on_site(links.extract(pages)).select(F.col("target").alias("url"), urls.authority(F.col("target")).alias("site"))


def feed_new(found: DataFrame, seen: SeenUrls, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives the URLs of each batch of `found` (url, ..) that no batch had to `take`, with the number of the batch.

    What was seen is in the store of `seen`, not in the query's state, which so has no row however long it runs.  A
    batch counts as seen once it is taken: one that failed before is given again, under its number, and one that is
    played again later finds its URLs in the store and gives none.
    """

    def step(batch: DataFrame, number: int) -> None:
        new = cut(seen.new(batch.dropDuplicates(["url"])))
        if not new.isEmpty():
            take(new, number)
            seen.add(new)

    return found.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PACED = "site string, url string, release_ms long"


def paced(found: DataFrame, delay: float) -> DataFrame:
    """(site, url, release_ms) of a stream `found` (site, url), on each site one URL every `delay` seconds.

    Each site's state is the queue of its waiting URLs and the time from which the next one may go; a timer wakes the
    site when that is due, whether new URLs come or not, and the state ends with the queue's last release.
    """
    step = max(1, int(delay * 1000))

    def release(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, due = state.get if state.exists else ([], 0)
        waiting = [*waiting, *(u for frame in frames for u in frame["url"])]
        now, out = state.getCurrentProcessingTimeMs(), []
        if waiting and due <= now:
            out, waiting, due = [(key[0], waiting[0], now)], waiting[1:], now + step
        if waiting or due > now:
            state.update((waiting, due))
            state.setTimeoutDuration(max(1, due - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["site", "url", "release_ms"])

    return found.groupBy("site").applyInPandasWithState(release, PACED, "waiting array<string>, due long", "append", GroupStateTimeout.ProcessingTimeTimeout)
