"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic.

An item uses three resources of a container: tokens, one segment, and loss-bearing tokens. While a
container is open, the item is chosen whose demand has the largest dot product with what is left,
among those that fit. Items larger than a container are cut into full containers and a rest.

The token limit is that of the container kind. The other two keep containers alike: none may hold more than
``LOSS_SLACK`` times its fair share of the loss-bearing tokens of its kind, nor more than ``SEGMENT_SLACK`` times the mean
number of segments. Fair shares cannot force room to stay empty over all containers together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratograph.session import cut

PLACED_SCHEMA = "spec_id int, cell long, bin int, position int, doc_id long, piece int, token_start long, token_end long, loss_tokens long, fill double, fullest double"
#: Items packed together in one task; cells beyond it only leave more room for choice.
CELL = 4000
#: Loss-bearing tokens and segments a container may hold, as multiples of the mean of its kind.
LOSS_SLACK, SEGMENT_SLACK = 1.02, 6.0
#: Containers that use less than this of every resource in the first pass are emptied and packed again across cells.
REPACK_BELOW = 0.97


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_limit: int) -> list[list[int]]:
    """Bins as lists of item indexes; every item must fit by its tokens.

    An item with more loss-bearing tokens than the limit needs all of a container's share: it is never cut, and only
    items without such tokens join it. Items of equal demand are one class, so a step looks at each class once, and
    takes as many of the chosen class as stay the best choice while they fit. What the heuristic
    leaves open by a few tokens is closed by the largest class that still fits. Ties go to the
    larger item and then the smaller index: the result does not depend on chance.
    """
    if len(tokens) and (tokens.max() > capacity or segments < 1):
        raise ValueError("an item is larger than a container")
    loss = np.minimum(loss, loss_limit)
    order = np.lexsort((np.arange(len(tokens)), loss, tokens))
    demand, first, left = np.unique(np.stack([tokens, loss], axis=1)[order], axis=0, return_index=True, return_counts=True)
    taken = first.copy()  # next item of each class, in ``order``
    size, weight = demand[:, 0] / max(1, capacity), demand[:, 1] / max(1, loss_limit)
    t, q, left = demand[:, 0].astype(np.int64), demand[:, 1].astype(np.int64), left.astype(np.int64)
    bins: list[list[int]] = []
    there = len(left)
    while there:
        room_t, room_s, room_q, items = capacity, segments, loss_limit, []
        while room_s > 0:
            # classes are in order of tokens: those that fit by tokens are a prefix
            stop = int(np.searchsorted(t, room_t, side="right"))
            product = size[:stop] * (room_t / max(1, capacity)) + weight[:stop] * (room_q / max(1, loss_limit))
            # every item takes one segment, so that part of the product is the same for all
            product = np.where((left[:stop] > 0) & (q[:stop] <= room_q), product, -1.0)
            if not stop or (best := product.max()) < 0:
                break
            k = stop - 1 - int(np.argmax(product[::-1] == best))
            n = min(int(left[k]), room_s, *([room_t // int(t[k])] if t[k] else []), *([room_q // int(q[k])] if q[k] else []))
            # more than one at once only while the class would be chosen again
            n = n if t[k] * 2 <= room_t else 1
            items += order[taken[k]:taken[k] + n].tolist()
            taken[k] += n
            left[k] -= n
            room_t, room_q, room_s = room_t - n * int(t[k]), room_q - n * int(q[k]), room_s - n
            if not left[k]:
                there -= 1
        bins.append(items)
        if there * 2 < len(left):  # classes that are used up are dropped now and then
            keep = left > 0
            size, weight, t, q, left, taken = size[keep], weight[keep], t[keep], q[keep], left[keep], taken[keep]
    return bins


def _pack_cell(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    capacity, segments, loss_limit = (int(frame[c].iloc[0]) for c in ("capacity", "segment_limit", "loss_limit"))
    size, loss = (frame["token_end"] - frame["token_start"]).to_numpy(), frame["loss_tokens"].to_numpy()
    bins = pack(size, loss, capacity, segments, loss_limit)
    counts = np.array([len(b) for b in bins])
    number = np.repeat(np.arange(len(bins)), counts)
    out = frame.iloc[np.concatenate([np.asarray(b, dtype=int) for b in bins])].reset_index(drop=True)
    used, lost = np.bincount(number, size[np.concatenate(bins).astype(int)]), np.bincount(number, loss[np.concatenate(bins).astype(int)])
    fullest = np.maximum(np.maximum(used / capacity, lost / loss_limit), counts / segments)
    out = out.assign(bin=number, position=np.concatenate([np.arange(c) for c in counts]), fill=(used / capacity)[number], fullest=fullest[number])
    return out[["spec_id", "cell", "bin", "position", "doc_id", "piece", "token_start", "token_end", "loss_tokens", "fill", "fullest"]]


def items_of(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """Items per container kind: texts, or pieces of texts larger than it.

    A spec takes the documents of its source, all documents where that is null. Specs without a
    positive capacity or without documents have no items. ``specs`` is small by nature; the join is
    by source and left to its size.
    """
    kinds = specs.filter("capacity_tokens > 0 AND spec_id IS NOT NULL").dropDuplicates(["spec_id"]).select("spec_id", F.col("capacity_tokens").cast("long").alias("capacity"), F.lower(F.trim("source")).alias("source"))
    # documents meet the specs of their source and those of all sources under a second key
    wanted = kinds.withColumn("key", F.coalesce("source", F.lit("\0all"))).drop("source")
    docs = sizes.withColumn("key", F.explode(F.array_compact(F.array(F.col("source"), F.lit("\0all")))))
    both = docs.join(F.broadcast(wanted), "key")  # a parameter table: one row per kind of container
    pieces = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("tokens") / F.col("capacity")))
    out = both.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    start, end = F.col("piece") * F.col("capacity"), F.least((F.col("piece") + 1) * F.col("capacity"), F.col("tokens"))
    # loss-bearing tokens of a piece: its share, rounded so that the pieces add up to the text
    share = lambda x: F.floor(F.when(F.col("tokens") > 0, F.col("loss_tokens") * x / F.col("tokens")).otherwise(0))
    return out.select("spec_id", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), start.alias("token_start"), end.alias("token_end"), (share(end) - share(start)).cast("long").alias("loss_tokens"))


def limits(items: DataFrame, loss_slack: float = LOSS_SLACK, segment_slack: float = SEGMENT_SLACK) -> DataFrame:
    """(spec_id, items, loss_limit, segment_limit): one row per spec.

    The loss limit is ``loss_slack`` times the capacity times the share of loss-bearing tokens in the spec's items, at most the
    capacity; the segment limit ``segment_slack`` times the mean number of items a full container holds. Both are at least 1.
    """
    size = F.col("token_end") - F.col("token_start")
    told = items.groupBy("spec_id").agg(F.count("*").alias("items"), F.max("capacity").alias("_c"), F.sum(size).alias("_t"), F.sum("loss_tokens").alias("_q"))
    share = F.when(F.col("_t") > 0, F.col("_q") / F.col("_t")).otherwise(1.0)
    each = F.greatest(F.lit(1.0), F.col("_t") / F.col("items"))
    return told.select("spec_id", "items", F.greatest(F.lit(1), F.least(F.col("_c"), F.ceil(F.col("_c") * share * loss_slack))).cast("long").alias("loss_limit"),
                       F.greatest(F.lit(1), F.ceil(F.col("_c") / each * segment_slack)).cast("long").alias("segment_limit"))


def fill_containers(sizes: DataFrame, specs: DataFrame, cell: int = CELL, loss_slack: float = LOSS_SLACK, segment_slack: float = SEGMENT_SLACK) -> DataFrame:
    """(spec_id, container_id, position, doc_id, piece, token_start, token_end, loss_tokens, fill): where each text or piece stands.

    Items are dealt by hash into cells of about ``cell`` items, however large a source is, and each cell
    is packed by itself. The containers a cell leaves open, using less than ``REPACK_BELOW`` of every resource, are few;
    their items are packed once more, now across cells, so that what stays open does not grow with the number of
    cells. A text that is cut fills whole containers but for its rest. Empty texts are items of no
    tokens. Specs share nothing.
    """
    items = items_of(sizes, specs)
    whole = (F.col("token_end") - F.col("token_start")) == F.col("capacity")
    full = items.filter(whole).select("spec_id", F.lit(-1).cast("long").alias("cell"), F.lit(0).alias("bin"), F.lit(0).alias("position"), "doc_id", "piece", "token_start", "token_end", "loss_tokens", F.lit(1.0).alias("fill"))
    rest = items.filter(~whole)
    bounds = cut(limits(rest, loss_slack, segment_slack))  # one row per spec

    def dealt(df: DataFrame, counts: DataFrame, size: int) -> DataFrame:
        cells = F.greatest(F.lit(1).cast("long"), F.round(F.col("items") / size).cast("long"))
        return df.join(F.broadcast(counts), "spec_id").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), cells)).drop("items")

    packed = cut(dealt(rest, bounds, cell).groupBy("spec_id", "cell").applyInPandas(_pack_cell, PLACED_SCHEMA))
    good = packed.filter(F.col("fullest") >= REPACK_BELOW).drop("fullest")
    kinds = specs.filter("spec_id IS NOT NULL").dropDuplicates(["spec_id"]).select("spec_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    loose = packed.filter(F.col("fullest") < REPACK_BELOW).drop("cell", "bin", "position", "fill", "fullest").join(F.broadcast(kinds), "spec_id")
    left = loose.groupBy("spec_id").agg(F.count("*").alias("items")).join(F.broadcast(bounds.drop("items")), "spec_id")
    again = dealt(loose, left, cell).groupBy("spec_id", "cell").applyInPandas(_pack_cell, PLACED_SCHEMA).drop("fullest")
    again = again.withColumn("cell", -2 - F.col("cell"))
    placed = full.unionByName(good).unionByName(again)
    name = F.when(F.col("cell") == -1, F.format_string("%d/f/%d/%d", "spec_id", "doc_id", "piece")).when(F.col("cell") < -1, F.format_string("%d/r%d/%d", "spec_id", -2 - F.col("cell"), "bin")).otherwise(F.format_string("%d/c%d/%d", "spec_id", "cell", "bin"))
    return placed.select("spec_id", name.alias("container_id"), "position", "doc_id", "piece", "token_start", "token_end", "loss_tokens", "fill")


def fill_report(placed: DataFrame, specs: DataFrame, loss_slack: float = LOSS_SLACK, segment_slack: float = SEGMENT_SLACK) -> DataFrame:
    """Per spec: containers, tokens, the least number of containers any packing needs, the mean fill, and use per resource.

    ``fullest``, ``most_loss`` and ``most_segments`` are the largest uses of a container; ``at_tokens``, ``at_loss`` and ``at_segments`` count
    the containers that hold at least ``REPACK_BELOW`` of a limit. Full pieces of cut texts are containers of their own and outside the
    limits on loss and segments.
    """
    kinds = specs.filter("spec_id IS NOT NULL").dropDuplicates(["spec_id"]).select("spec_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    rows = placed.join(F.broadcast(kinds), "spec_id")
    bounds = limits(rows.filter(F.col("token_end") - F.col("token_start") < F.col("capacity")), loss_slack, segment_slack).drop("items")
    per_bin = rows.groupBy("spec_id", "container_id").agg(F.max("capacity").alias("capacity"), F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.sum("loss_tokens").alias("lost"), F.count("*").alias("segments"))
    per_bin = per_bin.join(F.broadcast(bounds), "spec_id", "left")  # one row per spec
    near = lambda use, limit: F.count_if(F.col(use) >= F.col(limit) * REPACK_BELOW)
    packed = F.col("used") < F.col("capacity")
    per_spec = per_bin.groupBy("spec_id").agg(
        F.max("capacity").alias("capacity_tokens"), F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.max("loss_limit").alias("loss_limit"), F.max(F.when(packed, F.col("lost"))).alias("most_loss"),
        F.max("segment_limit").alias("segment_limit"), F.max("segments").alias("most_segments"), near("used", "capacity").alias("at_tokens"), near("lost", "loss_limit").alias("at_loss"), near("segments", "segment_limit").alias("at_segments"))
    return per_spec.select("*", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("mean_fill"))
