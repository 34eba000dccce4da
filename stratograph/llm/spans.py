"""Long exact spans shared between records.

Lines are the units: the text from the start of each line on is digested over a fixed length, and
digests are grouped globally. That alone cannot give every span (one may begin and end inside lines, and
a line may be longer than a span), so two steps are added. Lines longer than the gap are given further
unit starts by winnowing, which makes sure that every span of the wanted length holds a unit whose
digest its copies share. Around shared units, all windows of exactly that length are then digested, and
two records share a span if and only if they share such a window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratograph.operators.skew import skew_join
from stratograph.session import cut, stored

LENGTH = 200
#: Characters of a unit; a span of LENGTH has LENGTH - UNIT + 1 places at which one may begin.
UNIT = 80
#: k-gram of the winnowing inside long lines; with windows of UNIT - GRAM + 1 grams it finds a start in any UNIT characters.
GRAM = 40

#: Rows from which the windows of one digest are split over tasks; fewer (some megabytes) meet in one.
HOT_ROWS = 50_000
#: Rows of fixed size up to which a set found by counting is broadcast; beyond, the same join is shuffled.
BROADCAST_ROWS = 500_000
#: Tasks for windows, as a multiple of the usual number: they are several times as large as the texts they are taken from.
WINDOW_TASKS = 4

UNIT_SCHEMA = "digest long, h long, pos int"
WINDOW_SCHEMA = "digest binary, prev long, h long, pos int"
#: Digests that are counted in a task before their counts are handed on.
COUNTED = 200_000


def _long(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def unit_starts(text: str, length: int = LENGTH, unit: int = UNIT) -> list[int]:
    """Starts of the units of a text: its own start, local minima among its line starts, and winnowed places in long lines.

    If two texts have a common substring of ``length`` characters, both have the same unit start in it with ``unit`` characters to follow.
    Either a line break lies in its first ``length - unit`` characters: the starts of lines behind it are the same in both, and of
    those within that many places the one of smallest digest is a minimum in both. Or they lie in one line, and then a full winnowing window does.
    """
    starts, lines, at, gap = [0], [], 0, length - unit
    for line in text.split("\n"):
        if at and at + unit <= len(text):
            lines.append((at, _long(text[at:at + unit])))
        if len(line) >= gap:
            size = unit - GRAM + 1
            grams = [_long(line[i:i + GRAM]) for i in range(len(line) - GRAM + 1)]
            last = -1
            for i in range(len(grams) - size + 1):
                if last < i or grams[i + size - 1] <= grams[last]:
                    last = min(range(i, i + size), key=lambda j: (grams[j], -j))
                    if last or at:
                        starts.append(at + last)
        at += len(line) + 1
    # a line start is a minimum if some ``gap`` places in a row hold it and no smaller one; of equal ones the last counts
    left, right, open_ = [-gap - 1] * len(lines), [len(text) + gap + 1] * len(lines), []
    for i, (p, digest) in enumerate(lines):
        while open_ and lines[open_[-1]][1] >= digest:
            right[open_.pop()] = p
        if open_:
            left[i] = lines[open_[-1]][0]
        open_.append(i)
    starts += [p for i, (p, _) in enumerate(lines) if right[i] - left[i] > gap]
    return sorted(set(starts))


def _units(batches: Iterator[pd.DataFrame], length: int, unit: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        records, places, digests = [], [], []
        for h, text in batch.itertuples(index=False):
            for p in unit_starts(text, length, unit):
                if p + unit <= len(text):
                    records.append(h)
                    places.append(p)
                    digests.append(_long(text[p:p + unit]))
        yield pd.DataFrame({"digest": pd.Series(digests, dtype="int64"), "h": pd.Series(records, dtype="int64"), "pos": pd.Series(places, dtype="int32")})


def _places(starts: list, chars: int, length: int, unit: int) -> Iterator[tuple[int, bool]]:
    """(place, whether the first unit at or after it is frequent) of each window around a unit of a text."""
    last = -1
    for s, near in sorted((x["pos"], x["near"]) for x in starts):
        for p in range(max(last + 1, s + unit - length, 0), min(s, chars - length) + 1):
            yield p, near
        last = max(last, s)


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _windows(batches: Iterator[pd.DataFrame], length: int, unit: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for h, text, starts in batch.itertuples(index=False):
            before = None
            for p, _ in _places(starts, len(text), length, unit):
                digest = _digest(text[p:p + length])
                rows.append((digest, before[1] if before and before[0] == p - 1 else None, h, p))
                before = (p, int.from_bytes(digest[:8], "big", signed=True))
        frame = pd.DataFrame(rows, columns=["digest", "prev", "h", "pos"])
        yield frame.astype({"prev": "Int64", "h": "int64", "pos": "int32"})


def _counts(batches: Iterator[pd.DataFrame], length: int, unit: int) -> Iterator[pd.DataFrame]:
    frame = lambda c: pd.DataFrame({"digest": pd.Series(list(c), dtype="object"), "n": pd.Series(list(c.values()), dtype="int64")})
    counted: Counter = Counter()
    for batch in batches:
        for _, text, starts in batch.itertuples(index=False):
            counted.update(_digest(text[p:p + length]) for p, near in _places(starts, len(text), length, unit) if near)
            if len(counted) >= COUNTED:
                yield frame(counted)
                counted = Counter()
    yield frame(counted)


def _in(df: DataFrame, few: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """Join with a stored set of rows of fixed size, broadcast if a count shows it small and shuffled otherwise."""
    return df.join(F.broadcast(few), key, how) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.join(few, key, how)


@dataclass(frozen=True)
class Sharing:
    """What records share: ``members`` (h, id, keeper_id, chars, copies), ``windows`` (digest, prev, h, pos) and ``hot`` (digest).

    Records of equal text are one class, ``h`` its number, so a text that a third of all records repeat is
    looked at once. ``windows`` are those of ``length`` characters around units that stand in more than
    one class, not yet compared; ``hot`` are the digests of frequent ones.
    """

    members: DataFrame
    windows: DataFrame
    hot: DataFrame
    length: int


def _number(text: Column) -> Column:
    return F.xxhash64(text)


def numbered(texts: DataFrame) -> DataFrame:
    """Add ``h``: one number per text, 64 bits of a hash. Texts whose numbers clash, which 128 bits of another hash tell, get other numbers."""
    m = F.unhex(F.md5("text"))
    clash = cut(texts.select(_number(F.col("text")).alias("h"), m.alias("m")).groupBy("h").agg(F.min("m").alias("a"), F.max("m").alias("b")).filter("a <> b").select("h", F.lit(True).alias("_clash")))
    out = texts.withColumn("h", _number(F.col("text")))
    if not clash.head(1):
        return out
    return _in(out, clash, "h", "left").withColumn("h", F.when(F.col("_clash"), F.xxhash64(m)).otherwise(F.col("h"))).drop("_clash")


def sharing(records: DataFrame, length: int = LENGTH, unit: int = UNIT, hot_rows: int = HOT_ROWS) -> Sharing:
    """Collect the windows of (id, text) records that may be shared.

    Repeated rows of an id count once; an id with several texts stands for all of them. Texts shorter than
    ``length``, null texts and null ids take no part. Texts stay where they are read; of each line only its digest,
    the class and the place are moved. Texts and windows are equal if their 128-bit digests are.

    Hot is a property of a window's digest, so equal windows are compared in one way. Counted are the windows
    whose unit is frequent: from the bound over the number of places a unit can have in a window. Of the
    windows of one digest, those with rarer units are fewer than the bound in all, so a digest of twice the
    bound or more is always found.
    """
    texts = numbered(records.filter(F.col("id").isNotNull() & (F.char_length("text") >= length)).select("id", "text"))
    named = texts.select("id", "h", F.char_length("text").alias("chars")).distinct()
    classes = named.groupBy("h").agg(F.min("id").alias("keeper_id"), F.count("*").alias("copies"))
    members = cut(skew_join(named, classes, ["h"], "inner", ["id"]))
    # one text per class: those of the other members are left where they are
    once = _in(texts, cut(members.filter("id <> keeper_id").select("id", "h")), ["id", "h"], "left_anti").select("h", "text")
    units = stored(once.mapInPandas(lambda b: _units(b, length, unit), UNIT_SCHEMA))
    common = units.groupBy("digest").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n")).filter("a <> b")
    common = cut(common.select("digest", (F.col("n") * (length - unit + 1) >= F.lit(hot_rows)).alias("near")))
    starts = _in(units, common, "digest", "inner").groupBy("h").agg(F.collect_set(F.struct("pos", "near")).alias("starts"))  # as many as the text has lines, at most
    starts = stored(starts)
    near = starts.filter(F.exists("starts", lambda s: s["near"]))
    # only texts with such units move; the sizes of their rows are not bounded, so how they are joined is left to the engine
    windows = _in(once, starts.select("h"), "h", "left_semi").join(starts, "h").mapInPandas(lambda b: _windows(b, length, unit), WINDOW_SCHEMA)
    near = _in(once, near.select("h"), "h", "left_semi").join(near, "h").mapInPandas(lambda b: _counts(b, length, unit), "digest binary, n long")
    hot = cut(near.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot_rows).select("digest"))
    return Sharing(members, windows, hot, length)


def _compared(found: Sharing) -> DataFrame:
    """Windows that stand in more than one class, with new: whether their holders may be new.

    ``new`` is false if all holders have the same window one character before: then all their pairs are
    pairs of that one. Windows that are not hot meet in one task per digest, which is few rows; for hot
    ones counts are taken by partials and joined back, by broadcast or over split keys.
    """
    def facts(agg):
        return {"shared": agg(F.min("h")) != agg(F.max("h")), "new": F.coalesce(agg(F.min("prev")) != agg(F.max("prev")), F.lit(True)) | (agg(F.count_if(F.col("prev").isNull())) > 0)}

    columns = ["digest", "h", "pos", "shared", "new"]
    few = found.hot.limit(BROADCAST_ROWS + 1).count()
    tasks = WINDOW_TASKS * int(found.hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = _in(found.windows, found.hot, "digest", "left_anti") if few else found.windows
    per_digest = Window.partitionBy("digest")
    told = cold.repartition(tasks, "digest").withColumns(facts(lambda c: c.over(per_digest))).select(*columns)
    if few:
        hot = _in(found.windows, found.hot, "digest", "left_semi")
        stats = hot.groupBy("digest").agg(*[c.alias(n) for n, c in facts(lambda c: c).items()])
        hot = hot.join(F.broadcast(stats), "digest") if few <= BROADCAST_ROWS else skew_join(hot, stats, ["digest"], "inner", ["h", "pos"])
        told = told.unionByName(hot.select(*columns))
    return told.filter("shared").drop("shared")


def class_pairs(found: Sharing) -> DataFrame:
    """(p, q), p < q: classes of different texts that share a span.

    Pairs come from windows whose holders may be new, so what is joined grows with the number of
    shared spans, not with their length, and every row joined is a pair of the result. The holders of a frequent window are
    split over tasks.
    """
    ends = cut(_compared(found).filter("new").select("digest", "h").distinct())
    pairs = skew_join(ends.select("digest", F.col("h").alias("p")), ends.select("digest", F.col("h").alias("q")), ["digest"], "inner", ["p"])
    return pairs.filter("p < q").select("p", "q").distinct()


def sharing_pairs(found: Sharing) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records that share a span. Members of one class share all of their text."""
    of = found.members.select("h", "id")
    with_p = skew_join(of.select(F.col("h").alias("p"), F.col("id").alias("x")), class_pairs(found), ["p"], "inner", ["x"])
    pairs = skew_join(of.select(F.col("h").alias("q"), F.col("id").alias("y")), with_p, ["q"], "inner", ["y"]).select("x", "y")
    same = found.members.filter("copies > 1").select("h", "id")
    within = skew_join(same.select("h", F.col("id").alias("x")), same.select("h", F.col("id").alias("y")), ["h"], "inner", ["x"]).filter("x < y").select("x", "y")
    return pairs.filter("x <> y").unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def sharing_classes(records: DataFrame, found: Sharing) -> DataFrame:
    """(id, class_id, copies, links): one row per record and text: its class, named by the smallest member, the members of that, and the
    other classes that share a span with it.

    Together with :func:`class_pairs` this says all that :func:`sharing_pairs` does without forming pairs of copies. Records without a text
    of ``length`` characters have a null class and no links.
    """
    pairs = class_pairs(found)
    links = pairs.select(F.col("p").alias("h")).unionByName(pairs.select(F.col("q").alias("h"))).groupBy("h").agg(F.count("*").alias("links"))
    told = skew_join(found.members.select("id", "h", "keeper_id", "copies"), links, ["h"], "left", ["id"])
    base = records.filter("id IS NOT NULL").select("id").distinct()
    return base.join(told, "id", "left").select("id", F.col("keeper_id").alias("class_id"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def shared_share(records: DataFrame, found: Sharing) -> DataFrame:
    """Per record: its characters, how many lie in shared spans, the spans, and how many are repeats.

    ``spans`` lists maximal runs as begin-end (end exclusive, characters of the original text).
    ``removable_chars`` are characters in windows for which an earlier ranked record (smaller id)
    exists: dropping those keeps the earliest occurrence of everything. Records without shared
    spans are reported with zeros; records of null text with null characters. Nothing here forms pairs.
    """
    length = found.length
    keepers = found.members.select("h", "keeper_id").distinct()
    rows = cut(_compared(found).select("digest", "h", "pos"))
    first = rows.join(keepers, "h").groupBy("digest").agg(F.min("keeper_id").alias("first_id"))
    ranked = skew_join(rows, first, ["digest"], "inner", ["h", "pos"]).join(keepers, "h")

    def covered(df: DataFrame, out: str) -> DataFrame:
        by_place = Window.partitionBy("h").orderBy("pos")
        step = F.least(F.lit(length), F.coalesce(F.lead("pos").over(by_place) - F.col("pos"), F.lit(length)))
        return df.select("h", "pos").distinct().withColumn("_chars", step).groupBy("h").agg(F.sum("_chars").alias(out))

    by_place = Window.partitionBy("h").orderBy("pos")
    runs = rows.select("h", "pos").distinct().withColumn("_new", (F.col("pos") > F.coalesce(F.lag("pos").over(by_place) + length, F.lit(-1))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(by_place)).groupBy("h", "_run").agg(F.min("pos").alias("begin"), (F.max("pos") + length).alias("end"))
    spans = runs.groupBy("h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "end"))), lambda s: F.concat(s["begin"], F.lit("-"), s["end"])), " ").alias("spans"))
    of_class = keepers.join(covered(rows, "shared"), "h", "left").join(covered(ranked.filter("first_id < keeper_id"), "again"), "h", "left").join(spans, "h", "left").drop("keeper_id")
    members = found.members.join(of_class, "h")
    whole = F.col("copies") > 1
    told = members.select("id", F.when(whole, F.col("chars")).otherwise(F.coalesce("shared", F.lit(0))).alias("s"), F.when(F.col("id") != F.col("keeper_id"), F.col("chars")).otherwise(F.coalesce("again", F.lit(0))).alias("r"),
                          F.when(whole, F.concat(F.lit("0-"), "chars")).otherwise(F.coalesce("spans", F.lit(""))).alias("t"))
    told = told.groupBy("id").agg(F.max("s").alias("s"), F.max("r").alias("r"), F.max("t").alias("t"))
    base = records.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.char_length("text")).cast("long").alias("chars"))
    return base.join(told, "id", "left").select("id", "chars", F.coalesce("s", F.lit(0)).cast("long").alias("shared_chars"), F.coalesce("r", F.lit(0)).cast("long").alias("removable_chars"), F.coalesce("t", F.lit("")).alias("spans"))
