"""Token ids, token budgets and containers of fixed capacity, all by a public byte-level tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import bpe, labels
from quern.runtime import materialise, ship, spread

TOKENIZER = "byte_bpe_50k"
#: Ranks within one length are counted in slices of about so many rows, so a length that many rows share is no single task.
SLICE = 20_000


def encode(documents: DataFrame, tokenizer: str = TOKENIZER, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of each row: ``key, ids ARRAY<INT>``; one pass, no shuffle.

    Special-token strings are ordinary text. Null and empty texts give an empty list, repeated rows repeated
    results, an empty table no rows; any length of text is encoded whole; other columns are ignored.
    """
    ship(documents.sparkSession)
    folder = labels.tokenizer_folder(folder)

    def run(batches):
        model = bpe.load(bpe.Backtracking, folder, tokenizer)
        for batch in batches:
            parts = [model.encode(x.as_py()) for x in batch.column(1)]
            ends = np.zeros(len(parts) + 1, "i8")
            np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
            values = pa.array(np.frombuffer(b"".join(parts), "i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["k", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count(documents: DataFrame, tokenizer: str = TOKENIZER, folder: str | None = None, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``documents`` without ``text`` and with its token count; null and empty texts count 0. One pass, no shuffle."""
    ship(documents.sparkSession)
    folder = labels.tokenizer_folder(folder)
    kept = [c for c in documents.columns if c not in (text, into)]
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        model = bpe.load(bpe.Heap, folder, tokenizer)
        for batch in batches:
            counts = pa.array([model.count(x.as_py()) for x in batch.column(len(kept))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], counts], [*kept, into])

    return spread(documents.select(*[F.col(f"`{c}`") for c in kept], F.col(text))).mapInArrow(run, f"{fields}{', ' if fields else ''}`{into}` bigint")


def budget(documents: DataFrame, tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """Tokens of each source, language, domain and lane, of each combination, and of all.

    ``level, source, language, domain, lane, n_docs, n_tokens, n_distinct_docs, n_distinct_tokens``. Labels come
    in one spelling (NULL for none, shown as NULL with the level naming the column). Of exact copies the one with
    the least ``doc_id`` counts as distinct; null and empty texts are documents of no tokens. Counts and copies
    are over all rows. Text never shuffles: a 128-bit key of it does, pre-aggregated on the map side.
    """
    base = documents.select(
        "doc_id",
        "text",
        labels.slug(F.col("source")).alias("source"),
        labels.language(F.col("lang")).alias("language"),
        labels.slug(F.col("domain")).alias("domain"),
        labels.slug(F.col("capability_lane"), "_").alias("lane"),
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(7), F.reverse("text"), F.length("text")).alias("h2"),
    )
    counted = materialise(count(base, tokenizer, folder), "budget")
    first = counted.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(1).alias("is_first"))
    marked = counted.join(first, "doc_id", "left").withColumn("is_first", F.coalesce("is_first", F.lit(0)))
    # one row per combination first: the rollup then works on a few thousand rows
    fine = marked.groupBy("source", "language", "domain", "lane").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("is_first").alias("n_distinct_docs"),
        F.sum(F.col("n_tokens") * F.col("is_first")).alias("n_distinct_tokens"),
    )
    levels = {"all": [], "source": ["source"], "language": ["language"], "domain": ["domain"], "lane": ["lane"], "source_language_domain_lane": ["source", "language", "domain", "lane"]}
    names = ["source", "language", "domain", "lane"]
    spread = fine.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    shown = [F.when(F.col("level").isin(*[x for x, cols in levels.items() if c in cols]), F.col(c)).alias(c) for c in names]
    sums = ["n_docs", "n_tokens", "n_distinct_docs", "n_distinct_tokens"]
    return spread.select("level", *shown, *sums).groupBy("level", *names).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums])


# --- containers -------------------------------------------------------------------------------------------------


class Planner:
    """Containers of a histogram of lengths; at most ``capacity`` lengths, however many items there are.

    Lengths that fill a container with one, two, three or four items exactly are matched through an index of
    which lengths are still available; what is left goes best fit, longest first. Every choice is made for as many
    containers at once as the counts allow, so the work depends on the capacity only.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, "i8")
        for length, number in histogram.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"length {length} doesn't fit a container of {capacity}")
            self.left[length] = number
        self.plan: list[tuple[tuple[int, ...], int]] = []

    def _take(self, lengths: tuple[int, ...]) -> None:
        """As many containers of these lengths as there are items for."""
        kinds, uses = np.unique(lengths, return_counts=True)
        number = int((self.left[kinds] // uses).min())
        if number:
            self.left[kinds] -= number * uses
            self.plan.append((lengths, number))

    def _available(self, gap: int, used: tuple[int, ...]) -> np.ndarray:
        free = self.left[: gap + 1].copy()
        for x in used:
            if x <= gap:
                free[x] -= 1
        return free > 0

    def _pair(self, gap: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """Two available lengths, the larger first and as large as possible, that sum to ``gap``."""
        if gap < 2:
            return None
        free = self._available(gap, used)
        both = free[1:gap] & free[1:gap][::-1]
        for high in np.flatnonzero(both)[::-1][:1] + 1:
            low = gap - int(high)
            if high == low and self.left[low] - used.count(low) < 2:
                both[low - 1] = False
                others = np.flatnonzero(both)[::-1] + 1
                if not len(others):
                    return None
                high = others[0]
                low = gap - int(high)
            return int(high), low
        return None

    def _triple(self, gap: int, used: tuple[int, ...]) -> tuple[int, int, int] | None:
        for high in (np.flatnonzero(self._available(gap, used)[: max(gap - 1, 0)])[::-1]).tolist():
            if high * 3 < gap:
                return None
            if (pair := self._pair(gap - high, (*used, high))) is not None:
                return high, *pair
        return None

    def run(self) -> list[tuple[tuple[int, ...], int]]:
        """(lengths of a container, number of such containers), in order of the container ids."""
        self._take((self.capacity,))
        for find in (lambda g, u: (g,) if g > 0 and self._available(g, u)[g] else None, self._pair, self._triple):
            for length in range(self.capacity - 1, 0, -1):
                while self.left[length] > 0 and (rest := find(self.capacity - length, (length,))) is not None:
                    self._take((length, *rest))
        self._best_fit()
        return self.plan

    def _best_fit(self) -> None:
        open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        rooms = np.zeros(self.capacity + 1, bool)

        def add(lengths: tuple[int, ...], number: int) -> None:
            room = self.capacity - sum(lengths)
            open_by_room.setdefault(room, []).append((lengths, number))
            rooms[room] = True

        for length in range(self.capacity, 0, -1):
            number = int(self.left[length])
            while number:
                fitting = np.flatnonzero(rooms[length:])
                if not len(fitting):  # a new container holds as many of this length as fit, for all at once
                    fit = self.capacity // length
                    full, rest = divmod(number, fit)
                    if full:
                        add((length,) * fit, full)
                    if rest:
                        add((length,) * rest, 1)
                    break
                room = int(fitting[0]) + length
                lengths, containers = open_by_room[room].pop()
                rooms[room] = bool(open_by_room[room])
                fit = min(room // length, number)
                moved = min(containers, number // fit)
                if containers > moved:
                    open_by_room[room].append((lengths, containers - moved))
                    rooms[room] = True
                add((*lengths, *(length,) * fit), moved)
                number -= moved * fit
        self.left[:] = 0
        for room in sorted(open_by_room):
            self.plan.extend(open_by_room[room])


def ranked(items: DataFrame, size: str, order: list[str], most: int, into: str = "rank", rows: int = SLICE) -> DataFrame:
    """Rank (from 0) of each row within its ``size``, of which one has at most ``most`` rows, by slices of about ``rows``."""
    sliced = items.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(-(-most // rows) or 1)).cast("int"))
    counts = sliced.groupBy(size, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(size).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(size, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(size, "_slice").orderBy(*order)
    return sliced.withColumn("_row", F.row_number().over(within)).join(starts, [size, "_slice"]).withColumn(into, F.col("_start") + F.col("_row") - 1).drop("_slice", "_row", "_start")


def containers(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """Documents in containers of ``capacity`` tokens, cut only where a document exceeds the capacity.

    One row per item: ``container_id, doc_id, part_no, start_token, n_tokens, unused`` (``unused`` is its container's).
    A longer document is cut into full parts and a rest. Documents without tokens (null, empty) take no space: their
    row has a NULL container. Repeated documents are items of their own; an empty table gives no rows. Only the
    histogram of lengths, at most ``capacity`` rows, goes to the driver; ids are deterministic.
    """
    spark = documents.sparkSession
    sizes = materialise(count(documents.select("doc_id", "text"), tokenizer, folder), "sizes")
    parts = (
        sizes.filter("n_tokens > 0")
        .withColumn("part_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))))
        .select("doc_id", "part_no", (F.col("part_no") * F.lit(capacity).cast("bigint")).alias("start_token"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("part_no") * capacity).alias("n_tokens"))
    )
    histogram = {r[0]: r[1] for r in parts.groupBy("n_tokens").count().collect()}
    plan = Planner(histogram, capacity).run()

    rows: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, items a container, first container, unused
    taken: dict[int, int] = {}
    container = 0
    for lengths, number in plan:
        unused = capacity - sum(lengths)
        for length in sorted(set(lengths)):
            uses = lengths.count(length)
            start = taken.get(length, 0)
            rows.setdefault(length, []).append((start, uses, container, unused))
            taken[length] = start + uses * number
        container += number
    found = spark.sparkContext.broadcast({length: np.array(x, "i8") for length, x in rows.items()})

    def place(batches):
        lookup = found.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            ids, unused = np.zeros(len(length), "i8"), np.zeros(len(length), "i8")
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                table = lookup[int(one)]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                ids[at] = row[:, 2] + (rank[at] - row[:, 0]) // row[:, 1]
                unused[at] = row[:, 3]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *batch.columns[:4], pa.array(unused)], ["container_id", "doc_id", "part_no", "start_token", "n_tokens", "unused"])

    schema = "container_id bigint, doc_id bigint, part_no int, start_token bigint, n_tokens bigint, unused bigint"
    placed = ranked(parts, "n_tokens", ["doc_id", "part_no"], max(histogram.values(), default=0)).select("doc_id", "part_no", "start_token", "n_tokens", "rank").mapInArrow(place, schema)
    nothing = sizes.filter("n_tokens = 0").selectExpr("cast(null as bigint) container_id", "doc_id", "0 part_no", "cast(0 as bigint) start_token", "n_tokens", "cast(null as bigint) unused")
    return placed.unionByName(nothing)
