"""Filling containers of fixed capacity with texts of varying length."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.common import cut_lineage, prefix_offsets
from .tokens import VOCABULARY, count_tokens, token_slice

Pattern = tuple[tuple[int, int], ...]


class _Stock:
    """Items left, by size: a sorted list of sizes and their counts."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, room: int, without: dict[int, int]) -> int:
        """Largest size that fits when some items are already in use; 0 if none."""
        i = bisect_right(self.sizes, room) - 1
        while i >= 0 and self.count[self.sizes[i]] <= without.get(self.sizes[i], 0):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, n: int, without: int, above: int = 0) -> list[int]:
        """The n smallest items larger than ``above`` besides one item of size ``without``."""
        out: list[int] = []
        for s in self.sizes[bisect_right(self.sizes, above) :]:
            out += [s] * min(n - len(out), self.count[s] - (s == without))
            if len(out) >= n:
                break
        return out


def _best_pair(stock: _Stock, item: int, room: int) -> tuple[int, int]:
    """Two further items of greatest sum within room, larger first; (0, 0) if none."""
    best, pair = 0, (0, 0)
    i, j = 0, bisect_right(stock.sizes, room) - 1
    free = lambda s: stock.count[s] - (s == item)
    while i <= j:
        a, b = stock.sizes[j], stock.sizes[i]
        if a + b > room or not free(a):
            j -= 1
        else:
            if free(b) >= (2 if a == b else 1) and a + b > best:
                best, pair = a + b, (a, b)
            i += 1
    return pair


def reduce_by_dominance(stock: _Stock, capacity: int) -> list[tuple[int, Pattern]]:
    """Martello-Toth reduction: takes containers out of ``stock`` whose contents dominate.

    Sizes are visited from the largest. With an item j, the set {j} is fixed if nothing
    else fits; {j, largest partner} if at most one more item fits or the pair fills the
    container, or if two fit but no two sum to more than the partner; {j, a, b} if two fit,
    the best pair holds the partner itself, and no two items larger than b fit together. A set that dominates one item dominates its equals as long as
    both sizes last (taking items away never adds alternatives), so it is fixed that many times at once;
    the work depends on the number of sizes, not of items.
    """
    fixed: list[tuple[int, Pattern]] = []
    again = True
    while again:
        again = False
        for s in sorted(stock.sizes, reverse=True):
            while stock.count.get(s):
                room = capacity - s
                partner = stock.largest(room, {s: 1})
                if not partner:
                    n = stock.count[s]
                    stock.take(s, n)
                    fixed.append((n, ((s, 1),)))
                    again = True
                    break
                few = stock.smallest(3, s)
                fits = sum(1 for k in range(len(few)) if sum(few[: k + 1]) <= room)
                members: tuple[int, ...] = ()
                if fits == 1 or s + partner == capacity:
                    members = (s, partner)
                elif fits == 2:
                    a, b = _best_pair(stock, s, room)
                    if partner >= a + b:
                        members = (s, partner)
                    elif a == partner and sum(stock.smallest(2, s, above=b) or [capacity]) > room:
                        members = (s, a, b)
                if not members:
                    break
                need = {m: members.count(m) for m in members}
                n = min(stock.count[m] // k for m, k in need.items())
                for m, k in need.items():
                    stock.take(m, n * k)
                fixed.append((n, tuple(sorted(need.items(), reverse=True))))
                again = True
    return fixed


def best_fit(stock: _Stock, capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing over what is left, for all items of a size at once.

    Open containers are kept as classes of equal room and contents. An item goes to the
    least room that takes it, and its equals follow into the same container while they fit,
    so a class takes room // size items per container before the next class is tried.
    """
    rooms: list[int] = []
    classes: dict[int, list[tuple[int, Pattern]]] = {}

    def put(room: int, n: int, pattern: Pattern) -> None:
        if room not in classes:
            insort(rooms, room)
            classes[room] = []
        classes[room].append((n, pattern))

    for s in sorted(stock.sizes, reverse=True):
        left = stock.count[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                n, pattern = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    rooms.pop(i)
            else:
                room, n, pattern = capacity, left, ()
            each = room // s
            full = min(n, left // each)
            left -= full * each
            if full:
                put(room - each * s, full, (*pattern, (s, each)))
            if full < n and left:
                put(room - left * s, 1, (*pattern, (s, left)))
                left, full = 0, full + 1
            if full < n and pattern:
                put(room, n - full, pattern)
    return [x for group in classes.values() for x in group]


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Contents of all containers as (number of containers, ((size, items), ...)).

    ``counts`` has sizes from 1 to the capacity. Containers fixed by dominance come first.
    """
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("sizes must lie between 1 and the capacity")
    stock = _Stock(counts)
    return reduce_by_dominance(stock, capacity) + best_fit(stock, capacity)


def pack_documents(docs: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, buckets: int = 64) -> DataFrame:
    """``spec_id, container_id, doc_id, piece, token_start, n_tokens``: every text's container.

    A text longer than the capacity is cut into pieces of the capacity and a rest; no other
    text is cut. Null texts and texts without tokens take no room and come out with
    container_id null. Specs without a positive capacity are left out.

    Only the histogram of sizes reaches the driver: at most ``capacity`` rows per spec,
    whatever the number of documents. Dominance reduction and best fit plan on it; the plan
    goes back as ranges of ranks within a size. Ranks come from a running count over
    (size, bucket) on top of bucket sums, so a size that holds a third of all texts is spread.
    """
    sized = count_tokens(docs.select(key, text), text, vocabulary)
    spec = [(r["spec_id"], r["capacity_tokens"]) for r in specs.where("capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").collect()]
    spark = docs.sparkSession
    shape = "spec_id int, container_id long, piece int, token_start long, n_tokens long"
    if not spec:
        return spark.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, {shape}").select("spec_id", "container_id", key, "piece", "token_start", "n_tokens")
    sized = cut_lineage(sized)  # counted once, read for the histogram and for the assignment
    capacities = F.explode(F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(int(c)).cast("long").alias("_c")) for i, c in spec])).alias("_s")
    cut = sized.where("n_tokens > 0").select(key, "n_tokens", capacities).select(key, "_s.spec_id", "_s._c", "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("_s._c")).cast("int"))).alias("piece"))
    items = cut.select("spec_id", key, "piece", (F.col("piece") * F.col("_c")).alias("token_start"), F.least(F.col("_c"), F.col("n_tokens") - F.col("piece") * F.col("_c")).alias("size"))

    counts: dict[int, dict[int, int]] = {i: {} for i, _ in spec}
    for r in items.groupBy("spec_id", "size").count().collect():  # at most the sum of all capacities
        counts[r["spec_id"]][r["size"]] = r["count"]
    ranges = []
    for i, c in spec:
        container, used = 0, dict.fromkeys(counts[i], 0)
        for n, pattern in plan_containers(counts[i], c):
            for size, each in pattern:
                ranges.append((i, size, used[size], used[size] + n * each, each, container))
                used[size] += n * each
            container += n
    plan = spark.createDataFrame(ranges, "spec_id int, size long, first long, stop long, each int, container long")
    by_size = plan.groupBy("spec_id", "size").agg(F.sort_array(F.collect_list(F.struct("first", "stop", "each", "container"))).alias("_ranges"))

    based = prefix_offsets(items, ["spec_id", "size"], F.lit(1).cast("long"), F.struct(key, "piece"), buckets)
    rank = F.col("_base") + F.row_number().over(Window.partitionBy("spec_id", "size", "_bucket").orderBy(key, "piece")) - 1
    placed = based.withColumn("_rank", rank).join(by_size, ["spec_id", "size"])
    hit = F.filter("_ranges", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["stop"]))[0]
    packed = placed.withColumn("_r", hit).select(
        "spec_id", (F.col("_r.container") + F.floor((F.col("_rank") - F.col("_r.first")) / F.col("_r.each"))).cast("long").alias("container_id"), key, "piece", "token_start", F.col("size").alias("n_tokens")
    )
    empty = sized.where("n_tokens = 0").select(key, capacities).select(F.col("_s.spec_id").alias("spec_id"), F.lit(None).cast("long").alias("container_id"), key, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("n_tokens"))
    return packed.unionByName(empty)


def attach_text(packed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds each piece's text; pieces of a cut text join to the whole text.

    Pieces are gathered per document (their number is bounded by its length), so a text is
    moved and tokenized once, however many pieces it was cut into.
    """
    cols = ["spec_id", "container_id", "piece", "token_start", "n_tokens"]
    schema = T.StructType([*[packed.schema[c] for c in packed.columns], T.StructField("text", T.StringType())])
    rows = packed.groupBy(key).agg(F.collect_list(F.struct(*cols)).alias("_pieces")).join(docs.select(key, F.col(text).alias("_text")), key).select(key, "_pieces", "_text")
    order = packed.columns

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out: dict[str, list] = {c: [] for c in [*order, "text"]}
                which: list[int] = []
                for i, (pieces, body) in enumerate(zip(part.column("_pieces").to_pylist(), part.column("_text").to_pylist())):
                    cut = {p["spec_id"] for p in pieces if p["piece"] > 0}
                    parts = [p for p in pieces if p["spec_id"] in cut]
                    known = iter(token_slice(body, [(p["token_start"], p["token_start"] + p["n_tokens"]) for p in parts], vocabulary) if parts else [])
                    for p in pieces:
                        which.append(i)
                        for c in cols:
                            out[c].append(p[c])
                        out["text"].append(next(known) if p["spec_id"] in cut else body)
                keys = part.column(key).take(pa.array(which, pa.int64()))
                names = [*order, "text"]
                fields = to_arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([keys if c == key else pa.array(out[c], fields.field(c).type) for c in names], names=names)

    return rows.mapInArrow(slices, schema)
