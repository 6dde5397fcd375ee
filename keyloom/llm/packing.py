"""Filling containers of a fixed capacity with documents measured in tokens.

A grouping genetic algorithm after Falkenauer: a solution is a list of bins, not of items. Crossover
injects whole, well-filled bins of one parent into the other and drops the bins that then hold an item
twice; mutation empties badly filled bins. The displaced documents are put back by local search: new
bins are made of them that are full by a subset sum, so that no other filling dominates them, and the
rest goes, largest first, where it fits best. Fitness is the mean of (fill / capacity)^2.

Documents are dealt at random into regions of about ``REGION`` documents, whose size does not depend
on the data. Each region is evolved by several islands with populations of their own, all in parallel;
between epochs every island's best solution migrates to the next island. The badly filled bins of all
regions are opened and packed once more, in regions of their own, so that the space left over does not
grow with the number of regions.
"""

from __future__ import annotations

import base64
import pickle
import random
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.runtime import durable, spread

CAPACITY = 4096
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary's public tokenizer cuts a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a region, islands of a region, epochs between migrations.
REGION, ISLANDS, EPOCHS = 5000, 3, 2
#: Solutions of an island and children born in an epoch.
POPULATION, CHILDREN = 6, 12
#: Documents among which a subset sum is looked for.
POOL = 40
#: Most tasks of an epoch for each core of the session.
TASKS = 16
#: Bins filled less than this are opened and packed again; how often.
REOPEN, ROUNDS = 0.999, 2

Bin = tuple[int, tuple[int, ...]]  # fill, items


def _best_fit(bins: list[Bin], items: Sequence[int], sizes: Sequence[int], capacity: int) -> list[Bin]:
    """Put items, largest first, into the bin that leaves least room; open new bins where none fits."""
    rooms = sorted((capacity - fill, k) for k, (fill, _) in enumerate(bins))
    held = [list(b[1]) for b in bins]
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k = capacity, len(held)
            held.append([])
        held[k].append(i)
        insort(rooms, (room - sizes[i], k))
    fill = {k: capacity - room for room, k in rooms}
    return [(fill[k], tuple(h)) for k, h in enumerate(held)]


def fitness(bins: Sequence[Bin], capacity: int) -> float:
    """Mean squared fill; more when fewer and fuller bins hold the same items."""
    return sum((fill / capacity) ** 2 for fill, _ in bins) / max(1, len(bins))


def _subset(sizes: Sequence[int], room: int) -> list[int]:
    """Places of the sizes whose sum comes closest to ``room`` from below. Bit n of a number stands for the sum n."""
    mask, sums = (1 << (room + 1)) - 1, [1]
    for x in sizes:
        sums.append((sums[-1] | (sums[-1] << x)) & mask)
        if sums[-1] >> room:
            break
    left, some = sums[-1].bit_length() - 1, []
    for k in range(len(sums) - 2, -1, -1):
        if not sums[k] >> left & 1:
            some.append(k)
            left -= sizes[k]
    return some


def refill(bins: list[Bin], loose: Sequence[int], sizes: Sequence[int], capacity: int, rnd: random.Random) -> list[Bin]:
    """``bins`` and the loose items: full bins are made of them by subset sums, what is left over is best-fitted."""
    wait = sorted((i for i in loose if sizes[i]), key=lambda i: (sizes[i], i))
    rest = [i for i in loose if not sizes[i]]
    made = list(bins)
    while wait:
        first = wait.pop()
        room = capacity - sizes[first]
        at = rnd.sample(range(len(wait)), min(POOL, len(wait)))
        chosen = sorted((at[k] for k in _subset([sizes[wait[k]] for k in at], room)), reverse=True)
        if sum(sizes[wait[k]] for k in chosen) == room:
            made.append((capacity, (first, *[wait.pop(k) for k in chosen])))
        else:
            rest.append(first)
    return _best_fit(made, rest, sizes, capacity)


def crossover(one: list[Bin], other: list[Bin], sizes: Sequence[int], capacity: int, rnd: random.Random) -> list[Bin]:
    """``one`` with whole bins of ``other``: some of its fullest; bins that share an item with them, and a few bad ones, are taken apart."""
    ranked = sorted(other, key=lambda b: -b[0])
    some = ranked[: max(1, len(ranked) // 2)]
    injected = rnd.sample(some, max(1, len(some) // 2))
    taken = {i for _, items in injected for i in items}
    kept, loose = list(injected), []
    for b in one:
        if taken.isdisjoint(b[1]):
            kept.append(b)
        else:
            loose += [i for i in b[1] if i not in taken]
    return refill(kept, loose, sizes, capacity, rnd)


def mutate(bins: list[Bin], sizes: Sequence[int], capacity: int, rnd: random.Random) -> list[Bin]:
    """Empty all bins that are not full and as many full ones, and put their items back."""
    bad = [k for k, (fill, _) in enumerate(bins) if fill < capacity]
    out = {*bad, *rnd.sample(range(len(bins)), min(len(bins), len(bad) + 2))}
    return refill([b for k, b in enumerate(bins) if k not in out], [i for k in sorted(out) for i in bins[k][1]], sizes, capacity, rnd)


def _start(sizes: Sequence[int], capacity: int, rnd: random.Random, plain: bool) -> list[Bin]:
    """A first solution: best fit of all, or of the rest after a random third is packed in random order."""
    if plain:
        return _best_fit([], range(len(sizes)), sizes, capacity)
    items = list(range(len(sizes)))
    rnd.shuffle(items)
    cut, bins = len(items) // 3, []
    for i in items[:cut]:
        bins = [(bins[0][0] + sizes[i], (*bins[0][1], i)), *bins[1:]] if bins and bins[0][0] + sizes[i] <= capacity else [(sizes[i], (i,)), *bins]
    return _best_fit(bins, items[cut:], sizes, capacity)


def evolve(sizes: Sequence[int], population: list[list[Bin]], capacity: int, children: int, rnd: random.Random) -> list[list[Bin]]:
    """The population after so many births, best first; stops where no solution can have fewer bins."""
    least = -(-sum(sizes) // capacity)
    pool = sorted(population, key=lambda b: -fitness(b, capacity))
    for _ in range(children):
        best = pool[0]
        if len(best) <= max(1, least):
            break
        a, b = (min(rnd.sample(range(len(pool)), min(2, len(pool)))) for _ in "ab")
        child = crossover(pool[a], pool[b], sizes, capacity, rnd)
        if rnd.random() < 0.5:
            child = mutate(child, sizes, capacity, rnd)
        pool.append(child)
        pool.sort(key=lambda b: -fitness(b, capacity))
        pool.pop()
    return pool


def _epoch(frames: Iterator[pd.DataFrame], capacity: int, population: int, children: int, epoch: int) -> Iterator[pd.DataFrame]:
    for d in frames:
        out = []
        for region, island, sizes, pop, guest in zip(d["region"], d["island"], d["sizes"], d["pop"], d["guest"]):
            rnd = random.Random(f"{region}-{island}-{epoch}")
            sizes = [int(x) for x in sizes]
            pool = pickle.loads(pop) if pop is not None else [_start(sizes, capacity, rnd, k == 0) for k in range(population)]
            if guest is not None:
                pool[-1] = pickle.loads(guest)
            pool = evolve(sizes, pool, capacity, children, rnd)
            out.append((region, island, pickle.dumps(pool), pickle.dumps(pool[0]), fitness(pool[0], capacity)))
        yield pd.DataFrame(out, columns=["region", "island", "pop", "guest", "fit"])


_STATE = "region long, island int, pop binary, guest binary, fit double"


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in frames:
        rows = []
        for region, ids, sizes, best in zip(d["region"], d["ids"], d["sizes"], d["guest"]):
            for k, (fill, items) in enumerate(pickle.loads(best)):
                rows += [(ids[i], int(sizes[i]), region, k, fill) for i in items]
        yield pd.DataFrame(rows, columns=["rid", "size", "region", "bin", "fill"])


def pack_items(items: DataFrame, capacity: int, region: int = REGION, islands: int = ISLANDS, epochs: int = EPOCHS, salt: int = 0, population: int = POPULATION, children: int = CHILDREN) -> DataFrame:
    """(rid, size) of at most ``capacity`` each -> rid, size, region, bin, fill, by the genetic algorithm on islands."""
    kept = durable(items)
    regions = max(1, round(kept.count() / region))
    dealt = kept.withColumn("region", F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(regions)))
    # a region's size is bounded by the random deal, whatever the documents are
    tasks = dealt.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("rid", "size"))).alias("x")).select("region", F.col("x.rid").alias("ids"), F.col("x.size").alias("sizes"))
    tasks = durable(tasks)
    slots = min(regions * islands, TASKS * items.sparkSession.sparkContext.defaultParallelism)
    state = tasks.select("region", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("binary").alias("pop"), F.lit(None).cast("binary").alias("guest"))
    for e in range(epochs):
        # a task for each island while there are no more than the cores can take at once a few times over
        slot = F.pmod(F.col("region") * islands + F.col("island"), F.lit(slots)).cast("int")
        bred = state.repartitionById(slots, slot).mapInPandas(lambda f, e=e: _epoch(f, capacity, population, children, e), _STATE)
        bred = durable(bred)
        if e < epochs - 1:
            migrants = bred.select("region", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "guest")
            state = bred.drop("guest", "fit").join(migrants, ["region", "island"]).join(tasks.drop("ids"), "region").select("region", "sizes", "island", "pop", "guest")
    best = bred.groupBy("region").agg(F.max_by("guest", F.struct("fit", -F.col("island"))).alias("guest"))
    return best.join(tasks, "region").select("region", "ids", "sizes", "guest").mapInPandas(_unpack, "rid long, size int, region long, bin int, fill int")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """rid (a number for each row), doc_id, tokens; null texts have none."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    counted = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(count, "doc_id long, tokens long")
    return durable(counted.withColumn("rid", F.monotonically_increasing_id()))


def fill_containers(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, region: int = REGION, rounds: int = ROUNDS) -> DataFrame:
    """Each document's containers: doc_id, part, first_token, tokens, container, fill (of the container).

    A document of at most ``capacity`` tokens is one part; a longer one is split into full containers of
    its own and a last part, which is packed like a document. Null and empty texts take no room but get
    a container. Repeated rows and ids are packed one by one. An empty table gives no rows. ``docs``
    needs doc_id and text; other columns are not read.
    """
    counted = token_counts(docs, vocabulary)
    full = F.when(F.col("tokens") > capacity, F.floor(F.col("tokens") / capacity)).otherwise(F.lit(0))
    sized = counted.withColumn("full", full).withColumn("rest", (F.col("tokens") - F.col("full") * capacity).cast("int"))
    own = sized.filter("full > 0").select("rid", "doc_id", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("part")).select("doc_id", "part", (F.col("part").cast("long") * capacity).alias("first_token"), F.lit(capacity).alias("tokens"), F.concat_ws("-", F.lit("d"), "rid", "part").alias("container"), F.lit(capacity).alias("fill"))
    items = sized.filter("full = 0 or rest > 0").select("rid", F.col("rest").alias("size"))
    packed = None
    for r in range(rounds):
        got = durable(pack_items(items, capacity, region, salt=r))
        last = r == rounds - 1
        done = got if last else got.filter(F.col("fill") >= REOPEN * capacity)
        named = done.select("rid", "size", F.concat_ws("-", F.lit(f"p{r}"), "region", "bin").alias("container"), "fill")
        packed = named if packed is None else packed.union(named)
        if not last:
            items = got.filter(F.col("fill") < REOPEN * capacity).select("rid", "size")
    parts = packed.join(sized.select("rid", "doc_id", "full"), "rid").select("doc_id", F.col("full").cast("int").alias("part"), (F.col("full") * capacity).cast("long").alias("first_token"), F.col("size").alias("tokens"), "container", "fill")
    return parts.union(own)
